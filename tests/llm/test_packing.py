import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from faultspark.llm import packing
from faultspark.llm.token_ids import default_tokenizer, encoder
from tests.llm.conftest import odd_rows


def fewest(items, c):
    """The least number of sequences, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= c}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def spread(p):
    """Sequences as sorted (offset, length) lists."""
    out = defaultdict(list)
    for length, _, seq, per, offset, count in p.slots:
        for k in range(count):
            out[seq + k // per].append((offset + k % per * length, length))
    return {k: sorted(v) for k, v in out.items()}


@settings(max_examples=300, deadline=None)
@given(st.integers(6, 30), st.lists(st.integers(1, 30), max_size=10))
def test_reduction_keeps_the_optimum_and_nothing_overlaps(c, items):
    items = [min(x, c) for x in items]
    p = packing.Packing(dict(Counter(items)), c)
    assert sorted(x for b in spread(p).values() for _, x in b) == sorted(items)
    for b in spread(p).values():
        at = 0
        for offset, length in b:
            assert offset == at
            at += length
        assert at <= c
    only = packing.Packing({}, c)
    only.left = dict(Counter(items))
    only.given = dict.fromkeys(only.left, 0)
    only.reduce()
    rest = [k for k, n in only.left.items() for _ in range(n)]
    assert only.n_sequences + fewest(rest, c) == fewest(items, c)


def test_large_histogram_is_close_to_the_bound():
    random.seed(3)
    h = Counter(min(2048, max(1, int(random.lognormvariate(6, 1)))) for _ in range(50_000))
    p = packing.Packing(dict(h))
    assert p.n_sequences <= 1.001 * sum(k * n for k, n in h.items()) / 2048 + 1 and p.reduced > 0


def check(rows, texts):
    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    want = Counter()
    for d, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head, at, k = len(ids) % 2048 or 2048, 0, 0
        while at < len(ids):
            end = head if k == 0 else at + 2048
            want[d, k, at, end - at, zlib.crc32(ids[at:end].tobytes())] += 1
            at, k = end, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in by.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_whole_table(documents):
    check(packing.pack_documents(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(odd, none):
    check(packing.pack_documents(odd).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert packing.pack_documents(none).count() == 0


def test_ids_can_be_kept(odd):
    for r in packing.pack_documents(odd, keep_ids=True).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstvrelmd09Aé²½,!\xa0\x85\x1c"), st.characters(codec="utf-8")), max_size=40), max_size=8))
def test_ids_equal_those_of_the_library(texts):
    enc = encoder(default_tokenizer())
    assert [x.tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
