"""Spelling variants against words less one code point, and single edits against all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultspark.llm import spelling as S
from tests.llm.conftest import odd_rows

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(docs):
    out = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, near=None):
    if near is None:
        near = defaultdict(set)
        less = defaultdict(set)
        for w in words:
            for i in range(len(w)):
                cut = w[:i] + w[i + 1 :]
                less[i, cut].add(w)
                if cut in words:
                    near[w].add(cut)
                    near[cut].add(w)
        for group in less.values():
            for a in group:
                near[a] |= group - {a}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w] or "", root, n, len(near[w]), words[form[w]] if form[w] else 0))
    return sorted(out)


def rows(frame):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in frame.select(COLUMNS).collect())


def test_variants_of_the_documents(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert rows(S.spelling_variants(documents)) == plain(counted(docs))


def test_odd_documents(odd, none):
    docs = [(r[0], r[1]) for r in odd_rows()]
    assert rows(S.spelling_variants(odd, least=1)) == plain({w: n for w, n in {**counted(docs), **all_words(docs)}.items()})
    assert S.spelling_variants(none).count() == 0


def all_words(docs):
    out = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6}


@pytest.mark.parametrize("block", [3, 1024])
def test_single_edits_are_those_of_all_pairs(spark, block):
    """Short alphabets, so halves, repeats and several edits meet; words of any length and letter."""
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"x" * 3000, "x" * 2999, "y" + "x" * 2999, "ü\U0001f600z", "ü\U0001f600", "ü\U0001f601z", "", "a\x00", "a", "a\x00b"}
    words = {w: rng.choice([5, 5, 6, 30, 160, 900, 5000]) for w in sorted(words)}
    near = {a: {b for b in words if one_edit(a, b)} for a in words}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert rows(S.variants(frame, block=block)) == plain(words, near)
    found = {r["word"]: r["n_near"] for r in S.near_words(frame, block).collect()}
    assert found == {w: len(x) for w, x in near.items() if x}


def test_a_tile_by_itself():
    words = ["banana", "bananas", "banano", "cabana", "banena"]
    front, back, longer = S.matrices(words, 6)
    assert front.shape == (5, 7) and list(np.flatnonzero(longer)) == [1] and back[0, 0] == ord("a")
    p, q = S.compare(words, np.zeros(5, int), np.zeros(5, int), np.zeros(5, bool), np.zeros(5, int), 6)
    assert {frozenset((words[a], words[b])) for a, b in zip(p, q)} == {frozenset(x) for x in (("banana", "bananas"), ("banana", "banano"), ("banana", "banena"))}


def test_roots_follow_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [(f"v{i}", "w4") for i in range(40)]
    got = {r["word"]: r["root"] for r in S.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w13"} and len(got) == 53


def test_a_common_word_in_one_third_of_all(spark):
    docs = [(i, "variant " * 300 + f"variint word{i}") for i in range(60)] + [(i, None) for i in range(60, 70)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))
    assert rows(S.spelling_variants(frame)) == plain(counted(docs))
