import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from faultspark.llm import token_files
from faultspark.llm.token_ids import default_tokenizer
from tests.llm.conftest import odd_rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 64).flatmap(lambda b: st.integers(0, 2**b - 1)), max_size=200))
def test_round_trip_of_any_ids(ids):
    ids = np.array(ids, np.uint64)
    words, first = token_files.pack(ids)
    assert (token_files.unpack(words, len(ids)) == ids).all() and len(first) == len(words)


def test_block_offsets_name_the_first_id_of_a_word():
    docs = [np.arange(i, i + 5000) % 50257 for i in (0, 17, 40_000)]
    payload = token_files.encode_block(docs)
    assert all((a == b).all() for a, b in zip(token_files.decode_block(payload), docs))
    _, _, n_docs, n_ids, n_words = token_files.MAGIC.unpack_from(payload)
    at = token_files.MAGIC.size + 8 * n_docs
    k = -(-n_words // token_files.STRIDE)
    offsets = np.frombuffer(payload, "<u8", k, at)
    words = np.frombuffer(payload, "<u8", n_words, at + 8 * k)
    ids = np.concatenate(docs)
    for i, o in enumerate(offsets[1:], 1):  # decoding may begin at any of them
        assert (token_files.unpack(words[i * token_files.STRIDE :], n_ids - int(o)) == ids[int(o) :]).all()
    assert 8 * n_words < 4 * n_ids


def check(rows, texts):
    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in texts]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert sorted((d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(texts, ids)) == sorted((d is not None, d or 0, n, c) for _, d, n, c in got)
    at, last = 0, None
    for start, d, n, _ in got:
        assert start == at and (last is None or d >= last)
        at, last = at + n, d


def test_whole_table(documents):
    check(token_files.token_files(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(odd, none):
    check(token_files.token_files(odd).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert token_files.token_files(none).count() == 0
