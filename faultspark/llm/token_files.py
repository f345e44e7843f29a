"""Token ids in Simple-8b files.

A file is a Parquet file of Spark's writer (so that a lost task's half-written file never
shows) whose rows are blocks in order; a block's payload is self-contained bytes, all
little-endian:

    "TS8B", u32 version, u64 n_docs, u64 n_ids, u64 n_words
    i64 x n_docs    ids of each document, in order
    u64 x ceil(n_words / STRIDE)    number of the first id of each STRIDE-th word
    u64 x n_words   words

The top 4 bits of a word select how many ids it holds and how wide they are (COUNTS,
WIDTHS); the first id is in the lowest bits. Selector ESCAPE announces an id that needs
more than 60 bits: the word after it is that id, whole. A word's number of ids follows
from its selector alone, so all words of one selector are unpacked at once.

Blocks hold whole documents and end at BLOCK_IDS ids or more. The table has part (place of
the file in the order of doc_id), block and the document ids beside the payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from faultspark.functions.iterate import cut_lineage, shared_folder

from .token_ids import default_tokenizer, encoder
from .vector_text import small

#: Ids from which a block is full.
BLOCK_IDS = 1 << 16
STRIDE = 1024
END = 0
#: Fixed by the coding: ids in a word and bits for each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 14
MAGIC = struct.Struct("<4sIQQQ")


_SHORT = np.frexp(np.arange(1 << 16))[1].clip(1).astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if len(ids) and int(ids.max()) < 1 << 16:
        return _SHORT[ids]
    low, high = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64), (ids >> np.uint64(32)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).clip(1).astype(np.uint8)


def selectors(ids: np.ndarray) -> np.ndarray:
    """For each id the selector of a word that begins with it: as many ids as fit."""
    need, n = _bits(ids), len(ids)
    fit = np.cumsum(np.bincount(need, minlength=65))  # ids of up to so many bits
    span = {1: need}  # largest need of so many ids on, for powers of two
    out = np.full(n, ESCAPE, np.uint8)
    for s in range(ESCAPE - 1, -1, -1):
        count = int(COUNTS[s])
        if fit[WIDTHS[s]] < count:
            continue
        p = 1 << (count.bit_length() - 1)
        while (k := max(span)) < p:
            span[2 * k] = np.maximum(span[k][: len(span[k]) - k], span[k][k:])
        most = np.maximum(span[p][: n - count + 1], span[p][count - p : n - p + 1])
        np.copyto(out[: n - count + 1], np.uint8(s), where=most <= WIDTHS[s])
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the number of the first id of each (of an escape's second word: the next id's)."""
    ids = ids.astype(np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sel = selectors(ids)
    step, at, i, n = COUNTS[sel].tolist(), [], 0, len(ids)
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    s = sel[at]
    slots = 1 + (s == ESCAPE)
    place = np.cumsum(slots) - slots
    words, first = np.zeros(int(slots.sum()), np.uint64), np.zeros(int(slots.sum()), np.int64)
    first[place] = at
    for x in np.unique(s):
        a, w = at[s == x], place[s == x]
        words[w] |= np.uint64(int(x) << 60)
        if x == ESCAPE:
            words[w + 1], first[w + 1] = ids[a], a + 1
        else:
            for j in range(COUNTS[x]):
                words[w] |= ids[a + j] << np.uint64(j * WIDTHS[x])
    return words, first


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ids in the words, all words of a selector at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for w in np.flatnonzero(sel == ESCAPE):  # an id behind an escape may look like another
        if not raw[w]:
            raw[w + 1] = True
    count = np.where(raw, 0, COUNTS[np.minimum(sel, ESCAPE)])
    at = np.cumsum(count) - count
    out = np.zeros(n, np.uint64)
    for x in np.unique(sel[~raw]):
        w = np.flatnonzero((sel == x) & ~raw)
        if x == ESCAPE:
            out[at[w]] = words[w + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[x])) - 1)
        for j in range(COUNTS[x]):
            out[at[w] + j] = (words[w] >> np.uint64(j * WIDTHS[x])) & mask
    return out


def encode_block(docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    words, first = pack(ids)
    sizes = np.array([len(d) for d in docs], "<i8")
    return MAGIC.pack(b"TS8B", 1, len(docs), len(ids), len(words)) + sizes.tobytes() + first[::STRIDE].astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode_block(payload: bytes) -> list[np.ndarray]:
    """The documents of a block."""
    magic, version, n_docs, n_ids, n_words = MAGIC.unpack_from(payload)
    if magic != b"TS8B" or version != 1:
        raise ValueError("not a block of token ids")
    at = MAGIC.size
    sizes = np.frombuffer(payload, "<i8", n_docs, at)
    at += 8 * n_docs + 8 * -(-n_words // STRIDE)
    ids = unpack(np.frombuffer(payload, "<u8", n_words, at), n_ids)
    return np.split(ids, np.cumsum(sizes)[:-1]) if n_docs else []


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts, each with an end mark, in ascending doc_id order.

    A null text is an empty one; null ids come first; equal rows are written each for itself.
    """
    vocabulary = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, block = encoder(vocabulary), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        n = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([encode_block(held)], pa.binary())],
                ["part", "block", "n_ids", "doc_ids", "payload"])

        for batch in small(batches):
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, t in zip(ids, enc.encode(texts)):
                names.append(i)
                held.append(np.append(t, END))
                n += len(t) + 1
                if n >= block_ids:
                    yield full()
                    names, held, n, block = [], [], 0, block + 1
        if held:
            yield full()

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, "part int, block bigint, n_ids bigint, doc_ids array<bigint>, payload binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    files = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32", *["ids"] * keep_ids]
        for batch in batches:
            for part, block, ids, payload in zip(*(c.to_pylist() for c in batch.columns)):
                docs = decode_block(payload)
                size = np.array([len(d) for d in docs], np.int64)
                cols = [pa.array(np.full(len(docs), part, np.int32)), pa.array(np.full(len(docs), block)), pa.array(ids, pa.int64()), pa.array(np.cumsum(size) - size), pa.array(size),
                        pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64()))] if keep_ids else [])], names)

    schema = "part int, block bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    docs = files.select("part", "block", "doc_ids", "payload").mapInArrow(decode, schema)
    sizes = files.select("part", "block", "n_ids")
    # one row a file: what all files before hold
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in parts:
        before.append((r["part"], total))
        total += r["n"]
    before = spark.createDataFrame(before, "part int, before bigint")
    order = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("ahead")).join(before, "part")
    return docs.join(cut_lineage(blocks), ["part", "block"]).select("doc_id", (F.col("before") + F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)
