"""Join of near-duplicate documents: n-gram Jaccard similarity by MinHash banding.

Documents with equal sets of 5-word shingles are copies and form one class; only classes
are joined. The smallest hashes of a class under many permutations are cut into bands;
classes that agree in a band meet in a bucket. Rows per band are fixed, and so many bands
are taken that a pair at the threshold meets with the wanted recall. Buckets with the same
members are taken once. A bucket larger than a block is dealt into blocks, and each pair of
blocks is one unit of work: it counts common shingles of its classes on their full sets, so
every link is exact. A pair that shares several buckets is counted in the first. A unit
returns the number of links of each class and one edge to the smallest of those it connects
with, never pairs.

Defined results: a null text is an empty one; texts of one to four words have one shingle of
all of them; texts without words are copies of each other; rows equal in doc_id and text are
one document read twice, and both get the same result; a null doc_id sorts first; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultspark.functions.graph import connected_components
from faultspark.functions.iterate import cut_lineage

from .vector_text import chunks, mix, shingle_sets, shingles, small, words

THRESHOLD = 0.8
RECALL = 0.998
ROWS = 5
#: Classes, and shingles of their sets, in a block of a bucket.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands with which a pair at the threshold shares one with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _key() -> list:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]


def signatures(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(d, t, s1, s2, n, bands): the set's 128-bit identity, its size, a key for each band."""
    n_bands = bands_for(threshold, recall, rows)
    draws = mix(np.arange(1, 2 * n_bands * rows + 1, dtype=np.uint64))
    factor, add = draws[::2] | np.uint64(1), draws[1::2]
    salt = mix(np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    names = ["d", "t", "s1", "s2", "n", "bands"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(2).to_pylist()
            ids, sizes, keys = [], [], []
            for a, b in chunks(texts):
                s, offs = shingles(*words(texts[a:b]))
                full = np.flatnonzero(np.diff(offs))
                at = offs[full]
                low = np.empty((len(factor), len(full)), np.uint64)
                for k in range(len(factor) if len(full) else 0):
                    low[k] = np.minimum.reduceat(s * factor[k] + add[k], at)
                banded = np.zeros((b - a, n_bands), np.uint64)
                for k in range(n_bands):
                    h = np.zeros(len(full), np.uint64)
                    for j in range(rows):
                        h = mix(h + low[k * rows + j] + np.uint64(1))
                    banded[full, k] = h ^ salt[k]
                for i in range(b - a):
                    own = np.unique(s[offs[i] : offs[i + 1]])
                    ids.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sizes.append(len(own))
                    keys.append(banded[i].view(np.int64) if len(own) else banded[i, :0].view(np.int64))
            s12 = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s12[:, 0].copy()), pa.array(s12[:, 1].copy()), pa.array(sizes, pa.int64()), lists], names)

    d, t = _key()
    return docs.select(d, t, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, "d bigint, t bigint, s1 bigint, s2 bigint, n bigint, bands array<bigint>")


def buckets(classes: DataFrame) -> DataFrame:
    """(band, key, m, shingles): buckets of two or more classes; of equal ones the first."""
    who = F.xxhash64("d", "t")
    b = classes.select("d", "t", "n", F.posexplode("bands").alias("band", "key")).groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), F.bit_xor(who).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "t", "d")).alias("x2"))
    first = b.filter("m > 1").groupBy("m", "x1", "x2").agg(F.min(F.struct("band", "key", "shingles")).alias("f"))
    return first.select("f.band", "f.key", "m", "f.shingles")


def placed(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(d, t, spots): for each class its buckets, as (band, key, blocks, own block)."""
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = classes.select("d", "t", F.posexplode("bands").alias("band", "key")).join(found.select("band", "key", blocks.alias("blocks")), ["band", "key"])
    spot = F.struct("band", "key", "blocks", F.pmod(F.xxhash64("t", "d", "key"), F.col("blocks")).cast("int").alias("own"))
    return rows.groupBy("d", "t").agg(F.array_sort(F.collect_list(spot)).alias("spots"))


def _local(a: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, from a symmetric matrix of links."""
    label = np.arange(len(a))
    while True:
        low = label.copy()
        i, j = np.nonzero(a)
        np.minimum.at(low, i, label[j])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _count_common(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Dense incidence of the shingles that two or more of the sets have, by row."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1
    _, col = np.unique(group[often], return_inverse=True)
    return row[order][often], col


def _links(rows: list[dict], i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row inside a unit of work, and the smallest row of its component."""
    own = np.array([r["own"] for r in rows])
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    row, col = _count_common(sets)
    common = np.zeros((len(a), len(b)), np.float32)
    width = max(1, (1 << 22) // max(len(rows), 1))
    for at in range(0, int(col.max()) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        slab = np.zeros((len(rows), min(width, int(col[-1]) + 1 - at)), np.float32)
        slab[row[lo:hi], col[lo:hi] - at] = 1
        common += slab[a] @ slab[b].T
    linked = common * (1 + threshold) >= threshold * (size[a][:, None] + size[b][None, :]) - 1e-6
    band = rows[0]["band"]
    spots = np.zeros((len(rows), band), np.int64)
    for k, r in enumerate(rows):
        for x in r["before"]:
            spots[k, x["band"]] = x["key"]
    for x in range(band):  # met before in an earlier bucket
        linked &= (spots[a, x][:, None] != spots[b, x][None, :]) | (spots[a, x] == 0)[:, None]
    if i == j:
        np.fill_diagonal(linked, False)
    full = np.zeros((len(rows), len(rows)), bool)
    full[np.ix_(a, b)] = linked
    full |= full.T
    return full.sum(1), _local(full)


def verified(docs: DataFrame, spots: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(d, t, links, rd, rt): links of a class inside one unit and the smallest it connects with."""
    d, t = _key()
    texts = docs.select(d, t, F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(spots, ["d", "t"]).dropDuplicates(["d", "t"])
    names = ["key", "i", "j", "band", "own", "d", "t", "before", "set"]
    kinds = "key bigint, i int, j int, band int, own int, d bigint, t bigint, before array<struct<band:int,key:bigint>>, set binary"
    before = pa.list_(pa.struct([("band", pa.int32()), ("key", pa.int64())]))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            out: list[tuple] = []
            size = 0
            ds, ts, tx, sp = (c.to_pylist() for c in batch.columns)
            for x, y, own_set, spot in zip(ds, ts, shingle_sets(tx), sp):
                raw = own_set.tobytes()
                for k, s in enumerate(spot):
                    earlier = [{"band": e["band"], "key": e["key"]} for e in spot[:k]]
                    for other in range(s["blocks"]):
                        out.append((s["key"], min(s["own"], other), max(s["own"], other), s["band"], s["own"], x, y, earlier, raw))
                        size += len(raw)
                if size > 1 << 24:
                    yield _batch(out, names, before)
                    out, size = [], 0
            if out:
                yield _batch(out, names, before)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, i, j), rows in _groups(batches):
            if len(rows) < 2:
                continue
            links, low = _links(rows, i, j, threshold)
            for k in np.flatnonzero(links):
                r, q = rows[k], rows[low[k]]
                out.append((r["d"], r["t"], int(links[k]), q["d"], q["t"]))
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    made = texts.select("d", "t", "text", "spots").mapInArrow(units, kinds)
    # rows of a unit in ascending order, so the smallest row of a component is its smallest class
    return made.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "d", "t").mapInArrow(verify, "d bigint, t bigint, links bigint, rd bigint, rt bigint")


def _batch(out: list[tuple], names: list[str], before: pa.DataType) -> pa.RecordBatch:
    c = list(zip(*out))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), before, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds)], names)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], ["d", "t", "links", "rd", "rt"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of one unit after another; a unit is bounded by two blocks."""
    now, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            k = (r["key"], r["i"], r["j"])
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(r)
    if held:
        yield now, held


def near_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(d, t, doc_id, n_shingles, copy_of, n_copies, n_links, class_id, first): one row per document.

    copy_of is the smallest document with the same shingles, n_copies counts those; n_links
    counts the different texts that are similar; class_id is the smallest document that a
    chain of links leads to, and first says whether this row is that document.
    """
    signed = cut_lineage(signatures(docs, threshold, recall, rows))
    classes = cut_lineage(signed.groupBy("s1", "s2").agg(F.min(F.struct("d", "t")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")))
    members = signed.join(classes.select(F.col("rep.d").alias("d"), F.col("rep.t").alias("t")), ["d", "t"], "left_semi").dropDuplicates(["d", "t"])
    members = members.select("d", "t", "n", "bands")
    spots = placed(members, cut_lineage(buckets(members)))
    found = cut_lineage(verified(docs, spots, threshold))
    counted = found.groupBy("d", "t").agg(F.sum("links").alias("links"))
    edges = found.select(F.struct("d", "t").alias("a"), F.struct(F.col("rd").alias("d"), F.col("rt").alias("t")).alias("b"))
    parts = connected_components(edges)
    told = counted.join(parts.select(F.col("node.d").alias("d"), F.col("node.t").alias("t"), "component"), ["d", "t"], "full")
    reps = classes.select("s1", "s2", "rep", "copies", "n").join(told.select(F.struct("d", "t").alias("rep"), "links", "component"), "rep", "left")
    reps = cut_lineage(reps.select("s1", "s2", "rep", "copies", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")))
    whole = signed.select("d", "t", "s1", "s2").join(reps, ["s1", "s2"])
    name = lambda c: F.when(c != -(2**63), c)
    return whole.select(
        "d", "t", name(F.col("d")).alias("doc_id"), F.col("n").alias("n_shingles"), name(F.col("rep.d")).alias("copy_of"), F.col("copies").alias("n_copies"),
        F.col("links").alias("n_links"), name(F.col("component.d")).alias("class_id"), (F.struct("d", "t") == F.col("component")).alias("first"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """The documents without near duplicates: of each class the first stays, once."""
    first = near_join(docs, threshold, recall, rows).filter("first").select(F.col("d").alias("__d"), F.col("t").alias("__t"))
    d, t = _key()
    k = docs.select("*", d.alias("__kd"), t.alias("__kt"))
    kept = k.join(first.distinct(), (k["__kd"] == first["__d"]) & (k["__kt"] == first["__t"]), "left_semi")
    return kept.dropDuplicates(["__kd", "__kt"]).select(*docs.columns)
