"""Document fingerprints: bottom-k sketches of 5-word shingles.

A fingerprint holds the ``K`` smallest of a document's distinct shingle hashes (all of them
if there are fewer), and whether that is all. It can be merged with that of another part,
gives the number of distinct shingles, and with another fingerprint their resemblance and
containment. As text: "a" (all) or "k" (the smallest of more), then base64 of the sorted
hashes as little-endian 64-bit numbers.

Defined results: a null text is an empty one; a text of one to four words has one shingle
of all of them, a text without words none; two sketches without shingles resemble each
other fully, one of them resembles no other; an empty table gives an empty table; columns
other than doc_id and text are ignored by the query's operator.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultspark.functions.iterate import cut_lineage

from .vector_text import CHUNK, chunks, shingles, words

K = 256
#: Parts of the order of documents for each shuffle partition at least, and bytes of text of a part and of a task at most, on average.
PARTS, PART_BYTES, TASK_BYTES = 8, 1 << 24, 1 << 26
SPAN = 2.0**64


@dataclass(frozen=True)
class Sketch:
    low: np.ndarray  # sorted distinct hashes
    whole: bool  # no hash is left out

    @staticmethod
    def of(hashes: np.ndarray, k: int = K) -> Sketch:
        distinct = np.unique(hashes)
        return Sketch(distinct[:k], len(distinct) <= k)

    def text(self) -> str:
        return "ka"[self.whole] + base64.b64encode(self.low.astype("<u8").tobytes()).decode()

    @staticmethod
    def read(text: str) -> Sketch:
        return Sketch(np.frombuffer(base64.b64decode(text[1:]), "<u8"), text[0] == "a")

    def merge(self, other: Sketch, k: int = K) -> Sketch:
        """The sketch of both parts together."""
        low = np.union1d(self.low, other.low)
        whole = self.whole and other.whole and len(low) <= k
        # beyond the last hash of a sketch that isn't whole nothing is known
        for s in (self, other):
            if not s.whole:
                low = low[low <= s.low[-1]]
        return Sketch(low[:k], whole)

    def distinct(self) -> float:
        """Number of distinct shingles: exact if whole, else from how densely the smallest lie."""
        return float(len(self.low)) if self.whole else (len(self.low) - 1) * SPAN / float(self.low[-1])

    def _with(self, other: Sketch) -> tuple[int, int, float]:
        """Distinct hashes of the union as far as both sketches know it, how many of them both
        have, and the estimated size of the whole union."""
        last = [s.low[-1] for s in (self, other) if not s.whole]
        a, b = self.low, other.low
        if last:
            a, b = (x[: np.searchsorted(x, min(last), "right")] for x in (a, b))
        both = np.sort(np.concatenate([a, b]))
        twice = int((both[1:] == both[:-1]).sum())
        n = len(both) - twice
        return n, twice, float(n) if not last else (n - 1) * SPAN / float(min(last))

    def resemblance(self, other: Sketch) -> float:
        """Jaccard similarity, from the smallest hashes of the union; exact if both are whole."""
        if not len(self.low) or not len(other.low):
            return float(len(self.low) == len(other.low))
        n, both, _ = self._with(other)
        return both / n

    def containment(self, other: Sketch) -> float:
        """Share of this document's shingles that the other has."""
        if not len(self.low):
            return 1.0
        if not len(other.low):
            return 0.0
        n, both, union = self._with(other)
        return min(1.0, both / n * union / max(self.distinct(), 1.0))


def sketches(texts: list[str], k: int = K) -> Iterator[Sketch]:
    for a, b in chunks(texts, CHUNK):
        s, offs = shingles(*words(texts[a:b]))
        for i in range(b - a):
            h = s[offs[i] : offs[i + 1]]
            if len(h) > 8 * k:  # sort the smallest only
                low = np.unique(np.partition(h, 4 * k)[: 4 * k])
                if len(low) > k:
                    yield Sketch(low[:k], False)
                    continue
            yield Sketch.of(h, k)


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """Adds fingerprint and n_shingles (estimated distinct shingles) to (doc_id, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sketches([t or "" for t in batch.column(1).to_pylist()], k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.text() for s in found], pa.string()), pa.array([s.distinct() for s in found], pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(sketch, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string, n_shingles double")


def merge_fingerprints(prints: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, fingerprint) of all parts of a document or group.

    Each task merges what it holds of a group first; then the few that are left meet.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Sketch.read(text)
                held[key] = held[key].merge(s, k) if key in held else s
            if len(held) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([s.text() for s in held.values()])], [by, "fingerprint"])
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([s.text() for s in held.values()])], [by, "fingerprint"])

    schema = f"`{by}` {dict(prints.dtypes)[by]}, fingerprint string"
    part = prints.select(by, "fingerprint").mapInArrow(merged, schema)
    return part.repartition(by).sortWithinPartitions(by).mapInArrow(merged, schema)


def next_documents(docs: DataFrame) -> DataFrame:
    """(part, halo, d, t, doc_id, text): the documents dealt into parts in order of doc_id.

    The next document of one is that before it in ascending order (of the first, the last).
    The head of each part, with halo 0, is a copy of the last document of the part before.
    Equal ids are ordered by the hash of the text. The numbers of parts and of tasks follow the
    bytes of the texts; the parts' borders, and nothing else, are on the driver.
    """
    spark = docs.sparkSession
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]
    ids = cut_lineage(docs.select(*key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("b")))
    n, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    step = max(1, n // max(PARTS * tasks, -(-size // PART_BYTES)))
    ids = ids.drop("b")
    ordered = ids.repartitionByRange("d", "t").sortWithinPartitions("d", "t").select("d", "t", (F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) % step).alias("r"))
    number = lambda d, t: int(d) * 2**64 + int(t) + 2**63
    # a part begins with each of these
    cuts = np.array(sorted({number(r["d"], r["t"]) for r in ordered.filter("r = 0").select("d", "t").collect()})[1:], object)

    def part_of(d: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, d.astype(object) * 2**64 + t.astype(object) + 2**63, "right") if len(cuts) else np.zeros(len(d), np.int64)

    def last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, tuple[int, int]] = {}
        for batch in batches:
            d, t = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p, x in zip(part_of(d, t).tolist(), zip(d.tolist(), t.tolist())):
                most[p] = max(most.get(p, x), x)
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array([x[0] for x in most.values()], pa.int64()), pa.array([x[1] for x in most.values()], pa.int64())], ["part", "d", "t"])

    tails = ids.mapInArrow(last_rows, "part bigint, d bigint, t bigint").groupBy("part").agg(F.max(F.struct("d", "t")).alias("x")).orderBy("part").collect()
    parts = [r["part"] for r in tails]
    follow = {(r["x"]["d"], r["x"]["t"]): parts[(i + 1) % len(parts)] for i, r in enumerate(tails)}
    names = ["part", "halo", "d", "t", "doc_id", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(part_of(d, t), pa.int64()), pa.array(np.ones(n, np.int32)), *batch.columns], names)
            heads = [i for i, x in enumerate(zip(d.tolist(), t.tolist())) if x in follow and x not in sent]
            if heads:
                keys = [(int(d[i]), int(t[i])) for i in heads]
                sent.update(keys)
                copy = batch.take(pa.array(heads, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([follow[x] for x in keys], pa.int64()), pa.array(np.zeros(len(heads), np.int32)), *copy.columns], names)

    rows = docs.select(*key, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.mapInArrow(deal, f"part bigint, halo int, d bigint, t bigint, doc_id {dict(docs.dtypes)['doc_id']}, text string")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "halo", "d", "t")


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[str, Sketch] = ("", Sketch.of(np.zeros(0, np.uint64)))
        for batch in batches:
            halo, ids, texts = batch.column(1).to_pylist(), batch.column(4), batch.column(5).to_pylist()
            edited = [t[: len(t) - len(t) // 2] + b[: len(t) // 2] for t, b in zip(texts, [before[0], *texts])]
            own, new = list(sketches(texts, k)), list(sketches(edited, k))
            at = [i for i, h in enumerate(halo) if h]
            then = [before[1], *own]
            cols = [
                pa.array([len(texts[i]) for i in at], pa.int64()), pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in at], pa.string()),
                pa.array([own[i].text() for i in at], pa.string()), pa.array([new[i].text() for i in at], pa.string()),
                pa.array([own[i].resemblance(new[i]) for i in at], pa.float64()), pa.array([own[i].resemblance(then[i]) for i in at], pa.float64()),
                pa.array([own[i].distinct() for i in at], pa.float64())]
            if texts:
                before = (texts[-1], own[-1])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *cols], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    return next_documents(docs).mapInArrow(compare, schema)
