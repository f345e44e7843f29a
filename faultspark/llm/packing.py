"""Best-fit packing of token documents after dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most
``capacity`` counts, however many documents there are. It is solved on the driver in bulk,
many sequences of one make at a time, and the solution is a list of slots: so many pieces
of one length at this place of that many sequences. Its size depends on the capacity only.
Pieces are ordered by length in a range-partitioned sort; the place of a piece in that
order tells its slot, so each task finds sequence and offset of its own rows.

Reduction (Martello and Toth): a set of documents that with document j dominates every
other set with j is a sequence of some best solution. Sets of up to three are tried for
every length, in bulk: j alone if nothing fits beside it; j and the largest that fits if
it fills the rest, or if no second one fits, or if no two others reach beyond it; j, the
largest that fits and the largest beside both if no two larger than the last fit instead.
What is left is packed best-fit in decreasing order.

Defined results: a null text is an empty one; an empty text is one end mark; equal rows
are packed each for itself; an empty table gives an empty table; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultspark.functions.iterate import cut_lineage

from .token_ids import default_tokenizer, encoder
from .vector_text import small

CAPACITY = 2048
END = 0
ROW_BITS = 33  # of monotonically_increasing_id: the row inside its partition


class Packing:
    """Sequences over a histogram of lengths, as slots (length, g, seq, per, offset, count):
    from the g-th piece of that length on, ``count`` pieces go ``per`` at a time into
    sequences seq, seq + 1, ..., behind each other from ``offset``."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.c, self.n_sequences, self.reduced = capacity, 0, 0
        self.left = {k: n for k, n in histogram.items() if n > 0}
        self.given = dict.fromkeys(self.left, 0)
        self.slots: list[tuple[int, int, int, int, int, int]] = []
        self.reduce()
        self.best_fit()

    def put(self, length: int, seq: int, per: int, offset: int, count: int) -> None:
        self.slots.append((length, self.given[length], seq, per, offset, count))
        self.given[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, made: list[int], times: int) -> None:
        """``times`` sequences of exactly these lengths."""
        offset = 0
        for x in sorted(set(made), reverse=True):
            per = made.count(x)
            self.put(x, self.n_sequences, per, offset, per * times)
            offset += per * x
        self.n_sequences += times
        self.reduced += times

    def dominating(self, j: int, sizes: list[int]) -> list[int] | None:
        """Lengths of a set with j that dominates all sets with j; ``sizes`` is sorted."""
        free = {j: self.left[j] - 1}

        def has(x: int, used: int = 0) -> bool:
            return free.get(x, self.left.get(x, 0)) > used

        def largest(most: int, beside: int = 0) -> int:
            i = bisect_right(sizes, most)
            while i and not has(sizes[i - 1], int(sizes[i - 1] == beside)):
                i -= 1
            return sizes[i - 1] if i else 0

        def smallest(n: int, above: int = 0) -> int | None:
            """Sum of the n smallest lengths over ``above``; None if there are fewer."""
            total, i = 0, bisect_right(sizes, above)
            while n and i < len(sizes):
                take = min(n, free.get(sizes[i], self.left[sizes[i]]))
                total, n, i = total + take * sizes[i], n - take, i + 1
            return None if n else total

        room = self.c - j
        k = largest(room)
        if not k:
            return [j]
        two, three = smallest(2), smallest(3)
        if k == room or two is None or two > room:
            return [j, k]
        if three is not None and three <= room:
            return None
        # at most two more fit: pairs are the sets to beat
        best = max((x + y for x in sizes if has(x) and x < room and (y := largest(min(room - x, x), x))), default=0)
        if best <= k:
            return [j, k]
        b = largest(room - k, k)
        if not b:
            return None
        above = smallest(2, b)
        return [j, k, b] if above is None or above > room or above <= k and best <= k else None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in sorted(self.left, reverse=True):
                while j in self.left:
                    made = self.dominating(j, sorted(self.left))
                    if made is None:
                        break
                    # what is removed only lessens the sets to beat, so the set stays dominating
                    self.fix(made, min(self.left[x] // made.count(x) for x in made))
                    changed = True

    def best_fit(self) -> None:
        """Decreasing order; each piece goes where the least room is left that holds it."""
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
        rooms: list[int] = []

        def leave(room: int, seq: int, many: int) -> None:
            if room:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((seq, many))

        for size in sorted(self.left, reverse=True):
            while n := self.left.get(size, 0):
                i = bisect_left(rooms, size)
                if i < len(rooms):
                    room = rooms[i]
                    seq, many = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[i]
                else:
                    room, seq, many = self.c, self.n_sequences, -(-n // (self.c // size))
                    self.n_sequences += many
                per = room // size  # the same sequence stays the tightest until it is full
                full = min(many, n // per)
                if full:
                    self.put(size, seq, per, self.c - room, full * per)
                    leave(room - per * size, seq, full)
                if full < many:
                    rest = n - full * per
                    if rest:
                        self.put(size, seq + full, rest, self.c - room, rest)
                        leave(room - rest * size, seq + full, 1)
                    leave(room, seq + full + bool(rest), many - full - bool(rest)) if many > full + bool(rest) else None

    def table(self, histogram: dict[int, int]) -> dict[str, np.ndarray]:
        """The slots in order of the pieces sorted by length."""
        first, at = {}, 0
        for length in sorted(histogram):
            first[length], at = at, at + histogram[length]
        rows = sorted((first[s[0]] + s[1], s[2], s[3], s[4], s[0]) for s in self.slots)
        return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(("g", "seq", "per", "offset", "length"))}


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end mark,
    cut only if there are more than ``capacity``; then the first piece takes what is over."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, piece, start, size, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(enc.encode(texts)):
                ids = np.append(ids, np.int32(END)).astype("<u4")
                head = len(ids) % capacity or capacity
                for k, at in enumerate([0, *range(head, len(ids), capacity)]):
                    part = ids[at : head if k == 0 else at + capacity]
                    row.append(i), piece.append(k), start.append(at), size.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``."""
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    order = [c for c in ("length", "doc_id", "piece") if c in pieces.columns]
    ordered = cut_lineage(pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(F.shiftright("__at", ROW_BITS).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    base = np.zeros(max(sizes, default=0) + 2, np.int64)
    for p, n in sizes.items():
        base[p + 1] = n
    shared = spark.sparkContext.broadcast((np.cumsum(base), Packing(histogram, capacity).table(histogram)))
    at, size = ordered.columns.index("__at"), ordered.columns.index("length")
    kept = [c for c in ordered.columns if c != "__at"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, slots = shared.value
        for batch in batches:
            n = batch.column(at).to_numpy(zero_copy_only=False)
            g = base[n >> ROW_BITS] + (n & ((1 << ROW_BITS) - 1))
            s = np.searchsorted(slots["g"], g, "right") - 1
            k, length = g - slots["g"][s], batch.column(size).to_numpy(zero_copy_only=False)
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(slots["seq"][s] + k // slots["per"][s]), pa.array(slots["offset"][s] + k % slots["per"][s] * length)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in ordered.dtypes if n != "__at")
    return ordered.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of ``capacity`` tokens."""
    return pack_pieces(token_pieces(docs, capacity, tokenizer, keep_ids), capacity)
