"""Quality classifier: random-indexing word vectors, pooled per document, into a small network.

Random indexing: each token has a sparse index vector of +1 and -1 fixed by its hash; the
vector of a token is the sum of the index vectors of its neighbours up to WINDOW tokens away,
over all documents. Tokens share ROWS rows by hash, so the table has a fixed size; tasks add
up their own, and blocks of rows are summed in two levels. A document is the mean of its
tokens' unit vectors, once plain and once weighted down for frequent tokens.

The network has one hidden layer of HIDDEN tanh units and is trained with Adam on a bounded
sample of labelled documents; one temperature, fitted on a second sample, calibrates its
probabilities. Learning bounds, all documented parameters: FIT and CALIBRATE documents. The
word vectors cover all documents and texts.

Defined results: a null or empty text is a zero vector and gets the network's score for it;
without labels of both classes every score is the labels' mean (0 without labels); rows
without an id are scored, never learnt from; repeated rows are scored alike; an empty table
gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultspark.functions.iterate import cut_lineage

from .labelled import held_out, labelled_sample
from .vector_text import chunks, mix, styled_tokens

ROWS, DIMS, ONES, WINDOW = 1 << 14, 64, 4, 2
SLICE = 512  # rows of a block of the table
FIT, CALIBRATE = 8192, 4096
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 256, 3e-3, 1e-4, 7
#: Weight of a token is RARE / (RARE + its share of all tokens).
RARE = 1e-3
THRESHOLD = 0.5


def rows_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(50)).astype(np.int64) & (ROWS - 1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ones in the index vector of each row."""
    h = mix(np.arange(1, ROWS * ONES + 1, dtype=np.uint64)).reshape(ROWS, ONES)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def neighbour_sums(texts: list[str]) -> np.ndarray:
    """Sums of neighbours' index vectors by row, and in a last column how often a row occurs."""
    place, sign = index_vectors()
    total = np.zeros((ROWS, DIMS + 1))
    for a, b in chunks(texts, 1 << 19):
        tokens, offs = styled_tokens(texts[a:b])
        row = rows_of(tokens)
        doc = np.repeat(np.arange(b - a), np.diff(offs))
        total[:, DIMS] += np.bincount(row, minlength=ROWS)
        for step in range(1, WINDOW + 1):
            near = np.flatnonzero(doc[step:] == doc[:-step])
            left, right = row[near], row[near + step]
            # equal pairs are counted once and weighted
            pair, n = np.unique(left * ROWS + right, return_counts=True)
            left, right = pair // ROWS, pair % ROWS
            for x, y in ((left, right), (right, left)):
                for j in range(ONES):
                    total[:, :DIMS] += np.bincount(x * DIMS + place[y, j], sign[y, j] * n, ROWS * DIMS).reshape(ROWS, DIMS)
    return total


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors by row, and the rows' shares of all tokens."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIMS + 1))
        for batch in batches:
            total += neighbour_sums([t or "" for t in batch.column(0).to_pylist()])
        yield _slices(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.float64)
                held[i] = held[i] + part if i in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slice", "sums"])

    parts = docs.select("text").mapInArrow(gather, "slice int, sums binary")
    # in two levels, so that a task adds up about the square root of the input's partitions
    level = F.pmod(F.spark_partition_id(), F.lit(max(1, math.isqrt(docs.rdd.getNumPartitions()))))
    some = parts.withColumn("level", level).repartition("slice", "level").select("slice", "sums").mapInArrow(add, "slice int, sums binary")
    summed = some.repartition("slice").mapInArrow(add, "slice int, sums binary").collect()  # ROWS x DIMS numbers, whatever the input
    total = np.zeros((ROWS, DIMS + 1))
    for r in summed:
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += np.frombuffer(r["sums"], np.float64).reshape(SLICE, DIMS + 1)
    v, n = total[:, :DIMS], total[:, DIMS]
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.maximum(size, 1e-12)).astype(np.float32), (n / max(n.sum(), 1.0)).astype(np.float32)


def _slices(total: np.ndarray) -> pa.RecordBatch:
    k = ROWS // SLICE
    raw = [total[i * SLICE : (i + 1) * SLICE].tobytes() for i in range(k)]
    return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(raw, pa.binary())], ["slice", "sums"])


def pool(texts: list[str], vectors: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A row for each text: mean of its tokens' vectors, plain and weighted."""
    weight = (RARE / (RARE + share)).astype(np.float32)
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    for a, b in chunks(texts, 1 << 19):
        tokens, offs = styled_tokens(texts[a:b])
        row = rows_of(tokens)
        doc = np.repeat(np.arange(b - a), np.diff(offs))
        pair, n = np.unique(doc * ROWS + row, return_counts=True)
        doc, row = pair // ROWS, pair % ROWS
        at = np.searchsorted(doc, np.arange(b - a + 1))
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            continue
        v = vectors[row] * n[:, None].astype(np.float32)
        w = n * weight[row]
        out[a + full, :DIMS] = np.add.reduceat(v, at[full]) / np.add.reduceat(n, at[full])[:, None]
        out[a + full, DIMS:] = np.add.reduceat(v * weight[row][:, None], at[full]) / np.maximum(np.add.reduceat(w, at[full]), 1e-12)[:, None]
    return out


class Network:
    """Two layers: tanh units, then one logit; divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        self.temperature = 1.0
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, step = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        z = self._scaled(x)
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                g, step = self._gradient(z[at], y[at]), step + 1
                for k, q in enumerate(self.p):
                    gk = g[k] + DECAY * q
                    m[k], s[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * s[k] + 0.001 * gk * gk
                    q -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8).astype(np.float64)

    def _gradient(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y) / len(z)
        back = np.outer(e, self.p[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ e, np.array([e.sum()])]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss, by golden section over its logarithm."""
        if len(set(y.tolist())) < 2:
            return
        f = self.logit(x)

        def loss(t: float) -> float:
            g = f / np.exp(t)
            return float(np.mean(np.logaddexp(0, g) - y * g))

        lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(60):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, np.ndarray, Network | float]:
    vectors, share = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, share))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column(1).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "fit", "x"])

    sample = labelled_sample(docs, labels, label, FIT, CALIBRATE, balanced=False).select("doc_id", "text", "y", "fit")
    kind = dict(docs.dtypes)["doc_id"]
    rows = cut_lineage(sample.mapInArrow(pooled, f"doc_id {kind}, y int, fit boolean, x binary")).orderBy("doc_id", "x").collect()  # bounded by parameters
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 2 * DIMS)
    y, fitted = np.array([r["y"] for r in rows], np.float64), np.array([r["fit"] for r in rows], bool)
    if len(set(y[fitted].tolist())) < 2:
        return vectors, share, float(y.mean()) if len(y) else 0.0
    net = Network(x[fitted], y[fitted])
    net.calibrate(x[~fitted], y[~fitted])
    return vectors, share, net


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, share, net = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            s = np.full(len(texts), net) if isinstance(net, float) else net.score(pool(texts, vectors, share))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
