"""Toxicity by the nearest labelled examples.

A bounded sample of labelled documents (half of each class) is the index, another one, with
the classes' natural shares, calibrates the scores. Terms are the folded words of all
documents; their document frequencies come from one map-side-combined aggregation. Vectors
are (1 + ln tf) * idf * factor over every word, of length 1; similarity is the cosine. The
factor is the chi-squared by which a word tells the classes of the index apart, 1 at least:
no word is left out, but those of one class decide which examples are near. The index holds
the examples' whole vectors in blocks of like ones: the most frequent words as a matrix a
block with the largest weight of each word, the others as postings. A block is looked at
only if those largest weights let one of its examples be among the best K, which are so
exact. They vote with weight
1 / (distance + SOFT), against a prior of weight PRIOR; a logistic curve fitted on the second
sample turns the vote into a probability. The neighbours are the evidence.

Words of a text that no sampled document has change only the length of its vector. They are
joined with the document frequencies by shuffles, so no task holds the corpus's vocabulary.

Learning bounds, all documented parameters: REFERENCES examples in the index, CALIBRATE
others. Document frequencies cover all documents.

Defined results: a null or empty text, and one without any word of an example, has no
neighbours and gets the score of the prior alone; without labels of both classes every score is the labels' mean
(0 without labels); rows without an id are scored, never learnt from; repeated rows are scored
alike; an empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultspark.functions.iterate import cut_lineage

from .labelled import held_out, labelled_sample
from .vector_text import chunks, folded_words, ranges, small

REFERENCES, CALIBRATE = 6144, 8192
K, SOFT, PRIOR = 16, 0.2, 1.0
#: Examples in a block, texts searched at once, and terms in the blocks' matrices at most (words in a 32nd of the examples).
BLOCK, TOGETHER, COLUMNS, COMMON = 16, 256, 512, 32
#: Blocks looked at first, besides those that k examples fill; products closer than NEAR may be the same.
AHEAD, NEAR = 6, 1e-8
#: Words that a task gathers before it hands their counts on.
GATHER = 1 << 21
THRESHOLD = 0.7


class BlockMaxIndex:
    """Block-max inverted index over vectors of length 1.

    Examples are numbered anew, like ones together, and cut into blocks. Frequent terms keep
    their weights as one small matrix for each block and the largest of them for each term
    and block; the other terms are postings. For a query the largest weights give a bound of
    its products with any example of a block. The few blocks of the largest bounds are looked
    at first, then those whose bound reaches the k-th product found, and no others.
    """

    def __init__(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, block: int | None = None):
        block = block or BLOCK
        # like examples: those with the same heaviest term, then by number
        heaviest = np.full(n_docs, n_terms)
        order = np.lexsort((terms, -weights, docs))
        first = np.ones(len(order), bool)
        first[1:] = docs[order][1:] != docs[order][:-1]
        heaviest[docs[order][first]] = terms[order][first]
        self.number = np.lexsort((np.arange(n_docs), heaviest))  # of each place
        place = np.empty(n_docs, np.int64)
        place[self.number] = np.arange(n_docs)
        docs = place[docs]
        order = np.lexsort((docs, terms))
        self.doc, self.weight, self.n_docs, self.block = docs[order], weights[order].astype(np.float64), n_docs, block
        self.n_blocks = -(-n_docs // block)
        self.at = np.searchsorted(terms[order], np.arange(n_terms + 1))
        size = np.diff(self.at)
        common = np.argsort(-size, kind="stable")[:COLUMNS]
        self.common = common[size[common] * COMMON >= max(n_docs, 1)]
        self.column = np.full(n_terms, -1)
        self.column[self.common] = np.arange(len(self.common))
        self.blocks = self.most = None
        self.seen = self.skipped = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None, "most": None}

    def _open(self) -> None:
        """Weights as (block, term, example of the block), and the largest of each block and term."""
        self.blocks = np.zeros((self.n_blocks, len(self.common), self.block))
        for c, t in enumerate(self.common):
            d = self.doc[self.at[t] : self.at[t + 1]]
            self.blocks[d // self.block, c, d % self.block] = self.weight[self.at[t] : self.at[t + 1]]
        self.most = self.blocks.max(axis=2, initial=0.0).T.copy()

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest inner product over 0, ties by number, and the products."""
        return next(self.nearest_of_all([(terms, weights)], k))

    def nearest_of_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for each of many vectors."""
        if self.blocks is None:
            self._open()
        for a in range(0, len(queries), TOGETHER):
            yield from self._search(queries[a : a + TOGETHER], k)

    def _search(self, part: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, width = len(part), self.n_blocks * self.block
        q, score = np.zeros((n, len(self.common))), np.zeros((n, width))
        for i, (t, w) in enumerate(part):
            c = self.column[t]
            q[i, c[c >= 0]] = w[c >= 0]
            t, w = t[c < 0], w[c < 0]
            size = self.at[t + 1] - self.at[t]
            p = ranges(self.at[t], size)
            score[i] = np.bincount(self.doc[p], np.repeat(w, size) * self.weight[p], width)
        # postings count in full, so of these the bound is the largest sum of a block
        bound = q @ self.most + score.reshape(n, self.n_blocks, self.block).max(axis=2, initial=0.0)
        ahead = -(-k // self.block) + AHEAD
        first = np.argpartition(-bound, ahead, axis=1)[:, :ahead] if ahead < self.n_blocks else np.broadcast_to(np.arange(self.n_blocks), bound.shape)
        seen = np.zeros(bound.shape, bool)
        np.put_along_axis(seen, first, True, axis=1)
        who, at, product = self._look(q, score, seen & (bound >= NEAR), np.zeros(n), k)
        # the others that can still hold one of the k
        kth = np.zeros(n)
        count = np.bincount(who, minlength=n)
        full = count == k
        kth[full] = product[np.cumsum(count)[full] - 1]
        more = ~seen & (bound >= np.maximum(kth - NEAR, NEAR)[:, None])
        self.seen += int((seen | more).sum())
        self.skipped += int((~seen & ~more).sum())
        if more.any():
            rest = self._look(q, score, more, kth, k)
            who, at, product = self._best(*(np.concatenate(x) for x in zip((who, at, product), rest)), k)
        edges = np.searchsorted(who, np.arange(n + 1))
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield at[lo:hi], product[lo:hi]

    def _look(self, q: np.ndarray, score: np.ndarray, wanted: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of the wanted blocks of each query that reach its floor, as queries in order,
        examples and products."""
        which, who = np.nonzero(wanted.T)
        got = np.empty((len(who), self.block))
        cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(which) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            b = which[lo]
            got[lo:hi] = q[who[lo:hi]] @ self.blocks[b]
            got[lo:hi] += score[who[lo:hi], b * self.block : (b + 1) * self.block]
        got = np.round(got, 9)
        row, place = np.nonzero((got > 0) & (got >= floor[who][:, None]))
        at = which[row] * self.block + place
        return self._best(who[row], self.number[at], got[row, place], k)

    @staticmethod
    def _best(who: np.ndarray, at: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((at, -product, who))
        who, at, product = who[order], at[order], product[order]
        start = np.searchsorted(who, who)
        keep = np.arange(len(who)) - start < k
        return who[keep], at[keep], product[keep]


def text_words(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted hashes of its words and how often each is in it."""
    for a, b in chunks(texts):
        h, offs = folded_words(texts[a:b])
        row = np.repeat(np.arange(b - a), np.diff(offs))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(first)
        n, ends = np.diff(np.append(starts, len(h))), np.searchsorted(row[starts], np.arange(b - a + 1))
        h = h[starts]
        for i in range(b - a):
            yield h[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): in how many of all documents each word is; the row without a term counts the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(words: list[np.ndarray], n: int) -> pa.RecordBatch:
            term, df = np.unique(np.concatenate(words), return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([None, *term.view(np.int64).tolist()], pa.int64()), pa.array([n, *df.tolist()], pa.int64())], ["term", "n"])

        words, size, n = [], 0, 0
        for batch in small(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for h, _ in text_words(texts):
                words.append(h)
                size += len(h)
                n += 1
                if size >= GATHER:
                    yield counted(words, n)
                    words, size, n = [], 0, 0
        yield counted(words, n)

    return docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def inverse(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def weighted(words: Iterable[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the words of each text the places of those in the sorted ``terms`` with their weights,
    and the hashes of the others with the factors of their frequencies in the text."""
    for h, n in words:
        at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
        hit = terms[at] == h if len(terms) else np.zeros(len(h), bool)
        tf = 1 + np.log(n)
        yield at[hit], tf[hit] * idf[at[hit]], h[~hit], tf[~hit]


def chi_squared(places: list[np.ndarray], y: np.ndarray, n_terms: int) -> np.ndarray:
    """How far the document frequencies of each word differ between the classes."""
    count = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=n_terms)
    n, yes, share = count(places), count([a for a, c in zip(places, y) if c]), y.mean()
    return (yes - n * share) ** 2 / np.maximum(n * share * (1 - share) * (1 - n / len(y)), 1e-9)


class ToxicityModel:
    """The index with its labels, and the calibration."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, names: list[int], words: list[tuple[np.ndarray, np.ndarray]], y: list[int], prior: float):
        """``words`` are the sorted hashes of an example's words and how often each is in it."""
        self.terms, self.names, self.y, self.prior = terms, np.array(names, object), np.array(y, np.float64), prior
        rows = [(at, w) for at, w, _, _ in weighted(words, terms, idf)]
        factor = np.maximum(1.0, chi_squared([at for at, _ in rows], self.y, len(terms)))
        self.idf = idf * factor
        rows = [(at, w * factor[at] / max(np.linalg.norm(w * factor[at]), 1e-12)) for at, w in rows]
        doc = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        flat = lambda i, kind: np.concatenate([r[i] for r in rows]).astype(kind) if rows else np.zeros(0, kind)
        self.index = BlockMaxIndex(doc, flat(0, np.int64), flat(1, np.float64), len(rows), len(terms))
        self.slope, self.shift = 1.0, 0.0

    def nearest(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """The neighbours with the products of their vectors and the text's, and its squared length by known words."""
        for a in range(0, len(texts), TOGETHER):
            rows = [(at, w) for at, w, _, _ in weighted(text_words(texts[a : a + TOGETHER]), self.terms, self.idf)]
            for (_, w), (found, dot) in zip(rows, self.index.nearest_of_all(rows, K)):
                yield found, dot, float((w * w).sum())

    def vote(self, found: np.ndarray, near: np.ndarray) -> float:
        """Share of toxic votes."""
        v = 1.0 / (1.0 - np.minimum(near, 1.0) + SOFT)
        return float(((v * self.y[found]).sum() + PRIOR * self.prior) / (v.sum() + PRIOR))

    def calibrate(self, votes: list[float], y: list[int]) -> None:
        """Logistic curve over the logit of the vote, by Newton steps; ridge 1e-3."""
        if len(set(y)) < 2:
            return
        x = np.array([self.logit(v) for v in votes])
        a, t, b = np.stack([x, np.ones_like(x)], 1), np.array(y, np.float64), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (t - p) - 1e-3 * (b - [1.0, 0.0]))
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(b[0]), float(b[1])

    @staticmethod
    def logit(v: float) -> float:
        v = min(max(v, 1e-4), 1 - 1e-4)
        return float(np.log(v / (1 - v)))

    def score(self, vote: Column) -> Column:
        v = F.least(F.greatest(vote, F.lit(1e-4)), F.lit(1 - 1e-4))
        x = F.lit(self.slope) * F.log(v / (1 - v)) + F.lit(self.shift)
        return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def words_of(sample: DataFrame) -> DataFrame:
    """(doc_id, y, h, n): the words of sampled documents as packed hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = list(text_words(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())], ["doc_id", "y", "h", "n"])

    kind = dict(sample.dtypes)["doc_id"]
    return sample.select("doc_id", "y", "text").mapInArrow(run, f"doc_id {kind}, y int, h binary, n binary")


def frequencies_of(words: DataFrame, df: DataFrame) -> pa.Table:
    """(term, n) of the distinct words of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)))], ["term"])

    terms = words.select("h").mapInArrow(run, "term bigint").distinct()
    return terms.join(df, "term", "left").select("term", F.coalesce("n", F.lit(1)).alias("n")).toArrow()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[ToxicityModel | float, DataFrame | None, int]:
    """A model, or the labels' mean where there are not two classes to tell apart; the words in
    more than one document with their numbers of documents; and how many documents there are.

    Of the examples the driver gets words and counts, of the other sample the votes.
    """
    sample = cut_lineage(labelled_sample(docs, labels, label, REFERENCES, CALIBRATE, balanced=True))
    count = {(r["fit"], r["y"]): r["n"] for r in sample.groupBy("fit", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda fits: {y: n for (f, y), n in count.items() if f == fits}
    base = of(False) or of(True)
    mean = base.get(1, 0) / sum(base.values()) if base else 0.0
    if len(of(True)) < 2:
        return mean, None, 0
    df = cut_lineage(document_frequencies(docs).filter("n > 1 OR term IS NULL"))
    n = df.filter("term IS NULL").first()["n"]
    df = df.filter("term IS NOT NULL")
    examples = cut_lineage(words_of(sample.filter("fit")))
    known = frequencies_of(examples, df)
    terms, counted = known.column("term").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(terms)
    rows = examples.orderBy("doc_id", "h").toArrow().to_pylist()  # bounded by REFERENCES
    words = [(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int32)) for r in rows]
    model = ToxicityModel(terms[order], inverse(n, counted[order]), [r["doc_id"] for r in rows], words, [r["y"] for r in rows], mean)
    if of(False):
        others = sample.filter("NOT fit")
        known_votes = votes(others.select("doc_id", "text", "y"), model, df, n, ["y"]).select("vote", "y").collect()  # bounded by CALIBRATE
        model.calibrate([r["vote"] for r in known_votes], [r["y"] for r in known_votes])
    return model, df, n


def name_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def votes(docs: DataFrame, model: ToxicityModel, df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """(keep..., vote, evidence) of every text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"`{c}` {k}" for c, k in docs.select(*keep).dtypes)
    m = len(keep)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch.column(m).to_pylist()]
            found, dot, size = zip(*shared.value.nearest(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:m], pa.array([name_of(t) for t in texts], pa.int64()), pa.array([f.tolist() for f in found], pa.list_(pa.int32())),
                 pa.array([d.tolist() for d in dot], pa.list_(pa.float64())), pa.array(size, pa.float64())], [*keep, "key", "found", "dot", "size"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            key = np.array([name_of(t) for t in texts], np.int64)
            parts = [(h, tf) for _, _, h, tf in weighted(text_words(texts), shared.value.terms, shared.value.idf)]
            # and one row that counts the text, under a term that spreads these rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.repeat(key, [len(h) for h, _ in parts]), key])), pa.array(np.concatenate([*(h for h, _ in parts), key.view(np.uint64)]).view(np.int64)),
                 pa.array(np.concatenate([*(tf for _, tf in parts), np.full(len(key), -1.0)]), pa.float64())], ["key", "term", "tf"])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            given, told = [], []
            for found, dot, size in zip(*(batch.column(m + i).to_pylist() for i in range(3))):
                found, near = np.array(found, np.int64), np.array(dot) / np.sqrt(max(size, 1e-12))
                given.append(model.vote(found, near))
                told.append(",".join(f"{model.names[i]}:{int(model.y[i])}:{s:.4f}" for i, s in zip(found, near)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:m], pa.array(given, pa.float64()), pa.array(told, pa.string())], [*keep, "vote", "evidence"])

    found = docs.select(*keep, "text").mapInArrow(search, f"{kept}, key bigint, found array<int>, dot array<double>, size double")
    # texts that are there m times have m times the sum
    idf = F.log(F.lit(1.0 + n) / (1 + F.coalesce("n", F.lit(1)))) + 1
    extra = docs.select("text").mapInArrow(others, "key bigint, term bigint, tf double").join(df, "term", "left")
    extra = extra.groupBy("key").agg((F.sum(F.when(F.col("tf") > 0, F.pow(F.col("tf") * idf, F.lit(2.0))).otherwise(0.0)) / F.count_if(F.col("tf") < 0)).alias("rest"))
    extra = extra.select("key", F.round("rest", 9).alias("rest"))
    both = found.join(extra, "key", "left").select(*keep, "found", "dot", (F.col("size") + F.coalesce("rest", F.lit(0.0))).alias("size"))
    return both.mapInArrow(vote, f"{kept}, vote double, evidence string")


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): evidence lists neighbours as
    "doc_id:label:similarity", nearest first."""
    docs = docs.select("doc_id", "text")
    model, df, n = fit(docs, labels, label)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if isinstance(model, float):
        return rows.select("doc_id", "held_out", F.lit(model).alias("score"), F.lit(int(model >= threshold)).alias("predicted"), F.lit("").alias("evidence"))
    scored = votes(rows, model, df, n, ["doc_id", "held_out"]).withColumn("score", model.score(F.col("vote")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
