"""Exact top-k search: the k-th score of each query is found by refining score histograms.

Vectors become integers, floor(scale * x), so scores (inner products) are exact and ties are
real. Rows are dealt into cells of bounded size, a part of the candidates by a part of the
queries, and every round scores all cells again: it counts the scores of each query in
``BINS`` bins of the range that holds its k-th one, adds the counts of all cells up, and
takes the bin with the k-th as the next range, until a bin is one number wide. A last round
keeps what is above the k-th score, and of the rows that have it as many as are wanted, the
smallest ids first. No round moves or keeps a score; a cell's counts end at its own k-th
score, as the k-th of all can't be lower.

Defined results: vectors that are null, or that hold a null or non-finite component or one
whose integer is beyond +-2**24, take no part, and neither do rows without an id; vectors of
other dimensions than the query's are not its candidates; two empty vectors score 0; a
query with fewer than k candidates gets them all; repeated rows are a candidate each; rows
with the query's id are its own, and an id with several vectors asks with the smallest of
them; equal scores are ranked by the smaller id; an empty table gives an empty table;
columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultspark.functions.iterate import cut_lineage

#: Most candidates and queries of a cell (on average; they are dealt by hashes).
CANDIDATES, QUERIES = 8192, 1024
#: Bins of a histogram, and queries counted at a time.
BINS, SLICE = 4096, 128
#: Integers of a component stay below.
LIMIT = 1 << 24


def integers(vec: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, null for vectors that take no part."""
    # NaN is greater than every number
    fits = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float(LIMIT / scale)))
    return F.when(fits, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, dim)


def _scored(rows: pa.Table, asked: pa.Table, dim: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of the queries with the scores of all candidates, and which of these count."""
    a, b = _matrix(rows, dim), _matrix(asked, dim)
    ids, own = rows.column("id").to_numpy(), asked.column("query_id").to_numpy()
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(dim, 1)
    kind = np.float64 if largest < 2**53 else np.int64  # either way the sums are exact
    a, b = a.astype(kind).T, b.astype(kind)
    for at in range(0, len(b), SLICE):
        part = slice(at, min(at + SLICE, len(b)))
        yield part, (b[part] @ a).astype(np.int64), ids[None, :] != own[part, None]


def _count_cell(k: int, key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """(query_id, bin, n) of one cell, from the highest bin to the one with the cell's k-th."""
    lo, top, width, above = (asked.column(c).to_numpy() for c in ("lo", "top", "width", "above"))
    ids, out = asked.column("query_id").to_numpy(), []
    for part, score, counts in _scored(rows, asked, key[0].as_py()) if rows.num_rows and asked.num_rows else ():
        step = np.maximum(width[part], 1)[:, None]
        place = (score - lo[part, None]) // step
        use = counts & (place >= 0) & (score < top[part, None]) & (width[part, None] > 0)
        n = len(score)
        seen = np.bincount((place + np.arange(n)[:, None] * BINS)[use], minlength=n * BINS).reshape(n, BINS)[:, ::-1]
        before = np.cumsum(seen, axis=1) - seen
        q, b = np.nonzero((seen > 0) & (before < (k - above[part])[:, None]))
        out.append((ids[part][q], BINS - 1 - b, seen[q, b]))
    cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "bin": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})


def _keep_cell(k: int, key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
    """(query_id, vec_id, score) above the k-th score, and the smallest ids of those that have it."""
    kth, above = asked.column("lo").to_numpy(), asked.column("above").to_numpy()
    ids, own, out = rows.column("id").to_numpy(), asked.column("query_id").to_numpy(), []
    order = np.argsort(ids, kind="stable")
    for part, score, counts in _scored(rows, asked, key[0].as_py()) if rows.num_rows and asked.num_rows else ():
        q, r = np.nonzero(counts & (score > kth[part, None]))
        out.append((own[part][q], ids[r], score[q, r]))
        tied = (counts & (score == kth[part, None]))[:, order]
        q, r = np.nonzero(tied & (np.cumsum(tied, axis=1) <= (k - above[part])[:, None]))
        out.append((own[part][q], ids[order][r], kth[part][q]))
    cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), cols)})


def search(rows: DataFrame, is_query: Column, k: int = 5, id_: str = "vec_id", vec: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each row that ``is_query`` marks.

    Work is that of all scores, once a round; rounds are those that narrow the range of
    scores to one number (two or three for short vectors).
    """
    known = rows.select(F.col(id_).cast("bigint").alias("id"), integers(vec, scale).alias("v"), is_query.alias("asks")).filter("id IS NOT NULL AND v IS NOT NULL")
    # the number of a row is fixed here, so that every round deals alike
    known = cut_lineage(known.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}))
    n, largest = known.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    asked = known.filter("asks").groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("v"))
    # no score lies beyond this: the sum of a query's integers times the largest one
    bound = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + F.abs(x).cast("bigint")) * F.lit(int(largest or 0)) + 1
    asked = cut_lineage(asked.select("query_id", "v", F.size("v").alias("dim"), (-bound).alias("lo"), (bound + 1).alias("top"), F.ceil((bound * 2 + 1) / BINS).cast("bigint").alias("width"), F.lit(0).cast("bigint").alias("above"), bound.alias("bound")))
    parts, groups = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(asked.count() / QUERIES))
    left = known.select("id", "v", "dim", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))

    def cells(state: DataFrame, f, schema: str) -> DataFrame:
        right = state.select("query_id", "v", "dim", "lo", "top", "width", "above", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("grp"))
        key = ["dim", "part", "grp"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda key, a, b: f(k, key, a, b), schema)

    while (asked.agg(F.max("width")).first()[0] or 0) > 0:
        counted = cells(asked.filter("width > 0"), _count_cell, "query_id bigint, bin bigint, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin"))  # BINS rows at most
        sums = counted.withColumn("sum", F.sum("n").over(down)).join(asked.select("query_id", "above"), "query_id")
        found = sums.filter(F.col("above") + F.col("sum") >= k).groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("sum") - F.col("n")).alias("more")), "bin").alias("f"))
        at = F.col("lo") + F.col("f.bin") * F.col("width")
        narrower = F.when(F.col("width") == 1, 0).otherwise(F.ceil(F.col("width") / BINS)).cast("bigint")
        missed = F.col("f").isNull()  # fewer than k candidates: all of them are above
        done = F.col("width") == 0
        asked = cut_lineage(asked.join(found, "query_id", "left").select(
            "query_id", "v", "dim", F.when(done, F.col("lo")).when(missed, -F.col("bound") - 1).otherwise(at).alias("lo"), (at + F.col("width")).alias("top"),
            F.when(done | missed, F.lit(0).cast("bigint")).otherwise(narrower).alias("width"),
            (F.col("above") + F.when(done | missed, F.lit(0).cast("bigint")).otherwise(F.col("f.more"))).alias("above"), "bound"))
    best = cells(asked, _keep_cell, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


#: The same in DuckDB: all scores, then ranks.
SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 65536), true)),
  q AS (SELECT vec_id AS query_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY 1),
  s AS (SELECT query_id, vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * v.v[i]))::BIGINT AS score FROM q JOIN v ON v.vec_id <> query_id AND len(v.v) = len(q.v))
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, coalesce(score, 0)::BIGINT AS score FROM s QUALIFY rank <= 5"""
