"""Neighbour joins without all pairs: exact by a metric tree, approximate by hash tables.

The tree has two levels. Of n points, the square root of n / LEAF become top pivots, the
only ones that the driver sees; a 1 / LEAF share become leaf pivots below the top pivot they
are nearest to. Points go to their nearest top pivot and then to the nearest leaf pivot of
that cell, so leaves stay of bounded size on average at any n, while no task compares with
more pivots than one cell has. A ball around a query and a cell cannot meet if the triangle
inequality or the hyperplane between two pivots says so; the query goes to all other
leaves, so nothing is left out. Inside a leaf, queries and candidates are cut into blocks,
and every (query block, candidate block) task returns at most k rows per query or one
aggregate per query, never the pairs.

Where a few queries, chosen by hashes, show that balls meet many leaves (in high dimension
they meet nearly all), vectors are not dealt out to leaves: they are packed into blocks that
are stored once, and tasks read every block of queries beside every run of stored blocks. So
what is shuffled are the vectors once and the results of a task.

Equal vectors can't be told apart by pivots; of each such group a neighbour search keeps the
k smallest ids, which are the only ones that can be an answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from ..functions.iterate import cut_lineage

#: Points of a leaf on average, rows of a block, and of a task that deals a cell's rows to leaves.
LEAF, BLOCK, DEAL = 2048, 2048, 16384
#: Rows of a stored block, and blocks that a task reads in turn beside one of its own.
PACK, TURN = 8192, 16
#: Leaves that a query may be dealt to on average, or their share if that is more; beyond it stored blocks are read.
VISITS, VISIT_SHARE, PROBES = 8, 1 / 32, 256
#: Rows of a block that are compared at a time, and pairs whose distance is computed at a time.
SLAB, PAIRS = 512, 65536


def _matrix(col) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, 1))


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _share(id_: str, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), id_).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))


# ---- the tree --------------------------------------------------------------------------

@dataclass(frozen=True)
class Tree:
    tops: np.ndarray
    size: np.ndarray  # points below each top pivot
    radius: np.ndarray  # their largest distance to it
    points: DataFrame  # id, x, further columns, top, sub
    leaves: DataFrame  # top, sub, px, radius
    n_leaves: int
    slack: float  # what rounding may take from a distance


def _nearest_top(df: DataFrame, tops: np.ndarray) -> DataFrame:
    """Add the nearest top pivot and the distance to it."""

    def run(it):
        for p in it:
            if len(p):
                d = np.sqrt(_gram(_matrix(p["x"]), tops))
                top = d.argmin(axis=1)
                yield p.assign(top=top.astype("int32"), to_top=d[np.arange(len(p)), top])

    return df.mapInPandas(run, df.withColumn("top", F.lit(0)).withColumn("to_top", F.lit(0.0)).schema)


def _per_top(rows: DataFrame, leaves: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Run ``f`` on the rows of each top cell, cut into parts, beside the cell's leaf pivots."""
    parts = rows.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("__parts"))
    left = rows.join(parts, "top").withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")).drop("__parts")
    right = leaves.join(parts, "top").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    names = schema.names

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        out = [f(a.iloc[i : i + 512], b) for i in range(0, len(a), 512)]
        return pd.concat(out)[names]

    return left.groupBy("top", "__part").cogroup(right.groupBy("top", "__part")).applyInPandas(run, schema)


def _nearest_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Add the nearest leaf pivot of a row's top cell and the distance to it."""

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = np.sqrt(_gram(_matrix(a["x"]), _matrix(b["px"])))
        at = d.argmin(axis=1)
        return a.assign(sub=b["sub"].to_numpy()[at], to_sub=d[np.arange(len(a)), at])

    return _per_top(rows, leaves, nearest, rows.withColumn("sub", F.lit(0).cast("bigint")).withColumn("to_sub", F.lit(0.0)).schema)


def plant(base: DataFrame, id_: str, vec: str, extra: list[str] | None = None) -> Tree:
    """The tree of the points of ``base``."""
    d = cut_lineage(base.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("x"), *(extra or [])))
    n = d.count()
    m = max(1, math.ceil(math.sqrt(n / LEAF)))
    rows = d.select("id", "x").orderBy(_share("id", "top"), "id").limit(m).collect()
    tops = np.unique(np.array([r[1] for r in rows], dtype=float), axis=0) if rows else np.zeros((1, 1))
    # every top pivot is one of its leaf pivots, with number 0
    own = d.sparkSession.createDataFrame([(i, 0, [float(v) for v in p]) for i, p in enumerate(tops)], "top int, sub bigint, px array<double>")
    placed = _nearest_top(d, tops)
    picked = placed.filter(_share("id", "leaf") < 1.0 / LEAF).select("top", F.xxhash64("x").alias("sub"), F.col("x").alias("px")).dropDuplicates(["top", "sub"])
    pivots = cut_lineage(own.unionByName(picked))
    points = cut_lineage(_nearest_leaf(placed, pivots))
    stats = points.groupBy("top", "sub").agg(F.max("to_sub").alias("radius"))
    leaves = cut_lineage(pivots.join(stats, ["top", "sub"]).select("top", "sub", "px", "radius"))  # those that have points
    size, radius = np.zeros(len(tops)), np.full(len(tops), -np.inf)
    for top, count, r in points.groupBy("top").agg(F.count(F.lit(1)), F.max("to_top")).collect():
        size[top], radius[top] = count, r
    most = float(np.abs(tops).max(initial=0.0) + radius[size > 0].max(initial=0.0) + 1.0)
    return Tree(tops, size, radius, points.drop("to_top", "to_sub"), leaves, leaves.count(), 1e-6 * most)


def _may_meet(d: np.ndarray, gap: np.ndarray, radius: np.ndarray, ball: np.ndarray, slack: float) -> np.ndarray:
    """Cells that a ball can reach: d are distances to pivots, gap those of the nearest pivot to all."""
    near = d[np.arange(len(d)), d.argmin(axis=1)]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d**2 - (near**2)[:, None]) / (2.0 * gap)
    plane[gap == 0] = 0.0
    return np.maximum(plane, d - radius[None, :]) - slack <= ball[:, None]


def reached_leaves(queries: DataFrame, tree: Tree) -> DataFrame:
    """Each query (id, x, r, ...) once for every leaf with points within r of it: adds top, sub."""
    tops, radius, slack = tree.tops, tree.radius, tree.slack
    if not tree.size.sum():
        return queries.withColumn("top", F.lit(0)).withColumn("sub", F.lit(0).cast("bigint")).filter("false")
    between = np.sqrt(_gram(tops, tops))

    def run(it):
        for p in it:
            if len(p):
                d = np.sqrt(_gram(_matrix(p["x"]), tops))
                row, top = np.nonzero(_may_meet(d, between[d.argmin(axis=1)], radius, p["r"].to_numpy() + slack, slack))
                yield p.iloc[row].assign(top=top.astype("int32"))

    def below(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        at = _matrix(b["px"])
        d = np.sqrt(_gram(_matrix(a["x"]), at))
        gap = np.sqrt(_gram(at[d.argmin(axis=1)], at))
        row, leaf = np.nonzero(_may_meet(d, gap, b["radius"].to_numpy(), a["r"].to_numpy() + slack, slack))
        return a.iloc[row].assign(sub=b["sub"].to_numpy()[leaf])

    first = queries.mapInPandas(run, queries.withColumn("top", F.lit(0)).schema)
    return _per_top(first, tree.leaves, below, first.withColumn("sub", F.lit(0).cast("bigint")).schema)


def block_join(q: DataFrame, c: DataFrame, keys: list[str], task: Callable, schema: str, first: bool = False) -> DataFrame:
    """Run ``task(query block, candidate block)`` on all pairs of blocks of each cell; both sides have id, x, keys.

    With ``first`` a query block meets one candidate block of its cell only, so no query is sent twice.
    """
    c = c.select(*[F.col(n).alias(n) for n in c.columns])  # both sides may be the same table
    blocks = lambda d, name: d.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = blocks(q, "__nq").join(blocks(c, "__nc"), keys)
    meets = F.col("__qb") % F.col("__nc")
    left = q.join(sizes, keys).withColumn("__qb", F.pmod(F.xxhash64("id"), F.col("__nq")).cast("int")).withColumn("__cb", meets if first else F.explode(F.sequence(F.lit(0), F.col("__nc") - 1)))
    right = c.join(sizes, keys).withColumn("__cb", F.pmod(F.xxhash64("id", F.lit(1)), F.col("__nc")).cast("int")).withColumn("__qb", F.explode(F.sequence(F.lit(0), F.col("__nq") - 1)))
    right = right.filter(F.col("__cb") == meets) if first else right
    unit = [*keys, "__qb", "__cb"]
    names = [field.split()[0] for field in schema.split(",")]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        return task(a, b)

    return left.drop("__nq", "__nc").groupBy(*unit).cogroup(right.drop("__nq", "__nc").groupBy(*unit)).applyInPandas(run, schema)


# ---- stored blocks ---------------------------------------------------------------------

def pack(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows (cell, id, ...) as stored blocks of one cell, one to a partition: each column becomes one array, arrays end to end."""
    names = [f.name for f in df.schema if f.name != "cell"]
    size = cut_lineage(df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PACK).cast("int").alias("__n")))
    first = F.coalesce(F.sum("__n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each cell
    m = max(1, size.agg(F.sum("__n")).first()[0] or 0)
    number = (F.col("__first") + F.pmod(F.xxhash64("id"), F.col("__n"))).cast("int")
    rows = df.join(size.withColumn("__first", first), "cell").withColumn("block", number)
    blocks = rows.groupBy("cell", "block").agg(F.collect_list(F.struct(*names)).alias("r"))
    flat = [(F.flatten(f"r.{n}") if isinstance(df.schema[n].dataType, ArrayType) else F.col(f"r.{n}")).alias(n) for n in names]
    return cut_lineage(blocks.select("cell", "block", *flat).repartitionById(m, "block")), m


def _unpack(batch: pa.RecordBatch, row: int, columns: dict[str, bool], side: str) -> pd.DataFrame:
    """One block of a pair as rows; ``columns`` tells which hold arrays."""
    flat = {n: batch.column(f"{side}{n}").slice(row, 1).flatten().to_numpy(zero_copy_only=False) for n in columns}
    n = len(flat["id"])
    return pd.DataFrame({c: list(flat[c].reshape(n, -1)) if wide else flat[c] for c, wide in columns.items()}).assign(cell=batch.column(f"{side}cell")[row].as_py())


def against_all(q: DataFrame, c: DataFrame | None, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Every block of ``q`` against all blocks of its cell in ``c`` (none: ``q`` itself); both have cell, id, x.

    ``step(state, query block, candidate block)`` is called in turn, first with None, and ``finish`` makes rows of the last state.
    Blocks are read where they are stored; no row is sent more than once.
    """
    stored, m = pack(q)
    others, mc = (stored, m) if c is None else pack(c)
    wide = lambda d: {f.name: isinstance(f.dataType, ArrayType) for f in d.schema if f.name != "cell"}
    left, right = wide(q), wide(q if c is None else c)
    a = stored.select(*[F.col(n).alias(f"a_{n}") for n in stored.columns])
    b = others.coalesce(max(1, math.ceil(mc / TURN))).select(*[F.col(n).alias(f"b_{n}") for n in others.columns])
    # no key to shuffle by: every pair of partitions is a task that reads both
    pairs = a.join(b.hint("shuffle_replicate_nl"), F.col("a_cell") - F.col("b_cell") == 0)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def rows(state) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(finish(state)[target.names], schema=target, preserve_index=False)

    def run(batches):
        at = state = block = None
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("a_block")[i].as_py()
                if number != at:
                    if state is not None:
                        yield rows(state)
                    at, state, block = number, None, _unpack(batch, i, left, "a_")
                state = step(state, block, _unpack(batch, i, right, "b_"))
        if state is not None:
            yield rows(state)

    return pairs.mapInArrow(run, schema)


def merging(task: Callable, merge: Callable, slab: int | None = None) -> tuple[Callable, Callable]:
    """Step and finish of ``task(query rows, candidate rows)`` whose results ``merge`` makes one for each row again.

    The task gets ``slab`` rows of a block at a time (all, if none is given: it cuts them itself).
    """

    def step(state, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [task(a.iloc[i : i + (slab or len(a))], b) for i in range(0, len(a), slab or len(a))]
        return merge(pd.concat(found if state is None else [state, *found], ignore_index=True))

    return step, lambda state: state


def screening(y: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of rows x and their limits: pairs of x and y whose squared distance may be up to
    the row's limit, all that are and few that are not. The next call may overwrite its result.

    Single precision does if its rounding is small beside the limits. What is known of y is
    computed once, and slabs of rows share the memory of their products, as fresh memory costs
    more than these.
    """
    yy, held = (y * y).sum(1), {}
    far = yy.max(initial=0.0)
    right = np.concatenate([y, np.ones((len(y), 1)), yy[:, None]], axis=1)
    small = np.ascontiguousarray(right.astype(np.float32).T) if far < 1e25 else None

    def near(x: np.ndarray, limit: np.ndarray) -> np.ndarray:
        xx = (x * x).sum(1)
        most = xx.max(initial=0.0) + far
        loose = 2.0 * (x.shape[1] + 6) * 2.0**-24 * most
        if 1e-25 < most < 1e25 and loose <= 0.01 * limit.min(initial=np.inf):
            a = np.concatenate([-2.0 * x, xx[:, None], np.ones((len(x), 1))], axis=1).astype(np.float32)
            shape = len(x), len(y)
            if held.get("shape") != shape:
                held.update(shape=shape, d=np.empty(shape, np.float32), hit=np.empty(shape, bool))
            d = np.matmul(a, small, out=held["d"])
            return np.less_equal(d, ((limit + loose) * (1 + 1e-6)).astype(np.float32)[:, None], out=held["hit"])
        return _gram(x, y) <= (limit + 1e-9 * (xx + far))[:, None]

    return near


def screen(x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return screening(y)(x, limit)


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each hit."""
    return np.divmod(np.flatnonzero(hit), max(hit.shape[1], 1))


def _exact_of(x: np.ndarray, y: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[_exact(x[r[i : i + PAIRS]], y[s[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)]])


def distance_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, rows: int = 256, cols: int = 256) -> np.ndarray:
    """Distances of each row of x to all of y, times ``weights``; small ones, where rounding would show, are computed exactly.

    Pairs are taken in tiles that stay in a core's cache; one product gives the squares and the cross terms.
    """
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    left, right = np.column_stack([x, xx, np.ones(len(x))]), np.vstack([-2.0 * y.T, np.ones(len(y)), yy])
    out, held = np.zeros((len(x), weights.shape[1])), np.empty((min(rows, len(x)), min(cols, len(y))))
    for j in range(0, len(y), cols):
        far, weight, across = yy[j : j + cols], weights[j : j + cols], np.ascontiguousarray(right[:, j : j + cols])
        for i in range(0, len(x), rows):
            near = xx[i : i + rows]
            d = np.matmul(left[i : i + rows], across, out=held[: len(near), : len(far)])
            if not d.min() >= 1e-5 * (near.max() + far.max()):
                r, s = np.nonzero(d < 1e-5 * (near[:, None] + far))
                d[r, s] = _exact_of(x[i : i + rows], y[j : j + cols], r, s) ** 2
            out[i : i + rows] += np.sqrt(d, out=d) @ weight
    return out


def _meets_many(queries: DataFrame, tree: Tree) -> bool:
    """Whether queries (id, x, r) meet so many leaves that dealing them out costs more than reading all blocks."""
    some = cut_lineage(queries.orderBy(_share("id", "visits"), "id").limit(PROBES))
    n = some.count()
    return tree.n_leaves > 1 and n > 0 and reached_leaves(some, tree).count() / n > max(VISITS, VISIT_SHARE * tree.n_leaves)


# ---- exact neighbours ------------------------------------------------------------------

FOUND = "id bigint, nid bigint, dist double"


def _topk_task(k: int, exclude_self: bool) -> Callable:
    def task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(a["x"]), _matrix(b["x"])
        ids, nids = a["id"].to_numpy(), b["id"].to_numpy()
        d = _gram(x, y)
        if exclude_self:
            d[ids[:, None] == nids[None, :]] = np.inf
        m = min(k, d.shape[1])
        kth = np.partition(d, m - 1, axis=1)[:, m - 1]
        tol = 1e-9 * ((x * x).sum(1) + (y * y).sum(1).max())
        r, s = np.nonzero((d <= (kth + tol)[:, None]) & np.isfinite(d))
        out = pd.DataFrame({"id": ids[r], "nid": nids[s], "dist": _exact(x[r], y[s])})
        out = out.sort_values(["id", "dist", "nid"], kind="stable")
        return out[out.groupby("id").cumcount() < k]

    return task


def _keep_top(part: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(W.partitionBy("id").orderBy("dist", "nid"))
    return part.withColumn("rank", r).filter(F.col("rank") <= k)


def _running_topk(k: int, exclude_self: bool) -> tuple[Callable, Callable]:
    """Step and finish of the k nearest of all blocks, within the r of each query."""
    need = k + 1 if exclude_self else k

    def step(state, a: pd.DataFrame, b: pd.DataFrame):
        x, y = _matrix(a["x"]), _matrix(b["x"])
        ids, nids = a["id"].to_numpy(), b["id"].to_numpy()
        if state is None:
            state = [ids, a["r"].to_numpy() ** 2 * (1 + 1e-12), np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)]
        _, limit, row, nid, dist = state
        new, reach = [(row, nid, dist)], screening(y)
        for i in range(0, len(x), SLAB):
            part = x[i : i + SLAB]
            r, s = _places(reach(part, limit[i : i + SLAB]))
            if len(r) > 64 * need * len(part):  # what a block has itself bounds it better
                d, m = _gram(part, y), min(need, len(y))
                kth = np.partition(d, m - 1, axis=1)[:, m - 1] + 1e-9 * ((part * part).sum(1) + (y * y).sum(1).max())
                r, s = np.nonzero(d <= kth[:, None])
            if exclude_self:
                other = ids[i + r] != nids[s]
                r, s = r[other], s[other]
            new.append((i + r, nids[s], _exact_of(part, y, r, s)))
        row, nid, dist = (np.concatenate(v) for v in zip(*new))
        order = np.lexsort((nid, dist, row))
        row, nid, dist = row[order], nid[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, nid, dist, rank = (v[rank < k] for v in (row, nid, dist, rank))
        last = rank == k - 1
        limit[row[last]] = np.minimum(limit[row[last]], dist[last] ** 2 * (1 + 1e-12))
        return [ids, limit, row, nid, dist]

    return step, lambda state: pd.DataFrame({"id": state[0][state[2]], "nid": state[3], "dist": state[4]})


def knn(queries: DataFrame, base: DataFrame, k: int, id_: str = "vec_id", vec: str = "x", exclude_self: bool = False) -> DataFrame:
    """k nearest base points of every query by Euclidean distance: (id, nid, dist, rank).

    ``exclude_self`` is the training form (a point is not its own neighbour); ties go
    to the smaller id. A query first looks into one block of its own leaf; what it finds there, or
    what the sizes of the top cells promise, bounds the leaves that it visits next (its own again
    if that has more blocks: leaves near the middle of many dimensions hold far more rows than others).
    """
    need = k + 1 if exclude_self else k
    # of equal vectors only the smallest ids can be among the k
    twin = F.row_number().over(W.partitionBy("x").orderBy("id"))
    few = base.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("x")).withColumn("__twin", twin).filter(F.col("__twin") <= need).drop("__twin")
    tree = plant(few, "id", "x")
    tops, size, radius, task = tree.tops, tree.size, tree.radius, _topk_task(k, exclude_self)
    q = queries.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("x"))
    if not size.sum():
        return q.select("id", F.lit(0).cast("bigint").alias("nid"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank")).filter("false")

    def promised(it):
        """A distance within which the top cells have ``need`` points."""
        for p in it:
            if len(p):
                reach = np.sqrt(_gram(_matrix(p["x"]), tops)) + radius[None, :]
                order = np.argsort(reach, axis=1)
                enough = np.cumsum(size[order], axis=1) >= need
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
                bound = np.take_along_axis(reach, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
                yield p.assign(r=np.where(enough.any(axis=1), bound, np.inf))

    own = _nearest_leaf(_nearest_top(q, tops), tree.leaves).drop("to_top", "to_sub")
    own = cut_lineage(own.mapInPandas(promised, own.withColumn("r", F.lit(0.0)).schema))
    if tree.n_leaves == 1:  # there is no other leaf to visit
        return _keep_top(block_join(own.drop("r"), tree.points, ["top", "sub"], task, FOUND), k)
    inside = cut_lineage(block_join(own.drop("r"), tree.points, ["top", "sub"], task, FOUND, first=True))
    kth = _keep_top(inside, k).groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.max("dist").alias("__kth"))
    ball = F.when(F.col("__n") >= k, F.least("r", "__kth")).otherwise(F.col("r"))
    asks = cut_lineage(own.join(kth, "id", "left").select("id", "x", ball.alias("r"), F.col("top").alias("own_top"), F.col("sub").alias("own_sub")))
    if _meets_many(asks.select("id", "x", "r"), tree):
        here = F.lit(0).alias("cell")
        return _keep_top(against_all(asks.select(here, "id", "x", "r"), tree.points.select(here, "id", "x"), *_running_topk(k, exclude_self), FOUND), k)
    large = tree.points.groupBy(F.col("top").alias("own_top"), F.col("sub").alias("own_sub")).agg((F.count(F.lit(1)) > BLOCK).alias("large"))
    asks = cut_lineage(asks.join(large, ["own_top", "own_sub"], "left"))
    more = reached_leaves(asks, tree).filter("large OR NOT (top = own_top AND sub = own_sub)").select("id", "x", "top", "sub")
    inside = inside.join(asks.filter("large").select("id"), "id", "left_anti")
    return _keep_top(inside.unionByName(block_join(more, tree.points, ["top", "sub"], task, FOUND)), k)


def within(queries: DataFrame, base: DataFrame, eps: float, task: Callable, schema: str, id_: str = "vec_id", vec: str = "x",
           q_extra: list[str] | None = None, c_extra: list[str] | None = None, merge: Callable = lambda found: found) -> DataFrame:
    """Run ``task(query block, candidate block)`` on every pair of blocks that may hold points within ``eps``.

    ``merge`` may make fewer of the rows that several tasks return.
    """
    tree = plant(base, id_, vec, c_extra)
    q = queries.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("x"), *(q_extra or []), F.lit(float(eps)).alias("r"))
    if _meets_many(q.select("id", "x", "r"), tree):
        here = F.lit(0).alias("cell")
        return against_all(q.drop("r").select(here, "*"), tree.points.drop("top", "sub").select(here, "*"), *merging(task, merge, SLAB), schema)
    return block_join(reached_leaves(q, tree).drop("r"), tree.points, ["top", "sub"], task, schema)


def close_pairs(a: pd.DataFrame, b: pd.DataFrame, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks within eps; near ties are decided on the exact distance."""
    x, y = _matrix(a["x"]), _matrix(b["x"])
    r, s = _places(screen(x, y, np.full(len(x), eps * eps * (1 + 1e-12))))
    if len(r) < len(x) * len(y) / 32:  # so few that all are decided on the exact distance
        close = _exact_of(x, y, r, s) <= eps
        return r[close], s[close]
    d = _gram(x, y)
    tol = 1e-9 * ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] + eps * eps)
    sure = d <= eps * eps - tol
    r, s = np.nonzero(np.abs(d - eps * eps) < tol)
    if len(r):
        sure[r, s] = _exact(x[r], y[s]) <= eps
    return np.nonzero(sure)


def all_blocks(df: DataFrame, task: Callable, merge: Callable, schema: str, id_: str, vec: str, extra: list[str]) -> DataFrame:
    """Every block against every block: for measures that are defined over all distances."""
    d = df.select(F.col(id_).alias("id"), F.col(vec).alias("x"), *extra, F.lit(0).alias("cell"))
    return against_all(d, None, *merging(task, merge), schema)


# ---- approximate neighbours ------------------------------------------------------------

@dataclass(frozen=True)
class Tables:
    """Hash tables of random projections: a key is ``parts`` of them, rounded down by ``width``."""

    direction: np.ndarray  # (tables, parts, dimension)
    shift: np.ndarray
    width: float

    def keys(self, x: np.ndarray) -> np.ndarray:
        t, m, p = self.direction.shape
        cell = np.floor((x @ self.direction.reshape(t * m, p).T + self.shift.ravel()) / self.width).astype(np.int64).reshape(len(x), t, m)
        out = np.zeros((len(x), t), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(m):
                out = (out ^ cell[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)


def collision(distance: float, width: float) -> float:
    """Odds that two points at a distance share the rounded value of one projection."""
    if distance <= 0:
        return 1.0
    s = width / distance
    return math.erf(s / math.sqrt(2)) - math.sqrt(2 / math.pi) / s * (1 - math.exp(-s * s / 2))


def choose_tables(near: float, usual: float, n: int, dim: int, recall: float, seed: int = 42) -> Tables:
    """Width, parts and tables for a recall of neighbours at distance ``near``.

    Keys are as long as brings a bucket of points at ``usual`` distances down to a leaf.
    """
    width = 4.0 * max(near, 1e-12)
    p_near, p_far = collision(near, width), min(collision(usual, width), 1 - 1e-9)
    parts = max(1, math.ceil(math.log(max(n / LEAF, 1.0)) / -math.log(p_far)))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(p_near**parts, 1 - 1e-9))))
    rng = np.random.default_rng(seed)
    return Tables(rng.standard_normal((tables, parts, dim)), rng.uniform(0, width, (tables, parts)), width)


def knn_approx(queries: DataFrame, base: DataFrame, k: int, id_: str = "vec_id", vec: str = "x", exclude_self: bool = False, recall: float = 0.95,
               probes: int = 256, seed: int = 42) -> DataFrame:
    """About the same as ``knn``: neighbours among the points that share a key with the query in
    one of several hash tables, with their exact distances.

    The distances that the tables are made for come from ``probes`` queries, chosen by hashes
    and compared with all points; ``recall`` is wanted of neighbours at the largest of their
    k-th distances but a tenth. Other queries may find fewer than k. Where that takes so many
    tables that their copies of the rows cost more than stored blocks, all are compared there.
    """
    q = queries.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("x"))
    c = base.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("x"))
    n = c.count()
    some = q.orderBy(_share("id", f"probe{seed}"), "id").limit(probes)
    one = [d.withColumn("cell", F.lit(0)) for d in (some, c)]
    seen = _keep_top(block_join(*one, ["cell"], _topk_task(k, exclude_self), FOUND), k).groupBy("id").agg(F.max("dist").alias("kth"))
    near = seen.agg(F.percentile_approx("kth", 0.9, 1000)).first()[0]
    if near is None:
        return q.select("id", F.lit(0).cast("bigint").alias("nid"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank")).filter("false")
    x = _matrix(some.toPandas()["x"])
    usual = float(np.sqrt(_gram(x, x)[~np.eye(len(x), dtype=bool)]).mean()) if len(x) > 1 else near
    made = choose_tables(float(near), max(usual, float(near)), n, x.shape[1], recall, seed)
    if len(made.direction) > max(VISITS, VISIT_SHARE * n / LEAF):  # a copy of a row for each table is more than reading all blocks
        here = F.lit(0).alias("cell")
        return _keep_top(against_all(q.select(here, "id", "x", F.lit(math.inf).alias("r")), c.select(here, "id", "x"), *_running_topk(k, exclude_self), FOUND), k)

    def keyed(it):
        for p in it:
            if len(p):
                key = made.keys(_matrix(p["x"]))
                for t in range(key.shape[1]):
                    yield p.assign(table=np.int32(t), key=key[:, t])

    schema = q.withColumn("table", F.lit(0)).withColumn("key", F.lit(0).cast("bigint")).schema
    part = block_join(q.mapInPandas(keyed, schema), c.mapInPandas(keyed, schema), ["table", "key"], _topk_task(k, exclude_self), FOUND)
    return _keep_top(part.groupBy("id", "nid").agg(F.min("dist").alias("dist")), k)
