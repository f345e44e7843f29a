"""Ordered computation that stays balanced when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. The helpers here sort a
table by key and order into range partitions, run the window inside (key, partition) and
carry the sums of the key's earlier partitions in as a header row. Ranges are of whole
ordering tuples, so equal leading values are split by the columns behind them. No row
carries a border, and none is on the driver. The number of partitions is the table's size
over ``faultspark.chunkBytes``, without a ceiling; a table of one partition has no headers,
everything else is the same. Nulls count as equal keys and come first in the order, as in
the plain window.

Series tables that carry a dense ``idx`` need no cuts: their chunk is
``idx div faultspark.seriesChunk``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .exprs import col
from .iterate import cut_lineage

#: Bytes of files for a partition; in a sort its rows took 16 to 46 times as many.
CHUNK_BYTES = 1 << 24
#: Sizes that are only a guess of the optimizer; such tables are counted.
UNKNOWN = 1 << 50


def series_chunk(spark: SparkSession) -> int:
    return int(spark.conf.get("faultspark.seriesChunk", "65536"))


def chunk_count(df: DataFrame) -> int:
    """Chunks for a table, from the size of the files it reads; runs no job unless that is
    unknown, as it is behind a checkpoint."""
    size = int(df.sparkSession.conf.get("faultspark.chunkBytes", str(CHUNK_BYTES)))
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [plan.apply(i) for i in range(plan.size())]
    known = sum(UNKNOWN if leaf.getClass().getSimpleName() == "LogicalRDD" else int(str(leaf.stats().sizeInBytes())) for leaf in leaves)
    return max(1, math.ceil((known if known < UNKNOWN else 32 * df.count()) / size))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; a table without keys has one row."""
    if not keys:
        return left.join(right)
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def in_order(df: DataFrame, by: list[Column | str], parts: int) -> DataFrame:
    """The rows in ascending order over ``parts`` partitions, with the partition's number as __part.

    Borders are chosen by Spark from a sample and stay with its shuffle. The checkpoint makes
    the numbers the same for all who read them.
    """
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return cut_lineage(ordered.withColumn("__part", F.spark_partition_id()))


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums per key, and under ``totals`` {name: sum} the key's whole sums."""
    totals = totals or {}
    cols = df.columns
    values = {f"__v_{n}": e for n, e in sums.items()}
    places = {f"__o{i}": col(c) for i, c in enumerate(order)}
    d = df.withColumns(values).withColumns(places)
    parts = chunk_count(df)
    if parts == 1:
        inside = W.partitionBy(*keys)
        run = inside.orderBy(*places).rowsBetween(W.unboundedPreceding, W.currentRow)
        d = d.select("*", *[F.sum(f"__v_{n}").over(run).alias(f"__s_{n}") for n in sums], *[F.sum(f"__v_{s}").over(inside).alias(f"__u_{n}") for n, s in totals.items()])
        return d.select(*cols, *[F.col(f"__s_{n}").alias(n) for n in sums], *[F.col(f"__u_{n}").alias(n) for n in totals])
    d = in_order(d, [*keys, *places], parts)
    # one row for each key and partition: what its earlier partitions hold
    base = d.groupBy(*keys, "__part").agg(*[F.sum(v).alias(v) for v in values])
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    base = base.select(*keys, "__part", F.lag("__part").over(W.partitionBy(*keys).orderBy("__part")).isNotNull().alias("__later"),
                       *[F.sum(v).over(before).alias(v) for v in values], *[F.sum(f"__v_{s}").over(whole).alias(f"__t_{n}") for n, s in totals.items()])
    base = (base if totals else base.filter("__later")).drop("__later")
    d = d.withColumn("__row", F.lit(1)).unionByName(base.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    inside = W.partitionBy(*keys, "__part")
    run = inside.orderBy("__row", *places).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.select("*", *[F.sum(f"__v_{n}").over(run).alias(f"__s_{n}") for n in sums], *[F.max(f"__t_{n}").over(inside).alias(f"__u_{n}") for n in totals]).filter("__row = 1")
    return d.select(*cols, *[F.col(f"__s_{n}").alias(n) for n in sums], *[F.col(f"__u_{n}").alias(n) for n in totals])


def with_position(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row inside its key."""
    out = with_running(df, keys, order, {"__position": F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col("__position") - 1).drop("__position")


def agg_with_quantiles(df: DataFrame, keys: list[str], aggs: list[Column], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """Group aggregates plus exact interpolated quantiles ``{name: (column, p)}``.

    Equal values of all columns are counted first, which combines before the shuffle; one
    ordered pass over (column, value) then gives each value its ranks, and an aggregate per
    column picks the two order statistics around each quantile. Only its results, one row for
    each column, are spread to the named columns.
    """
    keys, wanted = list(keys), list(dict.fromkeys(c for c, _ in quantiles.values()))
    values = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(wanted)])
    long = df.select(*keys, F.explode(values).alias("__x")).filter("__x.v IS NOT NULL")
    freq = long.groupBy(*keys, F.col("__x.c").alias("__c"), F.col("__x.v").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    run = with_running(freq, [*keys, "__c"], ["__v"], {"__hi": F.col("__n")}, {"__all": "__hi"})
    lo, shares = F.col("__hi") - F.col("__n"), list(dict.fromkeys(p for _, p in quantiles.values()))
    picks, between = [], []
    for i, p in enumerate(shares):
        h = (F.col("__all") - 1) * F.lit(float(p))
        at = lambda rank: F.max(F.when((lo <= rank) & (rank < F.col("__hi")), F.col("__v")))
        picks += [at(F.floor(h)).alias(f"__a{i}"), at(F.ceil(h)).alias(f"__b{i}"), F.max(h - F.floor(h)).alias(f"__f{i}")]
        a, b, f = F.col(f"__a{i}"), F.col(f"__b{i}"), F.col(f"__f{i}")
        between.append(F.when(a == b, a).otherwise(a * (1 - f) + b * f).alias(f"__q{i}"))
    each = run.groupBy(*keys, "__c").agg(*picks).select(*keys, "__c", *between)
    got = each.groupBy(*keys).agg(*[F.max(F.when(F.col("__c") == wanted.index(c), F.col(f"__q{shares.index(p)}"))).alias(n) for n, (c, p) in quantiles.items()])
    out = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("__rows"))
    return join_on(out, got, keys, "left").drop("__rows")


def neighbours(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[str, int]],
    idx: str = "idx",
    chunk: int | None = None,
) -> DataFrame:
    """Add values of nearby samples: ``{new: (column, offset)}``, negative offset = earlier.

    Rows near a chunk border are copied into the adjoining chunk, so each window
    covers one bounded chunk and a long series spreads over many tasks.
    """
    back = max([-o for _, o in wanted.values() if o < 0], default=0)
    ahead = max([o for _, o in wanted.values() if o > 0], default=0)
    d = _haloed(df, back, ahead, idx, chunk)
    w = W.partitionBy(*keys, "__chunk").orderBy(idx)
    d = d.select("*", *[
        (F.lag(c, -o) if o < 0 else F.lead(c, o)).over(w).alias(n) for n, (c, o) in wanted.items()
    ])
    return d.filter(F.col("__chunk") == F.col("__home")).select(*df.columns, *wanted)


def _haloed(df: DataFrame, back: int, ahead: int, idx: str, chunk: int | None = None) -> DataFrame:
    """Rows with their chunk ``__home`` and each chunk ``__chunk`` that looks at them."""
    size = max(chunk or series_chunk(df.sparkSession), back, ahead)
    home = F.floor(F.col(idx) / size).cast("bigint")
    inside = F.col(idx) % size
    copies = [home]
    if back:
        copies.append(F.when(inside >= size - back, home + 1))
    if ahead:
        copies.append(F.when((inside < ahead) & (home > 0), home - 1))
    return df.withColumn("__home", home).withColumn("__chunk", F.explode(F.array_compact(F.array(*copies))))


def rolling(df: DataFrame, keys: list[str], wanted: dict[str, Column], before: int, after: int, idx: str = "idx", chunk: int | None = None) -> DataFrame:
    """Add aggregates over the ``before`` rows before each row, the row, and the ``after`` rows behind it: ``{new: aggregate}``."""
    w = W.partitionBy(*keys, "__chunk").orderBy(idx).rowsBetween(-before, after)
    d = _haloed(df, before, after, idx, chunk).select("*", *[a.over(w).alias(n) for n, a in wanted.items()])
    return d.filter(F.col("__chunk") == F.col("__home")).select(*df.columns, *wanted)


def series_prefix(
    df: DataFrame,
    keys: list[str],
    value: Column,
    name: str,
    idx: str = "idx",
    chunk: int | None = None,
) -> DataFrame:
    """Inclusive prefix sum of ``value`` along ``idx`` using fixed-size chunks."""
    size = chunk or series_chunk(df.sparkSession)
    d = df.withColumn("__chunk", F.floor(F.col(idx) / size).cast("bigint")).withColumn("__x", value)
    parts = [*keys, "__chunk"]
    w = W.partitionBy(*parts).orderBy(idx).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    base = d.groupBy(*parts).agg(F.sum("__x").alias("__t"))
    base = base.select(*parts, F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__o"))
    local = d.withColumn("__s", F.sum("__x").over(w))
    return join_on(local, base, parts).withColumn(name, F.col("__s") + F.col("__o")).select(*df.columns, name)
