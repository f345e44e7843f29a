"""Mergeable states of distinct counts and quantiles, one for each part of a table.

A part's states are computed once, when it comes in, and kept; a report merges the states of
all parts and never reads their rows again. Distinct counts are HyperLogLog states, quantiles
KLL states; merging them gives the same bounds as one pass over all rows. Where a count must be
exact, a part keeps its distinct values as rows beside its states; a report counts those of all
parts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordering import join_on

#: Binary logarithm of the registers of a distinct count (relative error about 1.04 / 2 ** (LG / 2)), and accuracy of a quantile
#: (rank error about 1.3 % of the rows at 200, a third of that at 800).
LG, K = 14, 800


def part_states(df: DataFrame, keys: list[str], distinct: dict[str, str], quantiles: dict[str, str], lg: int = LG, k: int = K) -> DataFrame:
    """One row of states for each key: ``distinct`` and ``quantiles`` name columns {name: column}."""
    counts = [F.hll_sketch_agg(c, F.lit(lg)).alias(f"d_{n}") for n, c in distinct.items()]
    values = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(f"q_{n}") for n, c in quantiles.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts, *values)


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """The states of several parts as those of one."""
    counts = [F.hll_union_agg(c).alias(c) for c in states.columns if c.startswith("d_")]
    values = [F.kll_merge_agg_double(c).alias(c) for c in states.columns if c.startswith("q_")]
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), *counts, *values)


def _values(path: str, name: str) -> str:
    return f"{path}-values-{name}"


def add_part(part: DataFrame, path: str, keys: list[str], distinct: dict[str, str], quantiles: dict[str, str], lg: int = LG, k: int = K,
             exact: dict[str, str] | None = None) -> None:
    """Append the states of a new part to those kept below ``path``; ``exact`` names columns {name: column} whose distinct values are kept."""
    part_states(part, keys, distinct, quantiles, lg, k).write.mode("append").parquet(path)
    for name, c in (exact or {}).items():
        part.select(*keys, F.col(c).alias("value")).distinct().write.mode("append").parquet(_values(path, name))


def report(spark: SparkSession, path: str, keys: list[str], at: list[float], exact: list[str] | None = None) -> DataFrame:
    """Rows, distinct counts and quantiles of all parts so far; ``exact`` are names of exact counts."""
    m = merge_states(spark.read.parquet(path), keys)
    counts = [F.hll_sketch_estimate(c).alias(c[2:]) for c in m.columns if c.startswith("d_")]
    # nothing but nulls leaves an empty state, which has no quantile
    some = lambda c: F.kll_sketch_get_n_double(c) > 0
    values = [F.when(some(c), F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(p)))).alias(f"{c[2:]}_p{round(100 * p)}") for c in m.columns if c.startswith("q_") for p in at]
    out = m.select(*keys, "n", *counts, *values)
    for name in exact or []:
        found = spark.read.parquet(_values(path, name)).distinct().groupBy(*keys).agg(F.count("value").alias(name))
        out = join_on(out, found, keys)
    return out
