"""Leakage-safe splits, folds, blocks, sequences and class weights.

Random order comes from md5 of key and seed, so a split does not depend on the
number of partitions or on retries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import ratio, stable_hash
from ..functions.iterate import cut_lineage
from ..functions.ordering import chunk_count, join_on, with_position
from ..functions.parallel import run_all


#: Leading digits of the hash that name a bucket, so a bucket has about a 16^DIGITS-th of a stratum.
DIGITS = 3
#: Buckets of all strata up to which their labels are sent to every task instead of joined by a shuffle.
SENT = 200_000


def _hashed(df: DataFrame, key: str, strata: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their hash and bucket, and per (stratum, bucket) its rows, those before it and all of the stratum."""
    h = stable_hash(key, seed)
    d = df.withColumn("__h", h).withColumn("__b", F.coalesce(F.substring("__h", 1, DIGITS), F.lit("")))
    size = d.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__m"))
    before = W.partitionBy(*strata).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    return d, size.select("*", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__first"), F.sum("__m").over(W.partitionBy(*strata)).alias("__n"))


def _placed(d: DataFrame, buckets: DataFrame, key: str, strata: list[str]) -> DataFrame:
    """Add __pos, the position in the stratum, and __n; a bucket's window starts with a row that holds what is before it."""
    head = buckets.select(*strata, "__b", "__first", "__n", F.lit(0).alias("__row"))
    both = d.withColumn("__row", F.lit(1)).unionByName(head, allowMissingColumns=True)
    run = W.partitionBy(*strata, "__b").orderBy("__row", "__h", key)
    sofar = run.rowsBetween(W.unboundedPreceding, W.currentRow)
    pos = (F.first("__first").over(sofar) + F.row_number().over(run) - 2).alias("__pos")
    return both.select(*d.columns, "__row", pos, F.first("__n").over(sofar).alias("__n")).filter("__row = 1").drop("__row", "__h", "__b")


def _ranked(df: DataFrame, key: str, strata: list[str], seed: int) -> DataFrame:
    """Add __pos and __n in the order of hashes. They spread evenly, so their leading digits cut a stratum without a sort of it."""
    return _placed(*_hashed(df, key, strata, seed), key, strata)


def stratified_split(df: DataFrame, key: str, stratum: str | None, test: float = 0.3, val: float | None = None, seed: int = 42) -> DataFrame:
    """Exact-fraction train / val / test labels inside each stratum.

    In a large table only the buckets that a border falls into are ranked; whole buckets on
    one side of the borders get their label without a shuffle.
    """
    strata = [stratum] if stratum else []
    n_test = F.ceil(F.col("__n") * F.lit(float(test)))
    n_val = F.lit(0) if val is None else F.ceil((F.col("__n") - n_test) * F.lit(val / (1.0 - test)))

    def label(first: Column, last: Column) -> Column:
        """The label of positions from first to last, null if a border is between them."""
        return F.when(last < n_test, "test").when((first >= n_test) & (last < n_test + n_val), "val").when(first >= n_test + n_val, "train")

    d, buckets = _hashed(df, key, strata, seed)
    at = F.col("__pos")
    if chunk_count(df) == 1:
        return _placed(d, buckets, key, strata).withColumn("split", label(at, at)).drop("__pos", "__n")
    buckets = cut_lineage(buckets.withColumn("split", label(F.col("__first"), F.col("__first") + F.col("__m") - 1)))
    known = buckets.select(*strata, "__b", "split")
    known = F.broadcast(known) if buckets.count() <= SENT else known
    named = join_on(d, known, [*strata, "__b"])
    cut = _placed(named.filter("split IS NULL").drop("split"), buckets.filter("split IS NULL"), key, strata).withColumn("split", label(at, at))
    return named.filter("split IS NOT NULL").drop("__h", "__b").unionByName(cut.drop("__pos", "__n"))


def kfold(df: DataFrame, key: str, stratum: str | None, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold ids that differ by at most one row per stratum."""
    d = _ranked(df, key, [stratum] if stratum else [], seed)
    return d.withColumn("fold", (F.col("__pos") % k).cast("int")).drop("__pos", "__n")


def leakage_safe_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scale every split with statistics of the training rows."""
    from .matrix import standardize

    return standardize(df.filter(F.col("split") == "train"), df, cols)


def repeated_eval(df: DataFrame, key: str, stratum: str | None, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
                  metrics: Callable[[DataFrame], DataFrame], n: int = 10, test: float = 0.3, base_seed: int = 0) -> DataFrame:
    """Split, fit and score ``n`` times; rows (repeat, metric, label_name, value).

    ``fit(train)`` returns a scoring function; ``metrics(scored)`` returns metric rows. What
    ``df`` is made from is computed once.
    """
    df = cut_lineage(df)

    def one(i: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            d = stratified_split(df, key, stratum, test, seed=base_seed + i)
            score = fit(d.filter(F.col("split") == "train"))
            return cut_lineage(metrics(score(d.filter(F.col("split") == "test"))).withColumn("repeat", F.lit(i)))

        return run

    return reduce(DataFrame.unionByName, run_all([one(i) for i in range(n)]))


def summarize_repeats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric", "label_name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.transform(F.array_sort(F.collect_list(F.struct("repeat", "value"))), lambda s: s["value"]).alias("values"))


def cross_validate(df: DataFrame, key: str, stratum: str, fit, metrics, k: int = 5, seed: int = 42) -> DataFrame:
    """k-fold form of ``repeated_eval``; whatever ``fit`` does is refit in every fold."""
    d = cut_lineage(kfold(df, key, stratum, k, seed))

    def one(i: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            score = fit(d.filter(F.col("fold") != i))
            return cut_lineage(metrics(score(d.filter(F.col("fold") == i))).withColumn("repeat", F.lit(i)))

        return run

    return reduce(DataFrame.unionByName, run_all([one(i) for i in range(k)]))


def block_split(df: DataFrame, order: list[str], block: int = 20, train: float = 0.64, val: float = 0.16, seed: int = 42) -> DataFrame:
    """Contiguous blocks of events; each block goes whole to one split."""
    d = with_position(df, [], order, "pos").withColumn("block", F.floor(F.col("pos") / block).cast("bigint"))
    b = _ranked(d.select("block").distinct(), "block", [], seed)
    n_train = F.bround(F.col("__n") * F.lit(train), 0)
    n_val = F.bround(F.col("__n") * F.lit(val), 0)
    split = F.when(F.col("__pos") < n_train, "train").when(F.col("__pos") < n_train + n_val, "val").otherwise("test")
    return d.join(b.select("block", split.alias("split")), "block")


def sliding_sequences(df: DataFrame, block: str, pos: str, features: str, label: str, length: int = 10, stride: int = 1) -> DataFrame:
    """Runs of ``length`` consecutive events inside a block, labelled by the last one."""
    order = W.partitionBy(block).orderBy(pos)
    w = order.rowsBetween(0, length - 1)
    d = df.select(block, pos, F.collect_list(features).over(w).alias("sequence"), F.last(label).over(w).alias("label"),
                  (F.row_number().over(order) - 1).alias("__i"))
    return d.filter((F.size("sequence") == length) & (F.col("__i") % stride == 0)).drop("__i")


def sample_per_class(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows per class in md5 order; Spark keeps only n candidates per class before the shuffle."""
    d = df.withColumn("__h", stable_hash(key, seed))
    rn = F.row_number().over(W.partitionBy(label).orderBy("__h", key))
    return d.withColumn("__r", rn).filter(F.col("__r") <= n).drop("__h", "__r")


def split_composition(df: DataFrame, label: str, min_test: int = 5) -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    return g.withColumn("test_frac", ratio(F.col("test"), F.col("total"))).withColumn("warn", F.col("test") < min_test)


def split_composition_multilabel(df: DataFrame, labels: list[str], min_test: int = 5) -> DataFrame:
    flags = F.explode(F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in labels]), lambda x: x.isNotNull())).alias("label")
    return split_composition(df.select("split", flags), "label", min_test)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = c.agg(F.sum("n_class").alias("n")).scalar()
    k = c.agg(F.count(F.lit(1)).alias("k")).scalar()
    return c.withColumn("weight", ratio(total, k * F.col("n_class")))


def scale_pos_weight(df: DataFrame, labels: list[str]) -> DataFrame:
    """n_neg / n_pos per binary label, 1 when there is no positive."""
    row = df.agg(*[F.count_if(F.col(c) == 1).alias(c) for c in labels], F.count(F.lit(1)).alias("__n"))
    d = row.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n_pos")) for c in labels])).alias("r"))
    return d.select("r.label", "r.n_pos", F.coalesce(ratio(F.col("__n") - F.col("r.n_pos"), F.col("r.n_pos")), F.lit(1.0)).alias("weight"))


def powerset_weights(df: DataFrame, labels: list[str]) -> DataFrame:
    """Row weights balanced over label combinations."""
    combo = F.concat_ws("", *[F.col(c).cast("string") for c in labels])
    d = df.withColumn("combo", combo)
    return d.join(class_weights(d, "combo").drop("n_class"), "combo")


def category_vs_normal(df: DataFrame, category: str, value: str, normal: str = "Normal", minimum: int = 10) -> DataFrame:
    """Rows of one category or normal, with the target; empty when a class is too small to model."""
    d = df.filter(F.col(category).isin(value, normal)).withColumn("target", (F.col(category) == value).cast("int"))
    small = d.agg(F.least(F.count_if(F.col("target") == 1), F.count_if(F.col("target") == 0)).alias("m")).scalar()
    return d.filter(small >= minimum)
