"""Lead-time probes and robustness analyses."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.exprs import ratio, safe_corr
from ..functions.ordering import agg_with_quantiles, with_running
from .series import REFERENCE_DT_US, pre_window, scale_samples, window_features

# Probe offsets as multiples of the window length.
OFFSET_MULTIPLES = [0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0]


def probe_triggers(trigger: DataFrame, n_ref: float, ref_dt: float = REFERENCE_DT_US, multiples: list[float] = OFFSET_MULTIPLES,
                   keys: list[str] | None = None) -> DataFrame:
    """One shifted trigger per event and offset; offsets stop at the first window that does not fit."""
    keys = keys or ["series_id"]
    t = trigger.withColumn("win_n", scale_samples(n_ref, "dt_us", ref_dt))
    t = t.withColumn("mult", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    t = t.withColumn("offset_n", F.bround(F.col("mult") * F.col("win_n"), 0).cast("int")).withColumn("probe_z", F.col("z") - F.col("offset_n"))
    fits = (F.col("probe_z") > 0) & (F.col("probe_z") >= F.col("win_n"))
    w = W.partitionBy(*keys).orderBy("mult").rowsBetween(W.unboundedPreceding, W.currentRow)  # a dozen rows per event
    return t.withColumn("__ok", F.min(fits).over(w)).filter("__ok").drop("__ok", "win_n")


def offset_probe(samples: DataFrame, trigger: DataFrame, n_ref: float, early_ref: float, late_ref: float, ref_dt: float = REFERENCE_DT_US,
                 multiples: list[float] = OFFSET_MULTIPLES, keys: list[str] | None = None) -> DataFrame:
    """Window features of every (event, offset): the samples are read once and matched to all windows."""
    keys = keys or ["series_id"]
    p = probe_triggers(trigger, n_ref, ref_dt, multiples, keys)
    p = p.withColumn("z", F.col("probe_z")).drop("probe_z")
    w = pre_window(samples, p, n_ref, ref_dt, keys)
    k = [*keys, "mult"]
    return window_features(w, scale_samples(early_ref, "dt_us", ref_dt), scale_samples(late_ref, "dt_us", ref_dt), k)


def lead_time(curve: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Longest unbroken run of detections from offset 0; censored when no drop was seen."""
    w = W.partitionBy(key).orderBy("mult").rowsBetween(W.unboundedPreceding, W.currentRow)
    up = F.col("proba") >= threshold
    d = curve.withColumn("__run", F.min(up).over(w))
    g = d.groupBy(key).agg(F.max(F.when(F.col("__run"), F.col("offset_ms"))).alias("lead_ms"), F.count_if(~up).alias("n_drop"))
    return g.filter(F.col("lead_ms").isNotNull()).select(key, "lead_ms", (F.col("n_drop") == 0).alias("censored"))


def lead_time_summary(leads: DataFrame) -> DataFrame:
    g = agg_with_quantiles(leads, ["censored"], [F.count(F.lit(1)).alias("n"), F.avg("lead_ms").alias("mean"), F.min("lead_ms").alias("min"), F.max("lead_ms").alias("max")], {"median": ("lead_ms", 0.5)})
    total = leads.agg(F.count(F.lit(1)).alias("n")).scalar()
    return g.withColumn("share", ratio(F.col("n"), total))


def probability_curve(features: DataFrame, score: Callable[[DataFrame], DataFrame], dt_us: DataFrame, key: str, n_ref: float, ref_dt: float) -> DataFrame:
    """Probability at every offset: one scoring pass over all (event, offset) rows."""
    d = score(features).join(dt_us.select(key, "dt_us"), key)
    off = F.bround(F.col("mult") * scale_samples(n_ref, "dt_us", ref_dt), 0)
    return d.select(key, "mult", (off * F.col("dt_us") / 1000.0).alias("offset_ms"), F.col("score").alias("proba"))


def midwindow_triggers(trigger: DataFrame, n_ref: float, ref_dt: float = REFERENCE_DT_US, margin: float = 2.0) -> DataFrame:
    """The middle of each recording as trigger, where it clears both ends by ``margin`` windows."""
    m = F.bround(scale_samples(n_ref, "dt_us", ref_dt) * F.lit(float(margin)), 0).cast("int")
    mid = F.floor(F.col("n") / 2).cast("bigint")
    return trigger.withColumn("mid", mid).withColumn("margin", m).filter((F.col("mid") - F.col("margin") > 0) & (F.col("mid") + F.col("margin") < F.col("n")))


def pretrigger_fraction(trigger: DataFrame, label: str) -> DataFrame:
    """Share of the recording before the trigger, per class."""
    d = trigger.withColumn("frac", F.col("z") / F.col("n"))
    return agg_with_quantiles(d, [label], [F.count(F.lit(1)).alias("n_events"), F.avg("frac").alias("mean"), F.stddev_pop("frac").alias("std")], {"median": ("frac", 0.5)})


def single_feature_leak_scan(long: DataFrame, label: str) -> DataFrame:
    """Best accuracy of one threshold on each feature, and its correlation with the label.

    Equal values are counted first; the ordered pass then runs in chunks per feature.
    """
    g = long.groupBy("feature", F.col("value").cast("double").alias("v")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    r = with_running(g, ["feature"], ["v"], {"cp": F.col("pos"), "cn": F.col("neg")}, {"P": "cp", "N": "cn"})
    total = F.col("P") + F.col("N")
    above = F.col("cn") + F.col("P") - F.col("cp")  # predict 1 above the value
    acc = ratio(F.greatest(above, total - above, F.col("P"), F.col("N")), total)
    best = r.groupBy("feature").agg(F.max(acc).alias("best_accuracy"))
    c = long.groupBy("feature").agg(safe_corr(F.col("value").cast("double"), F.col(label).cast("double")).alias("corr"))
    return best.join(c, "feature")


def throughput_benchmark(df: DataFrame, score: Callable[[DataFrame], DataFrame], repeats: int = 5) -> DataFrame:
    """Wall time of a full scoring pass, repeated: mean, median, p95, max and rows per second."""
    n = df.count()
    ms = []
    for _ in range(repeats):
        t0 = time.perf_counter()
        score(df).write.format("noop").mode("overwrite").save()
        ms.append(((time.perf_counter() - t0) * 1000.0,))
    t = df.sparkSession.createDataFrame(ms, "ms double")
    g = agg_with_quantiles(t, [], [F.count(F.lit(1)).alias("n_timed"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms")], {"median_ms": ("ms", 0.5), "p95_ms": ("ms", 0.95)})
    return g.withColumn("rows_per_s", F.lit(float(n)) * 1000 / F.col("mean_ms"))
