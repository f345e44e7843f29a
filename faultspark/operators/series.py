"""Alignment, windows and per-series features.

A samples table has key columns, a dense ``idx`` from 0, ``t_us`` (time relative to
the recorder's reference) and ``value``. Aggregates run straight on the key with
map-side combine. Anything ordered works on fixed-size idx chunks, so a recording
that holds a third of all samples is still spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import safe_corr
from ..functions.ordering import agg_with_quantiles, neighbours, series_chunk, series_prefix, with_position

# Sample spacing of the dominant decimation, and window lengths counted at that spacing.
REFERENCE_DT_US = 11.356860963627696
PRECURSOR_SAMPLES, EARLY_SAMPLES, LATE_START = 3000, 1000, 2000
DECAY_SAMPLES, MONOTONE_SAMPLES, JUMP_SAMPLES = 500, 100, 10
NOMINAL_TAU_S = 0.005
CARRIER_HZ = 88e6
SEGMENTS = ["early", "mid_early", "mid", "mid_late", "late"]

KEYS = ["series_id"]


def index_samples(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Give raw rows their position inside each recording."""
    return with_position(df, keys, order, "idx")


def join_events(samples: DataFrame, events: DataFrame, keys: list[str], lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Attach one row per event to its samples, optionally only to those with lo <= idx < hi.

    The event row is repeated for each idx chunk it touches and the join key includes the
    chunk, so the samples of one huge recording spread over many tasks and samples in
    chunks outside the range never match. Without bounds the events need a length ``n``.
    """
    size = series_chunk(samples.sparkSession)
    lo = F.lit(0) if lo is None else lo
    hi = F.col("n") if hi is None else hi
    chunks = F.sequence(F.floor(lo / size).cast("bigint"), F.floor((hi - 1) / size).cast("bigint"))
    e = events.filter(hi > lo).withColumn("__chunk", F.explode(chunks))
    s = samples.withColumn("__chunk", F.floor(F.col("idx") / size).cast("bigint"))
    return s.join(e, [*keys, "__chunk"]).drop("__chunk")


def find_trigger(samples: DataFrame, keys: list[str] = KEYS, fallback_dt: float = 1.0) -> DataFrame:
    """Trigger index z (smallest abs time, first on a tie), median spacing and length."""
    d = neighbours(samples.select(*keys, "idx", "t_us"), keys, {"__prev": ("t_us", -1)})
    d = d.withColumn("__dt", F.col("t_us") - F.col("__prev"))
    out = agg_with_quantiles(
        d, keys,
        [F.min_by("idx", F.struct(F.abs("t_us"), F.col("idx"))).alias("z"), F.count(F.lit(1)).alias("n")],
        {"dt_us": ("__dt", 0.5)})
    return out.withColumn("dt_us", F.coalesce("dt_us", F.lit(float(fallback_dt))))


def scale_samples(n: float, dt: Column | str, ref_dt: float = REFERENCE_DT_US) -> Column:
    """Samples covering the duration that ``n`` samples have at the reference spacing."""
    dt = F.col(dt) if isinstance(dt, str) else dt
    safe = F.when(dt > 0, dt).otherwise(F.lit(ref_dt))
    return F.greatest(F.lit(1), F.bround(F.lit(float(n) * ref_dt) / safe, 0).cast("int"))


def pre_window(samples: DataFrame, trigger: DataFrame, n_ref: float, ref_dt: float = REFERENCE_DT_US,
               keys: list[str] = KEYS, lead: Column | None = None, parts: list[str] | None = None) -> DataFrame:
    """The window of fixed duration that ends at the trigger; recordings too short for it drop out."""
    end = F.col("z") if lead is None else F.col("z") - lead
    t = trigger.withColumn("win_n", scale_samples(n_ref, "dt_us", ref_dt)).withColumn("win_end", end)
    t = t.filter(F.col("win_end") >= F.col("win_n"))
    j = join_events(samples, t, keys, F.col("win_end") - F.col("win_n"), F.col("win_end"))
    j = j.filter((F.col("idx") >= F.col("win_end") - F.col("win_n")) & (F.col("idx") < F.col("win_end")))
    return j.withColumn("pos", (F.col("idx") - (F.col("win_end") - F.col("win_n"))).cast("bigint"))


def post_window(samples: DataFrame, trigger: DataFrame, n_ref: float, ref_dt: float = REFERENCE_DT_US,
                keys: list[str] = KEYS) -> DataFrame:
    t = trigger.withColumn("win_n", scale_samples(n_ref, "dt_us", ref_dt)).filter(F.col("z") + F.col("win_n") <= F.col("n"))
    j = join_events(samples, t, keys, F.col("z"), F.col("z") + F.col("win_n"))
    j = j.filter((F.col("idx") >= F.col("z")) & (F.col("idx") < F.col("z") + F.col("win_n")))
    return j.withColumn("pos", (F.col("idx") - F.col("z")).cast("bigint"))


def segments(samples: DataFrame, trigger: DataFrame, n_ref: float, ref_dt: float = REFERENCE_DT_US,
             keys: list[str] = KEYS) -> DataFrame:
    """Mean, std and slope of five parts of the pre-trigger window; only complete parts appear."""
    t = trigger.withColumn("win_n", scale_samples(n_ref, "dt_us", ref_dt))
    t = t.withColumn("have", F.least("win_n", "z")).withColumn("seg_len", F.floor(F.col("win_n") / 5))
    t = t.filter((F.col("seg_len") > 0) & (F.col("have") >= F.col("seg_len")))
    j = join_events(samples, t, keys, F.col("z") - F.col("have"), F.col("z"))
    j = j.filter((F.col("idx") >= F.col("z") - F.col("have")) & (F.col("idx") < F.col("z")))
    pos = F.col("idx") - (F.col("z") - F.col("have"))
    j = j.withColumn("pos", pos).withColumn("seg", F.least(F.lit(4), F.floor(pos / F.col("seg_len"))).cast("int"))
    end = F.when(F.col("seg") == 4, F.col("win_n")).otherwise((F.col("seg") + 1) * F.col("seg_len"))
    j = j.filter(end <= F.col("have"))
    name = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("seg") + 1)
    return j.groupBy(*keys, name.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.coalesce(F.regr_slope("value", "pos"), F.lit(0.0)).alias("slope"))


def fixed_segments(samples: DataFrame, pre: int, bounds: dict[str, tuple[int, int]], keys: list[str] = KEYS) -> DataFrame:
    """Older form on fixed sample positions, plus the whole pre- and post-trigger parts."""
    spans = {**bounds, "full_pretrigger": (0, pre), "post_trigger": (pre, 2**31 - 1)}
    tags = F.array_compact(F.array(*[
        F.when((F.col("idx") >= a) & (F.col("idx") < b), F.lit(k)) for k, (a, b) in spans.items()]))
    d = samples.withColumn("segment", F.explode(tags))
    return d.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def series_stats(samples: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Fourteen statistics from one aggregation.

    Level statistics use the raw values; shape statistics belong to the z-scored
    series, which follows from the raw ones by shift and scale.
    """
    v = F.col(value)
    raw = agg_with_quantiles(
        samples, keys,
        [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("__lo"), F.max(v).alias("__hi"),
         F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.sum(v * v).alias("energy"), F.count(v).alias("__n")],
        {"__q1": (value, 0.25), "__q2": (value, 0.5), "__q3": (value, 0.75)})
    flat = F.col("std") <= 0

    def z(c: str) -> Column:
        return F.when(flat, F.col(c)).otherwise(F.try_divide(F.col(c) - F.col("mean"), F.col("std")))

    d = raw.withColumn("rms", F.sqrt(F.try_divide(F.col("energy"), F.col("__n"))))
    d = d.select(*keys, "mean", "std", z("__lo").alias("min"), z("__hi").alias("max"), z("__q2").alias("median"),
                 z("__q1").alias("q1"), z("__q3").alias("q3"), "skewness", "kurtosis", "rms", "energy", flat.alias("__flat"))
    z_rms = F.when(F.col("__flat"), F.col("rms")).otherwise(F.lit(1.0))
    return d.select(*keys, "mean", "std", "min", "max", (F.col("max") - F.col("min")).alias("range"), "median", "q1", "q3",
                    (F.col("q3") - F.col("q1")).alias("iqr"), "skewness", "kurtosis", "rms", "energy",
                    F.coalesce(F.try_divide(F.col("max"), z_rms), F.lit(0.0)).alias("crest_factor"))


def zscore(samples: DataFrame, keys: list[str] = KEYS, value: str = "value", eps: float | None = None) -> DataFrame:
    """(x - mean) / std per key; constant series stay unchanged unless ``eps`` is added to std."""
    aggs = [F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s")]
    if "idx" in samples.columns:
        stats = samples.groupBy(*keys).agg(*aggs, (F.max("idx") + 1).alias("__n"))
        d = join_events(samples, stats, keys, hi=F.col("__n")).drop("__n")
    else:
        d = samples.join(samples.groupBy(*keys).agg(*aggs), keys)  # adaptive execution splits a skewed key
    centred = F.col(value) - F.col("__m")
    out = (centred / (F.col("__s") + F.lit(eps))) if eps is not None else F.when(
        F.col("__s") > 0, F.try_divide(centred, F.col("__s"))).otherwise(F.col(value))
    return d.withColumn("z", out).drop("__m", "__s")


def zero_crossings(samples: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    d = neighbours(samples.select(*keys, "idx", value), keys, {"__prev": (value, -1)})
    return d.groupBy(*keys).agg(F.count_if(F.signum(value) != F.signum("__prev")).alias("zero_crossings"))


def autocorr_lag(samples: DataFrame, k: int, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Pearson correlation of the series with itself k samples later; 0 for a single sample."""
    d = neighbours(samples.select(*keys, "idx", value), keys, {"__prev": (value, -k)})
    c = F.when(F.count(F.lit(1)) <= 1, 0.0).otherwise(safe_corr("__prev", value))
    return d.groupBy(*keys).agg(c.alias("autocorr"))


def local_maxima(samples: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    d = neighbours(samples.select(*keys, "idx", value), keys, {"__a": (value, -1), "__b": (value, 1)})
    return d.filter((F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b"))).select(*keys, "idx", value)


def gradients(samples: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Central first and second differences with one-sided ends, from one neighbour pass."""
    d = neighbours(samples, keys, {"__a2": (value, -2), "__a1": (value, -1), "__b1": (value, 1), "__b2": (value, 2)})
    x, a1, a2, b1, b2 = (F.col(c) for c in (value, "__a1", "__a2", "__b1", "__b2"))
    g = F.when(a1.isNull(), b1 - x).when(b1.isNull(), x - a1).otherwise((b1 - a1) / 2)
    g_before = F.when(a2.isNull(), x - a1).otherwise((x - a2) / 2)
    g_after = F.when(b2.isNull(), b1 - x).otherwise((b2 - x) / 2)
    gg = F.when(a1.isNull(), g_after - g).when(b1.isNull(), g - g_before).otherwise((g_after - g_before) / 2)
    return d.withColumn("grad", g).withColumn("grad2", gg).drop("__a1", "__a2", "__b1", "__b2")


def derivative_features(samples: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    g = gradients(samples.select(*keys, "idx", value), keys, value)
    return g.groupBy(*keys).agg(*[
        e.alias(f"{tag}_{n}") for tag, c in (("velocity", "grad"), ("accel", "grad2"))
        for n, e in (("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("max", F.max(F.abs(c))))])


def forward_derivatives(samples: DataFrame, dt: Column, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Forward difference (last one repeated) and 3-point second derivative (ends copied)."""
    d = neighbours(samples, keys, {"__a2": (value, -2), "__a1": (value, -1), "__b1": (value, 1), "__b2": (value, 2)})
    x, a1, a2, b1, b2 = (F.col(c) for c in (value, "__a1", "__a2", "__b1", "__b2"))
    d1 = F.when(b1.isNotNull(), b1 - x).otherwise(x - a1) / dt
    d2 = (F.when(a1.isNull(), b2 - 2 * b1 + x).when(b1.isNull(), x - 2 * a1 + a2).otherwise(b1 - 2 * x + a1)) / (dt * dt)
    return d.withColumn("deriv1", d1).withColumn("deriv2", d2).drop("__a1", "__a2", "__b1", "__b2")


def forward_derivative_features(samples: DataFrame, dt: Column, keys: list[str] = KEYS) -> DataFrame:
    d = forward_derivatives(samples, dt, keys)
    return d.groupBy(*keys).agg(*[e.alias(f"{c}_{n}") for c in ("deriv1", "deriv2")
                                  for n, e in (("max", F.max(F.abs(c))), ("mean", F.avg(F.abs(c))))])


def trends(window: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Least-squares slope and leading quadratic coefficient over positions 0..win_n-1."""
    x = F.col("pos") - (F.col("win_n") - 1) / 2
    y = F.col(value)
    x2 = x * x
    g = window.groupBy(*keys).agg(
        F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x2 * y).alias("sx2y"),
        F.sum(x2).alias("sx2"), F.sum(x2 * x2).alias("sx4"))
    n = F.col("n")
    return g.select(
        *keys, F.coalesce(F.try_divide(F.col("sxy"), F.col("sx2")), F.lit(0.0)).alias("trend_slope"),
        F.try_divide(n * F.col("sx2y") - F.col("sx2") * F.col("sy"), n * F.col("sx4") - F.col("sx2") * F.col("sx2")).alias("trend_acceleration"))


def _chunked_sum(df: DataFrame, keys: list[str], step: Column, idx: str) -> tuple[DataFrame, list[str], W]:
    size = series_chunk(df.sparkSession)
    d = df.withColumn("__chunk", F.floor(F.col(idx) / size).cast("bigint")).withColumn("__x", step)
    parts = [*keys, "__chunk"]
    w = W.partitionBy(*parts).orderBy(idx).rowsBetween(W.unboundedPreceding, W.currentRow)
    return d.withColumn("__p", F.sum("__x").over(w)), parts, w


def _earlier(keys: list[str]):
    return W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)


def cusum_centered(samples: DataFrame, keys: list[str] = KEYS, value: str = "value", idx: str = "idx") -> DataFrame:
    """Largest and smallest prefix sum of x - mean."""
    mean = samples.groupBy(*keys).agg(F.avg(value).alias("__m"), (F.max(idx) + 1).alias("__n"))
    rows = samples.select(*keys, F.col(idx).alias("idx"), value)
    d, parts, _ = _chunked_sum(join_events(rows, mean, keys, hi=F.col("__n")), keys, F.col(value) - F.col("__m"), "idx")
    c = d.groupBy(*parts).agg(F.max("__p").alias("hi"), F.min("__p").alias("lo"), F.sum("__x").alias("t"))
    c = c.withColumn("o", F.coalesce(F.sum("t").over(_earlier(keys)), F.lit(0.0)))
    return c.groupBy(*keys).agg(F.max(F.col("hi") + F.col("o")).alias("cusum_max"), F.min(F.col("lo") + F.col("o")).alias("cusum_min"))


def _page_steps(samples: DataFrame, keys: list[str], value: str, baseline: int, idx: str) -> DataFrame:
    early = F.when(F.col(idx) < baseline, F.col(value))
    base = samples.groupBy(*keys).agg((F.avg(early) + F.stddev_pop(early) / 2).alias("__k"), (F.max(idx) + 1).alias("__n"))
    return join_events(samples, base, keys, hi=F.col("__n")).drop("__n")


def cusum_page(samples: DataFrame, keys: list[str] = KEYS, value: str = "value", baseline: int = 600, idx: str = "idx") -> DataFrame:
    """Largest one-sided change statistic: prefix sum minus its running minimum."""
    d = _page_steps(samples.select(*keys, idx, value), keys, value, baseline, idx)
    d, parts, w = _chunked_sum(d, keys, F.when(F.col(idx) == 0, 0.0).otherwise(F.col(value) - F.col("__k")), idx)
    d = d.withColumn("__m", F.least(F.lit(0.0), F.min("__p").over(w)))
    c = d.groupBy(*parts).agg(F.max(F.col("__p") - F.col("__m")).alias("rise"), F.max("__p").alias("hi"),
                              F.min("__p").alias("lo"), F.sum("__x").alias("t"))
    c = c.withColumn("o", F.coalesce(F.sum("t").over(_earlier(keys)), F.lit(0.0)))
    c = c.withColumn("before", F.least(F.lit(0.0), F.min(F.col("o") + F.col("lo")).over(_earlier(keys))))
    return c.groupBy(*keys).agg(F.max(F.greatest("rise", F.col("o") + F.col("hi") - F.col("before"))).alias("cusum_max"))


def page_path(samples: DataFrame, keys: list[str] = KEYS, value: str = "value", baseline: int = 600, idx: str = "idx") -> DataFrame:
    """The change statistic at every sample (column ``page``)."""
    d = _page_steps(samples, keys, value, baseline, idx)
    d, parts, w = _chunked_sum(d, keys, F.when(F.col(idx) == 0, 0.0).otherwise(F.col(value) - F.col("__k")), idx)
    d = d.withColumn("__m", F.min("__p").over(w))
    c = d.groupBy(*parts).agg(F.min("__p").alias("lo"), F.sum("__x").alias("t"))
    c = c.withColumn("o", F.coalesce(F.sum("t").over(_earlier(keys)), F.lit(0.0)))
    c = c.withColumn("before", F.least(F.lit(0.0), F.min(F.col("o") + F.col("lo")).over(_earlier(keys)))).drop("lo", "t")
    d = d.join(c, parts)
    return d.select(*samples.columns, (F.col("o") + F.col("__p") - F.least("before", F.col("o") + F.col("__m"))).alias("page"))


def early_late(window: DataFrame, early: Column, late: Column, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Difference, ratio and variance ratio between the end and the start of a window."""
    v = F.col(value)
    e, l = F.when(F.col("pos") < early, v), F.when(F.col("pos") >= late, v)
    g = window.groupBy(*keys).agg(
        F.avg(e).alias("me"), F.avg(l).alias("ml"), F.var_pop(e).alias("ve"), F.var_pop(l).alias("vl"), F.avg(F.abs(v)).alias("ma"))
    small = F.abs("me") <= 1e-6 * (F.col("ma") + 1e-12)
    return g.select(*keys, (F.col("ml") - F.col("me")).alias("early_late_diff"),
                    F.when(small, 0.0).otherwise(F.try_divide(F.col("ml"), F.col("me"))).alias("early_late_ratio"),
                    (F.col("vl") / (F.col("ve") + 1e-10)).alias("var_ratio_late_early"))


def window_features(window: DataFrame, early: Column, late: Column, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Trend, cumulative-sum and early/late features of a pre-trigger window from one shuffle.

    A window has a fixed duration, so one key is a bounded group and its running sum
    needs no chunks; the aggregation reuses the partitioning of the running sum.
    """
    part = W.partitionBy(*keys)
    v = F.col(value)
    d = window.withColumn("__e", v - F.avg(v).over(part))
    d = d.withColumn("__cs", F.sum("__e").over(part.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    x = F.col("pos") - (F.col("win_n") - 1) / 2
    x2 = x * x
    e, l = F.when(F.col("pos") < early, v), F.when(F.col("pos") >= late, v)
    g = d.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("sy"), F.sum(x * v).alias("sxy"), F.sum(x2 * v).alias("sx2y"), F.sum(x2).alias("sx2"), F.sum(x2 * x2).alias("sx4"),
        F.max("__cs").alias("cusum_max"), F.min("__cs").alias("cusum_min"),
        F.avg(e).alias("me"), F.avg(l).alias("ml"), F.var_pop(e).alias("ve"), F.var_pop(l).alias("vl"), F.avg(F.abs(v)).alias("ma"))
    n = F.col("n")
    return g.select(
        *keys, F.coalesce(F.try_divide(F.col("sxy"), F.col("sx2")), F.lit(0.0)).alias("trend_slope"),
        F.try_divide(n * F.col("sx2y") - F.col("sx2") * F.col("sy"), n * F.col("sx4") - F.col("sx2") * F.col("sx2")).alias("trend_acceleration"),
        "cusum_max", "cusum_min", (F.col("ml") - F.col("me")).alias("early_late_diff"),
        F.when(F.abs("me") <= 1e-6 * (F.col("ma") + 1e-12), 0.0).otherwise(F.try_divide(F.col("ml"), F.col("me"))).alias("early_late_ratio"),
        (F.col("vl") / (F.col("ve") + 1e-10)).alias("var_ratio_late_early"))


def pre_post_stats(samples: DataFrame, trigger: DataFrame, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """RMS, std and mean before and after the trigger, their change and the largest abs value after."""
    d = join_events(samples, trigger.select(*keys, "z", "n"), keys)
    pre, post = F.when(F.col("idx") < F.col("z"), F.col(value)), F.when(F.col("idx") >= F.col("z"), F.col(value))
    g = d.groupBy(*keys).agg(
        F.sqrt(F.avg(pre * pre)).alias("rms_pre"), F.stddev_pop(pre).alias("std_pre"), F.avg(pre).alias("mean_pre"),
        F.sqrt(F.avg(post * post)).alias("rms_post"), F.stddev_pop(post).alias("std_post"), F.avg(post).alias("mean_post"),
        F.coalesce(F.max(F.abs(post)), F.lit(0.0)).alias("max_abs_post"))
    return g.withColumn("change", F.coalesce(F.col("mean_post") - F.col("mean_pre"), F.lit(0.0)))


def settling(samples: DataFrame, trigger: DataFrame, first: int = 500, tail: int = 100, tol: float = 0.05,
             level: float = 95.0, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Largest early excursion after the trigger, samples until settled, share above a level.

    The final value is the median of the last ``tail`` samples, so each key's
    median sees at most ``tail`` values.
    """
    events = trigger.select(*keys, "z", "n")
    d = join_events(samples, events, keys)
    after = F.col("idx") - F.col("z")
    v = F.col(value)
    ends = d.filter(F.col("idx") >= F.greatest(F.col("z"), F.col("n") - tail)).groupBy(*keys).agg(F.percentile(v, 0.5).alias("__final"))
    thr = F.when(F.col("__final") != 0, F.abs("__final") * tol).otherwise(F.lit(tol))
    g = join_events(samples, events.join(ends, keys), keys).groupBy(*keys).agg(
        F.max(F.when((after >= 0) & (after < first), F.abs(v))).alias("max_excursion"),
        F.min(F.when((after >= 0) & (F.abs(v - F.col("__final")) < thr), after)).cast("double").alias("settle"),
        F.avg((F.abs(v) > level).cast("int")).alias("saturation_fraction"))
    return g.select(*keys, "max_excursion", F.coalesce("settle", F.lit(math.inf)).alias("settling_samples"), "saturation_fraction")


def unwrap_phase(samples: DataFrame, keys: list[str] = KEYS, value: str = "value", idx: str = "idx") -> DataFrame:
    """Remove jumps larger than pi (column ``phase``)."""
    d = neighbours(samples, keys, {"__prev": (value, -1)}, idx)
    step = F.col(value) - F.col("__prev")
    turn = F.lit(2 * math.pi)
    m = F.pmod(step + math.pi, turn) - math.pi
    m = F.when((m == -math.pi) & (step > 0), math.pi).otherwise(m)
    fix = F.when(F.abs(step) >= math.pi, m - step).otherwise(0.0)
    p = series_prefix(d, keys, F.coalesce(fix, F.lit(0.0)), "__fix", idx)
    return p.withColumn("phase", F.col(value) + F.col("__fix")).drop("__prev", "__fix")


def split_at_trigger(samples: DataFrame, trigger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Label rows pre or post and give each part its own position."""
    d = join_events(samples, trigger, keys)
    late = F.col("idx") >= F.col("z")
    return d.withColumn("part", F.when(late, "post").otherwise("pre")).withColumn(
        "pidx", F.when(late, F.col("idx") - F.col("z")).otherwise(F.col("idx")).cast("bigint"))


def detuning(samples: DataFrame, trigger: DataFrame, keys: list[str] = KEYS, value: str = "value", min_pre: int = 100) -> DataFrame:
    """Mean, spread, drift, range (Hz) of the pre-trigger phase and its jump at the trigger."""
    parts = [*keys, "part"]
    u = unwrap_phase(split_at_trigger(samples, trigger, keys), parts, value, "pidx")
    g = neighbours(u, parts, {"__a2": ("phase", -2), "__a1": ("phase", -1), "__b1": ("phase", 1), "__b2": ("phase", 2)}, "pidx")
    x, a1, a2, b1, b2 = (F.col(c) for c in ("phase", "__a1", "__a2", "__b1", "__b2"))
    v = F.when(a1.isNull(), b1 - x).when(b1.isNull(), x - a1).otherwise((b1 - a1) / 2)
    vb = F.when(a2.isNull(), x - a1).otherwise((x - a2) / 2)
    va = F.when(b2.isNull(), b1 - x).otherwise((b2 - x) / 2)
    acc = F.when(a1.isNull(), va - v).when(b1.isNull(), v - vb).otherwise((va - vb) / 2)
    two_pi = 2 * math.pi
    dt = F.col("dt_us") / 1e6
    early = F.col("part") == "pre"
    pre = lambda e: F.when(early, e)
    # both parts in one aggregate: all but the tenth sample after the trigger come from before it
    j = g.groupBy(*keys).agg(
        F.count(pre(F.lit(1))).alias("n_pre"), (F.regr_slope(pre(x), pre(F.col("pidx") * dt)) / two_pi).alias("mean_hz"),
        F.stddev_pop(pre(v / dt / two_pi)).alias("std_hz"), (F.avg(pre(acc / dt / dt)) / two_pi).alias("slope_hz_s"),
        ((F.max(pre(x)) - F.min(pre(x))) / two_pi).alias("peak_to_peak"), F.max_by(pre(x), pre(F.col("pidx"))).alias("__last"),
        F.max(F.when(~early & (F.col("pidx") == 10), x)).alias("__p10"))
    jump = F.coalesce((F.col("__p10") - F.col("__last")) / two_pi, F.lit(0.0))
    enough = F.col("n_pre") > min_pre
    cols = {"mean_hz": F.col("mean_hz"), "std_hz": F.col("std_hz"), "slope_hz_s": F.col("slope_hz_s"),
            "peak_to_peak": F.col("peak_to_peak"), "jump": jump}
    j = trigger.select(*keys).join(j, keys, "left")
    return j.select(*keys, *[F.when(enough, c).otherwise(0.0).alias(f"detuning_{n}") for n, c in cols.items()])


def phase_stability(samples: DataFrame, trigger: DataFrame, keys: list[str] = KEYS, value: str = "value", min_pre: int = 100) -> DataFrame:
    """Jitter, excursion, drift and spectral power of the pre-trigger phase.

    The one-sided power sum follows from Parseval: it needs the sum of squares, the
    plain sum and the alternating sum, so no transform is computed.
    """
    parts = [*keys, "part"]
    u = unwrap_phase(split_at_trigger(samples, trigger, keys).filter(F.col("part") == "pre"), parts, value, "pidx")
    v = F.col(value)
    t_s = F.col("pidx") * F.col("dt_us") / 1e6
    sign = F.when(F.col("pidx") % 2 == 0, 1.0).otherwise(-1.0)
    g = u.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(v).alias("jitter"), (F.max(v) - F.min(v)).alias("excursion"),
        F.regr_slope(F.col("phase"), t_s).alias("slope"), F.sum(v * v).alias("ss"), F.sum(v).alias("x0"), F.sum(sign * v).alias("xh"))
    n = F.col("n")
    half = F.when(n % 2 == 0, F.col("xh") * F.col("xh")).otherwise(0.0)
    psd = (n * F.col("ss") + F.col("x0") * F.col("x0") + half) / 2 / n
    g = g.select(*keys, "jitter", "excursion", F.when(n > min_pre, F.col("slope")).otherwise(0.0).alias("noise_slope"), psd.alias("psd_integral"))
    # a recording whose trigger is its first sample has nothing before it
    g = trigger.select(*keys).join(g, keys, "left")
    return g.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("jitter", "excursion", "noise_slope", "psd_integral")])


def pair_channels(samples: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """Two channels of one event side by side on idx (columns a and b)."""
    d = samples.filter(F.col("channel").isin(first, second))
    g = d.groupBy(*keys, "idx").agg(F.max(F.when(F.col("channel") == first, F.col("value"))).alias("a"),
                                    F.max(F.when(F.col("channel") == second, F.col("value"))).alias("b"))
    return g.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def power_balance(pairs: DataFrame, trigger: DataFrame, jump_ref: float = JUMP_SAMPLES, ref_dt: float = REFERENCE_DT_US,
                  keys: list[str] = KEYS, fwd: str = "a", refl: str = "b") -> DataFrame:
    """Mean forward and reflected power before the trigger, their ratio, jump and imbalance."""
    t = trigger.withColumn("__h", scale_samples(jump_ref, "dt_us", ref_dt))
    d = join_events(pairs, t, keys)
    p, q = F.col(fwd) * F.col(fwd), F.col(refl) * F.col(refl)
    i, z, h = F.col("idx"), F.col("z"), F.col("__h")
    g = d.groupBy(*keys).agg(
        F.avg(F.when(i < z, p)).alias("forward_mean"), F.avg(F.when(i < z, q)).alias("reflected_mean"),
        F.avg(F.when((i >= z - h) & (i < z), p)).alias("__pre"), F.avg(F.when((i >= z) & (i < z + h), p)).alias("__post"),
        F.coalesce(F.stddev_pop(F.when(i < z, p - q)), F.lit(0.0)).alias("imbalance"), F.max(F.col("n") > z + h).alias("__fits"))
    jump = F.abs(F.col("__post") - F.col("__pre")) / (F.col("__pre") + 1e-10)
    return g.select(*keys, "forward_mean", "reflected_mean", (F.col("reflected_mean") / (F.col("forward_mean") + 1e-10)).alias("reflection_ratio"),
                    F.when(F.col("__fits"), F.coalesce(jump, F.lit(0.0))).otherwise(0.0).alias("jump"), "imbalance")


def decay_fit(samples: DataFrame, trigger: DataFrame, n_ref: float = DECAY_SAMPLES, ref_dt: float = REFERENCE_DT_US,
              nominal: float = NOMINAL_TAU_S, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Exponential decay after the trigger: tau, rate, R2, tau over nominal, log residual and loaded Q."""
    w = post_window(samples, trigger, n_ref, ref_dt, keys).withColumn("y", F.abs(value))
    s = w.groupBy(*keys).agg(F.min("y").alias("__lo"), F.min_by("y", "pos").alias("__first"), F.max_by("y", "pos").alias("__end"))
    s = s.filter(F.col("__first") >= F.col("__end"))
    w = w.join(s, keys).withColumn("ln", F.log(F.col("y") - F.col("__lo") + 1e-10)).withColumn("t_s", F.col("pos") * F.col("dt_us") / 1e6)
    g = w.groupBy(*keys).agg(F.regr_slope("ln", "t_s").alias("b"), F.regr_r2("ln", "t_s").alias("r2"), F.var_pop("ln").alias("vy"))
    tau = F.try_divide(F.lit(-1.0), F.col("b"))
    r2 = F.when(F.col("vy") > 0, F.col("r2")).otherwise(0.0)
    g = g.select(*keys, tau.alias("tau"), F.when(tau > 0, F.try_divide(F.lit(1.0), tau)).alias("rate"), r2.alias("r2"), (tau / nominal).alias("relative"),
                 F.sqrt(F.greatest(F.lit(0.0), F.col("vy") * (1 - r2))).alias("residual"), (tau * math.pi * CARRIER_HZ).alias("loaded_q"))
    out = trigger.select(*keys).join(g, keys, "left")
    return out.withColumn("r2", F.coalesce("r2", F.lit(0.0)))


def validity_flags(samples: DataFrame, trigger: DataFrame, n_ref: float = MONOTONE_SAMPLES, ref_dt: float = REFERENCE_DT_US,
                   on_level: float = 1.0, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """rf_on from the mean level; valid_decay when over 60 % of the window falls."""
    t = trigger.withColumn("__w", scale_samples(n_ref, "dt_us", ref_dt))
    d = join_events(neighbours(samples.select(*keys, "idx", value), keys, {"__next": (value, 1)}), t, keys)
    i, z, w = F.col("idx"), F.col("z"), F.col("__w")
    falls = (i >= z) & (i < z + w - 1) & (F.abs("__next") < F.abs(value))
    g = d.groupBy(*keys).agg(F.avg(F.abs(value)).alias("level"), F.count_if(falls).alias("falls"), F.max(w).alias("w"), F.max(F.col("n") > z + w).alias("fits"))
    return g.select(*keys, (F.col("level") > on_level).cast("int").alias("rf_on"),
                    (F.col("fits") & (F.col("falls") > 0.6 * F.col("w"))).cast("int").alias("valid_decay"))


def numeric_metadata(df: DataFrame, key: str, header: str) -> DataFrame:
    """One feature ``meta_<k>`` for every header value that reads as a number."""
    d = df.select(key, F.explode(header).alias("k", "text")).withColumn("value", F.col("text").try_cast("double"))
    return d.filter(F.col("value").isNotNull()).select(key, F.concat(F.lit("meta_"), "k").alias("feature"), "value")


def sequences(samples: DataFrame, length: int = 4000, pre: int = 3000, step: int = 10, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Fixed-length arrays: full (cut or zero padded), pre-trigger part, every step-th sample."""
    d = samples.filter(F.col("idx") < length).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", value))), lambda s: s[value].cast("float")).alias("__v"))
    pad = F.array_repeat(F.lit(0.0).cast("float"), F.lit(length) - F.size("__v"))
    d = d.withColumn("full", F.concat("__v", pad)).drop("__v")
    return d.withColumn("pre", F.slice("full", 1, pre)).withColumn("coarse", F.filter("full", lambda x, i: i % step == 0))


def resample_linear(samples: DataFrame, lo: float, hi: float, points: int, keys: list[str] = KEYS,
                    t: str = "t_us", value: str = "value") -> DataFrame:
    """Linear interpolation onto a regular grid; NULL outside the recorded span.

    Each interval between two samples emits the grid points inside it, so the
    as-of match needs no join.
    """
    step = (hi - lo) / (points - 1)
    d = neighbours(samples.select(*keys, "idx", t, value), keys, {"__t1": (t, 1), "__v1": (value, 1), "__t2": (t, 2)})
    t0, t1 = F.col(t), F.col("__t1")
    k0 = F.greatest(F.lit(0), F.ceil((t0 - lo) / step)).cast("int")
    end = F.when(F.col("__t2").isNull(), F.floor((t1 - lo) / step)).otherwise(F.ceil((t1 - lo) / step) - 1)
    k1 = F.least(F.lit(points - 1), end).cast("int")
    hit = d.filter((t1 > t0) & (k1 >= k0)).withColumn("k", F.explode(F.sequence(k0, k1)))
    grid_t = F.lit(lo) + F.col("k") * F.lit(step)
    v = F.col(value) + (F.col("__v1") - F.col(value)) * (grid_t - t0) / (t1 - t0)
    got = hit.select(*keys, F.col("k"), v.alias("v"))
    per = got.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    per = samples.select(*keys).distinct().join(per, keys, "left")
    vals = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.try_element_at("m", i))
    return per.select(*keys, F.posexplode(vals).alias("k", "value"))


def ensemble_mean_band(traces: DataFrame, category: str) -> DataFrame:
    """Mean and spread per grid point, hidden where too few recordings contribute."""
    g = traces.groupBy(category, "k").agg(F.count(F.lit(1)).alias("n_loaded"), F.count("value").alias("coverage"),
                                          F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    enough = F.col("coverage") >= F.greatest(F.lit(3), F.bround(F.col("n_loaded") * 0.3, 0).cast("int"))
    return g.select(category, "k", "coverage", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.col("std")).alias("std"))


def fixed_window(samples: DataFrame, meta: DataFrame, pre: int = 3000, post: int = 1000, keys: list[str] = KEYS) -> DataFrame:
    """Sample-count window around ``postrow``, clipped to [0, nrow)."""
    lo, hi = F.greatest(F.lit(0), F.col("postrow") - pre), F.least(F.col("nrow"), F.col("postrow") + post)
    d = join_events(samples, meta, keys, lo, hi)
    return d.filter((F.col("idx") >= lo) & (F.col("idx") < hi)).withColumn("pos", F.col("idx") - lo)


def sample_step_us(ndec: Column | str) -> Column:
    """Sampling step in microseconds of a decimation factor."""
    return F.lit(4.0) * (F.col(ndec) if isinstance(ndec, str) else ndec) / F.lit(70.442)


def clean_value(v: Column | str) -> Column:
    """NaN, NULL and exact zero become 1e-10; infinities become +-1e10."""
    v = F.col(v) if isinstance(v, str) else v
    return (F.when(v.isNull() | F.isnan(v) | (v == 0), 1e-10).when(v == math.inf, 1e10).when(v == -math.inf, -1e10).otherwise(v))


def clean_series(samples: DataFrame, channels: list[str], event: str) -> DataFrame:
    """Cleaned samples with a constant 1e-10 series for each absent channel.

    One pass: samples of an (event, idx) cell become a map over channels, which is
    then read for the full channel list.
    """
    g = samples.filter(F.col("channel").isin(channels)).groupBy(event, "idx").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "value"))).alias("m"))
    names = F.array(*[F.lit(c) for c in channels])
    d = g.select(event, "idx", "m", F.explode(names).alias("channel"))
    return d.select(event, "channel", "idx", clean_value(F.try_element_at("m", F.col("channel"))).alias("value"))


def normalisation_check(samples: DataFrame, channel: str, z: str = "z") -> DataFrame:
    """Largest deviation of per-channel mean from 0 and of std from 1."""
    g = samples.groupBy(channel).agg(F.avg(z).alias("m"), F.stddev_pop(z).alias("s"))
    return g.agg(F.count(F.lit(1)).alias("n_channels"), F.max(F.abs("m")).alias("max_mean_dev"), F.max(F.abs(F.col("s") - 1)).alias("max_std_dev"))


def modulation_features(pairs: DataFrame, keys: list[str] = KEYS, a: str = "a", b: str = "b", phase: str = "phase") -> DataFrame:
    """Modulation depth, phase range, forward over reflected ratio, error statistics and phase drift."""
    d = gradients(pairs, keys, phase)
    x, y = F.abs(a), F.abs(b)
    err = F.col(b) - F.col(a)
    g = d.groupBy(*keys).agg(
        (F.try_divide(F.max(x) - F.min(x), F.avg(x)) * 100).alias("amplitude_mod_depth"),
        (F.max(phase) - F.min(phase)).alias("phase_mod_depth"), F.try_divide(F.avg(x), F.avg(y)).alias("forward_reflected_ratio"),
        F.avg(x).alias("cavity_gradient"), F.avg(err).alias("error_mean"), F.stddev_pop(err).alias("error_std"),
        F.max(F.abs(err)).alias("error_max"), (F.avg("grad") * CARRIER_HZ / (2 * math.pi)).alias("detuning_hz"))
    g = g.withColumn("detuning_bandwidth", F.col("detuning_hz") / CARRIER_HZ)
    return g.fillna(0.0, ["amplitude_mod_depth", "forward_reflected_ratio"])


def to_long(wide: DataFrame, keys: list[str], prefix: Column | None = None) -> DataFrame:
    """One row per (key, feature); ragged features simply have no row."""
    cols = [c for c in wide.columns if c not in keys]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("value")) for c in cols])).alias("p")
    d = wide.select(*keys, pairs)
    name = F.col("p.f") if prefix is None else F.concat(prefix, F.lit("_"), F.col("p.f"))
    return d.select(*keys, name.alias("feature"), F.col("p.value").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
