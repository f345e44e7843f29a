"""Operators that the method documents propose."""

from __future__ import annotations

import numpy as np
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import ratio, safe_corr, stable_hash
from ..functions.ordering import agg_with_quantiles, join_on, neighbours, rolling, with_position, with_running
from .neighbours import knn
from .series import join_events, page_path


def zscore_outliers(df: DataFrame, cols: list[str], limit: float = 3.0) -> DataFrame:
    """Flag rows where any column is more than ``limit`` deviations from its mean."""
    s = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    z = [F.coalesce(F.abs(ratio(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}"))), F.lit(0.0)) for c in cols]
    return df.join(s).withColumn("outlier", F.exists(F.array(*z), lambda v: v > limit).cast("int")).select(*df.columns, "outlier")  # one-row stats


def onset_times(samples: DataFrame, event: str, threshold: float, baseline: int = 600, value: str = "value") -> DataFrame:
    """First sample per channel where the change statistic exceeds ``threshold``; the earliest channel is the root."""
    keys = [event, "channel"]
    p = page_path(samples, keys, value, baseline)
    first = p.filter(F.col("page") > threshold).groupBy(*keys).agg(F.min_by("t_us", "idx").alias("onset_us"))
    root = first.groupBy(event).agg(F.min_by("channel", F.struct("onset_us", "channel")).alias("root_channel"))
    return first.join(root, event)


def fault_timeline(df: DataFrame, ts: str, fault: str, faults: list[str]) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).pivot(fault, faults).agg(F.count(F.lit(1))).fillna(0)


def hours_between(df: DataFrame, device: str, us: str, tie: str) -> DataFrame:
    """Hours from each fault to the next one on the same device."""
    d = with_position(df.select(device, us, tie), [device], [us, tie], "idx")
    n = neighbours(d, [device], {"__prev": (us, -1)})
    return n.filter(F.col("__prev").isNotNull()).select(device, tie, ((F.col(us) - F.col("__prev")) / 3.6e9).alias("hours"))


def device_fault_counts(df: DataFrame, device: str, fault: str, faults: list[str]) -> DataFrame:
    return df.groupBy(device).pivot(fault, faults).agg(F.count(F.lit(1))).fillna(0)


def t_statistic(df: DataFrame, value: str, label: str) -> DataFrame:
    """Two-sample t statistic with pooled variance."""
    a, b = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    g = df.agg(F.count(a).alias("n1"), F.count(b).alias("n0"), F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    t = ratio(F.col("m1") - F.col("m0"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0"))))
    return g.select("n1", "n0", "m1", "m0", t.alias("t"), (F.col("n1") + F.col("n0") - 2).alias("df"))


def association_rules(df: DataFrame, conditions: list[str], support: float = 0.1, confidence: float = 0.7) -> DataFrame:
    """Rules between boolean conditions."""
    items = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in conditions]), lambda x: x.isNotNull())
    m = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(df.select(items.alias("items")))
    return m.associationRules.select(F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "confidence", "support")


def kaplan_meier(df: DataFrame, duration: str, observed: str) -> DataFrame:
    """Survival estimate at each event time."""
    g = df.groupBy(F.col(duration).cast("double").alias("t")).agg(F.count_if(F.col(observed) == 1).alias("d"), F.count(F.lit(1)).alias("c"))
    n = g.agg(F.sum("c").alias("n")).scalar()
    r = with_running(g, [], ["t"], {"gone": F.col("c")})
    at_risk = r.withColumn("at_risk", n - F.col("gone") + F.col("c"))
    # the factor 0 at a final death ends the product; its log is kept out of the sum
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)
    zero = F.when(F.col("d") == F.col("at_risk"), 1).otherwise(0)
    s = with_running(at_risk, [], ["t"], {"ls": step, "ended": zero})
    return s.filter("d > 0").select("t", "at_risk", "d", F.when(F.col("ended") > 0, 0.0).otherwise(F.exp("ls")).alias("survival"))


def lagged_correlation(pairs: DataFrame, lags: list[int], keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Correlation of a with b shifted by each lag, and the lag with the largest absolute value."""
    d = neighbours(pairs, keys, {f"__b{l}": (b, l) for l in lags if l}).withColumn("__b0", F.col(b))
    g = d.groupBy(*keys).agg(*[safe_corr(F.col(a), F.col(f"__b{l}")).alias(f"r{l}") for l in lags])
    long = g.select(*keys, F.explode(F.array(*[F.struct(F.lit(l).alias("lag"), F.col(f"r{l}").alias("r")) for l in lags])).alias("p")).select(*keys, "p.lag", "p.r")
    best = long.filter(F.col("r").isNotNull()).groupBy(*keys).agg(F.max_by("lag", F.struct(F.abs("r"), -F.col("lag"))).alias("best_lag"))
    return long.join(best, keys)


def clip_symmetric(df: DataFrame, value: str, by: list[str], p: float = 0.999) -> DataFrame:
    q = agg_with_quantiles(df, by, [], {"__u": (value, p)})
    return join_on(df, q, by).withColumn(value, F.greatest(-F.col("__u"), F.least(F.col("__u"), F.col(value)))).drop("__u")


def moving_average(samples: DataFrame, window: int, keys: list[str], value: str = "value", idx: str = "idx") -> DataFrame:
    """Centred mean of ``window`` samples; NULL where the window is not complete."""
    before, after = window // 2, window - window // 2 - 1
    d = rolling(samples, keys, {"__sum": F.sum(value), "__n": F.count(value)}, before, after, idx)
    return d.withColumn("smooth", F.when(F.col("__n") == window, F.col("__sum") / window)).drop("__sum", "__n")


def propagation(samples: DataFrame, trigger: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Samples until below half the first post-trigger value, drop rate, recovery slope, pre/post contrast."""
    events = trigger.select(*keys, "z", "n")
    v, pos = F.col(value), F.col("idx") - F.col("z")
    first = join_events(samples, events, keys, F.col("z"), F.col("z") + 1).filter(pos == 0).select(*keys, v.alias("__v0"))
    post, pre = F.when(pos >= 0, v), F.when(pos < 0, v)
    g = join_events(samples, events.join(first, keys), keys).groupBy(*keys).agg(
        F.min(F.when((pos >= 0) & (v < 0.5 * F.col("__v0")), pos)).alias("drop_n"), F.max("__v0").alias("v0"), F.min(post).alias("lo"),
        F.regr_slope(post, pos).alias("recovery_slope"), ratio(F.avg(post), F.avg(pre)).alias("ratio_mean"), (F.var_pop(post) - F.var_pop(pre)).alias("diff_variance"))
    return g.select(*keys, "drop_n", ratio(F.col("v0") - F.col("lo"), F.col("drop_n")).alias("drop_rate"), "recovery_slope", "ratio_mean", "diff_variance")


def granger(pairs: DataFrame, p: int, q: int, a: str = "a", b: str = "b", keys: list[str] | None = None) -> DataFrame:
    """F statistic of adding q lags of b to an autoregression of a with p lags, pooled over the series.

    Only the cross-product matrix of the lagged columns leaves the executors.
    """
    keys = keys or ["series_id"]
    wanted = {f"__a{i}": (a, -i) for i in range(1, p + 1)} | {f"__b{i}": (b, -i) for i in range(1, q + 1)}
    d = neighbours(pairs.select(*keys, "idx", a, b), keys, wanted).dropna()
    cols = ["__one", *wanted]
    d = d.withColumn("__one", F.lit(1.0))
    n = len(cols)
    names = [*cols, a]
    row = d.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i in range(n + 1) for j in range(i, n + 1)]).first()
    m = np.zeros((n + 1, n + 1))
    it = iter(row)
    for i in range(n + 1):
        for j in range(i, n + 1):
            m[i, j] = m[j, i] = next(it)

    def rss(k: int) -> float:
        beta = np.linalg.solve(m[:k, :k], m[:k, n])
        return float(m[n, n] - beta @ m[:k, n])

    total = m[0, 0]
    r, u = rss(1 + p), rss(1 + p + q)
    f = ((r - u) / q) / (u / (total - p - q - 1))
    return pairs.sparkSession.createDataFrame([(int(total), float(r), float(u), float(f))], "n bigint, rss_restricted double, rss_full double, f double")


def variance_threshold(long: DataFrame, minimum: float = 0.01) -> DataFrame:
    return long.groupBy("feature").agg(F.var_pop("value").alias("variance")).filter(F.col("variance") >= minimum)


def l1_selection(df: DataFrame, cols: list[str], label: str, reg: float = 0.01) -> DataFrame:
    """Features with a non-zero lasso coefficient."""
    from pyspark.ml.regression import LinearRegression

    from .matrix import to_vector

    m = LinearRegression(featuresCol="__x", labelCol=label, elasticNetParam=1.0, regParam=reg).fit(to_vector(df, cols, "__x"))
    rows = [(c, float(w)) for c, w in zip(cols, m.coefficients.toArray()) if w != 0.0]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def centre_distance(df: DataFrame, centres: DataFrame, id_: str = "vec_id", vec: str = "x", pct: float = 0.9) -> DataFrame:
    """Distance to the nearest centre of normal operation; flag above a percentile."""
    d = knn(df, centres, 1, id_, vec).select("id", F.col("nid").alias("centre"), F.col("dist").alias("score"))
    cut = agg_with_quantiles(d.select("score"), [], [], {"c": ("score", pct)}).scalar()
    return d.withColumn("flag", (F.col("score") > cut).cast("int"))


def calibrate(samples: DataFrame, coefficients: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Multiply by the coefficient of the device type; unknown types keep their value."""
    return samples.join(coefficients, on, "left").withColumn(value, F.col(value) * F.coalesce("coef", F.lit(1.0))).drop("coef")


def smote(df: DataFrame, label: str, minority, per_row: int, k: int = 5, id_: str = "vec_id", vec: str = "x", seed: int = 42) -> DataFrame:
    """Synthetic minority rows between a row and one of its neighbours, at a hashed distance."""
    m = df.filter(F.col(label) == minority)
    e = knn(m, m, k, id_, vec, exclude_self=True)
    c = e.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    n = e.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    c = c.join(n, "id").filter(F.col("rank") == F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.col("__n")) + 1)
    u = F.pmod(F.xxhash64("nid", "copy", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    own, other = m.select(F.col(id_).alias("id"), F.col(vec).alias("__a")), m.select(F.col(id_).alias("nid"), F.col(vec).alias("__b"))
    j = c.withColumn("__u", u).join(own, "id").join(other, "nid")
    x = F.transform(F.arrays_zip("__a", "__b"), lambda p: p["__a"] + F.col("__u") * (p["__b"] - p["__a"]))
    return j.select("id", "copy", "nid", F.col("__u").alias("u"), x.alias("x"))


def undersample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, in md5 order."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m")).scalar()
    d = with_position(df.withColumn("__h", stable_hash(key, seed)), [label], ["__h", key], "__r")
    return d.filter(F.col("__r") < n).drop("__h", "__r")


def fbeta(counts: DataFrame, beta: float) -> DataFrame:
    """Support-weighted F-beta from per-label counts."""
    b2 = beta * beta
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f = F.coalesce(ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp), F.lit(0.0))
    return counts.agg(ratio(F.sum(f * (tp + fn)), F.sum(tp + fn)).alias("f_beta"))


def time_folds(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Expanding folds in time order: fold i trains on parts 0..i and tests on part i + 1."""
    d = with_position(df, [], order, "pos")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.floor(n / (k + 1))
    # equal test parts at the end; the remainder belongs to the first training part
    back = n - F.lit(k) * size
    part = F.when(F.col("pos") < back, 0).otherwise(F.floor((F.col("pos") - back) / size) + 1)
    return d.withColumn("part", part.cast("int"))


def conformal_sets(calibration: DataFrame, test: DataFrame, classes: list[str], true: str, significance: float = 0.05) -> DataFrame:
    """Split conformal sets: classes whose 1 - p does not exceed the calibrated quantile."""
    p_true = F.element_at(F.create_map(*[x for c in classes for x in (F.lit(c), F.col(f"p_{c}"))]), F.col(true))
    cal = calibration.select((1 - p_true).alias("s"))
    cut = agg_with_quantiles(cal, [], [], {"c": ("s", 1.0 - significance)}).scalar()
    sets = F.array_compact(F.array(*[F.when(1 - F.col(f"p_{c}") <= F.col("__cut"), F.lit(c)) for c in classes]))
    return test.withColumn("__cut", cut).withColumn("prediction_set", sets).drop("__cut")
