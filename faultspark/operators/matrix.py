"""Feature-matrix operators: pivot, imputation, correlation, scaling, PCA, profiles."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import percent
from ..functions.ordering import agg_with_quantiles, join_on

# Endings of features that only look at the window before the trigger.
PRECURSOR_SUFFIXES = ["_trend_slope", "_trend_acceleration", "_cusum_max", "_cusum_min",
                      "_early_late_diff", "_early_late_ratio", "_var_ratio_late_early"]

# Names, prefixes and endings that place a feature in a family.
FAMILY_EXACT = {
    "Effective Decay": ["effective_decay_tau", "decay_rate", "decay_fit_r2", "decay_non_exponentiality",
                        "decay_relative_to_nominal", "valid_decay_window"],
    "RF Mismatch": ["rf_mismatch_rms_pre", "rf_mismatch_rms_post", "rf_mismatch_max_excursion", "rf_mismatch_settling_time",
                    "control_settling_time", "reflected_saturation_fraction", "control_saturation_fraction",
                    "phase_std_pre", "phase_std_post"],
    "Phase Stability": ["phase_jitter_rms", "phase_noise_slope", "phase_excursion_pp", "phase_psd_integral"],
    "RF Power Flow": ["forward_power_mean", "reflected_power_mean", "power_imbalance_rms", "power_jump_at_trigger",
                      "power_reflection_ratio"],
    "Metadata/Status": ["beam_present", "feed_forward_enabled", "llrf_loop_closed", "rf_drive_on"],
}
FAMILY_PREFIX = {"detuning_": "Detuning", "microphonics_": "Microphonics", "mod_amplitude_": "Modulator Command",
                 "mod_phase_": "Modulator Command", "meta_": "Metadata/Status"}
TEMPORAL_SUFFIXES = PRECURSOR_SUFFIXES + ["_velocity_mean", "_velocity_std", "_velocity_max", "_accel_mean", "_accel_std", "_accel_max"]
STATISTICAL_SUFFIXES = ["_mean", "_std", "_skewness", "_kurtosis", "_min", "_max", "_range", "_median", "_q1", "_q3", "_iqr",
                        "_rms", "_crest_factor", "_peak_count", "_energy", "_zero_crossings", "_autocorr_lag1"]
SEGMENT_PATTERN = "_segment_(early|mid_early|mid|mid_late|late)_(mean|std|slope)$"
HUGE = 1e10


def pivot_features(long: DataFrame, key: str, features: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    return long.groupBy(key).pivot(feature, features).agg(F.first(value, ignorenulls=True))


def unpivot(wide: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return wide.unpivot(keys, cols, "feature", "value")


def finite(v: Column, fill: float = 0.0) -> Column:
    """NaN and NULL become ``fill``; infinities become +-1e10."""
    return (F.when(v.isNull() | F.isnan(v), fill).when(v == float("inf"), HUGE).when(v == float("-inf"), -HUGE).otherwise(v))


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinite and missing values take the column median, or 0 for an empty column."""
    known = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in cols})
    med = agg_with_quantiles(known.select(*cols), [], [], {f"__m_{c}": (c, 0.5) for c in cols})
    j = known.join(med)  # one-row table
    return j.select(*[F.coalesce(c, f"__m_{c}", F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def to_vector(df: DataFrame, cols: list[str], name: str = "x") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r of every ordered pair as rows (i, j, r); NULL with a constant column.

    MLlib sums one p x p matrix over the partitions; only that matrix reaches the driver.
    """
    spark = df.sparkSession
    m = Correlation.corr(to_vector(df.select(*cols), cols).select("x"), "x").first()[0].toArray()
    p = len(cols)
    # a constant column has no correlation with anything, itself included
    constant = [p > 1 and all(m[i, j] != m[i, j] for j in range(p) if j != i) for i in range(p)]
    rows = [(i, j, cols[i], cols[j], None if m[i, j] != m[i, j] or constant[i] else float(m[i, j])) for i in range(p) for j in range(p)]
    return spark.createDataFrame(rows, "i int, j int, feature_i string, feature_j string, r double")


def correlation_filter(corr: DataFrame, names: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Drop every unprotected feature that follows a feature it is correlated with.

    ``names`` has feature and protected. The rule looks at the column order only: a
    dropped feature still drops later ones, and NULL correlations never do.
    """
    hit = corr.filter((F.col("i") < F.col("j")) & (F.abs("r") > threshold)).select(F.col("feature_j").alias("feature")).distinct()
    drop = hit.join(names.filter(~F.col("protected")), "feature", "left_semi")
    return names.join(drop, "feature", "left_anti")


def is_precursor(name: Column | str) -> Column:
    pattern = "(" + "|".join(PRECURSOR_SUFFIXES) + ")$|_segment_"
    return (F.col(name) if isinstance(name, str) else name).rlike(pattern)


def select_precursor_columns(names: DataFrame) -> DataFrame:
    return names.filter(is_precursor("feature")).distinct().orderBy("feature")


def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column; a constant column gets scale 1."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] else 1.0) for c in cols}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def standardize(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(train, cols))


def standardize_long(train: DataFrame, df: DataFrame) -> DataFrame:
    """The same on (event, feature, value) rows, for matrices too wide for columns."""
    s = train.groupBy("feature").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    j = df.join(s, "feature")
    return j.withColumn("value", (F.col("value") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")


def array_moments(df: DataFrame, vec: str = "x"):
    """Mean and population std of each position of an array column: one number per feature."""
    import numpy as np

    v = df.select(array_to_vector(vec).alias("v"))
    n, s = v.agg(F.count(F.lit(1)), Summarizer.metrics("mean", "variance").summary(F.col("v"))).first()
    return s["mean"].toArray(), np.sqrt(s["variance"].toArray() * (n - 1) / n)


def standardize_arrays(train: DataFrame, df: DataFrame, vec: str = "x") -> DataFrame:
    """The same for one array column."""
    mean, std = array_moments(train, vec)
    centre = F.array(*[F.lit(float(m)) for m in mean])
    scale = F.array(*[F.lit(float(s) if s > 0 else 1.0) for s in std])
    return df.withColumn(vec, F.zip_with(F.arrays_zip(F.col(vec).alias("v"), centre.alias("m")), scale, lambda a, s: (a["v"] - a["m"]) / s))


class PcaModel:
    """Principal directions with the sign fixed by the largest loading."""

    def __init__(self, components, ratios, mean):
        self.components, self.ratios, self.mean = components, ratios, mean

    @property
    def k(self) -> int:
        return self.components.shape[1]

    def transform(self, df: DataFrame, vec: str = "x", out: str = "pc") -> DataFrame:
        rows = [F.array(*[F.lit(float(v)) for v in self.components[:, j]]) for j in range(self.k)]
        shift = [float(self.components[:, j] @ self.mean) for j in range(self.k)]
        dot = [F.aggregate(F.zip_with(vec, r, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - F.lit(s) for r, s in zip(rows, shift)]
        return df.withColumn(out, F.array(*dot))

    def project(self, df: DataFrame, vec: str = "x", out: str = "pc", reconstruct: str | None = None) -> DataFrame:
        """Batch matrix product in Arrow batches; adds the scores and, if asked, the reconstruction."""
        import numpy as np
        import pyarrow as pa

        comp, mean = self.components, self.mean
        schema = df.select("*", F.array(F.lit(0.0)).alias(out)).schema
        if reconstruct:
            schema = df.select("*", F.array(F.lit(0.0)).alias(out), F.array(F.lit(0.0)).alias(reconstruct)).schema

        def lists(m):
            off = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(m).ravel()))

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(vec).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                s = (x - mean) @ comp
                arrays, names = list(b.columns) + [lists(s)], list(b.schema.names) + [out]
                if reconstruct:
                    arrays.append(lists(s @ comp.T + mean))
                    names.append(reconstruct)
                yield pa.RecordBatch.from_arrays(arrays, names)

        return df.mapInArrow(run, schema)


def pca(train: DataFrame, vec: str = "x", variance: float | None = 0.95, k: int | None = None) -> PcaModel:
    """Smallest number of directions reaching ``variance``, or a fixed ``k``; fit on ``train`` only."""
    import numpy as np

    p = train.select(F.size(vec)).first()[0]
    v = train.select(array_to_vector(vec).alias("v"))
    model = PCA(k=p, inputCol="v", outputCol="o").fit(v)
    comp, ratios = model.pc.toArray(), model.explainedVariance.toArray()
    lead = comp[np.abs(comp).argmax(axis=0), np.arange(p)]
    comp = comp * np.where(lead < 0, -1.0, 1.0)
    mean, _ = array_moments(train, vec)
    if k is None:
        k = int(np.searchsorted(np.cumsum(ratios), variance - 1e-12) + 1)
    k = min(k, p)
    return PcaModel(comp[:, :k], ratios[:k], mean)


def components_for_variance(ratios: DataFrame, thresholds: list[float]) -> DataFrame:
    """First component count whose cumulative share reaches each threshold, else all of them.

    ``ratios`` (component, ratio) has one row per feature at most.
    """
    w = W.orderBy("component").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = ratios.withColumn("cum", F.sum("ratio").over(w))
    t = c.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return t.groupBy("threshold").agg(F.coalesce(F.min(F.when(F.col("cum") >= F.col("threshold"), F.col("component"))), F.max("component")).alias("n_components"))


def feature_profile(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("variance"),
        percent(F.count_if(F.col("value") == 0), F.count("value")).alias("pct_zero"))


def profile_summary(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.count_if(F.col("variance") > 1.5).alias("n_high_variance"), F.count_if(F.col("variance") < 0.1).alias("n_low_variance"),
        F.count_if(F.col("pct_zero") > 50).alias("n_sparse"), F.count_if(F.abs("mean") < 0.01).alias("n_zero_mean"),
        F.count_if(F.col("std") < 1e-6).alias("n_constant"))


def class_mean_difference(long: DataFrame, label: str, k: int) -> DataFrame:
    """Features ranked by the absolute difference of their class means."""
    g = long.groupBy("feature").agg(F.abs(F.avg(F.when(F.col(label) == 1, F.col("value"))) - F.avg(F.when(F.col(label) == 0, F.col("value")))).alias("diff"))
    g = g.filter(F.col("diff").isNotNull())
    rank = F.row_number().over(W.orderBy(F.desc("diff"), "feature"))  # one row per feature
    return g.withColumn("rank", rank).filter(F.col("rank") <= k)


def winsorize(df: DataFrame, cols: list[str], by: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Clip each column to its interpolated quantiles inside each group."""
    q = agg_with_quantiles(df, by, [], {f"__{t}_{c}": (c, p) for c in cols for t, p in (("lo", lo), ("hi", hi))})
    j = join_on(df, q, by)
    return j.select(*[F.least(F.greatest(F.col(c), F.col(f"__lo_{c}")), F.col(f"__hi_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def feature_family(name: Column | str) -> Column:
    """Family by exact name, then prefix, segment form, temporal ending, statistical ending."""
    n = F.col(name) if isinstance(name, str) else name
    c = F.when(F.lit(False), "")
    for family, names in FAMILY_EXACT.items():
        c = c.when(n.isin(names), family)
    for prefix, family in FAMILY_PREFIX.items():
        c = c.when(n.startswith(prefix), family)
    c = c.when(n.rlike(SEGMENT_PATTERN), "Temporal")
    c = c.when(n.rlike("(" + "|".join(TEMPORAL_SUFFIXES) + ")$"), "Temporal")
    c = c.when(n.rlike("(" + "|".join(STATISTICAL_SUFFIXES) + ")$"), "Statistical")
    return c.otherwise("Other")


def exclude_channels(names: DataFrame, channels: list[str]) -> DataFrame:
    """Drop features that are a channel or start with ``channel_``."""
    keep = F.lit(True)
    for ch in channels:
        keep = keep & ~((F.col("feature") == ch) | F.col("feature").startswith(f"{ch}_"))
    return names.filter(keep)


def add_alias(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Copy columns under further names unless the name is already taken."""
    new = {a: F.col(c) for a, c in aliases.items() if a not in df.columns and c in df.columns}
    return df.withColumns(new) if new else df
