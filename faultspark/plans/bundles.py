"""Queries that train a model, keep it in the shared folder, and score with the loaded copy."""

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..functions.iterate import shared_folder
from ..operators import bundles as B, probes as P, series as S
from ..streaming import streams as N
from .probes import N_WIN
from .registry import query
from .series import rounded
from .seriesdata import REF_DT, samples
from .streams import events

COLUMNS = ["trend_slope", "trend_acceleration", "cusum_max", "cusum_min", "early_late_diff", "early_late_ratio", "var_ratio_late_early"]


def probes(t):
    """Window features at all offsets, with a label: a mean of the later half above that of the first."""
    s = samples(t)
    trigger = S.find_trigger(s)
    d = P.offset_probe(s, trigger, N_WIN, 2, 4, REF_DT)
    after = S.pre_post_stats(s, trigger).select("series_id", (F.col("change") > 0).cast("int").alias("y"))
    return s, trigger, d.join(after, "series_id").withColumnsRenamed({c: f"value_{c}" for c in COLUMNS})


NAMED = [f"value_{c}" for c in COLUMNS]


def saved(t, d, estimator=None):
    """A bundle of the windows at the trigger, as another session would read it."""
    path = shared_folder(t.spark, "bundle")
    fitted = B.fit_bundle(d.filter("mult = 0 AND series_id % 3 <> 0"), NAMED, "y", estimator)
    B.save_bundle(fitted, path, t.spark)
    return fitted, B.load_bundle(t.spark.newSession(), path)


@query("model_bundle", "A9")
def _(t):
    _, _, d = probes(t)
    fitted, loaded = saved(t, d)
    a = fitted.score(d.filter("mult = 0")).select("series_id", F.col("score").alias("fitted"))
    b = loaded.score(d.filter("mult = 0")).select("series_id", "y", "y_pred", "score")
    return b.join(a, "series_id").select("series_id", "y", "y_pred", rnd("score").alias("score"), (F.abs(F.col("score") - F.col("fitted")) <= 1e-12).alias("same"))


@query("probability_curve_trained", "L3")
def _(t):
    _, trigger, d = probes(t)
    c = B.bundle_curve(saved(t, d)[1], d, trigger, "series_id", N_WIN, REF_DT)
    return c.select("series_id", "mult", rnd("offset_ms", 2).alias("offset_ms"), rnd("proba").alias("proba"))


@query("lead_time_trained", "L2")
def _(t):
    _, trigger, d = probes(t)
    m = saved(t, d)[1]
    hit = m.score(d.filter("mult = 0 AND series_id % 3 = 0")).filter("y = 1 AND y_pred = 1").select("series_id")
    return rounded(P.lead_time(B.bundle_curve(m, d.join(hit, "series_id"), trigger, "series_id", N_WIN, REF_DT), "series_id"))


@query("midwindow_probe_trained", "L4")
def _(t):
    s, trigger, d = probes(t)
    plain = saved(t, d)[1]
    bundle = B.Bundle(COLUMNS, plain.label, plain.threshold, plain.model)  # the same features by their plain names
    g = B.bundle_midwindow(bundle, s, trigger, N_WIN, 2, 4, REF_DT)
    return g.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y_pred"), F.lit(0)).alias("n_flagged"), rnd(F.avg("y_pred")).alias("share"))


def row_bundle(t):
    """A logistic model of single events: their value and hour, for purchases against the rest."""
    e = t.events.filter("value IS NOT NULL AND ts IS NOT NULL").select("value", F.hour("ts").alias("hour"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    path = shared_folder(t.spark, "bundle")
    B.save_bundle(B.fit_bundle(e, ["value", "hour"], "y", LogisticRegression(maxIter=100), threshold=0.2), path, t.spark)
    return B.load_bundle(t.spark.newSession(), path)


def alerts(d, bundle):
    gate = (F.col("value") >= 0.1) & (F.col("event_type") != "view")
    return N.stream_score_alert(d.withColumn("hour", F.hour("ts")), gate, bundle.score, bundle.threshold)


@query("stream_score_alert_trained", "N1")
def _(t):
    return rounded(N.drain(alerts(events(t), row_bundle(t)).select("event_id", "user_id", "score")))


@query("bundle_throughput", "L8")
def _(t):
    _, _, d = probes(t)
    return P.throughput_benchmark(d.select("series_id", *NAMED), saved(t, d)[1].score).select("n_timed", "mean_ms", "median_ms", "p95_ms", "max_ms", "rows_per_s")


@query("pretrigger_comparison", "G10")
def _(t):
    s, trigger, d = probes(t)
    stats = S.series_stats(s).select("series_id", *[F.col(c).alias(f"value_{c}") for c in ("mean", "std", "min", "max", "rms", "energy")])
    return rounded(B.pretrigger_comparison(d.filter("mult = 0").join(stats, "series_id"), "series_id", "y", [*NAMED, *[c for c in stats.columns if c != "series_id"]]))


@query("early_fault_stage", "G10")
def _(t):
    _, _, d = probes(t)
    return rounded(B.early_fault_stage(d.filter("mult = 0"), "series_id", "y", NAMED, shared_folder(t.spark, "early-fault")))
