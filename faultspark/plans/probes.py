"""Queries for lead-time probes and robustness analyses."""

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import probes as P, series as S
from .matrixdata import LONG_SQL, orders_long
from .registry import R, query
from .series import rounded
from .seriesdata import BASE_SQL, REF_DT, samples, scaled_sql

N_WIN = 6
MULTS = P.OFFSET_MULTIPLES
PROBE_SQL = f"""{BASE_SQL}, o AS (SELECT series_id, z, n, dt_us, {scaled_sql(N_WIN)} AS win_n, m AS mult, z - round_even(m * {scaled_sql(N_WIN)}, 0)::INT AS pz FROM trig, (SELECT unnest({MULTS})::DOUBLE AS m)),
  f AS (SELECT *, bool_and(pz > 0 AND pz >= win_n) OVER (PARTITION BY series_id ORDER BY mult ROWS UNBOUNDED PRECEDING) AS ok FROM o),
  w AS (SELECT f.*, s.idx, s.value, s.idx - (pz - win_n) AS pos FROM f JOIN s ON s.series_id = f.series_id AND s.idx >= pz - win_n AND s.idx < pz WHERE ok)"""


@query("probe_triggers", "L1", f"{PROBE_SQL} SELECT series_id, mult, pz AS probe_z FROM f WHERE ok")
def _(t):
    return P.probe_triggers(S.find_trigger(samples(t)), N_WIN, REF_DT).select("series_id", "mult", "probe_z")


@query("offset_probe", "L1", f"""{PROBE_SQL}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id, mult) AS e, {scaled_sql(2)} AS ne, {scaled_sql(4)} AS nl FROM w),
  p AS (SELECT *, sum(e) OVER (PARTITION BY series_id, mult ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cs FROM c),
  g AS (SELECT series_id, mult, coalesce(regr_slope(value, pos), 0) AS sl, max(cs) AS hi, min(cs) AS lo, avg(CASE WHEN pos >= nl THEN value END) - avg(CASE WHEN pos < ne THEN value END) AS df FROM p GROUP BY 1, 2)
  SELECT series_id, mult, {R('sl')} AS trend_slope, {R('hi')} AS cusum_max, {R('lo')} AS cusum_min, {R('df')} AS early_late_diff FROM g""")
def _(t):
    s = samples(t)
    d = P.offset_probe(s, S.find_trigger(s), N_WIN, 2, 4, REF_DT)
    return rounded(d.select("series_id", "mult", "trend_slope", "cusum_max", "cusum_min", "early_late_diff"))


# a curve per user: four-hour steps of the mean value stand in for probabilities
CURVE_SQL = "cv AS (SELECT user_id, (event_id % 12)::DOUBLE AS mult, (event_id % 12) * 4.0::DOUBLE AS offset_ms, avg(least(1.0, value / 60)) AS proba FROM events GROUP BY 1, 2, 3)"


def curve(t):
    m = F.col("event_id") % 12
    return t.events.groupBy("user_id", m.cast("double").alias("mult"), (m * 4.0).alias("offset_ms")).agg(F.avg(F.least(F.lit(1.0), F.col("value") / 60)).alias("proba"))


LEAD_SQL = f"""WITH {CURVE_SQL}, r AS (SELECT *, min((proba >= 0.5)::INT) OVER (PARTITION BY user_id ORDER BY mult ROWS UNBOUNDED PRECEDING) AS run FROM cv),
  ld AS (SELECT user_id, max(CASE WHEN run = 1 THEN offset_ms END) AS lead_ms, count_if(proba < 0.5) = 0 AS censored FROM r GROUP BY 1 HAVING max(CASE WHEN run = 1 THEN offset_ms END) IS NOT NULL)"""


@query("lead_time", "L2", f"{LEAD_SQL} SELECT user_id, lead_ms, censored FROM ld")
def _(t):
    return P.lead_time(curve(t), "user_id")


@query("lead_time_summary", "L2", f"{LEAD_SQL} SELECT censored, count(*) AS n, {R('avg(lead_ms)')} AS mean, min(lead_ms) AS min, max(lead_ms) AS max, {R('median(lead_ms)')} AS median, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM ld GROUP BY 1")
def _(t):
    return rounded(P.lead_time_summary(P.lead_time(curve(t), "user_id")))


def slope_score(d):
    """A fixed logistic score on two window features, in place of a trained model."""
    return d.withColumn("score", 1.0 / (1.0 + F.exp(-(F.col("trend_slope") * 0.1 + F.col("early_late_diff") * 0.01))))


@query("probability_curve", "L3", f"""{PROBE_SQL}, g AS (SELECT series_id, mult, any_value(dt_us) AS dt_us, any_value(win_n) AS win_n, coalesce(regr_slope(value, pos), 0) AS sl, avg(CASE WHEN pos >= {scaled_sql(4)} THEN value END) - avg(CASE WHEN pos < {scaled_sql(2)} THEN value END) AS df FROM w GROUP BY 1, 2)
  SELECT series_id, mult, {R('round_even(mult * win_n, 0) * dt_us / 1000', 2)} AS offset_ms, {R('1.0 / (1.0 + exp(-(sl * 0.1 + df * 0.01)))')} AS proba FROM g""")
def _(t):
    s = samples(t)
    tr = S.find_trigger(s)
    d = P.probability_curve(P.offset_probe(s, tr, N_WIN, 2, 4, REF_DT), slope_score, tr, "series_id", N_WIN, REF_DT)
    return d.select("series_id", "mult", rnd("offset_ms", 2).alias("offset_ms"), rnd("proba").alias("proba"))


@query("midwindow_triggers", "L4", f"{BASE_SQL}, q AS (SELECT series_id, n // 2 AS mid, round_even({scaled_sql(20)} * 2.0, 0)::INT AS margin, n FROM trig) SELECT series_id, mid, margin FROM q WHERE mid - margin > 0 AND mid + margin < n")
def _(t):
    return P.midwindow_triggers(S.find_trigger(samples(t)), 20, REF_DT).select("series_id", "mid", "margin")


@query("midwindow_probe", "L4", f"""{BASE_SQL}, q AS (SELECT series_id, n // 2 AS mid, round_even({scaled_sql(N_WIN)} * 2.0, 0)::INT AS margin, {scaled_sql(N_WIN)} AS win_n, n, dt_us FROM trig), e AS (SELECT * FROM q WHERE mid - margin > 0 AND mid + margin < n),
  w AS (SELECT e.*, s.value, s.idx - (mid - win_n) AS pos FROM e JOIN s ON s.series_id = e.series_id AND s.idx >= mid - win_n AND s.idx < mid WHERE mid >= win_n),
  g AS (SELECT series_id, 1.0 / (1.0 + exp(-(coalesce(regr_slope(value, pos), 0) * 0.1 + (avg(CASE WHEN pos >= {scaled_sql(4)} THEN value END) - avg(CASE WHEN pos < {scaled_sql(2)} THEN value END)) * 0.01))) AS p FROM w GROUP BY 1)
  SELECT count(*) AS n, count_if(p > 0.5) AS n_flagged, {R('avg((p > 0.5)::INT)')} AS share FROM g""")
def _(t):
    s = samples(t)
    tr = P.midwindow_triggers(S.find_trigger(s), N_WIN, REF_DT).withColumn("z", F.col("mid")).drop("mid", "margin")
    d = slope_score(P.offset_probe(s, tr, N_WIN, 2, 4, REF_DT, [0.0]))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0.5).alias("n_flagged"), rnd(F.avg((F.col("score") > 0.5).cast("int"))).alias("share"))


@query("pretrigger_fraction", "L5", f"{BASE_SQL}, f AS (SELECT (series_id % 3 = 0)::INT AS label, z / n AS frac FROM trig) SELECT label, count(*) AS n_events, {R('avg(frac)')} AS mean, {R('stddev_pop(frac)')} AS std, {R('median(frac)')} AS median FROM f GROUP BY 1")
def _(t):
    d = S.find_trigger(samples(t)).withColumn("label", (F.col("series_id") % 3 == 0).cast("int"))
    return rounded(P.pretrigger_fraction(d, "label"))


@query("single_feature_leak_scan", "L7", f"""WITH {LONG_SQL}, g AS (SELECT feature, value, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM long GROUP BY 1, 2),
  c AS (SELECT feature, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY feature) AS np, sum(neg) OVER (PARTITION BY feature) AS nn FROM g WINDOW w AS (PARTITION BY feature ORDER BY value)),
  a AS (SELECT feature, max(greatest(cn + np - cp, cp + nn - cn, np, nn) / (np + nn)) AS acc FROM c GROUP BY 1), k AS (SELECT feature, covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0) AS r FROM long GROUP BY 1)
  SELECT feature, {R('acc')} AS best_accuracy, {R('r')} AS corr FROM a JOIN k USING (feature)""")
def _(t):
    return rounded(P.single_feature_leak_scan(orders_long(t), "y"))


@query("throughput_benchmark", "L8")
def _(t):
    score = lambda d: d.withColumn("score", 1.0 / (1.0 + F.exp(-F.col("l_discount") * 10 + F.col("l_tax"))))
    return P.throughput_benchmark(t.lineitem.select("l_discount", "l_tax"), score).select("n_timed", "mean_ms", "median_ms", "p95_ms", "max_ms", "rows_per_s")
