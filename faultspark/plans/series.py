"""Queries for alignment, windows and per-series features."""

import math

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import series as S
from .registry import R, query
from .seriesdata import BASE_SQL, PRE, REF_DT, SAMPLES_SQL, WINDOW_SQL, samples, scaled_sql, window

PI = repr(math.pi)


def rounded(df, n=6, skip=()):
    return df.select(*[rnd(c, n).alias(c) if ty in ("double", "float") and c not in skip else F.col(c) for c, ty in df.dtypes])


def both(t):
    s = samples(t)
    return s, S.find_trigger(s)


@query("find_trigger", "C1", f"{BASE_SQL} SELECT series_id, z, n, dt_us FROM trig")
def _(t):
    return S.find_trigger(samples(t))


@query("scale_samples", "C2", f"{BASE_SQL} SELECT series_id, {scaled_sql(3000)}::INT AS n_long, {scaled_sql(PRE)}::INT AS n_short FROM trig")
def _(t):
    tr = S.find_trigger(samples(t))
    return tr.select("series_id", S.scale_samples(3000, "dt_us", REF_DT).alias("n_long"), S.scale_samples(PRE, "dt_us", REF_DT).alias("n_short"))


@query("pre_window", "C3", f"{WINDOW_SQL} SELECT series_id, idx, pos, value FROM win")
def _(t):
    return window(t).select("series_id", "idx", "pos", "value")


@query("post_window", "C3", f"""{BASE_SQL}, w AS (SELECT *, {scaled_sql(PRE)} AS win_n FROM a)
  SELECT series_id, idx, idx - z AS pos, value FROM w WHERE z + win_n <= n AND idx >= z AND idx < z + win_n""")
def _(t):
    return S.post_window(*both(t), PRE, REF_DT).select("series_id", "idx", "pos", "value")


@query("segments", "C4", f"""{BASE_SQL}, w AS (SELECT *, {scaled_sql(32)} AS win_n FROM a), h AS (SELECT *, least(win_n, z) AS have, win_n // 5 AS seg_len FROM w),
  p AS (SELECT *, idx - (z - have) AS pos FROM h WHERE seg_len > 0 AND have >= seg_len AND idx >= z - have AND idx < z),
  g AS (SELECT *, least(4, pos // seg_len) AS seg FROM p),
  k AS (SELECT * FROM g WHERE (CASE WHEN seg = 4 THEN win_n ELSE (seg + 1) * seg_len END) <= have)
  SELECT series_id, ['early','mid_early','mid','mid_late','late'][(seg + 1)::INT] AS segment, count(*) AS n, {R('avg(value)')} AS mean,
    {R('stddev_pop(value)')} AS std, {R('coalesce(regr_slope(value, pos), 0)')} AS slope FROM k GROUP BY 1, 2""")
def _(t):
    return rounded(S.segments(*both(t), 32, REF_DT))


@query("fixed_segments", "C4", f"""WITH {SAMPLES_SQL}, g AS (SELECT *, unnest([CASE WHEN idx < 6 THEN 'early' END, CASE WHEN idx >= 6 AND idx < 12 THEN 'mid' END,
    CASE WHEN idx >= 12 AND idx < 18 THEN 'late' END, CASE WHEN idx < 18 THEN 'full_pretrigger' END, CASE WHEN idx >= 18 THEN 'post_trigger' END]) AS segment FROM s)
  SELECT series_id, segment, count(*) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std FROM g WHERE segment IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return rounded(S.fixed_segments(samples(t), 18, {"early": (0, 6), "mid": (6, 12), "late": (12, 18)}))


Z_SQL = f"""WITH {SAMPLES_SQL}, m AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY 1),
  zz AS (SELECT s.*, m, sd, CASE WHEN sd > 0 THEN (value - m) / sd ELSE value END AS z FROM s JOIN m USING (series_id))"""


@query("series_stats", "C5", f"""{Z_SQL} SELECT series_id, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, {R('min(z)')} AS min, {R('max(z)')} AS max,
    {R('max(z) - min(z)')} AS "range", {R('median(z)')} AS median, {R('quantile_cont(z, 0.25)')} AS q1, {R('quantile_cont(z, 0.75)')} AS q3,
    {R('quantile_cont(z, 0.75) - quantile_cont(z, 0.25)')} AS iqr, {R('avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5)')} AS skewness,
    {R('avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3')} AS kurtosis, {R('sqrt(avg(value * value))')} AS rms,
    {R('sum(value * value)', 4)} AS energy, {R('coalesce(max(z) / nullif(sqrt(avg(z * z)), 0), 0)')} AS crest_factor FROM zz GROUP BY 1""")
def _(t):
    d = S.series_stats(samples(t))
    return rounded(d.withColumn("energy", rnd("energy", 4)))


@query("zero_crossings", "C6", f"""{Z_SQL}, l AS (SELECT *, lag(z) OVER (PARTITION BY series_id ORDER BY idx) AS p FROM zz)
  SELECT series_id, count_if(sign(z) <> sign(p)) AS zero_crossings FROM l GROUP BY 1""")
def _(t):
    return S.zero_crossings(S.zscore(samples(t)), value="z")


for _k in (1, 5):
    query(f"autocorr_lag{_k}", "C7", f"""WITH {SAMPLES_SQL}, l AS (SELECT *, lag(value, {_k}) OVER (PARTITION BY series_id ORDER BY idx) AS p FROM s)
      SELECT series_id, {R('CASE WHEN count(*) <= 1 THEN 0 ELSE corr(p, value) END')} AS autocorr FROM l GROUP BY 1""")(
        lambda t, k=_k: rounded(S.autocorr_lag(samples(t), k)))


@query("local_maxima", "C8", f"""WITH {SAMPLES_SQL}, l AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx))
  SELECT series_id, idx, value FROM l WHERE value > p AND value > q""")
def _(t):
    return S.local_maxima(samples(t))


@query("zscore", "C9", f"{Z_SQL} SELECT series_id, idx, {R('z')} AS z FROM zz")
def _(t):
    return S.zscore(samples(t)).select("series_id", "idx", rnd("z").alias("z"))


@query("zscore_global", "C9", f"""WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1)
  SELECT event_id, {R('(value - m) / (sd + 1e-10)')} AS z FROM events JOIN m USING (event_type)""")
def _(t):
    return S.zscore(t.events, ["event_type"], eps=1e-10).select("event_id", rnd("z").alias("z"))


GRAD_SQL = """g AS (SELECT *, CASE WHEN lag({v}) OVER w IS NULL THEN lead({v}) OVER w - {v} WHEN lead({v}) OVER w IS NULL THEN {v} - lag({v}) OVER w
    ELSE (lead({v}) OVER w - lag({v}) OVER w) / 2 END AS grad FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY {i})),
  gg AS (SELECT *, CASE WHEN lag(grad) OVER w IS NULL THEN lead(grad) OVER w - grad WHEN lead(grad) OVER w IS NULL THEN grad - lag(grad) OVER w
    ELSE (lead(grad) OVER w - lag(grad) OVER w) / 2 END AS grad2 FROM g WINDOW w AS (PARTITION BY {k} ORDER BY {i}))"""


def grad_sql(v="value", src="s", k="series_id", i="idx"):
    return GRAD_SQL.format(v=v, src=src, k=k, i=i)


@query("gradients", "C11", f"WITH {SAMPLES_SQL}, {grad_sql()} SELECT series_id, idx, {R('grad')} AS grad, {R('grad2')} AS grad2 FROM gg")
def _(t):
    return rounded(S.gradients(samples(t)).select("series_id", "idx", "grad", "grad2"))


@query("derivative_features", "C11", f"WITH {SAMPLES_SQL}, {grad_sql()} SELECT series_id, " + ", ".join(
    f"{R(e.format(c))} AS {tag}_{n}" for tag, c in (("velocity", "grad"), ("accel", "grad2"))
    for n, e in (("mean", "avg({})"), ("std", "stddev_pop({})"), ("max", "max(abs({}))"))) + " FROM gg GROUP BY 1")
def _(t):
    return rounded(S.derivative_features(samples(t)))


@query("forward_derivative_features", "C12", f"""WITH {SAMPLES_SQL}, l AS (SELECT series_id, idx, value AS x, lag(value) OVER w AS a, lead(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
  f AS (SELECT *, (b - x) / 0.5 AS f1, (b - 2 * x + a) / 0.25 AS f2 FROM l),
  q AS (SELECT *, coalesce(f1, lag(f1) OVER w) AS d1, coalesce(f2, CASE WHEN a IS NULL THEN lead(f2) OVER w ELSE lag(f2) OVER w END) AS d2 FROM f WINDOW w AS (PARTITION BY series_id ORDER BY idx))
  SELECT series_id, {R('max(abs(d1))')} AS deriv1_max, {R('avg(abs(d1))')} AS deriv1_mean, {R('max(abs(d2))')} AS deriv2_max, {R('avg(abs(d2))')} AS deriv2_mean FROM q GROUP BY 1""")
def _(t):
    return rounded(S.forward_derivative_features(samples(t), F.lit(0.5)))


@query("trends", "C13", f"""{WINDOW_SQL}, q AS (SELECT series_id, count(*)::DOUBLE AS n, regr_slope(value, pos) AS b1, sum(pos::DOUBLE) AS s1, sum(pow(pos, 2)) AS s2, sum(pow(pos, 3)) AS s3,
    sum(pow(pos, 4)) AS s4, sum(value) AS t0, sum(pos * value) AS t1, sum(pos * pos * value) AS t2 FROM win GROUP BY 1)
  SELECT series_id, {R('coalesce(b1, 0)')} AS trend_slope,
    {R('(t2 * (n*s2 - s1*s1) - t1 * (n*s3 - s1*s2) + t0 * (s1*s3 - s2*s2)) / nullif(s4 * (n*s2 - s1*s1) - s3 * (n*s3 - s1*s2) + s2 * (s1*s3 - s2*s2), 0)')} AS trend_acceleration FROM q""")
def _(t):
    return rounded(S.trends(window(t)))


@query("cusum_centered", "C14", f"""{WINDOW_SQL}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id) AS e FROM win),
  p AS (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cs FROM c)
  SELECT series_id, {R('max(cs)')} AS cusum_max, {R('min(cs)')} AS cusum_min FROM p GROUP BY 1""")
def _(t):
    return rounded(S.cusum_centered(window(t), idx="pos"))


PAGE_SQL = f"""WITH {SAMPLES_SQL}, bs AS (SELECT series_id, avg(value) + stddev_pop(value) / 2 AS k FROM s WHERE idx < 12 GROUP BY 1),
  c AS (SELECT s.*, CASE WHEN idx = 0 THEN 0 ELSE value - k END AS e FROM s JOIN bs USING (series_id)),
  p AS (SELECT *, sum(e) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cs FROM c),
  q AS (SELECT *, cs - min(cs) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS page FROM p)"""


@query("cusum_page", "C15", f"{PAGE_SQL} SELECT series_id, {R('max(page)')} AS cusum_max FROM q GROUP BY 1")
def _(t):
    return rounded(S.cusum_page(samples(t), baseline=12))


@query("early_late", "C16", f"""{WINDOW_SQL}, e AS (SELECT *, {scaled_sql(7)} AS ne, {scaled_sql(13)} AS nl FROM win),
  g AS (SELECT series_id, avg(CASE WHEN pos < ne THEN value END) AS me, avg(CASE WHEN pos >= nl THEN value END) AS ml, var_pop(CASE WHEN pos < ne THEN value END) AS ve,
    var_pop(CASE WHEN pos >= nl THEN value END) AS vl, avg(abs(value)) AS ma FROM e GROUP BY 1)
  SELECT series_id, {R('ml - me')} AS early_late_diff, {R('CASE WHEN abs(me) <= 1e-6 * (ma + 1e-12) THEN 0 ELSE ml / me END')} AS early_late_ratio,
    {R('vl / (ve + 1e-10)', 5)} AS var_ratio_late_early FROM g""")
def _(t):
    w = window(t)
    d = S.early_late(w, S.scale_samples(7, "dt_us", REF_DT), S.scale_samples(13, "dt_us", REF_DT))
    return rounded(d.withColumn("var_ratio_late_early", rnd("var_ratio_late_early", 5)))


@query("pre_post_stats", "C17", f"""{BASE_SQL}, p AS (SELECT series_id, CASE WHEN idx < z THEN value END AS a, CASE WHEN idx >= z THEN value END AS b FROM a)
  SELECT series_id, {R('sqrt(avg(a * a))')} AS rms_pre, {R('stddev_pop(a)')} AS std_pre, {R('avg(a)')} AS mean_pre, {R('sqrt(avg(b * b))')} AS rms_post,
    {R('stddev_pop(b)')} AS std_post, {R('avg(b)')} AS mean_post, {R('coalesce(max(abs(b)), 0)')} AS max_abs_post, {R('coalesce(avg(b) - avg(a), 0)')} AS change FROM p GROUP BY 1""")
def _(t):
    return rounded(S.pre_post_stats(*both(t)))


@query("settling", "C18", f"""{BASE_SQL}, f AS (SELECT series_id, median(value) AS fin FROM a WHERE idx >= greatest(z, n - 10) GROUP BY 1),
  j AS (SELECT a.*, fin, CASE WHEN fin <> 0 THEN 0.2 * abs(fin) ELSE 0.2 END AS thr FROM a JOIN f USING (series_id))
  SELECT series_id, max(CASE WHEN idx >= z AND idx < z + 8 THEN abs(value) END) AS max_excursion,
    coalesce(min(CASE WHEN idx >= z AND abs(value - fin) < thr THEN (idx - z)::DOUBLE END), 'inf'::DOUBLE) AS settling_samples,
    {R('avg((abs(value) > 95)::INT)')} AS saturation_fraction FROM j GROUP BY 1""")
def _(t):
    d = S.settling(*both(t), first=8, tail=10, tol=0.2, level=95.0)
    return d.withColumn("saturation_fraction", rnd("saturation_fraction"))


PHASE = f"(value - 6.0 * floor(value / 6.0)) - 3.0"
PHASE_SQL = f"""ph AS (SELECT *, {PHASE} AS v FROM {{src}}), st AS (SELECT *, v - lag(v) OVER (PARTITION BY {{k}} ORDER BY {{i}}) AS st FROM ph),
  md AS (SELECT *, (st + {PI}) - 2 * {PI} * floor((st + {PI}) / (2 * {PI})) - {PI} AS m FROM st),
  fx AS (SELECT *, CASE WHEN abs(st) >= {PI} THEN (CASE WHEN m = -{PI} AND st > 0 THEN {PI} ELSE m END) - st ELSE 0 END AS fx FROM md),
  un AS (SELECT *, v + coalesce(sum(fx) OVER (PARTITION BY {{k}} ORDER BY {{i}} ROWS UNBOUNDED PRECEDING), 0) AS phase FROM fx)"""


def phase_of(d):
    return d.withColumn("value", (F.col("value") - 6.0 * F.floor(F.col("value") / 6.0)) - 3.0)


@query("unwrap_phase", "C19", f"WITH {SAMPLES_SQL}, {PHASE_SQL.format(src='s', k='series_id', i='idx')} SELECT series_id, idx, {R('phase')} AS phase FROM un")
def _(t):
    return S.unwrap_phase(phase_of(samples(t))).select("series_id", "idx", rnd("phase").alias("phase"))


PART_SQL = f"""{BASE_SQL}, pt AS (SELECT *, CASE WHEN idx >= z THEN 'post' ELSE 'pre' END AS part, CASE WHEN idx >= z THEN idx - z ELSE idx END AS pidx,
    (dt_us / 1e10) AS dts FROM a), {PHASE_SQL.format(src='pt', k='series_id, part', i='pidx')}"""


def scaled_trigger(t):
    """Trigger table with spacing rescaled so that rates keep six informative decimals."""
    s, tr = both(t)
    return phase_of(s), tr.withColumn("dt_us", F.col("dt_us") / 1e10 * 1e6)


@query("detuning", "C20", f"""{PART_SQL}, pre AS (SELECT * FROM un WHERE part = 'pre'), {grad_sql('phase', 'pre', 'series_id', 'pidx')},
  q AS (SELECT series_id, count(*) AS np, regr_slope(phase, pidx * dts) / (2 * {PI}) AS mean_hz, stddev_pop(grad / dts / (2 * {PI})) AS std_hz,
    avg(grad2 / dts / dts) / (2 * {PI}) AS slope_hz, (max(phase) - min(phase)) / (2 * {PI}) AS ptp, arg_max(phase, pidx) AS lastp FROM gg GROUP BY 1),
  po AS (SELECT series_id, phase AS p10 FROM un WHERE part = 'post' AND pidx = 10)
  SELECT trig.series_id, {R('CASE WHEN np > 30 THEN mean_hz ELSE 0 END')} AS detuning_mean_hz, {R('CASE WHEN np > 30 THEN std_hz ELSE 0 END')} AS detuning_std_hz,
    {R('CASE WHEN np > 30 THEN slope_hz ELSE 0 END')} AS detuning_slope_hz_s, {R('CASE WHEN np > 30 THEN ptp ELSE 0 END')} AS detuning_peak_to_peak,
    {R(f'CASE WHEN np > 30 THEN coalesce((p10 - lastp) / (2 * {PI}), 0) ELSE 0 END')} AS detuning_jump
  FROM trig LEFT JOIN q USING (series_id) LEFT JOIN po USING (series_id)""")
def _(t):
    return rounded(S.detuning(*scaled_trigger(t), min_pre=30))


@query("phase_stability", "C21", f"""{PART_SQL}, q AS (SELECT series_id, count(*) AS np, stddev_pop(v) AS sd, max(v) - min(v) AS ptp, regr_slope(phase, pidx * dts) AS sl,
    list(v ORDER BY pidx) AS vs FROM un WHERE part = 'pre' GROUP BY 1),
  k AS (SELECT *, unnest(range(0, np // 2 + 1)) AS f FROM q),
  ft AS (SELECT series_id, pow(list_sum([vs[i + 1] * cos(2 * {PI} * f * i / np) for i in range(0, np)]), 2) + pow(list_sum([vs[i + 1] * sin(2 * {PI} * f * i / np) for i in range(0, np)]), 2) AS pw, np FROM k),
  ps AS (SELECT series_id, sum(pw) / max(np) AS psd FROM ft GROUP BY 1)
  SELECT series_id, {R('coalesce(sd, 0)')} AS jitter, {R('coalesce(ptp, 0)')} AS excursion, {R('CASE WHEN np > 30 THEN sl ELSE 0 END')} AS noise_slope, {R('coalesce(psd, 0)')} AS psd_integral
  FROM trig LEFT JOIN q USING (series_id) LEFT JOIN ps USING (series_id)""")
def _(t):
    return rounded(S.phase_stability(*scaled_trigger(t), min_pre=30))


@query("power_balance", "C23", f"""{BASE_SQL}, p AS (SELECT *, value * value AS f, second * second AS r, {scaled_sql(5)} AS h FROM a),
  g AS (SELECT series_id, avg(CASE WHEN idx < z THEN f END) AS fm, avg(CASE WHEN idx < z THEN r END) AS rm, avg(CASE WHEN idx >= z - h AND idx < z THEN f END) AS a0,
    avg(CASE WHEN idx >= z AND idx < z + h THEN f END) AS b0, stddev_pop(CASE WHEN idx < z THEN f - r END) AS im, max(n > z + h) AS fits FROM p GROUP BY 1)
  SELECT series_id, {R('fm', 4)} AS forward_mean, {R('rm', 4)} AS reflected_mean, {R('rm / (fm + 1e-10)')} AS reflection_ratio,
    {R('CASE WHEN fits THEN coalesce(abs(b0 - a0) / (a0 + 1e-10), 0) ELSE 0 END')} AS jump, {R('coalesce(im, 0)', 4)} AS imbalance FROM g""")
def _(t):
    s, tr = both(t)
    d = S.power_balance(s, tr, 5, REF_DT, fwd="value", refl="second")
    return d.select(
        "series_id", *[rnd(c, 4).alias(c) for c in ("forward_mean", "reflected_mean", "imbalance")], *[rnd(c).alias(c) for c in ("reflection_ratio", "jump")])


@query("pair_channels", "C23", """WITH s AS (SELECT user_id, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx, value FROM events)
  SELECT user_id, idx, a.value AS a, b.value AS b FROM s a JOIN s b USING (user_id, idx) WHERE a.channel = 'view' AND b.channel = 'click'""")
def _(t):
    from ..functions.exprs import micros

    e = t.events.select("user_id", F.col("event_type").alias("channel"), micros("ts").alias("us"), "event_id", "value")
    s = S.index_samples(e, ["user_id", "channel"], ["us", "event_id"])
    return S.pair_channels(s, "view", "click", ["user_id"])


@query("decay_fit", "C24", f"""{BASE_SQL}, w AS (SELECT *, {scaled_sql(12)} AS win_n FROM a), p AS (SELECT *, idx - z AS pos, abs(value) AS y, dt_us / 1e10 AS dts FROM w WHERE z + win_n <= n AND idx >= z AND idx < z + win_n),
  m AS (SELECT series_id, min(y) AS lo, arg_min(y, pos) AS y0, arg_max(y, pos) AS y1 FROM p GROUP BY 1),
  l AS (SELECT p.*, ln(y - lo + 1e-10) AS ly, pos * dts AS ts FROM p JOIN m USING (series_id) WHERE y0 >= y1),
  f AS (SELECT series_id, regr_slope(ly, ts) AS b, regr_intercept(ly, ts) AS c FROM l GROUP BY 1),
  e AS (SELECT series_id, max(b) AS b, sum(pow(ly - (c + b * ts), 2)) AS sse, sqrt(avg(pow(ly - (c + b * ts), 2))) AS rs, var_pop(ly) * count(*) AS sst FROM l JOIN f USING (series_id) GROUP BY 1)
  SELECT trig.series_id, {R('-1 / b')} AS tau, {R('CASE WHEN -1 / b > 0 THEN -b END')} AS rate, {R('coalesce(CASE WHEN sst > 0 THEN 1 - sse / sst ELSE 0 END, 0)')} AS r2,
    {R('-1 / b / 0.005', 4)} AS relative, {R('rs')} AS residual FROM trig LEFT JOIN e USING (series_id)""")
def _(t):
    s, tr = both(t)
    # spacing and reference are rescaled together, so the window length stays the same
    d = S.decay_fit(s, tr.withColumn("dt_us", F.col("dt_us") / 1e4), 12, REF_DT / 1e4)
    return rounded(d.withColumn("relative", rnd("relative", 4)).drop("loaded_q"))


@query("validity_flags", "C25", f"""{BASE_SQL}, l AS (SELECT *, {scaled_sql(6)} AS w, lead(value) OVER (PARTITION BY series_id ORDER BY idx) AS nx FROM a)
  SELECT series_id, (avg(abs(value)) > 50)::INT AS rf_on, (max(n > z + w) AND count_if(idx >= z AND idx < z + w - 1 AND abs(nx) < abs(value)) > 0.6 * max(w))::INT AS valid_decay FROM l GROUP BY 1""")
def _(t):
    return S.validity_flags(*both(t), 6, REF_DT, on_level=50.0)


@query("numeric_metadata", "C26", """WITH h AS (SELECT o_orderkey, unnest(['price', 'status', 'priority']) AS k, unnest([o_totalprice::VARCHAR, o_orderstatus, substr(o_orderpriority, 1, 1)]) AS v FROM orders)
  SELECT o_orderkey, 'meta_' || k AS feature, TRY_CAST(v AS DOUBLE) AS value FROM h WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL""")
def _(t):
    header = F.create_map(F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.substring("o_orderpriority", 1, 1))
    return S.numeric_metadata(t.orders.select("o_orderkey", header.alias("h")), "o_orderkey", "h")


@query("sequences", "C27", f"""WITH {SAMPLES_SQL}, g AS (SELECT series_id, list(value::FLOAT ORDER BY idx) AS v FROM s WHERE idx < 70 GROUP BY 1),
  p AS (SELECT series_id, list_concat(v, [0::FLOAT for i in range(0, 70 - len(v))]) AS full_v FROM g)
  SELECT series_id, list_transform(full_v, lambda x: {R('x', 3)}) AS "full", list_transform(full_v[1:60], lambda x: {R('x', 3)}) AS pre,
    [{R('full_v[i + 1]', 3)} for i in range(0, 70) if i % 10 = 0] AS coarse FROM p""")
def _(t):
    d = S.sequences(samples(t), 70, 60, 10)
    return d.select("series_id", *[F.transform(c, lambda x: rnd(x, 3)).alias(c) for c in ("full", "pre", "coarse")])


GRID = (-1.0e12, 1.0e12, 41)
STEP = (GRID[1] - GRID[0]) / (GRID[2] - 1)
GRID_SQL = f"""WITH {SAMPLES_SQL}, iv AS (SELECT *, lead(t_us) OVER w AS t1, lead(value) OVER w AS v1, lead(t_us, 2) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
  grid AS (SELECT i::INT AS k, {GRID[0]} + i * {STEP} AS g FROM range(0, {GRID[2]}) r(i)),
  hit AS (SELECT series_id, k, value + (v1 - value) * (g - t_us) / (t1 - t_us) AS v FROM iv JOIN grid ON g >= t_us AND (g < t1 OR (t2 IS NULL AND g = t1)) WHERE t1 > t_us),
  tr AS (SELECT u.series_id, grid.k, hit.v AS value FROM (SELECT DISTINCT series_id FROM s) u CROSS JOIN grid LEFT JOIN hit ON hit.series_id = u.series_id AND hit.k = grid.k)"""


@query("resample_linear", "C28", f"{GRID_SQL} SELECT series_id, k, {R('value')} AS value FROM tr")
def _(t):
    return rounded(S.resample_linear(samples(t), *GRID))


@query("ensemble_mean_band", "C29", f"""{GRID_SQL}, g AS (SELECT series_id % 5 AS category, k, count(*) AS n, count(value) AS coverage, avg(value) AS m, stddev_pop(value) AS sd FROM tr GROUP BY 1, 2)
  SELECT category, k, coverage, {R('CASE WHEN coverage >= greatest(3, round_even(n * 0.3, 0)) THEN m END')} AS mean, {R('CASE WHEN coverage >= greatest(3, round_even(n * 0.3, 0)) THEN sd END')} AS std FROM g""")
def _(t):
    tr = S.resample_linear(samples(t), *GRID).withColumn("category", F.col("series_id") % 5)
    return rounded(S.ensemble_mean_band(tr, "category"))


@query("ensemble_limits", "C29", f"""{GRID_SQL} SELECT series_id % 5 AS category, {R('quantile_cont(value, 0.01)')} AS p01, {R('quantile_cont(value, 0.99)')} AS p99 FROM tr GROUP BY 1""")
def _(t):
    from ..functions.ordering import agg_with_quantiles

    tr = S.resample_linear(samples(t), *GRID).withColumn("category", F.col("series_id") % 5)
    return rounded(agg_with_quantiles(tr, ["category"], [], {"p01": ("value", 0.01), "p99": ("value", 0.99)}))


@query("fixed_window", "C31", f"""WITH {SAMPLES_SQL}, m AS (SELECT user_id AS series_id, count(*) AS nrow, count(*) * 2 // 3 AS postrow FROM events GROUP BY 1)
  SELECT series_id, idx, idx - greatest(0, postrow - 30) AS pos, {R('4.0 * (series_id % 400) / 70.442')} AS step_us FROM s JOIN m USING (series_id) WHERE idx >= greatest(0, postrow - 30) AND idx < least(nrow, postrow + 10)""")
def _(t):
    m = t.events.groupBy(F.col("user_id").alias("series_id")).agg(F.count(F.lit(1)).alias("nrow")).selectExpr("series_id", "nrow", "nrow * 2 div 3 AS postrow")
    return S.fixed_window(samples(t), m, 30, 10).select("series_id", "idx", "pos", rnd(S.sample_step_us(F.col("series_id") % 400)).alias("step_us"))


@query("clean_series", "C32", """WITH e AS (SELECT user_id, event_type AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 2 THEN 'inf'::DOUBLE ELSE value END AS value FROM events),
  c AS (SELECT unnest(['view', 'error', 'never']) AS channel), i AS (SELECT DISTINCT user_id, idx FROM e WHERE channel IN ('view', 'error'))
  SELECT i.user_id, c.channel, i.idx, CASE WHEN value IS NULL OR value = 0 THEN 1e-10 WHEN value = 'inf'::DOUBLE THEN 1e10 ELSE value END AS value
  FROM i CROSS JOIN c LEFT JOIN e ON e.user_id = i.user_id AND e.channel = c.channel AND e.idx = i.idx""")
def _(t):
    from ..functions.exprs import micros

    k = F.col("event_id") % 7
    v = F.when(k == 0, 0.0).when(k == 1, F.lit(None).cast("double")).when(k == 2, F.lit(math.inf)).otherwise(F.col("value"))
    e = t.events.select("user_id", F.col("event_type").alias("channel"), micros("ts").alias("us"), "event_id", v.alias("value"))
    s = S.index_samples(e, ["user_id"], ["us", "event_id"])
    return S.clean_series(s, ["view", "error", "never"], "user_id")


@query("normalisation_check", "C33", f"""WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1),
  z AS (SELECT event_type, (value - m) / (sd + 1e-10) AS z FROM events JOIN m USING (event_type)), g AS (SELECT avg(z) AS a, stddev_pop(z) AS b FROM z GROUP BY event_type)
  SELECT count(*) AS n_channels, {R('max(abs(a))')} AS max_mean_dev, {R('max(abs(b - 1))')} AS max_std_dev FROM g""")
def _(t):
    return rounded(S.normalisation_check(S.zscore(t.events, ["event_type"], eps=1e-10), "event_type"))


@query("modulation_features", "C34", f"""WITH {SAMPLES_SQL}, ph AS (SELECT series_id, idx, value, second, t_us / 1e12 AS phase FROM s), {grad_sql('phase', 'ph')}
  SELECT series_id, {R('(max(abs(value)) - min(abs(value))) / nullif(avg(abs(value)), 0) * 100', 4)} AS amplitude_mod_depth, {R('max(phase) - min(phase)')} AS phase_mod_depth,
    {R('coalesce(avg(abs(value)) / nullif(avg(abs(second)), 0), 0)')} AS forward_reflected_ratio, {R('avg(abs(value))')} AS cavity_gradient, {R('avg(second - value)')} AS error_mean,
    {R('stddev_pop(second - value)')} AS error_std, {R('max(abs(second - value))')} AS error_max, {R(f'avg(grad) * 88e6 / (2 * {PI})', 2)} AS detuning_hz,
    {R(f'avg(grad) / (2 * {PI})')} AS detuning_bandwidth FROM gg GROUP BY 1""")
def _(t):
    d = S.modulation_features(samples(t).withColumn("phase", F.col("t_us") / 1e12), a="value", b="second")
    return rounded(d.withColumn("amplitude_mod_depth", rnd("amplitude_mod_depth", 4)).withColumn("detuning_hz", rnd("detuning_hz", 2)))


@query("longest_run", "C8", f"""WITH {SAMPLES_SQL}, u AS (SELECT series_id, idx, value > 50 AS up FROM s), g AS (SELECT *, idx - row_number() OVER (PARTITION BY series_id, up ORDER BY idx) AS isle FROM u),
  r AS (SELECT series_id, isle, count(*) AS n FROM g WHERE up GROUP BY 1, 2) SELECT series_id, coalesce(max(r.n), 0) AS longest, count(r.n) AS n_runs FROM (SELECT DISTINCT series_id FROM s) d LEFT JOIN r USING (series_id) GROUP BY 1""")
def _(t):
    """A user's kernel in three steps (start, merge, finish)."""
    from ..operators import kernels as N

    return N.run_series_kernel(samples(t), N.longest_run(50.0))


RUNS_SQL = """st AS (SELECT series_id, idx, v, coalesce(v <> lag(v) OVER (PARTITION BY series_id ORDER BY idx), TRUE)::INT AS new FROM src),
  nr AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS k FROM st),
  runs AS (SELECT series_id, k, any_value(v) AS v, (min(idx) + max(idx)) // 2 AS idx FROM nr GROUP BY 1, 2),
  tops AS (SELECT *, v > lag(v) OVER w AND v > lead(v) OVER w AS top FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY k))"""


@query("peak_count", "C8", f"""WITH {SAMPLES_SQL}, src AS (SELECT series_id, idx, (value - avg(value) OVER (PARTITION BY series_id)) / stddev_pop(value) OVER (PARTITION BY series_id) AS v FROM s), {RUNS_SQL},
  hi AS (SELECT p.series_id, p.k, p.v, max(CASE WHEN r.k < p.k AND r.v > p.v THEN r.k END) AS a, min(CASE WHEN r.k > p.k AND r.v > p.v THEN r.k END) AS b FROM tops p JOIN runs r USING (series_id) WHERE p.top GROUP BY 1, 2, 3),
  pr AS (SELECT hi.series_id, hi.k, hi.v - greatest(min(CASE WHEN r.k <= hi.k AND r.k > coalesce(a, -1) THEN r.v END), min(CASE WHEN r.k >= hi.k AND r.k < coalesce(b, 1e18) THEN r.v END)) AS prominence
    FROM hi JOIN runs r USING (series_id) GROUP BY 1, 2, hi.v)
  SELECT u.series_id, count(pr.k) AS n_peaks FROM (SELECT DISTINCT series_id FROM s) u LEFT JOIN pr ON pr.series_id = u.series_id AND prominence >= 0.5 GROUP BY 1""")
def _(t):
    from ..operators import kernels as N

    return N.peak_count(S.zscore(samples(t)), 0.5, value="z")


@query("peaks_by_distance", "C8", f"""WITH {SAMPLES_SQL}, src AS (SELECT series_id, idx, value AS v FROM s), {RUNS_SQL},
  o AS (SELECT series_id, list([idx] ORDER BY v DESC, idx DESC) AS ps FROM tops WHERE top GROUP BY 1),
  kept AS (SELECT series_id, unnest(list_reduce(ps, lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y - x[1]) < 5)) > 0 THEN a ELSE list_append(a, x[1]) END, []::BIGINT[])) AS idx FROM o)
  SELECT kept.series_id, kept.idx, value FROM kept JOIN s ON s.series_id = kept.series_id AND s.idx = kept.idx""")
def _(t):
    from ..operators import kernels as N

    return N.peaks_by_distance(samples(t), 5)


def _section_sql(x: str, y: str, s: str, b, a) -> tuple[str, list[str]]:
    """Output of one filter section for the input x with states s1, s2, and the next states for the output y."""
    nxt = [f"{b[j]!r} * {x} - {a[j]!r} * {y}" + (f" + {s}{j + 1}" if j + 1 < len(a) else "") for j in range(1, len(a))]
    return f"({b[0]!r} * {x} + {s}1)", nxt


def _recursion_sql(name: str, source: str, sections) -> str:
    """CTE ``name`` (series_id, i, x, y): the sections run over (series_id, i, x) of ``source``, i from 0."""
    sections = [(b.tolist(), a.tolist()) for b, a in sections]
    states = [f"p{k}_{j}" for k, (_, a) in enumerate(sections) for j in range(1, len(a))]
    x, ys, nxt = "x", [], []
    for k, (b, a) in enumerate(sections):
        y, after = _section_sql(x, f"y{k}", f"p{k}_", b, a)
        ys.append((f"y{k}", y))
        nxt += after
        x = f"y{k}"
    # one lateral step for each section, whose output the next one reads
    step = f"(SELECT d.series_id, d.i, d.x, {', '.join(f'0.0::DOUBLE AS {c}' for c in states)} FROM {source} d WHERE d.i = 0)"
    out = lambda src: f"SELECT series_id, i, x, {ys[-1][0]} AS y, {', '.join(f'{n} AS {c}' for n, c in zip(nxt, states))} FROM " + _nested(src, ys)
    again = f"(SELECT d.series_id, d.i, d.x, {', '.join('r.' + c for c in states)} FROM {name} r JOIN {source} d ON d.series_id = r.series_id AND d.i = r.i + 1)"
    return f"{name} AS ({out(step)} UNION ALL {out(again)})"


def _nested(src: str, ys: list[tuple[str, str]]) -> str:
    for name, expr in ys:
        src = f"(SELECT *, {expr} AS {name} FROM {src})"
    return src


def _highpass_sql() -> str:
    from ..operators.kernels import butterworth_highpass

    return f"""WITH RECURSIVE {SAMPLES_SQL}, src AS (SELECT series_id, idx AS i, value AS x FROM s), {_recursion_sql('r', 'src', butterworth_highpass(4, 0.01))},
  n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1) SELECT series_id, i AS idx, {R('CASE WHEN n <= 10 THEN x ELSE y END')} AS filtered FROM r JOIN n USING (series_id)"""


def _zero_phase_sql() -> str:
    from ..operators.kernels import butterworth_highpass

    sections = butterworth_highpass(1, 0.01)
    return f"""WITH RECURSIVE {SAMPLES_SQL}, n AS (SELECT series_id, count(*) AS n, arg_min(value, idx) AS x0, arg_max(value, idx) AS x1 FROM s GROUP BY 1 HAVING count(*) > 6),
  ext AS (SELECT series_id, idx + 6 AS i, value AS x, n FROM s JOIN n USING (series_id) UNION ALL SELECT series_id, 6 - idx, 2 * x0 - value, n FROM s JOIN n USING (series_id) WHERE idx BETWEEN 1 AND 6
    UNION ALL SELECT series_id, n - 1 + (n - 1 - idx) + 6, 2 * x1 - value, n FROM s JOIN n USING (series_id) WHERE n - 1 - idx BETWEEN 1 AND 6),
  e AS (SELECT series_id, i, x - first_value(x) OVER (PARTITION BY series_id ORDER BY i) AS x, n FROM ext), {_recursion_sql('f', 'e', sections)},
  g AS (SELECT series_id, n + 11 - i AS i, y - last_value(y) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x, n FROM f JOIN n USING (series_id)), {_recursion_sql('b', 'g', sections)}
  SELECT series_id, n + 5 - i AS idx, {R('y')} AS filtered FROM b JOIN n USING (series_id) WHERE n + 5 - i BETWEEN 0 AND n - 1"""


@query("highpass", "C10", _highpass_sql())
def _(t):
    from ..operators import kernels as N

    return rounded(N.highpass(samples(t)))


@query("highpass_zero_phase", "C10", _zero_phase_sql())
def _(t):
    from ..operators import kernels as N

    return rounded(N.highpass_zero_phase(samples(t), 0.01))


@query("spectral_features", "C22")
def _(t):
    from ..operators import kernels as N

    return rounded(N.spectral_features(*scaled_trigger(t), min_pre=20), 4)


@query("extract_features", "C30")
def _(t):
    from ..operators.extraction import extract_features

    s = samples(t)
    two = s.select("series_id", "idx", "t_us", F.explode(F.array(
        F.struct(F.lit("a").alias("channel"), F.col("value")), F.struct(F.lit("b").alias("channel"), F.col("second").alias("value")))).alias("p")).select("series_id", "p.channel", "idx", "t_us", "p.value")
    meta = t.events.groupBy(F.col("user_id").alias("series_id")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("first")).select(
        "series_id", F.create_map(F.lit("NROW"), F.col("n").cast("string"), F.lit("LOOP"), F.when(F.col("series_id") % 2 == 0, "ON").otherwise("OFF"), F.lit("DATE"), F.col("first"), F.lit("BEAM"), F.lit("OUI")).alias("header"))
    d = extract_features(two, {"cavity": "a", "phase": "b", "forward": "a", "reflected": "b", "amplifier": "a", "modulator_amplitude": "a", "modulator_phase": "b"}, meta, window=PRE, ref_dt=REF_DT, min_pre=20)
    return rounded(d, 4)
