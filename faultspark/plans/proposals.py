"""Queries for the proposed operators."""

from pyspark.sql import functions as F

from ..functions.exprs import micros, rnd
from ..operators import metrics as H, proposals as P, series as S
from .matrixdata import ORDERS_SQL, VECTORS_SQL, orders_long, orders_matrix, vectors
from .metrics import COUNTS_SQL, LABELS3, preds
from .registry import R, query
from .series import rounded
from .seriesdata import BASE_SQL, SAMPLES_SQL, samples

TYPES = ["click", "error", "purchase", "signup", "view"]


@query("zscore_outliers", "P1", "WITH s AS (SELECT avg(l_quantity) a, stddev_pop(l_quantity) b, avg(l_extendedprice) c, stddev_pop(l_extendedprice) d FROM lineitem) SELECT l_orderkey, l_linenumber, (abs((l_quantity - a) / b) > 1.5 OR abs((l_extendedprice - c) / d) > 1.5)::INT AS outlier FROM lineitem, s")
def _(t):
    return P.zscore_outliers(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 1.5).select("l_orderkey", "l_linenumber", "outlier")


@query("onset_times", "P2", """WITH s AS (SELECT user_id, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts)::DOUBLE AS t_us, value FROM events),
  b AS (SELECT user_id, channel, avg(value) + stddev_pop(value) / 2 AS k FROM s WHERE idx < 4 GROUP BY 1, 2), c AS (SELECT s.*, CASE WHEN idx = 0 THEN 0 ELSE value - k END AS e FROM s JOIN b USING (user_id, channel)),
  p AS (SELECT *, sum(e) OVER w AS cs FROM c WINDOW w AS (PARTITION BY user_id, channel ORDER BY idx ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, cs - min(cs) OVER (PARTITION BY user_id, channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS page FROM p),
  f AS (SELECT user_id, channel, arg_min(t_us, idx) AS onset_us FROM q WHERE page > 80 GROUP BY 1, 2) SELECT user_id, channel, onset_us, arg_min(channel, (onset_us, channel)) OVER (PARTITION BY user_id) AS root_channel FROM f""")
def _(t):
    e = t.events.select("user_id", F.col("event_type").alias("channel"), micros("ts").alias("us"), "event_id", "value")
    s = S.index_samples(e, ["user_id", "channel"], ["us", "event_id"]).withColumn("t_us", F.col("us").cast("double"))
    return P.onset_times(s, "user_id", 80.0, 4)


_COUNTS = ", ".join(f"count_if(event_type = '{x}') AS {x}" for x in TYPES)


@query("fault_timeline", "P3", f"SELECT ts::DATE AS day, {_COUNTS} FROM events GROUP BY 1")
def _(t):
    return P.fault_timeline(t.events, "ts", "event_type", TYPES)


@query("hours_between", "P4", f"WITH l AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events WHERE event_type = 'error') SELECT user_id, event_id, {R('d / 3.6e9')} AS hours FROM l WHERE d IS NOT NULL")
def _(t):
    e = t.events.filter(F.col("event_type") == "error").select("user_id", "event_id", micros("ts").alias("us"))
    return rounded(P.hours_between(e, "user_id", "us", "event_id"))


@query("device_fault_counts", "P5", f"SELECT user_id, {_COUNTS} FROM events GROUP BY 1")
def _(t):
    return P.device_fault_counts(t.events, "user_id", "event_type", TYPES)


@query("t_statistic", "P6", f"""WITH g AS (SELECT count_if(y = 1) AS n1, count_if(y = 0) AS n0, avg(CASE WHEN y = 1 THEN v END) AS m1, avg(CASE WHEN y = 0 THEN v END) AS m0, var_samp(CASE WHEN y = 1 THEN v END) AS v1, var_samp(CASE WHEN y = 0 THEN v END) AS v0
    FROM (SELECT (l_returnflag = 'R')::INT AS y, l_quantity AS v FROM lineitem)) SELECT n1, n0, {R('m1')} AS m1, {R('m0')} AS m0, {R('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0))')} AS t, n1 + n0 - 2 AS df FROM g""")
def _(t):
    return rounded(P.t_statistic(t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "l_quantity", "y"))


_BOOLS = {"returned": "l_returnflag = 'R'", "finished": "l_linestatus = 'F'", "large": "l_quantity > 15"}


@query("association_rules", "P7", f"""WITH b AS (SELECT {', '.join(f'({e})::INT AS {n}' for n, e in _BOOLS.items())} FROM lineitem), n AS (SELECT count(*) AS n FROM b),
  r AS ({' UNION ALL '.join(f"SELECT '{','.join(sorted(a))}' AS antecedent, '{c}' AS consequent, sum({'*'.join(a)}) AS sa, sum({'*'.join(a + [c])}) AS sb FROM b"
      for c in _BOOLS for a in ([x] for x in _BOOLS if x != c))} UNION ALL {' UNION ALL '.join(f"SELECT '{','.join(sorted(x for x in _BOOLS if x != c))}' AS antecedent, '{c}' AS consequent, sum({'*'.join(x for x in _BOOLS if x != c)}) AS sa, sum({'*'.join(_BOOLS)}) AS sb FROM b" for c in _BOOLS)})
  SELECT antecedent, consequent, {R('sb / sa')} AS confidence, {R('sb / n')} AS support FROM r, n WHERE sb / n >= 0.1 AND sb / sa >= 0.6""")
def _(t):
    d = t.lineitem.select(*[F.expr(e).alias(n) for n, e in _BOOLS.items()])
    return rounded(P.association_rules(d, list(_BOOLS), 0.1, 0.6))


@query("kaplan_meier", "P8", f"""WITH x AS (SELECT floor(l_extendedprice / 1000) AS t, (l_returnflag <> 'N' OR l_extendedprice > 104000)::INT AS o FROM lineitem), g AS (SELECT t, count_if(o = 1) AS d, count(*) AS c FROM x GROUP BY 1), r AS (SELECT t, d, sum(c) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM g)
  SELECT t, at_risk::BIGINT AS at_risk, d, {R('product(1 - d / at_risk) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)')} AS survival FROM r QUALIFY d > 0""")
def _(t):
    d = t.lineitem.select(F.floor(F.col("l_extendedprice") / 1000).alias("t"), ((F.col("l_returnflag") != "N") | (F.col("l_extendedprice") > 104000)).cast("int").alias("o"))
    return rounded(P.kaplan_meier(d, "t", "o"))


LAGS = [-3, -1, 0, 1, 2]


@query("lagged_correlation", "P9", f"""WITH {SAMPLES_SQL}, l AS (SELECT series_id, value, lag AS lag, CASE lag {' '.join(f"WHEN {l} THEN lead(second, {l}) OVER w" if l > 0 else f"WHEN {l} THEN lag(second, {-l}) OVER w" for l in LAGS)} END AS b
    FROM s, (SELECT unnest({LAGS}) AS lag) WINDOW w AS (PARTITION BY series_id, lag ORDER BY idx)), c AS (SELECT series_id, lag, corr(value, b) AS r FROM l GROUP BY 1, 2)
  SELECT series_id, lag::INT AS lag, {R('r')} AS r, (arg_max(lag, (abs(c.r), -lag)) OVER (PARTITION BY series_id))::INT AS best_lag FROM c""")
def _(t):
    return rounded(P.lagged_correlation(samples(t), LAGS, ["series_id"], "value", "second"))


@query("clip_symmetric", "P10", f"WITH q AS (SELECT event_type, quantile_cont(value, 0.9) AS u FROM events GROUP BY 1) SELECT event_id, {R('greatest(-u, least(u, value))')} AS value FROM events JOIN q USING (event_type)")
def _(t):
    return rounded(P.clip_symmetric(t.events.select("event_id", "event_type", "value"), "value", ["event_type"], 0.9).select("event_id", "value"))


@query("moving_average", "P10", f"""WITH {SAMPLES_SQL}, m AS (SELECT series_id, idx, avg(value) OVER w AS sm, count(*) OVER w AS c FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) SELECT series_id, idx, {R('CASE WHEN c = 10 THEN sm END')} AS smooth FROM m""")
def _(t):
    return rounded(P.moving_average(samples(t), 10, ["series_id"]).select("series_id", "idx", "smooth"))


@query("propagation", "P11", f"""{BASE_SQL}, p AS (SELECT *, idx - z AS pos, max(CASE WHEN idx = z THEN value END) OVER (PARTITION BY series_id) AS v0 FROM a),
  g AS (SELECT series_id, min(CASE WHEN pos >= 0 AND value < 0.5 * v0 THEN pos END) AS drop_n, max(v0) - min(CASE WHEN pos >= 0 THEN value END) AS fall, regr_slope(CASE WHEN pos >= 0 THEN value END, pos) AS sl, avg(CASE WHEN pos >= 0 THEN value END) / avg(CASE WHEN pos < 0 THEN value END) AS rm,
    var_pop(CASE WHEN pos >= 0 THEN value END) - var_pop(CASE WHEN pos < 0 THEN value END) AS dv FROM p GROUP BY 1) SELECT series_id, drop_n, {R('fall / nullif(drop_n, 0)')} AS drop_rate, {R('sl')} AS recovery_slope, {R('rm')} AS ratio_mean, {R('dv', 4)} AS diff_variance FROM g""")
def _(t):
    s = samples(t)
    d = P.propagation(s, S.find_trigger(s), ["series_id"])
    return rounded(d.withColumn("diff_variance", rnd("diff_variance", 4)))


@query("granger", "P12")
def _(t):
    return rounded(P.granger(samples(t), 2, 2, "value", "second"), 4)


@query("variance_threshold", "P13", f"WITH {ORDERS_SQL}, u AS (SELECT unnest(['disc_mean', 'tax_mean', 'qty_mean', 'always_one']) AS feature, unnest([disc_mean, tax_mean, qty_mean, always_one]) AS value FROM m) SELECT feature, {R('var_pop(value)')} AS variance FROM u GROUP BY 1 HAVING var_pop(value) >= 0.01")
def _(t):
    d = orders_long(t).filter(F.col("feature").isin("disc_mean", "tax_mean", "qty_mean", "always_one"))
    return rounded(P.variance_threshold(d))


@query("l1_selection", "P13")
def _(t):
    return rounded(P.l1_selection(orders_matrix(t), ["n_lines", "qty_sum", "disc_mean", "tax_mean", "always_one"], "price_sum", 100.0), 2)


CENTRE_SQL = f"""WITH {VECTORS_SQL}, c AS (SELECT label, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(x[p]) AS m FROM v, range(1, 65) r(p) GROUP BY 1, 2) GROUP BY 1),
  d AS (SELECT vec_id AS id, c.label AS centre, list_distance(x, c) AS s FROM v, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(x, c), c.label) = 1)"""


@query("centre_distance", "P14", f"{CENTRE_SQL} SELECT id, centre::BIGINT AS centre, {R('s')} AS score, (s > (SELECT quantile_cont(s, 0.9) FROM d))::INT AS flag FROM d")
def _(t):
    v = vectors(t)
    long = v.select("label", F.posexplode("x").alias("p", "w")).groupBy("label", "p").agg(F.avg("w").alias("w"))
    c = long.groupBy(F.col("label").cast("bigint").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda s: s["w"]).alias("x"))
    return rounded(P.centre_distance(v, c))


@query("calibrate", "P15", f"WITH k AS (SELECT s_suppkey, s_acctbal / 1000 AS coef FROM supplier WHERE s_suppkey % 3 <> 0) SELECT l_orderkey, l_linenumber, {R('l_quantity * coalesce(coef, 1)', 4)} AS value FROM lineitem LEFT JOIN k ON l_suppkey = s_suppkey")
def _(t):
    k = t.supplier.filter(F.col("s_suppkey") % 3 != 0).select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 1000).alias("coef"))
    d = P.calibrate(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("value")), k, ["l_suppkey"])
    return d.select("l_orderkey", "l_linenumber", rnd("value", 4).alias("value"))


@query("smote", "P16")
def _(t):
    d = P.smote(vectors(t), "label", 1, 3)
    return d.select("id", "copy", "nid", rnd("u").alias("u"), F.transform("x", lambda v: rnd(v)).alias("x"))


@query("undersample", "P16", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '#42'), event_id) <= (SELECT min(c) FROM (SELECT count(*) AS c FROM events GROUP BY event_type))")
def _(t):
    return P.undersample(t.events.select("event_id", "event_type"), "event_id", "event_type")


@query("fbeta_weighted", "P18", f"{COUNTS_SQL} SELECT {R('sum(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) * (tp + fn)) / sum(tp + fn)')} AS f_beta FROM f")
def _(t):
    return rounded(P.fbeta(H.multiclass_counts(preds(t), "y3", "p3", LABELS3), 2.0))


@query("time_folds", "P18", "WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events) SELECT event_id, pos, (CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END)::INT AS part FROM p")
def _(t):
    e = t.events.select("event_id", micros("ts").alias("us"))
    return P.time_folds(e, ["us", "event_id"], 5).select("event_id", "pos", "part")


@query("conformal_sets", "P19", """WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag AS y, 0.2 + l_discount * 4 AS p_A, 0.3 + l_tax * 3 AS p_N, 0.5 - l_discount - l_tax AS p_R FROM lineitem),
  c AS (SELECT quantile_cont(1 - CASE y WHEN 'A' THEN p_A WHEN 'N' THEN p_N ELSE p_R END, 0.8) AS cut FROM s WHERE l_orderkey % 2 = 0)
  SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN 1 - p_A <= cut THEN 'A' END, CASE WHEN 1 - p_N <= cut THEN 'N' END, CASE WHEN 1 - p_R <= cut THEN 'R' END], lambda x: x IS NOT NULL), ',') AS prediction_set FROM s, c WHERE l_orderkey % 2 = 1""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("y"), (F.lit(0.2) + F.col("l_discount") * 4).alias("p_A"), (F.lit(0.3) + F.col("l_tax") * 3).alias("p_N"), (F.lit(0.5) - F.col("l_discount") - F.col("l_tax")).alias("p_R"))
    odd = F.col("l_orderkey") % 2 == 1
    out = P.conformal_sets(d.filter(~odd), d.filter(odd), ["A", "N", "R"], "y", 0.2)
    return out.select("l_orderkey", "l_linenumber", F.array_join("prediction_set", ",").alias("prediction_set"))
