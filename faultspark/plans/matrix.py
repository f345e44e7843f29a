"""Queries for feature-matrix operators."""

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import matrix as M
from .matrixdata import COLS, LONG_SQL, ORDERS_SQL, orders_long, orders_matrix, vectors
from .registry import R, query
from .series import rounded

DIM_COLS = COLS[:8]


@query("pivot_features", "D1", f"WITH {ORDERS_SQL} SELECT event_id, {', '.join(f'{R(c, 4)} AS {c}' for c in COLS[:5])} FROM m")
def _(t):
    return rounded(M.pivot_features(orders_long(t), "event_id", COLS[:5]), 4)


@query("unpivot_features", "D1", f"WITH {LONG_SQL} SELECT event_id, feature, {R('value', 4)} AS value FROM long WHERE feature IN ('n_lines', 'qty_sum')")
def _(t):
    return rounded(M.unpivot(orders_matrix(t), ["event_id"], ["n_lines", "qty_sum"]), 4)


def holes(t):
    k = F.col("l_orderkey") % 7
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(None).cast("double"))
                             .otherwise(F.col("l_quantity")).alias("q"), F.when(k == 3, F.lit(float("-inf"))).otherwise(F.col("l_tax")).alias("tax"))


HOLES_SQL = """h AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE l_quantity END AS q,
    CASE l_orderkey % 7 WHEN 3 THEN '-inf'::DOUBLE ELSE l_tax END AS tax FROM lineitem)"""


@query("impute_zero", "D2", f"""WITH {HOLES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN q IS NULL OR isnan(q) THEN 0 WHEN isinf(q) THEN 1e10 ELSE q END AS q,
    CASE WHEN isinf(tax) THEN -1e10 ELSE tax END AS tax FROM h""")
def _(t):
    return M.impute_zero(holes(t), ["q", "tax"])


@query("impute_median", "D2", f"""WITH {HOLES_SQL}, k AS (SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(q) THEN q END AS q, CASE WHEN isfinite(tax) THEN tax END AS tax FROM h)
  SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT median(q) FROM k)) AS q, coalesce(tax, (SELECT median(tax) FROM k)) AS tax FROM k""")
def _(t):
    return M.impute_median(holes(t), ["q", "tax"])


def _pairs(fmt):
    return " UNION ALL ".join(fmt.format(i=i, j=j, a=a, b=b) for i, a in enumerate(COLS) for j, b in enumerate(COLS))


CORR_SQL = f"""WITH {ORDERS_SQL}, c AS ({_pairs("SELECT {i} AS i, {j} AS j, '{a}' AS feature_i, '{b}' AS feature_j, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS r FROM m")})"""


@query("correlation_matrix", "D3", f"{CORR_SQL} SELECT i, j, feature_i, feature_j, {R('r')} AS r FROM c")
def _(t):
    return rounded(M.correlation_matrix(orders_matrix(t), COLS))


@query("correlation_filter", "D4", f"""{CORR_SQL}, d AS (SELECT DISTINCT feature_j FROM c WHERE i < j AND abs(r) > 0.7 AND feature_j <> 'price_sum'),
  n AS (SELECT unnest([{', '.join(f"'{c}'" for c in COLS)}]) AS feature) SELECT feature, feature = 'price_sum' AS protected FROM n WHERE feature NOT IN (SELECT feature_j FROM d)""")
def _(t):
    names = t.spark.createDataFrame([(c, c == "price_sum") for c in COLS], "feature string, protected boolean")
    return M.correlation_filter(M.correlation_matrix(orders_matrix(t), COLS), names, 0.7)


# feature names follow from the tables: event type x a fixed set of endings
ENDINGS = ["mean", "trend_slope", "segment_early_std", "cusum_max", "velocity_max", "segment_mid_late_slope", "kurtosis", "raw"]
NAMES_SQL = f"names AS (SELECT DISTINCT event_type || '_' || e AS feature FROM events, (SELECT unnest([{', '.join(repr(e) for e in ENDINGS)}]) AS e))"


def names(t):
    d = t.events.select("event_type").distinct().withColumn("e", F.explode(F.array(*[F.lit(e) for e in ENDINGS])))
    return d.select(F.concat_ws("_", "event_type", "e").alias("feature"))


@query("select_precursor_columns", "D5", f"WITH {NAMES_SQL} SELECT feature FROM names WHERE regexp_matches(feature, '(_trend_slope|_trend_acceleration|_cusum_max|_cusum_min|_early_late_diff|_early_late_ratio|_var_ratio_late_early)$') OR contains(feature, '_segment_')")
def _(t):
    return M.select_precursor_columns(names(t))


@query("standardize", "D6", f"""WITH {ORDERS_SQL} SELECT event_id, {', '.join(R(f'({c} - (SELECT avg({c}) FROM m WHERE event_id % 10 < 7)) / coalesce(nullif((SELECT stddev_pop({c}) FROM m WHERE event_id % 10 < 7), 0), 1)', 5) + f' AS {c}' for c in ('qty_sum', 'price_max', 'always_one'))} FROM m""")
def _(t):
    m = orders_matrix(t).select("event_id", "qty_sum", "price_max", "always_one")
    return rounded(M.standardize(m.filter(F.col("event_id") % 10 < 7), m, ["qty_sum", "price_max", "always_one"]), 5)


@query("standardize_long", "D6", f"""WITH {LONG_SQL}, s AS (SELECT feature, avg(value) AS a, stddev_pop(value) AS b FROM long GROUP BY 1)
  SELECT event_id, feature, {R('(value - a) / CASE WHEN b > 0 THEN b ELSE 1 END', 5)} AS value FROM long JOIN s USING (feature)""")
def _(t):
    d = orders_long(t)
    return rounded(M.standardize_long(d, d).select("event_id", "feature", "value"), 5)


@query("pca_scores", "D7")
def _(t):
    v = vectors(t)
    v = M.standardize_arrays(v, v)
    model = M.pca(v, variance=0.95)
    return model.project(v).select("vec_id", F.size("pc").alias("k"), rnd(F.get("pc", F.lit(0)), 4).alias("pc1"), rnd(F.get("pc", F.lit(1)), 4).alias("pc2"))


@query("pca_reconstruct", "D7")
def _(t):
    v = vectors(t)
    d = M.pca(v, k=5).project(v, reconstruct="back")
    return d.select("vec_id", F.transform("back", lambda x: rnd(x, 4)).alias("back"))


@query("components_for_variance", "D8", """WITH v AS (SELECT event_type AS feature, var_pop(value) AS v FROM events GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY v DESC, feature) AS component, v / sum(v) OVER () AS ratio FROM v),
  c AS (SELECT *, sum(ratio) OVER (ORDER BY component ROWS UNBOUNDED PRECEDING) AS cum FROM o), t AS (SELECT unnest([0.3, 0.5, 0.9, 2.0])::DOUBLE AS threshold)
  SELECT threshold, coalesce(min(CASE WHEN cum >= threshold THEN component END), max(component))::INT AS n_components FROM c, t GROUP BY 1""")
def _(t):
    from pyspark.sql import Window as W

    v = t.events.groupBy(F.col("event_type").alias("feature")).agg(F.var_pop("value").alias("v"))
    total = v.agg(F.sum("v").alias("s")).scalar()
    o = v.select(F.row_number().over(W.orderBy(F.desc("v"), "feature")).alias("component"), (F.col("v") / total).alias("ratio"))
    return M.components_for_variance(o, [0.3, 0.5, 0.9, 2.0])


PROFILE_SQL = f"WITH {LONG_SQL}, p AS (SELECT feature, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS variance, 100.0 * count_if(value = 0) / count(value) AS pct_zero FROM long GROUP BY 1)"


@query("feature_profile", "D9", f"{PROFILE_SQL} SELECT feature, n, {R('mean', 4)} AS mean, {R('std', 4)} AS std, {R('variance', 2)} AS variance, {R('pct_zero', 4)} AS pct_zero FROM p")
def _(t):
    return rounded(M.feature_profile(orders_long(t)).withColumn("variance", rnd("variance", 2)), 4)


@query("profile_summary", "D9", f"{PROFILE_SQL} SELECT count_if(variance > 1.5) AS n_high_variance, count_if(variance < 0.1) AS n_low_variance, count_if(pct_zero > 50) AS n_sparse, count_if(abs(mean) < 0.01) AS n_zero_mean, count_if(std < 1e-6) AS n_constant FROM p")
def _(t):
    return M.profile_summary(M.feature_profile(orders_long(t)))


@query("class_mean_difference", "D10", f"""WITH {LONG_SQL}, g AS (SELECT feature, abs(avg(CASE WHEN y = 1 THEN value END) - avg(CASE WHEN y = 0 THEN value END)) AS diff FROM long GROUP BY 1)
  SELECT feature, {R('diff')} AS diff, row_number() OVER (ORDER BY diff DESC, feature)::INT AS rank FROM g QUALIFY rank <= 5""")
def _(t):
    return rounded(M.class_mean_difference(orders_long(t), "y", 5))


@query("winsorize", "D11", """WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1)
  SELECT event_id, event_type, """ + R("least(greatest(value, lo), hi)") + """ AS value FROM events JOIN q USING (event_type)""")
def _(t):
    return rounded(M.winsorize(t.events.select("event_id", "event_type", "value"), ["value"], ["event_type"]))


TAXONOMY_EXTRA = ["decay_rate", "detuning_jump", "mod_phase_std_pre", "meta_KPI", "phase_std_pre", "rf_drive_on"]


@query("feature_taxonomy", "D12", f"""WITH {NAMES_SQL}, a AS (SELECT feature FROM names UNION ALL SELECT unnest([{', '.join(repr(x) for x in TAXONOMY_EXTRA)}]) AS feature FROM (SELECT count(*) FROM events))
  SELECT CASE WHEN feature = 'decay_rate' THEN 'Effective Decay' WHEN feature = 'phase_std_pre' THEN 'RF Mismatch' WHEN feature = 'rf_drive_on' THEN 'Metadata/Status' WHEN feature LIKE 'detuning\\_%' ESCAPE '\\' THEN 'Detuning'
    WHEN feature LIKE 'mod\\_phase\\_%' ESCAPE '\\' THEN 'Modulator Command' WHEN feature LIKE 'meta\\_%' ESCAPE '\\' THEN 'Metadata/Status' WHEN regexp_matches(feature, '(_segment_.*|_slope|_cusum_max|_velocity_max)$') THEN 'Temporal'
    WHEN regexp_matches(feature, '_(mean|kurtosis)$') THEN 'Statistical' ELSE 'Other' END AS family, count(*) AS n FROM a GROUP BY 1""")
def _(t):
    extra = t.events.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(x) for x in TAXONOMY_EXTRA])).alias("feature"))
    return names(t).union(extra).groupBy(M.feature_family("feature").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("exclude_channels", "D13", f"WITH {NAMES_SQL} SELECT feature FROM names WHERE NOT starts_with(feature, 'view_') AND NOT starts_with(feature, 'error_')")
def _(t):
    return M.exclude_channels(names(t), ["view", "error", "err"])


@query("add_alias", "D14", f"WITH {ORDERS_SQL} SELECT event_id, n_lines, qty_mean, n_lines AS line_count FROM m")
def _(t):
    m = orders_matrix(t).select("event_id", "n_lines", "qty_mean")
    return M.add_alias(m, {"line_count": "n_lines", "qty_mean": "n_lines", "gone": "absent"})
