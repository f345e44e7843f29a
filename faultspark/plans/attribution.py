"""Queries for attribution."""

from pyspark.sql import functions as F

from ..operators import attribution as K
from .clusters import PROF_SQL, long_vectors
from .matrixdata import LONG_SQL, orders_long, vectors
from .registry import R, query
from .series import rounded

COEF = {"qty_sum": 0.5, "price_max": -0.001, "disc_mean": 3.0}


@query("linear_shapley", "K1", f"""WITH {LONG_SQL}, k AS (SELECT unnest({list(COEF)}) AS feature, unnest({list(COEF.values())})::DOUBLE AS coef), mm AS (SELECT feature, avg(value) AS a FROM long GROUP BY 1)
  SELECT event_id, feature, {R('coef * (value - a)', 4)} AS value FROM long JOIN k USING (feature) JOIN mm USING (feature)""")
def _(t):
    coef = t.spark.createDataFrame(list(COEF.items()), "feature string, coef double")
    return rounded(K.linear_shapley(orders_long(t).select("event_id", "feature", "value"), coef), 4)


ATTR_SQL = PROF_SQL + ", atr AS (SELECT 'l' || (label % 4) AS label, feature, value * (1 + label) AS value FROM lg)"


def attributions(t):
    return long_vectors(t).select(F.concat(F.lit("l"), (F.col("label") % 4).cast("string")).alias("label"), "feature", (F.col("value") * (1 + F.col("label"))).alias("value"))


@query("mean_abs_attribution", "K4", f"""{ATTR_SQL}, g AS (SELECT label, feature, avg(abs(value)) AS imp FROM atr GROUP BY 1, 2) SELECT label, feature, {R('imp')} AS importance, (row_number() OVER (PARTITION BY label ORDER BY imp DESC, feature))::INT AS rank FROM g QUALIFY rank <= 20""")
def _(t):
    return rounded(K.mean_abs_attribution(attributions(t)))


GROUP_SQL = f"""{ATTR_SQL}, i AS (SELECT label, 'g' || (length(feature) * 7 + ascii(right(feature, 1))) % 5 AS family, avg(abs(value)) AS imp FROM atr GROUP BY label, feature, 2),
  g AS (SELECT label, family, count(*) AS n_features, sum(imp) AS t, avg(imp) AS a, median(imp) AS d FROM i GROUP BY 1, 2),
  p AS (SELECT label, family, n_features, 100 * t / sum(t) OVER w AS tp, 100 * a / sum(a) OVER w AS ap, 100 * d / sum(d) OVER w AS dp FROM g WINDOW w AS (PARTITION BY label))"""


def grouped(t):
    a = attributions(t)
    fam = a.select("feature").distinct().withColumn("family", F.concat(F.lit("g"), ((F.length("feature") * 7 + F.ascii(F.right("feature", F.lit(1)))) % 5).cast("string")))
    return K.group_attribution(a, fam)


@query("group_attribution", "K5", f"{GROUP_SQL} SELECT label, family, n_features, {R('tp')} AS total_pct, {R('ap')} AS mean_pct, {R('dp')} AS median_pct FROM p")
def _(t):
    return rounded(grouped(t))


@query("top_groups", "K5", f"{GROUP_SQL} SELECT label, arg_max(family, (tp, family)) AS top_by_total, arg_max(family, (ap, family)) AS top_by_mean, arg_max(family, (dp, family)) AS top_by_median FROM p GROUP BY 1")
def _(t):
    return K.top_groups(grouped(t))


@query("shared_important_features", "K6", f"""{ATTR_SQL}, i AS (SELECT label, feature, avg(abs(value)) AS imp FROM atr GROUP BY 1, 2), c AS (SELECT label, quantile_cont(imp, 0.9) AS cut FROM i GROUP BY 1)
  SELECT feature, count_if(imp > cut) AS n_important, {R('avg(imp)')} AS mean, {R('stddev_samp(imp)')} AS std, count_if(imp > cut) >= 3 AS shared FROM i JOIN c USING (label) GROUP BY 1""")
def _(t):
    return rounded(K.shared_important_features(attributions(t)))


def tanh_score(weights):
    """A small non-linear scorer, enough to show the expansion on any model."""
    def score(d):
        z = F.aggregate(F.zip_with("x", F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return d.withColumn("score", F.tanh(z))
    return score


#: One for each of the 64 dimensions.
WEIGHTS = [0.5, -1.0, 0.3, 0.0, 0.8, 0.1, -0.4, 0.2] * 8


@query("sampled_shapley", "K2")
def _(t):
    d = K.sampled_shapley(vectors(t), tanh_score(WEIGHTS), [0.0] * 64, "vec_id")
    return rounded(d)


@query("local_surrogate", "K3")
def _(t):
    d = K.local_surrogate(vectors(t), tanh_score(WEIGHTS), [0.1] * 64, "vec_id")
    return rounded(d)
