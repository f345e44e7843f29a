"""Queries for anomaly scores."""

from pyspark.sql import functions as F

from ..functions.exprs import ratio, rnd
from ..functions.iterate import cut_lineage
from ..functions.ordering import with_running
from ..operators import anomaly as A
from ..operators.neighbours import knn, knn_approx
from .matrixdata import ORDERS_SQL, VECTORS_SQL, orders_matrix, vectors
from .registry import R, query
from .series import rounded


def split_vectors(t):
    v = vectors(t)
    return v.filter(F.col("vec_id") % 10 < 7), v.filter(F.col("vec_id") % 10 >= 7)


@query("isolation_forest", "F1")
def _(t):
    tr, te = split_vectors(t)
    return rounded(A.isolation_forest(tr, te).select("vec_id", "score", "flag"))


@query("isolation_forest_tuned", "F1")
def _(t):
    v = vectors(t)
    return rounded(A.isolation_forest(v, v, contamination=0.37).select("vec_id", "score", "flag"))


def knn_sql(q, b, k, strict):
    return f"""SELECT q.vec_id AS id, b.vec_id AS nid, list_distance(q.x, b.x) AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, b.x), b.vec_id) AS rank
      FROM {q} q JOIN {b} b ON {'q.vec_id <> b.vec_id' if strict else 'TRUE'} QUALIFY rank <= {k}"""


SPLIT_SQL = f"WITH {VECTORS_SQL}, tr AS (SELECT * FROM v WHERE vec_id % 10 < 7), te AS (SELECT * FROM v WHERE vec_id % 10 >= 7)"


@query("knn_training", "F2", f"WITH {VECTORS_SQL}, e AS ({knn_sql('v', 'v', 5, True)}) SELECT id, nid, {R('dist')} AS dist, rank::INT AS rank FROM e")
def _(t):
    v = vectors(t)
    return rounded(knn(v, v, 5, exclude_self=True))


@query("knn_query", "F2", f"{SPLIT_SQL}, e AS ({knn_sql('te', 'tr', 7, False)}) SELECT id, nid, {R('dist')} AS dist, rank::INT AS rank FROM e")
def _(t):
    tr, te = split_vectors(t)
    return rounded(knn(te, tr, 7))


@query("knn_approx", "F2")
def _(t):
    tr, te = split_vectors(t)
    return rounded(knn_approx(te, tr, 7))


LRD = "SELECT e.id, 1.0 / (avg(greatest(kd, dist)) + 1e-10) AS lrd FROM {e} e JOIN k ON k.id = e.nid GROUP BY 1"


@query("lof", "F3", f"""WITH {VECTORS_SQL}, e AS ({knn_sql('v', 'v', 20, True)}), k AS (SELECT id, max(dist) AS kd FROM e GROUP BY 1), l AS ({LRD.format(e='e')}),
  o AS (SELECT e.id, avg(n.lrd) / max(s.lrd) AS lof FROM e JOIN l n ON n.id = e.nid JOIN l s ON s.id = e.id GROUP BY 1) SELECT id, {R('lof')} AS lof, (lof > 1.5)::INT AS flag FROM o""")
def _(t):
    return rounded(A.lof(vectors(t), k=20))


@query("lof_novelty", "F3", f"""{SPLIT_SQL}, e AS ({knn_sql('tr', 'tr', 20, True)}), k AS (SELECT id, max(dist) AS kd FROM e GROUP BY 1), l AS ({LRD.format(e='e')}), e2 AS ({knn_sql('te', 'tr', 20, False)}), s AS ({LRD.format(e='e2')}),
  o AS (SELECT e2.id, avg(n.lrd) / max(s.lrd) AS lof FROM e2 JOIN l n ON n.id = e2.nid JOIN s ON s.id = e2.id GROUP BY 1) SELECT id, {R('lof')} AS lof, (lof > 1.5)::INT AS flag FROM o""")
def _(t):
    tr, te = split_vectors(t)
    return rounded(A.lof(tr, te, k=20))


for _k, _p in ((20, 90), (5, 75), (10, 90)):
    query(f"kdist_eps_{_k}_{_p}", "F4", f"WITH {VECTORS_SQL}, e AS ({knn_sql('v', 'v', _k, False)}) SELECT {R(f'quantile_cont(dist, {_p / 100})')} AS eps FROM e WHERE rank = {_k}")(
        lambda t, k=_k, p=_p: rounded(A.kdist_eps(vectors(t), k, p)))


def near_and_eps(t):
    """The ten nearest neighbours, which one search finds for the radius and for the clusters."""
    v = vectors(t)
    near = cut_lineage(knn(v, v, 10))
    return near, A.eps_of_near(near, 10, 30).first()[0]


@query("dbscan", "F5", f"""WITH RECURSIVE {VECTORS_SQL}, e AS ({knn_sql('v', 'v', 10, False)}), ep AS (SELECT quantile_cont(dist, 0.3) AS eps FROM e WHERE rank = 10),
  near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE list_distance(a.x, b.x) <= (SELECT eps FROM ep)), n AS (SELECT a AS id, count(*) >= 5 AS core FROM near GROUP BY 1),
  g AS (SELECT a, b FROM near JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE p.core AND q.core), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b), c AS (SELECT a AS id, min(b) AS root FROM r GROUP BY 1),
  k AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM c)), l AS (SELECT id, cluster FROM c JOIN k USING (root)),
  t AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN l ON l.id = b GROUP BY 1)
  SELECT n.id, coalesce(CASE WHEN core THEN l.cluster ELSE t.cluster END, -1)::BIGINT AS cluster, core FROM n LEFT JOIN l ON l.id = n.id LEFT JOIN t ON t.id = n.id""")
def _(t):
    return A.dbscan_of_near(vectors(t), *near_and_eps(t), 5)


@query("dbscan_cores", "F5", f"""WITH {VECTORS_SQL}, e AS ({knn_sql('v', 'v', 10, False)}), ep AS (SELECT quantile_cont(dist, 0.3) AS eps FROM e WHERE rank = 10),
  n AS (SELECT a.vec_id AS id, count_if(list_distance(a.x, b.x) <= (SELECT eps FROM ep)) AS n FROM v a, v b GROUP BY 1) SELECT count(*) AS n_points, count_if(n >= 5) AS n_core FROM n""")
def _(t):
    return A.cores_of_near(vectors(t), *near_and_eps(t), 5).agg(F.count(F.lit(1)).alias("n_points"), F.count_if("core").alias("n_core"))


@query("dbscan_distance_score", "F6", f"""WITH {VECTORS_SQL}, l AS (SELECT vec_id, x, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END AS cluster FROM v),
  c AS (SELECT cluster, list(m ORDER BY p) AS c FROM (SELECT cluster, p, avg(x[p]) AS m FROM l, range(1, 65) r(p) WHERE cluster >= 0 GROUP BY 1, 2) GROUP BY 1)
  SELECT vec_id AS id, l.cluster::BIGINT AS cluster, {R('CASE WHEN max(l.cluster) >= 0 THEN max(CASE WHEN c.cluster = l.cluster THEN list_distance(x, c) END) ELSE min(list_distance(x, c)) END')} AS score FROM l, c GROUP BY 1, 2""")
def _(t):
    v = vectors(t)
    labels = v.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label")).cast("bigint").alias("cluster"))
    return rounded(A.dbscan_distance_score(v, labels))


@query("mahalanobis_shrunk", "F7")
def _(t):
    tr, te = split_vectors(t)
    return rounded(A.mahalanobis_lw(tr, te, k=30).select("vec_id", "score", "flag"), 4)


@query("mahalanobis_chi2", "F8", f"""WITH {ORDERS_SQL}, f AS (SELECT avg(qty_mean) AS ma, avg(disc_mean) AS mb, var_samp(qty_mean) + 1e-6 AS saa, var_samp(disc_mean) + 1e-6 AS sbb, covar_samp(qty_mean, disc_mean) AS sab FROM m WHERE event_id % 10 < 7),
  d AS (SELECT event_id, sqrt((pow(qty_mean - ma, 2) * sbb - 2 * (qty_mean - ma) * (disc_mean - mb) * sab + pow(disc_mean - mb, 2) * saa) / (saa * sbb - sab * sab)) AS s FROM m, f)
  SELECT event_id, {R('s')} AS score, (s > sqrt(-2 * ln(0.05)))::INT AS flag FROM d""")
def _(t):
    m = orders_matrix(t)
    return rounded(A.mahalanobis_chi2(m.filter(F.col("event_id") % 10 < 7), m, ["qty_mean", "disc_mean"]).select("event_id", "score", "flag"))


for _rule in ("percentile", "sigma"):
    def _recon(t, rule=_rule):
        tr, te = split_vectors(t)
        return rounded(A.pca_reconstruction(tr, te, rule=rule).select("vec_id", "score", "flag"))
    query(f"pca_reconstruction_{_rule}", "F9")(_recon)

SCORES_SQL = f"WITH {ORDERS_SQL}, s AS (SELECT event_id, y, qty_mean, disc_mean, always_one, (qty_mean > 30)::INT AS f1, (disc_mean > 0.06)::INT AS f2, (tax_mean > 0.05)::INT AS f3 FROM m)"


def flags(t):
    """Flags of orders. f2 and f3 compare means with numbers that many means equal but for rounding, so means are summed in the table's order of rows."""
    place = ["file_path", "row_index"]
    lines = t.lineitem.select(F.col("l_orderkey").alias("event_id"), *[f"_metadata.{c}" for c in place], "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    run = with_running(lines, ["event_id"], place, {"disc": F.col("l_discount"), "tax": F.col("l_tax")})
    mean = lambda total, c: ratio(F.max_by(total, F.struct(*place)), F.count(c))
    m = run.groupBy("event_id").agg(F.max("returned").alias("y"), F.avg("l_quantity").alias("qty_mean"), mean("disc", "l_discount").alias("disc_mean"), mean("tax", "l_tax").alias("tax_mean"))
    return m.select("event_id", "y", "qty_mean", "disc_mean", F.lit(1.0).alias("always_one"), (F.col("qty_mean") > 30).cast("int").alias("f1"),
                    (F.col("disc_mean") > 0.06).cast("int").alias("f2"), (F.col("tax_mean") > 0.05).cast("int").alias("f3"))


@query("minmax_ensemble", "F10", f"""{SCORES_SQL}, b AS (SELECT min(qty_mean) a, max(qty_mean) b, min(disc_mean) c, max(disc_mean) d FROM s)
  SELECT event_id, {R('((qty_mean - a) / (b - a) + (disc_mean - c) / (d - c) + 0) / 3')} AS ensemble FROM s, b""")
def _(t):
    return A.minmax_ensemble(flags(t), ["qty_mean", "disc_mean", "always_one"]).select("event_id", rnd("ensemble").alias("ensemble"))


@query("vote_ensemble", "F11", f"{SCORES_SQL} SELECT event_id, {R('(f1 + f2 + f3) / 3')} AS vote, ((f1 + f2 + f3) / 3 >= 0.5)::INT AS flag FROM s")
def _(t):
    return rounded(A.vote_ensemble(flags(t), ["f1", "f2", "f3"]).select("event_id", "vote", "flag"))


@query("detector_summary", "F12", f"""{SCORES_SQL}, u AS (SELECT y, unnest(['f1','f2','f3']) AS method, unnest([f1, f2, f3]) AS f FROM s)
  SELECT method, {R('avg(CASE WHEN y = 1 THEN f END)')} AS detection_rate, {R('avg(CASE WHEN y = 0 THEN f END)')} AS false_positive_rate,
    {R('coalesce(2 * count_if(y = 1 AND f = 1) / nullif(2 * count_if(y = 1 AND f = 1) + count_if(y = 0 AND f = 1) + count_if(y = 1 AND f = 0), 0), 0)')} AS f1 FROM u GROUP BY 1""")
def _(t):
    return rounded(A.detector_summary(flags(t), ["f1", "f2", "f3"], "y"))


@query("jaccard_agreement", "F13", f"""{SCORES_SQL}, u AS (SELECT event_id, unnest(['f1','f2','f3']) AS m, unnest([f1, f2, f3]) AS f FROM s)
  SELECT a.m AS method_a, b.m AS method_b, {R('count_if(a.f = 1 AND b.f = 1) / (count_if(a.f = 1 OR b.f = 1) + 1e-10)')} AS jaccard FROM u a JOIN u b USING (event_id) GROUP BY 1, 2""")
def _(t):
    return rounded(A.jaccard_agreement(flags(t), ["f1", "f2", "f3"]))


@query("adaptive_params", "F14", "SELECT c_nationkey, least(20, greatest(2, count(*) - 1)) AS k, least(5, greatest(2, count(*) // 5)) AS min_samples FROM customer GROUP BY 1")
def _(t):
    k, m = A.adaptive_params(F.col("n"))
    return t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select("c_nationkey", k.alias("k"), m.alias("min_samples"))


@query("per_label_outlier_recall", "F15", f"""{SCORES_SQL}, u AS (SELECT f1, unnest(['f2','f3']) AS label, unnest([f2, f3]) AS y FROM s) SELECT label, count_if(y = 1) AS n, {R('avg(CASE WHEN y = 1 THEN f1 END)')} AS recall FROM u GROUP BY 1""")
def _(t):
    return rounded(A.per_label_outlier_recall(flags(t), ["f2", "f3"], "f1"))
