"""Queries for clustering and cluster quality."""

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import cluster_metrics as J, clustering as I
from .matrixdata import ORDERS_SQL, VECTORS_SQL, orders_matrix, vectors
from .registry import R, query
from .series import rounded


@query("kmeans", "I1")
def _(t):
    d, inertia = I.kmeans(vectors(t), 4, n_init=10)
    return d.select("vec_id", "cluster").withColumn("inertia", F.lit(round(inertia, 4)))


@query("gmm", "I2")
def _(t):
    return I.gmm(vectors(t), 3).select("vec_id", "cluster", F.transform("probability", lambda p: rnd(p)).alias("probability"))


@query("hierarchical", "I3")
def _(t):
    return I.hierarchical(vectors(t), 4).select("vec_id", "cluster")


@query("graph_clustering", "I4")
def _(t):
    return I.graph_clustering(vectors(t), 3)


LAB_SQL = "lab AS (SELECT vec_id, label % 4 AS m1, (vec_id % 7) % 3 AS m2, CASE WHEN label < 5 THEN 0 ELSE 1 END AS m3 FROM embeddings)"


def labelings(t):
    return t.embeddings.select("vec_id", (F.col("label") % 4).alias("m1"), ((F.col("vec_id") % 7) % 3).alias("m2"), F.when(F.col("label") < 5, 0).otherwise(1).alias("m3"))


@query("coassociation", "I5", f"""WITH {LAB_SQL}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, ((a.m1 = b.m1)::INT + (a.m2 = b.m2)::INT + (a.m3 = b.m3)::INT) / 3 AS share FROM lab a, lab b)
  SELECT {R('share')} AS share, count(*)::BIGINT AS n_pairs FROM p WHERE share > 0 GROUP BY 1""")
def _(t):
    c = I.coassociation(labelings(t), ["m1", "m2", "m3"])
    return c.groupBy(rnd("share").alias("share")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_pairs"))


@query("consensus", "I5", f"""WITH RECURSIVE {LAB_SQL}, sg AS (SELECT m1, m2, m3, min(vec_id) AS node FROM lab GROUP BY 1, 2, 3),
  e AS (SELECT a.node AS a, b.node AS b FROM sg a, sg b WHERE (a.m1 = b.m1)::INT + (a.m2 = b.m2)::INT + (a.m3 = b.m3)::INT >= 3 OR a.node = b.node),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS root FROM r GROUP BY 1)
  SELECT root AS first_id, count(*) AS n FROM lab JOIN sg USING (m1, m2, m3) JOIN c ON c.a = sg.node GROUP BY 1""")
def _(t):
    d = I.consensus(labelings(t), ["m1", "m2", "m3"], "vec_id", tau=0.9)
    return d.groupBy("cluster").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n")).drop("cluster")


@query("cluster_per_category", "I6")
def _(t):
    d = vectors(t).withColumn("category", F.when(F.col("label") < 5, "a").otherwise("b"))
    return I.cluster_per_category(d, "category")


@query("k_candidates", "I7")
def _(t):
    return rounded(I.k_candidates(vectors(t), [2, 3, 4, 5, 6]))


KM_SQL = "km AS (SELECT (2 + user_id % 9)::INT AS k, avg(value) AS silhouette, stddev_pop(value) AS davies_bouldin FROM events GROUP BY 1)"


@query("find_optimal_k", "I7", f"""WITH {KM_SQL}, s AS (SELECT k, silhouette, davies_bouldin, (coalesce((silhouette - min(silhouette) OVER ()) / nullif(max(silhouette) OVER () - min(silhouette) OVER (), 0), 0.5)
    + coalesce(1 - (davies_bouldin - min(davies_bouldin) OVER ()) / nullif(max(davies_bouldin) OVER () - min(davies_bouldin) OVER (), 0), 0.5)) / 2 AS score FROM km)
  SELECT k, {R('silhouette')} AS silhouette, {R('davies_bouldin')} AS davies_bouldin, {R('score')} AS score, row_number() OVER (ORDER BY s.score DESC, k) = 1 AS optimal FROM s""")
def _(t):
    m = t.events.groupBy((2 + F.col("user_id") % 9).cast("int").alias("k")).agg(F.avg("value").alias("silhouette"), F.stddev_pop("value").alias("davies_bouldin"))
    return rounded(I.find_optimal_k(m))


CAND_SQL = """cand AS (SELECT event_type AS category, 'c' || (user_id % 4) AS candidate, (CASE WHEN value < 20 THEN 0 WHEN value < (user_id % 4) * 40 + 60 THEN 1 ELSE 2 END)::INT AS cluster, count(*) AS n FROM events GROUP BY 1, 2, 3),
  q AS (SELECT *, sum(n * cluster) OVER (PARTITION BY category, candidate) / sum(n) OVER (PARTITION BY category, candidate) AS silhouette FROM cand)"""


@query("balanced_choice", "I8", f"""WITH {CAND_SQL}, s AS (SELECT category, candidate, min(n) / sum(n) AS ms, max(silhouette) AS sil FROM q GROUP BY 1, 2), ok AS (SELECT * FROM s WHERE ms >= 0.15::DOUBLE)
  SELECT c.category, arg_max(candidate, (sil, candidate)) AS candidate, {R('max(sil)')} AS silhouette FROM (SELECT DISTINCT category FROM s) c LEFT JOIN ok USING (category) GROUP BY 1""")
def _(t):
    from pyspark.sql import Window as W

    u = F.col("user_id") % 4
    c = t.events.groupBy(F.col("event_type").alias("category"), F.concat(F.lit("c"), u.cast("string")).alias("candidate"),
                         F.when(F.col("value") < 20, 0).when(F.col("value") < u * 40 + 60, 1).otherwise(2).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("category", "candidate")
    c = c.withColumn("silhouette", F.sum(F.col("n") * F.col("cluster")).over(w) / F.sum("n").over(w))
    return rounded(I.balanced_choice(c))


@query("balanced_selection", "I8")
def _(t):
    d = vectors(t).withColumn("category", F.when(F.col("label") < 5, "a").otherwise("b"))
    return rounded(I.balanced_selection(d, "category"))


@query("subspace_clustering", "I9")
def _(t):
    return rounded(I.subspace_clustering(orders_matrix(t), ["qty_sum", "qty_mean", "price_sum", "price_max", "disc_mean", "tax_mean"],
                                         {"amount": ["QTY", "price"], "rates": ["disc", "tax"]}))


PROF_SQL = f"WITH {VECTORS_SQL}, lg AS (SELECT label, 'e' || p AS feature, x[p] AS value FROM v, range(1, 65) r(p))"


def long_vectors(t):
    return vectors(t).select("vec_id", "label", F.posexplode("x").alias("p", "value")).select("vec_id", "label", F.concat(F.lit("e"), (F.col("p") + 1).cast("string")).alias("feature"), "value")


@query("cluster_profile", "I10", f"""{PROF_SQL}, g AS (SELECT label, feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM lg GROUP BY 1, 2)
  SELECT label, feature, n, {R('mean')} AS mean, {R('std')} AS std, (row_number() OVER (PARTITION BY label ORDER BY abs(g.mean) DESC, feature))::INT AS rank FROM g QUALIFY rank <= 10""")
def _(t):
    return rounded(I.cluster_profile(long_vectors(t), "label"))


@query("cluster_sizes", "I10", f"SELECT l_linenumber, count(*) AS n, count_if(l_returnflag = 'R') AS n_returned, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM lineitem GROUP BY 1")
def _(t):
    return rounded(I.cluster_sizes(t.lineitem.withColumn("returned", (F.col("l_returnflag") == "R").cast("int")), "l_linenumber", ["returned"]))


CD = ["qty_sum", "qty_mean", "price_max", "disc_mean", "always_one"]


@query("cohens_d", "I11", f"""WITH {ORDERS_SQL}, lg AS (SELECT y, unnest([{', '.join(f"'{c}'" for c in CD)}]) AS feature, unnest([{', '.join(CD)}]) AS value FROM m),
  q AS (SELECT feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM lg GROUP BY 1), w AS (SELECT feature, y, least(greatest(value, lo), hi) AS v FROM lg JOIN q USING (feature)),
  g AS (SELECT feature, avg(CASE WHEN y = 1 THEN v END) - avg(CASE WHEN y = 0 THEN v END) AS dm, sqrt(((count_if(y = 0) - 1) * var_samp(CASE WHEN y = 0 THEN v END) + (count_if(y = 1) - 1) * var_samp(CASE WHEN y = 1 THEN v END)) / greatest(count(*) - 2, 1)) AS sp FROM w GROUP BY 1),
  e AS (SELECT feature, CASE WHEN sp < 1e-9 THEN 0 ELSE greatest(-5, least(5, dm / sp)) END AS d FROM g) SELECT feature, {R('d')} AS d, (row_number() OVER (ORDER BY abs(e.d) DESC, feature))::INT AS rank FROM e QUALIFY rank <= 4""")
def _(t):
    return rounded(I.cohens_d(orders_matrix(t), CD, "y", 4))


SIL_SQL = f"""WITH {VECTORS_SQL}, c AS (SELECT vec_id, x, CASE WHEN vec_id % 50 = 0 THEN -1 WHEN label = 9 AND vec_id = (SELECT max(vec_id) FROM embeddings WHERE label = 9) THEN 99 ELSE label END AS cluster FROM v),
  n AS (SELECT cluster, count(*) AS n FROM c WHERE cluster >= 0 GROUP BY 1), s AS (SELECT a.vec_id, a.cluster AS own, b.cluster, sum({{d}}) AS s FROM c a JOIN c b ON a.cluster >= 0 AND b.cluster >= 0 GROUP BY 1, 2, 3),
  g AS (SELECT vec_id, max(CASE WHEN own = s.cluster THEN n END) AS n, max(CASE WHEN own = s.cluster THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> s.cluster THEN s / n END) AS b FROM s JOIN n ON n.cluster = s.cluster GROUP BY 1)
  SELECT {R('avg(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM g"""


def clustered(t):
    last = t.embeddings.filter(F.col("label") == 9).agg(F.max("vec_id").alias("m")).scalar()
    return vectors(t).withColumn("cluster", F.when(F.col("vec_id") % 50 == 0, -1).when((F.col("label") == 9) & (F.col("vec_id") == last), 99).otherwise(F.col("label")).cast("bigint"))


@query("silhouette", "J1", SIL_SQL.format(d="list_distance(a.x, b.x)"))
def _(t):
    return rounded(J.silhouette(clustered(t)))


@query("silhouette_squared", "J1", SIL_SQL.format(d="pow(list_distance(a.x, b.x), 2)"))
def _(t):
    return rounded(J.silhouette_squared(clustered(t).filter(F.col("cluster") >= 0)))


@query("variance_ratios", "J2", f"""WITH {VECTORS_SQL}, lg AS (SELECT vec_id, label, p, x[p] AS val FROM v, range(1, 65) r(p)), cm AS (SELECT label, p, avg(val) AS m, count(*) AS n FROM lg GROUP BY 1, 2), gm AS (SELECT p, avg(val) AS g FROM lg GROUP BY 1),
  bt AS (SELECT sum(n * pow(m - g, 2)) AS b FROM cm JOIN gm USING (p)), ds AS (SELECT vec_id, label, sum(pow(val - m, 2)) AS d2 FROM lg JOIN cm USING (label, p) GROUP BY 1, 2), wt AS (SELECT sum(d2) AS w, count(*) AS nn FROM ds),
  sc AS (SELECT label, avg(sqrt(d2)) AS s FROM ds GROUP BY 1), pr AS (SELECT a.label AS i, b.label AS j, sqrt(sum(pow(a.m - b.m, 2))) AS gap FROM cm a JOIN cm b ON a.p = b.p AND a.label <> b.label GROUP BY 1, 2),
  rr AS (SELECT i, max((si.s + sj.s) / gap) AS r FROM pr JOIN sc si ON si.label = i JOIN sc sj ON sj.label = j GROUP BY 1), k AS (SELECT count(*)::INT AS k, avg(r) AS db FROM rr)
  SELECT k, {R('b * (nn - k) / (w * (k - 1))')} AS calinski_harabasz, {R('db')} AS davies_bouldin FROM bt, wt, k""")
def _(t):
    return rounded(J.variance_ratios(vectors(t), cluster="label"))


@query("label_agreement_scores", "J3", f"""WITH c AS (SELECT l_returnflag AS t, l_linenumber AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT t, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT c, sum(n) AS n, max(n) AS top FROM c GROUP BY 1), nn AS (SELECT sum(n)::DOUBLE AS tot FROM c),
  pa AS (SELECT sum(n * (n - 1) / 2) AS p, -sum(n / tot * ln(n / tot)) AS h FROM a, nn), pb AS (SELECT sum(b.n * (b.n - 1) / 2) AS p, -sum(n / tot * ln(n / tot)) AS h, sum(top) AS top FROM b, nn), pc AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n / tot * ln((n / tot) / ((an / tot) * (bn / tot)))) AS mi FROM (SELECT c.n, a.n AS an, b.n AS bn FROM c JOIN a USING (t) JOIN b USING (c)), nn)
  SELECT {R('(pc.p - pa.p * pb.p / (tot * (tot - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (tot * (tot - 1) / 2))')} AS ari, {R('mi / ((pa.h + pb.h) / 2)')} AS nmi, {R('top / tot')} AS purity FROM pa, pb, pc, nn""")
def _(t):
    return rounded(J.label_agreement_scores(t.lineitem, "l_returnflag", "l_linenumber"))


SC_SQL = "sc AS (SELECT event_type AS fault, 'm' || (user_id % 4) AS method, avg(value) / 70 - 0.3 * (user_id % 4 = 0)::INT AS silhouette FROM events GROUP BY 1, 2, user_id % 4)"


def fault_scores(t):
    u = F.col("user_id") % 4
    g = t.events.groupBy(F.col("event_type").alias("fault"), u.alias("u")).agg(F.avg("value").alias("v"))
    return g.select("fault", F.concat(F.lit("m"), F.col("u").cast("string")).alias("method"), (F.col("v") / 70 - F.when(F.col("u") == 0, 0.3).otherwise(0.0)).alias("silhouette"))


@query("best_method_per_fault", "J4", f"""WITH {SC_SQL}, b AS (SELECT fault, arg_max(method, (silhouette, method)) AS method, max(silhouette) AS s FROM sc GROUP BY 1)
  SELECT fault, method, {R('s')} AS silhouette, CASE WHEN s >= 0.5 THEN 'strong' WHEN s >= 0.25 THEN 'reasonable' ELSE 'weak' END AS grade,
    CASE WHEN s > 0.7 THEN 'strong' WHEN s >= 0.5 THEN 'reasonable' WHEN s >= 0.25 THEN 'weak' ELSE 'poor' END AS grade4, count(*) OVER (PARTITION BY method) AS wins FROM b""")
def _(t):
    return rounded(J.best_method_per_fault(fault_scores(t)))


@query("method_statistics", "J4", f"WITH {SC_SQL} SELECT method, {R('avg(silhouette)')} AS mean, {R('stddev_samp(silhouette)')} AS std, {R('min(silhouette)')} AS min, {R('max(silhouette)')} AS max FROM sc GROUP BY 1")
def _(t):
    return rounded(J.method_statistics(fault_scores(t)))


@query("overall_statistics", "J4", f"WITH {SC_SQL} SELECT {R('avg(silhouette)')} AS mean, {R('min(silhouette)')} AS min, {R('max(silhouette)')} AS max, {R('median(silhouette)')} AS median FROM sc")
def _(t):
    return rounded(J.overall_statistics(fault_scores(t)))


@query("fault_method_table", "J4", f"WITH {SC_SQL} SELECT fault, " + ", ".join(f"{R(f'''max(CASE WHEN method = 'm{i}' THEN silhouette END)''')} AS m{i}" for i in range(4)) + " FROM sc GROUP BY 1")
def _(t):
    return rounded(J.fault_method_table(fault_scores(t), [f"m{i}" for i in range(4)]))
