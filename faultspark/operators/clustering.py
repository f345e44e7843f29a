"""Sub-type discovery: clusterers, consensus, selection of balanced structure, profiles."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.exprs import ratio
from ..functions.graph import connected_components
from ..functions.iterate import cut_lineage
from ..functions.ordering import agg_with_quantiles, with_position
from ..functions.parallel import run_all
from . import many_clusterings as many
from .anomaly import dbscan
from .cluster_metrics import silhouette_squared, variance_ratios
from .matrix import standardize_arrays, winsorize
from .neighbours import knn


def kmeans(df: DataFrame, k: int, n_init: int = 10, seed: int = 42, vec: str = "x") -> tuple[DataFrame, float]:
    """Labels and inertia of the best of ``n_init`` starts."""
    df = df.withColumn("__v", array_to_vector(vec)).persist()  # one pass over it per iteration
    best = None
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="cluster").fit(df)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    df.unpersist()
    return best.transform(df).drop("__v"), float(best.summary.trainingCost)


def gmm(df: DataFrame, k: int, seed: int = 42, n_init: int = 1, vec: str = "x") -> DataFrame:
    """Full-covariance mixture on all columns of ``vec``, with membership probabilities."""
    rows = cut_lineage(df.select(F.lit(0).alias("g"), F.xxhash64(vec).alias("id"), F.col(vec).alias("x")))
    blocks = many.stored(rows)
    m = many.fit_mixtures(blocks, many.best_centres(rows, [(0, k)], n_init, seed, blocks))[0]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, _ = m.membership(batch.column(vec).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.argmax(axis=1), pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "cluster", "probability"])

    return df.mapInArrow(run, df.select("*", F.lit(0).alias("cluster"), F.array(F.lit(0.0)).alias("probability")).schema)


def hierarchical(df: DataFrame, k: int, seed: int = 42, vec: str = "x") -> DataFrame:
    """Divisive hierarchy; the distributed counterpart of agglomerative clustering."""
    d = df.withColumn("__v", array_to_vector(vec)).persist()
    m = BisectingKMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(d)
    d.unpersist()
    return m.transform(d).drop("__v")


def graph_clustering(df: DataFrame, k: int, neighbours: int = 5, id_: str = "vec_id", vec: str = "x") -> DataFrame:
    """Power iteration on the neighbour graph of all rows: (id, cluster)."""
    e = knn(df, df, neighbours, id_, vec, exclude_self=True)
    pairs = e.select(F.least("id", "nid").alias("src"), F.greatest("id", "nid").alias("dst"), (F.lit(1.0) / (1.0 + F.col("dist"))).alias("weight"))
    g = pairs.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return PowerIterationClustering(k=k, maxIter=20, weightCol="weight", initMode="degree").assignClusters(g)


def coassociation(labels: DataFrame, methods: list[str]) -> DataFrame:
    """Share of methods that put two rows together, for every pair of label combinations.

    Rows with the same labels under every method behave alike, so pairs are formed
    between distinct combinations (at most the product of the cluster counts) and carry
    row counts; no row pairs are built.
    """
    sig = labels.groupBy(*methods).agg(F.count(F.lit(1)).alias("n")).withColumn("sig", F.concat_ws(",", *methods))
    long = sig.select("sig", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("bigint").alias("c")) for m in methods])).alias("p")).select("sig", "n", "p.m", "p.c")
    a = long.select(F.col("sig").alias("sig_a"), F.col("n").alias("n_a"), "m", "c")
    b = long.select(F.col("sig").alias("sig_b"), F.col("n").alias("n_b"), "m", "c")
    return a.join(b, ["m", "c"]).groupBy("sig_a", "sig_b", "n_a", "n_b").agg((F.count(F.lit(1)) / len(methods)).alias("share"))


def agreeing(labels: DataFrame, methods: list[str], tau: float) -> DataFrame:
    """Pairs of label combinations (sig_a, sig_b, share) that agree in at least ``tau`` of the methods.

    Who agrees in t of m methods agrees in one of any m - t + 1; the join is on those methods
    that tell most combinations apart, so a method with one huge cluster joins nothing as long
    as t > 1. A pair that meets in several of them is kept where it meets first.
    """
    need = max(1, math.ceil(tau * len(methods) - 1e-9))
    sig = cut_lineage(labels.groupBy(*methods).agg(F.count(F.lit(1)).alias("n")).withColumn("sig", F.concat_ws(",", *methods)))
    # pairs that a method would join: the sum of its clusters' squared sizes
    size = [sig.groupBy(m).agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0 for m in methods]
    chosen = [m for _, m in sorted(zip(size, methods))][: len(methods) - need + 1]
    row = F.array(*[F.col(m).cast("bigint") for m in methods])
    keyed = sig.select("sig", row.alias("l"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(m).cast("bigint").alias("c")) for i, m in enumerate(chosen)])).alias("p")).select("sig", "l", "p.i", "p.c")
    a, b = keyed.select(F.col("sig").alias("sig_a"), F.col("l").alias("la"), "i", "c"), keyed.select(F.col("sig").alias("sig_b"), F.col("l").alias("lb"), "i", "c")
    same = F.zip_with("la", "lb", lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
    at = F.array(*[F.get("__same", F.lit(methods.index(m))) for m in chosen])
    pairs = a.join(b, ["i", "c"]).withColumn("__same", same).filter(F.array_position(at, 1) == F.col("i") + 1)
    share = F.aggregate("__same", F.lit(0), lambda s, x: s + x) / len(methods)
    return pairs.select("sig_a", "sig_b", share.alias("share")).filter(F.col("share") >= need / len(methods) - 1e-9)


def consensus(labels: DataFrame, methods: list[str], id_: str, tau: float = 0.5) -> DataFrame:
    """Components of combinations that agree in at least ``tau`` of the methods, back on rows."""
    co = agreeing(labels, methods, tau)
    names = labels.select(F.concat_ws(",", *methods).alias("sig")).distinct().withColumn("node", F.dense_rank().over(W.orderBy("sig")).cast("bigint"))
    e = co.join(names.select(F.col("sig").alias("sig_a"), F.col("node").alias("a")), "sig_a").join(names.select(F.col("sig").alias("sig_b"), F.col("node").alias("b")), "sig_b").select("a", "b")
    comp = connected_components(e)
    named = names.join(comp, "node", "left").select("sig", F.coalesce("component", "node").alias("cluster"))
    return labels.withColumn("sig", F.concat_ws(",", *methods)).join(named, "sig").select(id_, "cluster")


def _categories(df: DataFrame, category: str, minimum: int) -> dict:
    """Categories of at least ``minimum`` rows and their sizes, numbered in their order."""
    return {c: n for c, n in sorted((r[0], r[1]) for r in df.filter(F.col(category).isNotNull()).groupBy(category).count().collect()) if n >= minimum}


def _numbered(df: DataFrame, category: str, names: list, id_: str, vec: str) -> DataFrame:
    """(id, g, x) of the named categories."""
    g = (F.array_position(F.array(*[F.lit(c) for c in names]), F.col(category)) - 1).cast("int") if names else F.lit(-1)
    return df.select(F.col(id_).alias("id"), g.alias("g"), F.col(vec).alias("x")).filter("g >= 0")


def dbscan_per_group(rows: DataFrame, k: int = 5, pct: float = 75, min_samples: int = 5) -> DataFrame:
    """(id, g, cluster): one density clustering of all groups, each with its own radius, the
    percentile of its k-th neighbour distances.

    A coordinate that sets groups apart keeps them from being neighbours; dividing by its
    radius gives every group the radius 1.
    """
    far = rows.agg(F.max(F.sqrt(F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda s, v: s + v)))).first()[0] or 1.0
    apart = lambda x, step: F.concat(x, F.array(F.col("g") * F.lit(float(step))))
    near = knn(*[rows.select("id", apart(F.col("x"), 4 * far + 1).alias("x"))] * 2, k, "id", "x").filter(F.col("rank") == k)
    # searches are cut off once made: what follows reads them several times
    near = cut_lineage(near.select("id", "dist").join(rows.select("id", "g"), "id"))
    eps = cut_lineage(agg_with_quantiles(near, ["g"], [], {"eps": ("dist", pct / 100.0)}))
    scaled = rows.join(eps, "g").withColumn("e", F.greatest("eps", F.lit(1e-9)))
    widest = far / max(scaled.agg(F.min("e")).first()[0] or 1.0, 1e-9)
    d = cut_lineage(scaled.select("id", "g", apart(F.transform("x", lambda v: v / F.col("e")), 2 * widest + 4).alias("x")))
    found = cut_lineage(dbscan(d, 1.0, min_samples, "id", "x").join(d.select("id", "g"), "id"))
    own = with_position(found.filter("cluster >= 0").select("g", "cluster").distinct(), ["g"], ["cluster"], "number")
    return found.join(own, ["g", "cluster"], "left").select("id", "g", F.coalesce("number", F.lit(-1)).cast("bigint").alias("cluster"))


def cluster_per_category(df: DataFrame, category: str, minimum: int = 5, n_init: int = 10, id_: str = "vec_id", vec: str = "x") -> DataFrame:
    """Cluster each large enough category on its own with four methods: (id, category, method, cluster).

    All categories are fitted in the same scans.
    """
    size = _categories(df, category, minimum)
    names = list(size)
    rows = cut_lineage(_numbered(df, category, names, id_, vec))
    wanted = [(g, max(1, min(3, n // 2))) for g, n in enumerate(size.values())]
    blocks = many.stored(rows)
    centres = many.best_centres(rows, wanted, n_init, blocks=blocks)
    trees = [t for t in many.fit_trees(rows, dict(wanted), blocks=blocks) if t.k == dict(wanted)[t.g]]
    methods = {"kmeans": centres, "hierarchical": trees, "gmm": many.fit_mixtures(blocks, centres)}
    order = [F.struct(F.lit(m).alias("method"), F.get("labels", F.lit(i)).cast("bigint").alias("cluster")) for i, m in enumerate(methods)]
    flat = many.with_labels(rows, [m for found in methods.values() for m in found]).select("id", "g", F.explode(F.array(*order)).alias("l")).select("id", "g", "l.method", "l.cluster")
    out = flat.unionByName(dbscan_per_group(rows).select("id", "g", F.lit("dbscan").alias("method"), "cluster"))
    kind = dict(df.dtypes)[category]
    name = F.get(F.array(*[F.lit(c) for c in names]), F.col("g")) if names else F.lit(None).cast(kind)
    return out.select("id", name.alias("category"), "method", "cluster")


def k_candidates(df: DataFrame, ks: list[int], n_init: int = 10, id_: str = "vec_id", vec: str = "x", measure: str = "euclidean") -> DataFrame:
    """Silhouette, variance ratios and inertia for each k; all k and starts share their scans."""
    rows = cut_lineage(df.select(F.col(id_).alias("id"), F.lit(0).alias("g"), F.col(vec).alias("x")))
    models = many.best_centres(rows, [(0, k) for k in ks], n_init)
    labelled = cut_lineage(many.with_labels(rows, models))
    score = _silhouettes(labelled, measure)
    out = []
    for i, m in enumerate(models):
        v = variance_ratios(labelled.select("x", F.get("labels", F.lit(i)).alias("cluster"))).first()
        out.append((m.k, score[0, i], v["calinski_harabasz"], v["davies_bouldin"], m.cost))
    return df.sparkSession.createDataFrame(out, "k int, silhouette double, calinski double, davies_bouldin double, inertia double")


def _silhouettes(labelled: DataFrame, measure: str, wanted: set[tuple[int, int]] | None = None) -> dict[tuple[int, int], float]:
    """Silhouette of each (g, slot), or of the ``wanted``: Euclidean over all pairs in blocks, or
    with squared distances from centroids, which is linear in rows."""
    if measure not in ("euclidean", "squared"):
        raise ValueError(f"unknown measure {measure}")
    if wanted is not None and not wanted:
        return {}
    if measure == "euclidean":
        return {(r["g"], r["slot"]): r["silhouette"] for r in many.silhouettes(labelled, wanted).collect()}
    slots = labelled.groupBy("g").agg(F.max(F.size("labels"))).collect()
    return {(g, i): silhouette_squared(labelled.filter(F.col("g") == g).select("x", F.get("labels", F.lit(i)).alias("cluster"))).first()[0]
            for g, n in slots for i in range(n) if wanted is None or (g, i) in wanted}


def find_optimal_k(metrics: DataFrame) -> DataFrame:
    """Score each k by scaled silhouette and inverted Davies-Bouldin; mark the best (first on a tie)."""
    b = metrics.agg(F.min("silhouette").alias("s0"), F.max("silhouette").alias("s1"), F.min("davies_bouldin").alias("d0"), F.max("davies_bouldin").alias("d1"))
    s = F.coalesce(ratio(F.col("silhouette") - F.col("s0"), F.col("s1") - F.col("s0")), F.lit(0.5))
    d = F.coalesce(1 - ratio(F.col("davies_bouldin") - F.col("d0"), F.col("d1") - F.col("d0")), F.lit(0.5))
    scored = metrics.join(b).select("k", "silhouette", "davies_bouldin", ((s + d) / 2).alias("score"))  # one-row bounds
    best = scored.agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k")).scalar()
    return scored.withColumn("optimal", F.col("k") == best)


def balanced_choice(candidates: DataFrame, min_frac: float = 0.15) -> DataFrame:
    """Best silhouette per category among labelings whose smallest cluster is large enough; others get none.

    ``candidates`` has category, candidate, cluster, n, silhouette.
    """
    share = candidates.groupBy("category", "candidate").agg(ratio(F.min("n"), F.sum("n")).alias("min_share"), F.max("silhouette").alias("silhouette"))
    ok = share.filter(F.col("min_share") >= min_frac).groupBy("category").agg(
        F.max_by("candidate", F.struct("silhouette", "candidate")).alias("candidate"), F.max("silhouette").alias("silhouette"))
    return share.select("category").distinct().join(ok, "category", "left")


def balanced_selection(df: DataFrame, category: str, ks: range = range(2, 7), min_frac: float = 0.15, minimum: int = 20, n_init: int = 10,
                       id_: str = "vec_id", vec: str = "x", measure: str = "euclidean") -> DataFrame:
    """Winsorise and scale each category, try clusterers and k, keep the best balanced labeling.

    Every category, k, start and method is fitted in the same scans. Labelings with a cluster
    below ``min_frac`` can't be chosen, whatever their silhouette; those of all others come from
    one computation of the distances.
    """
    size = _categories(df, category, minimum)
    names = list(size)
    schema = f"category {dict(df.dtypes)[category]}, candidate string, cluster int, n bigint, silhouette double"
    if not names:
        return balanced_choice(df.sparkSession.createDataFrame([], schema), min_frac)
    rows = _numbered(df, category, names, id_, vec)
    cols = [f"c{i}" for i in range(rows.select(F.size("x")).first()[0])]
    wide = rows.select("id", "g", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(cols)])
    clipped = cut_lineage(winsorize(wide, cols, ["g"]).select("id", "g", F.array(*cols).alias("x")))
    moments = clipped.groupBy("g").agg(Summarizer.metrics("mean", "std", "count").summary(array_to_vector("x")).alias("s")).collect()
    scale = {r["g"]: (r["s"]["mean"].toArray(), r["s"]["std"].toArray() * ((r["s"]["count"] - 1) / r["s"]["count"]) ** 0.5) for r in moments}
    mean = F.array(*[F.array(*[F.lit(float(v)) for v in scale[g][0]]) for g in range(len(names))])
    std = F.array(*[F.array(*[F.lit(float(v) if v > 0 else 1.0) for v in scale[g][1]]) for g in range(len(names))])
    scaled = F.zip_with(F.zip_with("x", F.get(mean, F.col("g")), lambda x, m: x - m), F.get(std, F.col("g")), lambda x, s: x / s)
    rows = cut_lineage(clipped.select("id", "g", scaled.alias("x")))
    wanted = [(g, k) for g, n in enumerate(size.values()) for k in ks if k <= min(max(ks), n // 5 - 1)]
    blocks = many.stored(rows)

    def centres_and_mixtures():
        centres = many.best_centres(rows, wanted, n_init, blocks=blocks)
        return centres, many.fit_mixtures(blocks, centres)

    (centres, mixtures), trees = run_all([centres_and_mixtures, lambda: many.fit_trees(rows, {g: k for g, k in wanted}, blocks=blocks)])
    models = [*centres, *[t for t in trees if (t.g, t.k) in wanted], *mixtures]
    labelled = cut_lineage(many.with_labels(rows, models))
    counts = many.sizes(labelled).collect()  # one row for each cluster of a model
    of: dict[tuple[int, int], list[int]] = {}
    for r in counts:
        of.setdefault((r["g"], r["slot"]), []).append(r["n"])
    score = _silhouettes(labelled, measure, {at for at, n in of.items() if min(n) / sum(n) >= min_frac})
    names_of = {g: [m.name for m in models if m.g == g] for g in range(len(names))}
    cand = [(names[r["g"]], names_of[r["g"]][r["slot"]], r["cluster"], r["n"], score.get((r["g"], r["slot"]))) for r in counts]
    return balanced_choice(df.sparkSession.createDataFrame(cand, schema), min_frac)


def subspace_clustering(df: DataFrame, cols: list[str], groups: dict[str, list[str]], ks: range = range(2, 8), n_init: int = 10, measure: str = "euclidean", id_: str = "event_id") -> DataFrame:
    """Best k by silhouette on the columns of each group; groups with fewer than 3 columns are skipped."""
    rows = []
    for name, patterns in groups.items():
        use = [c for c in cols if any(p.lower() in c.lower() for p in patterns)]
        if len(use) < 3:
            continue
        d = df.select(F.col(id_).alias("id"), F.lit(0).alias("g"), F.array(*[F.col(c).cast("double") for c in use]).alias("x"))
        d = cut_lineage(standardize_arrays(d, d))
        labelled = cut_lineage(many.with_labels(d, many.best_centres(d, [(0, k) for k in ks], n_init)))
        score = _silhouettes(labelled, measure)
        best = max(range(len(ks)), key=lambda i: (score[0, i], -ks[i]))
        rows.append((name, len(use), ks[best], score[0, best]))
    return df.sparkSession.createDataFrame(rows, "subspace string, n_features int, best_k int, silhouette double")


def cluster_profile(long: DataFrame, cluster: str, k: int = 10) -> DataFrame:
    """Features with the largest absolute mean in each cluster."""
    g = long.groupBy(cluster, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    r = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc(F.abs("mean")), "feature"))
    return g.withColumn("rank", r).filter(F.col("rank") <= k)


def cluster_sizes(df: DataFrame, cluster: str, labels: list[str]) -> DataFrame:
    """Size, share and label counts of each cluster."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(l) == 1).alias(f"n_{l}") for l in labels]).withColumn("share", ratio(F.col("n"), total))


def cohens_d(df: DataFrame, cols: list[str], cluster: str, k: int) -> DataFrame:
    """Effect size of cluster 1 against 0 on winsorised columns, clipped to +-5, largest first."""
    w = winsorize(df.select(cluster, *cols), cols, [])
    long = w.unpivot([cluster], cols, "feature", "value")
    v0, v1 = F.when(F.col(cluster) == 0, F.col("value")), F.when(F.col(cluster) == 1, F.col("value"))
    g = long.groupBy("feature").agg(F.avg(v0).alias("m0"), F.avg(v1).alias("m1"), F.var_samp(v0).alias("s0"), F.var_samp(v1).alias("s1"), F.count(v0).alias("n0"), F.count(v1).alias("n1"))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("s0") + (F.col("n1") - 1) * F.col("s1")) / F.greatest(F.col("n0") + F.col("n1") - 2, F.lit(1)))
    d = F.when(pooled < 1e-9, 0.0).otherwise(F.coalesce(F.try_divide(F.col("m1") - F.col("m0"), pooled), F.lit(0.0)))
    g = g.select("feature", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), d)).alias("d"))
    r = F.row_number().over(W.orderBy(F.desc(F.abs("d")), "feature"))  # one row per feature
    return g.withColumn("rank", r).filter(F.col("rank") <= k)
