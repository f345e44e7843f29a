"""Queries for supervised models on the embeddings table."""

from functools import partial

from pyspark.sql import functions as F

from ..operators import anomaly as A, models as G
from ..operators.splits import stratified_split
from .matrixdata import vectors
from .registry import query
from .series import rounded

FOREST = partial(G.fit_forest, trees=100, depth=10)
LABELS = ["b0", "b1", "high"]


def labelled(t):
    l = F.col("label")
    return vectors(t).select("vec_id", "x", l, (l < 4).cast("int").alias("y"), (l % 2).cast("int").alias("b0"), (F.floor(l / 2) % 2).cast("int").alias("b1"), (l >= 7).cast("int").alias("high"))


def parts(t):
    d = stratified_split(labelled(t), "vec_id", "y", 0.3)
    return d.filter("split = 'train'"), d.filter("split = 'test'")


def binary(name, code, fit):
    def build(t):
        tr, te = parts(t)
        return rounded(fit(tr, "y")(te).select("vec_id", "y", "y_pred", "score"))
    query(name, code)(build)


binary("logistic_regression", "G1", G.fit_logistic)
binary("random_forest", "G2", FOREST)
binary("random_forest_balanced", "G2", partial(FOREST, weighted=True))
binary("boosted_trees", "G3", G.fit_boosted)
binary("svm_rbf", "G4", partial(G.fit_svm, features=200, rounds=100))
binary("mlp", "G12", partial(G.fit_mlp, hidden=(64, 32), rounds=100))


def multilabel(name, code, fit):
    def build(t):
        tr, te = parts(t)
        return fit(tr)(te).select("vec_id", *[f"pred_{l}" for l in LABELS])
    query(name, code)(build)


multilabel("binary_relevance", "G5", lambda tr: G.fit_binary_relevance(tr, LABELS, FOREST))
multilabel("classifier_chain", "G6", lambda tr: G.fit_classifier_chain(tr, LABELS, FOREST))
multilabel("classifier_chain_random_order", "G6", lambda tr: G.fit_classifier_chain(tr, LABELS, FOREST, order=G.random_order(3)))
multilabel("label_powerset", "G7", lambda tr: G.fit_label_powerset(tr, LABELS, fit=FOREST))


@query("powerset_classes", "G7", """WITH e AS (SELECT vec_id, label % 2 AS b0, (label // 2) % 2 AS b1, (label >= 7)::INT AS high FROM embeddings), c AS (SELECT b0, b1, high, min(vec_id) AS first_id, count(*) AS n FROM e GROUP BY 1, 2, 3)
  SELECT b0, b1, high, first_id, n, (row_number() OVER (ORDER BY first_id) - 1)::INT AS class_id FROM c""")
def _(t):
    return G.powerset_classes(labelled(t), LABELS, "vec_id")


@query("root_cause_classifier", "G8")
def _(t):
    tr, te = parts(t)
    m = G.fit_root_cause(tr, LABELS, FOREST)
    return m(G.with_root(te, LABELS)).select("vec_id", "root", "y_pred")


@query("subtype_classifier", "G9")
def _(t):
    tr, te = parts(t)
    d = lambda df: df.withColumn("sub", F.concat(F.lit("s"), (F.col("label") % 3).cast("string")))
    m = G.fit_subtype(d(tr), "y", 1, "sub", 50, FOREST)
    return m(d(te).filter("y = 1")).select("vec_id", "sub", "subtype_pred")


@query("model_comparison", "G10")
def _(t):
    tr, te = parts(t)
    return rounded(G.model_comparison(tr, te, "y", {"logistic": G.fit_logistic, "forest": FOREST, "boosted": G.fit_boosted, "svm": G.fit_svm}))


@query("channel_ablation", "G11")
def _(t):
    names = [f"ch{i // 16}_f{i}" for i in range(64)]
    return rounded(G.channel_ablation(labelled(t), "vec_id", "y", names, {f"without_ch{i}": [f"ch{i}"] for i in range(4)}, FOREST))


@query("top_features", "G13")
def _(t):
    tr, _ = parts(t)
    return rounded(G.top_features(FOREST(tr, "y"), [f"e{i}" for i in range(64)], 10, tr))


@query("forest_selection", "P13")
def _(t):
    tr, _ = parts(t)
    return rounded(G.top_features(FOREST(tr, "b0"), [f"e{i}" for i in range(64)], 5, tr))


@query("learning_curve", "H12")
def _(t):
    d = labelled(t).select("vec_id", "x", "y")
    return rounded(G.learning_curve(d, "vec_id", "y", [0, 1], [i / 8 for i in range(1, 9)], 5, FOREST))


@query("feature_scope_test", "L6")
def _(t):
    d = G.feature_scope_test(labelled(t).select("vec_id", "x", "y"), "vec_id", "y", {"half": list(range(32))}, 10, FOREST)
    return rounded(d.drop("values"))


@query("two_stage", "P17")
def _(t):
    tr, te = parts(t)
    flag = lambda a, b: A.isolation_forest(a, b, contamination=0.5)
    return rounded(G.two_stage(tr, te, "y", flag, FOREST).select("vec_id", "flag", "y_pred", "score"))


@query("soft_voting", "P17")
def _(t):
    tr, te = parts(t)
    return rounded(G.soft_voting(tr, "y", [G.fit_logistic, FOREST])(te).select("vec_id", "y_pred", "score"))


@query("stacking", "P17")
def _(t):
    tr, te = parts(t)
    return rounded(G.stacking(tr.drop("split"), "vec_id", "y", [G.fit_logistic, FOREST])(te).select("vec_id", "y_pred", "score"))
