"""Models that are saved, loaded in another session and used in a stream."""

import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import functions as F

from faultspark.functions.iterate import shared_folder
from faultspark.operators import bundles as B
from faultspark.plans import bundles as Q, load_all
from faultspark.plans.registry import Tables
from faultspark.streaming import streams as N
from tests.conftest import FOLDER


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), F.sin("id").alias("b"), F.lit(3.0).alias("same"))
    return d.withColumn("y", (F.col("a") + F.col("b") > 3).cast("int"))


@pytest.mark.parametrize("make", [lambda: None, LogisticRegression, lambda: LinearSVC(maxIter=20)])
def test_a_loaded_bundle_scores_the_same(spark, rows, make):
    fitted = B.fit_bundle(rows.filter("id < 300"), ["a", "b", "same"], "y", make())
    path = shared_folder(spark, "bundle-test")
    B.save_bundle(fitted, path, spark)
    loaded = B.load_bundle(spark.newSession(), path)
    assert (loaded.columns, loaded.label, loaded.threshold) == (fitted.columns, "y", fitted.threshold)
    # other order and more columns
    test = rows.select(F.lit(1).alias("features"), "b", "id", "same", "y", F.col("a").cast("int").alias("a"))
    one, two = ({r["id"]: (r["score"], r["y_pred"]) for r in m.score(d).select("id", "score", "y_pred").collect()} for m, d in ((fitted, rows), (loaded, test)))
    assert one.keys() == two.keys() and all(abs(one[i][0] - two[i][0]) <= 1e-12 and one[i][1] == two[i][1] for i in one)
    right = {r["id"]: r["y"] for r in rows.collect()}
    assert sum(one[i][1] == right[i] for i in one) > 360
    B.save_bundle(fitted, path, spark)  # over the earlier one
    assert B.load_bundle(spark, path).columns == ["a", "b", "same"]


def test_rows_without_a_feature_get_no_score(spark, rows):
    m = B.fit_bundle(rows, ["a", "b"], "y", LogisticRegression())
    odd = rows.limit(1).select("id", "y", F.col("a"), F.lit(None).cast("double").alias("b")).unionByName(rows.limit(1).select("id", "y", F.lit(float("nan")).alias("a"), "b"))
    assert m.score(odd).count() == 0 and m.score(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="b"):
        m.score(rows.drop("b"))


def test_scaled_rows_use_the_training_moments(spark, rows):
    m = B.fit_bundle(rows.filter("id < 70"), ["a", "same"], "y", LogisticRegression())
    got = m.scaled(rows.filter("id >= 70")).select("a", "x").limit(5).collect()
    mean, std = rows.filter("id < 70").agg(F.avg("a"), F.stddev_samp("a")).first()
    assert all(r["x"] == pytest.approx([(r["a"] - mean) / std, 0.0]) for r in got)


def test_a_stream_scores_as_a_batch(spark):
    t = Tables(spark, FOLDER)
    bundle = Q.row_bundle(t)
    batch = {(r["event_id"], round(r["score"], 9)) for r in Q.alerts(t.events, bundle).select("event_id", "score").collect()}
    stream = {(r["event_id"], round(r["score"], 9)) for r in N.drain(Q.alerts(Q.events(t), bundle).select("event_id", "score")).collect()}
    assert batch and batch == stream


def test_registered_bundles(spark):
    t = Tables(spark, FOLDER)
    q = load_all()
    got = q["model_bundle"].build(t).collect()
    assert got and all(r["same"] for r in got) and sum(r["y"] == r["y_pred"] for r in got) >= 0.6 * len(got)
    curve = q["probability_curve_trained"].build(t).collect()
    first = {r["series_id"]: r["proba"] for r in curve if r["mult"] == 0}
    assert first == {r["series_id"]: r["score"] for r in got}


def test_models_on_all_and_on_early_columns(spark):
    got = load_all()["pretrigger_comparison"].build(Tables(spark, FOLDER)).collect()
    assert {(r["columns"], r["model"]) for r in got} == {(c, m) for c in ("all", "pre_trigger") for m in ("logistic_regression", "random_forest", "boosted_trees", "svm")}
    assert {r["n_features"] for r in got if r["columns"] == "pre_trigger"} == {7} and {r["n_features"] for r in got if r["columns"] == "all"} == {13}


def test_early_fault_stage(spark):
    got = load_all()["early_fault_stage"].build(Tables(spark, FOLDER)).collect()
    assert {r["model"] for r in got} == {"random_forest", "isolation_forest", "lof", "mahalanobis", "pca_reconstruction", "ensemble", "dbscan"}
