"""Trained models that outlive their session: columns, scaler, classifier and threshold.

A bundle is fitted on training rows only, written with MLlib's writer to a folder that all
executors share, and scores the same in any later session, in a batch or in a stream. It
knows its columns by name, so extra columns and their order do not matter; a missing one is
an error. Rows with a null or NaN feature get no score, as a window that did not fit the
recording has none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.iterate import cut_lineage
from ..functions.parallel import run_all
from . import anomaly as A
from .matrix import is_precursor
from .metrics import binary_metrics, roc_auc
from .probes import midwindow_triggers, offset_probe
from .series import REFERENCE_DT_US, scale_samples
from .splits import stratified_split


@dataclass(frozen=True)
class Bundle:
    columns: list[str]
    label: str
    threshold: float
    model: PipelineModel

    def complete(self, df: DataFrame) -> DataFrame:
        """Rows that have every feature."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"the bundle needs the columns {missing}")
        return df.filter(reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in self.columns]))

    def score(self, df: DataFrame) -> DataFrame:
        """Complete rows with ``score`` (class 1, or the margin of a machine without
        probabilities) and ``y_pred``."""
        d = self.complete(df)
        cast = d.withColumns({f"__f{i}": F.col(c).cast("double") for i, c in enumerate(self.columns)})
        out = self.model.transform(cast)
        p = vector_to_array("__probability" if "__probability" in out.columns else "__raw")
        own = [c for c in out.columns if c.startswith("__")]
        return out.withColumn("score", F.get(p, F.lit(1))).withColumn("y_pred", (F.col("score") >= self.threshold).cast("int")).drop(*own)

    def scaled(self, df: DataFrame, vec: str = "x") -> DataFrame:
        """Complete rows with their scaled features as an array."""
        cast = self.complete(df).withColumns({f"__f{i}": F.col(c).cast("double") for i, c in enumerate(self.columns)})
        for stage in self.model.stages[:2]:
            cast = stage.transform(cast)
        out = cast.withColumn(vec, vector_to_array("__scaled"))
        return out.drop(*[c for c in out.columns if c.startswith("__")])


def _named(estimator: Estimator) -> Estimator:
    estimator = estimator.copy()
    names = {"featuresCol": "__scaled", "predictionCol": "__prediction", "rawPredictionCol": "__raw", "probabilityCol": "__probability"}
    for param, name in names.items():
        if estimator.hasParam(param):
            estimator.set(estimator.getParam(param), name)
    return estimator


def fit_bundle(train: DataFrame, columns: list[str], label: str, estimator: Estimator | None = None, threshold: float | None = None) -> Bundle:
    """Scaler and classifier from the complete rows of ``train``; a forest of 100 trees of depth 10
    unless another estimator is given. The threshold is 0.5, or 0 for a margin."""
    est = _named(estimator if estimator is not None else RandomForestClassifier(numTrees=100, maxDepth=10, seed=42))
    est.set(est.getParam("labelCol"), label)
    if threshold is None:
        threshold = 0.5 if est.hasParam("probabilityCol") else 0.0
    empty = Bundle(list(columns), label, threshold, None)
    d = empty.complete(train).select(label, *[F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(columns)])
    d = cut_lineage(d)  # read once per pass of the optimiser
    stages = [VectorAssembler(inputCols=[f"__f{i}" for i in range(len(columns))], outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__scaled", withMean=True, withStd=True), est]
    return Bundle(list(columns), label, threshold, Pipeline(stages=stages).fit(d))


def save_bundle(bundle: Bundle, path: str, spark: SparkSession) -> None:
    """Write the model and its description below ``path``, in place of an earlier bundle."""
    bundle.model.write().overwrite().save(f"{path}/model")
    about = spark.createDataFrame([(bundle.columns, bundle.label, bundle.threshold)], "columns array<string>, label string, threshold double")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    r = spark.read.parquet(f"{path}/about").first()
    return Bundle(list(r["columns"]), r["label"], r["threshold"], PipelineModel.read().session(spark).load(f"{path}/model"))


def bundle_curve(bundle: Bundle, probes: DataFrame, trigger: DataFrame, key: str, n_ref: float, ref_dt: float = REFERENCE_DT_US) -> DataFrame:
    """Probability of a trained model at every offset of every event."""
    d = bundle.score(probes).join(trigger.select(key, "dt_us"), key)
    off = F.bround(F.col("mult") * scale_samples(n_ref, "dt_us", ref_dt), 0)
    return d.select(key, "mult", (off * F.col("dt_us") / 1000.0).alias("offset_ms"), F.col("score").alias("proba"))


def bundle_midwindow(bundle: Bundle, samples: DataFrame, trigger: DataFrame, n_ref: float, early_ref: float, late_ref: float, ref_dt: float = REFERENCE_DT_US) -> DataFrame:
    """Scores of a window in the middle of each recording, where no fault is near."""
    mid = midwindow_triggers(trigger, n_ref, ref_dt).withColumn("z", F.col("mid")).drop("mid", "margin")
    return bundle.score(offset_probe(samples, mid, n_ref, early_ref, late_ref, ref_dt, [0.0]))


def _row(scored: DataFrame, label: str, name: str, n_features: int) -> DataFrame:
    m = binary_metrics(scored, label, "y_pred").drop("n")
    return m.join(roc_auc(scored, label, "score")).select(F.lit(name).alias("model"), F.lit(n_features).alias("n_features"), "accuracy", "precision", "recall", "f1", "auc")  # one row each


def four_models(train: DataFrame, test: DataFrame, columns: list[str], label: str) -> dict[str, DataFrame]:
    """Test scores of logistic regression, forest, boosted trees and a linear machine on the
    same columns, each with its own bundle."""
    kinds = {"logistic_regression": LogisticRegression(maxIter=1000), "random_forest": RandomForestClassifier(numTrees=100, maxDepth=10, seed=42),
             "boosted_trees": GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, seed=42), "svm": LinearSVC(maxIter=100)}
    made = run_all([lambda est=est: fit_bundle(train, columns, label, est) for est in kinds.values()])
    return {name: b.score(test) for name, b in zip(kinds, made)}


def pretrigger_comparison(df: DataFrame, key: str, label: str, columns: list[str], test: float = 0.3, seed: int = 42) -> DataFrame:
    """The four models on all columns and on those that only look before the trigger."""
    d = cut_lineage(stratified_split(df, key, label, test, seed=seed))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    early = {r[0] for r in names.filter(is_precursor("feature")).collect()}
    sets = {"all": columns, "pre_trigger": [c for c in columns if c in early]}
    out = []
    for scope, cols in sets.items():
        for name, scored in four_models(d.filter("split = 'train'"), d.filter("split = 'test'"), cols, label).items():
            out.append(_row(scored, label, name, len(cols)).withColumn("columns", F.lit(scope)))
    return reduce(DataFrame.unionByName, out)


def early_fault_stage(df: DataFrame, key: str, label: str, columns: list[str], path: str, test: float = 0.3, seed: int = 42) -> DataFrame:
    """A forest and five detectors on pre-trigger columns, their scores averaged after min-max
    scaling, and the forest's bundle written to ``path``.

    Detectors learn from scaled training rows without their labels; the density clustering
    looks at test rows alone. Returns the test metrics of each and of the ensemble.
    """
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    early = {r[0] for r in names.filter(is_precursor("feature")).collect()}
    cols = [c for c in columns if c in early]
    d = cut_lineage(stratified_split(df, key, label, test, seed=seed))
    forest = fit_bundle(d.filter("split = 'train'"), cols, label)
    save_bundle(forest, path, df.sparkSession)
    rows = cut_lineage(forest.scaled(d).select(key, label, "split", "x"))
    train, held = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")
    one = lambda f: f.select(key, "score", F.col("flag").alias("y_pred"))
    lof = A.lof(train, held, id_=key).withColumnRenamed("id", key)
    found = {
        "random_forest": forest.score(d.filter("split = 'test'")).select(key, "score", "y_pred"),
        "isolation_forest": one(A.isolation_forest(train, held, key)),
        "lof": lof.select(key, F.col("lof").alias("score"), F.col("flag").alias("y_pred")),
        "mahalanobis": one(A.mahalanobis_lw(train, held, k=min(30, len(cols)))),
        "pca_reconstruction": one(A.pca_reconstruction(train, held)),
    }
    truth = held.select(key, label)
    found = {n: cut_lineage(s) for n, s in found.items()}
    out = [_row(s.join(truth, key), label, n, len(cols)) for n, s in found.items()]
    wide = truth
    for n, s in found.items():
        wide = wide.join(s.select(key, F.col("score").alias(n)), key)
    together = A.minmax_ensemble(wide, list(found), "score").withColumn("y_pred", (F.col("score") > 0.5).cast("int"))
    out.append(_row(together, label, "ensemble", len(cols)))
    noise = A.dbscan(held, 0.5, 5, key).select(F.col("id").alias(key), (F.col("cluster") < 0).cast("int").alias("y_pred"))
    out.append(_row(noise.join(truth, key).withColumn("score", F.col("y_pred").cast("double")), label, "dbscan", len(cols)))
    return reduce(DataFrame.unionByName, out)
