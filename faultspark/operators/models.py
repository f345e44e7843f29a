"""Supervised models: thin, leakage-safe use of MLlib on array features.

Every ``fit_*`` takes a training table with an array column ``x`` and a label and
returns a function that adds ``y_pred`` and, for two classes, ``score``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.iterate import cut_lineage
from ..functions.parallel import run_all, scan_parts
from . import metrics as H
from .splits import class_weights, stratified_split

Scorer = Callable[[DataFrame], DataFrame]


def _with_vector(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("__v", array_to_vector(vec))


def _scorer(model, vec: str, probability: bool = True) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        d = model.transform(_with_vector(df, vec))
        d = d.withColumn("y_pred", F.col("prediction").cast("int"))
        if probability:
            p = vector_to_array("probability")
            d = d.withColumn("proba", p).withColumn("score", F.get("proba", F.lit(1)))
        return d.drop("__v", "prediction", "rawPrediction", "probability")

    score.model = model
    return score


def _fit(estimator, train: DataFrame, vec: str):
    """Every pass of the optimiser is a job and more (boosted trees: some 1,000 stages), so rows are kept in as many partitions as their number asks for, not as many as the last shuffle left."""
    made = _with_vector(train, vec).persist()
    d = made.repartition(scan_parts(made, vec)).persist()
    d.count()
    made.unpersist()
    model = estimator.fit(d)
    d.unpersist()
    return model


def balanced(train: DataFrame, label: str) -> DataFrame:
    return train.join(class_weights(train, label).select(label, "weight"), label)


def fit_logistic(train: DataFrame, label: str, vec: str = "x", c: float = 1.0) -> Scorer:
    n = train.count()
    est = LogisticRegression(featuresCol="__v", labelCol=label, regParam=1.0 / (c * n), maxIter=1000, standardization=False)
    return _scorer(_fit(est, train, vec), vec)


def fit_forest(train: DataFrame, label: str, vec: str = "x", trees: int = 100, depth: int = 10, weighted: bool = False, seed: int = 42) -> Scorer:
    est = RandomForestClassifier(featuresCol="__v", labelCol=label, numTrees=trees, maxDepth=min(depth, 30), seed=seed)
    if weighted:
        train, est = balanced(train, label), est.setWeightCol("weight")
    return _scorer(_fit(est, train, vec), vec)


def fit_boosted(train: DataFrame, label: str, vec: str = "x", rounds: int = 100, depth: int = 5, rate: float = 0.1, classes: int = 2, seed: int = 42) -> Scorer:
    est = GBTClassifier(featuresCol="__v", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    if classes > 2:
        return _scorer(_fit(OneVsRest(classifier=est, featuresCol="__v", labelCol=label), train, vec), vec, probability=False)
    return _scorer(_fit(est, train, vec), vec)


def fit_svm(train: DataFrame, label: str, vec: str = "x", features: int = 200, gamma: float | None = None, c: float = 1.0, rounds: int = 100, seed: int = 42) -> Scorer:
    """RBF kernel by random Fourier features, a linear machine on them, and a sigmoid on its margin."""
    p = train.select(F.size(vec)).first()[0]
    sq = F.aggregate(F.transform(vec, lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate(vec, F.lit(0.0), lambda s, v: s + v)
    m2, m1 = train.agg(F.avg(sq) / p, F.avg(total) / p).first()
    g = gamma or 1.0 / (p * max(m2 - m1 * m1, 1e-12))
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((p, features)) * np.sqrt(2 * g), rng.uniform(0, 2 * np.pi, features)

    def lift(df: DataFrame) -> DataFrame:
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(vec).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                z = np.sqrt(2.0 / features) * np.cos(x @ w + b)
                off = pa.array(np.arange(0, z.size + 1, features, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(off, pa.array(z.ravel()))], [*batch.schema.names, "__z"])

        return df.mapInArrow(run, df.select("*", F.array(F.lit(0.0)).alias("__z")).schema)

    n = train.count()
    svc = _fit(LinearSVC(featuresCol="__v", labelCol=label, regParam=1.0 / (c * n), maxIter=rounds, tol=1e-3), lift(train), "__z")

    def margin(df: DataFrame) -> DataFrame:
        d = svc.transform(_with_vector(lift(df), "__z"))
        return d.withColumn("__m", F.array(F.get(vector_to_array("rawPrediction"), F.lit(1)))).drop("__v", "__z", "prediction", "rawPrediction")

    sigmoid = fit_logistic(margin(train), label, "__m")
    return lambda df: sigmoid(margin(df)).drop("__m")


def fit_mlp(train: DataFrame, label: str, vec: str = "x", hidden: tuple[int, ...] = (64, 32), classes: int = 2, rounds: int = 100, seed: int = 42) -> Scorer:
    p = train.select(F.size(vec)).first()[0]
    est = MultilayerPerceptronClassifier(featuresCol="__v", labelCol=label, layers=[p, *hidden, classes], maxIter=rounds, seed=seed)
    return _scorer(_fit(est, train, vec), vec)


# ---- several labels --------------------------------------------------------------------

def fit_binary_relevance(train: DataFrame, labels: list[str], fit: Callable = fit_forest, **kw) -> Scorer:
    """One model per label; adds ``pred_<label>`` and ``score_<label>``."""
    models = dict(zip(labels, run_all([lambda l=l: fit(train, l, **kw) for l in labels])))

    def score(df: DataFrame) -> DataFrame:
        for l, m in models.items():
            df = m(df).withColumnsRenamed({"y_pred": f"pred_{l}", "score": f"score_{l}"}).drop("proba")
        return df

    return score


def fit_classifier_chain(train: DataFrame, labels: list[str], fit: Callable = fit_forest, order: list[int] | None = None, vec: str = "x", **kw) -> Scorer:
    """Each model also sees the earlier labels: the true ones in training, the predicted ones later."""
    seq = [labels[i] for i in (order or range(len(labels)))]
    models, d = [], train.withColumn("__c", F.col(vec))
    for l in seq:
        models.append(fit(d, l, vec="__c", **kw))
        d = d.withColumn("__c", F.concat("__c", F.array(F.col(l).cast("double"))))

    def score(df: DataFrame) -> DataFrame:
        df = df.withColumn("__c", F.col(vec))
        for l, m in zip(seq, models):
            df = m(df).withColumnsRenamed({"y_pred": f"pred_{l}", "score": f"score_{l}"}).drop("proba")
            df = df.withColumn("__c", F.concat("__c", F.array(F.col(f"pred_{l}").cast("double"))))
        return df.drop("__c")

    return score


def random_order(n: int, seed: int = 42) -> list[int]:
    return [int(i) for i in np.random.default_rng(seed).permutation(n)]


def powerset_classes(df: DataFrame, labels: list[str], id_: str) -> DataFrame:
    """Class id of each label combination, numbered by first appearance."""
    first = df.groupBy(*labels).agg(F.min(id_).alias("first_id"), F.count(F.lit(1)).alias("n"))
    return first.withColumn("class_id", F.row_number().over(W.orderBy("first_id")) - 1)  # one row per combination


def fit_label_powerset(train: DataFrame, labels: list[str], id_: str = "vec_id", fit: Callable = fit_forest, weighted: bool = True, **kw) -> Scorer:
    """One multi-class model over label combinations; unknown classes decode to no label."""
    classes = cut_lineage(powerset_classes(train, labels, id_).select(*labels, "class_id"))
    model = fit(train.join(classes, labels), "class_id", weighted=weighted, **kw)
    back = classes.select(F.col("class_id").alias("y_pred"), *[F.col(l).alias(f"pred_{l}") for l in labels])

    def score(df: DataFrame) -> DataFrame:
        d = model(df).drop("proba", "score")
        return d.join(back, "y_pred", "left").fillna(0, [f"pred_{l}" for l in labels])

    return score


def fit_root_cause(train: DataFrame, labels: list[str], fit: Callable = fit_forest, **kw) -> Scorer:
    """Multi-class model of the first flagged label, on rows with any label."""
    d = with_root(train, labels)
    return fit(d, "root", **kw)


def with_root(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.withColumn("root", (F.array_position(F.array(*labels), 1) - 1).cast("int")).filter(F.col("root") >= 0)


def fit_subtype(train: DataFrame, category: str, value, subtype: str, minimum: int = 50, fit: Callable = fit_forest, **kw) -> Scorer:
    """Multi-class model of the sub-types inside one category; with too few rows it scores none."""
    d = train.filter((F.col(category) == value) & F.col(subtype).isNotNull())
    if d.count() <= minimum:
        return lambda df: df.withColumn("y_pred", F.lit(None).cast("int")).withColumn("subtype_pred", F.lit(None).cast("string")).filter(F.lit(False))
    names = [r[0] for r in d.select(subtype).distinct().orderBy(subtype).collect()]  # a handful of sub-types
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(subtype)) - 1
    m = fit(d.withColumn("__s", code.cast("int")), "__s", **kw)
    return lambda df: m(df).withColumn("subtype_pred", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("y_pred") + 1))


# ---- comparisons -----------------------------------------------------------------------

def evaluate(scored: DataFrame, label: str, name: str) -> DataFrame:
    """One row of accuracy, precision, recall, F1 and AUC."""
    m = H.binary_metrics(scored, label, "y_pred").drop("n")
    return m.join(H.roc_auc(scored, label, "score")).select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", "auc")  # one row each


def model_comparison(train: DataFrame, test: DataFrame, label: str, models: dict[str, Callable]) -> DataFrame:
    train, test = cut_lineage(train), cut_lineage(test)
    return reduce(DataFrame.unionByName, run_all([lambda n=n, fit=fit: cut_lineage(evaluate(fit(train, label)(test), label, n)) for n, fit in models.items()]))


def channel_ablation(df: DataFrame, key: str, label: str, names: list[str], sets: dict[str, list[str]], fit: Callable = fit_forest, test: float = 0.3, seed: int = 42, vec: str = "x", **kw) -> DataFrame:
    """Refit without the features of each channel set and compare with the full set."""
    d = cut_lineage(stratified_split(df, key, label, test, seed=seed))

    def one(run: str, channels: list[str]) -> Callable[[], DataFrame]:
        keep = [i for i, n in enumerate(names) if not any(n == c or n.startswith(f"{c}_") for c in channels)]

        def fitted() -> DataFrame:
            part = d.withColumn(vec, F.array(*[F.get(vec, F.lit(i)) for i in keep]))
            m = fit(part.filter("split = 'train'"), label, vec=vec, **kw)
            return cut_lineage(evaluate(m(part.filter("split = 'test'")), label, run).withColumn("n_features", F.lit(len(keep))))

        return fitted

    rows = reduce(DataFrame.unionByName, run_all([one(r, c) for r, c in {"baseline": [], **sets}.items()]))
    base = rows.filter("model = 'baseline'").agg(F.max("accuracy").alias("a")).scalar()
    return rows.withColumn("accuracy_change", F.col("accuracy") - base)


def top_features(scorer: Scorer, names: list[str], k: int, df: DataFrame) -> DataFrame:
    """Importances of a tree model, largest first."""
    imp = scorer.model.featureImportances.toArray()
    t = df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")
    return t.orderBy(F.desc("importance"), "feature").limit(k)


def learning_curve(df: DataFrame, key: str, label: str, labels: list, sizes: list[float], folds: int = 5, fit: Callable = fit_forest, seed: int = 42, **kw) -> DataFrame:
    """Macro F1 on training and validation rows for nested shares of each fold's training part."""
    from .splits import kfold

    d = cut_lineage(kfold(df, key, label, folds, seed).withColumn("__u", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)))

    def one(i: int, s: float) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            tr = d.filter((F.col("fold") != i) & (F.col("__u") < s))
            m = fit(tr, label, **kw)
            f = lambda part: H.averaged_f1(H.multiclass_counts(m(part), label, "y_pred", labels)).select("macro")
            a, b = f(tr).withColumnRenamed("macro", "train_f1"), f(d.filter(F.col("fold") == i)).withColumnRenamed("macro", "cv_f1")
            return cut_lineage(a.join(b).select(F.lit(s).alias("size"), F.lit(i).alias("fold"), "train_f1", "cv_f1"))  # one row

        return run

    return reduce(DataFrame.unionByName, run_all([one(i, s) for i in range(folds) for s in sizes]))


def feature_scope_test(df: DataFrame, key: str, label: str, scopes: dict[str, list[int]], n: int = 10, fit: Callable = fit_forest, vec: str = "x", **kw) -> DataFrame:
    """AUC over repeated splits on each restricted column set."""
    from .splits import repeated_eval, summarize_repeats

    out = []
    for scope, keep in scopes.items():
        part = df.withColumn(vec, F.array(*[F.get(vec, F.lit(i)) for i in keep]))
        auc = lambda scored: H.roc_auc(scored, label, "score").select(F.lit("auc").alias("metric"), F.lit(scope).alias("label_name"), F.col("auc").alias("value"))
        out.append(repeated_eval(part, key, label, lambda tr: fit(tr, label, vec=vec, **kw), auc, n))
    return summarize_repeats(reduce(DataFrame.unionByName, out))


def two_stage(train: DataFrame, test: DataFrame, label: str, score_anomaly: Callable[[DataFrame, DataFrame], DataFrame], fit: Callable = fit_forest, **kw) -> DataFrame:
    """Classify only rows that the anomaly score flags; the rest count as normal (0)."""
    flagged = score_anomaly(train, test)
    m = fit(train, label, **kw)
    hit = m(flagged.filter("flag = 1").drop("score"))
    rest = flagged.filter("flag = 0").drop("score").withColumn("y_pred", F.lit(0)).withColumn("score", F.lit(0.0))
    return hit.drop("proba").unionByName(rest)


def soft_voting(train: DataFrame, label: str, fits: list[Callable]) -> Scorer:
    """Mean of the class-1 probabilities."""
    models = run_all([lambda f=f: f(train, label) for f in fits])

    def score(df: DataFrame) -> DataFrame:
        for i, m in enumerate(models):
            df = m(df).withColumnRenamed("score", f"__s{i}").drop("proba", "y_pred")
        mean = sum((F.col(f"__s{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
        return df.withColumn("score", mean).withColumn("y_pred", (F.col("score") > 0.5).cast("int")).drop(*[f"__s{i}" for i in range(len(models))])

    return score


def stacking(train: DataFrame, key: str, label: str, fits: list[Callable], folds: int = 5, seed: int = 42) -> Scorer:
    """A logistic model on scores that each base model gives to rows it was not trained on."""
    from .splits import kfold

    d = cut_lineage(kfold(train, key, label, folds, seed))

    def base(models, df):
        for i, m in enumerate(models):
            df = m(df).withColumnRenamed("score", f"__s{i}").drop("proba", "y_pred")
        return df.withColumn("__x", F.array(*[F.col(f"__s{i}") for i in range(len(models))])).drop(*[f"__s{i}" for i in range(len(models))])

    made = run_all([lambda f=f, i=i: f(d.filter(F.col("fold") != i), label) for i in range(folds) for f in fits])
    held = [base(made[i * len(fits) : (i + 1) * len(fits)], d.filter(F.col("fold") == i)) for i in range(folds)]
    top = fit_logistic(cut_lineage(reduce(DataFrame.unionByName, held)), label, "__x")
    final = run_all([lambda f=f: f(train, label) for f in fits])
    return lambda df: top(base(final, df)).drop("__x")
