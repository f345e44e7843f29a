"""Evaluation metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import percent, ratio, safe_corr
from ..functions.ordering import agg_with_quantiles, with_running


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _rows(*structs: Column) -> Column:
    return F.explode(F.array(*structs)).alias("r")


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """Counts for every pair of the fixed label list and the share of the true row."""
    cells = [(a, b) for a in labels for b in labels]
    row = df.agg(*[F.count_if((F.col(true) == a) & (F.col(pred) == b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)])
    k = len(labels)
    d = row.select(_rows(*[F.struct(
        F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(f"c{i}").alias("n"),
        sum((F.col(f"c{(i // k) * k + j}") for j in range(k)), F.lit(0)).alias("row_n")) for i, (a, b) in enumerate(cells)])).select("r.*")
    return d.select("y_true", "y_pred", "n", _or0(ratio(F.col("n"), F.col("row_n"))).alias("share"))


def binary_metrics(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    t, p = F.col(true) == 1, F.col(pred) == 1
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("n", ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"), _or0(ratio(tp, tp + fp)).alias("precision"),
                    _or0(ratio(tp, tp + fn)).alias("recall"), _or0(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def multiclass_counts(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """tp, fp, fn and support per label of a multi-class prediction."""
    row = df.agg(*[e for i, l in enumerate(labels) for e in (
        F.count_if((F.col(true) == l) & (F.col(pred) == l)).alias(f"tp{i}"), F.count_if((F.col(true) != l) & (F.col(pred) == l)).alias(f"fp{i}"),
        F.count_if((F.col(true) == l) & (F.col(pred) != l)).alias(f"fn{i}"))])
    return row.select(_rows(*[F.struct(F.lit(l).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
                              for i, l in enumerate(labels)])).select("r.*")


def multilabel_counts(df: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    row = df.agg(*[e for l, (t, p) in labels.items() for e in (
        F.count_if((F.col(t) == 1) & (F.col(p) == 1)).alias(f"tp_{l}"), F.count_if((F.col(t) == 0) & (F.col(p) == 1)).alias(f"fp_{l}"),
        F.count_if((F.col(t) == 1) & (F.col(p) == 0)).alias(f"fn_{l}"))])
    return row.select(_rows(*[F.struct(F.lit(l).alias("label"), F.col(f"tp_{l}").alias("tp"), F.col(f"fp_{l}").alias("fp"), F.col(f"fn_{l}").alias("fn"))
                              for l in labels])).select("r.*")


def label_report(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    total = counts.agg(F.sum(tp + fn).alias("n")).scalar()
    return counts.select("label", (tp + fn).alias("support"), percent(tp + fn, total).alias("support_pct"), _or0(ratio(tp, tp + fp)).alias("precision"),
                         _or0(ratio(tp, tp + fn)).alias("recall"), _or0(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def averaged_f1(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = _or0(ratio(2 * tp, 2 * tp + fp + fn))
    return counts.agg(F.avg(f1).alias("macro"), _or0(ratio(F.sum(2 * tp), F.sum(2 * tp + fp + fn))).alias("micro"),
                      _or0(ratio(F.sum(f1 * (tp + fn)), F.sum(tp + fn))).alias("weighted"))


def hamming_loss(df: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    wrong = sum(((F.col(t) != F.col(p)).cast("int") for t, p in labels.values()), F.lit(0))
    return df.agg((F.avg(wrong) / len(labels)).alias("hamming_loss"))


def _score_steps(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Cumulative positives and negatives at each distinct score, from the highest down.

    Equal scores are counted before the ordered pass, which then runs in chunks.
    """
    g = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    by = -F.col("score")
    return with_running(g, keys, [by], {"tp": F.col("pos"), "fp": F.col("neg")}, {"n_pos": "tp", "n_neg": "fp"})


def roc_auc(df: DataFrame, y: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Rank statistic with averaged ties; NULL when only one class is present."""
    keys = keys or []
    s = _score_steps(df, keys, y, score)
    below = F.col("n_neg") - F.col("fp") + F.col("neg") / 2.0
    return s.groupBy(*keys).agg(ratio(F.sum(F.col("pos") * below), F.max(F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


def roc_auc_per_label(df: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    d = df.select(_rows(*[F.struct(F.lit(l).alias("label"), F.col(t).alias("y"), F.col(s).cast("double").alias("s")) for l, (t, s) in labels.items()])).select("r.*")
    return roc_auc(d, "y", "s", ["label"])


def curves(df: DataFrame, y: str, score: str) -> DataFrame:
    """One point per distinct score: rates, precision, recall and F1."""
    s = _score_steps(df, [], y, score)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("n_pos"))
    return s.select("score", "pos", "neg", "tp", "fp", "n_pos", ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), r.alias("tpr"), p.alias("precision"), r.alias("recall"),
                    (2 * p * r / (p + r + 1e-10)).alias("f1"))


def pr_auc(points: DataFrame) -> DataFrame:
    """Trapezoid area; the previous point follows from the cumulative counts, so no second ordering."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    p0 = F.coalesce(ratio(tp0, tp0 + fp0), F.lit(1.0))
    return points.agg(F.sum((F.col("recall") - ratio(tp0, F.col("n_pos"))) * (F.col("precision") + p0) / 2).alias("pr_auc"))


def best_f1_threshold(points: DataFrame) -> DataFrame:
    top = F.struct("f1", "score")
    return points.agg(F.max_by("score", top).alias("threshold"), F.max("f1").alias("f1"))


def confidence_bin(c: Column) -> Column:
    return F.when(c <= 0.5, "low").when(c <= 0.7, "medium").when(c <= 0.85, "high").otherwise("very_high")


def confidence_bins(df: DataFrame, confidence: str, correct: Column) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(confidence_bin(F.col(confidence)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct.cast("int")).alias("accuracy")).withColumn("pct", percent(F.col("n"), total))


def confidence_summary(df: DataFrame, confidence: str) -> DataFrame:
    return agg_with_quantiles(df, [], [F.avg(confidence).alias("mean"), F.min(confidence).alias("min"), F.max(confidence).alias("max")], {"median": (confidence, 0.5)})


def route_by_confidence(c: Column) -> Column:
    return F.when(c > 0.85, "auto").when(c > 0.70, "validate").when(c > 0.50, "onset").otherwise("expert")


def confused_pairs(df: DataFrame, true: str, pred: str, k: int) -> DataFrame:
    return (df.filter(F.col(true) != F.col(pred)).groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), true, pred).limit(k))


def method_table(metrics: DataFrame) -> DataFrame:
    """Methods ranked by micro F1, with a mark on the best of each metric and of each phase.

    ``metrics`` has one row per method.
    """
    best = metrics.agg(F.min_by("method", F.struct("hamming", "method")).alias("h"), F.max_by("method", F.struct("micro_f1", "method")).alias("mi"),
                       F.max_by("method", F.struct("macro_f1", "method")).alias("ma"))
    per = metrics.groupBy("phase").agg(F.max_by("method", F.struct("micro_f1", "method")).alias("phase_best"))
    rank = F.row_number().over(W.orderBy(F.desc_nulls_last("micro_f1"), "method"))
    d = metrics.join(best).join(per, "phase")
    return d.select("method", "phase", "micro_f1", "macro_f1", "hamming", rank.alias("rank"), (F.col("method") == F.col("h")).alias("best_hamming"),
                    (F.col("method") == F.col("mi")).alias("best_micro"), (F.col("method") == F.col("ma")).alias("best_macro"),
                    (F.col("method") == F.col("phase_best")).alias("best_in_phase"))


def method_type_summary(metrics: DataFrame, type_: str, cols: list[str]) -> DataFrame:
    return metrics.groupBy(type_).agg(*[e.alias(f"{c}_{n}") for c in cols for n, e in (
        ("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("min", F.min(c)), ("max", F.max(c)))])


def ecdf(df: DataFrame, class_: str, score: str) -> DataFrame:
    """Share of the class at or below each distinct score; scores are shifted to be positive."""
    lo, hi = df.agg(F.min(score).alias("a")).scalar(), df.agg(F.max(score).alias("a")).scalar()
    shift = F.when(lo <= 0, -lo + (hi - lo + 1e-9) * 1e-6).otherwise(0.0)
    g = df.groupBy(class_, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("c"))
    run = with_running(g, [class_], ["score"], {"cum": F.col("c")}, {"n": "cum"})
    return run.select(class_, (F.col("score") + shift).alias("score"), ratio(F.col("cum"), F.col("n")).alias("ecdf"))


def learning_curve_summary(rows: DataFrame) -> DataFrame:
    """Mean and std of train and validation F1 per size, the final gap and the gain over the range."""
    g = rows.groupBy("size").agg(F.avg("train_f1").alias("train_mean"), F.stddev_pop("train_f1").alias("train_std"),
                                 F.avg("cv_f1").alias("cv_mean"), F.stddev_pop("cv_f1").alias("cv_std"))
    s = g.agg(F.max_by("train_mean", "size").alias("t1"), F.max_by("cv_mean", "size").alias("c1"), F.min_by("cv_mean", "size").alias("c0"))
    return g.join(s).select("size", "train_mean", "train_std", "cv_mean", "cv_std", (F.col("t1") - F.col("c1")).alias("final_gap"), (F.col("c1") - F.col("c0")).alias("cv_gain"))


def size_vs_score(df: DataFrame, size: str, score: str, n_features: int) -> DataFrame:
    return df.agg(safe_corr(F.col(size).cast("double"), F.col(score)).alias("r_size"), safe_corr(F.log10(size), F.col(score)).alias("r_log_size"),
                  ratio(F.lit(n_features), F.sum(size)).alias("features_per_row"))
