"""Queries for evaluation metrics; lineitem columns stand in for predictions."""

from pyspark.sql import functions as F

from ..operators import metrics as H
from .registry import R, query
from .series import rounded

PRED_SQL = """p AS (SELECT l_returnflag AS y3, CASE WHEN l_discount > 0.07 THEN 'R' WHEN l_tax > 0.04 THEN 'N' ELSE l_returnflag END AS p3, (l_returnflag = 'R')::INT AS y, (l_discount > 0.05)::INT AS yp,
   floor(l_extendedprice / 500) - 20 AS score, 0.3 + round(l_tax * 100) * 0.08 AS conf, (l_linestatus = 'F')::INT AS y2, (l_tax > 0.03)::INT AS yp2, l_quantity, l_orderkey, l_linenumber FROM lineitem)"""


def preds(t):
    return t.lineitem.select(
        F.col("l_returnflag").alias("y3"), F.when(F.col("l_discount") > 0.07, "R").when(F.col("l_tax") > 0.04, "N").otherwise(F.col("l_returnflag")).alias("p3"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("yp"),
        (F.floor(F.col("l_extendedprice") / 500) - 20).cast("double").alias("score"), (F.lit(0.3) + F.round(F.col("l_tax") * 100) * 0.08).alias("conf"),
        (F.col("l_linestatus") == "F").cast("int").alias("y2"), (F.col("l_tax") > 0.03).cast("int").alias("yp2"), "l_quantity")


LABELS3 = ["A", "N", "R", "X"]
PAIRS = {"returned": ("y", "yp"), "open": ("y2", "yp2")}


@query("confusion_matrix", "H1", f"""WITH {PRED_SQL}, l AS (SELECT unnest({LABELS3}) AS l), c AS (SELECT a.l AS y_true, b.l AS y_pred, count(p.y) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.y3 = a.l AND p.p3 = b.l GROUP BY 1, 2)
  SELECT y_true, y_pred, n, {R('coalesce(n / nullif(sum(n) OVER (PARTITION BY y_true), 0), 0)')} AS share FROM c""")
def _(t):
    return rounded(H.confusion_matrix(preds(t), "y3", "p3", LABELS3))


@query("binary_metrics", "H2", f"""WITH {PRED_SQL} SELECT count(*) AS n, {R('avg((y = yp)::INT)')} AS accuracy, {R('coalesce(count_if(y = 1 AND yp = 1) / nullif(count_if(yp = 1), 0), 0)')} AS "precision",
  {R('coalesce(count_if(y = 1 AND yp = 1) / nullif(count_if(y = 1), 0), 0)')} AS recall, {R('coalesce(2 * count_if(y = 1 AND yp = 1) / nullif(count_if(y = 1) + count_if(yp = 1), 0), 0)')} AS f1 FROM p""")
def _(t):
    return rounded(H.binary_metrics(preds(t), "y", "yp"))


COUNTS_SQL = f"""WITH {PRED_SQL}, l AS (SELECT unnest({LABELS3}) AS label), c AS (SELECT label, count_if(y3 = label AND p3 = label) AS tp, count_if(y3 <> label AND p3 = label) AS fp, count_if(y3 = label AND p3 <> label) AS fn FROM p, l GROUP BY 1),
  f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


@query("label_report", "H3", f"""{COUNTS_SQL} SELECT label, tp + fn AS support, {R('100.0 * (tp + fn) / sum(tp + fn) OVER ()')} AS support_pct, {R('coalesce(tp / nullif(tp + fp, 0), 0)')} AS "precision",
  {R('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {R('f1')} AS f1 FROM f""")
def _(t):
    return rounded(H.label_report(H.multiclass_counts(preds(t), "y3", "p3", LABELS3)))


@query("averaged_f1", "H3", f"{COUNTS_SQL} SELECT {R('avg(f1)')} AS macro, {R('sum(2 * tp) / sum(2 * tp + fp + fn)')} AS micro, {R('sum(f1 * (tp + fn)) / sum(tp + fn)')} AS weighted FROM f")
def _(t):
    return rounded(H.averaged_f1(H.multiclass_counts(preds(t), "y3", "p3", LABELS3)))


@query("averaged_f1_multilabel", "H3", f"""WITH {PRED_SQL}, u AS (SELECT unnest(['returned', 'open']) AS label, unnest([y, y2]) AS y, unnest([yp, yp2]) AS q FROM p),
  c AS (SELECT label, count_if(y = 1 AND q = 1) AS tp, count_if(y = 0 AND q = 1) AS fp, count_if(y = 1 AND q = 0) AS fn FROM u GROUP BY 1), f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
  SELECT {R('avg(f1)')} AS macro, {R('sum(2 * tp) / sum(2 * tp + fp + fn)')} AS micro, {R('sum(f1 * (tp + fn)) / sum(tp + fn)')} AS weighted FROM f""")
def _(t):
    return rounded(H.averaged_f1(H.multilabel_counts(preds(t), PAIRS)))


@query("hamming_loss", "H4", f"WITH {PRED_SQL} SELECT {R('avg((y <> yp)::INT + (y2 <> yp2)::INT) / 2')} AS hamming_loss FROM p")
def _(t):
    return rounded(H.hamming_loss(preds(t), PAIRS))


AUC_SQL = "(sum(CASE WHEN y = 1 THEN rk + (tie - 1) / 2.0 END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / nullif(count_if(y = 1)::DOUBLE * count_if(y = 0), 0)"


@query("roc_auc", "H5", f"WITH {PRED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY score) AS rk, count(*) OVER (PARTITION BY score) AS tie FROM p) SELECT {R(AUC_SQL)} AS auc FROM r")
def _(t):
    return rounded(H.roc_auc(preds(t), "y", "score"))


@query("roc_auc_per_label", "H5", f"""WITH {PRED_SQL}, u AS (SELECT unnest(['returned', 'open', 'none']) AS label, unnest([y, y2, 0]) AS y, unnest([score, conf, conf]) AS score FROM p),
  r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) AS rk, count(*) OVER (PARTITION BY label, score) AS tie FROM u) SELECT label, {R(AUC_SQL)} AS auc FROM r GROUP BY 1""")
def _(t):
    d = preds(t).withColumn("zero", F.lit(0))
    return rounded(H.roc_auc_per_label(d, {"returned": ("y", "score"), "open": ("y2", "conf"), "none": ("zero", "conf")}))


CURVE_SQL = f"""WITH {PRED_SQL}, g AS (SELECT score, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM p GROUP BY 1),
  c AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY score DESC)),
  q AS (SELECT score, fp / nn AS fpr, tp / np AS tpr, tp / (tp + fp) AS prec, tp / np AS rec, 2 * (tp / (tp + fp)) * (tp / np) / (tp / (tp + fp) + tp / np + 1e-10) AS f1 FROM c)"""


@query("roc_pr_curves", "H6", f'{CURVE_SQL} SELECT score, {R("fpr")} AS fpr, {R("tpr")} AS tpr, {R("prec")} AS "precision", {R("f1")} AS f1 FROM q')
def _(t):
    return rounded(H.curves(preds(t), "y", "score").select("score", "fpr", "tpr", "precision", "f1"), skip=("score",))


@query("pr_auc", "H6", f"{CURVE_SQL}, l AS (SELECT rec, prec, coalesce(lag(rec) OVER w, 0) AS r0, coalesce(lag(prec) OVER w, 1) AS p0 FROM q WINDOW w AS (ORDER BY score DESC)) SELECT {R('sum((rec - r0) * (prec + p0) / 2)')} AS pr_auc FROM l")
def _(t):
    return rounded(H.pr_auc(H.curves(preds(t), "y", "score")))


@query("best_f1_threshold", "H6", f"{CURVE_SQL} SELECT score AS threshold, {R('f1')} AS f1 FROM q ORDER BY q.f1 DESC, score DESC LIMIT 1")
def _(t):
    return rounded(H.best_f1_threshold(H.curves(preds(t), "y", "score")), skip=("threshold",))


@query("confidence_bins", "H7", f"""WITH {PRED_SQL} SELECT CASE WHEN conf <= 0.5::DOUBLE THEN 'low' WHEN conf <= 0.7::DOUBLE THEN 'medium' WHEN conf <= 0.85::DOUBLE THEN 'high' ELSE 'very_high' END AS bin, count(*) AS n,
  {R('avg((y = yp)::INT)')} AS accuracy, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM p GROUP BY 1""")
def _(t):
    return rounded(H.confidence_bins(preds(t), "conf", F.col("y") == F.col("yp")))


@query("confidence_summary", "H7", f"WITH {PRED_SQL} SELECT {R('avg(conf)')} AS mean, {R('min(conf)')} AS min, {R('max(conf)')} AS max, {R('median(conf)')} AS median FROM p")
def _(t):
    return rounded(H.confidence_summary(preds(t), "conf"))


@query("route_by_confidence", "H8", f"WITH {PRED_SQL} SELECT CASE WHEN conf > 0.85::DOUBLE THEN 'auto' WHEN conf > 0.7::DOUBLE THEN 'validate' WHEN conf > 0.5::DOUBLE THEN 'onset' ELSE 'expert' END AS route, count(*) AS n FROM p GROUP BY 1")
def _(t):
    return preds(t).groupBy(H.route_by_confidence(F.col("conf")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("confused_pairs", "H9", f"WITH {PRED_SQL} SELECT y3, p3, count(*) AS n FROM p WHERE y3 <> p3 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 3")
def _(t):
    return H.confused_pairs(preds(t), "y3", "p3", 3)


METHOD_SQL = """mt AS (SELECT 'm' || l_linenumber AS method, 'phase' || (l_linenumber % 3) AS phase, CASE WHEN l_linenumber % 2 = 0 THEN 'classic' ELSE 'deep' END AS kind,
   avg(l_discount) AS micro_f1, avg(l_tax) AS macro_f1, avg((l_quantity > 25)::INT) AS hamming FROM lineitem GROUP BY 1, 2, 3)"""


def methods(t):
    n = F.col("l_linenumber")
    return t.lineitem.groupBy(F.concat(F.lit("m"), n.cast("string")).alias("method"), F.concat(F.lit("phase"), (n % 3).cast("string")).alias("phase"), F.when(n % 2 == 0, "classic").otherwise("deep").alias("kind")).agg(
        F.avg("l_discount").alias("micro_f1"), F.avg("l_tax").alias("macro_f1"), F.avg((F.col("l_quantity") > 25).cast("int")).alias("hamming"))


@query("method_table", "H10", f"""WITH {METHOD_SQL} SELECT method, phase, {R('micro_f1')} AS micro_f1, {R('macro_f1')} AS macro_f1, {R('hamming')} AS hamming, (row_number() OVER (ORDER BY mt.micro_f1 DESC, method))::INT AS rank,
  method = (SELECT method FROM mt ORDER BY hamming, method LIMIT 1) AS best_hamming, method = (SELECT method FROM mt ORDER BY micro_f1 DESC, method DESC LIMIT 1) AS best_micro,
  method = (SELECT method FROM mt ORDER BY macro_f1 DESC, method DESC LIMIT 1) AS best_macro, row_number() OVER (PARTITION BY phase ORDER BY mt.micro_f1 DESC, method DESC) = 1 AS best_in_phase FROM mt""")
def _(t):
    return rounded(H.method_table(methods(t)))


@query("method_type_summary", "H10", f"WITH {METHOD_SQL} SELECT kind, " + ", ".join(f"{R(f'{f}({c})')} AS {c}_{n}" for c in ("micro_f1", "hamming") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM mt GROUP BY 1")
def _(t):
    return rounded(H.method_type_summary(methods(t), "kind", ["micro_f1", "hamming"]))


@query("ecdf", "H11", f"""WITH {PRED_SQL}, sh AS (SELECT CASE WHEN min(score) <= 0 THEN -min(score) + 1e-6 * (max(score) - min(score) + 1e-9) ELSE 0 END AS s FROM p)
  SELECT DISTINCT y, {R('score + s')} AS score, {R('cume_dist() OVER (PARTITION BY y ORDER BY p.score)')} AS ecdf FROM p, sh""")
def _(t):
    return rounded(H.ecdf(preds(t), "y", "score"))


@query("learning_curve_summary", "H12", f"""WITH g AS (SELECT l_linenumber AS size, avg(a) AS tm, stddev_pop(a) AS ts, avg(b) AS cm, stddev_pop(b) AS cs FROM (SELECT l_linenumber, l_suppkey % 5 AS fold, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1)
  SELECT size, {R('tm')} AS train_mean, {R('ts')} AS train_std, {R('cm')} AS cv_mean, {R('cs')} AS cv_std, {R('(SELECT arg_max(tm, size) - arg_max(cm, size) FROM g)')} AS final_gap, {R('(SELECT arg_max(cm, size) - arg_min(cm, size) FROM g)')} AS cv_gain FROM g""")
def _(t):
    rows = t.lineitem.groupBy(F.col("l_linenumber").alias("size"), (F.col("l_suppkey") % 5).alias("fold")).agg(F.avg("l_discount").alias("train_f1"), F.avg("l_tax").alias("cv_f1"))
    return rounded(H.learning_curve_summary(rows))


@query("size_vs_score", "H13", f"""WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS s FROM events GROUP BY 1) SELECT {R('corr(n::DOUBLE, s)')} AS r_size, {R('corr(log10(n), s)')} AS r_log_size, {R('418.0 / sum(n)')} AS features_per_row FROM g""")
def _(t):
    g = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("s"))
    return rounded(H.size_vs_score(g, "n", "s", 418))
