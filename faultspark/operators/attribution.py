"""Attribution of model output to features and feature groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.exprs import ratio
from ..functions.ordering import agg_with_quantiles


def linear_shapley(long: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Exact Shapley values of a linear model: coefficient times distance from the feature mean."""
    mean = long.groupBy("feature").agg(F.avg("value").alias("__m")).join(coefficients, "feature")
    return long.join(mean, "feature").withColumn("value", F.col("coef") * (F.col("value") - F.col("__m"))).drop("__m", "coef")


def sampled_shapley(rows: DataFrame, score: Callable[[DataFrame], DataFrame], background: list[float], id_: str, vec: str = "x", n_perm: int = 8, seed: int = 42) -> DataFrame:
    """Monte Carlo Shapley values of any model: (id, feature index, value).

    Every row is expanded into permutation walks from the background point to the row;
    ``score`` maps a table with ``x`` to one with ``score``. The difference along a walk
    belongs to the feature that changed.
    """
    p = len(background)

    def walks(it):
        base = np.array(background, dtype=float)
        for pdf in it:
            for rid, x in zip(pdf["id"], pdf["x"]):
                out = []  # one explained row at a time keeps the batch small
                x = np.asarray(x, dtype=float)
                for m in range(n_perm):
                    order = np.random.default_rng([seed, int(rid), m]).permutation(p)
                    cur = base.copy()
                    out.append((rid, m, 0, -1, cur.copy()))
                    for step, f in enumerate(order, 1):
                        cur[f] = x[f]
                        out.append((rid, m, step, int(f), cur.copy()))
                yield pd.DataFrame(out, columns=["id", "perm", "step", "feature", "x"])

    src = rows.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("x"))
    e = src.mapInPandas(walks, "id bigint, perm int, step int, feature int, x array<double>")
    s = score(e).select("id", "perm", "step", "feature", "score")
    w = W.partitionBy("id", "perm").orderBy("step")  # one walk: p + 1 rows
    d = s.withColumn("delta", F.col("score") - F.lag("score").over(w)).filter("step > 0")
    return d.groupBy("id", "feature").agg(F.avg("delta").alias("value"))


def local_surrogate(rows: DataFrame, score: Callable[[DataFrame], DataFrame], scale: list[float], id_: str, vec: str = "x", n: int = 500, top: int = 20, ridge: float = 1.0, seed: int = 42) -> DataFrame:
    """Weighted ridge fit around each row on Gaussian perturbations: its ``top`` coefficients.

    Only the perturbed points are expanded; each row keeps its own normal equations.
    """
    p = len(scale)
    width = 0.75 * np.sqrt(p)

    def noise(rid):
        # drawn again where it is needed: only scores are dealt out
        z = np.random.default_rng([seed, int(rid)]).standard_normal((n, p))
        z[0] = 0.0
        return z

    def perturb(it):
        s = np.array(scale, dtype=float)
        for pdf in it:
            for rid, x in zip(pdf["id"], pdf["x"]):
                yield pd.DataFrame({"id": rid, "j": np.arange(n, dtype=np.int32), "x": list(np.asarray(x) + noise(rid) * s)})

    def fit(pdf):
        pdf = pdf.sort_values("j")
        z = noise(pdf["id"].iloc[0])[pdf["j"].to_numpy()]
        y = pdf["score"].to_numpy()
        w = np.exp(-((z**2).sum(1)) / width**2)
        zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
        coef = np.linalg.solve((zc * w[:, None]).T @ zc + ridge * np.eye(p), (zc * w[:, None]).T @ yc)
        keep = np.argsort(-np.abs(coef), kind="stable")[:top]
        return pd.DataFrame({"id": int(pdf["id"].iloc[0]), "feature": keep.astype("int32"), "value": coef[keep]})

    src = rows.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("x"))
    e = src.mapInPandas(perturb, "id bigint, j int, x array<double>")
    s = score(e).select("id", "j", "score")
    return s.groupBy("id").applyInPandas(fit, "id bigint, feature int, value double")  # n points per row


def mean_abs_attribution(attr: DataFrame, top: int = 20) -> DataFrame:
    g = attr.groupBy("label", "feature").agg(F.avg(F.abs("value")).alias("importance"))
    r = F.row_number().over(W.partitionBy("label").orderBy(F.desc("importance"), "feature"))
    return g.withColumn("rank", r).filter(F.col("rank") <= top)


def group_attribution(attr: DataFrame, groups: DataFrame) -> DataFrame:
    """Sum, mean and median importance per label and group, each as a percentage of its total over groups."""
    imp = attr.groupBy("label", "feature").agg(F.avg(F.abs("value")).alias("imp")).join(groups, "feature")
    g = agg_with_quantiles(imp, ["label", "family"], [F.count(F.lit(1)).alias("n_features"), F.sum("imp").alias("total"), F.avg("imp").alias("mean")], {"median": ("imp", 0.5)})
    w = W.partitionBy("label")  # one row per group
    pct = [(F.coalesce(ratio(F.col(c) * 100, F.sum(c).over(w)), F.lit(0.0))).alias(f"{c}_pct") for c in ("total", "mean", "median")]
    return g.select("label", "family", "n_features", *pct)


def top_groups(groups: DataFrame) -> DataFrame:
    return groups.groupBy("label").agg(*[F.max_by("family", F.struct(f"{c}_pct", "family")).alias(f"top_by_{c}") for c in ("total", "mean", "median")])


def shared_important_features(attr: DataFrame, pct: float = 0.9) -> DataFrame:
    """How many labels rank a feature above their own 90th percentile, with its overall mean and std."""
    imp = attr.groupBy("label", "feature").agg(F.avg(F.abs("value")).alias("imp"))
    cut = agg_with_quantiles(imp, ["label"], [], {"cut": ("imp", pct)})
    g = imp.join(cut, "label").groupBy("feature").agg(F.count_if(F.col("imp") > F.col("cut")).alias("n_important"), F.avg("imp").alias("mean"), F.stddev_samp("imp").alias("std"))
    return g.withColumn("shared", F.col("n_important") >= 3).orderBy(F.desc("mean"), "feature")
