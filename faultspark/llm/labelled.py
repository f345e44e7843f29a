"""Bounded samples of labelled documents to learn from.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are learnt from; the others are held
out. A sample takes the rows with a small hash of doc_id, at a rate that gives the wanted
number. Labels of one document that contradict each other count as the larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is never learnt from; a row without an id is neither, so False."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fit: int, calibrate: int, balanced: bool) -> DataFrame:
    """(doc_id, text, y, fit): about ``fit`` rows to fit on and ``calibrate`` others.

    The sample's ids are broadcast: their number is bounded by the two parameters.
    The rows to fit on are half of each class where ``balanced`` and there are enough.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(n.values()))
    rate = {c: min(0.67, fit / 2 / max(1, n.get(c, 0)) if balanced else fit / total) for c in (0, 1)}
    # the others keep the natural shares: where more was fitted on, a larger part of the rest is taken
    left = {c: 1 - rate[c] for c in (0, 1)}
    share = min(1.0, calibrate / (total * min(left.values())))
    keep = {c: share * min(left.values()) / left[c] for c in (0, 1)}

    def unit(seed: str) -> Column:
        return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))

    def of(rates: dict[int, float]) -> Column:
        return F.when(F.col("y") == 1, F.lit(float(rates[1]))).otherwise(F.lit(float(rates[0])))

    y = y.withColumn("fit", unit("fit") < of(rate)).filter(F.col("fit") | (unit("calibrate") < of(keep)))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(y), "doc_id")
