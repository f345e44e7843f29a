"""Feature matrices the queries derive: orders by line statistics, and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

COLS = ["n_lines", "qty_sum", "qty_mean", "price_sum", "price_max", "disc_mean", "tax_mean", "qty_twice", "always_one"]
ORDERS_SQL = """m AS (SELECT l_orderkey AS event_id, count(*)::DOUBLE AS n_lines, sum(l_quantity) AS qty_sum, avg(l_quantity) AS qty_mean, sum(l_extendedprice) AS price_sum,
    max(l_extendedprice) AS price_max, avg(l_discount) AS disc_mean, avg(l_tax) AS tax_mean, 2 * sum(l_quantity) AS qty_twice, 1.0::DOUBLE AS always_one,
    max((l_returnflag = 'R')::INT) AS y FROM lineitem GROUP BY 1)"""
LONG_SQL = f"""{ORDERS_SQL}, long AS (SELECT event_id, y, unnest([{', '.join(f"'{c}'" for c in COLS)}]) AS feature, unnest([{', '.join(COLS)}]) AS value FROM m)"""


def orders_matrix(t):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum(q).alias("qty_sum"), F.avg(q).alias("qty_mean"), F.sum(p).alias("price_sum"),
        F.max(p).alias("price_max"), F.avg("l_discount").alias("disc_mean"), F.avg("l_tax").alias("tax_mean"), (F.sum(q) * 2).alias("qty_twice"),
        F.lit(1.0).alias("always_one"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))


def orders_long(t):
    m = orders_matrix(t)
    return m.unpivot(["event_id", "y"], COLS, "feature", "value")


def vectors(t):
    return t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


VECTORS_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings)"
