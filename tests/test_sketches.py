"""States of parts against one pass and against exact figures."""

from pyspark.sql import functions as F

from faultspark.functions.iterate import shared_folder
from faultspark.operators import sketches as K

D, Q = {"ids": "id"}, {"v": "v"}


def table(spark):
    d = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("id"), F.when(F.col("id") % 11 > 0, F.abs(F.sin("id")) * 100).alias("v"), (F.col("id") % 7).alias("part"))
    return d.unionByName(spark.createDataFrame([(9, 1, None, 0), (None, 2, 5.0, 1)], "k bigint, id bigint, v double, part bigint"))


def test_parts_equal_one_pass_within_the_bounds(spark):
    d = table(spark).cache()
    path = shared_folder(spark, "sketch-test")
    for p in range(7):
        K.add_part(d.filter(F.col("part") == p), path, ["k"], D, Q)
    got = {r["k"]: r for r in K.report(spark, path, ["k"], [0.1, 0.5, 0.99]).collect()}
    exact = {r["k"]: r for r in d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).collect()}
    assert got.keys() == exact.keys()
    for k, r in got.items():
        assert r["n"] == exact[k]["n"] and abs(r["ids"] / exact[k]["ids"] - 1) < 0.03
        for p in (0.1, 0.5, 0.99):
            own = d.filter(F.col("k").eqNullSafe(F.lit(k)) & F.col("v").isNotNull())
            q = r[f"v_p{round(100 * p)}"]
            if own.count() > 10:
                assert abs(own.filter(F.col("v") <= q).count() / own.count() - p) < 0.01
    assert got[9]["v_p50"] is None and got[None]["v_p50"] == 5.0
    one = {r["k"]: r["d_ids"] for r in K.merge_states(K.part_states(d, ["k"], D, Q), ["k"]).collect()}
    many = {r["k"]: r["d_ids"] for r in K.merge_states(spark.read.parquet(path), ["k"]).collect()}
    est = spark.createDataFrame([(bytes(one[0]), bytes(many[0]))], "a binary, b binary").select(F.hll_sketch_estimate("a"), F.hll_sketch_estimate("b")).first()
    assert abs(est[0] / est[1] - 1) < 1e-6 or abs(est[0] - est[1]) <= 0.01 * est[0]


def test_exact_counts_of_parts_that_share_values(spark):
    d = spark.range(36_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 12_000 > 1, F.col("id") % 12_000).alias("id"), F.lit(1.0).alias("v"), F.floor(F.col("id") / 9_000).alias("part"))
    path = shared_folder(spark, "sketch-exact")
    for p in range(4):
        K.add_part(d.filter(F.col("part") == p), path, ["k"], {}, Q, exact=D)
    assert {(r["k"], r["n"], r["ids"]) for r in K.report(spark, path, ["k"], [0.5], ["ids"]).collect()} == {(0, 18_000, 5_999), (1, 18_000, 5_999)}
