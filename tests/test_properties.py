"""Splits, leakage, partition independence, hot keys and physical plans."""

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window as W, functions as F

from faultspark.functions.graph import connected_components
from faultspark.functions.ordering import agg_with_quantiles, with_position, with_running
from faultspark.operators import labels as L, matrix as M, proposals as P, series as S, splits as E
from faultspark.plans import load_all
from faultspark.plans.registry import Tables
from tests.compare import check
from tests.conftest import FOLDER


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_sizes_are_exact_and_do_not_depend_on_partitions(spark, tiny_chunks):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("y"))
    a = {r["id"]: r["split"] for r in E.stratified_split(df.repartition(7), "id", "y", 0.3, 0.1).collect()}
    b = {r["id"]: r["split"] for r in E.stratified_split(df.coalesce(1), "id", "y", 0.3, 0.1).collect()}
    assert a == b and sum(v == "test" for v in a.values()) == sum(-(-n * 3 // 10) for n in (334, 333, 333))


def test_training_statistics_ignore_test_rows(spark):
    df = E.stratified_split(spark.range(100).select("id", F.col("id").cast("double").alias("v")), "id", None, 0.3)
    wild = df.withColumn("v", F.when(F.col("split") == "test", 1e9).otherwise(F.col("v")))
    a, b = (E.leakage_safe_fit(d, ["v"]).filter("split = 'train'").orderBy("id").collect() for d in (df, wild))
    assert a == b


@pytest.mark.parametrize("hot", [0.34, 0.9])
def test_a_hot_key_is_cut_into_chunks(spark, tiny_chunks, hot):
    df = spark.range(3000).select(
        F.when(F.col("id") % 100 < int(hot * 100), 0).otherwise(F.col("id") % 50).alias("k"), "id")
    got = with_running(df, ["k"], ["id"], {"s": F.col("id")}).toPandas().sort_values(["k", "id"])
    assert (got.s == got.groupby("k").id.cumsum()).all()
    q = agg_with_quantiles(df, ["k"], [F.count(F.lit(1)).alias("n")], {"q": ("id", 0.37)}).toPandas().set_index("k").q
    want = got.groupby("k").id.quantile(0.37)
    assert abs(q - want).max() < 1e-9


@pytest.mark.parametrize("small", [True, False])
def test_nulls_ties_and_hot_keys_equal_the_plain_window(spark, small):
    """Null keys and order values, one value in 90 % of the rows, one key with a third."""
    df = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 5).cast("string")).alias("k"),
        F.when(F.col("id") % 41 == 0, None).when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") % 13).alias("v"), "id", F.when(F.col("id") % 17 > 0, F.col("id") * 1.5).alias("x"))
    w = W.partitionBy("k").orderBy("v", "id")
    whole = W.partitionBy("k")
    want = df.withColumn("p", F.row_number().over(w) - 1).withColumn("s", F.sum("x").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("a", F.sum("x").over(whole))
    if small:
        spark.conf.set("faultspark.chunkBytes", "500")
    try:
        got = with_position(with_running(df, ["k"], ["v", "id"], {"s": F.col("x")}, {"a": "s"}), ["k"], ["v", "id"], "p")
        assert sorted(map(str, got.select("k", "v", "id", "p", "s", "a").collect())) == sorted(map(str, want.select("k", "v", "id", "p", "s", "a").collect()))
        q = agg_with_quantiles(df, ["k"], [F.count("x").alias("n")], {"m": ("v", 0.5), "u": ("x", 0.9)})
        exact = df.groupBy("k").agg(F.count("x").alias("n"), F.percentile("v", 0.5).alias("m"), F.percentile("x", 0.9).alias("u"))
        rounded = lambda d: sorted(str((r["k"], r["n"], round(r["m"], 6), round(r["u"], 6))) for r in d.collect())
        assert rounded(q) == rounded(exact)
        assert agg_with_quantiles(df.filter("x IS NULL"), [], [F.count(F.lit(1)).alias("n")], {"m": ("x", 0.5)}).first()["m"] is None
    finally:
        spark.conf.unset("faultspark.chunkBytes")


def test_rows_without_a_group_stay(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("v"))
    assert E.stratified_split(df, "id", "y", 0.3).count() == 300
    assert M.winsorize(df, ["v"], ["y"]).filter("v IS NOT NULL").count() == 300
    assert P.clip_symmetric(df, "v", ["y"], 0.9).filter("v IS NOT NULL").count() == 300


def test_no_job_runs_while_a_small_query_is_built(spark):
    tables = Tables(spark, FOLDER)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        for name in ("roc_auc", "time_folds", "block_split", "stratified_split", "winsorize", "series_stats"):
            load_all()[name].build(tables)
        jobs = len(tracker.getJobIdsForGroup("building"))
        assert jobs <= 6 * 6, jobs  # schemas of the parquet files are read, nothing is counted
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_series_spreads_over_many_tasks(spark, tiny_chunks):
    df = spark.range(400).select((F.col("id") % 1).alias("series_id"), F.col("id").alias("idx"), F.sin("id").alias("value"))
    shuffles = [x for x in plan(S.gradients(df)).splitlines() if "hashpartitioning" in x]
    assert len(shuffles) == 1 and "series_id" in shuffles[0] and "__chunk" in shuffles[0]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 200 + i) for i in range(80)]
    e = spark.createDataFrame(chain + star, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + i] == 100 for i in range(80))


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_filters_reach_the_scan_and_columns_are_pruned(spark):
    t = Tables(spark, FOLDER)
    q = load_all()
    text = plan(q["confused_pairs"].build(t))
    assert "ReadSchema: struct<l_discount:double,l_tax:double,l_returnflag:string" in text.replace("l_partkey", "") and "l_comment" not in text
    text = plan(q["read_pv_history"].build(t))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    text = plan(L.join_ground_truth(t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("path")),
                                    t.customer.select(F.col("c_name").alias("file"), F.col("c_mktsegment").alias("label"), F.lit("Normal").alias("category"))))
    # the last truth row of a file counts, so labels are told apart after that, not at the scan
    assert "PushedFilters: [IsNotNull(c_name)]" in text and "c_address" not in text and "EqualTo(c_mktsegment" not in text


def test_running_sums_carry_no_borders(spark, tiny_chunks):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(with_running(df, ["k"], ["id"], {"s": F.col("id")}, {"all": "s"}))
    assert "NestedLoop" not in text and "Cartesian" not in text and "aggregate(" not in text


@pytest.mark.parametrize("name", ["segments", "series_stats", "cusum_page", "early_late", "join_ground_truth", "roc_auc", "coassociation", "read_many_pvs", "resample_linear"])
def test_no_pair_products_and_no_python_in_relational_plans(spark, name):
    text = plan(load_all()[name].build(Tables(spark, FOLDER)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text.replace("BroadcastNestedLoopJoin BuildRight, Inner\n", "") and "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", ["vote_ensemble", "per_label_outlier_recall", "detector_summary"])
def test_flags_sum_in_the_order_of_rows(spark, tmp_path, name):
    """Means near a limit are those of the rows in turn, however the table is cut into tasks."""
    pq.write_table(pq.read_table("/root/testdata/sf0.01/lineitem.parquet"), tmp_path / "lineitem.parquet", row_group_size=5000)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    cut = {"spark.sql.files.maxPartitionBytes": "100000", "spark.sql.files.openCostInBytes": "0", "faultspark.chunkBytes": "200000"}
    before = {k: spark.conf.get(k, None) for k in cut}
    try:
        for k, v in cut.items():
            spark.conf.set(k, v)
        assert check(spark, con, load_all()[name], str(tmp_path))[2] is None
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
