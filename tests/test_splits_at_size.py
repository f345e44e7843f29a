"""Splits of a large table: no task holds a stratum, no source is computed twice, sizes stay exact."""

import math

import pytest
from pyspark.sql import functions as F

from faultspark.functions.ordering import chunk_count
from faultspark.operators import splits as E


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_one_stratum_is_shared_by_tasks(spark, many_parts):
    df = spark.range(4000).withColumn("y", F.lit(1))
    assert largest(E.kfold(df, "id", "y")) < 2000
    assert largest(E.stratified_split(df, "id", "y", 0.3)) < 2000


def test_borders_are_exact_with_equal_and_missing_keys(spark, tiny_chunks):
    # one key for a third of the rows, none for some: their hashes fall into one bucket
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 > 0, F.col("id")).alias("k"), (F.col("id") % 2).alias("y"), "id")
    for stratum, sizes in ((None, [3000]), ("y", [1500, 1500])):
        d = E.stratified_split(df, "k", stratum, 0.3, 0.1).groupBy(*([stratum] if stratum else []), "split").count().collect()
        got = {}
        for r in d:
            got[r["split"]] = got.get(r["split"], 0) + r["count"]
        test = [n * 3 // 10 for n in sizes]
        val = [math.ceil((n - t) * (0.1 / (1.0 - 0.3))) for n, t in zip(sizes, test)]
        assert got == {"test": sum(test), "val": sum(val), "train": sum(sizes) - sum(test) - sum(val)}
        folds = E.kfold(df, "k", stratum).groupBy("fold").count().collect()
        assert {r["count"] for r in folds} == {600}


def test_repeats_compute_their_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for p in it:
            seen.add(len(p))
            yield p

    df = spark.range(200).withColumn("y", F.col("id") % 2).mapInPandas(count, "id bigint, y bigint")
    size = lambda d: d.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("n").alias("metric"), F.lit("all").alias("label_name"), "value")
    rows = E.repeated_eval(df, "id", "y", lambda train: lambda d: d, size, n=3).collect()
    assert [r["value"] for r in rows] == [60.0] * 3
    assert seen.value == 200


def test_a_large_file_is_several_parts(spark):
    # 26 MB of files, some 600,000 and 10,000 rows
    two = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").select(F.lit(1)) for t in ("lineitem", "documents")]
    assert chunk_count(two[0].unionByName(two[1])) == 2
