import pytest
from pyspark.sql import functions as F

from faultspark.functions.exprs import safe_corr
from faultspark.sources import ingest as I


def test_listing_and_skip_reasons(spark, tmp_path):
    for name, size in (("a_rec", 100), ("b_rec", 99), ("c.TXT", 500), ("sub/d_rec", 300), ("e.", 150)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * size)
    rows = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in I.scan_files(I.list_files(spark, str(tmp_path))).collect()}
    assert rows == {"a_rec": None, "b_rec": "too_small", "c.TXT": "excluded_suffix", "d_rec": None, "e.": None}


def test_hidden_comes_before_excluded_name(spark):
    df = spark.createDataFrame([("/x/.DS_Store", 1000), ("/x/Thumbs.db", 1000)], "path string, length bigint")
    assert [r["reason"] for r in I.scan_files(df).orderBy("path").collect()] == ["hidden", "excluded_name"]


def test_header_cases(spark):
    text = "KPI = 9.99 (x)\nno equals\nACQ1=1(s)\nACQx=2\nSPAN=a(b)c(d)\nKPI=10(y)\nEMPTY=\n"
    r = I.parse_header(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r["header"] == {"ACQ1": "1", "ACQx": "2", "SPAN": "a(b)c", "KPI": "10", "EMPTY": ""} and r["num_acq"] == 1


def test_truth_file(spark, tmp_path):
    p = tmp_path / "truth.csv"
    p.write_text("Fichier;Defaut;Label;Détails\n/a/b/x.dat;Normal;ok;\ny.dat;;Filtré;mean voltage\n", encoding="utf-8")
    rows = I.read_delimited_truth(spark, str(p)).orderBy("file").collect()
    assert [tuple(r) for r in rows] == [("x.dat", "Normal", "ok", ""), ("y.dat", "", "Filtré", "mean voltage")]


def test_dataset_round_trip_is_partitioned(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 4).alias("year"))
    I.write_dataset(df, f"{tmp_path}/d", ["year"])
    back = spark.read.parquet(f"{tmp_path}/d").filter("year = 1")
    assert back.count() == 5 and "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().toString()


def test_metrics_need_rows_and_run_keys(spark, tmp_path):
    rows = spark.createDataFrame([("acc", "all", 0.5, ".1%")], "metric string, label_name string, value double, fmt string")
    run = {"dataset_version": "v", "dataset_path": "p", "script": "s"}
    I.write_metrics(rows, f"{tmp_path}/m", "phase", run)
    assert spark.read.parquet(f"{tmp_path}/m").first()["display"] == "50.0%"
    with pytest.raises(ValueError):
        I.write_metrics(rows.filter("false"), f"{tmp_path}/m", "phase", run)
    with pytest.raises(ValueError):
        I.write_metrics(rows, f"{tmp_path}/m", "phase", {"script": "s"})


def test_half_open_range_keeps_start_and_nanos_order(spark):
    s = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5, 1.0), (1, "2024-01-01 00:00:00", 2, 2.0), (1, "2024-01-02 00:00:00", 0, 3.0)], "channel_id int, t string, nanosecs bigint, float_val double").withColumn("smpl_time", F.to_timestamp("t"))
    c = spark.createDataFrame([(1, "a")], "channel_id int, name string")
    bounds = [F.to_timestamp(F.lit(x)) for x in ("2024-01-01", "2024-01-02")]
    assert [r["value"] for r in I.read_pv_history(s, c, "a", *bounds).collect()] == [2.0, 1.0]
    assert I.read_pv_history(s, c, "zzz", *bounds).count() == 0


def test_correlation_with_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert df.agg(safe_corr("x", "y")).first()[0] is None
