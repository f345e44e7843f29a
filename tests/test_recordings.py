"""Headers of binary recordings, by seeking and from the bytes of binaryFile."""

import os
import struct

from pyspark.sql import functions as F

from faultspark.sources import ingest as I, recordings as V

HEADER = "KPI = 9.99 (x)\nno equals\nACQ1=1(s)\nACQx=2\nKPI=10(dB)\nPLAIN=7\nÉTAT=é(u)\n".encode()


def put(folder, name, raw):
    p = folder / name
    p.parent.mkdir(exist_ok=True, parents=True)
    p.write_bytes(raw)


def fixture(folder):
    pad = b"KPI=0(x)\n" * 40
    put(folder, "2019 11 06/good one", struct.pack(">i", len(HEADER)) + HEADER + pad)
    put(folder, "a%20b+c", struct.pack(">i", 5) + b"A=1\xff\xfe" + pad)  # bytes that are no UTF-8, a name that looks encoded
    put(folder, "negative", struct.pack(">i", -5) + pad)
    put(folder, "shorter", struct.pack(">i", 10**6) + b"B=2(u)\n" * 20)
    put(folder, "none", struct.pack(">i", 0) + pad)
    put(folder, "h99", struct.pack(">i", 3) + b"C=3" + b"x" * 92)
    put(folder, "h100", struct.pack(">i", 3) + b"C=3" + b"x" * 93)
    put(folder, "c.TXT", struct.pack(">i", 3) + b"C=3" + pad)
    put(folder, ".hidden", struct.pack(">i", 3) + b"C=3" + pad)


def test_recordings_of_all_kinds(spark, tmp_path):
    fixture(tmp_path)
    got = {r["path"].rsplit("/", 1)[1]: r for r in V.scan_recordings(spark, str(tmp_path)).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "good one": None, "a%20b+c": None, "negative": "other_error", "shorter": None, "none": None, "h99": "too_small", "h100": None, "c.TXT": "excluded_suffix"}
    assert got["good one"]["header"] == {"ACQ1": "1", "ACQx": "2", "KPI": "10", "PLAIN": "7", "ÉTAT": "é"} and got["good one"]["num_acq"] == 1
    assert got["a%20b+c"]["header"] == {"A": "1"} and got["none"]["header"] == {} and got["shorter"]["header"] == {"B": "2"} and got["h100"]["header"] == {"C": "3"}
    assert all(got[k]["header"] is None for k in ("negative", "h99", "c.TXT"))


def test_both_ways_agree(spark, tmp_path):
    fixture(tmp_path)
    size, text, failed = V.decode_header("content")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    native = {r[0]: tuple(r)[1:] for r in raw.select("path", size, text, failed).collect()}
    seek = {r["path"]: (r["header_size"], r["header_text"], r["failed"]) for r in V.read_headers(I.list_files(spark, str(tmp_path))).collect()}
    assert native == seek and len(seek) == 8


def test_missing_null_and_clashing(spark, tmp_path):
    put(tmp_path, "two", b"\x00\x01")
    rows = spark.createDataFrame([(f"{tmp_path}/two", "old"), (f"{tmp_path}/gone", "old"), (None, "old")], "path string, header_text string").withColumn("path ", F.lit(1))
    got = V.read_headers(rows).collect()
    assert [(r["header_size"], r["header_text"], r["readable"], r["failed"], r["path "]) for r in got] == [(None, None, True, True, 1)] * 3
    assert V.read_headers(rows.filter("false")).count() == 0


def test_samples_are_not_read(tmp_path):
    """A sparse file of 8 GB opens as fast as a small one."""
    put(tmp_path, "huge", struct.pack(">i", 3) + b"D=4")
    os.truncate(tmp_path / "huge", 8 << 30)
    assert V._header(f"file:{tmp_path}/huge") == (3, "D=4", True, False)


def test_written_recordings_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"r {i}", f"N={i}(u)\né=ü", bytearray(b"N=9\n" * 40)) for i in range(20)], "name string, header string, body binary")
    assert V.write_recordings(rows, f"file:{tmp_path}/out") == 20
    back = V.scan_recordings(spark, f"{tmp_path}/out").select(I.basename("path").alias("f"), F.col("header")["N"].alias("n"), F.col("header")["é"].alias("u")).collect()
    assert sorted((r["f"], r["n"], r["u"]) for r in back) == sorted((f"r {i}", str(i), "ü") for i in range(20))


def test_tasks_list_what_spark_lists(spark, tmp_path):
    fixture(tmp_path)
    for name in ("a/b/c/deep", "a/_hidden/x", "a/.hid/x", "_x", "_k=1/y", "_metadata", "half._COPYING_", "a/empty", "b c+d%20/é"):
        put(tmp_path, name, b"" if name.endswith("empty") else b"12345")
    want = sorted(tuple(r) for r in I.list_files(spark, str(tmp_path)).selectExpr("path", "length", "unix_millis(modificationTime)").collect())
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        assert sorted(tuple(r) for r in V.list_in_tasks(spark, folder).selectExpr("path", "length", "unix_millis(modificationTime)").collect()) == want
    assert len(want) > 10 and V.list_in_tasks(spark, f"{tmp_path}/a*").count() == I.list_files(spark, f"{tmp_path}/a*").count()


def test_recordings_are_spread_over_folders_and_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FILES", 4)
    rows = spark.range(60).selectExpr("concat('r', id) AS name", "concat('N=', id) AS header", "binary(repeat('x', 100)) AS body")
    assert V.write_recordings(rows, str(tmp_path / "out"), spread=True) == 60
    back = V.scan_recordings(spark, str(tmp_path / "out"))
    assert sorted(r[0] for r in back.select(F.col("header")["N"]).collect()) == sorted(str(i) for i in range(60))
    assert max(len(os.listdir(tmp_path / "out" / d)) for d in os.listdir(tmp_path / "out")) < 20
    assert back.select(F.spark_partition_id()).distinct().count() > 8
