"""Streams in several batches, with shuffled and late files."""

from datetime import datetime, timedelta, timezone

import pytest

from faultspark.functions.iterate import shared_folder
from faultspark.operators import labels as L
from faultspark.streaming import streams as N

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event bigint, ts timestamp, value double, post int, expected bigint"


def stream(spark, files, schema=SCHEMA):
    """One file a batch, in the given order."""
    path = shared_folder(spark, "stream-test")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_event_whose_samples_come_in_several_batches(spark):
    files = [
        [(1, at(0), 1.0, 0, 4), (1, at(1), 3.0, 0, 4)], [(2, at(2), 5.0, 0, 1)], [(1, at(3), -7.0, 1, 4), (1, at(4), 2.0, 1, 4)],
        [(3, at(5), 1.0, 0, 9)], [(4, at(60 * 6), 1.0, 1, 1)], [(5, at(60 * 9), 1.0, 1, 1)]]
    got = {r["event"]: r for r in N.drain(N.stream_event_features(stream(spark, files), "event", "ts", "1 hour")).collect()}
    assert (got[1]["n"], got[1]["complete"], got[1]["mean_pre"], got[1]["mean_post"], got[1]["max_abs_post"]) == (4, True, 2.0, -2.5, 7.0)
    assert (got[3]["n"], got[3]["complete"]) == (1, False)  # its hour of patience is over
    assert all(got[k]["complete"] for k in (2, 4, 5)) and len(got) == 5


def test_shuffled_files_within_the_delay_change_nothing(spark):
    rows = [(i % 3, at(i), float(i), i % 2, 10) for i in range(30)]
    files = [rows[k::5] for k in (3, 0, 4, 1, 2)]
    got = {r["event"]: (r["n"], r["complete"]) for r in N.drain(N.stream_event_features(stream(spark, files), "event", "ts", "1 hour")).collect()}
    assert got == {0: (10, True), 1: (10, True), 2: (10, True)}


def test_rows_later_than_the_watermark_are_dropped(spark):
    """A batch drops what is later than the watermark that the batch before it began with."""
    files = [[(1, at(5), 1.0, 0, 1)], [(1, at(25), 2.0, 0, 1)], [(1, at(300), 3.0, 0, 1)], [(1, at(301), 3.0, 0, 1)], [(1, at(6), 9.0, 0, 1)], [(1, at(900), 4.0, 0, 1)]]
    got = N.drain(N.stream_window_stats(stream(spark, files), "ts", "value", ["event"], "1 hour", "30 minutes")).orderBy("start").collect()
    assert [(r["n"], r["max"]) for r in got] == [(2, 2.0), (2, 3.0)]
    got = N.drain(N.stream_session_stats(stream(spark, files), "ts", "value", ["event"], "1 hour", "30 minutes")).orderBy("start").collect()
    assert [(r["n"], r["max"]) for r in got] == [(2, 2.0), (2, 3.0)]


@pytest.mark.parametrize("delay, want", [("10 hours", 1), ("10 minutes", 2)])
def test_a_path_is_new_again_after_the_delay(spark, delay, want):
    files = [[("a", at(0))], [("a", at(1))], [("b", at(120))], [("b", at(121))], [("a", at(122))]]
    got = [r["path"] for r in N.drain(N.stream_dedup_files(stream(spark, files, "path string, ts timestamp"), "path", "ts", delay)).collect()]
    assert got.count("a") == want and got.count("b") == 1


def test_the_last_truth_row_of_a_name_counts(spark):
    events = spark.createDataFrame([(1, "/x/a.dat"), (2, "/x/b.dat")], "event_id bigint, path string")
    truth = spark.createDataFrame([("a.dat", "old", L.NORMAL, 1), ("a.dat", "new", L.FAULT_CATEGORIES[0], 2), ("b.dat", L.FILTERED, L.NORMAL, 5), ("b.dat", "x", L.NORMAL, 4)],
                                  "file string, label string, category string, line int")
    assert [(r["event_id"], r["category"]) for r in L.join_ground_truth(events, truth, order="line").collect()] == [(1, L.FAULT_CATEGORIES[0])]
    assert L.join_ground_truth(events, truth).filter("event_id = 1").count() == 1
