"""Live recordings with Structured Streaming; each operator agrees with its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.iterate import shared_folder
from ..operators.labels import join_ground_truth


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of one table as a stream, with the schema of the stored files."""
    schema = spark.read.parquet(f"{folder}/{name}*.parquet").schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(f"{folder}/{name}*.parquet")


def drain(stream: DataFrame, settings: dict[str, str] = {}) -> DataFrame:
    """Process all available input into files on the shared checkpoint folder and return them.

    ``settings`` hold for this stream only.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        q = (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_score_alert(stream: DataFrame, gate: Column, score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Quality gate, model score and alert filter on each arriving row."""
    return score(stream.filter(gate)).filter(F.col("score") > threshold)


def stream_window_stats(stream: DataFrame, ts: str, value: str, keys: list[str], duration: str, delay: str, slide: str | None = None) -> DataFrame:
    """Statistics per time window; rows later than the watermark are dropped."""
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    return _stats(stream.withWatermark(ts, delay).groupBy(w.alias("w"), *keys), value, keys)


def stream_session_stats(stream: DataFrame, ts: str, value: str, keys: list[str], gap: str, delay: str) -> DataFrame:
    """The same per burst of activity, ended by a pause of ``gap``."""
    return _stats(stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys), value, keys)


def _stats(grouped, value: str, keys: list[str]) -> DataFrame:
    g = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
                    F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n", "mean", "std", "min", "max", "rms")


def stream_event_features(stream: DataFrame, event: str, ts: str, delay: str, timeout_ms: int = 3_600_000) -> DataFrame:
    """Pre- and post-trigger statistics of each event, sent when its ``expected`` samples are in or it times out.

    Rows carry ``post`` (0 or 1), ``value`` and ``expected``. The state is a few running
    numbers per side, whatever the length of the recording. An event times out once the
    watermark is ``timeout_ms`` beyond the largest time of its own rows, so how the input is
    cut into batches does not matter.
    """
    out = f"`{event}` bigint, n bigint, mean_pre double, std_pre double, mean_post double, std_post double, max_abs_post double, complete boolean"
    state_schema = "n bigint, n0 bigint, s0 double, q0 double, n1 bigint, s1 double, q1 double, m1 double, expected bigint, last bigint"

    def row(key, st, complete: bool) -> pd.DataFrame:
        n, n0, s0, q0, n1, s1, q1, m1, *_ = st

        def mean_std(k, s, q):
            return (s / k, float(np.sqrt(max(q / k - (s / k) ** 2, 0.0)))) if k else (None, None)

        (a, b), (c, d) = mean_std(n0, s0, q0), mean_std(n1, s1, q1)
        return pd.DataFrame([[key[0], n, a, b, c, d, m1 if n1 else None, complete]], columns=[event, "n", "mean_pre", "std_pre", "mean_post", "std_post", "max_abs_post", "complete"])

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            st = state.get
            state.remove()
            yield row(key, st, False)
            return
        n, n0, s0, q0, n1, s1, q1, m1, expected, last = state.get if state.exists else (0, 0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0, 0)
        for f in frames:
            v, late = f["value"].to_numpy(float), f["post"].to_numpy() == 1
            n, expected = n + len(f), int(f["expected"].max())
            last = max(last, int(f[ts].max().timestamp() * 1000))
            a, b = v[~late], v[late]
            n0, s0, q0 = n0 + len(a), s0 + a.sum(), q0 + (a * a).sum()
            n1, s1, q1 = n1 + len(b), s1 + b.sum(), q1 + (b * b).sum()
            m1 = max(m1, np.abs(b).max()) if len(b) else m1
        st = (int(n), int(n0), float(s0), float(q0), int(n1), float(s1), float(q1), float(m1), int(expected), int(last))
        if n >= expected:
            if state.exists:
                state.remove()
            yield row(key, st, True)
        else:
            state.update(st)
            state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))

    d = stream.withWatermark(ts, delay)
    return d.groupBy(event).applyInPandasWithState(update, out, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def stream_dedup_files(stream: DataFrame, path: str, ts: str, delay: str) -> DataFrame:
    """The first arrival of each path; one that comes again ``delay`` or more later, by event
    time and once the watermark has passed, counts as new."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([path])


def stream_label_join(stream: DataFrame, truth: DataFrame, path: str = "path") -> DataFrame:
    """Labels for arriving events from the static truth table."""
    return join_ground_truth(stream, truth, path)
