"""Series tables that the queries derive from the events table, and the same in SQL.

One recording per user: samples in time order, time relative to the middle of the
recording. ``value`` is the first channel and the number in ``props`` the second.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import micros
from ..operators import series as S

REF_DT = 2.16e10  # six hours, the reference spacing for these sparse recordings
PRE = 20  # window length at the reference spacing

SAMPLES_SQL = """s0 AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    epoch_us(ts) AS us, value, regexp_extract(props, '[0-9]+')::DOUBLE AS second FROM events),
  mid AS (SELECT series_id, (min(us) + max(us)) // 2 AS ref_us FROM s0 GROUP BY 1),
  s AS (SELECT series_id, idx, (us - ref_us)::DOUBLE AS t_us, value, second FROM s0 JOIN mid USING (series_id))"""
TRIGGER_SQL = """d AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY series_id ORDER BY idx) AS dt FROM s),
  trig AS (SELECT series_id, (array_agg(idx ORDER BY abs(t_us), idx))[1] AS z, count(*) AS n, coalesce(median(dt), 1.0) AS dt_us FROM d GROUP BY 1)"""
BASE_SQL = f"WITH {SAMPLES_SQL}, {TRIGGER_SQL}, a AS (SELECT s.*, z, n, dt_us FROM s JOIN trig USING (series_id))"


def scaled_sql(n: float) -> str:
    return f"greatest(1, round_even({n * REF_DT} / CASE WHEN dt_us > 0 THEN dt_us ELSE {REF_DT} END, 0)::INT)"


WINDOW_SQL = f"""{BASE_SQL}, w AS (SELECT *, {scaled_sql(PRE)} AS win_n FROM a),
  win AS (SELECT *, idx - (z - win_n) AS pos FROM w WHERE z >= win_n AND idx >= z - win_n AND idx < z)"""


def samples(t):
    e = t.events.select(
        F.col("user_id").alias("series_id"), micros("ts").alias("us"), "event_id", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("second"))
    s = S.index_samples(e, ["series_id"], ["us", "event_id"])
    mid = e.groupBy("series_id").agg(F.min("us").alias("a"), F.max("us").alias("b")).selectExpr("series_id", "(a + b) div 2 AS ref_us")
    d = s.join(mid, "series_id")
    return d.select("series_id", "idx", (F.col("us") - F.col("ref_us")).cast("double").alias("t_us"), "value", "second")


def window(t):
    s = samples(t)
    return S.pre_window(s, S.find_trigger(s), PRE, REF_DT)
