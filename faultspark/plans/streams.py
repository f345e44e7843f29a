"""Streaming queries, drained over the stored tables; the SQL is the batch result."""

from pyspark.sql import functions as F

from ..functions.exprs import micros
from ..functions.iterate import cut_lineage, shared_folder
from ..operators import series as S
from ..streaming import machine as M, streams as N
from .labels import TRUTH_SQL, event_files, truth_table
from .labels import CATS_SQL
from .registry import R, query
from .series import rounded


FILES = 5


def in_files(t, name, order):
    """The table dealt into parts in order of a column, null values first, read one part a batch.

    Each part is written by as many tasks as hold its rows, into a folder of its own; the
    source takes folders by age, and as many files a batch as a part has.
    """
    path = shared_folder(t.spark, f"stream-{name}")
    df = getattr(t, name)
    cuts = df.agg(F.percentile_approx(order, [i / FILES for i in range(1, FILES)], 1000)).first()[0] or []
    part = F.when(order.isNull(), 0).otherwise(sum(((order > F.lit(c)).cast("int") for c in cuts), F.lit(0)))
    tasks = df.rdd.getNumPartitions()
    for i in range(len(cuts) + 1):
        df.filter(part == i).write.parquet(f"{path}/part={i}")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", tasks).parquet(f"{path}/part=*")


def events(t):
    return in_files(t, "events", micros("ts"))


def logistic(d):
    return d.withColumn("score", 1.0 / (1.0 + F.exp(-(F.col("value") - 60) / 20)))


@query("stream_score_alert", "N1", f"WITH s AS (SELECT event_id, user_id, 1.0 / (1.0 + exp(-(value - 60) / 20)) AS score FROM events WHERE value >= 0.1 AND event_type <> 'view') SELECT event_id, user_id, {R('score')} AS score FROM s WHERE score > 0.8")
def _(t):
    gate = (F.col("value") >= 0.1) & (F.col("event_type") != "view")
    return rounded(N.drain(N.stream_score_alert(events(t), gate, logistic, 0.8).select("event_id", "user_id", "score")))


STATS = ", ".join(f"{R(e)} AS {n}" for n, e in (("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("min", "min(value)"), ("max", "max(value)"), ("rms", "sqrt(avg(value * value))")))


@query("stream_window_stats", "N2", f"""SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, {STATS} FROM events
  GROUP BY 1, 2, 3 HAVING "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    s = events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(N.drain(N.stream_window_stats(s, "ts", "value", ["event_type"], "1 day", "1 hour")))


@query("stream_session_stats", "N2", f"""WITH l AS (SELECT user_id, ts, value, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM l), x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, {STATS} FROM g GROUP BY user_id, sid)
  SELECT start, "end", user_id, n, mean, std, min, max, rms FROM x WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    s = events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(N.drain(N.stream_session_stats(s, "ts", "value", ["user_id"], "6 hours", "1 hour")))


@query("stream_event_features", "N3", f"""WITH b AS (SELECT user_id, (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS mid FROM events GROUP BY 1), p AS (SELECT e.user_id, value, epoch_us(ts) >= mid AS post FROM events e JOIN b USING (user_id))
  SELECT user_id, count(*) AS n, {R('avg(CASE WHEN NOT post THEN value END)')} AS mean_pre, {R('stddev_pop(CASE WHEN NOT post THEN value END)')} AS std_pre, {R('avg(CASE WHEN post THEN value END)')} AS mean_post, {R('stddev_pop(CASE WHEN post THEN value END)')} AS std_post,
    {R('max(CASE WHEN post THEN abs(value) END)')} AS max_abs_post, TRUE AS complete FROM p GROUP BY 1""")
def _(t):
    b = t.events.groupBy("user_id").agg(micros(F.min("ts")).alias("a"), micros(F.max("ts")).alias("z"), F.count(F.lit(1)).alias("expected")).selectExpr("user_id", "(a + z) div 2 AS mid", "expected")
    s = events(t).join(b, "user_id").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (micros("ts") >= F.col("mid")).cast("int").alias("post"), "expected")
    return rounded(N.drain(N.stream_event_features(s, "user_id", "ts", "1 hour")))


def _side_sql(side, post):
    keep = f"FILTER (WHERE post = {post})"
    real = {"mean": "avg(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "rms": "sqrt(avg(v * v))"}
    parts = [f"count(v) {keep} AS n_{side}", *[f"{R(e.replace(')', f') {keep}', 1) if n != 'rms' else f'sqrt(avg(v * v) {keep})')} AS {n}_{side}" for n, e in real.items()],
             f"CASE WHEN count(v) {keep} > 0 THEN {R(f'coalesce(regr_slope(v, idx) {keep}, 0)')} END AS slope_{side}", f"CASE WHEN count(v) {keep} > 0 THEN {R(f'coalesce(max(abs(v - prev)) {keep}, 0)')} END AS max_step_{side}",
             f"count(*) FILTER (WHERE post = {post} AND sign(v) <> sign(prev)) AS zero_crossings_{side}"]
    return ", ".join(parts)


@query("stream_event_machine", "N3", f"""WITH o AS (SELECT user_id, epoch_us(ts) AS us, value - 50 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
  b AS (SELECT user_id, (min(us) + max(us)) // 2 AS mid FROM o GROUP BY 1), p AS (SELECT o.*, (us >= mid)::INT AS post FROM o JOIN b USING (user_id)),
  l AS (SELECT *, lag(v) OVER (PARTITION BY user_id, post ORDER BY idx) AS prev FROM p)
  SELECT user_id, {_side_sql("pre", 0)}, {_side_sql("post", 1)}, {R("avg(v) FILTER (WHERE post = 1) - avg(v) FILTER (WHERE post = 0)")} AS jump, count(*) AS n_samples, TRUE AS complete FROM l GROUP BY 1""")
def _(t):
    e = t.events.select("user_id", "event_id", "ts", micros("ts").alias("us"), (F.col("value") - 50).alias("value"))
    b = e.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("z"), F.count(F.lit(1)).alias("expected")).selectExpr("user_id", "(a + z) div 2 AS mid", "expected")
    numbered = cut_lineage(S.index_samples(e, ["user_id"], ["us", "event_id"]).join(b, "user_id"))  # each part is read from it

    class Recorded:
        spark = t.spark
        samples = numbered.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "idx", "value", (F.col("us") >= F.col("mid")).cast("int").alias("post"), "expected")

    s = in_files(Recorded, "samples", F.unix_micros("ts"))
    return rounded(N.drain(M.stream_series_kernel(s, M.trigger_features(), "user_id", "ts", "1 hour", extra=["post"]), {M.STORE: M.ROCKS}))


@query("stream_dedup_files", "N4", "SELECT DISTINCT user_id || '/' || event_type AS path FROM events")
def _(t):
    s = events(t).select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"))
    return N.drain(N.stream_dedup_files(s, "path", "ts", "400 days").select("path"))  # a horizon longer than the table: each path once


@query("stream_label_join", "N5", f"""WITH {TRUTH_SQL}
  SELECT o_orderkey AS event_id, '/pm/' || year(o_orderdate) || '/Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || '.dat' AS path, (category <> 'Normal')::INT AS "binary",
    list_transform({CATS_SQL}, lambda c: (c = category)::INT) AS multilabel, category, CASE WHEN category = '{'Rég signal RF hors tolérance'}' THEN label END AS subtype
  FROM orders JOIN truth ON c_custkey = o_custkey WHERE label <> 'Filtré'""")
def _(t):
    class Streamed:
        orders = in_files(t, "orders", F.col("o_orderkey"))

    return N.drain(N.stream_label_join(event_files(Streamed), truth_table(t)))
