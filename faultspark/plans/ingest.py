"""Queries for sources, ingest and sinks."""

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..functions.iterate import shared_folder
from ..sources import ingest as I, recordings as V
from .registry import query

SUFFIXES = "'.txt','.md','.json','.pyc','.log','.xml','.html','.pdf','.png','.jpg','.jpeg','.gif','.csv','.fig'"

# pages stand in for a file listing: the kind of file follows from the page id
FILES_SQL = """files AS (
  SELECT CASE page_id % 6 WHEN 0 THEN '/raw/.page' || page_id WHEN 1 THEN '/raw/page' || page_id || '.PNG'
           WHEN 2 THEN '/raw/page' || page_id || '.fig' WHEN 3 THEN '/raw/.DS_Store'
           ELSE '/raw/sub/page' || page_id || '_rec' END AS path,
         CASE WHEN page_id % 12 = 4 THEN length(url) ELSE length(html) END AS length
  FROM pages)"""


def page_files(t):
    pid = F.col("page_id").cast("string")
    kind = F.col("page_id") % 6
    return t.pages.select(
        F.when(kind == 0, F.concat(F.lit("/raw/.page"), pid))
        .when(kind == 1, F.concat(F.lit("/raw/page"), pid, F.lit(".PNG")))
        .when(kind == 2, F.concat(F.lit("/raw/page"), pid, F.lit(".fig")))
        .when(kind == 3, F.lit("/raw/.DS_Store"))
        .otherwise(F.concat(F.lit("/raw/sub/page"), pid, F.lit("_rec"))).alias("path"),
        F.when(F.col("page_id") % 12 == 4, F.length("url")).otherwise(F.length("html")).alias("length"))


REASON_SQL = f"""CASE WHEN name LIKE '.%' THEN 'hidden'
      WHEN name IN ('.directory','.DS_Store','Thumbs.db') THEN 'excluded_name'
      WHEN lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN ({SUFFIXES}) THEN 'excluded_suffix'
      WHEN length < 100 THEN 'too_small' END"""


@query("scan_files", "A1", f"""WITH {FILES_SQL}, n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM files)
  SELECT path, length::INT AS length, {REASON_SQL} AS reason FROM n""")
def _(t):
    return I.scan_files(page_files(t))


@query("scan_summary", "A1", f"""WITH {FILES_SQL}, n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM files)
  SELECT coalesce({REASON_SQL}, 'usable') AS reason, count(*) AS n_files, sum(length)::BIGINT AS total_bytes
  FROM n GROUP BY 1""")
def _(t):
    return I.scan_summary(I.scan_files(page_files(t)))


@query("parse_header", "A2", """WITH h AS (SELECT o_orderkey, unnest(['KPI', 'NDEC', 'ACQ1', 'STATUS']) AS key,
    unnest([o_totalprice::DECIMAL(18,2)::VARCHAR, (o_orderkey % 400)::VARCHAR, 'a(b', o_orderstatus]) AS value FROM orders)
  SELECT o_orderkey, key, value, 1 AS num_acq FROM h""")
def _(t):
    text = F.concat(
        F.lit("KPI = "), F.format_string("%.2f", "o_totalprice"), F.lit(" (keV)\n no separator here\nNDEC="),
        (F.col("o_orderkey") % 400).cast("string"), F.lit("\nACQ1=a(b(unit)\nSTATUS=old\nSTATUS = "), "o_orderstatus",
        F.lit(" ()\n"))
    d = I.parse_header(t.orders.select("o_orderkey", text.alias("text")), "text")
    return d.select("o_orderkey", F.explode("header"), "num_acq")


@query("clean_truth", "A3", """SELECT regexp_extract('/pm/' || c_nationkey || '/' || c_name || '.dat', '[^/]*$') AS file,
    CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS category,
    coalesce(CASE WHEN c_acctbal > 0 THEN 'ok' END, '') AS label, '' AS details FROM customer""")
def _(t):
    raw = t.customer.select(
        F.concat(F.lit("/pm/"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_name", F.lit(".dat")).alias("Fichier"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("Defaut"),
        F.when(F.col("c_acctbal") > 0, F.lit("ok")).alias("Label"), F.lit(None).cast("string").alias("Détails"))
    return I.clean_truth(raw)


@query("incremental_ingest", "A4", """SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def _(t):
    done = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    new = t.orders.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    return I.incremental_ingest(new, done, "o_orderkey")


@query("union_batches", "A5", """SELECT s_suppkey::BIGINT AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier
  UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer
  UNION ALL SELECT p_partkey, NULL, p_retailprice, NULL FROM part""")
def _(t):
    return I.union_batches([
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("balance"))])


OUTCOME_SQL = """outcomes AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'error'
    WHEN o_totalprice < 100000 THEN 'quality_fail' ELSE 'quality_pass' END AS outcome FROM orders)"""


def order_outcomes(t):
    d = t.orders.withColumn("success", F.col("o_orderstatus") != "P").withColumn("quality_pass", F.col("o_totalprice") >= 100000)
    return I.split_outcomes(d)


@query("split_outcomes", "A6", f"WITH {OUTCOME_SQL} SELECT outcome, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM outcomes GROUP BY 1")
def _(t):
    return order_outcomes(t).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


@query("top_errors", "A6", f"WITH {OUTCOME_SQL} SELECT o_orderpriority AS error, count(*) AS n FROM outcomes WHERE outcome = 'error' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def _(t):
    return I.top_errors(order_outcomes(t).withColumnRenamed("o_orderpriority", "error"), n=3)


@query("write_dataset", "A9", """SELECT o_orderstatus, year(o_orderdate)::INT AS year, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders
  GROUP BY 1, 2""")
def _(t):
    path = shared_folder(t.spark, "dataset")
    I.write_dataset(t.orders.withColumn("year", F.year("o_orderdate")), path, ["o_orderstatus", "year"])
    back = t.spark.read.parquet(path)
    return back.groupBy("o_orderstatus", "year").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def archive(t):
    sample = t.orders.select(F.col("o_custkey").alias("channel_id"), F.col("o_orderdate").alias("smpl_time"),
                             F.col("o_orderkey").alias("nanosecs"), F.col("o_totalprice").alias("float_val"))
    channel = t.customer.select(F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("name"))
    return sample, channel


@query("read_pv_history", "A7", """SELECT o_orderdate AS time, o_orderkey AS nanosecs, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_name = 'Customer#000000007' AND o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def _(t):
    sample, channel = archive(t)
    bounds = [F.to_timestamp(F.lit(d)) for d in ("1993-01-01", "1999-01-01")]
    return I.read_pv_history(sample, channel, "Customer#000000007", *bounds)


@query("read_many_pvs", "A8", """WITH req AS (SELECT c_custkey AS request_id, c_name AS name, c_custkey AS channel_id,
    TIMESTAMP '1997-01-01' + to_days((c_custkey % 200)::INT) AS t0,
    TIMESTAMP '1997-01-01' + to_days((c_custkey % 200 + 30 + c_nationkey * 10)::INT) AS t1 FROM customer)
  SELECT request_id, name, o_orderdate AS time, o_orderkey AS nanosecs, o_totalprice AS value
  FROM req JOIN orders ON o_custkey = channel_id AND o_orderdate >= t0 AND o_orderdate < t1""")
def _(t):
    sample, channel = archive(t)
    day0 = F.to_timestamp(F.lit("1997-01-01"))
    shift = (F.col("c_custkey") % 200).cast("int")
    req = t.customer.select(
        F.col("c_custkey").alias("request_id"), F.col("c_name").alias("name"),
        (day0 + F.make_dt_interval(shift)).alias("start"),
        (day0 + F.make_dt_interval(shift + 30 + F.col("c_nationkey") * 10)).alias("end"))
    return I.read_many_pvs(sample, channel, req)


@query("metric_rows", "A10", """SELECT 'summary' AS phase, o_orderpriority || ':' || m AS metric, m AS label_name, value, fmt,
    CASE fmt WHEN ',' THEN format('{:,}', round(value)::BIGINT) WHEN '.2f' THEN printf('%.2f', value)
      ELSE printf('%.1f', value * 100) || '%' END AS display,
    'v1' AS dataset_version, 'orders' AS dataset_path, 'overview' AS script, TIMESTAMP '2024-01-01' AS generated_at
  FROM (SELECT o_orderpriority, unnest(['n', 'mean', 'share']) AS m, unnest([count(*)::DOUBLE, round(avg(o_totalprice), 3),
      round(avg((o_orderstatus = 'F')::INT), 4)]) AS value, unnest([',', '.2f', '.1%']) AS fmt FROM orders GROUP BY o_orderpriority)""")
def _(t):
    g = t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).cast("double").alias("n"), rnd(F.avg("o_totalprice"), 3).alias("mean"),
        rnd(F.avg((F.col("o_orderstatus") == "F").cast("int")), 4).alias("share"))
    rows = g.select("o_orderpriority", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.col(m).alias("value"), F.lit(f).alias("fmt"))
        for m, f in (("n", ","), ("mean", ".2f"), ("share", ".1%"))])).alias("r"))
    rows = rows.select(F.concat("o_orderpriority", F.lit(":"), "r.m").alias("metric"), F.col("r.m").alias("label_name"), "r.value", "r.fmt")
    run = {"dataset_version": "v1", "dataset_path": "orders", "script": "overview"}
    return I.metric_rows(rows, "summary", run, F.to_timestamp(F.lit("2024-01-01")))


@query("write_metrics", "A10", """SELECT 'orders' AS phase, o_orderstatus AS metric, 'total' AS label_name, round(sum(o_totalprice), 2) AS value, format('{:,}', count(*)) AS display FROM orders GROUP BY o_orderstatus""")
def _(t):
    g = t.orders.groupBy(F.col("o_orderstatus").alias("metric")).agg(rnd(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    path = shared_folder(t.spark, "metrics")
    run = {"dataset_version": "v1", "dataset_path": "orders", "script": "ingest"}
    I.write_metrics(g.select("metric", F.lit("total").alias("label_name"), F.col("total").alias("value"), F.lit(None).cast("string").alias("fmt")), path, "orders", run)
    I.write_metrics(g.select("metric", F.lit("n").alias("label_name"), F.col("n").alias("value"), F.lit(",").alias("fmt")), path, "orders", run)
    back = t.spark.read.parquet(path)
    counts = back.filter("label_name = 'n'").select("metric", "display")
    return back.filter("label_name = 'total'").drop("display").join(counts, "metric").select("phase", "metric", "label_name", "value", "display")


@query("read_delimited_truth", "A3", """SELECT c_name || '.dat' AS file, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'n' || c_nationkey END AS category, c_mktsegment AS label, '' AS details FROM customer""")
def _(t):
    path = shared_folder(t.spark, "truth")
    raw = t.customer.select(F.concat(F.lit("/raw/2024/"), "c_name", F.lit(".dat")).alias("Fichier"), F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("Defaut"),
                            F.col("c_mktsegment").alias("Label"), F.lit(None).cast("string").alias("Détails"))
    raw.write.csv(path, sep=";", header=True)
    return I.read_delimited_truth(t.spark, path)


@query("list_files", "A1", "SELECT o_orderstatus AS folder, TRUE AS complete, TRUE AS all_sized FROM orders GROUP BY 1")
def _(t):
    """Every file of a folder is listed: as many as the rows read back from it come from."""
    path = shared_folder(t.spark, "listing")
    t.orders.select("o_orderstatus", "o_orderkey").repartition("o_orderstatus", F.pmod(F.xxhash64("o_orderkey"), F.lit(16))).write.partitionBy("o_orderstatus").parquet(path)
    f = I.list_files(t.spark, path).filter(F.col("path").endswith(".parquet"))
    folder = F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1)
    listed = f.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_listed"), F.min(F.col("length") > 0).alias("all_sized"))
    held = t.spark.read.parquet(path).select(F.col("o_orderstatus").alias("folder"), F.input_file_name().alias("file")).groupBy("folder").agg(F.countDistinct("file").alias("n_held"))
    return listed.join(held, "folder").select("folder", (F.col("n_listed") == F.col("n_held")).alias("complete"), "all_sized")


@query("recording_headers", "A2", """WITH r AS (SELECT o_custkey AS k, count(*) AS n, 'rec ' || o_custkey || CASE o_custkey % 7 WHEN 2 THEN '.TXT' ELSE '' END AS file FROM orders GROUP BY 1),
  q AS (SELECT *, CASE WHEN k % 7 = 2 THEN 'excluded_suffix' WHEN k % 7 = 3 THEN 'too_small' END AS reason FROM r)
  SELECT file, reason, CASE WHEN reason IS NULL THEN n::VARCHAR END AS nrow, CASE WHEN reason IS NULL AND k % 2 = 0 THEN (k % 20)::VARCHAR END AS kpi, CASE WHEN reason IS NULL THEN 'CM(A)' || k END AS dbname,
    CASE WHEN reason IS NULL THEN 1 + (n > 1)::INT END AS num_acq FROM q""")
def _(t):
    """Recordings written from the orders of each customer, listed and opened again."""
    path = shared_folder(t.spark, "recordings")
    k = F.col("o_custkey")
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("rec "), k.cast("string"), F.when(k % 7 == 2, ".TXT").otherwise(""))
    header = F.concat(F.lit("DBNAME=CM(A)"), k.cast("string"), F.lit("(name)\nno value\nNROW = "), F.col("n").cast("string"), F.lit(" (samples)\nACQ1=5(s)\nACQx=1\n"),
                      F.when(F.col("n") > 1, "ACQ2=7\n").otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("KPI="), (k % 20).cast("string"), F.lit("(dB)\n"))).otherwise(""))
    short = F.when(k % 7 == 3, F.lit("A=1")).otherwise(header)
    body = F.when(k % 7 == 3, F.lit("")).otherwise(F.repeat(F.lit("KPI=0(x)\n"), 512)).cast("binary")  # looks like a header, must not be read
    V.write_recordings(g.select(name.alias("name"), short.alias("header"), body.alias("body")), path, spread=True)
    s = V.scan_recordings(t.spark, path)
    h = F.col("header")
    return s.select(I.basename("path").alias("file"), "reason", h["NROW"].alias("nrow"), h["KPI"].alias("kpi"), h["DBNAME"].alias("dbname"), F.when(F.col("reason").isNull(), F.col("num_acq")).alias("num_acq"))
