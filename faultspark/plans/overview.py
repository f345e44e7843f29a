"""Queries for overview and reporting aggregates."""

from pyspark.sql import functions as F

from ..operators import overview as O
from .registry import R, query
from .series import rounded


@query("class_balance", "O1", f"SELECT event_type AS label, count(*) AS n, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct, {R('count(*) / max(count(*)) OVER ()')} AS ratio FROM events GROUP BY 1")
def _(t):
    return O.class_balance(t.events, "event_type")


ML_SQL = "ml AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS r, max((l_linestatus = 'F')::INT) AS f, max((l_discount > 0.09)::INT) AS d FROM lineitem GROUP BY 1)"


def multilabels(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("f"),
                                                F.max((F.col("l_discount") > 0.09).cast("int")).alias("d"))


@query("label_cardinality", "O2", f"WITH {ML_SQL}, k AS (SELECT r + f + d AS k FROM ml) SELECT count(*) AS n, count_if(k = 1) AS n_single, count_if(k > 1) AS n_multi, {R('avg(CASE WHEN k > 0 THEN k END)')} AS mean_labels_per_fault, max(k)::INT AS max_labels, {R('avg(k)')} AS cardinality, {R('avg(k) / 3')} AS density FROM k")
def _(t):
    return O.label_cardinality(multilabels(t).withColumn("ml", F.array("r", "f", "d")), "ml", 3)


@query("cooccurrence", "O3", f"""WITH {ML_SQL}, u AS (SELECT l_orderkey, unnest(['r','f','d']) AS l, unnest([r, f, d]) AS v FROM ml), c AS (SELECT a.l AS label_i, b.l AS label_j, count_if(a.v = 1 AND b.v = 1) AS n_both, count_if(a.v = 1) AS n_i FROM u a JOIN u b USING (l_orderkey) GROUP BY 1, 2)
  SELECT label_i, label_j, n_both, n_i, {R('coalesce(n_both / nullif(n_i, 0), 0)')} AS p_j_given_i FROM c""")
def _(t):
    return O.cooccurrence(multilabels(t), ["r", "f", "d"])


for _u in ("year", "month"):
    query(f"events_by_{_u}", "O4", f"SELECT date_trunc('{_u}', o_orderdate)::TIMESTAMP AS period, count(*) AS n, count_if(o_orderstatus = 'F') AS n_fault, {R(chr(49) + '00.0 * count_if(o_orderstatus = ' + chr(39) + 'F' + chr(39) + ') / count(*)')} AS fault_pct FROM orders GROUP BY 1")(
        lambda t, u=_u: O.events_by(t.orders, u, "o_orderdate", F.col("o_orderstatus") == "F"))


@query("top_devices", "O5", f"SELECT user_id, count(*) AS n, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct, count(*) OVER () AS n_devices FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _(t):
    return O.top_devices(t.events, "user_id")


@query("header_distributions", "O6", f"""WITH u AS (SELECT unnest(['o_orderstatus', 'o_orderpriority', 'year']) AS field, unnest([o_orderstatus, o_orderpriority, year(o_orderdate)::VARCHAR]) AS value FROM orders)
  SELECT field, value, count(*) AS n, {R('100.0 * count(*) / (SELECT count(*) FROM orders)')} AS pct FROM u GROUP BY 1, 2""")
def _(t):
    return O.header_distributions(t.orders.withColumn("year", F.year("o_orderdate")), ["o_orderstatus", "o_orderpriority", "year"])


@query("numeric_distribution", "O6", f"SELECT min(o_totalprice) AS min, max(o_totalprice) AS max, {R('avg(o_totalprice)')} AS mean, {R('median(o_totalprice)')} AS median FROM orders")
def _(t):
    return rounded(O.numeric_distribution(t.orders, "o_totalprice"))


# metric rows: one per order, the priority is the stage and the order date its time
@query("stage_summary", "O7", """WITH st AS (SELECT unnest(['1-URGENT', '2-HIGH', '9-ABSENT']) AS phase), l AS (SELECT o_orderpriority AS phase, max(o_orderdate) AS generated_at, arg_max(o_orderkey::VARCHAR, (o_orderdate, o_orderkey::VARCHAR)) AS metric, arg_max(o_totalprice, (o_orderdate, o_orderkey::VARCHAR)) AS value FROM orders GROUP BY 1)
  SELECT phase, generated_at, metric, value, generated_at IS NOT NULL AS has_output FROM st FULL JOIN l USING (phase)""")
def _(t):
    stages = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-ABSENT",)], "phase string")
    m = t.orders.select(F.col("o_orderpriority").alias("phase"), F.col("o_orderdate").alias("generated_at"), F.col("o_orderkey").cast("string").alias("metric"), F.col("o_totalprice").alias("value"))
    return O.stage_summary(stages, m)


@query("stale_metrics", "O8", """WITH src AS (SELECT c_name AS dataset_path, TIMESTAMP '1995-01-01' + to_days((c_custkey % 1500)::INT) AS modified_at FROM customer WHERE c_custkey % 5 <> 0)
  SELECT o_orderkey, coalesce(o_orderdate < modified_at, FALSE) AS stale FROM orders LEFT JOIN src ON dataset_path = 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')""")
def _(t):
    src = t.customer.filter(F.col("c_custkey") % 5 != 0).select(F.col("c_name").alias("dataset_path"), (F.to_timestamp_ntz(F.lit("1995-01-01")) + F.make_dt_interval((F.col("c_custkey") % 1500).cast("int"))).alias("modified_at"))
    m = t.orders.select("o_orderkey", F.col("o_orderdate").alias("generated_at"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("dataset_path"))
    return O.stale_metrics(m, src).select("o_orderkey", "stale")


STRIP, ALLOW, NUMBER = r"https?://[^ ]*|[A-Za-z][0-9]+", "MANUAL:|license", r"[0-9]+\.?[0-9]*"


@query("unbacked_numbers", "O9", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
  m AS (SELECT doc_id, line_no::INT AS line_no, unnest(regexp_extract_all(regexp_replace(line, '{STRIP}', '', 'g'), '{NUMBER}')) AS literal FROM l WHERE NOT regexp_matches(line, '{ALLOW}')) SELECT doc_id, line_no, literal FROM m""")
def _(t):
    return O.unbacked_numbers(t.documents, "doc_id", "text", STRIP, ALLOW, NUMBER)
