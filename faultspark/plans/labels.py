"""Queries for labels, quality gates and attrition."""

from pyspark.sql import functions as F

from ..functions.exprs import micros, rnd
from ..operators import labels as L
from .registry import R, query

CATS_SQL = "[" + ",".join(f"'{c}'" for c in L.FAULT_CATEGORIES) + "]"
CATEGORY_SQL = f"CASE WHEN c_nationkey % 8 = 0 THEN 'Normal' ELSE {CATS_SQL}[c_nationkey % 8] END"
TRUTH_SQL = f"""truth AS (SELECT c_custkey, c_name || '.dat' AS file, {CATEGORY_SQL} AS category,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Filtré' ELSE c_mktsegment END AS label FROM customer)"""


def category_of(key):
    cats = F.array(*[F.lit(c) for c in L.FAULT_CATEGORIES])
    return F.when(key % 8 == 0, L.NORMAL).otherwise(F.get(cats, (key % 8 - 1).cast("int")))


def truth_table(t):
    return t.customer.select(
        F.concat("c_name", F.lit(".dat")).alias("file"), category_of(F.col("c_nationkey")).alias("category"),
        F.when(F.col("c_mktsegment") == "BUILDING", L.FILTERED).otherwise(F.col("c_mktsegment")).alias("label"))


def event_files(t):
    return t.orders.select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("/pm/"), F.year("o_orderdate").cast("string"), F.lit("/Customer#"),
                 F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(".dat")).alias("path"))


@query("join_ground_truth", "B1", f"""WITH {TRUTH_SQL}
  SELECT o_orderkey AS event_id, '/pm/' || year(o_orderdate) || '/Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || '.dat' AS path,
    (category <> 'Normal')::INT AS "binary", list_transform({CATS_SQL}, lambda c: (c = category)::INT) AS multilabel,
    category, CASE WHEN category = '{L.SUBTYPED_CATEGORY}' THEN label END AS subtype
  FROM orders JOIN truth ON c_custkey = o_custkey WHERE label <> 'Filtré'""")
def _(t):
    return L.join_ground_truth(event_files(t), truth_table(t))


ALARM_SQL = """CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 = 1 THEN 'zz' WHEN o_orderkey % 2 = 0
    THEN '0x' || lpad(printf('%X', o_orderkey % 200), 4, '0') ELSE printf('%x', o_orderkey % 200) END"""
ALARM_VALUE_SQL = "CASE WHEN o_orderkey % 11 IN (0, 1) THEN 0 ELSE o_orderkey % 200 END"


def alarm_text():
    k = F.col("o_orderkey")
    h = F.hex(k % 200)
    return (F.when(k % 11 == 0, "").when(k % 11 == 1, "zz")
            .when(k % 2 == 0, F.concat(F.lit("0x"), F.lpad(h, 4, "0"))).otherwise(F.lower(h)))


@query("decode_alarm_bits", "B2", f"""SELECT o_orderkey, alarm, v AS alm_value, (v > 0)::INT AS "binary",
    list_transform([0,1,2,3,4,5,6], lambda i: ((v >> i) & 1)::INT) AS multilabel
  FROM (SELECT o_orderkey, {ALARM_SQL} AS alarm, {ALARM_VALUE_SQL} AS v FROM orders)""")
def _(t):
    return L.decode_alarm_bits(t.orders.select("o_orderkey", alarm_text().alias("alarm")), "alarm")


FAULT_NAMES = ["click", "error", "purchase", "signup", "view"]


@query("label_any_after", "B3", """WITH b AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1),
  r AS (SELECT e.user_id, event_type, epoch_us(ts) AS idx, epoch_us(a) + (epoch_us(z) - epoch_us(a)) * 9 // 10 AS t0,
    (value > 60)::INT AS active FROM events e JOIN b USING (user_id)),
  m AS (SELECT user_id, [""" + ",".join(
    f"coalesce(max(CASE WHEN event_type = '{f}' THEN (idx >= t0 AND active = 1)::INT END), 0)" for f in FAULT_NAMES) + """] AS multilabel
    FROM r GROUP BY 1) SELECT user_id, multilabel, list_max(multilabel) AS "binary" FROM m""")
def _(t):
    b = t.events.groupBy("user_id").agg(micros(F.min("ts")).alias("a"), micros(F.max("ts")).alias("z"))
    b = b.selectExpr("user_id", "a + (z - a) * 9 div 10 AS t0")
    r = t.events.join(b, "user_id").select(
        "user_id", F.col("event_type").alias("fault"), micros("ts").alias("idx"), "t0",
        (F.col("value") > 60).cast("int").alias("active"))
    return L.label_any_after(r, "user_id", FAULT_NAMES)


# one recording per user: the two gate channels are two event types, KPI text comes from the first event
GATE_SQL = """lv AS (SELECT user_id, event_type, avg(abs(value)) / 500 AS m FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
  w AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN m END) AS cavity, max(CASE WHEN event_type = 'click' THEN m END) AS forward FROM lv GROUP BY 1),
  k AS (SELECT user_id, CASE WHEN user_id % 17 = 0 THEN NULL WHEN user_id % 17 = 1 THEN 'abc' ELSE (user_id % 40)::VARCHAR || '.5' END AS kpi
    FROM (SELECT DISTINCT user_id FROM events)),
  g AS (SELECT k.user_id, kpi, cavity, forward FROM k LEFT JOIN w USING (user_id))"""


def gate_tables(t):
    lv = (t.events.filter(F.col("event_type").isin("view", "click")).groupBy("user_id", "event_type")
          .agg((F.avg(F.abs("value")) / 500).alias("mean_abs"))
          .withColumn("channel", F.when(F.col("event_type") == "view", "cavity").otherwise("forward")))
    u = F.col("user_id")
    kpi = F.when(u % 17 == 1, "abc").when(u % 17 != 0, F.concat((u % 40).cast("string"), F.lit(".5")))
    return t.events.select("user_id").distinct().withColumn("kpi", kpi), lv


def gate_query(strict):
    def build(t):
        meta, lv = gate_tables(t)
        d = L.quality_gate(meta, lv, "user_id", strict)
        return d.select("user_id", "kpi", rnd("cavity").alias("cavity"), rnd("forward").alias("forward"), "quality_pass")
    return build


for _name, _strict in (("quality_gate", False), ("quality_gate_strict", True)):
    query(_name, "B4", f"""WITH {GATE_SQL} SELECT user_id, kpi, {R('cavity')} AS cavity, {R('forward')} AS forward,
      (CASE WHEN kpi IS NULL THEN {not _strict} ELSE coalesce(TRY_CAST(kpi AS DOUBLE) >= 10, FALSE) END)
        AND coalesce(cavity >= 0.1, FALSE) AND coalesce(forward >= 0.02, FALSE) AS quality_pass FROM g""")(gate_query(_strict))

_QS = (("min", 0.0), ("p10", 0.1), ("median", 0.5), ("p90", 0.9), ("max", 1.0))


def gated(t):
    meta, lv = gate_tables(t)
    d = L.quality_gate(meta, lv, "user_id")
    return d.select("user_id", F.coalesce(F.col("kpi").try_cast("double"), F.lit(0.0)).alias("kpi"),
                    F.coalesce("cavity", F.lit(0.0)).alias("cavity"), F.coalesce("forward", F.lit(0.0)).alias("forward"))


GATED_SQL = f"""WITH {GATE_SQL}, v AS (SELECT user_id, coalesce(TRY_CAST(kpi AS DOUBLE), 0) AS kpi,
    coalesce(cavity, 0) AS cavity, coalesce(forward, 0) AS forward FROM g)"""

def checks():
    return {"kpi": F.col("kpi") < 10, "cavity": F.col("cavity") < 0.1, "forward": F.col("forward") < 0.02}


@query("gate_reasons", "B5", f"""{GATED_SQL} SELECT count(*) AS n_total, count_if(kpi < 10) AS fail_kpi, count_if(cavity < 0.1) AS fail_cavity,
    count_if(forward < 0.02) AS fail_forward, count_if(kpi >= 10 AND cavity >= 0.1 AND forward >= 0.02) AS n_pass,
    {R('100.0 * count_if(kpi < 10) / count(*)')} AS fail_kpi_pct, {R('100.0 * count_if(cavity < 0.1) / count(*)')} AS fail_cavity_pct,
    {R('100.0 * count_if(forward < 0.02) / count(*)')} AS fail_forward_pct,
    {R('100.0 * count_if(kpi >= 10 AND cavity >= 0.1 AND forward >= 0.02) / count(*)')} AS n_pass_pct,
    {', '.join(f"{R(f'quantile_cont({c}, {p})')} AS {c}_{n}" for c in ('kpi', 'cavity', 'forward') for n, p in _QS)} FROM v""")
def _(t):
    d = L.gate_reasons(gated(t), checks(), ["kpi", "cavity", "forward"])
    return d.select(*[rnd(c).alias(c) if dt == "double" else F.col(c) for c, dt in d.dtypes])


@query("cascade_reasons", "B6", f"""{GATED_SQL} SELECT CASE WHEN kpi < 10 THEN 'kpi' WHEN cavity < 0.1 THEN 'cavity'
    WHEN forward < 0.02 THEN 'forward' ELSE 'pass' END AS reason, count(*) AS n FROM v GROUP BY 1""")
def _(t):
    return L.cascade_reasons(gated(t), checks())


@query("attrition_funnel", "B7", f"""WITH {TRUTH_SQL}, f AS (SELECT count(*) AS raw, count_if(o_orderstatus = 'P') AS err,
    count_if(o_orderkey % 50 = 0) AS zero FROM orders), tr AS (SELECT count(*) AS n, count_if(label = 'Filtré') AS flt FROM truth),
  d AS (SELECT count(*) AS n FROM customer WHERE c_acctbal > 0)
  SELECT unnest([0,1,2,3,4,5,6,7]) AS step, unnest(['raw_files','processing_errors','zero_byte_files','truth_rows','unreconciled','filtered','passing','final_events']) AS stage,
    unnest([raw, err, zero, tr.n, tr.n - (raw - err - zero), flt, tr.n - flt, d.n]) AS n FROM f, tr, d""")
def _(t):
    files = t.orders.select((F.col("o_orderstatus") == "P").alias("is_error"),
                            F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(1).alias("length"))
    return L.attrition_funnel(files, truth_table(t), t.customer.filter(F.col("c_acctbal") > 0))


@query("attrition_by_category", "B7", f"""WITH {TRUTH_SQL} SELECT category, count(*) AS n_raw, count_if(label <> 'Filtré') AS n_passing FROM truth GROUP BY 1""")
def _(t):
    return L.attrition_by_category(truth_table(t))


@query("compare_datasets", "B8", f"""WITH c AS (SELECT count(*) AS a, count_if(value > 20) AS b FROM events)
  SELECT a AS n_without, b AS n_with, a - b AS n_anti, a - b AS n_rejected, {R('100.0 * (a - b) / a')} AS rejection_pct,
    {R('100.0 - 100.0 * (a - b) / a')} AS pass_pct FROM c""")
def _(t):
    d = L.compare_datasets(t.events.select("event_id"), t.events.filter(F.col("value") > 20).select("event_id"), "event_id")
    return d.withColumn("rejection_pct", rnd("rejection_pct")).withColumn("pass_pct", rnd("pass_pct"))


AUDIT_SQL = """audit AS (SELECT l_orderkey, l_shipdate, l_shipmode_like AS family, (l_returnflag = 'R')::INT AS old_a, (l_linestatus = 'F')::INT AS new_a,
    (l_discount > 0.05)::INT AS old_b, (l_tax > 0.04)::INT AS new_b FROM (SELECT *, 'x-' || CASE l_suppkey % 3 WHEN 0 THEN 'CMA' WHEN 1 THEN 'CMB' ELSE 'REB' END || l_linenumber AS l_shipmode_like FROM lineitem))"""


def audit(t):
    k = F.col("l_suppkey") % 3
    return t.lineitem.select(
        "l_orderkey", "l_shipdate",
        F.concat(F.lit("x-"), F.when(k == 0, "CMA").when(k == 1, "CMB").otherwise("REB"), F.col("l_linenumber").cast("string")).alias("family"),
        (F.col("l_returnflag") == "R").cast("int").alias("old_a"), (F.col("l_linestatus") == "F").cast("int").alias("new_a"),
        (F.col("l_discount") > 0.05).cast("int").alias("old_b"), (F.col("l_tax") > 0.04).cast("int").alias("new_b"))


@query("label_agreement", "B9", f"""WITH {AUDIT_SQL} SELECT count(*) AS n, count_if(old_a = 0 AND new_a = 0) AS tn, count_if(old_a = 1 AND new_a = 1) AS tp,
    count_if(old_a = 0 AND new_a = 1) AS new_only, count_if(old_a = 1 AND new_a = 0) AS old_only,
    {R('100.0 * count_if(old_a = new_a) / count(*)')} AS agreement_pct, {R('100.0 * count_if(old_a <> new_a) / count(*)')} AS disagreement_pct FROM audit""")
def _(t):
    d = L.label_agreement(audit(t), "old_a", "new_a")
    return d.withColumn("agreement_pct", rnd("agreement_pct")).withColumn("disagreement_pct", rnd("disagreement_pct"))


@query("label_agreement_per_label", "B9", f"""WITH {AUDIT_SQL}, p AS (SELECT 'a' AS label, old_a AS o, new_a AS n FROM audit UNION ALL SELECT 'b', old_b, new_b FROM audit)
  SELECT label, sum(o)::BIGINT AS n_old, sum(n)::BIGINT AS n_new, count_if(n > o) AS new_gt_old, count_if(o > n) AS old_gt_new FROM p GROUP BY 1""")
def _(t):
    return L.label_agreement_per_label(audit(t), {"a": ("old_a", "new_a"), "b": ("old_b", "new_b")})


def _agree_sql(dim):
    return f"""WITH {AUDIT_SQL} SELECT {dim} AS dim, count(*) AS total, count_if(old_a = new_a) AS agree, count_if(old_a <> new_a) AS disagree,
      {R('100.0 * count_if(old_a <> new_a) / count(*)')} AS disagree_pct FROM audit GROUP BY 1"""


for _n, _sql, _dim in (
    ("agreement_by_family", "coalesce(nullif(regexp_extract(family, '(CMA|CMB)', 1), ''), 'Unknown')", lambda: L.family_of("family")),
    ("agreement_by_year", "year(l_shipdate)::INT", lambda: F.year("l_shipdate")),
    ("agreement_by_month", "date_trunc('month', l_shipdate)::TIMESTAMP", lambda: F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")),
):
    query(_n, "B10", _agree_sql(_sql))(
        lambda t, d=_dim: L.agreement_by(audit(t), d(), "old_a", "new_a").withColumn("disagree_pct", rnd("disagree_pct")))

DATE_TEXT_SQL = """CASE WHEN o_orderkey % 13 = 0 THEN 'no date' WHEN o_orderkey % 2 = 0 THEN 'OCT 29 ' || (year(o_orderdate) + 22) || ' 11:26:53'
   ELSE 'OCT 29 ' || year(o_orderdate) || ' 11:26:53' END"""
STATUS_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'oui' WHEN 1 THEN 'NON' WHEN 2 THEN 'On' WHEN 3 THEN '1' END"


@query("status_flags", "B11", f"""WITH d AS (SELECT o_orderkey, {DATE_TEXT_SQL} AS date_text, {STATUS_SQL} AS status FROM orders),
  y AS (SELECT *, TRY_CAST(nullif(regexp_extract(date_text, '(19|20)\\d{{2}}'), '') AS INT) AS yr FROM d)
  SELECT o_orderkey, date_text, status, CASE WHEN yr < 2021 THEN 1 ELSE coalesce(upper(status) IN ('OUI','YES','ON','1'), FALSE)::INT END AS feed_forward,
    coalesce(upper(status) IN ('ON','OUI','CLOSED','1'), FALSE)::INT AS loop_closed FROM y""")
def _(t):
    k = F.col("o_orderkey")
    date_text = F.when(k % 13 == 0, "no date").otherwise(F.concat(
        F.lit("OCT 29 "), (F.year("o_orderdate") + F.when(k % 2 == 0, 22).otherwise(0)).cast("string"), F.lit(" 11:26:53")))
    status = F.when(k % 5 == 0, "oui").when(k % 5 == 1, "NON").when(k % 5 == 2, "On").when(k % 5 == 3, "1")
    d = t.orders.select("o_orderkey", date_text.alias("date_text"), status.alias("status"))
    return d.withColumn("feed_forward", L.year_scoped_flag("date_text", "status")).withColumn("loop_closed", L.loop_flag("status"))


@query("primary_label", "B12", f"""WITH m AS (SELECT o_orderkey, list_transform([0,1,2,3,4,5,6], lambda i: ((({ALARM_VALUE_SQL}) >> i) & 1)::INT) AS ml FROM orders)
  SELECT o_orderkey, CASE WHEN list_position(ml, 1) > 0 THEN {CATS_SQL}[list_position(ml, 1)] ELSE 'Normal' END AS category FROM m""")
def _(t):
    d = L.decode_alarm_bits(t.orders.select("o_orderkey", alarm_text().alias("alarm")), "alarm")
    return d.select("o_orderkey", L.primary_label("multilabel").alias("category"))


@query("parse_device_id", "B13", """WITH d AS (SELECT c_custkey, 'x-CMA' || c_nationkey || '-CAV' || (c_custkey % 4) || ':' || c_mktsegment AS dbname FROM customer)
  SELECT c_custkey, dbname, split_part(dbname, '-', 2) AS module, split_part(split_part(dbname, '-', 3), ':', 1) AS cavity,
    split_part(dbname, '-', 2) || '-' || split_part(split_part(dbname, '-', 3), ':', 1) AS device_id FROM d""")
def _(t):
    name = F.concat(F.lit("x-CMA"), F.col("c_nationkey").cast("string"), F.lit("-CAV"), (F.col("c_custkey") % 4).cast("string"), F.lit(":"), "c_mktsegment")
    return L.parse_device_id(t.customer.select("c_custkey", name.alias("dbname")), "dbname")


MODE_SQL = "SELECT CASE WHEN o_orderstatus = 'O' THEN 'ON' ELSE 'OFF' END AS loop, o_totalprice > 200000 AS f FROM orders"


def mode_rows(t):
    return t.orders.select(F.when(F.col("o_orderstatus") == "O", "ON").otherwise("OFF").alias("loop"), (F.col("o_totalprice") > 200000).alias("f"))


@query("trigger_mode_crosstab", "B14", f"""SELECT CASE WHEN grouping(loop) = 1 THEN 'All' ELSE loop END AS loop,
    CASE WHEN grouping(f) = 1 THEN 'All' ELSE f::VARCHAR END AS has_fault, count(*) AS n FROM ({MODE_SQL}) GROUP BY CUBE(loop, f)""")
def _(t):
    return L.trigger_mode_crosstab(mode_rows(t), "loop", "f")


@query("trigger_mode", "B14", f"""SELECT CASE WHEN loop = 'OFF' AND NOT f THEN 'manual' WHEN loop = 'ON' AND f THEN 'auto_fault'
    WHEN loop = 'ON' THEN 'auto_normal' ELSE 'rare' END AS mode, count(*) AS n, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM ({MODE_SQL}) GROUP BY 1""")
def _(t):
    from ..operators.overview import with_share

    return with_share(mode_rows(t).groupBy(L.trigger_mode("loop", "f").alias("mode")).agg(F.count(F.lit(1)).alias("n")), "n", "pct")


def _filter_or_all(limit):
    return lambda t: L.filter_or_all(t.events.select("event_id", "value"), F.col("value") > limit)


query("filter_or_all_match", "B15", "SELECT event_id, value FROM events WHERE value > 200")(_filter_or_all(200))
query("filter_or_all_none", "B15", "SELECT event_id, value FROM events WHERE value > 1e9 OR (SELECT count(*) FROM events WHERE value > 1e9) = 0")(_filter_or_all(1e9))
