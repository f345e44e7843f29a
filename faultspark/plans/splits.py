"""Queries for splits, folds, blocks, sequences and class weights."""

from pyspark.sql import functions as F

from ..functions.exprs import micros, rnd
from ..operators import splits as E
from .matrixdata import ORDERS_SQL, orders_matrix
from .registry import R, query
from .series import rounded

STRAT_SQL = """r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY {p} ORDER BY md5(o_orderkey || '#42'), o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY {p}) AS n FROM orders)"""
SPLIT_CASE = """CASE WHEN pos < ceil(n * 0.3::DOUBLE) THEN 'test' WHEN pos < ceil(n * 0.3::DOUBLE) + ceil((n - ceil(n * 0.3::DOUBLE)) * (0.1::DOUBLE / (1.0::DOUBLE - 0.3::DOUBLE))) THEN 'val' ELSE 'train' END"""


@query("stratified_split", "E1", f"WITH {STRAT_SQL.format(p='o_orderpriority')} SELECT o_orderkey, o_orderpriority, {SPLIT_CASE} AS split FROM r")
def _(t):
    return E.stratified_split(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 0.3, 0.1)


@query("random_split", "E1", f"WITH {STRAT_SQL.format(p='1')} SELECT o_orderkey, CASE WHEN pos < ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r")
def _(t):
    return E.stratified_split(t.orders.select("o_orderkey"), "o_orderkey", None, 0.3)


@query("leakage_safe_fit", "E2", f"""WITH {ORDERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(event_id || '#7'), event_id) - 1 AS pos, count(*) OVER (PARTITION BY y) AS n FROM m),
  s AS (SELECT *, CASE WHEN pos < ceil(n * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r), f AS (SELECT avg(qty_sum) AS a, stddev_pop(qty_sum) AS b FROM s WHERE split = 'train')
  SELECT event_id, y, split, {R('(qty_sum - a) / b')} AS qty_sum FROM s, f""")
def _(t):
    d = E.stratified_split(orders_matrix(t).select("event_id", "y", "qty_sum"), "event_id", "y", 0.25, seed=7)
    return rounded(E.leakage_safe_fit(d, ["qty_sum"]))


# a fixed rule stands in for a model: predict 1 above the training mean
def mean_rule(train):
    cut = train.agg(F.avg("qty_sum").alias("m")).scalar()
    return lambda d: d.withColumn("y_pred", (F.col("qty_sum") > cut).cast("int"))


def accuracy(d):
    return d.agg(F.avg((F.col("y") == F.col("y_pred")).cast("int")).alias("value")).select(F.lit("accuracy").alias("metric"), F.lit("all").alias("label_name"), "value")


@query("repeated_eval", "E3", f"""WITH {ORDERS_SQL}, r AS (SELECT event_id, y, qty_sum, i, row_number() OVER (PARTITION BY y, i ORDER BY md5(event_id || '#' || i), event_id) - 1 AS pos, count(*) OVER (PARTITION BY y, i) AS n FROM m, range(0, 10) g(i)),
  s AS (SELECT *, pos < ceil(n * 0.3::DOUBLE) AS is_test FROM r), f AS (SELECT i, avg(qty_sum) AS a FROM s WHERE NOT is_test GROUP BY 1),
  v AS (SELECT i, avg((y = (qty_sum > a)::INT)::INT) AS value FROM s JOIN f USING (i) WHERE is_test GROUP BY 1)
  SELECT 'accuracy' AS metric, 'all' AS label_name, count(*) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, {R('min(value)')} AS min, {R('max(value)')} AS max, list({R('value')} ORDER BY i) AS "values" FROM v""")
def _(t):
    rows = E.repeated_eval(orders_matrix(t).select("event_id", "y", "qty_sum"), "event_id", "y", mean_rule, accuracy)
    d = rounded(E.summarize_repeats(rows))
    return d.withColumn("values", F.transform("values", lambda v: rnd(v)))


@query("kfold", "E4", f"WITH {STRAT_SQL.format(p='o_orderpriority')} SELECT o_orderkey, (pos % 5)::INT AS fold FROM r")
def _(t):
    return E.kfold(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority").select("o_orderkey", "fold")


@query("cross_validate", "E4", f"""WITH {ORDERS_SQL}, r AS (SELECT event_id, y, qty_sum, (row_number() OVER (PARTITION BY y ORDER BY md5(event_id || '#42'), event_id) - 1) % 5 AS fold FROM m),
  f AS (SELECT g.i, avg(qty_sum) AS a FROM r, range(0, 5) g(i) WHERE fold <> g.i GROUP BY 1)
  SELECT 'accuracy' AS metric, 'all' AS label_name, i::INT AS repeat, {R('avg((y = (qty_sum > a)::INT)::INT)')} AS value FROM r JOIN f ON fold = i GROUP BY i""")
def _(t):
    return rounded(E.cross_validate(orders_matrix(t).select("event_id", "y", "qty_sum"), "event_id", "y", mean_rule, accuracy))


BLOCK_SQL = """p AS (SELECT event_id, value, (event_type = 'error')::INT AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events), b0 AS (SELECT *, pos // 20 AS block FROM p),
  b AS (SELECT block, row_number() OVER (ORDER BY md5(block || '#42'), block) - 1 AS r, count(*) OVER () AS nb FROM (SELECT DISTINCT block FROM b0)),
  s AS (SELECT block, CASE WHEN r < round_even(nb * 0.64::DOUBLE, 0) THEN 'train' WHEN r < round_even(nb * 0.64::DOUBLE, 0) + round_even(nb * 0.16::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM b)"""


def blocks(t):
    e = t.events.select("event_id", "value", (F.col("event_type") == "error").cast("int").alias("y"), micros("ts").alias("us"))
    return E.block_split(e, ["us", "event_id"])


@query("block_split", "E5", f"WITH {BLOCK_SQL} SELECT event_id, pos, block, split FROM b0 JOIN s USING (block)")
def _(t):
    return blocks(t).select("event_id", "pos", "block", "split")


@query("sliding_sequences", "E6", f"""WITH {BLOCK_SQL}, j AS (SELECT * FROM b0 JOIN s USING (block)), q AS (SELECT block, pos, list(value) OVER w AS sequence, last(y) OVER w AS label FROM j WINDOW w AS (PARTITION BY block ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
  SELECT block, pos, sequence, label FROM q WHERE len(sequence) = 10""")
def _(t):
    return E.sliding_sequences(blocks(t), "block", "pos", "value", "y")


@query("sample_per_class", "E7", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '#42'), event_id) <= 40")
def _(t):
    return E.sample_per_class(t.events.select("event_id", "event_type"), "event_id", "event_type", 40)


@query("split_composition", "E8", f"""WITH {STRAT_SQL.format(p='1')}, s AS (SELECT o_orderpriority, CASE WHEN pos < ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r)
  SELECT o_orderpriority, count(*) AS total, count_if(split = 'train') AS train, count_if(split = 'test') AS test, {R("count_if(split = 'test') / count(*)")} AS test_frac, count_if(split = 'test') < 5 AS warn FROM s GROUP BY 1""")
def _(t):
    d = E.stratified_split(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", None, 0.3)
    return rounded(E.split_composition(d, "o_orderpriority"))


@query("split_composition_multilabel", "E8", f"""WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY md5(doc_id || '#42'), doc_id) - 1 AS pos, count(*) OVER () AS n FROM labels),
  s AS (SELECT *, CASE WHEN pos < ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r), f AS (SELECT split, 'quality' AS label FROM s WHERE quality = 1 UNION ALL SELECT split, 'toxic' FROM s WHERE toxic = 1)
  SELECT label, count(*) AS total, count_if(split = 'train') AS train, count_if(split = 'test') AS test, {R("count_if(split = 'test') / count(*)")} AS test_frac, count_if(split = 'test') < 5 AS warn FROM f GROUP BY 1""")
def _(t):
    return rounded(E.split_composition_multilabel(E.stratified_split(t.labels, "doc_id", None, 0.3), ["quality", "toxic"]))


@query("class_weights", "E9", f"SELECT event_type, count(*) AS n_class, {R('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM events GROUP BY 1")
def _(t):
    return rounded(E.class_weights(t.events, "event_type"))


@query("scale_pos_weight", "E9", f"""WITH u AS (SELECT 'quality' AS label, quality AS y FROM labels UNION ALL SELECT 'toxic', toxic FROM labels)
  SELECT label, count_if(y = 1) AS n_pos, {R('CASE WHEN count_if(y = 1) = 0 THEN 1 ELSE count_if(y <> 1) / count_if(y = 1) END')} AS weight FROM u GROUP BY 1""")
def _(t):
    return rounded(E.scale_pos_weight(t.labels, ["quality", "toxic"]))


@query("powerset_weights", "E9", f"""WITH c AS (SELECT doc_id, quality::VARCHAR || toxic::VARCHAR AS combo FROM labels), w AS (SELECT combo, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM c GROUP BY 1)
  SELECT combo, doc_id, {R('weight')} AS weight FROM c JOIN w USING (combo)""")
def _(t):
    return rounded(E.powerset_weights(t.labels, ["quality", "toxic"]).select("combo", "doc_id", "weight"))


for _n, _min in (("category_vs_normal", 10),):
    query(_n, "E10", f"""WITH c AS (SELECT event_id, event_type, (event_type = 'error')::INT AS target FROM events WHERE event_type IN ('error', 'view')), m AS (SELECT least(count_if(target = 1), count_if(target = 0)) AS m FROM c)
      SELECT event_id, event_type, target FROM c, m WHERE m >= {_min}""")(
        lambda t, m=_min: E.category_vs_normal(t.events.select("event_id", "event_type"), "event_type", "error", "view", m))
