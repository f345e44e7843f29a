"""Mixing sources to target weights by Poisson replication.

Every document is repeated k times, where k follows a Poisson distribution whose
mean is the repetition rate its source needs to reach the target weight. k is read
off the inverted distribution at a number in [0, 1) hashed from seed, doc_id and
text, so a task that runs again draws the same k. Only DataFrame functions are used.

Defined results: a null source is a source of its own; a null text counts no
characters; a source without any character keeps rate 1; rows that are equal in
doc_id and text draw the same k; an empty table gives an empty table; columns named
like the three added ones are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultspark.functions.iterate import cut_lineage

#: Means up to this value are inverted at once; a larger mean is a sum of equal parts.
PART_MEAN = 16.0
#: Terms of the distribution kept for a part: beyond them less than 2**-53 of the mass is left.
TERMS = 96
#: Rows of the table of rates up to which it is broadcast (under 100 MB); beyond, the join shuffles.
BROADCAST_ROWS = 50_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(source, n_docs, n_chars, rate): mean repetitions that bring each source to its weight.

    ``weights`` (source, weight) states the targets; sources it leaves out get 0. Without it
    the target of a source is its share of characters to the power ``temperature``.
    ``scale`` is the size of the result, in characters, over the size of the input.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("n_chars"))
    if weights is None:
        sized = sizes.withColumn("weight", F.pow("n_chars", F.lit(float(temperature))))
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        sized = sizes.join(w, sizes["source"].eqNullSafe(w["__s"]), "left").drop("__s").fillna({"weight": 0.0})
    sized = cut_lineage(sized)
    total, weight = sized.agg(F.sum("n_chars"), F.sum(F.when(F.col("n_chars") > 0, F.col("weight")))).first()
    rate = F.lit(float(scale * (total or 0.0))) * F.col("weight") / (F.lit(float(weight or 1.0)) * F.col("n_chars"))
    return sized.select("source", "n_docs", "n_chars", F.when(F.col("n_chars") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """Each document once for every draw, in an order that mixes all sources.

    Adds mix_copy (1 ... mix_copies), mix_copies and mix_key, the key of the global
    shuffle. Rows are dealt by mix_key to all partitions and sorted by it inside each.
    """
    docs = docs.drop("mix_copy", "mix_copies", "mix_key")
    rates = source_rates(docs, weights, temperature, scale)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART_MEAN)), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("__parts")
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))
    # running (probability, cumulated) terms; each list entry is P(draw <= k)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.getField("p").alias("p"), first.getField("c").alias("c"), F.array(first.getField("c")).alias("cdf")),
        lambda a, k: F.struct((a["p"] * F.col("__mean") / k).alias("p"), (a["c"] + a["p"] * F.col("__mean") / k).alias("c"),
                              F.concat(a["cdf"], F.array(a["c"] + a["p"] * F.col("__mean") / k)).alias("cdf")),
        lambda a: a["cdf"])
    table = (rates.select(F.col("source").alias("__source"), parts.alias("__parts"), "rate").withColumn("__mean", mean)
             .select("__source", "__parts", grown.alias("__cdf")))
    if rates.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")), F.lit(0),
        lambda n, j: n + F.aggregate("__cdf", F.lit(0), lambda k, c: k + (c <= F.element_at("__units", j)).cast("int")))
    units = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda j: unit(F.col("__name"), j.cast("string")))
    d = docs.withColumn("__name", name)
    d = (d.join(table, d["source"].eqNullSafe(table["__source"])).withColumn("__units", units).withColumn("mix_copies", drawn)
         .filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
         .withColumn("mix_key", F.md5(F.concat_ws("|", F.lit("order"), "__name", F.col("mix_copy").cast("string")).cast("binary")))
         .select(*docs.columns, "mix_copy", "mix_copies", "mix_key"))
    return d.repartition("mix_key").sortWithinPartitions("mix_key")


SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS n_chars FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN n_chars > 0 THEN (SELECT sum(n_chars) FROM sizes) * n_chars ** 0.5
                              / ((SELECT sum(n_chars ** 0.5) FROM sizes WHERE n_chars > 0) * n_chars) ELSE 1.0 END AS rate FROM sizes),
parts AS (SELECT source, greatest(ceil(rate / {PART_MEAN}), 1)::INT AS m, rate / greatest(ceil(rate / {PART_MEAN}), 1) AS mean FROM rates),
terms AS (SELECT source, m, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
          FROM parts, range(0, {TERMS + 1}) t(k)),
named AS (SELECT *, '0|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS name FROM documents),
drawn AS (SELECT d.name, j, count(*) AS k FROM named d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source, range(1, m + 1) p(j)
          WHERE t.c <= ('0x' || substr(md5(d.name || '|' || j), 1, 13))::BIGINT / 4503599627370496.0 GROUP BY d.name, j),
total AS (SELECT name, sum(k)::INT AS mix_copies FROM drawn GROUP BY name)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c::INT AS mix_copy, mix_copies, md5('order|' || d.name || '|' || c) AS mix_key
FROM named d JOIN total USING (name), range(1, mix_copies + 1) r(c)
"""
