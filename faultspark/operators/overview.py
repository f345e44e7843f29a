"""Overview and reporting aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import percent, ratio, rnd
from ..functions.ordering import agg_with_quantiles


def with_share(counts: DataFrame, n: str = "n", name: str = "pct") -> DataFrame:
    """Add the percentage of the grand total to a small table of counts."""
    total = counts.agg(F.sum(n).alias("t")).scalar()
    return counts.withColumn(name, rnd(percent(F.col(n), total)))


def class_balance(df: DataFrame, label: Column | str) -> DataFrame:
    """Count and share per class, and its ratio to the largest class."""
    c = df.groupBy((F.col(label) if isinstance(label, str) else label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = c.agg(F.max("n").alias("m")).scalar()
    return with_share(c).withColumn("ratio", rnd(ratio(F.col("n"), top)))


def label_cardinality(df: DataFrame, multilabel: str, n_labels: int) -> DataFrame:
    k = F.aggregate(multilabel, F.lit(0), lambda a, x: a + x)
    d = df.select(k.alias("k"))
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 1).alias("n_single"), F.count_if(F.col("k") > 1).alias("n_multi"),
        rnd(F.avg(F.when(F.col("k") > 0, F.col("k")))).alias("mean_labels_per_fault"), F.max("k").alias("max_labels"),
        rnd(F.avg("k")).alias("cardinality"), rnd(F.avg("k") / n_labels).alias("density"))


def cooccurrence(df: DataFrame, flags: list[str]) -> DataFrame:
    """Counts of i and j together and P(j | i); the label set is fixed, so one aggregation does it."""
    pairs = [(i, j) for i in flags for j in flags]
    row = df.agg(*[F.count_if((F.col(i) == 1) & (F.col(j) == 1)).alias(f"{i}|{j}") for i, j in pairs])
    out = row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("label_i"), F.lit(j).alias("label_j"), F.col(f"`{i}|{j}`").alias("n_both"), F.col(f"`{i}|{i}`").alias("n_i"))
        for i, j in pairs])).alias("r")).select("r.*")
    return out.withColumn("p_j_given_i", rnd(F.coalesce(ratio(F.col("n_both"), F.col("n_i")), F.lit(0.0))))


def events_by(df: DataFrame, unit: str, ts: str, fault: Column) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fault).alias("n_fault"), rnd(percent(F.count_if(fault), F.count(F.lit(1)))).alias("fault_pct"))


def top_devices(df: DataFrame, device: str, k: int = 10) -> DataFrame:
    c = df.groupBy(device).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t")).scalar()
    distinct = c.agg(F.count(F.lit(1)).alias("t")).scalar()
    return (c.withColumn("pct", rnd(percent(F.col("n"), total))).withColumn("n_devices", distinct)
            .orderBy(F.desc("n"), device).limit(k))


def header_distributions(df: DataFrame, fields: list[str]) -> DataFrame:
    """Value counts of several fields in one pass; each value with its share."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    c = df.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return c.withColumn("pct", rnd(percent(F.col("n"), total)))


def numeric_distribution(df: DataFrame, value: str) -> DataFrame:
    return agg_with_quantiles(df, [], [F.min(value).alias("min"), F.max(value).alias("max"), rnd(F.avg(value)).alias("mean")],
                              {"median": (value, 0.5)})


def stage_summary(stages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Latest headline value per expected stage; stages without output stay, marked absent."""
    latest = metrics.groupBy("phase").agg(
        F.max("generated_at").alias("generated_at"),
        F.max_by("metric", F.struct("generated_at", "metric")).alias("metric"),
        F.max_by("value", F.struct("generated_at", "metric")).alias("value"))
    return stages.join(latest, "phase", "full_outer").withColumn("has_output", F.col("generated_at").isNotNull())


def stale_metrics(metrics: DataFrame, sources: DataFrame) -> DataFrame:
    """Metrics written before their source last changed; a source that is unknown is not stale."""
    return metrics.join(sources, "dataset_path", "left").withColumn(
        "stale", F.coalesce(F.col("generated_at") < F.col("modified_at"), F.lit(False)))


def unbacked_numbers(df: DataFrame, key: str, text: str, strip: str, allow: str, number: str) -> DataFrame:
    """Number literals per line with line numbers, after removing structural text and allowed lines."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    kept = lines.filter(~F.col("line").rlike(allow))
    plain = F.regexp_replace("line", strip, "")
    return (kept.withColumn("literal", F.explode(F.regexp_extract_all(plain, F.lit(number), F.lit(0))))
            .select(key, (F.col("pos") + 1).alias("line_no"), "literal"))
