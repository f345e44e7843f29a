"""Labels, quality gates, attrition accounting and label agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import percent
from ..functions.ordering import agg_with_quantiles
from ..sources.ingest import basename

# The seven fault categories in alarm-bit order.
FAULT_CATEGORIES = [
    "Seuil pick-up",
    "Coupure externe rapide",
    "Absence autorisation RF",
    "Seuil de vide",
    "Claquage ou quench cavité",
    "Dép seuil de sécurité RF",
    "Rég signal RF hors tolérance",
]
NORMAL = "Normal"
FILTERED = "Filtré"
SUBTYPED_CATEGORY = FAULT_CATEGORIES[6]

# Thresholds of the quality gate.
MIN_KPI, MIN_CAVITY, MIN_FORWARD = 10.0, 0.1, 0.02
FIRST_MEANINGFUL_YEAR = 2021


def join_ground_truth(events: DataFrame, truth: DataFrame, path: str = "path", order: str | None = None) -> DataFrame:
    """Keep events with a usable truth row and attach their labels.

    A name that the truth table holds more than once counts with its last row by ``order``
    (without it, by label and category). The join runs on names only, before any waveform is read.
    """
    row = F.struct("label", "category")
    last = truth.groupBy("file").agg(F.max_by(row, F.struct(order, "label", "category") if order else row).alias("t"))
    usable = last.select("file", "t.label", "t.category").filter(F.col("label") != FILTERED)
    cats = F.array(*[F.lit(c) for c in FAULT_CATEGORIES])
    joined = events.withColumn("file", basename(path)).join(usable, "file")
    return joined.select(
        *events.columns,
        (F.col("category") != NORMAL).cast("int").alias("binary"),
        F.transform(cats, lambda c: (c == F.col("category")).cast("int")).alias("multilabel"),
        "category",
        F.when(F.col("category") == SUBTYPED_CATEGORY, F.col("label")).alias("subtype"),
    )


def alarm_value(alarm: Column | str) -> Column:
    """Hex text to a number; empty or malformed text is 0."""
    text = F.lower(F.trim(F.col(alarm) if isinstance(alarm, str) else alarm))
    digits = F.regexp_replace(text, "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def decode_alarm_bits(df: DataFrame, alarm: str, n: int = 7) -> DataFrame:
    value = alarm_value(alarm)
    return (df.withColumn("alm_value", value)
            .withColumn("binary", (F.col("alm_value") > 0).cast("int"))
            .withColumn("multilabel", F.array(*[F.getbit("alm_value", F.lit(i)).cast("int") for i in range(n)])))


def label_any_after(samples: DataFrame, event: str, faults: list[str], t0: str = "t0") -> DataFrame:
    """multilabel[i] = fault i active at or after the trigger; every event keeps a row."""
    late = (F.col("idx") >= F.col(t0)) & (F.col("active") == 1)
    flags = [F.coalesce(F.max(F.when(F.col("fault") == f, late.cast("int"))), F.lit(0)) for f in faults]
    g = samples.groupBy(event).agg(F.array(*flags).alias("multilabel"))
    return g.withColumn("binary", F.array_max("multilabel"))


def quality_columns(strict: bool) -> Column:
    """KPI test: a missing KPI passes, or fails when ``strict``; unreadable text always fails."""
    number = F.col("kpi").try_cast("double")
    parsed = F.coalesce(number >= MIN_KPI, F.lit(False))
    return F.when(F.col("kpi").isNull(), F.lit(not strict)).otherwise(parsed)


def quality_gate(meta: DataFrame, levels: DataFrame, event: str, strict: bool = False) -> DataFrame:
    """``levels`` has event, channel and mean_abs; a missing channel fails the gate."""
    wide = levels.groupBy(event).agg(
        F.max(F.when(F.col("channel") == "cavity", F.col("mean_abs"))).alias("cavity"),
        F.max(F.when(F.col("channel") == "forward", F.col("mean_abs"))).alias("forward"),
    )
    d = meta.join(wide, event, "left")
    ok = (quality_columns(strict) & F.coalesce(F.col("cavity") >= MIN_CAVITY, F.lit(False))
          & F.coalesce(F.col("forward") >= MIN_FORWARD, F.lit(False)))
    return d.withColumn("quality_pass", ok)


def gate_reasons(df: DataFrame, checks: dict[str, Column], quantiles_of: list[str]) -> DataFrame:
    """Failure count and rate of each check on its own, plus quantiles of the checked values."""
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for name, failed in checks.items():
        aggs += [F.count_if(failed).alias(f"fail_{name}")]
    none_failed = reduce(lambda a, b: a & b, [~c for c in checks.values()])
    aggs.append(F.count_if(none_failed).alias("n_pass"))
    qs = {f"{c}_{tag}": (c, p) for c in quantiles_of
          for tag, p in (("min", 0.0), ("p10", 0.1), ("median", 0.5), ("p90", 0.9), ("max", 1.0))}
    out = agg_with_quantiles(df, [], aggs, qs)
    for name in [*(f"fail_{c}" for c in checks), "n_pass"]:
        out = out.withColumn(f"{name}_pct", percent(F.col(name), F.col("n_total")))
    return out


def cascade_reason(checks: dict[str, Column]) -> Column:
    """Name of the first failing check, NULL when all pass."""
    c = None
    for name, failed in checks.items():
        c = F.when(failed, name) if c is None else c.when(failed, name)
    return c


def cascade_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return (df.withColumn("reason", F.coalesce(cascade_reason(checks), F.lit("pass")))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def attrition_funnel(files: DataFrame, truth: DataFrame, final: DataFrame) -> DataFrame:
    """Stage counts in one row each; the residual is what plain arithmetic leaves unexplained."""
    f = files.agg(F.count(F.lit(1)).alias("raw_files"), F.count_if("is_error").alias("processing_errors"),
                  F.count_if(F.col("length") == 0).alias("zero_byte_files"))
    t = truth.agg(F.count(F.lit(1)).alias("truth_rows"), F.count_if(F.col("label") == FILTERED).alias("filtered"))
    d = final.agg(F.count(F.lit(1)).alias("final_events"))
    row = f.join(t).join(d)  # three one-row tables
    row = row.withColumn("passing", F.col("truth_rows") - F.col("filtered")).withColumn(
        "unreconciled",
        F.col("truth_rows") - (F.col("raw_files") - F.col("processing_errors") - F.col("zero_byte_files")))
    stages = ["raw_files", "processing_errors", "zero_byte_files", "truth_rows", "unreconciled",
              "filtered", "passing", "final_events"]
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("n")) for i, s in enumerate(stages)
    ])).alias("r")).select("r.*")


def attrition_by_category(truth: DataFrame) -> DataFrame:
    """Raw and passing rows per category; full outer so a category may miss on either side."""
    raw = truth.groupBy("category").agg(F.count(F.lit(1)).alias("n_raw"))
    ok = truth.filter(F.col("label") != FILTERED).groupBy("category").agg(F.count(F.lit(1)).alias("n_passing"))
    return raw.join(ok, "category", "full_outer").fillna(0, ["n_raw", "n_passing"])


def compare_datasets(unfiltered: DataFrame, filtered: DataFrame, key: str) -> DataFrame:
    a = unfiltered.agg(F.count(F.lit(1)).alias("n_without"))
    b = filtered.agg(F.count(F.lit(1)).alias("n_with"))
    gone = unfiltered.join(filtered.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_anti"))
    r = a.join(b).join(gone)  # one-row tables
    rejected = F.col("n_without") - F.col("n_with")
    return (r.withColumn("n_rejected", rejected)
            .withColumn("rejection_pct", percent(rejected, F.col("n_without")))
            .withColumn("pass_pct", F.lit(100.0) - F.col("rejection_pct")))


def label_agreement(df: DataFrame, old: str, new: str) -> DataFrame:
    o, n = F.col(old) == 1, F.col(new) == 1
    out = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~o & ~n).alias("tn"), F.count_if(o & n).alias("tp"),
        F.count_if(~o & n).alias("new_only"), F.count_if(o & ~n).alias("old_only"))
    return (out.withColumn("agreement_pct", percent(F.col("tn") + F.col("tp"), F.col("n")))
            .withColumn("disagreement_pct", percent(F.col("new_only") + F.col("old_only"), F.col("n"))))


def label_agreement_per_label(df: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per label from a single pass: counts of old, new and both disagreements."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("label"), F.col(o).alias("o"), F.col(n).alias("n")) for k, (o, n) in labels.items()
    ])).alias("p")
    return df.select(pairs).groupBy("p.label").agg(
        F.sum("p.o").cast("bigint").alias("n_old"), F.sum("p.n").cast("bigint").alias("n_new"),
        F.count_if(F.col("p.n") > F.col("p.o")).alias("new_gt_old"),
        F.count_if(F.col("p.o") > F.col("p.n")).alias("old_gt_new"))


def agreement_by(df: DataFrame, dim: Column, old: str, new: str) -> DataFrame:
    same = F.col(old) == F.col(new)
    return df.groupBy(dim.alias("dim")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"),
        percent(F.count_if(~same), F.count(F.lit(1))).alias("disagree_pct"))


def family_of(name: Column | str, pattern: str = "(CMA|CMB)") -> Column:
    hit = F.regexp_extract(F.col(name) if isinstance(name, str) else name, pattern, 1)
    return F.when(hit == "", "Unknown").otherwise(hit)


def year_in(text: Column | str) -> Column:
    hit = F.regexp_extract(F.col(text) if isinstance(text, str) else text, r"((19|20)\d{2})", 1)
    return F.when(hit != "", hit.cast("int"))


def year_scoped_flag(date_text: Column | str, status: Column | str) -> Column:
    """On before the field was populated, else a yes-word or a numeric 1."""
    s = F.upper(F.col(status) if isinstance(status, str) else status)
    said_yes = F.coalesce(s.isin("OUI", "YES", "ON", "1"), F.lit(False)).cast("int")
    return F.when(year_in(date_text) < FIRST_MEANINGFUL_YEAR, 1).otherwise(said_yes)


def loop_flag(status: Column | str) -> Column:
    s = F.upper(F.col(status) if isinstance(status, str) else status)
    return F.coalesce(s.isin("ON", "OUI", "CLOSED", "1"), F.lit(False)).cast("int")


def primary_label(multilabel: Column | str, names: list[str] = FAULT_CATEGORIES) -> Column:
    """First flagged category; Normal when none is."""
    first = F.array_position(multilabel, 1)
    return F.when(first > 0, F.element_at(F.array(*[F.lit(n) for n in names]), first.cast("int"))).otherwise(NORMAL)


def parse_device_id(df: DataFrame, name: str, sep: str = "-") -> DataFrame:
    """``x-MODULE-CAVITY:y`` to module, cavity and both."""
    module = F.get(F.split(name, sep), F.lit(1))
    cavity = F.substring_index(F.get(F.split(name, sep), F.lit(2)), ":", 1)
    return (df.withColumn("module", module).withColumn("cavity", cavity)
            .withColumn("device_id", F.concat_ws("-", "module", "cavity")))


def trigger_mode_crosstab(df: DataFrame, loop: str, fault: str) -> DataFrame:
    c = df.cube(loop, fault).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
    return c.select(
        F.when(F.col("level") >= 2, "All").otherwise(F.col(loop)).alias("loop"),
        F.when((F.col("level") % 2) == 1, "All").otherwise(F.col(fault).cast("string")).alias("has_fault"), "n")


def trigger_mode(loop: Column | str, fault: Column | str) -> Column:
    on = (F.col(loop) if isinstance(loop, str) else loop) == "ON"
    bad = F.col(fault) if isinstance(fault, str) else fault
    return (F.when(~on & ~bad, "manual").when(on & bad, "auto_fault")
            .when(on & ~bad, "auto_normal").otherwise("rare"))


def filter_or_all(df: DataFrame, cond: Column) -> DataFrame:
    """Rows meeting ``cond``; every row when none does."""
    hits = df.agg(F.count_if(cond).alias("__hits"))
    return df.filter(cond | (hits.scalar() == 0))
