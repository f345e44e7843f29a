"""Sources and sinks: file listings, header text, truth CSV, archive history, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import micros

# File kinds that are never recordings, and the smallest usable size.
EXCLUDED_SUFFIXES = [".txt", ".md", ".json", ".pyc", ".log", ".xml", ".html",
                     ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".csv", ".fig"]
EXCLUDED_NAMES = [".directory", ".DS_Store", "Thumbs.db"]
MIN_BYTES = 100

# Column names of the truth file.
TRUTH_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("Fichier", "Defaut", "Label", "Détails")])

RUN_KEYS = ("dataset_version", "dataset_path", "script")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive listing without reading content (the content column is pruned)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", "length", "modificationTime")


def basename(path: Column | str) -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def skip_reason(path: str = "path", length: str = "length", is_file: str | None = None,
                readable: str | None = None, failed: str | None = None) -> Column:
    """First reason to skip a file, NULL for a usable recording."""
    name = basename(path)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    reason = F.when(F.lit(False), F.lit(""))
    if is_file:
        reason = reason.when(~F.col(is_file), F.lit("not_file"))
    reason = (
        reason.when(name.startswith("."), F.lit("hidden"))
        .when(name.isin(EXCLUDED_NAMES), F.lit("excluded_name"))
        .when(suffix.isin(EXCLUDED_SUFFIXES), F.lit("excluded_suffix"))
        .when(F.col(length) < MIN_BYTES, F.lit("too_small"))
    )
    if readable:
        reason = reason.when(~F.col(readable), F.lit("permission_denied"))
    if failed:
        reason = reason.when(F.col(failed), F.lit("other_error"))
    return reason


def scan_files(files: DataFrame, **columns) -> DataFrame:
    """Listing with a ``reason`` column; usable rows have NULL."""
    return files.withColumn("reason", skip_reason(**columns))


def scan_summary(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("total_bytes"))


def header_map(text: Column | str) -> Column:
    """``KEY=value(unit)`` lines to a map; the last line of a repeated key wins."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: F.instr(s, F.lit("=")) > 0)

    def entry(s: Column) -> Column:
        key = F.trim(F.substring_index(s, "=", 1))
        rest = F.trim(F.substr(s, F.instr(s, F.lit("=")) + 1))
        # cut before the last opening bracket, when there is one
        value = F.when(F.instr(rest, F.lit("(")) > 0,
                       F.trim(F.regexp_extract(rest, r"(?s)^(.*)\([^(]*$", 1))).otherwise(rest)
        return F.struct(key.alias("key"), value.alias("value"))

    entries = F.transform(lines, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def parse_header(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``header`` (map) and ``num_acq``, the number of numbered acquisition keys."""
    df = df.withColumn("header", header_map(text_col))
    numbered = F.filter(F.map_keys("header"), lambda k: k.rlike(r"^ACQ[0-9]+$"))
    return df.withColumn("num_acq", F.size(numbered))


def read_delimited_truth(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep=";", header=True, schema=TRUTH_SCHEMA, encoding="UTF-8")
    return clean_truth(raw)


def clean_truth(raw: DataFrame) -> DataFrame:
    """Null text becomes '' and the key is the file's base name."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return raw.select(
        basename(text("Fichier")).alias("file"),
        text("Defaut").alias("category"),
        text("Label").alias("label"),
        text("Détails").alias("details"),
    )


def incremental_ingest(new: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` whose key has not been processed yet."""
    keys = [key] if isinstance(key, str) else key
    return new.join(done.select(*keys), keys, "left_anti")


def union_batches(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def split_outcomes(df: DataFrame, success: str = "success", quality: str = "quality_pass") -> DataFrame:
    """Add ``outcome``: error, quality_fail or quality_pass."""
    return df.withColumn(
        "outcome",
        F.when(~F.coalesce(F.col(success), F.lit(False)), "error")
        .when(~F.coalesce(F.col(quality), F.lit(False)), "quality_fail")
        .otherwise("quality_pass"),
    )


def top_errors(df: DataFrame, error: str = "error", n: int = 10) -> DataFrame:
    return (df.filter(F.col("outcome") == "error").groupBy(error).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), error).limit(n))


def read_pv_history(sample: DataFrame, channel: DataFrame, name: str, start, end) -> DataFrame:
    """Samples of one channel in ``[start, end)``; nanoseconds stay a separate column."""
    ids = channel.filter(F.col("name") == name).select("channel_id")
    part = sample.filter((F.col("smpl_time") >= F.lit(start)) & (F.col("smpl_time") < F.lit(end)))
    return part.join(ids, "channel_id").select(
        F.col("smpl_time").alias("time"), "nanosecs", F.col("float_val").alias("value")
    ).orderBy("time", "nanosecs")


def read_many_pvs(sample: DataFrame, channel: DataFrame, requests: DataFrame, bin_days: int = 1) -> DataFrame:
    """Many (name, start, end) windows in one range join on channel and day bin.

    Each request is split over the day bins it touches, so the join is an equi-join
    on (channel, bin) and a busy channel spreads over its days.
    """
    width = bin_days * 86400

    def day_bin(c: Column) -> Column:
        return F.floor(micros(c) / (width * 1_000_000))

    asked = requests.join(channel, "name").withColumn(
        "bin", F.explode(F.sequence(day_bin(F.col("start")), day_bin(F.col("end")))))
    s = sample.withColumn("bin", day_bin(F.col("smpl_time")))
    hit = (F.col("smpl_time") >= F.col("start")) & (F.col("smpl_time") < F.col("end"))
    return s.join(asked, ["channel_id", "bin"]).filter(hit).select(
        "request_id", "name", F.col("smpl_time").alias("time"), "nanosecs", F.col("float_val").alias("value"))


def write_dataset(df: DataFrame, path: str, partition: list[str] | None = None, fmt: str = "parquet",
                  mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition:
        writer = writer.partitionBy(*partition)
    (writer.option("header", "true").csv if fmt == "csv" else writer.parquet)(path)


def display_value(value: Column | str, fmt: Column | str) -> Column:
    """Text form of a value for the usual formats: ',', '.Nf', '.N%' or none."""
    v = F.col(value) if isinstance(value, str) else value
    f = F.col(fmt) if isinstance(fmt, str) else fmt
    digits = F.coalesce(F.regexp_extract(f, r"\.(\d+)", 1).try_cast("int"), F.lit(0))
    plain = F.regexp_replace(F.call_function("format_number", v, digits), ",", "")
    return (F.when(f.isNull(), v.cast("string"))
            .when(f == ",", F.format_number(v, 0))
            .when(f.rlike(r"^,\.\d+f$"), F.call_function("format_number", v, digits))
            .when(f.rlike(r"^\.\d+f$"), plain)
            .when(f.rlike(r"^\.\d+%$"), F.concat(F.regexp_replace(F.call_function("format_number", v * 100, digits), ",", ""), F.lit("%")))
            .otherwise(v.cast("string")))


def metric_rows(df: DataFrame, phase: str, run: dict[str, str], generated_at: Column | None = None) -> DataFrame:
    """(metric, value, fmt, label_name) rows with run provenance and a display text."""
    missing = [k for k in RUN_KEYS if not run.get(k)]
    if missing:
        raise ValueError(f"run is missing {missing}")
    return df.select(
        F.lit(phase).alias("phase"), "metric", "label_name", F.col("value").cast("double").alias("value"), "fmt",
        display_value("value", "fmt").alias("display"),
        *[F.lit(run[k]).alias(k) for k in RUN_KEYS],
        (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
    )


def write_metrics(df: DataFrame, path: str, phase: str, run: dict[str, str]) -> None:
    """Append metric rows; refuses an empty set and missing value or label."""
    rows = metric_rows(df, phase, run)
    total, incomplete = rows.agg(
        F.count(F.lit(1)), F.count_if(F.col("value").isNull() | F.col("label_name").isNull())).first()
    if not total:
        raise ValueError("metrics must be non-empty")
    if incomplete:
        raise ValueError("each metric needs a value and a label")
    rows.write.mode("append").parquet(path)
