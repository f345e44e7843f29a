"""Headers of binary recordings: a big-endian int32 size, then UTF-8 ``KEY=value(unit)`` lines.

Two ways, with the same rows. ``read_headers`` opens each listed file in the tasks and reads the
size and the header only, however long the recording. ``decode_header`` is an expression over the
``content`` column of Spark's binaryFile source, for file systems that only Hadoop can open and
files below its 2 GB.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.iterate import cut_lineage
from .ingest import list_files, parse_header, skip_reason

PREFIX = 4
#: Files that a task opens, and that a folder gets when written.
FILES = 1024
LISTED = "path string, length bigint, modificationTime timestamp, folder boolean"
ADDED = T.StructType([T.StructField("header_size", T.IntegerType()), T.StructField("header_text", T.StringType()),
                      T.StructField("readable", T.BooleanType()), T.StructField("failed", T.BooleanType())])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it of a path as Spark lists it, blanks and all."""
    if "://" in path:
        scheme, rest = path.split("://", 1)
        return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _header(path: str) -> tuple[int | None, str | None, bool, bool]:
    try:
        system, inside = file_system(path)
        with system.open_input_file(inside) as f:
            raw = f.read(PREFIX)
            if len(raw) < PREFIX:
                return None, None, True, True
            size = struct.unpack(">i", raw)[0]
            if size < 0:
                return size, None, True, True
            return size, f.read(min(size, max(f.size() - PREFIX, 0))).decode("utf-8", errors="ignore"), True, False
    except PermissionError:
        return None, None, False, False
    except (OSError, pa.ArrowException):
        return None, None, True, True


def read_headers(files: DataFrame) -> DataFrame:
    """Adds header_size, header_text, readable and failed to a table with ``path``.

    Samples are never read. A file shorter than its header gives what there is; bytes that are no
    UTF-8 are left out. ``failed`` marks fewer than four bytes, a negative size, and a file that
    is gone or breaks; ``readable`` is false where permission is denied. A null path failed.
    Columns named like the added ones are replaced, all others pass through.
    """
    base = files.drop(*ADDED.names)
    types = [pa.int32(), pa.string(), pa.bool_(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # few header texts at a time
                part = b.slice(lo, 256)
                got = [_header(p) if p is not None else (None, None, True, True) for p in part.column("path").to_pylist()]
                new = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *ADDED.names])

    return base.mapInArrow(work, T.StructType([*base.schema.fields, *ADDED.fields]))


def decode_header(content: Column | str) -> tuple[Column, Column, Column]:
    """header_size, header_text and failed from the bytes of a file; U+FFFD is left out with the bytes that are no UTF-8."""
    c = F.col(content) if isinstance(content, str) else content
    unsigned = F.conv(F.hex(F.substring(c, 1, PREFIX)), 16, 10).cast("bigint")
    size = F.when(F.length(c) >= PREFIX, F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned).cast("int"))
    failed = F.coalesce(size < 0, F.lit(True))
    body = F.substring(c, F.lit(PREFIX + 1), F.greatest(size, F.lit(0))).cast("string")
    return size, F.when(~failed, F.replace(F.make_valid_utf8(body), F.lit("�"), F.lit(""))), failed


def _entries(folder: str) -> Iterator[tuple]:
    """What Spark would list in a folder, not in those below: path, length, time, whether it is a folder."""
    system, inside = file_system(folder)
    for f in system.get_file_info(fs.FileSelector(inside)):
        name, is_folder = f.base_name, f.type == fs.FileType.Directory
        hidden = name.startswith(".") or name.startswith("_") and "=" not in name
        if not hidden and not name.endswith("._COPYING_") and (is_folder or f.type == fs.FileType.File and f.size):
            yield f"{folder.rstrip('/')}/{name}", f.size, f.mtime, is_folder


def list_in_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The files that ``list_files`` gives for a folder, listed by tasks, one level of folders after the other.

    The driver sees the number of folders only. Patterns, and paths that mean another file system
    than they say, are left to Spark's listing.
    """
    local = folder.startswith("file:") or "://" not in folder
    if any(c in folder for c in "*?[]{}\\") or local and not folder.startswith("file:") and not spark.conf.get("spark.hadoop.fs.defaultFS", "file:").startswith("file:"):
        return list_files(spark, folder)
    base = "file:" + file_system(folder)[1] if local else folder
    types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                found = list(_entries(path))
                for lo in range(0, len(found), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[lo : lo + 8192]), types)], ["path", "length", "modificationTime", "folder"])

    level, files = spark.createDataFrame([(base,)], "path string"), None
    while True:
        here = cut_lineage(level.mapInArrow(work, LISTED))
        new = here.filter("NOT folder").drop("folder")
        files = new if files is None else files.unionByName(new)
        below = here.filter("folder").select("path")
        n = below.count()
        if not n:
            return files
        level = below.repartition(min(n, max(256, math.ceil(n / 16))))


def scan_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Listing with ``reason``, and for usable recordings the header map and the number of acquisitions.

    Files that their name or size excludes are not opened; hidden ones are not listed. Listing and
    opening are dealt out to tasks.
    """
    files = list_in_tasks(spark, folder)
    listed = files.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(files.count() / FILES)), "path").withColumn("__skip", skip_reason())
    # an excluded file keeps its row, but its path is not handed to the reader
    opened = listed.withColumn("listed_path", F.col("path")).withColumn("path", F.when(F.col("__skip").isNull(), F.col("path")))
    read = read_headers(opened).withColumn("path", F.col("listed_path")).drop("listed_path")
    reason = F.coalesce("__skip", F.when(~F.col("readable"), "permission_denied").when(F.col("failed"), "other_error"))
    done = read.withColumn("reason", reason).withColumn("header_text", F.when(F.col("reason").isNull(), F.col("header_text")))
    return parse_header(done, "header_text").drop("__skip", "readable", "failed", "header_text")


def write_recordings(rows: DataFrame, folder: str, spread: bool = False) -> int:
    """One file for each row with name, header (text) and body (binary); the number of files.

    ``spread`` deals them by their names to folders below, of about FILES files each. A task that is run again writes the same bytes to the same name.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        system, inside = file_system(folder)
        made = set()
        for b in batches:
            for name, header, body, sub in zip(*(b.column(c).to_pylist() for c in ("name", "header", "body", "sub"))):
                raw = header.encode()
                if sub not in made:
                    system.create_dir(inside + sub, recursive=True)
                    made.add(sub)
                with system.open_output_stream(f"{inside}{sub}/{name}") as f:
                    f.write(struct.pack(">i", len(raw)) + raw + body)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    parts = max(1, math.ceil(rows.count() / FILES)) if spread else 0
    sub = F.concat(F.lit("/"), F.pmod(F.xxhash64("name"), F.lit(parts)).cast("string")) if spread else F.lit("")
    rows = rows.select("name", "header", "body", sub.alias("sub"))
    rows = rows.repartition(parts, "sub") if spread else rows
    return rows.mapInArrow(work, "n bigint").agg(F.sum("n")).first()[0] or 0
