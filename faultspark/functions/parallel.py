"""Independent fits at the same time, as each alone leaves most of a cluster idle."""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fits that run at once.
AT_ONCE = 8
#: Values of a partition at least and at most, where the same rows are read again and again.
LEAST, MOST = 1 << 15, 1 << 22


def scan_parts(rows: DataFrame, vec: str, least: int = LEAST, most: int = MOST) -> int:
    """Partitions for rows that many jobs read: over all cores, but no task for a handful of rows, as each job pays for its tasks."""
    values = rows.agg(F.sum(F.size(vec).cast("bigint"))).first()[0] or 0
    return max(1, min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(values / least)), math.ceil(values / most))


def run_all(tasks: list[Callable], at_once: int = AT_ONCE) -> list:
    """Results of all tasks in order; each runs Spark jobs of its own from a thread."""
    if not tasks:
        return []
    spark = SparkSession.active()
    with ThreadPool(min(at_once, len(tasks))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in tasks], chunksize=1)
