"""One list of queries; each may carry the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    code: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, code: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``; ``code`` is the SURVEY operator id."""

    def add(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, code, build, sql)
        return build

    return add


def R(expr: str, n: int = 6) -> str:
    """SQL counterpart of ``rnd``."""
    return f"(round(CAST({expr} AS DOUBLE) + {3.7 * 10.0 ** -(n + 4)!r}::DOUBLE, {n}) + 0.0)"
