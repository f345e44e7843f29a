"""Exact top-k search against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultspark.llm import exact_topk as E
from tests.conftest import FOLDER

LIMIT = 2**24 / 256


def plain(rows, every, k):
    known = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < LIMIT for x in v)]
    asked = {}
    for i, v in known:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def got(frame, every, k):
    return sorted(tuple(r) for r in E.search(frame, F.col("vec_id") % every == 0, k).select("query_id", "rank", "vec_id", "score").collect())


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(300)]
    same = [0.5, -0.25, 1.0, 0.0, 2.0, -1.0]
    rows += [(1000 + i, same) for i in range(500)]  # ties of a large group of copies
    rows += [(7, same), (7, same), (10, [9.0] * 6), (10, [-9.0] * 6)]  # repeated rows and ids
    rows += [(2000, None), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2020, [math.nan] * 6), (2030, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (2040, [1e30] + [0.0] * 5), (None, same)]
    rows += [(3000, []), (3001, []), (3010, [1.0, 2.0]), (3011, [0.0, 0.0]), (3012, [2.0, 1.0]), (-20, [60000.0] * 6), (-21, [-60000.0] * 6), (4000, [1.0])]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<double>")
    clash = ["id", "v", "dim", "row", "part", "grp", "lo", "top", "width", "above", "bound", "asks", "query_id", "rank", "score", "bin", "n"]
    return d.select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_ties_nulls_copies_and_few_candidates(odd, k):
    assert got(odd, 10, k) == plain(odd_vectors(), 10, k)


def test_many_cells_and_narrow_bins(odd, monkeypatch):
    monkeypatch.setattr(E, "CANDIDATES", 64)
    monkeypatch.setattr(E, "QUERIES", 16)
    assert got(odd, 10, 5) == plain(odd_vectors(), 10, 5)


def test_the_whole_table(spark):
    d = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in d.select("vec_id", "embedding").collect()]
    assert got(d, 50, 5) == plain(rows, 50, 5)


def test_empty_tables(odd):
    assert E.search(odd.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert E.search(odd, F.lit(False)).count() == 0
