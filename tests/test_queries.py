"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import pytest
from pyspark.sql import functions as F

from faultspark.operators import clustering, extraction, kernels
from faultspark.plans import load_all
from faultspark.plans.registry import Tables
from tests.compare import check
from tests.conftest import FOLDER

QUERIES = load_all()
# codes whose operators take another path on large inputs
CHUNKED = ("B5", "C", "D2", "D11", "E", "H5", "H6", "H7", "H11", "I11", "J4", "K5", "K6", "L", "O6", "P2", "P4", "P8", "P9", "P10", "P16", "P18", "P19")


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, duck, name):
    _, _, error = check(spark, duck, QUERIES[name], FOLDER)
    assert error is None, error


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql and q.code.startswith(CHUNKED)])
def test_matches_sql_in_chunks(spark, duck, tiny_chunks, name):
    _, _, error = check(spark, duck, QUERIES[name], FOLDER)
    assert error is None, error


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_gives_rows(spark, duck, name):
    n, _, error = check(spark, duck, QUERIES[name], FOLDER)
    assert n > 0 and error is None


def test_vectors_are_whole(spark, duck, monkeypatch):
    t = Tables(spark, FOLDER)
    n = t.embeddings.count()
    assert QUERIES["sampled_shapley"].build(t).count() == 64 * n
    assert {r["count"] for r in QUERIES["local_surrogate"].build(t).groupBy("id").count().collect()} == {20}
    seen = []
    monkeypatch.setattr(clustering, "balanced_selection", lambda d, *a, **k: seen.append((d.first()["x"], a, k)) or d.selectExpr("1 AS x"))
    QUERIES["balanced_selection"].build(t)
    (x, a, k), = seen
    assert len(x) == 64 and a == ("category",) and not k


def test_filters_at_their_own_cutoff(spark, monkeypatch):
    t = Tables(spark, FOLDER)
    cut = []
    fake = lambda d, *a, **k: cut.append((a, k)) or d.select(*k["keys"], "idx", F.col("value").alias("filtered"))
    monkeypatch.setattr(kernels, "butterworth_highpass", lambda order, cutoff, f=kernels.butterworth_highpass: cut.append((order, cutoff)) or f(order, cutoff))
    QUERIES["highpass"].build(t)
    QUERIES["highpass_zero_phase"].build(t)
    assert cut == [(4, 0.01), (1, 0.01)]
    cut.clear()
    monkeypatch.setattr(extraction, "highpass", fake)
    QUERIES["extract_features"].build(t)
    assert cut == [((), {"keys": ["series_id", "channel"]})]


def test_every_survey_group_is_registered():
    codes = {q.code for q in QUERIES.values()}
    expected = {"A": 10, "B": 15, "C": 34, "D": 14, "E": 10, "F": 15, "G": 13, "H": 13, "I": 11, "J": 4, "K": 6, "L": 8, "N": 5, "O": 9, "P": 19}
    missing = [f"{g}{i}" for g, n in expected.items() for i in range(1, n + 1) if f"{g}{i}" not in codes]
    assert missing == []
