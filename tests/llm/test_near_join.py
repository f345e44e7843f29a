import random
from collections import Counter

import numpy as np
import pytest

from faultspark.llm import near_join
from tests.llm.brute import near
from tests.llm.conftest import odd_rows


def check(rows, docs):
    want = near(docs)
    assert {r["doc_id"]: (r["copy_of"], r["n_copies"], r["n_links"], r["class_id"]) for r in rows} == want


def test_whole_table(documents):
    check(near_join.near_join(documents).collect(), {r["doc_id"]: r["text"] for r in documents.collect()})


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [2048, 7])
def test_group_of_near_copies(spark, monkeypatch, block):
    """All links of a group, also where it is dealt into many blocks."""
    monkeypatch.setattr(near_join, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    docs = {i: edited(rng, base, i % 6) for i in range(60)}
    docs |= {100 + i: " ".join(f"v{rng.randrange(400)}" for _ in range(200)) for i in range(20)} | {200: docs[3], 201: "", 202: None, 203: "a b", 204: "a  b"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    # a high recall, so that the pairs at the threshold meet as well
    rows = near_join.near_join(d, recall=1 - 1e-9).collect()
    check(rows, docs)
    assert Counter(r["class_id"] for r in rows)[0] == 61


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.998):
        b = near_join.bands_for(0.8, recall, 5)
        assert 1 - (1 - 0.8**5) ** b >= recall > 1 - (1 - 0.8**5) ** (b - 1)


def test_recall_at_the_threshold(spark):
    rows = []
    for i in range(400):
        n = 400
        base = [f"p{i}_{j}" for j in range(n)]
        other = base[:]
        for j in range(0, 5 * round(n * 0.2 / 1.8 / 5) - 4, 5):  # each change costs five shingles
            other[j + 2] += "x"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = near_join.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.mean([r["n_links"] for r in got]) > 0.98


def test_odd_rows(odd, none):
    rows = near_join.near_join(odd).collect()
    assert len(rows) == odd.count() and near_join.near_join(none).count() == 0
    docs = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    want, got = near(docs), {r["doc_id"]: r for r in rows}
    for d, (_, _, links, cls) in want.items():
        assert got[d]["n_links"] == links and got[d]["class_id"] == cls
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    kept = near_join.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([*{w[3] for w in want.values()}, None])
    assert near_join.one_of_each(none).count() == 0
