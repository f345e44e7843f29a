"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from faultspark.llm.queries import ORACLES, QUERIES
from tests.compare import rows
from tests.conftest import FOLDER
from tests.llm.brute import WORD, line_runs, near, poisson_draw, repeated_words
from tests.llm.test_packing import check


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rel = duck.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, rel.fetchall())


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage(spark, documents):
    docs, stages = documents, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_join", "mix_sources", "best_fit_packing"]

    before = texts(docs)
    docs = spark.createDataFrame(stages["quality_rules"](spark, docs, FOLDER).collect(), documents.schema)
    kept = texts(docs)
    for d, t in before.items():
        w = WORD.findall(t or "")
        if len(w) < 50 or 100 * repeated_words(w) > 50 * len(w):
            assert d not in kept
    assert all(set(t.split("\n")) <= set(before[d].split("\n")) for d, t in kept.items()) and len(kept) > 0.4 * len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs = spark.createDataFrame(stages["line_dedup"](spark, docs, FOLDER).collect(), documents.schema)
    want = line_runs(kept)
    assert texts(docs) == {d: t for d, t in want.items() if WORD.search(t)}

    before = texts(docs)
    docs = spark.createDataFrame(stages["near_join"](spark, docs, FOLDER).collect(), documents.schema)
    classes = near(before)
    assert texts(docs) == {d: t for d, t in before.items() if classes[d][3] == d}

    held = docs.collect()
    chars = Counter()
    for r in held:
        chars[r["source"]] += len(r["text"])
    total, weight = sum(chars.values()), sum(c**0.5 for c in chars.values())
    docs = spark.createDataFrame(stages["mix_sources"](spark, docs, FOLDER).collect(), documents.schema)
    drawn = {r["doc_id"]: poisson_draw(f"0|{r['doc_id']}|{hashlib.md5(r['text'].encode()).hexdigest()}", total * chars[r["source"]] ** 0.5 / weight / chars[r["source"]]) for r in held}
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter({d: n for d, n in drawn.items() if n})

    check(stages["best_fit_packing"](spark, docs, FOLDER).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_run_is_its_stages(spark, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), documents.schema)
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER))


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            out = stage(spark, df, FOLDER)
            assert (out.columns == df.columns) or name == "best_fit_packing"
            assert out.agg(F.count(F.lit(1))).first()[0] >= 0
