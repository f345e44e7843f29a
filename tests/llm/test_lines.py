"""Line rules and line dedup."""

import random

from pyspark.sql import functions as F

from faultspark.llm import line_dedup, quality_rules as qr
from tests.llm.brute import WORD, line_runs, repeated_words
from tests.llm.conftest import odd_rows


def texts_of(df):
    return {r["doc_id"]: r["clean_text"] for r in df.collect()}


def test_random_corpora(spark):
    """Few different lines, so runs overlap, nest and repeat inside a document."""
    for seed in range(4):
        rng = random.Random(seed)
        pool = [" ".join(f"{c}{k}" for k in range(rng.choice([1, 3, 9, 20, 60]))) for c in "abcdefgh"] + ["", "  "]
        docs = {i: "\n".join(rng.choices(pool, k=rng.randrange(0, 30))) for i in range(12)}
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
        assert texts_of(line_dedup.dedup_lines(df)) == line_runs(docs), seed


def test_whole_table(documents):
    assert texts_of(line_dedup.dedup_lines(documents)) == line_runs({r["doc_id"]: r["text"] for r in documents.collect()})


def test_odd_rows_of_line_dedup(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and line_dedup.dedup_lines(none).count() == 0
    got = {r["doc_id"]: r for r in out.collect()}
    # rows equal in doc_id and text are one document; its lines stay, later ones go
    want = line_runs({r[0]: r[1] for r in odd_rows() if r[0] is not None})
    assert {d: got[d]["clean_text"] for d in want} == want
    assert got[8]["n_removed_lines"] == 4 and got[8]["clean_text"] == "" and got[9]["clean_text"] == "before it\n\nafter it"
    assert set(odd.columns) <= set(out.columns)


def test_counts_equal_plain_python(documents, odd):
    for df in (documents.select("doc_id", "text"), odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        docs = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in qr.quality_rules(df).collect():
            text = docs[r["doc_id"]]
            w = WORD.findall(text)
            lines = [x for x in text.split("\n") if WORD.search(x)]
            rep = repeated_words(w)
            failed = len(w) < 50 or 100 * rep > 50 * len(w)
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
                len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, failed), r["doc_id"]
            assert not (failed and r["kept"])


def test_rules_of_lines(spark):
    bad = {
        "symbols": "one%%% two*** three### four&&& five$$$ six%%% seven***", "shouted": "BUY!! NOW!! CHEAP!! THINGS!! HERE!! TODAY!! FAST!!", "open": "no end",
        "navigation": "Home | About us | Contact | Help | Terms", "boilerplate": "All rights reserved."}
    body = "\n".join(f"Line{i} is a{i} plain b{i} sentence c{i} of d{i} some e{i} words f{i} that g{i} end h{i}." for i in range(6))
    rows = [(1, body)] + [(i + 2, f"{body}\n{x}") for i, x in enumerate(bad.values())] + [(20, body + "\n" + "\n".join(" | ".join(f"i{k}{j}" for j in range(40)) for k in range(8)))]
    got = {r["doc_id"]: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["n_removed_lines"] == 0 and got[1]["clean_text"] == body
    for i in range(2, 2 + len(bad)):
        assert got[i]["kept"] and got[i]["clean_text"] == body, i
    assert not got[20]["kept"] and not got[20]["base_failed"] and got[20]["lost_share"] > 0.5


def test_repeats_of_texts_beyond_the_packed_size(spark):
    """Both ways of finding repeated windows give the same count."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randrange(3, 400))) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ws", F.split("text", " "))
    d = df
    for name, c in qr.repeated_words("ws", bits=4).items():
        d = d.withColumn(name, c)
    assert {r["doc_id"]: r["n_repeat_words"] for r in d.collect()} == {i: repeated_words(t.split(" ")) for i, t in enumerate(texts)}


def test_odd_rows_of_quality_rules(odd, none):
    out = qr.quality_rules(odd)
    assert out.count() == odd.count() and qr.quality_rules(none).count() == 0
    got = {r["doc_id"]: r for r in out.collect()}
    assert not got[1]["kept"] and got[1]["n_words"] == 0 and got[3]["n_lines"] == 0 and got[5]["n_repeat_words"] == 60_000 and not got[5]["kept"]
