import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from faultspark.llm import fingerprints as fp
from tests.llm.brute import jaccard, shingles


def check(rows, docs):
    """docs: (id, text) in ascending order of id."""
    err = []
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, (d, t) in enumerate(docs):
        after = docs[i - 1][1] or ""
        t = t or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + after[:k]
        r = by[d][0]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(after)
        err += [abs(jaccard(a, b) - r["near_edited"]), abs(jaccard(a, c) - r["near_next"])]
        assert fp.Sketch.read(r["fingerprint"]).resemblance(fp.Sketch.read(r["edited_fingerprint"])) == r["near_edited"]
        if len(a) <= fp.K:
            assert r["n_shingles"] == len(a)
        else:
            assert abs(r["n_shingles"] / len(a) - 1) < 0.35
    assert max(err) < 0.15 and np.mean(err) < 0.02
    same = {}
    for d, t in docs:
        assert same.setdefault(t or "", by[d][0]["fingerprint"]) == by[d][0]["fingerprint"]


def test_whole_table(documents):
    rows = fp.compare_edited(documents).collect()
    docs = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert len(rows) == len(docs)
    check(rows, docs)


def test_odd_rows(odd, none):
    assert fp.compare_edited(odd).count() == odd.count() and fp.compare_edited(none).count() == 0
    unique = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check(fp.compare_edited(unique).collect(), sorted((r["doc_id"], r["text"]) for r in unique.collect()))
    assert fp.fingerprint(none).count() == 0 and fp.fingerprint(odd).count() == odd.count()


numbers = st.lists(st.integers(0, 2**64 - 1), max_size=60)


@settings(max_examples=200, deadline=None)
@given(numbers, numbers)
def test_merged_sketch_is_that_of_the_whole(a, b):
    a, b = np.array(a, np.uint64), np.array(b, np.uint64)
    both, merged = fp.Sketch.of(np.concatenate([a, b]), 16), fp.Sketch.of(a, 16).merge(fp.Sketch.of(b, 16), 16)
    assert (both.low[: len(merged.low)] == merged.low).all() and both.whole == merged.whole
    assert len(merged.low) == min(16, len(np.unique(np.concatenate([a, b]))))


def test_containment_and_parts(spark):
    words = [f"w{i}" for i in range(3000)]
    whole, half = fp.Sketch.of(next(iter(map(lambda s: s.low, fp.sketches([" ".join(words)], 10**6)))), 256), None
    half = next(iter(fp.sketches([" ".join(words[:1500])], 256)))
    assert abs(half.containment(whole) - 1) < 0.2 and abs(whole.containment(half) - 0.5) < 0.15
    parts = spark.createDataFrame([(1, " ".join(words[:2000])), (1, " ".join(words[1996:])), (2, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fp.merge_fingerprints(fp.fingerprint(parts), "doc_id").collect()}
    assert got[1] == whole.text()
