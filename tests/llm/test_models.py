"""Scores learnt from labels: toxicity and quality."""

import numpy as np
import pytest

from faultspark.llm import labelled, quality_model, toxicity
from tests.llm.conftest import odd_rows

MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")


def test_nearest_are_those_of_all_cosines():
    rng = np.random.default_rng(4)
    n_terms, n_docs = 60, 500
    dense = np.where(rng.random((n_docs, n_terms)) < 0.1, rng.exponential(1.0, (n_docs, n_terms)), 0.0)
    dense[17] = dense[18] = dense[19]  # ties
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    doc, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(doc, term, dense[doc, term], n_docs, n_terms, block=8)
    for _ in range(200):
        q = np.where(rng.random(n_terms) < rng.choice([0.02, 0.1, 0.5]), rng.exponential(1.0, n_terms) ** 3, 0.0)
        q = q / max(np.linalg.norm(q), 1e-12)
        if rng.random() < 0.1:
            q = dense[17]
        at = np.flatnonzero(q)
        for k in (1, 5, 16):
            found, near = index.nearest(at, q[at], k)
            all_ = dense @ q
            want = np.sort(all_[all_ > 0])[::-1][:k]
            assert np.allclose(near, want) and np.allclose(all_[found], want)


def test_blocks_that_cannot_matter_are_skipped():
    """Examples of twelve topics: the bounds leave out most blocks, and the nearest are those of all cosines."""
    rng = np.random.default_rng(8)
    n_terms, n_docs = 240, 3000
    topic = rng.integers(0, 12, n_docs)
    dense = np.where(rng.random((n_docs, n_terms)) < 0.05, rng.random((n_docs, n_terms)), 0.0)
    for d in range(n_docs):
        dense[d, topic[d] * 20 + rng.choice(20, 6, replace=False)] += 4.0
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    doc, term = np.nonzero(dense)
    for columns in (0, 100, 240):  # postings only, both, matrices only
        index = toxicity.BlockMaxIndex(doc, term, dense[doc, term], n_docs, n_terms)
        index.common = np.argsort(-np.diff(index.at), kind="stable")[:columns]
        index.column[:] = -1
        index.column[index.common] = np.arange(columns)
        queries = [dense[i] for i in range(0, n_docs, 30)]
        for q, (found, near) in zip(queries, index.nearest_of_all([(np.flatnonzero(q), q[q > 0]) for q in queries], 16)):
            want = sorted(((-round(s, 9), i) for i, s in enumerate(dense @ q) if s > 0))[:16]
            assert [i for _, i in want] == found.tolist() and np.allclose([-s for s, _ in want], near)
        assert index.seen + index.skipped == 100 * index.n_blocks and index.skipped > 0.7 * 100 * index.n_blocks


def measure(rows, labels, label):
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    y, p, s = (np.array(x) for x in zip(*[(truth[r["doc_id"]], r["predicted"], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]))
    return (y == p).mean(), ((p == 1) & (y == 0)).sum(), -np.log(np.where(y == 1, s, 1 - s) + 1e-9).mean()


def test_toxicity_of_held_out_documents(more):
    docs, labels = more
    rows = toxicity.score_toxicity(docs, labels).collect()
    accuracy, wrong, loss = measure(rows, labels, "toxic")
    assert len(rows) == docs.count() and accuracy > 0.93 and wrong == 0 and loss < 0.3
    held = {r["doc_id"] for r in rows if r["held_out"]}
    cited = {int(x.split(":")[0]) for r in rows for x in r["evidence"].split(",") if x}
    assert cited and not cited & held


def test_neighbours_are_those_of_all_words(more):
    """Cosines over every word of every text, by dictionaries."""
    docs, labels = more
    docs = docs.unionByName(docs.filter("doc_id % 100 = 3"))  # repeated rows
    words = [(r["doc_id"], {}) for r in docs.select("doc_id").collect()]
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    df = {}
    for (_, own), text in zip(words, texts):
        h, offs = toxicity.folded_words([text])
        for w in h.tolist():
            own[w] = own.get(w, 0) + 1
        for w in own:
            df[w] = df.get(w, 0) + 1
    sample = {r["doc_id"]: r["y"] for r in labelled.labelled_sample(docs, labels, "toxic", toxicity.REFERENCES, toxicity.CALIBRATE, balanced=True).filter("fit").collect()}
    refs = [(i, own) for i, own in words if i in sample]
    n, share, seen = len(refs), np.mean([sample[i] for i, _ in refs]), {}
    for i, own in refs:
        for w in own:
            a = seen.setdefault(w, [0, 0])
            a[0] += 1
            a[1] += sample[i]

    def vector(own):
        v = {}
        for w, tf in own.items():
            c, yes = seen.get(w, (0, 0))
            chi2 = (yes - c * share) ** 2 / max(c * share * (1 - share) * (1 - c / n), 1e-9)
            v[w] = (1 + np.log(tf)) * (np.log((1 + len(words)) / (1 + df[w])) + 1) * max(1.0, chi2)
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    index = [vector(own) for _, own in refs]
    got = {}
    for r in toxicity.score_toxicity(docs, labels).collect():
        got.setdefault(r["doc_id"], []).append((r["score"], r["evidence"]))
    for i, own in words[:1000:20] + words[-5:]:
        v = vector(own)
        want = sorted((sum(x * d.get(w, 0.0) for w, x in v.items()) for d in index), reverse=True)
        want = [x for x in want if x > 0][: toxicity.K]
        assert len(set(got[i])) == 1
        near = [float(x.split(":")[2]) for x in got[i][0][1].split(",") if x]
        assert len(near) == len(want) and np.allclose(near, want, atol=1e-4)


def test_size_of_the_samples(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "'one' AS text")
    marks = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    n = {r["fit"]: r["count"] for r in labelled.labelled_sample(docs, marks, "toxic", toxicity.REFERENCES, toxicity.CALIBRATE, balanced=True).groupBy("fit").count().collect()}
    assert abs(n[True] - 6144) < 300 and abs(n[False] - 8192) < 400


def test_quality_of_held_out_documents(more):
    docs, labels = more
    rows = quality_model.score_quality(docs, labels).collect()
    accuracy, _, loss = measure(rows, labels, "quality")
    assert len(rows) == docs.count() and accuracy > 0.95 and loss < 0.2


def test_scores_are_those_of_a_plain_statement(documents, labels):
    """Index vectors, neighbours, pooling and the network's answer, token by token."""
    place, sign = quality_model.index_vectors()
    docs = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = {}
    for d, text in docs.items():
        tokens, _ = quality_model.styled_tokens([text])
        rows[d] = [int(t >> 50) & (quality_model.ROWS - 1) for t in tokens.tolist()]
    sums, count = {}, {}
    for own in rows.values():
        for i, r in enumerate(own):
            count[r] = count.get(r, 0) + 1
            v = sums.setdefault(r, np.zeros(quality_model.DIMS))
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(own):
                    for p, s in zip(place[own[j]], sign[own[j]]):
                        v[p] += s
    total = sum(count.values())

    def pooled(own):
        plain, weighted, w = np.zeros(quality_model.DIMS), np.zeros(quality_model.DIMS), 0.0
        for r in own:
            v = sums[r] / max(np.linalg.norm(sums[r]), 1e-12)
            rare = quality_model.RARE / (quality_model.RARE + count[r] / total)
            plain, weighted, w = plain + v, weighted + v * rare, w + rare
        return np.concatenate([plain / max(len(own), 1), weighted / max(w, 1e-12)])

    x = {d: pooled(own) for d, own in rows.items()}
    vectors, share, net = quality_model.fit(documents, labels)
    assert np.allclose(quality_model.pool([docs[d] for d in x], vectors, share), np.array(list(x.values())), atol=1e-4)
    got = {r["doc_id"]: r["score"] for r in quality_model.score_quality(documents, labels).collect()}
    w1, b1, w2, b2 = net.p
    for d, v in x.items():
        z = [min(max((a - m) / s, -8), 8) for a, m, s in zip(v, net.mean, net.std)]
        hidden = [np.tanh(sum(a * w for a, w in zip(z, w1[:, k])) + b1[k]) for k in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2)) + b2[0]
        assert abs(got[d] - 1 / (1 + np.exp(-logit / net.temperature))) < 5e-3


def test_held_out_labels_change_nothing(spark, more):
    docs, labels = more
    flipped = labels.withColumn("toxic", 1 - labels["toxic"]).filter(labelled.held_out()).unionByName(labels.filter(~labelled.held_out()))
    a = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert a == b


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 5)), rng.integers(0, 2, 40).astype(float)
    net = quality_model.Network(x, y)
    z = net._scaled(x)

    def loss():
        f = np.tanh(z @ net.p[0] + net.p[1]) @ net.p[2] + net.p[3]
        return np.mean(np.logaddexp(0, f) - y * f)

    for k, g in enumerate(net._gradient(z, y)):
        for at in list(np.ndindex(g.shape))[:6]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-5
            up = loss()
            net.p[k][at] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - g[at]) < 1e-6
            net.p[k][at] = old


def test_word_vectors_cover_all_partitions(spark, more):
    docs = more[0].limit(60).select("text")
    texts = [r["text"] for r in docs.collect()]
    v, share = quality_model.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    total = quality_model.neighbour_sums(texts)
    assert np.allclose(share, total[:, -1] / total[:, -1].sum(), atol=1e-7)
    assert np.allclose(v, total[:, :-1] / np.maximum(np.linalg.norm(total[:, :-1], axis=1, keepdims=True), 1e-12), atol=1e-5)


@pytest.mark.parametrize("score, label", [(toxicity.score_toxicity, "toxic"), (quality_model.score_quality, "quality")])
def test_odd_rows(spark, odd, none, score, label):
    marks = spark.createDataFrame([(i, i % 2, None) for i in range(1, 12)] + [(None, 1, 1), (7, None, None), (99, 1, 0)], "doc_id long, toxic int, quality int")
    marks = marks.selectExpr("doc_id", f"toxic AS {label}", "1 AS text", "2 AS n")
    for labels in (marks, marks.limit(0), marks.filter(f"{label} = 1")):
        rows = score(odd, labels).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.7 if label == "toxic" else 0.5)) for r in rows)
        assert all(r["held_out"] is not None for r in rows)
    assert score(none, marks).count() == 0
