"""Clusterings in shared scans against their plain forms, one group at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultspark.operators import clustering as I, many_clusterings as many, neighbours as NB
from tests.test_kernels import brute_dbscan


def blobs(seed, n, k, d, gap=6.0):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, gap, (k, d))
    return at[rng.integers(0, k, n)] + rng.normal(0, 0.6, (n, d))


@pytest.fixture(scope="module")
def two(spark):
    x = {"a": blobs(1, 150, 3, 4), "b": blobs(2, 90, 2, 4)}
    rows = [(i, c, [float(v) for v in r]) for i, (c, r) in enumerate((c, r) for c, m in x.items() for r in m)] + [(900, "tiny", [0.0] * 4), (901, None, [1.0] * 4)]
    return x, spark.createDataFrame(rows, "vec_id bigint, category string, x array<double>")


def rows_of(df):
    return df.filter("category IN ('a', 'b')").select(F.col("vec_id").alias("id"), F.when(F.col("category") == "a", 0).otherwise(1).alias("g"), "x")


def plain_lloyd(x, at):
    for _ in range(100):
        label = ((x[:, None] - at[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[label == c].mean(0) if (label == c).any() else at[c] for c in range(len(at))])
        if np.sqrt(((new - at) ** 2).sum(1)).max() <= 1e-4:
            return new
        at = new
    return at


def test_centres_are_those_of_each_group_alone(spark, two):
    x, df = two
    starts = [many.Centres(g, "", x[c][[0, 7, 20][:k]]) for g, c in enumerate("ab") for k in (2, 3)]
    for m, s in zip(many.fit_centres(rows_of(df), starts), starts):
        own = x["ab"[m.g]]
        want = plain_lloyd(own, s.at)
        assert np.allclose(m.at, want, atol=1e-3)
        assert m.cost == pytest.approx(((own[:, None] - m.at[None]) ** 2).sum(-1).min(1).sum())


def plain_mixture(x, label, k, rounds):
    p, ridge = np.eye(k)[label], 1e-6
    for _ in range(rounds):
        n = p.sum(0)
        mean = p.T @ x / n[:, None]
        log = np.empty(p.shape)
        for c in range(k):
            cov = (p[:, c, None] * (x - mean[c])).T @ (x - mean[c]) / n[c] + ridge * np.eye(x.shape[1])
            diff = x - mean[c]
            log[:, c] = np.log(n[c] / len(x)) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        p /= p.sum(1, keepdims=True)
    return p


def test_mixtures_equal_the_plain_steps(spark, two):
    x, df = two
    starts = [many.Centres(0, "", x["a"][[0, 7, 20]]), many.Centres(1, "", x["b"][[0, 7]])]
    for m, s in zip(many.fit_mixtures(rows_of(df), starts, rounds=6, tol=-np.inf), starts):
        own = x["ab"[m.g]]
        want = plain_mixture(own, s.labels(own), s.k, 7)
        assert np.allclose(m.membership(own)[0], want, atol=1e-5)


def test_a_mixture_of_fewer_rows_than_columns_is_proper(spark):
    x = blobs(3, 40, 2, 64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, x array<double>")
    got = I.gmm(df, 3).toPandas()
    assert len(got) == 40 and np.allclose([sum(p) for p in got.probability], 1.0)


def test_trees_split_the_widest_cluster(spark, two):
    x, df = two
    trees = {(t.g, t.k): t for t in many.fit_trees(rows_of(df), {0: 4, 1: 2})}
    assert set(trees) == {(0, 2), (0, 3), (0, 4), (1, 2)}
    assert len(set(trees[1, 2].labels(x["b"]))) == 2
    before, after = trees[0, 2].labels(x["a"]), trees[0, 3].labels(x["a"])
    changed = set(before[before != after])
    cost = {c: ((x["a"][before == c] - x["a"][before == c].mean(0)) ** 2).sum() for c in (0, 1)}
    assert len(changed) <= 1 and changed <= {max(cost, key=cost.get)}


def plain_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        s.append((b - a) / max(a, b))
    return np.mean(s)


def test_silhouettes_of_all_labelings(spark, two, monkeypatch):
    monkeypatch.setattr(NB, "BLOCK", 40)
    x, df = two
    models = [many.Centres(0, "", x["a"][:3]), many.Centres(0, "", x["a"][:2]), many.Centres(1, "", x["b"][:4])]
    labelled = many.with_labels(rows_of(df), models)
    got = {(r["g"], r["slot"]): r["silhouette"] for r in many.silhouettes(labelled).collect()}
    want = {(0, 0): plain_silhouette(x["a"], models[0].labels(x["a"])), (0, 1): plain_silhouette(x["a"], models[1].labels(x["a"])), (1, 0): plain_silhouette(x["b"], models[2].labels(x["b"]))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_every_category_is_clustered(spark, two):
    x, df = two
    got = I.cluster_per_category(df, "category").toPandas()
    assert {(c, m) for c, m in zip(got.category, got.method)} == {(c, m) for c in "ab" for m in ("kmeans", "hierarchical", "gmm", "dbscan")}
    assert got.groupby(["category", "method"]).size().to_dict() == {(c, m): len(x[c]) for c in "ab" for m in ("kmeans", "hierarchical", "gmm", "dbscan")}
    for c in "ab":
        found = got[(got.category == c) & (got.method == "dbscan")].sort_values("id").cluster.to_numpy()
        d = np.sqrt(((x[c][:, None] - x[c][None]) ** 2).sum(-1))
        eps = np.percentile(np.sort(d, axis=1)[:, 4], 75)
        assert (found == brute_dbscan(x[c], eps * (1 + 1e-12), 5)).mean() > 0.98


def test_the_balanced_labeling_of_each_category(spark, two):
    _, df = two
    got = {r["category"]: r for r in I.balanced_selection(df, "category", n_init=3).collect()}
    assert got["a"]["candidate"].endswith("-3") and got["b"]["candidate"].endswith("-2") and all(r["silhouette"] > 0.5 for r in got.values())
    assert {r["category"]: r["candidate"] for r in I.balanced_selection(df, "category", n_init=3, measure="squared").collect()}["a"].endswith("-3")
    assert I.balanced_selection(df.filter("category = 'tiny'"), "category").count() == 0
    with pytest.raises(ValueError):
        I.balanced_selection(df, "category", n_init=1, measure="other")


@pytest.mark.parametrize("tau", [0.2, 0.5, 0.75, 1.0])
def test_agreeing_combinations_are_those_of_all_pairs(spark, tau):
    """One method puts nearly all rows into one cluster."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 9)), int(i % 50 == 0), int(rng.integers(0, 4))) for i in range(300)]
    d = spark.createDataFrame(rows, "id bigint, m1 int, m2 int, m3 int, m4 int")
    m = ["m1", "m2", "m3", "m4"]
    want = {(r["sig_a"], r["sig_b"], round(r["share"], 6)) for r in I.coassociation(d, m).filter(F.col("share") >= tau).collect()}
    got = [(r["sig_a"], r["sig_b"], round(r["share"], 6)) for r in I.agreeing(d, m, tau).collect()]
    assert set(got) == want and len(got) == len(want)


def test_silhouettes_of_many_labelings_send_no_row_twice(spark, monkeypatch):
    monkeypatch.setattr(NB, "PACK", 16)
    monkeypatch.setattr(NB, "TURN", 2)
    monkeypatch.setattr(NB, "block_join", None)  # which sends a row to all tasks that compare it
    rng = np.random.default_rng(8)
    x, g = rng.normal(0, 1, (110, 3)), np.arange(110) % 2
    labels = np.c_[np.arange(110) % 3, np.arange(110) % 7 // 3]
    labelled = spark.createDataFrame([(int(g[i]), i, x[i].tolist(), labels[i].tolist()) for i in range(110)], "g int, id bigint, x array<double>, labels array<int>")
    got = {(r["g"], r["slot"]): r["silhouette"] for r in many.silhouettes(labelled).collect()}
    assert len(got) == 4
    for (cell, slot), value in got.items():
        p, lab = x[g == cell], labels[g == cell, slot]
        d, s = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), []
        for i in range(len(p)):
            a = d[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
            b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
            s.append((b - a) / max(a, b))
        assert abs(value - np.mean(s)) < 1e-9


def test_density_per_group_searches_neighbours_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, i % 2, [float(v) for v in rng.normal(size=3)]) for i in range(80)], "id bigint, g int, x array<double>")
    want = sorted(tuple(r) for r in I.dbscan_per_group(rows).collect())
    seen, search = spark.sparkContext.accumulator(0), I.knn

    def counted(*args, **more):
        def run(it):
            for p in it:
                seen.add(len(p))
                yield p

        found = search(*args, **more)
        return found.mapInPandas(run, found.schema)

    monkeypatch.setattr(I, "knn", counted)
    assert sorted(tuple(r) for r in I.dbscan_per_group(rows).collect()) == want
    assert seen.value == 80 * 5


def test_scans_read_rows_dealt_over_all_cores(spark, two, monkeypatch):
    """One partition of rows, as Spark makes of few bytes: its scans ran in that one task."""
    monkeypatch.setattr(many, "LEAST", 64)
    monkeypatch.setattr(many, "SCAN", 16)
    x, df = two
    rows, seen = rows_of(df).coalesce(1), spark.sparkContext.accumulator(0)
    blocks = many.stored(rows)
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.stored(blocks) is blocks
    got = {r["g"]: r["n"] for r in blocks.groupBy("g").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("most <= 16").collect()}
    assert got == {0: len(x["a"]), 1: len(x["b"])}
    starts = [many.Centres(g, "", x[c][[0, 7]]) for g, c in enumerate("ab")]
    scan = many.scan_sums

    def counted(d, task):
        def run(it):
            seen.add(1)
            yield from it

        return scan(d.mapInArrow(run, d.schema), task)

    monkeypatch.setattr(many, "scan_sums", counted)
    many.fit_centres(rows, starts, rounds=1)
    assert seen.value == 2 * blocks.rdd.getNumPartitions()


def test_balanced_selection_compares_rows_of_balanced_labelings_only(spark, two, monkeypatch):
    _, df = two
    asked, score = [], I._silhouettes
    monkeypatch.setattr(I, "_silhouettes", lambda labelled, measure, wanted=None: asked.append((labelled, wanted)) or score(labelled, measure, wanted))
    got = {r["category"]: r["silhouette"] for r in I.balanced_selection(df, "category", n_init=2).collect()}
    (labelled, wanted), = asked
    n = {}
    for r in many.sizes(labelled).collect():
        n.setdefault((r["g"], r["slot"]), []).append(r["n"])
    assert wanted == {at for at, m in n.items() if min(m) / sum(m) >= 0.15} and 0 < len(wanted) < len(n)
    every = {(r["g"], r["slot"]): r["silhouette"] for r in many.silhouettes(labelled).collect()}
    some = {(r["g"], r["slot"]): r["silhouette"] for r in many.silhouettes(labelled, wanted).collect()}
    assert some.keys() == wanted and all(some[at] == pytest.approx(every[at], abs=1e-12) for at in wanted)
    assert got == pytest.approx({c: max(s for (g, _), s in some.items() if g == i) for i, c in enumerate("ab")})


def test_partial_silhouettes_are_one_matrix_for_a_slab(spark, monkeypatch):
    """Partial sums were a row for each row, labeling and cluster."""
    rng = np.random.default_rng(9)
    labels = np.c_[np.arange(300) % 3, np.arange(300) % 4]
    labelled = spark.createDataFrame([(0, i, rng.normal(0, 1, 3).tolist(), labels[i].tolist()) for i in range(300)], "g int, id bigint, x array<double>, labels array<int>")
    sent, against = [], many.against_all
    monkeypatch.setattr(many, "against_all", lambda *a: sent.append(against(*a)) or sent[-1])
    assert many.silhouettes(labelled).count() == 2
    assert sent[0].count() == 1 and sent[0].first()["s"] is not None


def test_silhouettes_compare_copies_once(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (40, 3)).repeat(rng.integers(1, 9, 40), axis=0)
    labels = np.c_[np.arange(len(x)) % 3, (x[:, 0] > 0).astype(int)]  # copies may be in different clusters
    labelled = spark.createDataFrame([(0, i, x[i].tolist(), labels[i].tolist()) for i in range(len(x))], "g int, id bigint, x array<double>, labels array<int>").repartition(3)
    met, against = [], many.against_all
    monkeypatch.setattr(many, "against_all", lambda d, *a: met.append(d.count()) or against(d, *a))
    got = {r["slot"]: r["silhouette"] for r in many.silhouettes(labelled).collect()}
    assert met == [len({(*v, *l) for v, l in zip(x.tolist(), labels.tolist())})] and met[0] < len(x)
    assert all(got[i] == pytest.approx(plain_silhouette(x, labels[:, i]), abs=1e-9) for i in range(2))
