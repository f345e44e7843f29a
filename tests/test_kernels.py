"""Independent numpy or brute-force references on small data."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultspark.functions.parallel import scan_parts
from faultspark.operators import anomaly as A, attribution as K, cluster_metrics as J, kernels as N, matrix as M, models as G, neighbours as NB, proposals as P, series as S
from faultspark.plans import anomaly as plans, load_all
from faultspark.plans.registry import Tables
from tests.conftest import FOLDER


def frame(spark, columns):
    return spark.createDataFrame(pd.DataFrame([(s, i, float(v)) for s, x in columns.items() for i, v in enumerate(x)], columns=["series_id", "idx", "value"]), "series_id bigint, idx bigint, value double")


def series(n, seed=0, count=3):
    rng = np.random.default_rng(seed)
    return {k: rng.standard_normal(n + 7 * k).cumsum() for k in range(count)}


def brute_peaks(x, p):
    n, total, i = len(x), 0, 1
    while i < n - 1:
        j = i
        if x[i] > x[i - 1]:
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                h, left, right = x[i], x[i], x[i]
                k = i
                while k >= 0 and x[k] <= h:
                    left, k = min(left, x[k]), k - 1
                k = i
                while k < n and x[k] <= h:
                    right, k = min(right, x[k]), k + 1
                total += h - max(left, right) >= p
        i = j + 1
    return total


def test_peak_summaries_merge_to_the_exact_count():
    rng = random.Random(3)
    for _ in range(800):
        n, length, p = rng.randint(1, 400), rng.choice([1, 7, 40, 120]), rng.choice([0.5, 1, 2])
        x = [float(rng.randint(0, 6)) for _ in range(n)] if rng.random() < 0.5 else [rng.random() * 4 for _ in range(n)]
        parts = [N._summary(x[s:s + length], [1] * len(x[s:s + length]), p) for s in range(0, n, length)]
        v, m = sum((q[0] for q in parts), []), sum((q[1] for q in parts), [])
        v, m, c = N._summary(v, m, p)
        assert c + sum(q[2] for q in parts) + N._finish(v, m, p) == brute_peaks(x, p)


def test_peak_count_does_not_depend_on_chunks(spark, tiny_chunks):
    data = series(700)
    got = {r[0]: r[1] for r in N.peak_count(frame(spark, data), 0.5).collect()}
    assert got == {k: brute_peaks(list(x), 0.5) for k, x in data.items()}


def test_peaks_by_distance(spark, tiny_chunks):
    data = series(300, 4)
    got = {}
    for r in N.peaks_by_distance(frame(spark, data), 10).collect():
        got.setdefault(r["series_id"], set()).add(r["idx"])
    for k, x in data.items():
        peaks = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] > x[i + 1]]
        keep = {i: True for i in peaks}
        for i in sorted(peaks, key=lambda i: (x[i], i), reverse=True):
            if keep[i]:
                for j in peaks:
                    if j != i and abs(j - i) < 10:
                        keep[j] = False
        assert got[k] == {i for i in peaks if keep[i]}


def recursion(sections, x):
    for b, a in sections:
        y = np.zeros(len(x))
        for i in range(len(x)):
            y[i] = sum(b[j] * x[i - j] for j in range(len(b)) if i >= j) - sum(a[j] * y[i - j] for j in range(1, len(a)) if i >= j)
        x = y
    return x


def test_highpass_equals_the_recursion(spark, tiny_chunks):
    data = series(500)
    data[9] = np.arange(10.0)
    sections = N.butterworth_highpass(4, 0.2)
    got = N.highpass(frame(spark, data), 0.2).toPandas()
    for k, x in data.items():
        y = got[got.series_id == k].sort_values("idx").filtered.to_numpy()
        assert np.allclose(y, recursion(sections, x) if len(x) > 10 else x, atol=1e-9)


def test_a_recurrence_runs_in_pieces():
    rng = np.random.default_rng(3)
    for order, cutoff in ((1, 0.01), (2, 0.3), (4, 0.01), (5, 0.2)):
        sections = N.butterworth_highpass(order, cutoff)
        system = N.Recurrence.of(sections)
        for n in (0, 1, 63, 64, 65, 700):
            x = 50 + rng.normal(0, 3, n)
            want = recursion(sections, x)
            assert np.allclose(system.run(x)[0], want, atol=1e-9)
            state, got = None, []
            for part in np.array_split(x, 5):
                y, state = system.run(part, state)
                got.append(y)
            assert np.allclose(np.concatenate(got), want, atol=1e-9)


def test_turning_points_change_no_summary():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 400):
        x = rng.integers(0, 6, n).astype(float)
        assert N._extrema(N.turning_points(x).tolist(), [1] * len(N.turning_points(x))) == N._extrema(x.tolist(), [1] * n)


def test_a_users_kernel_does_not_depend_on_chunks(spark, tiny_chunks, monkeypatch):
    monkeypatch.setattr(N, "FAN_IN", 3)
    data = series(400, 6) | {7: np.ones(90), 8: -np.ones(40)}
    got = {r[0]: (r["longest"], r["n_runs"]) for r in N.run_series_kernel(frame(spark, data), N.longest_run(0.0)).collect()}
    for k, x in data.items():
        runs = [len(r) for r in "".join("u" if v > 0 else " " for v in x).split()]
        assert got[k] == (max(runs, default=0), len(runs))


def test_butterworth_gain():
    for order in (1, 4):
        for cutoff in (0.01, 0.2):
            def gain(f):
                z = np.exp(-1j * np.pi * f * np.arange(3))
                return abs(np.prod([(b @ z[: len(b)]) / (a @ z[: len(a)]) for b, a in N.butterworth_highpass(order, cutoff)]))
            assert gain(0.0) < 1e-12 and gain(cutoff) == pytest.approx(math.sqrt(0.5)) and gain(1.0) == pytest.approx(1.0)


def test_zero_phase_filter(spark, tiny_chunks):
    data = series(400, 5)
    got = N.highpass_zero_phase(frame(spark, data), 0.1).toPandas()
    sections = N.butterworth_highpass(1, 0.1)
    for k, x in data.items():
        e = np.r_[2 * x[0] - x[6:0:-1], x, 2 * x[-1] - x[-2:-8:-1]]
        f = recursion(sections, e - e[0])[::-1]
        b = recursion(sections, f - f[0])[::-1][6:-6]
        assert np.allclose(got[got.series_id == k].sort_values("idx").filtered.to_numpy(), b, atol=1e-9)


def test_spectrum_of_a_sine():
    t = np.arange(1000) / 1000.0
    mag = np.abs(np.fft.rfft(np.sin(2 * np.pi * 50 * t)))
    f, band, q = N.spectrum(mag, np.fft.rfftfreq(1000, 1e-3))
    assert f == 50 and band == pytest.approx(250000, rel=1e-6) and q == pytest.approx(25)


def test_long_recordings_use_the_distributed_transform(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = {k: 2 * np.sin(np.arange(n) * 0.7) + 0.3 * rng.standard_normal(n) for k, n in ((0, 211), (1, 150), (2, 90))}
    s = frame(spark, data).withColumn("value", F.col("value") / 2)
    t = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).select("series_id", (F.col("n") - 5).alias("z"), "n", F.lit(2000.0).alias("dt_us"))
    whole = N.spectral_features(s, t, 50).orderBy("series_id").toPandas()
    monkeypatch.setattr(N, "ONE_TASK_SAMPLES", 100)
    split = N.spectral_features(s, t, 50).orderBy("series_id").toPandas()
    assert np.allclose(whole.to_numpy(), split.to_numpy(), rtol=1e-8) and (whole.dominant_hz > 40).all()


def test_unwrap_and_page_cusum_equal_numpy(spark, tiny_chunks):
    rng = np.random.default_rng(1)
    data = {k: rng.uniform(-math.pi, math.pi, 200) for k in range(3)}
    u = S.unwrap_phase(frame(spark, data)).toPandas()
    c = {r[0]: r[1] for r in S.cusum_page(frame(spark, data), baseline=60).collect()}
    for k, x in data.items():
        assert np.allclose(u[u.series_id == k].sort_values("idx").phase, np.unwrap(x))
        s = best = 0.0
        mu, sd = x[:60].mean(), x[:60].std()
        for v in x[1:]:
            s = max(0.0, s + v - mu - sd / 2)
            best = max(best, s)
        assert c[k] == pytest.approx(best)


# ---- vectors ---------------------------------------------------------------------------

def points(spark, n=300, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.r_[rng.normal(0, 1, (n // 2, d)), rng.normal(6, 1, (n - n // 2 - 10, d)), np.repeat(rng.normal(3, 1, (1, d)), 10, axis=0)]
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, x array<double>")


def small_leaves(monkeypatch, leaf=12, block=24, deal=64):
    for name, value in (("LEAF", leaf), ("BLOCK", block), ("DEAL", deal)):
        monkeypatch.setattr(NB, name, value)


@pytest.mark.parametrize("own", [True, False])
def test_knn_with_a_tree_is_exact(spark, monkeypatch, own):
    small_leaves(monkeypatch)
    x, df = points(spark)
    got = NB.knn(df, df, 4, exclude_self=own).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    if own:
        np.fill_diagonal(d, np.inf)
    assert len(got) == 4 * len(x)
    want = np.sort(d, axis=1)[:, :4]
    have = got.sort_values(["id", "rank"]).dist.to_numpy().reshape(-1, 4)
    assert np.allclose(have, want)


def test_knn_where_nine_in_ten_points_are_equal(spark, monkeypatch):
    """Ids of ties are the smallest, and no leaf holds the group."""
    small_leaves(monkeypatch)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(0, 1, (1, 3)), 400, axis=0)
    other = rng.permutation(400)[:40]
    x[other] = rng.normal(0, 1, (40, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, x array<double>")
    for own in (True, False):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        if own:
            np.fill_diagonal(d, np.inf)
        want = [(i, int(j), r + 1) for i in range(400) for r, j in enumerate(np.lexsort((np.arange(400), d[i].round(9)))[:5])]
        got = sorted((r["id"], r["nid"], r["rank"]) for r in NB.knn(df, df, 5, exclude_self=own).collect())
        assert got == sorted(want)
    tree = NB.plant(NB.knn(df, df, 1).select("id").join(df.withColumnRenamed("vec_id", "id"), "id").dropDuplicates(["x"]), "id", "x")
    assert tree.points.groupBy("top", "sub").count().agg(F.max("count")).first()[0] <= 41 and len(tree.tops) > 1
    label = A.dbscan(df, 0.3, 5).orderBy("id").toPandas().cluster.to_numpy()
    assert (label == brute_dbscan(x, 0.3, 5)).all()


def stored_blocks(monkeypatch):
    """Many blocks, and several runs of them, of few rows; counts the queries that are dealt out to leaves."""
    dealt, reached = [], NB.reached_leaves
    for name, value in (("PACK", 24), ("TURN", 2), ("SLAB", 10), ("VISITS", 2), ("PROBES", 20)):
        monkeypatch.setattr(NB, name, value)
    monkeypatch.setattr(NB, "reached_leaves", lambda queries, tree: dealt.append(queries.count()) or reached(queries, tree))
    return dealt


@pytest.mark.parametrize("own", [True, False])
def test_knn_in_high_dimension_deals_out_no_queries(spark, monkeypatch, own):
    small_leaves(monkeypatch)
    dealt = stored_blocks(monkeypatch)
    x, df = points(spark, 200, 20)
    x[150:] = x[:50]  # copies in other blocks
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, x array<double>")
    got = NB.knn(df, df, 4, exclude_self=own).toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    if own:
        np.fill_diagonal(d, np.inf)
    want = np.array([np.lexsort((np.arange(200), row.round(9)))[:4] for row in d])
    assert (got.nid.to_numpy().reshape(-1, 4) == want).all()
    assert np.allclose(got.dist.to_numpy().reshape(-1, 4), np.take_along_axis(d, want, 1))
    assert max(dealt) <= 20


def test_knn_looks_into_one_block_of_a_leaf_first(spark, monkeypatch):
    """Leaves of many blocks cost no copies, and their other blocks are not forgotten."""
    small_leaves(monkeypatch, 48, 4, 500)
    seen, made = spark.sparkContext.accumulator(0), NB._topk_task

    def counted(*args):
        task = made(*args)
        return lambda a, b: seen.add(len(a) + len(b)) or task(a, b)

    monkeypatch.setattr(NB, "_topk_task", counted)
    monkeypatch.setattr(NB, "VISIT_SHARE", 0.0)
    x, df = points(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.array([np.lexsort((np.arange(len(x)), row.round(9)))[:4] for row in d])
    for visits in (0, 10**6):
        monkeypatch.setattr(NB, "VISITS", visits)
        got = NB.knn(df, df, 4, exclude_self=True).toPandas().sort_values(["id", "rank"])
        assert (got.nid.to_numpy().reshape(-1, 4) == want).all()
        assert visits or seen.value <= 3 * len(x)


def test_dbscan_in_high_dimension_deals_out_no_queries(spark, monkeypatch):
    small_leaves(monkeypatch)
    dealt = stored_blocks(monkeypatch)
    x, df = points(spark, 200, 12)
    eps = float(np.quantile(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 0.06))
    got = A.dbscan(df, eps, 5).orderBy("id").toPandas()
    want = brute_dbscan(x, eps, 5)
    assert (got.cluster.to_numpy() == want).all() and want.max() >= 0 and want.min() < 0
    assert max(dealt) <= 20


def test_screen_leaves_out_no_close_pair():
    rng = np.random.default_rng(5)
    for shift, size in ((0.0, 1.0), (1e4, 1.0), (0.0, 1e-30), (0.0, 1e30), (3.0, 1e-3)):
        x, y = (shift + size * rng.normal(0, 1, (40, 9)) for _ in range(2))
        d = ((x[:, None] - y[None]) ** 2).sum(-1)
        limit = np.sort(d, axis=1)[:, 6]
        near = NB.screen(x, y, limit)
        assert near[d <= limit[:, None]].all()


def test_neighbours_of_nothing(spark):
    _, df = points(spark, 60)
    none = df.filter("vec_id < 0")
    assert NB.knn(df, none, 3).count() == 0 and NB.knn(none, df, 3).count() == 0 and NB.knn_approx(df, none, 3).count() == 0
    assert NB.knn(df.limit(7), df.limit(2), 5).count() == 14  # fewer points than asked for
    assert set(A.dbscan(df, 1e-6, 50).toPandas().cluster) == {-1}


@pytest.mark.parametrize("d", [4, 24])
def test_hash_tables_find_nine_in_ten_neighbours(spark, monkeypatch, d):
    monkeypatch.setattr(NB, "LEAF", 64)  # keys of several parts
    rng = np.random.default_rng(d)
    centre = rng.normal(0, 4, (20, d))
    x = centre[rng.integers(0, 20, 1500)] + rng.normal(0, 0.5, (1500, d))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, x array<double>")
    exact = {(r["id"], r["nid"]): r["dist"] for r in NB.knn(df, df, 6, exclude_self=True).collect()}
    got = {(r["id"], r["nid"]): r["dist"] for r in NB.knn_approx(df, df, 6, exclude_self=True).collect()}
    both = exact.keys() & got.keys()
    assert len(both) >= 0.9 * len(exact) and all(abs(exact[p] - got[p]) < 1e-9 for p in both)


def test_odds_of_a_shared_key():
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, (4000, 8))
    b = a + 0.7 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(0, 1, (4000, 8)))
    shared = np.mean([len(set(NB.Tables(rng.standard_normal((1, 1, 8)), rng.uniform(0, 1.5, (1, 1)), 1.5).keys(np.stack(pair))[:, 0].tolist())) == 1 for pair in zip(a, b)])
    assert shared == pytest.approx(NB.collision(0.7, 1.5), abs=0.03)


def brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= m
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], c
            while stack:
                for j in np.nonzero(d[stack.pop()] & core)[0]:
                    if label[j] < 0:
                        label[j] = c
                        stack.append(j)
            c += 1
    for i in np.nonzero(~core)[0]:
        near = label[np.nonzero(d[i] & core)[0]]
        label[i] = near.min() if len(near) else -1
    return label


@pytest.mark.parametrize("leaf", [12, 2048])
def test_dbscan_equals_brute_force(spark, monkeypatch, leaf):
    small_leaves(monkeypatch, leaf, leaf)
    x, df = points(spark, 200, 3, 2)
    got = A.dbscan(df, 0.9, 5).orderBy("id").toPandas()
    assert (got.cluster.to_numpy() == brute_dbscan(x, 0.9, 5)).all()


def test_silhouettes_of_all_rows_send_no_row_twice(spark, monkeypatch):
    monkeypatch.setattr(NB, "PACK", 16)
    monkeypatch.setattr(NB, "TURN", 2)
    monkeypatch.setattr(NB, "block_join", None)  # which sends a row to all tasks that compare it
    x, df = points(spark, 100, 3)
    found = J.silhouette_rows(df.withColumn("cluster", F.col("vec_id") % 3)).orderBy("id").toPandas().silhouette.to_numpy()
    d, lab = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), np.arange(len(x)) % 3
    for i in range(len(x)):
        a = d[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        assert found[i] == pytest.approx((b - a) / max(a, b))


def test_silhouettes(spark, monkeypatch):
    monkeypatch.setattr(NB, "BLOCK", 32)
    x, df = points(spark, 120)
    lab = np.arange(len(x)) % 3
    lab[5] = 7
    df = df.withColumn("cluster", F.when(F.col("vec_id") == 5, 7).otherwise(F.col("vec_id") % 3))
    for power, fn in ((1, J.silhouette), (2, J.silhouette_squared)):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** power
        s = []
        for i in range(len(x)):
            own = lab == lab[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a = d[i, own].sum() / (own.sum() - 1)
            b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
            s.append((b - a) / max(a, b))
        assert fn(df).first()[0] == pytest.approx(np.mean(s), abs=1e-9)


def test_pca_and_reconstruction(spark):
    x, df = points(spark)
    m = M.pca(df, variance=0.95)
    val, vec = np.linalg.eigh(np.cov(x.T))
    ratio = val[::-1] / val.sum()
    assert m.k == int(np.searchsorted(ratio.cumsum(), 0.95) + 1)
    back = np.array([r[0] for r in m.project(df, reconstruct="b").orderBy("vec_id").select("b").collect()])
    v = vec[:, ::-1][:, : m.k]
    assert np.allclose(back, (x - x.mean(0)) @ v @ v.T + x.mean(0))


def test_shrunk_mahalanobis_equals_full_matrix_form(spark):
    x, df = points(spark)
    got = np.array([r[0] for r in A.mahalanobis_lw(df, df).orderBy("vec_id").select("score").collect()])
    c = x - x.mean(0)
    n, p = c.shape
    s = c.T @ c / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum()
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2, d2)
    cov = (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c))


def test_chi2_quantile():
    assert A.chi2_quantile(0.95, 1) == pytest.approx(3.841458821, abs=1e-6)
    assert A.chi2_quantile(0.95, 30) == pytest.approx(43.77297, abs=1e-4)


def test_isolation_forest_ranks_a_far_point_first_and_is_repeatable(spark):
    x, df = points(spark)
    far = df.unionByName(spark.createDataFrame([(9999, [40.0] * 4)], df.schema))
    a = A.isolation_forest(far, far, trees=40).orderBy(F.desc("score")).select("vec_id", "score").collect()
    b = A.isolation_forest(far.repartition(5), far, trees=40).orderBy(F.desc("score")).select("vec_id", "score").collect()
    assert a[0][0] == 9999 and a == b


def test_shapley_values_add_up_and_match_the_linear_form(spark):
    x, df = points(spark, 40)
    w = [1.0, -2.0, 0.5, 3.0]

    def score(d):
        return d.withColumn("score", F.aggregate(F.zip_with("x", F.array(*[F.lit(v) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))

    got = K.sampled_shapley(df, score, [0.5] * 4, "vec_id", n_perm=2).toPandas().pivot(index="id", columns="feature", values="value").to_numpy()
    assert np.allclose(got, (x - 0.5) * np.array(w))


def test_local_surrogate_finds_a_linear_model(spark):
    _, df = points(spark, 40)
    score = lambda d: d.withColumn("score", F.get("x", F.lit(0)) * 2 - F.get("x", F.lit(3)))
    got = K.local_surrogate(df, score, [1.0] * 4, "vec_id", n=400, ridge=1e-6).toPandas()
    assert np.allclose(got[got.feature == 0].value, 2, atol=1e-3) and np.allclose(got[got.feature == 3].value, -1, atol=1e-3)


def test_granger_statistic(spark, tiny_chunks):
    rng = np.random.default_rng(0)
    b = rng.standard_normal(300)
    a = np.zeros(300)
    for i in range(2, 300):
        a[i] = 0.4 * a[i - 1] + 0.8 * b[i - 2] + 0.1 * rng.standard_normal()
    df = spark.createDataFrame([(0, i, float(a[i]), float(b[i])) for i in range(300)], "series_id int, idx bigint, a double, b double")
    got = P.granger(df, 2, 2).first()
    y = a[2:]
    r = np.c_[np.ones(298), a[1:-1], a[:-2]]
    u = np.c_[r, b[1:-1], b[:-2]]
    rss = [((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum() for m in (r, u)]
    assert got["f"] == pytest.approx(((rss[0] - rss[1]) / 2) / (rss[1] / (298 - 5)), rel=1e-6)


def test_smote_points_lie_between_neighbours(spark):
    x, df = points(spark, 60)
    d = df.withColumn("label", (F.col("vec_id") < 30).cast("int"))
    rows = P.smote(d, "label", 1, 2).collect()
    assert len(rows) == 60
    for r in rows:
        assert np.allclose(r["x"], x[r["id"]] + r["u"] * (x[r["nid"]] - x[r["id"]])) and r["id"] < 30 and r["nid"] < 30


def test_chain_and_powerset_predict_every_row(spark):
    x, df = points(spark, 120)
    d = df.withColumn("a", (F.get("x", F.lit(0)) > 3).cast("int")).withColumn("b", (F.get("x", F.lit(1)) > 3).cast("int"))
    fit = lambda tr, l, **kw: G.fit_forest(tr, l, trees=10, depth=4, **kw)
    for m in (G.fit_classifier_chain(d, ["a", "b"], fit, order=[1, 0]), G.fit_label_powerset(d, ["a", "b"], fit=fit), G.fit_binary_relevance(d, ["a", "b"], fit)):
        p = m(d).toPandas()
        assert len(p) == len(x) and (p.a == p.pred_a).mean() > 0.95 and (p.b == p.pred_b).mean() > 0.95


def test_fits_read_as_many_partitions_as_their_rows_need(spark, monkeypatch):
    x, df = points(spark, 120)
    seen = []
    fake = type("Fake", (), {"fit": lambda self, d: seen.append((d.rdd.getNumPartitions(), d.count())) or "model"})()
    many = df.repartition(60)
    assert G._fit(fake, many, "x") == "model"
    # small partitions, over all cores; then so many values that a partition would hold too many of them
    for least, most in ((16, 1 << 22), (16, len(x) * x.shape[1] // 20)):
        monkeypatch.setattr(G, "scan_parts", lambda d, vec, a=least, b=most: scan_parts(d, vec, a, b))
        G._fit(fake, many, "x")
    assert seen == [(1, len(x)), (8, len(x)), (20, len(x))]


def test_kernels_over_many_small_series_share_batches(spark, tiny_chunks):
    # a null and a NaN key are groups of their own; a series crosses batches
    rows = [(k, i, float((i * 7 + s) % 5 - 2)) for s, k in enumerate([None, float("nan"), *map(float, range(300))]) for i in range(1 + s % 40)]
    df = spark.createDataFrame(rows, "series_id double, idx bigint, value double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {repr(r[0]): (r["longest"], r["n_runs"]) for r in N.run_series_kernel(df, N.longest_run(0.0)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {repr(k) for k, _, _ in rows}:
        up = "".join("x" if v > 0 else " " for k, _, v in rows if repr(k) == key).split()
        want[key] = (max(map(len, up), default=0), len(up))
    assert got == want
    plan = N.run_series_kernel(df, N.longest_run(0.0))._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan  # one call of Python for each series cost some 10 ms


def test_approximate_neighbours_read_blocks_where_tables_are_many(spark, monkeypatch):
    monkeypatch.setattr(NB, "VISITS", 0)
    monkeypatch.setattr(NB, "VISIT_SHARE", 0.0)
    x = np.random.default_rng(5).uniform(size=(1500, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, x array<double>")
    got = {(r["id"], r["rank"]): r["nid"] for r in NB.knn_approx(df.filter("vec_id % 10 = 0"), df, 4, exclude_self=True, recall=0.5).collect()}
    d = np.sqrt(((x[::10, None] - x[None]) ** 2).sum(2))
    d[np.arange(150), np.arange(0, 1500, 10)] = np.inf
    want = d.argsort(axis=1)[:, :4]
    assert got == {(10 * i, r + 1): int(want[i, r]) for i in range(150) for r in range(4)}


def test_filters_peaks_and_spectra_share_batches(spark):
    # one call of Python for each series cost some 10 ms; a null and a NaN key are series of their own, and series cross batches
    rng = np.random.default_rng(6)
    x = {k: rng.standard_normal(1 + i % 40).cumsum() for i, k in enumerate([None, float("nan"), *map(float, range(60))])}
    df = spark.createDataFrame([(k, i, float(v)) for k, s in x.items() for i, v in enumerate(s)], "series_id double, idx bigint, value double").repartition(5)
    system = N.Recurrence.of(N.butterworth_highpass(4, 0.01))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        filtered, peaks = (f(df).toPandas() for f in (N.highpass, N.peak_count))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(peaks) == len(x) and len(filtered) == sum(map(len, x.values()))
    for k in range(60):
        s, got = x[float(k)], filtered[filtered.series_id == k].sort_values("idx")
        assert np.allclose(got.filtered, s if len(s) <= 10 else system.run(s)[0]) and got.idx.tolist() == list(range(len(s)))
        assert peaks[peaks.series_id == k].n_peaks.tolist() == [brute_peaks(s, 0.5)]
    trigger = df.groupBy("series_id").agg(F.lit(3).alias("z"), F.count(F.lit(1)).alias("n"), F.lit(1.0).alias("dt_us"))
    for d in (N.highpass(df), N.peak_count(df), N.spectral_features(df, trigger, 1)):
        plan = d._jdf.queryExecution().toString()
        assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan


@pytest.mark.parametrize("leaf", [16, 4096])
def test_dbscan_of_known_neighbours_searches_only_among_full_points(spark, monkeypatch, leaf):
    monkeypatch.setattr(NB, "LEAF", leaf)
    x, _ = points(spark, 240, 2, 2)
    x = np.concatenate([x, x[:9].repeat(7, axis=0), x.max(0) + 9 + np.zeros((6, 2))])  # more copies than neighbours are known
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, x array<double>")
    near = NB.knn(df, df, 6).cache()
    searched, find = [], A._linked
    monkeypatch.setattr(A, "_linked", lambda d, eps: searched.append(d.count()) or find(d, eps))
    for eps in (0.2, 0.5, 0.9):
        got = A.dbscan_of_near(df, near, eps, 5).orderBy("id").toPandas()
        assert (got.cluster.to_numpy() == brute_dbscan(x, eps, 5)).all()
        n = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps).sum(1)
        assert got.core.tolist() == (n >= 5).tolist()
        assert searched[-1] == len({tuple(v) for v in x[n >= 6].tolist()})
    near.unpersist()


def test_density_queries_search_once(spark, monkeypatch):
    """All neighbours were searched for the radius, for the counts and for the links."""
    t, seen = Tables(spark, FOLDER), []
    for m, f in ((plans, "knn"), (A, "knn"), (A, "within")):
        monkeypatch.setattr(m, f, lambda *a, f=f, g=getattr(m, f), **k: seen.append((f, a[0].count())) or g(*a, **k))
    n = t.embeddings.count()
    load_all()["dbscan_cores"].build(t).collect()
    assert seen == [("knn", n)]
    load_all()["dbscan"].build(t).collect()
    assert [f for f, _ in seen[1:]] == ["knn", "within"] and seen[2][1] < n
