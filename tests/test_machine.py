"""The event state machine agrees with the batch kernel, over late, shuffled and repeated samples."""

import math

import numpy as np
import pandas as pd
import pytest

from faultspark.operators.kernels import longest_run, run_series_kernel
from faultspark.streaming import machine as M, streams as N
from tests.test_streams import at, stream

SCHEMA = "event bigint, ts timestamp, idx bigint, value double, post int, expected bigint"
ROCKS = {M.STORE: M.ROCKS}


@pytest.fixture
def chunks_of_four(spark):
    spark.conf.set("faultspark.seriesChunk", "4")
    yield
    spark.conf.unset("faultspark.seriesChunk")


def recording(event, n, seed, expected=None):
    rng = np.random.default_rng(seed)
    return [(event, at(i), i, float(x), int(i >= n // 2), expected or n) for i, x in enumerate(rng.normal(size=n).round(3))]


def machine(spark, files, kernel, **more):
    return N.drain(M.stream_series_kernel(stream(spark, files, SCHEMA), kernel, "event", "ts", "1 hour", **more), ROCKS)


def test_complete_events_equal_the_batch_kernel(spark, chunks_of_four):
    rows = [r for e, n in ((1, 23), (2, 4), (3, 1), (4, 9)) for r in recording(e, n, e)]
    rows[5] = (*rows[5][:3], None, *rows[5][4:])  # a null value is an arrived sample
    files = [rows[k::5] for k in (3, 0, 4, 1, 2)]  # late and shuffled
    files[4] = files[4] + files[4][:3] + [(None, at(1), 0, 1.0, 0, 1), (9, at(1), None, 1.0, 0, 1)]
    got = {r["event"]: tuple(r)[1:] for r in machine(spark, files, M.trigger_features(), extra=["post"]).collect()}
    sides = {}
    for r in rows:
        sides.setdefault(r[0], []).append(r)
    assert set(got) == set(sides)
    for e, all_rows in sides.items():
        row = dict(zip([f.split()[0] for f in M.trigger_features().out.split(",")] + ["n_samples", "complete"], got[e]))
        assert row["n_samples"] == len(all_rows) and row["complete"]
        for side, flag in (("pre", 0), ("post", 1)):
            pairs = [(r[2], r[3]) for r in all_rows if r[4] == flag and r[3] is not None]
            assert row[f"n_{side}"] == len(pairs)
            if not pairs:
                assert row[f"mean_{side}"] is None and row[f"slope_{side}"] is None
                continue
            i, v = (np.array(c, float) for c in zip(*pairs))
            slope = np.polyfit(i, v, 1)[0] if len(v) > 1 else 0.0
            want = (v.mean(), v.std(), v.min(), v.max(), np.sqrt((v * v).mean()), slope, np.abs(np.diff(v)).max(initial=0.0))
            assert np.allclose([row[f"{c}_{side}"] for c in ("mean", "std", "min", "max", "rms", "slope", "max_step")], want, atol=1e-9)
            assert row[f"zero_crossings_{side}"] == int((np.sign(v[1:]) != np.sign(v[:-1])).sum())


def test_any_kernel_runs_on_a_stream(spark, chunks_of_four):
    rows = [r for e, n in ((1, 30), (2, 7)) for r in recording(e, n, e + 10)]
    got = sorted(tuple(r) for r in machine(spark, [rows[1::2], rows[::2]], longest_run(0.2)).select("event", "longest", "n_runs").collect())
    batch = spark.createDataFrame(rows, SCHEMA)
    assert got == sorted(tuple(r) for r in run_series_kernel(batch, longest_run(0.2), ["event"]).collect())


def test_incomplete_events_are_sent_after_their_patience(spark, chunks_of_four):
    short = recording(1, 6, 1, expected=10)
    clock = [[(5, at(60 * h), 0, 1.0, 0, 1)] for h in (6, 9, 12)]
    got = {(r["event"], r["complete"]): r for r in machine(spark, [short[:3], short[3:], *clock], M.trigger_features(), extra=["post"]).collect()}
    r = got[1, False]
    want = [s[3] for s in short]
    assert r["n_samples"] == 6 and (1, True) not in got and r["n_pre"] + r["n_post"] == 6
    assert math.isclose(min(r["min_pre"], r["min_post"]), min(want))


def test_no_rows_give_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run_series_kernel(empty, M.trigger_features(), ["event"]).columns[0] == "event"
    assert machine(spark, [[]], M.trigger_features(), extra=["post"]).count() == 0


class Stored:
    """State and timers of one key, without Spark."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], set()

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else self.rows or None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.rows = None, []

    def appendList(self, rows):
        self.rows += rows

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("expected, signs", [(6, 0), (60, 1)])
def test_only_events_of_several_chunks_send_signs_of_life(expected, signs):
    store = Stored()
    step = M._Chunks(M.trigger_features(), 10, 1000, "event", ["idx", "value", "post"], "")
    step.init(store)
    pdf = pd.DataFrame({"idx": [0, 1], "value": [1.5, None], "post": [0, 1], "expected__": expected, "ms__": [5, 9]})
    assert len(list(step.handleInputRows((1, 0), iter([pdf]), store))) == signs
    assert store.value == (2, 0, 9, 1009, expected) and store.rows == [(0, 1.5, 0), (1, None, 1)] and store.timers == {1009}


def test_incomplete_events_of_one_chunk_are_sent(spark):
    short = recording(1, 6, 1, expected=10)
    clock = [[(5, at(60 * h), 0, 1.0, 0, 1)] for h in (6, 9, 12)]
    got = {(r["event"], r["complete"]): r for r in machine(spark, [short[:3], short[3:], *clock], M.trigger_features(), extra=["post"]).collect()}
    assert got[1, False]["n_samples"] == 6 and (1, True) not in got
