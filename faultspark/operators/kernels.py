"""Per-series numeric kernels that Spark expressions cannot state: peaks, filters, spectra.

Kernels run on fixed-size chunks. Filters carry the state of their recurrence from chunk
to chunk; peak counting merges small chunk summaries in a tree. So one long recording is
shared by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.exprs import ratio
from ..functions.iterate import cut_lineage
from ..functions.ordering import neighbours, series_chunk, series_prefix
from .series import KEYS, join_events, split_at_trigger, unwrap_phase

FAN_IN = 256
ONE_TASK_SAMPLES = 1 << 22


def apply_series_kernel(samples: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: list[str] = KEYS) -> DataFrame:
    """User function over whole series: one pandas frame in, any number of rows out.

    For recordings of bounded length; the chunked operators below have no such limit.
    """
    return samples.groupBy(*keys).applyInPandas(fn, schema)


@dataclass(frozen=True)
class SeriesKernel:
    """A user's function of a whole series as three steps on small states.

    ``start`` gets the samples of one chunk in order (a frame with idx and value) and returns a
    state, ``merge`` joins the states of two neighbouring stretches, ``finish`` turns the last
    state into rows. A state is a tuple that fits ``state``, rows fit ``out``.
    """

    state: str
    out: str
    start: Callable[[pd.DataFrame], tuple]
    merge: Callable[[tuple, tuple], tuple]
    finish: Callable[[tuple], list[tuple]]


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places where a run of equal keys begins; nulls are equal, and so are NaNs."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in keys:
        a, b = batch.column(k)[1:], batch.column(k)[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(a.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        new[1:] |= pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind, from_pandas=True)
    except (pa.ArrowInvalid, pa.ArrowTypeError):  # whole numbers as floats
        return pa.Array.from_pandas(pd.Series(values), type=kind)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _in_runs(df: DataFrame, keys: list[str], order: list[str], rows: Callable[[pa.RecordBatch, np.ndarray, int], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``rows(batch, starts, end)`` makes of whole groups, which begin at ``starts``, their rows in ``order``.

    Groups lie one behind another in sorted partitions, so many small ones share a batch: a call
    of Python for each series costs some 10 ms. A group is held whole.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []  # of one group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            seam = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            new = _starts(_joined([*seam, batch]), keys)[len(seam) :] - len(seam)
            if not len(new):
                held.append(batch)
                continue
            done = [*held, batch.slice(0, new[-1])] if new[-1] else held
            if done:
                whole = _joined(done)
                yield rows(whole, _starts(whole, keys), whole.num_rows)
            held = [batch.slice(new[-1])]
        if held:
            whole = _joined(held)
            yield rows(whole, np.array([0]), whole.num_rows)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def by_runs(df: DataFrame, keys: list[str], order: str, opened: Callable[[pa.RecordBatch], Callable[[int, int], list[tuple]]], fields: str) -> DataFrame:
    """Keys and the rows that each group gives, its rows in ``order``; ``opened(batch)`` returns a function of a group's first and last place."""
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], fields])
    target = to_arrow_schema(StructType.fromDDL(schema))
    given = target.names[len(keys):]

    def rows(batch: pa.RecordBatch, starts: np.ndarray, end: int) -> pa.RecordBatch:
        task = opened(batch)
        found = [task(lo, hi) for lo, hi in zip(starts, [*starts[1:], end])]
        at = pa.array(np.repeat(starts, [len(f) for f in found]))
        flat = [row for f in found for row in f]
        cols = [_column([row[i] for row in flat], target.field(n).type) for i, n in enumerate(given)]
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(at).cast(target.field(k).type) for k in keys], *cols], schema=target)

    return _in_runs(df, keys, [order], rows, schema)


def run_series_kernel(samples: DataFrame, kernel: SeriesKernel, keys: list[str] = KEYS, value: str = "value", idx: str = "idx") -> DataFrame:
    """Rows of ``kernel`` for each series; one series is shared by many tasks.

    Chunks give states, and ``FAN_IN`` neighbouring states become one until a series has one.
    """
    size = series_chunk(samples.sparkSession)
    fields = [f.split()[0] for f in kernel.state.split(",")]
    d = samples.select(*keys, F.floor(F.col(idx) / size).cast("bigint").alias("__part"), F.col(idx).alias("idx"), F.col(value).cast("double").alias("value"))

    def chunk(batch: pa.RecordBatch) -> Callable[[int, int], list[tuple]]:
        i, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("idx", "value"))
        return lambda lo, hi: [kernel.start(pd.DataFrame({"idx": i[lo:hi], "value": v[lo:hi]}))]

    def merged(batch: pa.RecordBatch) -> Callable[[int, int], tuple]:
        cols = [batch.column(f) for f in fields]
        cols = [pc.fill_null(c, np.nan).to_pylist() if pa.types.is_floating(c.type) else c.to_pylist() for c in cols]
        states = list(zip(*cols))
        return lambda lo, hi: reduce(kernel.merge, states[lo:hi])

    def level(batch: pa.RecordBatch) -> Callable[[int, int], list[tuple]]:
        whole = merged(batch)
        return lambda lo, hi: [whole(lo, hi)]

    def last(batch: pa.RecordBatch) -> Callable[[int, int], list[tuple]]:
        whole = merged(batch)
        return lambda lo, hi: kernel.finish(whole(lo, hi))

    s = cut_lineage(by_runs(d, [*keys, "__part"], "idx", chunk, kernel.state))
    parts = (s.agg(F.max("__part")).first()[0] or 0) + 1
    while parts > FAN_IN:
        s = s.withColumn("__at", F.col("__part")).withColumn("__part", F.floor(F.col("__part") / FAN_IN).cast("bigint"))
        s = by_runs(s, [*keys, "__part"], "__at", level, kernel.state)
        parts = parts // FAN_IN + 1
    return by_runs(s, keys, "__part", last, kernel.out)


def longest_run(level: float = 0.0) -> SeriesKernel:
    """Length of the longest run of samples above a level, and how many such runs there are."""

    def start(pdf: pd.DataFrame) -> tuple:
        up = pdf["value"].to_numpy() > level
        edges = np.flatnonzero(np.diff(np.r_[False, up, False].astype(np.int8)))
        size = edges[1::2] - edges[::2]
        n = len(up)
        first = int(size[0]) if n and up[0] else 0
        final = int(size[-1]) if n and up[-1] else 0
        return n, first, final, int(size.max(initial=0)), len(size)

    def merge(a: tuple, b: tuple) -> tuple:
        n, joined = a[0] + b[0], a[2] + b[1]
        first = a[1] + b[1] if a[1] == a[0] else a[1]
        final = a[2] + b[2] if b[2] == b[0] else b[2]
        return n, first, final, max(a[3], b[3], joined), a[4] + b[4] - (a[2] > 0 and b[1] > 0)

    return SeriesKernel("n bigint, first bigint, final bigint, best bigint, runs bigint", "longest bigint, n_runs bigint", start, merge, lambda s: [(s[3], s[4])])


# ---- peaks -----------------------------------------------------------------------------

def turning_points(x: np.ndarray) -> np.ndarray:
    """The first and last value and those where the direction turns, each flat part once."""
    x = x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
    up = x[1:] > x[:-1]
    return x[np.r_[True, up[1:] != up[:-1], True]] if len(x) > 2 else x


def _extrema(values, mult):
    """Alternating turning points; the two end points always stay."""
    v, m = [], []
    for x, k in zip(values, mult):
        if v and x == v[-1]:
            m[-1] = m[-1] + k - 1  # the same flat top on both sides of a cut
            continue
        if len(v) > 1 and (v[-1] - v[-2]) * (x - v[-1]) > 0:
            v.pop(), m.pop()
        v.append(x), m.append(k)
    return v, m


def _reduce(v, m, p):
    """Drop tops that lose to a higher neighbour before falling by p; equal tops join.

    The lower of the two valleys beside a dropped top stays. End points are not touched.
    """
    sv, sm = list(v[:1]), list(m[:1])
    for i in range(1, len(v)):
        sv.append(v[i]), sm.append(m[i])
        last = i == len(v) - 1
        while not last and len(sv) >= 4 and sv[-1] < sv[-2]:
            # ... a, valley, b, w with w a finished valley
            a, valley, b, w = sv[-4:]
            if b - valley < p and a >= b:
                if a == b:
                    sm[-4] += sm[-2]
                del sv[-3:], sm[-3:]
                sv.append(min(valley, w)), sm.append(1)
            elif a - valley < p and b > a and len(sv) >= 6:
                u = sv[-5]
                del sv[-5:-2], sm[-5:-2]
                sv.insert(-2, min(u, valley)), sm.insert(-2, 1)
            else:
                break
    return sv, sm


def _summary(v, m, p):
    """Short list of turning points that stands for the whole, and the peaks already certain."""
    v, m = _reduce(*_extrema(v, m), p)
    if len(v) <= 14:
        return v, m, 0
    i = next(k for k in range(5, 8) if v[k] < v[k - 1])
    j = next(k for k in range(len(v) - 6, len(v) - 9, -1) if v[k] < v[k - 1])
    inner = range(i + 1, j, 2)
    count = sum(m[k] for k in inner)
    top = max(v[k] for k in inner)
    return v[: i + 1] + [top] + v[j:], m[: i + 1] + [0] + m[j:], count


def _finish(v, m, p):
    v, m = _reduce(*_extrema(v, m), p)
    total = 0
    for k in range(1, len(v) - 1):
        if v[k] > v[k - 1] and v[k] > v[k + 1]:
            left = right = v[k]
            for x in reversed(v[:k]):
                if x > v[k]:
                    break
                left = min(left, x)
            for x in v[k + 1:]:
                if x > v[k]:
                    break
                right = min(right, x)
            if v[k] - left >= p and v[k] - right >= p:
                total += m[k]
    return total


def peak_count(samples: DataFrame, prominence: float = 0.5, keys: list[str] = KEYS, value: str = "value", idx: str = "idx") -> DataFrame:
    """Local maxima (flat tops count once) with at least ``prominence``."""
    size = max(series_chunk(samples.sparkSession), 16)
    fields = "v array<double>, m array<int>, n bigint"
    d = samples.select(*keys, F.floor(F.col(idx) / size).cast("bigint").alias("part"), F.col(idx).alias("i"), F.col(value).cast("double").alias("x"))

    def start(batch: pa.RecordBatch) -> Callable[[int, int], list[tuple]]:
        x = batch.column("x").to_numpy(zero_copy_only=False)

        def chunk(lo: int, hi: int) -> list[tuple]:
            t = turning_points(x[lo:hi])
            return [_summary(t.tolist(), [1] * len(t), prominence)]

        return chunk

    def merge(done: bool) -> Callable:
        def opened(batch: pa.RecordBatch) -> Callable[[int, int], list[tuple]]:
            v, m = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in "vm")
            n, ends = batch.column("n").to_numpy(), np.cumsum([0, *pc.list_value_length(batch.column("v")).to_pylist()])

            def level(lo: int, hi: int) -> list[tuple]:
                at, known = slice(ends[lo], ends[hi]), int(n[lo:hi].sum())
                if done:
                    return [(known + _finish(v[at].tolist(), m[at].tolist(), prominence),)]
                tops, counts, sure = _summary(v[at].tolist(), m[at].tolist(), prominence)
                return [(tops, counts, known + sure)]

            return level

        return opened

    s = by_runs(d, [*keys, "part"], "i", start, fields)
    longest = samples.agg(F.max(idx)).first()[0] or 0
    parts = longest // size + 1
    while parts > FAN_IN:
        s = s.withColumn("__at", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("bigint"))
        s = by_runs(s, [*keys, "part"], "__at", merge(False), fields)
        parts = parts // FAN_IN + 1
    return by_runs(s, keys, "part", merge(True), "n_peaks bigint")


def peaks_by_distance(samples: DataFrame, distance: int = 20, keys: list[str] = KEYS, value: str = "value", idx: str = "idx") -> DataFrame:
    """Peaks at least ``distance`` samples apart, the lower ones giving way first.

    In each round the undecided peaks that top their surroundings stay and remove the
    others nearby; rounds end when nothing is undecided.
    """
    d = neighbours(samples.select(*keys, idx, value), keys, {"__a": (value, -1)}, idx)
    # number the runs of equal values, so that a flat top is one step at its middle
    steps = series_prefix(d, keys, F.when(F.col(value) != F.col("__a"), 1.0).otherwise(0.0), "__run", idx)
    runs = steps.groupBy(*keys, F.col("__run").cast("bigint").alias("r")).agg(F.floor((F.min(idx) + F.max(idx)) / 2).alias(idx), F.first(value).alias(value))
    t = neighbours(runs, keys, {"__l": (value, -1), "__n": (value, 1)}, "r")
    rises = t.filter((F.col(value) > F.col("__l")) & (F.col(value) > F.col("__n")))
    p = rises.select(*keys, F.col(idx).alias("i"), F.col(value).alias("h"), F.lit(0).alias("state"))
    reach = distance - 1
    size = max(series_chunk(samples.sparkSession), distance)
    while True:
        home = F.floor(F.col("i") / size).cast("bigint")
        copies = F.array_compact(F.array(home, F.when(F.col("i") % size >= size - reach, home + 1), F.when((F.col("i") % size < reach) & (home > 0), home - 1)))
        e = p.withColumn("__home", home).withColumn("__c", F.explode(copies))
        near = W.partitionBy(*keys, "__c").orderBy("i").rangeBetween(-reach, reach)
        rank = F.struct("h", "i")
        e = e.withColumn("__top", F.max(F.when(F.col("state") == 0, rank)).over(near))
        e = e.filter(F.col("__c") == F.col("__home")).withColumn("state", F.when((F.col("state") == 0) & (rank == F.col("__top")), 1).otherwise(F.col("state"))).select(*p.columns)
        e = e.withColumn("__home", home).withColumn("__c", F.explode(copies))
        e = e.withColumn("__kept", F.max(F.when(F.col("state") == 1, 1)).over(near)).filter(F.col("__c") == F.col("__home"))
        p = cut_lineage(e.filter((F.col("state") == 1) | F.col("__kept").isNull()).select(*p.columns))
        if not p.filter("state = 0").head(1):
            return p.select(*keys, F.col("i").alias(idx), F.col("h").alias(value))


# ---- filters ---------------------------------------------------------------------------

def butterworth_highpass(order: int, cutoff: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order (or first-order) sections by the bilinear transform; cutoff relative to half the rate."""
    w = math.tan(math.pi * cutoff / 2.0)
    out = []
    for k in range(order // 2):
        q = 2.0 * math.cos(math.pi * (2 * k + 1) / (2 * order))
        a0 = 1.0 + q * w + w * w
        out.append((np.array([1.0, -2.0, 1.0]) / a0, np.array([1.0, 2.0 * (w * w - 1.0) / a0, (1.0 - q * w + w * w) / a0])))
    if order % 2:
        out.append((np.array([1.0, -1.0]) / (1.0 + w), np.array([1.0, (w - 1.0) / (1.0 + w)])))
    return out


@dataclass(frozen=True)
class Recurrence:
    """A chain of filter sections as one linear recurrence: y = c s + d x, then s = a s + b x.

    A run of samples maps the state s to a**n s + f, where f is the state that the run leaves
    when it starts from rest. Such maps compose, so runs of one series are filtered apart.
    """

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    #: Samples handled by one matrix product.
    STEP = 64

    @staticmethod
    def of(sections: list[tuple[np.ndarray, np.ndarray]]) -> Recurrence:
        whole = None
        for num, den in sections:
            m = len(den) - 1
            a = np.zeros((m, m))
            a[:, 0], a[range(m - 1), range(1, m)] = -den[1:], 1.0
            one = Recurrence(a, num[1:] - den[1:] * num[0], np.eye(m)[0], float(num[0]))
            whole = one if whole is None else whole.then(one)
        return whole

    def then(self, o: Recurrence) -> Recurrence:
        a = np.block([[self.a, np.zeros((len(self.a), len(o.a)))], [np.outer(o.b, self.c), o.a]])
        return Recurrence(a, np.concatenate([self.b, o.b * self.d]), np.concatenate([o.d * self.c, o.c]), o.d * self.d)

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one step: outputs by state, outputs by input, and the state left by each input."""
        n, m = self.STEP, len(self.a)
        powers = np.empty((n, m, m))
        powers[0] = np.eye(m)
        for i in range(1, n):
            powers[i] = powers[i - 1] @ self.a
        left = powers @ self.b  # state i + 1 samples after a unit input
        response = np.concatenate([[self.d], left[:-1] @ self.c])
        at = np.arange(n)
        inputs = np.where(at[:, None] >= at[None, :], response[np.maximum(at[:, None] - at[None, :], 0)], 0.0)
        return powers.transpose(0, 2, 1) @ self.c, inputs, left[::-1]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Outputs, and the state after the last sample."""
        n, m = self.STEP, len(self.a)
        by_state, by_input, leaves = self._tables
        s = np.zeros(m) if state is None else np.asarray(state, float)
        if not len(x):
            return np.zeros(0), s
        steps = -(-len(x) // n)
        padded = np.zeros((steps, n))
        padded.ravel()[: len(x)] = x
        gains, whole = padded @ leaves, self.power(n)
        states = np.empty((steps, m))
        for k in range(steps):
            states[k] = s
            s = whole @ s + gains[k]
        rest = len(x) - (steps - 1) * n
        end = self.power(rest) @ states[-1] + padded[-1, :rest] @ leaves[n - rest :]
        return (padded @ by_input.T + states @ by_state.T).ravel()[: len(x)], end


def linear_filter(samples: DataFrame, system: Recurrence, keys: list[str] = KEYS, value: str = "value", idx: str = "idx", out: str = "filtered", keep: list[str] | None = None, keep_short: int = 0) -> DataFrame:
    """Filter each series from rest: (keys, idx, out, columns to keep).

    Chunks are filtered from rest for the state that they leave, these states are carried along
    the chunks of a series, a few numbers each, and then every chunk is filtered from the state
    before it. Series of at most ``keep_short`` samples pass unchanged.
    """
    keep = keep or []
    size = max(series_chunk(samples.sparkSession), keep_short + 1)
    d = samples.select(*keys, *keep, F.col(idx).cast("bigint").alias("__i"), F.col(value).cast("double").alias("__x"), F.floor(F.col(idx) / size).cast("bigint").alias("__c"))
    types = dict(d.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    unit = [*keys, "__c"]

    def leave(batch: pa.RecordBatch) -> Callable[[int, int], list[tuple]]:
        x = batch.column("__x").to_numpy(zero_copy_only=False)
        return lambda lo, hi: [(hi - lo, system.run(x[lo:hi])[1].tolist())]

    def carry(batches):
        key, state, powers = None, None, {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            before = []
            for *k, _, n, s in zip(*columns):
                if k != key:
                    key, state = k, np.zeros(len(system.a))
                before.append(state.tolist())
                if n not in powers:
                    powers[n] = system.power(n)
                state = powers[n] @ state + np.array(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(before, pa.list_(pa.float64()))], [*unit, "s"])

    left = by_runs(d, unit, "__i", leave, "n bigint, s array<double>")
    state = left.repartition(*keys).sortWithinPartitions(*unit).mapInArrow(carry, f"{head}, __c bigint, s array<double>")
    names = [*keys, idx, out, *keep]
    schema = ", ".join([head, f"`{idx}` bigint, `{out}` double", *[f"`{k}` {types[k]}" for k in keep]])
    target = to_arrow_schema(StructType.fromDDL(schema))

    def filtered(batch: pa.RecordBatch, starts: np.ndarray, end: int) -> pa.RecordBatch:
        """The first row of a chunk has the state before it, the others its samples."""
        x, c, y, sample = batch.column("__x").to_numpy(zero_copy_only=False), batch.column("__c"), np.zeros(end), np.ones(end, bool)
        sample[starts] = False
        for lo, hi in zip(starts, [*starts[1:], end]):
            part = x[lo + 1 : hi]
            short = c[lo].as_py() == 0 and len(part) <= keep_short
            y[lo + 1 : hi] = part if short else system.run(part, batch.column("s")[lo].as_py())[0]
        found = {idx: batch.column("__i"), out: pa.array(y, from_pandas=True)}
        cols = [(found[n] if n in found else batch.column(n)).cast(target.field(n).type) for n in names]
        return pa.RecordBatch.from_arrays(cols, schema=target).filter(pa.array(sample))

    both = d.withColumn("__row", F.lit(1)).unionByName(state.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    return _in_runs(both, unit, ["__row", "__i"], filtered, schema)


def highpass(samples: DataFrame, cutoff: float = 0.01, order: int = 4, keys: list[str] = KEYS, value: str = "value", idx: str = "idx") -> DataFrame:
    """Causal Butterworth high-pass (column ``filtered``); series of up to 10 samples stay as they are."""
    return linear_filter(samples, Recurrence.of(butterworth_highpass(order, cutoff)), keys, value, idx, keep_short=10)


def highpass_zero_phase(samples: DataFrame, cutoff: float, order: int = 1, keys: list[str] = KEYS, value: str = "value", idx: str = "idx") -> DataFrame:
    """Forward and backward high-pass over an odd extension of both ends.

    A settled high-pass gives 0 for a constant, so starting settled on the first value
    equals filtering the series minus that value. Series no longer than the extension have
    no result.
    """
    system = Recurrence.of(butterworth_highpass(order, cutoff))
    pad = 3 * (order + 1)
    s = samples.select(*keys, F.col(idx).cast("bigint").alias("idx"), F.col(value).cast("double").alias("x"))
    ends = s.groupBy(*keys).agg(F.min_by("x", "idx").alias("x0"), F.max_by("x", "idx").alias("x1"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("idx") == pad, F.col("x"))).alias("xp"))
    d = join_events(s, ends.filter(F.col("n") > pad), keys)
    i, back = F.col("idx"), F.col("n") - 1 - F.col("idx")
    pieces = F.array_compact(F.array(
        F.struct((i + pad).alias("i"), F.col("x").alias("x")),
        F.when((i >= 1) & (i <= pad), F.struct((pad - i).alias("i"), (2 * F.col("x0") - F.col("x")).alias("x"))),
        F.when((back >= 1) & (back <= pad), F.struct((F.col("n") - 1 + back + pad).alias("i"), (2 * F.col("x1") - F.col("x")).alias("x")))))
    e = d.select(*keys, "n", (2 * F.col("x0") - F.col("xp")).alias("first"), F.explode(pieces).alias("p")).select(*keys, F.col("p.i").alias("idx"), (F.col("p.x") - F.col("first")).alias("x"), (F.col("n") + 2 * pad).alias("len"))
    f = cut_lineage(linear_filter(e, system, keys, "x", "idx", "y", ["len"]))
    last = f.groupBy(*keys).agg(F.max_by("y", "idx").alias("last"), F.max("len").alias("n"))
    r = join_events(f, last, keys).select(*keys, (F.col("len") - 1 - F.col("idx")).alias("i"), (F.col("y") - F.col("last")).alias("x"), "len")
    b = linear_filter(r, system, keys, "x", "i", "filtered", ["len"])
    pos = F.col("len") - 1 - F.col("i") - pad
    return b.filter((pos >= 0) & (pos < F.col("len") - 2 * pad)).select(*keys, pos.alias(idx), "filtered")


# ---- spectra ---------------------------------------------------------------------------

def spectrum(mag: np.ndarray, freq: np.ndarray) -> tuple[float, float, float]:
    """Dominant frequency (without DC), power from 10 to 100 Hz, and sharpness of the peak."""
    top = int(mag[1:].argmax()) + 1
    half = mag[top] / 2.0
    low = np.nonzero(mag[: top + 1] <= half)[0]
    high = np.nonzero(mag[top:] <= half)[0]
    lo = int(low[-1]) if len(low) else 0
    hi = top + int(high[0]) if len(high) else len(mag) - 1
    width = freq[hi] - freq[lo]
    band = float((mag[(freq >= 10) & (freq <= 100)] ** 2).sum())
    return float(freq[top]), band, float(freq[top] / width) if width > 0 else 0.0


def _fourier_step(df: DataFrame, keys: list[str], group: str, pos: str, size: int, inverse: bool) -> DataFrame:
    """Transform each group of at most ``size`` values; absent positions are zero."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {group} bigint, k bigint, re double, im double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(size, complex)
        x[pdf[pos].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.ifft(x) if inverse else np.fft.fft(x)
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {group: pdf[group].iloc[0], "k": np.arange(size), "re": y.real, "im": y.imag})

    return df.groupBy(*keys, group).applyInPandas(run, schema)


def fourier_transform(df: DataFrame, keys: list[str], bits: int, inverse: bool = False) -> DataFrame:
    """Transform of length 2**bits of rows (keys, i, re, im), spread over groups of about its square root.

    Columns of the index grid are transformed first, turned by a twiddle factor, then
    the rows: two shuffles, no group longer than 2**ceil(bits / 2).
    """
    n1, n2 = 1 << (bits // 2), 1 << (bits - bits // 2)
    d = df.withColumn("i2", F.col("i") % n2).withColumn("i1", F.floor(F.col("i") / n2).cast("bigint"))
    a = _fourier_step(d.select(*keys, "i2", "i1", "re", "im"), keys, "i2", "i1", n1, inverse)
    angle = F.lit((1 if inverse else -1) * 2 * math.pi / (n1 * n2)) * (F.col("i2") * F.col("k"))
    c, s = F.cos(angle), F.sin(angle)
    t = a.select(*keys, F.col("k").alias("k1"), "i2", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    b = _fourier_step(t, keys, "k1", "i2", n2, inverse)
    return b.select(*keys, (F.col("k1") + F.col("k") * n1).alias("i"), "re", "im")


def long_spectrum(df: DataFrame, keys: list[str], n_max: int, idx: str = "idx", value: str = "value", n: str = "n") -> DataFrame:
    """Magnitudes (keys, n, k, mag) of a transform of any length n, computed as a convolution with a chirp."""
    bits = max(4, (2 * n_max - 1).bit_length())
    size = 1 << bits

    def chirp(j):
        # the squared index is reduced before it meets the angle, so large indices stay exact
        return F.lit(math.pi) * ((j * j) % (2 * F.col(n))) / F.col(n)

    w = chirp(F.col(idx))
    src = df.select(*keys, n, F.col(idx).cast("bigint").alias("i"), F.col(value).alias("x"), w.alias("w"))
    a = src.select(*keys, "i", (F.col("x") * F.cos("w")).alias("re"), (-F.col("x") * F.sin("w")).alias("im"))
    ends = F.array_compact(F.array(F.col("i"), F.when(F.col("i") > 0, size - F.col("i"))))
    b = src.select(*keys, F.explode(ends).alias("i"), F.cos("w").alias("re"), F.sin("w").alias("im"))
    fa, fb = fourier_transform(a, keys, bits), fourier_transform(b, keys, bits)
    prod = fa.join(fb.withColumnsRenamed({"re": "r2", "im": "i2"}), [*keys, "i"]).select(
        *keys, "i", (F.col("re") * F.col("r2") - F.col("im") * F.col("i2")).alias("re"), (F.col("re") * F.col("i2") + F.col("im") * F.col("r2")).alias("im"))
    y = fourier_transform(prod, keys, bits, inverse=True)
    lengths = df.groupBy(*keys).agg(F.max(n).alias(n))
    return y.join(lengths, keys).filter(F.col("i") <= F.floor(F.col(n) / 2)).select(*keys, n, F.col("i").alias("k"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))


def _long_features(u: DataFrame, keys: list[str], n_max: int) -> DataFrame:
    """Spectral features of recordings too long for one task, from aggregates over their spectrum."""
    x = F.col("pidx") - (F.col("n") - 1) / 2
    fit = u.groupBy(*keys).agg(F.avg("phase").alias("m"), ratio(F.sum(x * F.col("phase")), F.sum(x * x)).alias("b"))
    r = u.join(fit, keys).withColumn("value", F.col("phase") - F.col("m") - F.col("b") * x).withColumn("idx", F.col("pidx"))
    rms = r.groupBy(*keys).agg(F.stddev_pop("value").alias("rms"), F.max("dt_us").alias("dt_us"))
    s = long_spectrum(r.select(*keys, "n", "idx", "value"), keys, n_max).join(rms, keys)
    s = s.withColumn("hz", F.col("k") / (F.col("n") * F.col("dt_us") / 1e6))
    top = s.filter("k > 0").groupBy(*keys).agg(F.max_by("k", F.struct("mag", -F.col("k"))).alias("kt"), F.max("mag").alias("peak"))
    j = s.join(top, keys)
    low = F.col("mag") <= F.col("peak") / 2
    g = j.groupBy(*keys).agg(
        F.max("rms").alias("rms"), F.max(F.when(F.col("k") == F.col("kt"), F.col("hz"))).alias("dominant_hz"),
        F.sum(F.when((F.col("hz") >= 10) & (F.col("hz") <= 100), F.col("mag") * F.col("mag")).otherwise(0.0)).alias("band_power"),
        F.coalesce(F.max(F.when((F.col("k") < F.col("kt")) & low, F.col("hz"))), F.lit(0.0)).alias("lo"),
        F.coalesce(F.min(F.when((F.col("k") > F.col("kt")) & low, F.col("hz"))), F.max("hz")).alias("hi"))
    return g.select(*keys, "rms", "dominant_hz", "band_power", F.coalesce(ratio(F.col("dominant_hz"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("q_factor"))


def spectral_features(samples: DataFrame, trigger: DataFrame, min_pre: int = 100, keys: list[str] = KEYS, value: str = "value") -> DataFrame:
    """Residual rms, dominant frequency, band power and Q of the detrended pre-trigger phase.

    A recording whose pre-trigger part fits one task is transformed there; a longer one
    goes through the distributed transform.
    """
    parts = [*keys, "part"]
    u = unwrap_phase(split_at_trigger(samples, trigger, keys).filter(F.col("part") == "pre"), parts, value, "pidx")
    u = u.select(*keys, "pidx", "phase", "dt_us", F.col("z").cast("bigint").alias("n"))
    def opened(batch: pa.RecordBatch) -> Callable[[int, int], list[tuple]]:
        phase, step = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("phase", "dt_us"))

        def whole(lo: int, hi: int) -> list[tuple]:
            y, n = phase[lo:hi], hi - lo
            if n <= min_pre:
                return [(0.0, 0.0, 0.0, 0.0)]
            x = np.arange(n) - (n - 1) / 2.0
            r = y - y.mean() - x * ((x * y).sum() / (x * x).sum()) if n > 1 else y * 0.0
            return [(float(r.std()), *spectrum(np.abs(np.fft.rfft(r)), np.fft.rfftfreq(n, float(step[lo]) / 1e6)))]

        return whole

    longest = trigger.agg(F.max("z")).first()[0] or 0
    found = u.filter(F.col("n") <= ONE_TASK_SAMPLES).select(*keys, "pidx", "phase", "dt_us")
    found = by_runs(found, keys, "pidx", opened, "rms double, dominant_hz double, band_power double, q_factor double")
    if longest > ONE_TASK_SAMPLES:
        found = found.unionByName(_long_features(u.filter(F.col("n") > ONE_TASK_SAMPLES), keys, longest))
    # a recording whose trigger is its first sample has nothing to transform
    out = trigger.select(*keys).join(found, keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rms", "dominant_hz", "band_power", "q_factor")])
