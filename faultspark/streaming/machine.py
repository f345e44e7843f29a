"""Event state machine: samples wait in the state store until an event is complete.

Two chained stateful steps share one event among many tasks. The first keeps the samples of one
chunk of one event and turns a full chunk into the small state of a ``SeriesKernel``; the second
keeps those states until they hold all samples of the event, merges them in order and sends the
features. Samples live in the store (RocksDB), so memory holds one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ordering import series_chunk
from ..operators.kernels import SeriesKernel

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(",")]


class _Waiting(StatefulProcessor):
    """Counts of what is in, the latest time of it, and a timer that follows that time."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint, given bigint, last bigint, due bigint, expected bigint")

    def close(self) -> None:
        pass

    def so_far(self) -> tuple[int, int, int, int, int]:
        return tuple(self.seen.get() or (0, 0, -1, -1, 0))  # each call is a round trip to the JVM

    def wait(self, n: int, given: int, last: int, due: int, expected: int, now: int) -> None:
        again = max(last + self.timeout, now + 1)
        if again != due:
            if due > now:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(again)
        self.seen.update((n, given, last, again, expected))

    def forget(self, due: int) -> None:
        if due >= 0:
            self.handle.deleteTimer(due)
        self.seen.clear()


class _Chunks(_Waiting):
    """Samples of one chunk to one kernel state; a chunk still open sends a sign of life.

    It sends none where its event has no other chunk and nothing of it was sent yet: nobody waits for it.
    """

    def __init__(self, kernel: SeriesKernel, size: int, timeout_ms: int, event: str, columns: list[str], types: str):
        super().__init__(timeout_ms)
        self.kernel, self.size, self.columns, self.types = kernel, size, columns, types
        self.fields = _names(kernel.state)
        self.out = [event, "part__", "first__", "n__", "expected__", "last__", "at__", *self.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rows = handle.getListState("rows", self.types)

    def row(self, key, pdf: pd.DataFrame | None, expected: int, last: int, now: int) -> pd.DataFrame:
        at = pd.Timestamp(max(last, now + 1), unit="ms", tz="UTC")
        if pdf is None:
            return pd.DataFrame([[key[0], key[1], -1, 0, expected, last, at, *[None] * len(self.fields)]], columns=self.out)
        pdf = pdf.sort_values("idx")
        return pd.DataFrame([[key[0], key[1], pdf["idx"].iloc[0], len(pdf), expected, last, at, *self.kernel.start(pdf)]], columns=self.out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        n, given, last, due, expected = self.so_far()
        new = list(rows)  # one chunk at most, but for samples sent twice
        new = new[0] if len(new) == 1 else pd.concat(new)
        expected = max(expected, int(new["expected__"].max()))
        last = max(last, int(new["ms__"].max()))
        pdf = new[self.columns]
        pdf = pdf if pdf["idx"].is_unique else pdf.drop_duplicates("idx")
        wanted = min(self.size, expected - key[1] * self.size) - given
        if n and n + len(pdf) >= wanted:
            old = pd.DataFrame(list(self.rows.get()), columns=self.columns)
            pdf = pd.concat([old, pdf]).drop_duplicates("idx")
            n = 0
            self.rows.clear()
        if n + len(pdf) >= wanted:
            self.forget(due)
            yield self.row(key, pdf, expected, last, now)
            return
        self.rows.appendList(list(zip(*([None if v != v else v for v in pdf[c].tolist()] for c in self.columns))))
        self.wait(n + len(pdf), given, last, due, expected, now)
        if given or key[1] or expected > self.size:
            yield self.row(key, None, expected, last, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        n, given, last, due, expected = self.so_far()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        if not n:
            self.seen.clear()
            return
        pdf = pd.DataFrame(list(self.rows.get()), columns=self.columns).drop_duplicates("idx")
        self.rows.clear()
        self.wait(0, given + len(pdf), max(last, now), due, expected, now)  # remembers what it gave for as long again
        yield self.row(key, pdf, expected, last, now)


class _Events(_Waiting):
    """Kernel states of the chunks of one event to its features."""

    def __init__(self, kernel: SeriesKernel, timeout_ms: int, event: str):
        super().__init__(timeout_ms)
        self.kernel, self.fields = kernel, _names(kernel.state)
        self.whole = {f.split()[0] for f in kernel.state.split(",") if f.split()[1].lower() in ("bigint", "int", "long", "integer")}
        self.out = [event, *_names(kernel.out), "n_samples", "complete"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getMapState("parts", "part bigint, first bigint", self.kernel.state)

    def state(self, row: tuple) -> tuple:
        """Without the floats that pandas makes of whole numbers beside nulls."""
        return tuple(None if pd.isna(v) else int(v) if f in self.whole else v for f, v in zip(self.fields, row))

    def send(self, key, parts: dict[tuple, tuple], n: int, complete: bool) -> pd.DataFrame:
        states = [s for _, s in sorted(parts.items(), key=lambda e: e[0])]
        rows = self.kernel.finish(reduce(self.kernel.merge, states)) if states else []
        return pd.DataFrame([[key[0], *row, n, complete] for row in rows], columns=self.out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, given, last, due, expected = self.so_far()
        stored, new = n > 0, {}
        for f in rows:
            last, expected = max(last, int(f["last__"].max())), max(expected, int(f["expected__"].max()))
            f = f[f["n__"] > 0]
            for part, first, row in zip(f["part__"], f["first__"], f[self.fields].itertuples(index=False, name=None)):
                new[int(part), int(first)] = self.state(row)
            n += int(f["n__"].sum())
        if n and n >= expected:
            if due >= 0:
                self.forget(due)
            yield self.send(key, (self.taken() if stored else {}) | new, n, True)
        else:
            for at, state in new.items():
                self.parts.updateValue(at, state)
            self.wait(n, given, last, due, expected, max(timerValues.getCurrentWatermarkInMs(), 0))

    def taken(self) -> dict[tuple, tuple]:
        """The stored states, which are stored no longer."""
        parts = {tuple(k): tuple(v) for k, v in self.parts.iterator()}
        self.parts.clear()
        return parts

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _, _, due, _ = self.so_far()
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
            if n:
                yield self.send(key, self.taken(), n, False)


def stream_series_kernel(stream: DataFrame, kernel: SeriesKernel, event: str, ts: str, delay: str, timeout_ms: int = 3_600_000, extra: list[str] = []) -> DataFrame:
    """Rows of ``kernel`` for each event, once its ``expected`` samples are in or it times out.

    The stream has ``event``, ``ts`` (timestamp), ``idx`` (0, 1, ...), ``value``, ``expected`` and the
    columns ``extra`` that the kernel's start reads. Complete events give what ``run_series_kernel``
    gives for the whole table, with n_samples and complete = true.

    A sample sent twice counts once while its chunk is open. A chunk sends what it has once the
    watermark is ``timeout_ms`` beyond the largest time of its samples; what comes after that is
    merged behind it. An event without all samples is sent with complete = false once the watermark
    is twice that time beyond its last sample of any chunk; later samples of it are a new event. Rows without event, idx or expected belong nowhere and are left
    out; those without a time wait as if they came with the watermark. Null values reach the kernel.
    """
    columns = ["idx", "value", *extra]
    types = dict(stream.dtypes) | {"idx": "bigint", "value": "double"}
    size = series_chunk(stream.sparkSession)
    d = stream.filter(F.col(event).isNotNull() & F.col("idx").isNotNull() & F.col("expected").isNotNull()).withWatermark(ts, delay).select(
        event, F.floor(F.col("idx") / size).cast("bigint").alias("part__"), ts, F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("double").alias("value"), *extra,
        F.col("expected").cast("bigint").alias("expected__"), F.coalesce(F.unix_millis(ts), F.lit(-1)).alias("ms__"))
    key = f"`{event}` {types[event]}"
    chunks = d.groupBy(event, "part__").transformWithStateInPandas(
        _Chunks(kernel, size, timeout_ms, event, columns, ", ".join(f"`{c}` {types[c]}" for c in columns)),
        f"{key}, part__ bigint, first__ bigint, n__ bigint, expected__ bigint, last__ bigint, at__ timestamp, {kernel.state}",
        outputMode="append", timeMode="eventtime", eventTimeColumnName="at__")
    return chunks.groupBy(event).transformWithStateInPandas(
        _Events(kernel, 2 * timeout_ms, event), f"{key}, {kernel.out}, n_samples bigint, complete boolean", outputMode="append", timeMode="eventtime")


# ---- features of one event -------------------------------------------------------------

_SIDE = ("n", "mean", "m2", "low", "high", "at", "mat", "c", "first", "final", "step", "crossings")
_OUT = ("n", "mean", "std", "min", "max", "rms", "slope", "max_step", "zero_crossings")


def _side(idx: np.ndarray, v: np.ndarray) -> tuple:
    keep = ~np.isnan(v)
    idx, v = idx[keep].astype(float), v[keep]
    if not len(v):
        return (0, *[None] * 10, 0)
    m, a = v.mean(), idx.mean()
    steps = np.abs(np.diff(v)).max(initial=0.0)
    return (len(v), float(m), float(((v - m) ** 2).sum()), float(v.min()), float(v.max()), float(a), float(((idx - a) ** 2).sum()), float(((idx - a) * (v - m)).sum()),
            float(v[0]), float(v[-1]), float(steps), int((np.sign(v[1:]) != np.sign(v[:-1])).sum()))


def _joined(a: tuple, b: tuple) -> tuple:
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    w, dv, da = a[0] * b[0] / n, b[1] - a[1], b[5] - a[5]
    return (n, a[1] + dv * b[0] / n, a[2] + b[2] + dv * dv * w, min(a[3], b[3]), max(a[4], b[4]), a[5] + da * b[0] / n, a[6] + b[6] + da * da * w, a[7] + b[7] + dv * da * w,
            a[8], b[9], max(a[10], b[10], abs(b[8] - a[9])), a[11] + b[11] + int(np.sign(b[8]) != np.sign(a[9])))


def _sent(s: tuple) -> tuple:
    n, mean, m2, low, high, _, mat, c, _, _, step, crossings = s
    if not n:
        return (0, *[None] * 7, 0)
    return n, mean, (m2 / n) ** 0.5, low, high, (m2 / n + mean * mean) ** 0.5, c / mat if mat else 0.0, step, crossings


def trigger_features(post: str = "post") -> SeriesKernel:
    """Level, spread, trend, largest step and sign changes before and after the trigger.

    ``post`` is a column of 0 and 1. Null values are left out; a side without values has n = 0 and
    nulls; the trend of a single sample is 0. ``jump`` is the difference of the two means.
    """
    whole = ("n", "crossings")
    k = len(_SIDE)
    state = ", ".join(f"{s}_{f} {'bigint' if f in whole else 'double'}" for s in ("a", "b") for f in _SIDE)
    out = ", ".join(f"{f}_{s} {'bigint' if f in ('n', 'zero_crossings') else 'double'}" for s in ("pre", "post") for f in _OUT) + ", jump double"

    def start(pdf: pd.DataFrame) -> tuple:
        idx, v, late = pdf["idx"].to_numpy(), pdf["value"].to_numpy(float), pdf[post].to_numpy() == 1
        return _side(idx[~late], v[~late]) + _side(idx[late], v[late])

    def merge(a: tuple, b: tuple) -> tuple:
        return _joined(a[:k], b[:k]) + _joined(a[k:], b[k:])

    def finish(s: tuple) -> list[tuple]:
        pre, after = _sent(s[:k]), _sent(s[k:])
        return [(*pre, *after, after[1] - pre[1] if pre[0] and after[0] else None)]

    return SeriesKernel(state, out, start, merge, finish)
