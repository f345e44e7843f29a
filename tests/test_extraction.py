"""All features of a recording: the groups together equal the operators one by one."""

import math

import pytest
from pyspark.sql import functions as F

from faultspark.operators import extraction as X, kernels as N, series as S

ROLES = {"cavity": "a", "phase": "b", "forward": "a", "reflected": "b", "amplifier": "c", "modulator_amplitude": "a", "modulator_phase": "b"}
REF = 10.0


@pytest.fixture(scope="module")
def samples(spark):
    """Three recordings; the second has no channel b or c, the third begins with its trigger."""
    n = {1: 240, 2: 200, 3: 150}
    rows = []
    for e, size in n.items():
        z = 0 if e == 3 else size // 2
        for c in ("a", "b", "c") if e != 2 else ("a",):
            for i in range(size):
                rows.append((e, c, i, float((i - z) * 10), math.sin(i * 0.3 + ord(c)) * (2.0 if c == "a" else 0.7) + 0.01 * i + (e == 1 and i > z) * 3.0))
    return spark.createDataFrame(rows, "series_id bigint, channel string, idx bigint, t_us double, value double").repartition(4)


@pytest.fixture(scope="module")
def meta(spark):
    rows = [(1, {"LOOP": "on", "DATE": "03/02/2019", "BEAM": "NON", "NROW": "240"}), (2, {"LOOP": "OFF", "DATE": "03/02/2022", "BEAM": "OUI"})]
    return spark.createDataFrame(rows, "series_id bigint, header map<string,string>")


def wide(df):
    out = {}
    for r in df.collect():
        assert (r["series_id"], r["feature"]) not in out
        out[r["series_id"], r["feature"]] = r["value"]
    return out


@pytest.mark.parametrize("filtered", [True, False])
def test_groups_equal_the_operators(samples, meta, filtered):
    got = wide(X.extract_features(samples, ROLES, meta, window=40, ref_dt=REF, min_pre=20, filtered=filtered))
    keys = ["series_id", "channel"]
    trig = S.find_trigger(samples.groupBy("series_id", "idx").agg(F.min("t_us").alias("t_us")))
    base = N.highpass(samples, keys=keys).withColumnRenamed("filtered", "value") if filtered else samples.select(*keys, "idx", "value")
    z = S.zscore(base, keys).select(*keys, "idx", F.col("z").alias("value"))
    for name, df in (("mean", S.series_stats(base, keys)), ("iqr", S.series_stats(base, keys)), ("peak_count", N.peak_count(z, 0.5, keys).withColumnRenamed("n_peaks", "peak_count")), ("velocity_std", S.derivative_features(z, keys))):
        for r in df.select(*keys, name).collect():
            assert got[r["series_id"], f"{r['channel']}_{name}"] == pytest.approx(r[name], abs=1e-9)
    phase = z.filter("channel = 'b'").drop("channel")
    for r in S.detuning(phase, trig, min_pre=20).filter("series_id <> 2").collect():
        assert got[r["series_id"], "detuning_mean_hz"] == pytest.approx(r["detuning_mean_hz"], rel=1e-6, abs=1e-6)
    pair = S.pair_channels(z, "b", "c", ["series_id"]).withColumn("value", F.col("a") - F.col("b"))
    for r in S.pre_post_stats(pair, trig).collect():
        assert got[r["series_id"], "rf_mismatch_rms_post"] == pytest.approx(r["rms_post"], abs=1e-9) == got[r["series_id"], "amp_rms_post"]


def test_absent_channels_flags_and_a_trigger_at_the_start(samples, meta):
    got = wide(X.extract_features(samples, ROLES, meta, window=40, ref_dt=REF, min_pre=20))
    assert {f for e, f in got if e == 2} >= set(X.ABSENT) and all(math.isfinite(v) for v in got.values())
    phase = [f for f in X.ABSENT if f.startswith(("detuning", "phase", "microphonics", "rf_mismatch"))]
    assert all(got[2, f] == 0.0 for f in phase)
    assert (got[1, "llrf_loop_closed"], got[1, "feed_forward_enabled"]) == (1.0, 1.0)
    assert (got[2, "llrf_loop_closed"], got[2, "feed_forward_enabled"]) == (0.0, 1.0)
    assert (got[3, "llrf_loop_closed"], got[3, "feed_forward_enabled"]) == (0.0, 0.0)
    assert got[3, "phase_jitter_rms"] == got[3, "microphonics_rms"] == 0.0 and got[3, "a_mean"] != 0.0
    few = wide(X.extract_features(samples.filter("series_id = 1"), {"cavity": "a"}, None, window=40, ref_dt=REF, clean=False))
    assert math.isnan(few[1, "rf_mismatch_settling_time"]) and few[1, "rf_drive_on"] == 0.0


def test_a_signal_that_never_settles(spark):
    # the last samples swing around 0 and no sample is near their median
    rows = [(1, c, i, float(i - 50), (5.0 if i % 2 else -5.0) if c == "b" else 0.0) for c in ("a", "b") for i in range(200)]
    d = spark.createDataFrame(rows, "series_id bigint, channel string, idx bigint, t_us double, value double")
    roles = {"reflected": "b", "amplifier": "a"}
    assert wide(X.extract_features(d, roles, filtered=False, clean=False))[1, "rf_mismatch_settling_time"] == math.inf
    assert wide(X.extract_features(d, roles, filtered=False))[1, "control_settling_time"] == 1e10
