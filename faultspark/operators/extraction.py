"""The full feature set of a recording: every feature group composed into one long table."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.iterate import cut_lineage
from ..functions.parallel import run_all
from . import series as S
from .kernels import highpass, peak_count, spectral_features
from .labels import loop_flag, year_scoped_flag
from .matrix import finite

# Second names under which seven features are also published.
ALIASES = {"amp_rms_pre": "rf_mismatch_rms_pre", "amp_rms_post": "rf_mismatch_rms_post", "phase_rms_pre": "phase_std_pre",
           "phase_rms_post": "phase_std_post", "control_overshoot_amp": "rf_mismatch_max_excursion",
           "control_settling_time": "rf_mismatch_settling_time", "control_saturation_fraction": "reflected_saturation_fraction"}


# What a feature is where its channel is absent from a recording.
ABSENT = {
    "effective_decay_tau": 0.0, "decay_rate": 0.0, "decay_fit_r2": 0.0, "decay_relative_to_nominal": 0.0, "decay_non_exponentiality": 0.0, "valid_decay_window": 0.0,
    "detuning_mean_hz": 0.0, "detuning_std_hz": 0.0, "detuning_slope_hz_s": 0.0, "detuning_peak_to_peak": 0.0, "detuning_jump_at_trigger": 0.0,
    "phase_jitter_rms": 0.0, "phase_excursion_pp": 0.0, "phase_noise_slope": 0.0, "phase_psd_integral": 0.0,
    "microphonics_rms": 0.0, "microphonics_dom_freq": 0.0, "microphonics_band_power_10_100": 0.0, "microphonics_q_factor": 0.0,
    "rf_mismatch_rms_pre": 0.0, "phase_std_pre": 0.0, "rf_mismatch_rms_post": math.nan, "phase_std_post": math.nan,
    "rf_mismatch_max_excursion": 0.0, "rf_mismatch_settling_time": math.nan, "reflected_saturation_fraction": 0.0,
    "mod_amplitude_mean_pre": 0.0, "mod_amplitude_std_pre": 0.0, "mod_phase_std_pre": 0.0, "mod_amplitude_change": 0.0, "mod_phase_change": 0.0, "mod_amplitude_max_post": 0.0,
    "forward_power_mean": 0.0, "reflected_power_mean": 0.0, "power_reflection_ratio": 0.0, "power_jump_at_trigger": 0.0, "power_imbalance_rms": 0.0,
    "rf_drive_on": 0.0, "llrf_loop_closed": 0.0, "feed_forward_enabled": 0.0,
}


def header_flags(meta: DataFrame, event: str = "series_id", header: str = "header") -> DataFrame:
    """(event, feature, value): whether the control loop was closed and the feed-forward on."""
    field = lambda name: F.try_element_at(F.col(header), F.lit(name))
    flags = F.create_map(F.lit("llrf_loop_closed"), loop_flag(field("LOOP")).cast("double"), F.lit("feed_forward_enabled"), year_scoped_flag(F.coalesce(field("DATE"), F.lit("")), field("BEAM")).cast("double"))
    return meta.select(event, F.explode(flags).alias("feature", "value"))


def extract_features(samples: DataFrame, roles: dict[str, str], meta: DataFrame | None = None, event: str = "series_id", window: float = S.PRECURSOR_SAMPLES,
                     ref_dt: float = S.REFERENCE_DT_US, min_pre: int = 100, filtered: bool = True, clean: bool = True) -> DataFrame:
    """(event, feature, value) from samples (event, channel, idx, t_us, value).

    ``roles`` names the channels for cavity, phase, forward, reflected, amplifier,
    modulator_amplitude and modulator_phase; where a role has no channel, or a recording not
    that channel, its features take their values of ``ABSENT``. ``meta`` has the event and a
    ``header`` map. With ``clean``, missing values become 0 and infinite ones (a signal that
    never settles) +-1e10.

    The samples are read for the trigger and for the filter; from then on all groups of
    features read one checkpoint of scaled samples, each as a job of its own, several at once.
    """
    ev, keys = [event], [event, "channel"]
    trig = cut_lineage(S.find_trigger(samples.groupBy(event, "idx").agg(F.min("t_us").alias("t_us")), ev))
    base = samples.select(*keys, "idx", "t_us", "value")
    if filtered:
        base = highpass(base, keys=keys).withColumnRenamed("filtered", "value")
    base = cut_lineage(base)
    z = cut_lineage(S.zscore(base, keys).select(*keys, "idx", F.col("value").alias("raw"), F.col("z").alias("value")))
    per_channel = cut_lineage(trig.join(base.select(*keys).distinct(), event))
    scale = window / S.PRECURSOR_SAMPLES
    name = F.col("channel")
    groups: list[Callable[[], DataFrame]] = []

    def long(df: DataFrame) -> DataFrame:
        return S.to_long(df, keys, name).drop("channel")

    def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
        return S.to_long(df.select(event, *[F.col(a).alias(b) for a, b in names.items()]), ev)

    def channel(role: str) -> DataFrame:
        return z.filter(name == roles[role]).drop("channel")

    def of_roles(*needed: str) -> Callable:
        """Register a group of features that needs these roles."""

        def add(f: Callable[[], DataFrame]) -> None:
            if all(r in roles for r in needed):
                groups.append(f)

        return add

    groups += [
        lambda: long(S.series_stats(base, keys)),
        lambda: long(S.zero_crossings(z, keys).withColumnRenamed("zero_crossings", "n_zero_crossings")),
        lambda: long(S.autocorr_lag(z, 1, keys).withColumnRenamed("autocorr", "autocorr_lag1")),
        lambda: long(peak_count(z, 0.5, keys).withColumnRenamed("n_peaks", "peak_count")),
        lambda: long(S.derivative_features(z, keys)),
        lambda: long(S.window_features(S.pre_window(z, per_channel, window, ref_dt, keys), S.scale_samples(S.EARLY_SAMPLES * scale, "dt_us", ref_dt), S.scale_samples(S.LATE_START * scale, "dt_us", ref_dt), keys)),
        lambda: S.to_long(S.segments(z, per_channel, window, ref_dt, keys).drop("n"), [*keys, "segment"], F.concat(name, F.lit("_segment_"), F.col("segment"))).drop("channel", "segment"),
    ]

    @of_roles("cavity")
    def decay() -> DataFrame:
        fit = named(S.decay_fit(channel("cavity"), trig, S.DECAY_SAMPLES * scale, ref_dt, keys=ev), {
            "tau": "effective_decay_tau", "rate": "decay_rate", "r2": "decay_fit_r2", "relative": "decay_relative_to_nominal", "residual": "decay_non_exponentiality"})
        return fit.unionByName(named(S.validity_flags(channel("cavity"), trig, S.MONOTONE_SAMPLES * scale, ref_dt, keys=ev), {"valid_decay": "valid_decay_window"}))

    @of_roles("phase")
    def detuning() -> DataFrame:
        return named(S.detuning(channel("phase"), trig, ev, min_pre=min_pre), {f"detuning_{n}": f"detuning_{m}" for n, m in (
            ("mean_hz", "mean_hz"), ("std_hz", "std_hz"), ("slope_hz_s", "slope_hz_s"), ("peak_to_peak", "peak_to_peak"), ("jump", "jump_at_trigger"))})

    @of_roles("phase")
    def stability() -> DataFrame:
        got = named(S.phase_stability(channel("phase"), trig, ev, min_pre=min_pre), {"jitter": "phase_jitter_rms", "excursion": "phase_excursion_pp", "noise_slope": "phase_noise_slope", "psd_integral": "phase_psd_integral"})
        return got.unionByName(named(S.pre_post_stats(channel("phase"), trig, ev), {"std_pre": "phase_std_pre", "std_post": "phase_std_post"}))

    @of_roles("phase")
    def microphonics() -> DataFrame:
        return named(spectral_features(channel("phase"), trig, min_pre, ev), {"rms": "microphonics_rms", "dominant_hz": "microphonics_dom_freq", "band_power": "microphonics_band_power_10_100", "q_factor": "microphonics_q_factor"})

    @of_roles("reflected", "amplifier")
    def mismatch() -> DataFrame:
        pair = S.pair_channels(z, roles["reflected"], roles["amplifier"], ev).withColumn("value", F.col("a") - F.col("b"))
        rms = named(S.pre_post_stats(pair, trig, ev), {"rms_pre": "rf_mismatch_rms_pre", "rms_post": "rf_mismatch_rms_post"})
        st = S.settling(pair, trig, keys=ev).join(trig.select(event, "dt_us"), event).withColumn("time", F.col("settling_samples") * F.col("dt_us") / 1e6)
        return rms.unionByName(named(st, {"max_excursion": "rf_mismatch_max_excursion", "time": "rf_mismatch_settling_time"}))

    @of_roles("reflected", "amplifier")
    def saturation() -> DataFrame:
        return named(channel("reflected").groupBy(event).agg(F.avg((F.abs("raw") > 95.0).cast("int")).alias("s")), {"s": "reflected_saturation_fraction"})

    @of_roles("modulator_amplitude", "modulator_phase")
    def modulator() -> DataFrame:
        amplitude = named(S.pre_post_stats(channel("modulator_amplitude"), trig, ev), {"mean_pre": "mod_amplitude_mean_pre", "std_pre": "mod_amplitude_std_pre", "change": "mod_amplitude_change", "max_abs_post": "mod_amplitude_max_post"})
        return amplitude.unionByName(named(S.pre_post_stats(channel("modulator_phase"), trig, ev), {"std_pre": "mod_phase_std_pre", "change": "mod_phase_change"}))

    @of_roles("forward")
    def drive() -> DataFrame:
        return named(channel("forward").groupBy(event).agg((F.avg(F.abs("raw")) > 1.0).cast("int").alias("on")), {"on": "rf_drive_on"})

    @of_roles("forward", "reflected")
    def power() -> DataFrame:
        return named(S.power_balance(S.pair_channels(z, roles["forward"], roles["reflected"], ev), trig, S.JUMP_SAMPLES * scale, ref_dt, ev), {
            "forward_mean": "forward_power_mean", "reflected_mean": "reflected_power_mean", "reflection_ratio": "power_reflection_ratio", "jump": "power_jump_at_trigger", "imbalance": "power_imbalance_rms"})

    if meta is not None:
        groups.append(lambda: S.numeric_metadata(meta, event, "header").unionByName(header_flags(meta, event)))
    done = run_all([lambda f=f: cut_lineage(f().select(event, "feature", F.col("value").cast("double").alias("value"))) for f in groups])
    both = reduce(DataFrame.unionByName, done)
    absent = F.create_map(*[x for f, v in ABSENT.items() for x in (F.lit(f), F.lit(v))])
    fill = trig.select(event, F.explode(absent).alias("feature", "value")).join(both.select(event, "feature"), [event, "feature"], "left_anti")
    both = both.unionByName(fill)
    # a copy under the second name, in the same pass
    back = F.create_map(*[x for a, n in ALIASES.items() for x in (F.lit(n), F.lit(a))])
    names = F.array_compact(F.array(F.col("feature"), F.try_element_at(back, F.col("feature"))))
    value = finite(F.col("value")) if clean else F.col("value")
    return both.select(event, F.explode(names).alias("feature"), value.alias("value"))
