"""Windows to frames: log profiles, cepstra with lifters, mel coefficients, and their normalisations."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.functions import columns, signal


def frames(windows: DataFrame, kernel, least: int, x: str = "x") -> DataFrame:
    """One row a frame: the windows' other columns, frame_id, v. Windows without a frame vanish."""
    made = windows.withColumn("__f", columns.frames(kernel, least)(x)).drop(x)
    return made.select(*[c for c in made.columns if c != "__f"], F.posexplode("__f").alias("frame_id", "v"))


def log_profiles(windows: DataFrame, n_fft=256, hop=128, window="hann") -> DataFrame:
    return frames(windows, partial(signal.log_profile, n_fft=n_fft, hop=hop, window=window), n_fft)


def complex_frames(windows: DataFrame, kernel, least: int, re: str = "re", im: str = "im") -> DataFrame:
    """frames() of complex windows, given as two array columns. Null frames are left out; frame_id counts them."""
    made = windows.withColumn("__f", columns.complex_frames(kernel, least)(re, im)).drop(re, im)
    return made.select(*[c for c in made.columns if c != "__f"], F.posexplode("__f").alias("frame_id", "v")).where(F.col("v").isNotNull())


def complex_log_profiles(windows: DataFrame, n_fft=256, hop=128, window="hann", re: str = "re", im: str = "im") -> DataFrame:
    """log_profiles() of complex windows: all bins but the first."""
    return complex_frames(windows, partial(signal.log_profile, n_fft=n_fft, hop=hop, window=window), n_fft, re, im)


def _occupied(z, form, n_fft, hop, window, lo, least):
    """Profiles or cepstra of the frames whose profile deviates enough; NaN for the others."""
    profile = signal.log_profile(z, n_fft, hop, window)
    v = profile if form == "spectral" else signal.cepstrum(z, n_fft, hop, window, lo)
    return np.where((profile.std(axis=2) >= least)[:, :, None], v, np.nan)


def occupied_frames(windows: DataFrame, form: str, n_fft=256, hop=128, lo=3, least=0.8, window="hann") -> DataFrame:
    """Frames of complex windows, as log profiles (`spectral`) or cepstra from quefrency lo on (`cepstral`). Frames of the noise
    floor are left out by the deviation of the window's own profile, so both forms keep the same ones."""
    if form not in ("spectral", "cepstral"):
        raise ValueError(f"unknown form {form!r}")
    return complex_frames(windows, partial(_occupied, form=form, n_fft=n_fft, hop=hop, window=window, lo=lo, least=least), n_fft)


def cepstra(windows: DataFrame, n_fft=256, hop=128, window="hann", lo=0, hi=None, eps=signal.EPS_MAG) -> DataFrame:
    return frames(windows, partial(signal.cepstrum, n_fft=n_fft, hop=hop, window=window, lo=lo, hi=hi, eps=eps), n_fft)


def full_cepstra(windows: DataFrame, n_fft=256, hop=128, window="hann", eps=signal.EPS_MAG) -> DataFrame:
    """Quefrencies 0 .. n_fft/2 - 1, the zeroth included."""
    return frames(windows, partial(signal.full_cepstrum, n_fft=n_fft, hop=hop, window=window, eps=eps), n_fft)


def liftered(windows: DataFrame, family="lb", lo=3, hi=None, n_fft=256, hop=128) -> DataFrame:
    return frames(windows, partial(signal.liftered, family=family, lo=lo, hi=hi, n_fft=n_fft, hop=hop), n_fft)


def all_lifters(windows: DataFrame, lifters=(1, 2, 3, 4, 6, 8), n_fft=256, hop=128) -> DataFrame:
    """One cepstrum pass; lifter L is a slice of it."""
    c = cepstra(windows, n_fft, hop, lo=1)
    c = c.withColumn("lifter", F.explode(F.array(*map(F.lit, lifters))))
    return c.withColumn("v", F.slice("v", F.col("lifter"), F.greatest(F.size("v") - F.col("lifter") + 1, F.lit(0))))


def _profile_then(step, x, n_fft, hop):
    return step(signal.log_profile(x, n_fft, hop))


def normalised(windows: DataFrame, method: str, n_fft=256, hop=128) -> DataFrame:
    """Log profiles after cmvn, detrend or rasta."""
    step = {"cmvn": signal.cmvn, "detrend": signal.detrended, "rasta": signal.rasta}[method]
    return frames(windows, partial(_profile_then, step, n_fft=n_fft, hop=hop), n_fft)


def mfcc(windows: DataFrame, fs=12000.0, n_fft=256, hop=128, n_mels=26, keep=11) -> DataFrame:
    return frames(windows, partial(signal.mfcc, fs=fs, n_fft=n_fft, hop=hop, n_mels=n_mels, keep=keep), n_fft)


def energy_mask(profiles: DataFrame, least: float = 0.8, v: str = "v") -> DataFrame:
    """Frames whose profile deviates enough; join its keys to other representations of the same frames."""
    mean = F.aggregate(v, F.lit(0.0), lambda a, e: a + e) / F.size(v)
    var = F.aggregate(F.transform(v, lambda e: F.pow(e - mean, 2)), F.lit(0.0), lambda a, e: a + e) / F.size(v)
    return profiles.where(F.sqrt(var) >= least)


def describe(frames_: DataFrame, znorm: bool = True, v: str = "v", out: str = "s") -> DataFrame:
    """The eleven shape descriptors of each row of v, as an array column in its place."""
    f = (lambda m: signal.shape_descriptors(signal.znorm(m))) if znorm else signal.shape_descriptors
    return frames_.withColumn(out, columns.rows(f, 2)(v)).drop(v)


def spectral_statistics(frames_: DataFrame, count: int = 11, v: str = "v", out: str = "s") -> DataFrame:
    return frames_.withColumn(out, columns.rows(lambda m: signal.spectral_statistics(m)[:, :count], 2)(v)).drop(v)


def class_moment_summary(stats: DataFrame, y: str = "y", s: str = "s") -> DataFrame:
    """Mean and population deviation of each statistic by class: y, stat, mean, std."""
    each = stats.select(y, F.posexplode(s).alias("stat", "__v"))
    return each.groupBy(y, "stat").agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"))


def fir(windows: DataFrame, taps: list[float], x: str = "x") -> DataFrame:
    """Every window through one causal channel with zero history."""
    h = np.array(taps)
    return windows.withColumn(x, columns.rows(lambda m: signal.causal_fir(m, h))(x))


#: Channels that a sweep takes at most; more are an error, none are left out.
MOST_CHANNELS = 4096


def fir_sweep(windows: DataFrame, channels: DataFrame, x: str = "x") -> DataFrame:
    """Windows through each channel of a small table (severity, taps), which is broadcast; one of more than MOST_CHANNELS is an error."""
    if channels.limit(MOST_CHANNELS + 1).count() > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels")
    each = windows.crossJoin(F.broadcast(channels))
    n = F.size(x)
    lag = lambda i: F.aggregate(F.sequence(F.lit(0), F.least(i, F.size("taps") - 1)), F.lit(0.0), lambda a, k: a + F.get("taps", k) * F.get(x, i - k))
    return each.withColumn(x, F.transform(F.sequence(F.lit(0), n - 1), lag))
