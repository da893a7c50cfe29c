"""Synthetic four-class complex signals, one seeded generator for each row, so that partitioning changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multiplicative amplitude jitter of the classes, and least amplitude.
JITTER, LEAST = (0.05, 0.15, 0.12, 0.10), 1e-6
#: Fixed values, by class: the floor under its peaks; how many peaks (from, to); their height, width in bins and distance
#: from the ends (from, to). The first class is one level (from, to); the last a decay by bin (from, to), a ripple and a floor.
LEVEL = (0.8, 1.2)
SPIKES = {"floor": 0.02, "peaks": (3, 6), "height": (5.0, 10.0), "beside": 0.3, "edge": 2}
BUMPS = {"floor": 0.05, "peaks": (2, 3), "height": (1.0, 2.5), "width": (4.0, 10.0), "edge": 8}
DECAY = {"rate": (0.04, 0.08), "ripple": (0.85, 1.15), "floor": 0.03}


def _peaks(spec: dict, rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and heights of a class's peaks."""
    size = rng.integers(spec["peaks"][0], spec["peaks"][1], endpoint=True)
    return rng.permutation(np.arange(spec["edge"], n - spec["edge"]))[:size, None], rng.uniform(*spec["height"], (size, 1))


def amplitude(y: int, rng: np.random.Generator, n: int) -> np.ndarray:
    """A level, sparse spikes, a few bumps, or a decay, from the parameters above; jittered."""
    bins, noise = np.arange(n, dtype=float), rng.normal(1, JITTER[y], n)
    if y == 0:
        a = np.broadcast_to(rng.uniform(*LEVEL), n)
    elif y == 3:
        a = np.exp(-rng.uniform(*DECAY["rate"]) * bins) * rng.uniform(*DECAY["ripple"], n) + DECAY["floor"]
    else:
        spec = SPIKES if y == 1 else BUMPS
        place, height = _peaks(spec, rng, n)
        far = np.abs(bins - place)
        shape = np.select([far == 0, far == 1], [1.0, spec["beside"]], 0.0) if y == 1 else np.exp(-((far / rng.uniform(*spec["width"], place.shape)) ** 2) / 2)
        a = np.maximum(spec["floor"], (height * shape).max(axis=0)) if y == 1 else spec["floor"] + (height * shape).sum(axis=0)
    return np.maximum(a * noise, LEAST)


def rotated(re: str, im: str, fs: float, hz: float) -> tuple[Column, Column]:
    """Array columns after a carrier offset: sample k turns by 2 pi hz k / fs. No offset changes nothing."""
    if not hz:
        return F.col(re), F.col(im)
    turn = lambda k: 2 * np.pi * hz / fs * k
    both = F.arrays_zip(F.col(re).alias("a"), F.col(im).alias("b"))
    return F.transform(both, lambda z, k: z["a"] * F.cos(turn(k)) - z["b"] * F.sin(turn(k))), F.transform(both, lambda z, k: z["a"] * F.sin(turn(k)) + z["b"] * F.cos(turn(k)))


def shifted(x: np.ndarray, fs: float, hz: float) -> np.ndarray:
    """Carrier offset."""
    return x * np.exp(2j * np.pi * hz * np.arange(len(x)) / fs) if hz else x


def _noisy(amp: np.ndarray, rng: np.random.Generator, fs: float, snr_db: float, cfo_hz: float) -> np.ndarray:
    """A signal with these amplitudes and random phases: unit power, then the carrier offset, then white noise."""
    n = len(amp)
    x = np.fft.ifft(amp * np.exp(2j * np.pi * rng.random(n)))
    x = shifted(x / np.sqrt(np.mean(np.abs(x) ** 2)), fs, cfo_hz)
    return (x + 10 ** (-snr_db / 20) / np.sqrt(2) * (rng.standard_normal(n) + 1j * rng.standard_normal(n))).astype(np.complex64)


def signals(ids: DataFrame, id_col: str, n_samples: int = 4096, fs: float = 20e6, snr_db: float = 20.0, cfo_hz: float = 0.0, seed: int = 2026) -> DataFrame:
    """signal_id, y (id mod 4), re, im for each id of a table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["signal_id"]:
                rng = np.random.default_rng([seed, int(i)])
                x = _noisy(amplitude(int(i) % 4, rng, n_samples), rng, fs, snr_db, cfo_hz)
                out.append((i, int(i) % 4, x.real.astype(float), x.imag.astype(float)))
            yield pd.DataFrame(out, columns=["signal_id", "y", "re", "im"])

    return ids.select(F.col(id_col).cast("long").alias("signal_id")).mapInPandas(run, "signal_id long, y int, re array<double>, im array<double>")


def resynthesised(windows: DataFrame, id_col: str, y_col: str, x_col: str, fs: float = 20e6, snr_db: float = 20.0, cfo_hz: float = 0.0, seed: int = 2026) -> DataFrame:
    """signal_id, y, re, im: for each window a signal with the window's own amplitudes by frequency, and random phases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, y, x in zip(b["signal_id"], b["y"], b["x"], strict=True):
                z = _noisy(np.maximum(np.abs(np.fft.fft(np.asarray(x, float))), LEAST), np.random.default_rng([seed, int(i)]), fs, snr_db, cfo_hz)
                out.append((i, y, z.real.astype(float), z.imag.astype(float)))
            yield pd.DataFrame(out, columns=["signal_id", "y", "re", "im"])

    own = windows.select(F.col(id_col).cast("long").alias("signal_id"), F.col(y_col).cast("int").alias("y"), F.col(x_col).alias("x"))
    return own.mapInPandas(run, "signal_id long, y int, re array<double>, im array<double>")
