"""Draws of published runs: splits and channels from numpy's seeded bit stream, in the order in which those runs drew them.

A stream is sequential, so a split's groups, and the ids of its test windows, meet in one task; more than MOST of them are
an error. The default draws by hash have no such limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1 << 22


def _bounded(n: int) -> None:
    if n > MOST:
        raise ValueError(f"more than {MOST} draws of one stream; use the draws by hash")


def _shuffled(values: pd.Series, seed: int) -> np.ndarray:
    _bounded(len(values))
    v = np.unique(values.to_numpy())
    np.random.default_rng(seed).shuffle(v)
    return v


def _roles(rows: pd.DataFrame, group: str, test_size: float, seed: int) -> pd.DataFrame:
    split = int(rows["split"].iloc[0])
    v = _shuffled(rows[group], seed + split)
    n = max(1, int(round(test_size * len(v))))
    return pd.DataFrame({"split": split, group: v, "role": np.where(np.arange(len(v)) < n, "test", "train")})


def _folds(rows: pd.DataFrame, group: str, n_splits: int, seed: int) -> pd.DataFrame:
    v = _shuffled(rows[group], seed)
    if len(v) < n_splits:
        raise ValueError(f"{len(v)} groups are too few for {n_splits} folds")
    return pd.DataFrame({group: v, "fold": np.minimum(np.arange(len(v)) // (len(v) // n_splits), n_splits - 1)})


def _kind(frame: DataFrame, column: str) -> str:
    return f"`{column}` {frame.schema[column].dataType.simpleString()}"


def split_roles(windows: DataFrame, group: str, splits: int, test_size: float = 0.3, seed: int = 2026) -> DataFrame:
    """split, group, role: sorted distinct groups shuffled by the stream of seed + split, the first ones for testing. Null groups are left out."""
    g = windows.select(group).where(F.col(group).isNotNull()).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    return g.groupBy("split").applyInPandas(lambda rows: _roles(rows, group, test_size, seed), f"split int, {_kind(windows, group)}, role string")


def grouped_kfold(frame: DataFrame, group: str, n_splits: int = 5, seed: int = 2026) -> DataFrame:
    """frame with fold: shuffled groups dealt in a row, the rest to the last fold."""
    if n_splits < 2:
        raise ValueError("two folds at least")
    g = frame.select(group).where(F.col(group).isNotNull()).distinct()
    return frame.join(g.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lambda rows: _folds(rows, group, n_splits, seed), f"{_kind(frame, group)}, fold int"), group)


def draws(n: int, taps: int, rng: np.random.Generator, complex_: bool, decay: float = 0.7) -> np.ndarray:
    """The next n channels of a stream, of unit energy: tap 0 direct, echoes normal and decaying."""
    if taps <= 1:
        return np.ones((n, 1), complex if complex_ else float)
    z = rng.standard_normal((n, 2, taps) if complex_ else (n, taps))
    h = np.exp(-decay * np.arange(taps)) * (z[:, 0] + 1j * z[:, 1] if complex_ else z)
    h[:, 0] = 1
    return h / np.sqrt((np.abs(h) ** 2).sum(axis=1, keepdims=True))


def _channels(rows: pd.DataFrame, severities: tuple[int, ...], seed: int, complex_: bool) -> pd.DataFrame:
    split, ids = int(rows["split"].iloc[0]), np.sort(rows["window_id"].to_numpy())
    _bounded(len(ids) * len(severities))
    rng, out = np.random.default_rng(seed + split + 7), []
    for taps in severities:
        h = draws(len(ids), taps, rng, complex_)
        cells = [[{"re": float(e.real), "im": float(e.imag)} for e in row] for row in h] if complex_ else list(h)
        out.append(pd.DataFrame({"split": split, "severity": taps, "window_id": ids, "h": cells}))
    return pd.concat(out)


def channels(tested: DataFrame, severities: tuple[int, ...], seed: int = 2026, complex_: bool = False) -> DataFrame:
    """split, severity, window_id, h for rows split, window_id of test windows: severity by severity, and by window id inside
    each, from the stream of seed + split + 7. A severity of 1 draws nothing."""
    h = "array<struct<re:double,im:double>>" if complex_ else "array<double>"
    run = lambda rows: _channels(rows, tuple(severities), seed, complex_)
    return tested.select("split", "window_id").groupBy("split").applyInPandas(run, f"split int, severity int, {_kind(tested, 'window_id')}, h {h}")
