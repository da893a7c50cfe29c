"""Streaming tilers: complete windows of each series as samples arrive, with what is left kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series long, block long, k int, x array<double>"


def _tiled(pos: int, held: list[float], x: np.ndarray, window: int, per_block: int, guard: int) -> tuple[int, list[float], list[tuple]]:
    """New samples behind `pos` earlier ones, of which `held` wait for their window: position, samples that wait, and (block, k, x) of full windows."""
    stride = window * per_block + guard
    at = pos + np.arange(len(x))
    inside = at % stride < window * per_block
    pos += len(x)
    x = np.concatenate([np.array(held, float), x[inside]])
    at = np.concatenate([np.full(len(held), -1), at[inside]])
    n = len(x) // window
    ends = at[window - 1 : n * window : window]  # each window's last sample, which came now
    return pos, x[n * window :].tolist(), [(int(e // stride), int(e % stride // window), v) for e, v in zip(ends, x[: n * window].reshape(n, window), strict=True)]


def tile_stream(samples: DataFrame, window: int, per_block: int, guard: int, series: str = "user_id", order: str = "event_id", value: str = "value") -> DataFrame:
    """series, block, k, x for every window that is full. Samples of a series must arrive in order between batches."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, held = state.get if state.exists else (0, [])
        x = pd.concat(list(batches)).sort_values(order)[value].to_numpy(float)
        pos, held, out = _tiled(pos, held, x, window, per_block, guard)
        state.update((pos, held))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["series", "block", "k", "x"])

    return samples.select(series, order, value).groupBy(series).applyInPandasWithState(step, OUT, "pos long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def tile_disordered(samples: DataFrame, window: int, per_block: int, guard: int, time: str = "ts", delay: str = "10 minutes", series: str = "user_id", order: str = "event_id", value: str = "value") -> DataFrame:
    """series, block, k, x as of tile_stream(), for samples that come in any order within a delay.

    A sample waits, in order of (time, order), until the watermark has passed its time: then no earlier one can come, and
    its place in the series is known. Samples later than the delay are dropped by the watermark, as everywhere in Spark;
    the last ones of a stream wait for the watermark to move on. State holds the samples of one delay a series.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, held, times, orders, values = state.get if state.exists else (0, [], [], [], [])
        waiting = pd.DataFrame({"t": times, "o": orders, "v": values}, dtype=object)
        # A timeout comes without samples.
        new = [pd.DataFrame({"t": b["__ms"], "o": b[order], "v": b[value]}) for b in ([] if state.hasTimedOut else batches)]
        waiting = pd.concat([waiting, *new]).astype({"t": "int64", "o": "int64", "v": "float64"}).sort_values(["t", "o"])
        passed = state.getCurrentWatermarkMs()
        ready = (waiting["t"] < passed).to_numpy()
        pos, held, out = _tiled(pos, held, waiting["v"].to_numpy()[ready], window, per_block, guard)
        rest = waiting[~ready]
        state.update((pos, held, rest["t"].tolist(), rest["o"].tolist(), rest["v"].tolist()))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["t"].iloc[0]), passed) + 1)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["series", "block", "k", "x"])

    own = samples.withWatermark(time, delay).select(F.col(time), F.unix_millis(F.col(time)).alias("__ms"), series, order, value)
    kept = "pos long, held array<double>, times array<long>, orders array<long>, waiting array<double>"
    return own.groupBy(series).applyInPandasWithState(step, OUT, kept, "append", GroupStateTimeout.EventTimeTimeout)
