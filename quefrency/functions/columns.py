"""Arrow-batched functions over array columns: one call for a whole batch, whatever the rows' lengths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows that a function takes at once, so that what it makes of them stays small.
ROWS = 2048


class Lists:
    """An Arrow array of lists of numbers as one flat array, with the place and length of each list (-1 for null)."""

    def __init__(self, s: pa.Array):
        self.size = s.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        self.start = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.values = s.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)

    def matrix(self, at: np.ndarray) -> np.ndarray:
        """The rows at these places, all of one length."""
        return self.values[self.start[at][:, None] + np.arange(self.size[at[0]])]


def packed(m: np.ndarray, gaps: bool = False) -> pa.Array:
    """Lists (nested for three axes) of a matrix. gaps: frames of NaN are null."""
    flat = pa.array(np.ascontiguousarray(m, float).ravel())
    for axis in range(m.ndim - 1, 0, -1):
        n = int(np.prod(m.shape[:axis]))
        null = np.isnan(m[:, :, 0]).ravel() if gaps and axis == 2 else np.zeros(n, bool)
        cut = pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[axis])
        flat = pa.ListArray.from_arrays(cut, flat, mask=pa.array(null)) if null.any() else pa.ListArray.from_arrays(cut, flat)
    return flat


def _by_length(s: pa.Array, f: Callable[[np.ndarray], np.ndarray], least: int, kind: pa.DataType, gaps: bool = False) -> pa.Array:
    parts = []
    for i in range(0, len(s), ROWS):
        x = Lists(s.slice(i, ROWS))
        place, made, n = np.full(len(x.size), -1), [pa.array([], kind)], 0
        for size in np.unique(x.size[x.size >= least]):
            at = np.flatnonzero(x.size == size)
            made.append(packed(np.asarray(f(x.matrix(at))), gaps))
            place[at] = n + np.arange(len(at))
            n += len(at)
        parts.append(pa.concat_arrays(made).take(pa.array(place, mask=place < 0)))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


VECTOR = pa.list_(pa.float64())


def by_key(k: pa.Array, s: pa.Array, kinds: list[pa.DataType], each: Callable[[str, np.ndarray], list[pa.Array] | None]) -> list[pa.Array]:
    """Arrow arrays of these types, from those that each(key, rows of that key) gives; null where it gives none."""
    d, x = k.dictionary_encode(), Lists(s)
    code = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    place, made, n = np.full(len(code), -1), [[pa.array([], t)] for t in kinds], 0
    for i, name in enumerate(d.dictionary.to_pylist()):
        at = np.flatnonzero((code == i) & (x.size >= 0))
        got = each(name, x.matrix(at)) if len(at) else None
        if got is not None:
            for own, a in zip(made, got, strict=True):
                own.append(a)
            place[at] = n + np.arange(len(at))
            n += len(at)
    take = pa.array(place, mask=place < 0)
    return [pa.concat_arrays(own).take(take) for own in made]


def rows(f: Callable[[np.ndarray], np.ndarray], least: int = 1):
    """array<double> -> array<double>; null for null and for shorter arrays."""
    return F.arrow_udf(lambda s: _by_length(s, f, least, VECTOR), "array<double>")


def frames(f: Callable[[np.ndarray], np.ndarray], least: int):
    """array<double> -> array<array<double>>: a vector for each frame of the window."""
    return F.arrow_udf(lambda s: _by_length(s, f, least, pa.list_(VECTOR)), "array<array<double>>")


def complex_frames(f: Callable[[np.ndarray], np.ndarray], least: int):
    """Two array columns, real and imaginary parts of as many samples each -> array<array<double>> as of frames(), from complex
    windows; null where either is null, where they differ in length, or for shorter ones. Rows of NaN become null frames."""
    join = lambda m: f(m[:, : m.shape[1] // 2] + 1j * m[:, m.shape[1] // 2 :])
    whole = F.arrow_udf(lambda s: _by_length(s, join, 2 * least, pa.list_(VECTOR), True), "array<array<double>>")
    return lambda re, im: whole(F.when(F.size(re) == F.size(im), F.concat(re, im)))


def named(column: str, names: list[str], digits: int | None = None) -> list[Column]:
    """The elements of an array as columns."""
    cell = lambda i: F.col(column)[i]
    return [(F.round(cell(i), digits) + F.lit(0.0) if digits else cell(i)).alias(n) for i, n in enumerate(names)]
