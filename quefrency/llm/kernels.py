"""Vectorised text kernels that run inside Arrow tasks: words, hashes, n-grams and sliding minima over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one kernel call works on; a longer text is still one call.
SLICE_BYTES = 1 << 19
_RNG = np.random.default_rng(20260)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
MULT = np.uint64(0x9E3779B97F4A7C15)
INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: White space of word splitting: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i for i < n, modulo 2**64; kept between calls."""
    if len(_pow[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        for k, base in enumerate((MULT, INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about `limit` bytes of text each."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each text starts (one more than there are texts). Null is empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (one more than there are texts)."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    inside = solid[1:-1].astype(bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & ((solid[:-2] == 0) | edge[:-1]))
    ends = np.flatnonzero(inside & ((solid[2:] == 0) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each byte range, by one prefix sum over the bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive elements at each place where k of them follow."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * MULT + h[j : j + n]
        return mix(out)
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    span = 1
    while span < w:
        step = min(span, w - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of `size`-word shingles of each lower-cased text; a shorter text is one shingle, an empty one none."""
    starts, ends, first = words(data, offsets)
    h = span_hashes(data, starts, ends, LOWER)
    g = grams(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(g[a : b - size + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            v = np.array([b - a], np.uint64)
            for i in range(a, b):
                v = v * MULT + h[i : i + 1]
            out.append(mix(v))
        else:
            out.append(np.empty(0, np.uint64))
    return out
