"""Representations as chains of array kernels: windows to frames to descriptors, for many representations in one pass.

A chain's steps are equal where their functions and options are, so what representations have in common (a spectrum, a
cepstrum, all descriptors) is made once a batch of windows, and windows are read once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quefrency.functions import columns, signal


@dataclass(frozen=True)
class Step:
    """A function of an array, with options; equal to another one of the same function and options."""

    f: Callable[..., np.ndarray]
    options: tuple = ()

    @classmethod
    def of(cls, f: Callable[..., np.ndarray], **options) -> Step:
        return cls(f, tuple(sorted(options.items())))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.f(x, **dict(self.options))


def _made(steps: tuple[Step, ...], x: np.ndarray, held: dict) -> np.ndarray:
    if steps and steps not in held:
        held[steps] = steps[-1](_made(steps[:-1], x, held))
    return held[steps] if steps else x


def shape(m: np.ndarray) -> np.ndarray:
    """The shape descriptors of z-scored frames; none of frames of fewer than two values."""
    if m.shape[2] < 2:
        return np.empty((*m.shape[:2], 0))
    return signal.shape_descriptors(signal.znorm(m.reshape(-1, m.shape[2]))).reshape(*m.shape[:2], -1)


def cut(m: np.ndarray, lo: int, hi: int | None = None) -> np.ndarray:
    return m[:, :, lo:hi]


def lifted(m: np.ndarray, family: str, lo: int, hi: int) -> np.ndarray:
    return m[:, :, lo:hi] * signal.lifter_weights(family, lo, hi)


def taken(m: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    return m[:, :, list(at)]


def deviates(m: np.ndarray, least: float) -> np.ndarray:
    """Frames that deviate enough; those with NaN do, as where a Spark column is compared."""
    return ~(m.std(axis=2) < least)


def deviates_surely(m: np.ndarray, least: float) -> np.ndarray:
    return m.std(axis=2) >= least


@dataclass(frozen=True)
class Frames:
    """A representation: steps from windows (a row each) to (windows, frames, values). least: samples of the shortest window that
    has a frame; mask: steps from windows to (windows, frames), the frames that stay; parts: the columns of a window."""

    steps: tuple[Step, ...]
    least: int
    mask: tuple[Step, ...] = ()
    parts: tuple[str, ...] = ("x",)

    def then(self, step: Step) -> Frames:
        return replace(self, steps=(*self.steps, step))

    def of(self, x: np.ndarray, held: dict) -> tuple[np.ndarray, np.ndarray]:
        """Values of all frames of windows, and which of them stay. held: what was made of the same windows before."""
        v = _made(self.steps, x, held)
        keep = np.ones(v.shape[:2], bool)
        if self.mask:
            some = _made(self.mask, x, held)[:, : v.shape[1]]
            keep[:, : some.shape[1]] = some
            keep[:, some.shape[1] :] = False
        return v, keep

    def __call__(self, windows: DataFrame) -> DataFrame:
        """The windows' other columns, frame_id and s of every frame that stays."""
        return described(windows, {"": self}).drop("key")


def _windows(parts: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of windows of one length, some at a time, and the windows as rows; two parts are those of complex samples, and
    windows whose parts differ in length are left out."""
    x = [columns.Lists(p) for p in parts]
    size = np.where(np.all([p.size == x[0].size for p in x], axis=0), x[0].size, -1)
    for n in np.unique(size[size > 0]):
        every = np.flatnonzero(size == n)
        for i in range(0, len(every), columns.ROWS):
            at = every[i : i + columns.ROWS]
            m = [p.matrix(at) for p in x]
            yield at, m[0] if len(m) == 1 else m[0] + 1j * m[1]


_FRAMES = pa.struct([("rep", pa.int32()), ("frame_id", pa.int32()), ("s", columns.VECTOR)])


def _frames(reps: list[Frames], parts: list[pa.Array]) -> pa.Array:
    """Each window's frames under all representations, as a list of (rep, frame_id, s)."""
    row, rep, frame, made = [], [], [], [pa.array([], columns.VECTOR)]
    for at, x in _windows(parts):
        held: dict = {}
        for i, r in enumerate(reps):
            if x.shape[1] >= r.least:
                v, keep = r.of(x, held)
                w, f = np.nonzero(keep)
                row.append(at[w])
                frame.append(f)
                rep.append(np.full(len(f), i))
                s = columns.packed(v[w, f]) if v.shape[2] else pa.nulls(len(f), columns.VECTOR)
                made.append(s)
    whole = lambda a: np.concatenate([np.empty(0, np.int64), *a])
    row = whole(row)
    order = np.argsort(row, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(parts[0])))])
    cells = [pa.array(whole(a)[order], pa.int32()) for a in (rep, frame)]
    own = pa.StructArray.from_arrays([*cells, pa.concat_arrays(made).take(pa.array(order))], fields=list(_FRAMES))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)


def described(windows: DataFrame, reps: dict[str, Frames]) -> DataFrame:
    """The windows' other columns, key (the representation), frame_id and s: all representations in one pass over the windows."""
    names, each = list(reps), list(reps.values())
    parts = each[0].parts
    own = F.arrow_udf(lambda *p: _frames(each, list(p)), "array<struct<rep int, frame_id int, s array<double>>>")
    made = windows.withColumn("__f", own(*(F.col(p).cast("array<double>") for p in parts))).drop(*parts)
    rest = [c for c in made.columns if c != "__f"]
    name = F.array(*map(F.lit, names))[F.col("rep")]
    return made.select(*rest, F.inline("__f")).select(*rest, name.alias("key"), "frame_id", "s")


#: Rows of features -> scores by class, and the classes in their order, of the model by name (`rep:split`).
Head = tuple[Callable[[np.ndarray], np.ndarray], list]


def outcomes(bent: DataFrame, reps: dict[str, Frames], heads: dict[str, Head], kind: DataType, levels: bool = False) -> DataFrame:
    """rep, level, split, severity, y, p, n: how often a label y got p. bent: split, severity, y and windows; a row of it is scored
    by the heads of its split under all representations, and tasks send counts. The largest score wins, the first of equals; p is
    null where there is no head. Levels are frame, and vote and prob if asked for: the label that most frames of a window have,
    the smallest one of ties, and that of the largest mean probability (of scores that are log odds)."""
    names, each, parts = list(reps), list(reps.values()), next(iter(reps.values())).parts
    label = to_arrow_type(kind)

    def scored(s: np.ndarray, keep: np.ndarray, head: Head | None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """level, rows among the windows, places of their labels (-1: none)."""
        w, f = np.nonzero(keep)
        if head is None or not s.shape[2]:
            yield "frame", w, np.full(len(w), -1)
            if levels:
                for level in ("vote", "prob"):
                    yield level, np.unique(w), np.full(len(np.unique(w)), -1)
            return
        z = head[0](s[w, f])
        p = z.argmax(axis=1)
        yield "frame", w, p
        if levels:
            some = np.flatnonzero(keep.any(axis=1))
            votes = np.bincount(w * z.shape[1] + p, minlength=len(s) * z.shape[1]).reshape(len(s), -1)
            yield "vote", some, votes[some].argmax(axis=1)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            odds = np.zeros((*keep.shape, z.shape[1]))
            odds[w, f] = z / z.sum(axis=1, keepdims=True)
            yield "prob", some, odds[some].sum(axis=1).argmax(axis=1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for b in batches:
            split = b.column("split").to_numpy(zero_copy_only=False)
            severity, y = (b.column(c).dictionary_encode() for c in ("severity", "y"))
            levels_, ys = severity.dictionary.to_pylist(), [*y.dictionary.to_pylist(), None]  # a null label is the last one
            of = severity.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ys) + y.indices.fill_null(len(ys) - 1).to_numpy(zero_copy_only=False)
            cells: dict[tuple, np.ndarray] = {}
            for at, x in _windows([b.column(p) for p in parts]):
                at, x = (a[np.argsort(split[at], kind="stable")] for a in (at, x))
                ends, made = np.flatnonzero(np.diff(split[at], prepend=-1, append=-1)), {}
                for name, rep in zip(names, each, strict=True):
                    if x.shape[1] < rep.least:
                        continue
                    v, keep = rep.of(x, made)
                    for i, j in zip(ends[:-1], ends[1:], strict=True):
                        own, k = at[i:j], int(split[at[i]])
                        head = heads.get(f"{name}:{k}")
                        labels = [*head[1], None] if head else [None]
                        for level, w, p in scored(v[i:j], keep[i:j], head):
                            n = np.bincount(of[own[w]] * len(labels) + p % len(labels), minlength=len(levels_) * len(ys) * len(labels))
                            cells[name, level, k] = cells[name, level, k] + n if (name, level, k) in cells else n
            for (name, level, k), n in cells.items():
                labels = [*heads[f"{name}:{k}"][1], None] if f"{name}:{k}" in heads else [None]
                for cell in np.flatnonzero(n).tolist():
                    rest, q = divmod(cell, len(labels))
                    key = name, level, k, levels_[rest // len(ys)], ys[rest % len(ys)], labels[q]
                    held[key] = held.get(key, 0) + int(n[cell])
        rows = [(*key, n) for key, n in held.items()]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), label, label, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["rep", "level", "split", "severity", "y", "p", "n"])

    own = bent.select("split", "severity", "y", *(F.col(p).cast("array<double>").alias(p) for p in parts))
    kind_ = kind.simpleString()
    each_ = own.mapInArrow(counted, f"rep string, level string, split int, severity int, y {kind_}, p {kind_}, n long")
    return each_.groupBy("rep", "level", "split", "severity", "y", "p").agg(F.sum("n").alias("n"))
