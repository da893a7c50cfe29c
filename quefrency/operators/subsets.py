"""Ablation and forward selection of descriptors, as one experiment for all subsets.

Descriptors of all frames are made once. Class moments of all descriptors come from one pass; those of any subset are
principal submatrices, so that models of all subsets and splits are fitted and scored together: a Newton step is one pass
for all of them, and all subsets' predictions of a test frame are one row. The number of jobs does not grow with the
number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quefrency.functions import columns
from quefrency.operators import experiments, heads, metrics, moments
from quefrency.operators.discriminant import ClassMoments
from quefrency.operators.experiments import Design, Representation

#: A subset is a tuple of places of descriptors; what each split looks at, by name.
Chosen = dict[int, dict[str, tuple[int, ...]]]


class Trial:
    """Training and test frames of all splits under one representation, kept while subsets are tried. Use with `with`."""

    def __init__(self, windows: DataFrame, base: Representation, design: Design, distort=experiments.distorted):
        if design.head not in ("nearest", "logistic"):
            raise ValueError(f"no subsets for the head {design.head!r}")
        self.design = design
        roles = experiments.design_roles(windows, design)
        train = base(windows.join(experiments.parts(roles, "train"), "grp")).withColumn("split", F.explode("parts"))
        key = F.col("split").cast("string").alias("key")
        self.train = moments.spread_by(train.select(key, "y", "s"), "key").persist(StorageLevel.MEMORY_AND_DISK)
        self.test = base(distort(windows, roles, design)).select("split", "severity", "y", "s").persist(StorageLevel.MEMORY_AND_DISK)
        self.moments: dict[str, ClassMoments] = experiments._models(self.train, lambda k: [(k, lambda s: s, None)])
        self.weights: dict[str, np.ndarray] = {}  # of the last models, by split and subset

    def __enter__(self) -> Trial:
        return self

    def __exit__(self, *_) -> None:
        self.train.unpersist()
        self.test.unpersist()

    def _forms(self, chosen: Chosen) -> dict[str, list[tuple[str, list[int], object]]]:
        """By split: name, places and kernel of each subset's class distances (their logarithms, for the logistic head)."""
        logs, out = self.design.head == "logistic", {}
        for split, subsets in chosen.items():
            whole = self.moments.get(str(split))
            if whole is not None:
                parts = [(name, list(at), whole.part(list(at))) for name, at in subsets.items()]
                out[str(split)] = [(name, at, m.kernel(m.ridge_forms(self.design.ridge), logs=logs)) for name, at, m in parts]
        return out

    def scores(self, chosen: Chosen, start: dict[int, np.ndarray] | None = None) -> DataFrame:
        """rep (the subset's name), split, severity, f1, accuracy: two shuffles whatever the number of subsets, and for the
        logistic head one pass a Newton step. start: weights that a split's logistic heads begin with."""
        forms = self._forms(chosen)
        labels = {k: list(m.classes) for k, m in self.moments.items()}
        order = sorted({name for subsets in chosen.values() for name in subsets})
        if self.design.head == "logistic":
            names = {k: [f"{k}:{name}" for name, _, _ in v] for k, v in forms.items()}
            views = {k: [(n, _view(at, kernel), None) for n, (_, at, kernel) in zip(names[k], v, strict=True)] for k, v in forms.items()}
            begin = {n: w for k, w in (start or {}).items() for n in names.get(str(k), [])}
            models = heads.fit_logistic(self.train, lambda k: views.get(k, []), start=begin)
            self.weights = {n: m.w for n, m in models.items()}
        else:
            models = {}
        place, kind = {name: i for i, name in enumerate(order)}, self.train.schema["y"].dataType
        names = ["split", "severity", "at", "y", "p", "n"]
        types = [pa.int32(), pa.int32(), pa.int32(), to_arrow_type(kind), pa.int32(), pa.int64()]

        def best(k: str, name: str, x: np.ndarray) -> np.ndarray:
            if not models:
                return x.argmin(axis=1)
            head = models[f"{k}:{name}"]
            return np.array([labels[k].index(v) for v in head.labels])[head.margins(head.design(x)).argmax(axis=1)]

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, int] = {}
            for b in batches:
                unit, y = (b.column(c).dictionary_encode() for c in ("split", "y"))
                severity, split, label = b.column("severity").to_numpy(zero_copy_only=False), *(d.indices.fill_null(-1).to_numpy(zero_copy_only=False) for d in (unit, y))
                x, ys = columns.Lists(b.column("s")), [*y.dictionary.to_pylist(), None]  # a null label is the last one
                for i, k in enumerate(unit.dictionary.to_pylist()):
                    rows = np.flatnonzero((split == i) & (x.size >= 0))
                    m = x.matrix(rows) if len(rows) and str(k) in forms else None
                    for name, at, kernel in forms[str(k)] if m is not None else []:
                        p, wide = best(str(k), name, kernel(m[:, at])), len(labels[str(k)])
                        cells, n = np.unique((severity[rows].astype(np.int64) * len(ys) + label[rows] % len(ys)) * wide + p, return_counts=True)
                        for cell, count in zip(cells.tolist(), n.tolist(), strict=True):
                            key = k, cell // wide // len(ys), place[name], ys[cell // wide % len(ys)], cell % wide
                            held[key] = held.get(key, 0) + count
            rows = [(*key, n) for key, n in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        # Predictions are places among a split's classes; each task sends their counts, which get their names when they are few.
        each = self.test.mapInArrow(counted, f"split int, severity int, at int, y {kind.simpleString()}, p int, n long")
        counts = each.groupBy("split", "severity", "at", "y", "p").agg(F.sum("n").alias("n"))
        named = F.create_map(*(F.lit(x) for i, name in enumerate(order) for x in (i, name)))[F.col("at")]
        which = F.create_map(*(x for k, v in labels.items() for x in (F.lit(int(k)), F.array(*(F.lit(c).cast(kind) for c in v)))))[F.col("split")]
        rows = counts.select(named.alias("rep"), "split", "severity", "y", F.element_at(which, F.col("p") + 1).alias("p"), "n")
        return metrics.macro_f1(rows, ["rep", "split", "severity"], weight="n").withColumnRenamed("macro_f1", "f1")


def _view(at: list[int], kernel):
    return lambda s: kernel(s[:, at])


def ablation(windows: DataFrame, base: Representation, names: list[str], design: Design = Design(), distort=experiments.distorted) -> DataFrame:  # noqa: B008
    """rep (full, or without_ a descriptor), split, severity, f1, accuracy: all descriptors, and all but each one."""
    every = tuple(range(len(names)))
    subsets = {"full": every} | {f"without_{n}": tuple(i for i in every if i != j) for j, n in enumerate(names)}
    with Trial(windows, base, design, distort) as t:
        out = t.scores({k: subsets for k in range(design.splits)})
        rows = out.collect()  # one row a subset, split and severity
        return windows.sparkSession.createDataFrame(rows, out.schema)


def forward(windows: DataFrame, base: Representation, names: list[str], design: Design = Design(), steps: int | None = None, distort=experiments.distorted, least: int = 3) -> DataFrame:  # noqa: B008
    """split, step (from 1), descriptor, under: greedy selection on each split by itself. A step adds the descriptor whose
    model has the largest mean score at severities from `least` on, the first one of ties; all splits and candidates of a
    step are tried together."""
    chosen: dict[int, tuple[int, ...]] = {k: () for k in range(design.splits)}
    out: list[tuple] = []
    start: dict[int, np.ndarray] = {}
    with Trial(windows, base, design, distort) as t:
        for step in range(1, min(steps or len(names), len(names)) + 1):
            tried = {k: {str(j): (*at, j) for j in range(len(names)) if j not in at} for k, at in chosen.items()}
            under = metrics.under_fir(t.scores(tried, start), ["split", "rep"], least).collect()  # one row a split and candidate
            for split in chosen:
                found = [(r["under"] if r["under"] is not None else -1.0, -int(r["rep"])) for r in under if r["split"] == split]
                if found:
                    value, place = max(found)
                    chosen[split] = (*chosen[split], -place)
                    out.append((split, step, names[-place], float(value)))
                    if f"{split}:{-place}" in t.weights:
                        start[split] = t.weights[f"{split}:{-place}"]
    return windows.sparkSession.createDataFrame(out, "split int, step int, descriptor string, under double")
