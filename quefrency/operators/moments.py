"""Count, mean and scatter matrix of vectors by key, in one Arrow pass: tasks send one row a key, merged about their means."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quefrency.functions import columns


def merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, scatter) of two parts together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def of(m: np.ndarray) -> tuple:
    mean = m.mean(axis=0)
    return len(m), mean, (m - mean).T @ (m - mean)


def deviation(n: int, mean: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Population deviation of each feature; 1 where it is nothing but the rounding of a constant's parts."""
    std = np.sqrt(np.diag(scatter) / n)
    return np.where(std > 1e-13 * np.maximum(np.abs(mean), 1e-300), std, 1.0)


def stacked(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(float)


def by_groups(batch: pa.RecordBatch, names: list[str], s: str = "s") -> Iterator[tuple[tuple, np.ndarray]]:
    """Values of the columns `names`, and the matrix of the arrays s of their rows, for each such group of an Arrow batch.
    Rows with a null among them are left out."""
    x, code, values = columns.Lists(batch.column(s)), np.zeros(batch.num_rows, np.int64), []
    ok = x.size >= 0
    for name in names:
        d = batch.column(name).dictionary_encode()
        at = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ok, code = ok & (at >= 0), code * len(d.dictionary) + at
        values.append(d.dictionary.to_pylist())
    rows = np.flatnonzero(ok)
    rows = rows[np.argsort(code[rows], kind="stable")]
    for at in np.split(rows, np.flatnonzero(np.diff(code[rows])) + 1) if len(rows) else []:
        place, key = int(code[at[0]]), []
        for v in reversed(values):
            place, i = divmod(place, len(v))
            key.append(v[i])
        yield tuple(reversed(key)), x.matrix(at)


def _passed(frame: DataFrame, run: Callable[[Iterator], Iterator[pd.DataFrame]], schema: str, arrow: bool) -> DataFrame:
    """The rows that run makes of pandas frames, or of Arrow batches."""
    if not arrow:
        return frame.mapInPandas(run, schema)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name].to_list(), f.type) for f in kinds], schema=kinds)

    return frame.mapInArrow(made, schema)


def _met(parts: DataFrame, keys: list[str], add: Callable[[list[dict]], tuple], schema: str) -> list[Row]:
    """A row a key on the driver, of what add(its rows) gives. Rows of a key meet in one partition, and a partition's keys are
    added in one call: a call for each key would cost more than its few rows."""
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(tuple(r[k] for k in keys), []).append(r)
        yield pd.DataFrame([(*key, *add(own)) for key, own in held.items()], columns=names)

    return _passed(parts.repartition(*keys), run, schema, True).collect()


def grouped(frame: DataFrame, keys: dict[str, str], each: Callable[[pd.DataFrame], Iterable[tuple[tuple, np.ndarray]]], arrow: bool = False) -> dict[tuple, tuple]:
    """key -> (n, mean, scatter), of the matrices that each(batch) gives by key. keys: names and types. One row a key meets on
    the driver. arrow: batches are Arrow's, whose arrays are read without an object a row."""
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", n long, mean array<double>, scatter array<double>"
    names = [*keys, "n", "mean", "scatter"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for b in batches:
            for key, m in each(b):
                if len(m):
                    held[key] = merged(held[key], of(m)) if key in held else of(m)
        yield pd.DataFrame([(*k, n, mean, scatter.ravel()) for k, (n, mean, scatter) in held.items()], columns=names)

    def add(own: list[dict]) -> tuple:
        total = None
        for r in sorted(own, key=lambda r: (r["n"], *r["mean"])):
            part = (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1))
            total = merged(total, part) if total else part
        return total[0], total[1], total[2].ravel()

    rows = _met(_passed(frame, run, schema, arrow), list(keys), add, schema)
    return {tuple(r[k] for k in keys): (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1)) for r in sorted(rows, key=lambda r: tuple(str(r[k]) for k in keys))}


def summed(frame: DataFrame, keys: dict[str, str], each: Callable[[pd.DataFrame], Iterable[tuple[tuple, np.ndarray]]], arrow: bool = False) -> dict[tuple, np.ndarray]:
    """key -> sum of the vectors that each(batch) gives by key, all of a key of one length. Tasks send one row a key, and one
    row a key meets on the driver. keys: names and types. arrow: as of grouped()."""
    names = [*keys, "v"]
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", v binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, v in each(b):
                held[key] = held[key] + v if key in held else np.asarray(v, float)
        yield pd.DataFrame([(*k, v.tobytes()) for k, v in held.items()], columns=names)

    def add(own: list[dict]) -> tuple:
        return (np.sum([np.frombuffer(v) for v in sorted(r["v"] for r in own)], axis=0).tobytes(),)  # in an order of their own, whatever task sent them

    rows = _met(_passed(frame, run, schema, arrow), list(keys), add, schema)
    return {tuple(r[k] for k in keys): np.frombuffer(r["v"]) for r in rows}


def spread(frame: DataFrame) -> DataFrame:
    """The frame dealt to at least as many partitions as there are cores. Rows that are small but costly in Python would else
    meet in the few partitions that their bytes fill."""
    spark = frame.sparkSession
    return frame.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread_by(frame: DataFrame, key: str, s: str = "s") -> DataFrame:
    """Rows that every step of a fit reads, dealt to a partition a core by ranges of their key, and of a hash inside it. A task
    sends its sums for each model, so what a step shuffles is about a row a model, and not one for each model and task."""
    return frame.repartitionByRange(frame.sparkSession.sparkContext.defaultParallelism, key, F.xxhash64(s))


def dealt(frame: DataFrame) -> DataFrame:
    """As spread_by(), for rows from which all models of a fit learn: a partition a core."""
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)
