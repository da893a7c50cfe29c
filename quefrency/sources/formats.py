"""Recordings as Spark data sources: `spark.read.format("iq")` and `format("mat")` after register().

A partition of `iq` is a block of samples of one file, so a task reads a byte range; filters on path and start leave out
blocks and files before anything is read. A partition of `mat` is a file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quefrency.sources.recordings import mat_variable

_BLOCK = 1 << 16


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listed(path: str, glob: str) -> list[tuple[str, int]]:
    """Path and length of a file, or of a folder's files whose names fit, by path."""
    from pyarrow import fs

    store, inside = _store(path)
    scheme = f"{path.split('://')[0]}://" if "://" in path else ""
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, glob))


_COMPARED = {EqualTo: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, In: lambda v, w: v in w}


class _Pruned(DataSourceReader):
    """Leaves out partitions by filters on their own columns. Spark still applies the filters to what is read."""

    own: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.path, self.options, self.tests = options.get("path"), options, []
        if not self.path:
            raise ValueError("give a path")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.tests = [(f.attribute[0], type(f), f.value) for f in filters if type(f) in _COMPARED and len(f.attribute) == 1 and f.attribute[0] in self.own]
        return filters

    def fits(self, **columns) -> bool:
        return all(c not in columns or _COMPARED[kind](columns[c], value) for c, kind, value in self.tests)


@dataclass
class Block(InputPartition):
    path: str
    start: int
    count: int


class IqReader(_Pruned):
    own = ("path", "start")

    def partitions(self) -> list[Block]:
        block = int(self.options.get("block", _BLOCK))
        if block <= 0:
            raise ValueError("blocks need at least one sample")
        files = [(p, size // 4) for p, size in listed(self.path, self.options.get("pathglobfilter", "*.bin")) if self.fits(path=p)]
        return [Block(p, at, min(block, n - at)) for p, n in files for at in range(0, n, block) if self.fits(start=at)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        store, inside = _store(partition.path)
        with store.open_input_file(inside) as f:
            raw = f.read_at(partition.count * 4, partition.start * 4)
        x = np.frombuffer(raw, "<i2").reshape(-1, 2).astype(np.float32) / np.float32(32768)
        cells = [[partition.path], [partition.start], [x[:, 0]], [x[:, 1]]]
        kinds = pa.string(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["path", "start", "re", "im"])


class IqSource(DataSource):
    """Interleaved little-endian 16-bit I and Q. Options: path, block (samples of a row), pathGlobFilter. Half a sample at the end of a file is left out."""

    @classmethod
    def name(cls) -> str:
        return "iq"

    def schema(self) -> str:
        return "path string, start long, re array<float>, im array<float>"

    def reader(self, schema) -> DataSourceReader:
        return IqReader(self.options)


class MatReader(_Pruned):
    own = ("path",)

    def partitions(self) -> list[Block]:
        return [Block(p, 0, size) for p, size in listed(self.path, self.options.get("pathglobfilter", "*.mat")) if self.fits(path=p)]

    def read(self, partition: Block) -> Iterator[tuple]:
        store, inside = _store(partition.path)
        with store.open_input_file(inside) as f:
            x = mat_variable(f.read(), self.options.get("suffix", "_DE_time"))
        yield partition.path, None if x is None else x.tolist()


class MatSource(DataSource):
    """MAT version 5. Options: path, suffix (of the variable's name), pathGlobFilter. Files without such a variable have a null."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return "path string, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return MatReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let Spark hand filters to Python sources, which these need."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (IqSource, MatSource):
        spark.dataSource.register(source)
