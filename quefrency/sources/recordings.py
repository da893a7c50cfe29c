"""Recordings as Spark sources: raw interleaved IQ files and MAT version 5 files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sample rate and carrier by band, in Hz.
BANDS = {"2G": (120e6, 2.44e9), "5G": (200e6, 5.8e9)}


def parse_name(name: Column) -> dict[str, Column]:
    """class_label, band, part, total_parts of a recording's file name; an unknown band is an error."""
    base = F.regexp_replace(name, r"\.bin$", "")
    of = lambda k: F.regexp_extract(base, r"_(\d+)of(\d+)$", k)
    core = F.split(F.regexp_replace(base, r"_\d+of\d+$", ""), "_")
    band, size = F.element_at(core, -1), F.size(core)
    role = (F.element_at(core, 1) == "Parrot") & (size >= 4) & F.get(core, size - 2).isin("control", "video")
    model = F.array_join(F.slice(core, 2, F.greatest(size - 2 - role.cast("int"), F.lit(0))), "_")
    label = F.concat_ws("_", F.element_at(core, 1), model, F.when(role, F.get(core, size - 2)))
    known = F.when(band.isin(*BANDS), band).otherwise(F.raise_error(F.concat(F.lit("unknown band in "), name)).cast("string"))
    number = lambda c: F.when(c != "", c.cast("int"))
    return {"class_label": label, "band": known, "part": number(of(1)), "total_parts": number(of(2))}


def discover(spark: SparkSession, folder: str, band: str = "2G") -> DataFrame:
    """Recordings of a band, by path. Only names and lengths are read. A file whose length is no whole number of samples is left out."""
    if band not in BANDS:
        raise ValueError(f"unknown band {band!r}; known: {sorted(BANDS)}")
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*_{band}*.bin").load(folder).select("path", "length").where("length % 4 = 0")
    name = F.element_at(F.split("path", "/"), -1)
    fs, fc = BANDS[band]
    return f.select("path", *(c.alias(k) for k, c in parse_name(name).items()), F.expr("length div 4").alias("n_samples"), F.lit(fs).alias("fs"), F.lit(fc).alias("fc")).orderBy("path")


def numbered(recordings: DataFrame) -> DataFrame:
    """recordings with rec_id (by path) and class_id (by the first path of each class): one row a file, so one task orders them."""
    first = Window.partitionBy("class_label")
    one = Window.orderBy("__first")
    x = recordings.withColumn("__first", F.min("path").over(first))
    return x.withColumn("class_id", F.dense_rank().over(one) - 1).withColumn("rec_id", F.row_number().over(Window.orderBy("path")) - 1).drop("__first")


def read_iq_windows(windows: DataFrame, path: str = "path", start: str = "start", count: str = "count") -> DataFrame:
    """windows with re and im: `count` samples from sample `start` of each file, as floats in -1 .. 1.

    Only those bytes are read, through a file system that pyarrow opens (local, S3, GCS, HDFS). A negative start, a count
    that is not positive, or a range beyond the file is an error.
    """
    names = windows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            re, im = [], []
            for uri, at, n in zip(b[path], b[start], b[count], strict=True):
                if at < 0 or n <= 0:
                    raise ValueError("windows start at 0 or later and hold a sample at least")
                store, inside = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")
                with store.open_input_file(inside) as f:
                    raw = f.read_at(int(n) * 4, int(at) * 4)
                if len(raw) < n * 4:
                    raise ValueError(f"{uri} ends before sample {at + n}")
                x = np.frombuffer(raw, "<i2").reshape(-1, 2).astype(np.float32) / np.float32(32768)
                re.append(x[:, 0])
                im.append(x[:, 1])
            yield b.assign(re=re, im=im)[[*names, "re", "im"]]

    return windows.mapInPandas(run, f"{kinds}, re array<float>, im array<float>")


def read_iq(spark: SparkSession, folder: str, block: int = 1 << 16, glob: str = "*.bin") -> DataFrame:
    """path, start, re, im: blocks of samples. A task reads its own byte ranges, so files may be of any size."""
    if block <= 0:
        raise ValueError("blocks need at least one sample")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.expr("length div 4").alias("n")).where("n > 0")
    each = files.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))).alias("start"))
    ranges = each.select("path", "start", F.least(F.lit(block), F.col("n") - F.col("start")).alias("count"))
    return read_iq_windows(ranges.repartition("path", "start")).drop("count")


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # small element: size and data in the tag
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == 15 else -size % 8)


#: Number formats of MAT version 5 by type code.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def mat_variable(content: bytes, suffix: str = "_DE_time") -> np.ndarray | None:
    """The first numeric array of a MAT version 5 file whose name ends in suffix, flattened."""
    order = "<" if content[126:128] == b"IM" else ">"
    for kind, data in _elements(content[128:], order):
        if kind == 15:
            kind, data = next(_elements(zlib.decompress(data), order), (0, b""))
        if kind != 14:
            continue
        parts = list(_elements(data, order))
        if len(parts) >= 4 and parts[2][1].decode("latin1").endswith(suffix):
            return np.frombuffer(parts[3][1], order + _NUMBERS[parts[3][0]]).astype(float)
    return None


def read_mat(spark: SparkSession, folder: str, suffix: str = "_DE_time") -> DataFrame:
    """path, x: the named variable of every MAT file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "x": [mat_variable(c, suffix) for c in b["content"]]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(folder).select("path", "content").mapInPandas(run, "path string, x array<double>")
