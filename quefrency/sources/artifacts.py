"""Result documents: nested JSON to tidy rows of leaves and back, and tolerance checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A step of a path: a key, plain or in quotes and brackets, or a place in an array.
_STEP = re.compile(r'\.?([^.\[\]"]+)|\["((?:[^"\\]|\\.)*)"\]|\[(\d+)\]')


class _Literal(str):
    """A number as it is written."""


def _walk(value, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            plain = k and not re.search(r'[.\[\]"]', k)
            step = f"[{json.dumps(k, ensure_ascii=False)}]" if not plain else f".{k}" if path else k
            yield from _walk(v, path + step)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}[{i}]")
    else:
        yield path, str(value) if isinstance(value, _Literal) else json.dumps(value, ensure_ascii=False)


def _leaves(texts: pd.Series) -> pd.Series:
    read = lambda t: json.loads(t, parse_float=_Literal, parse_int=_Literal, parse_constant=_Literal)
    return pd.Series([None if t is None else [{"path": p, "value": v} for p, v in _walk(read(t), "")] for t in texts], dtype=object)


def leaves(text: Column) -> Column:
    """Array of (path, value) of a JSON document's leaves, in order: paths as in `a.b[0].c`, keys with dots, brackets or quotes
    as in `a["b.c"]`; values as JSON, numbers as they are written. Empty objects and arrays are leaves. Null gives null; what
    is no JSON is an error."""
    return F.pandas_udf(_leaves, "array<struct<path:string,value:string>>")(text)


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    """file, path, value: every leaf of JSON documents, however deep."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), leaves(F.col("value")).alias("leaf"))
    return docs.select("file", F.inline("leaf"))


def _put(root: dict, path: str, value) -> None:
    steps = [int(n) if n else json.loads(f'"{q}"') if q is not None and not k else k for k, q, n in ((m[1], m[2], m[3]) for m in _STEP.finditer(path))]
    at, keys = root, ["", *steps]
    for a, b in pairwise(keys):
        at = at.setdefault(a, {"list": isinstance(b, int), "of": {}})["of"]
    at[keys[-1]] = {"leaf": value}


def _built(node: dict):
    if "leaf" in node:
        return node["leaf"]
    return [_built(node["of"][k]) for k in sorted(node["of"])] if node["list"] else {k: _built(v) for k, v in node["of"].items()}


def _documents(paths: pd.Series, values: pd.Series) -> pd.Series:
    out = []
    for p, v in zip(paths, values, strict=True):
        root: dict = {}
        for path, value in zip(p, v, strict=True):
            _put(root, path, json.loads(value))
        out.append(json.dumps(_built(root[""]) if root else {}, ensure_ascii=False))
    return pd.Series(out)


def documents(rows: DataFrame, key: str = "file") -> DataFrame:
    """key, text: the JSON document of each key's leaves (path, value). Keys of objects are in the order of their paths; gaps in
    arrays close. A document's leaves meet in one row, as its text does."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("l"))
    return held.select(key, F.pandas_udf(_documents, "string")(F.col("l.path"), F.col("l.value")).alias("text"))


def write_documents(rows: DataFrame, folder: str, key: str = "file") -> None:
    """A folder of JSON lines, a document of documents() each."""
    documents(rows, key).select(F.col("text").alias("value")).write.text(folder)


def check(got: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """want (value, tolerance) against got (value): ok where they differ by the tolerance at most; a missing value is not ok."""
    g = got.select(*keys, F.col("value").alias("got"))
    return want.join(g, keys, "left").withColumn("ok", F.coalesce(F.abs(F.col("got") - F.col("value")) <= F.col("tolerance"), F.lit(False)))
