"""Drilling telemetry: two files' columns brought to rpm, torque, rop, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quefrency.operators.tiling import decimate


def numeric(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their new names as doubles; what does not parse is null, and rows with nulls go."""
    return frame.select(*(F.expr(f"try_cast(`{a}` as double)").alias(b) for a, b in names.items())).na.drop()


def read_parquet_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Every second row of each file, in the file's order, after rows with nulls are gone."""
    names = {"rpm": "rpm", "tqa": "torque", "rop5": "rop", "dept": "depth"}
    own = spark.read.parquet(path).select(*names, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    parsed = own.select(*(F.expr(f"try_cast(`{a}` as double)").alias(b) for a, b in names.items()), "__file", "__row")
    return decimate(parsed, ["__row"], series=["__file"]).select(*names.values())


def read_csv_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Rows on bottom."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return on_bottom(numeric(raw, {"Rotary Speed (rpm)": "rpm", "Surface Torque (KPa)": "torque", "ROP(1 m)": "rop", "Depth (m)": "depth"}))


def on_bottom(frame: DataFrame) -> DataFrame:
    return frame.where("rpm > 10 and rop > 1 and torque > 0")
