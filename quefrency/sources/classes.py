"""The class of a bearing recording by its file number, as a small table to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File numbers of each class, in the order of class ids.
FILES = {
    "Normal": (97, 98, 99, 100),
    "IR007": (105, 106, 107, 108),
    "IR014": (169, 170, 171, 172),
    "IR021": (209, 210, 211, 212),
    "Ball007": (118, 119, 120, 121),
    "Ball014": (185, 186, 187, 188),
    "Ball021": (222, 223, 224, 225),
    "OR007": (130, 131, 132, 133),
    "OR014": (197, 198, 199, 200),
    "OR021": (234, 235, 236, 237),
}


def bearing_classes(spark: SparkSession) -> DataFrame:
    """file_no, class_label, class_id: one row a file."""
    rows = [(n, label, i) for i, (label, files) in enumerate(FILES.items()) for n in files]
    return spark.createDataFrame(rows, "file_no int, class_label string, class_id int")


def file_number(path: Column) -> Column:
    """97 for .../97.mat; null for other names."""
    return F.regexp_extract(path, r"(\d+)\.mat$", 1).try_cast("int")


def labelled(recordings: DataFrame, number: Column) -> DataFrame:
    """recordings with class_label and class_id; files of no class go."""
    dim = F.broadcast(bearing_classes(recordings.sparkSession))
    return recordings.withColumn("file_no", number).join(dim, "file_no")
