"""Where operators keep intermediate tables: the shared folder that the cluster names, so that lost executors take nothing with them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_kept: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Only where that is unset on a local master, as in tests, a folder of our own
    is set: on a cluster, executors could not read each other's files there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/quefrency-{uuid.uuid4().hex}"


def keep(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: cuts lineage and computes it once."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    _kept.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def mark() -> int:
    """The number of tables kept so far, for release()."""
    return len(_kept)


def release(spark: SparkSession, since: int = 0, but_last: bool = False) -> int:
    """Delete what keep() has written in this session since a mark, once results are stored; the last table stays, if asked
    for. Returns how many tables that were."""
    old = _kept[since : len(_kept) - but_last]
    _kept[since : since + len(old)] = []
    for name in old:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)
