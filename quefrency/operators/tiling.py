"""Rows to windows: leakage-safe blocks with guards, caps by class, whole-group balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quefrency.operators import ranking


def tile(samples: DataFrame, series: str, order: list[str], window: int, per_block: int, guard: int, partial_blocks: bool = False) -> DataFrame:
    """samples with pos, block, k (window in the block) and offset; rows of guards and of incomplete windows go.

    partial_blocks: keep the full windows of a last block that is not full. Positions are found range by range, so that no task
    orders a whole series.
    """
    stride = window * per_block + guard
    x = ranking.by_value(samples, [series], order).withColumnsRenamed({"before": "pos", "total": "n_rows"})
    x = x.withColumn("block", F.expr(f"pos div {stride}")).withColumn("in_block", F.col("pos") % stride).where(F.col("in_block") < window * per_block)
    x = x.withColumn("k", F.expr(f"in_block div {window}")).withColumn("offset", F.col("in_block") % window)
    end = F.col("block") * stride + ((F.col("k") + 1) * window if partial_blocks else F.lit(window * per_block))
    return x.where(end <= F.col("n_rows")).drop("in_block", "n_rows")


def windows(tiled: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """One array a window, in order; windows with null or non-finite samples go."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))
    x = tiled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(ok, F.struct("offset", F.col(value).alias("v"))))).alias("x"))
    return x.where(F.size("x") == size).withColumn("x", F.transform("x", lambda e: e["v"]))


def cap_by_class(frame: DataFrame, y: str, order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each class: a group limit, which Spark pushes below the shuffle."""
    return frame.withColumn("__rn", F.row_number().over(Window.partitionBy(y).orderBy(*order))).where(F.col("__rn") <= cap).drop("__rn")


def group_order(group: str, seed: int):
    """A pseudo-random but reproducible order of groups, the same on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))


def balance_by_groups(frame: DataFrame, group: str, cap: int, seed: int = 2026) -> DataFrame:
    """Whole groups in pseudo-random order until `cap` rows are reached; the crossing group stays. Only group counts are ordered."""
    counts = frame.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return frame.join(ranking.by_hash(counts, [], group_order(group, seed), [group], F.col("__n")).where(F.col("before") < cap).select(group), group, "left_semi")


def decimate(frame: DataFrame, order: list[str], step: int = 2, series: list[str] | None = None) -> DataFrame:
    """Every `step`-th row of each series, after rows with nulls are gone."""
    x = ranking.by_value(frame.na.drop(), series or [], order)
    return x.where(F.col("before") % step == 0).select(*frame.columns)


def zscore(frame: DataFrame, value: str, keys: list[str], out: str = "z") -> DataFrame:
    """Less the mean, by the population deviation where that is not tiny."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return frame.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.when(sd > 1e-9, sd).otherwise(1.0))


def group_id(rec, block, n_blocks: int):
    """Packed group id; a struct of both never collides and is the better key."""
    return rec * n_blocks + block
