"""Leakage-safe splits as joins: roles are decided on distinct groups, and rows follow by a semi join's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.operators import ranking
from quefrency.operators.tiling import group_order


def grouped_split(frame: DataFrame, group: str, test_size: float = 0.3, seed: int = 2026) -> DataFrame:
    """frame with role train or test, a role for each group; the number of test groups is rounded half to even, one at least."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    g = ranking.by_hash(frame.select(group).distinct(), [], group_order(group, seed), [group])
    g = g.select(group, F.when(F.col("before") < F.greatest(F.lit(1), F.bround(F.lit(test_size) * F.col("total"))), "test").otherwise("train").alias("role"))
    return frame.join(g, group)


def grouped_kfold(frame: DataFrame, group: str, n_splits: int = 5, seed: int = 2026) -> DataFrame:
    """frame with fold: groups div k in each, and the rest in the last."""
    if n_splits < 2:
        raise ValueError("two folds at least")
    g = ranking.by_hash(frame.select(group).distinct(), [], group_order(group, seed), [group])
    size = F.greatest(F.floor(F.col("total") / n_splits), F.lit(1))
    return frame.join(g.select(group, F.least(F.floor(F.col("before") / size), F.lit(n_splits - 1)).cast("int").alias("fold")), group)


def day_split(frame: DataFrame, day: str, train: list | None = None, test: list | None = None) -> DataFrame:
    """frame with role by day: given lists, which must be disjoint, or the first half of the days (as strings) for training."""
    if (train is None) != (test is None):
        raise ValueError("give both lists of days or none")
    d = F.col(day).cast("string")
    if train is not None:
        if not train or not test or {*map(str, train)} & {*map(str, test)}:
            raise ValueError("days must be disjoint and not empty")
        role = F.when(d.isin([str(x) for x in train]), "train").when(d.isin([str(x) for x in test]), "test")
        return frame.withColumn("role", role).where("role is not null")
    days = frame.select(d.alias("__day")).distinct()
    days = ranking.running(days, [], F.substring("__day", 1, 7), ["__day"])
    days = days.select("__day", F.when(F.col("before") < F.greatest(F.lit(1), F.floor(F.col("total") / 2)), "train").otherwise("test").alias("role"))
    return frame.join(days, d == F.col("__day")).drop("__day")


def receiver_split(frame: DataFrame, receiver: str, train: list | None = None, test: list | None = None, test_size: float = 0.5, seed: int = 2026) -> DataFrame:
    """As grouped_split over receivers, or by given lists."""
    return grouped_split(frame, receiver, test_size, seed) if train is None and test is None else day_split(frame, receiver, train, test)


def leakage_audit(split: DataFrame, axes: list[str]) -> DataFrame:
    """For each axis: distinct values on either side, how many are on both, and the first ten of them."""
    out = None
    for a in axes:
        side = split.groupBy(F.col(a).cast("string").alias("v")).agg(F.max(F.when(F.col("role") == "train", 1).otherwise(0)).alias("tr"), F.max(F.when(F.col("role") == "test", 1).otherwise(0)).alias("te"))
        both = F.when((F.col("tr") == 1) & (F.col("te") == 1), F.col("v"))
        first = side.where("tr = 1 and te = 1").orderBy("v").limit(10).agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("first"))
        one = side.agg(F.sum("tr").alias("train_values"), F.sum("te").alias("test_values"), F.count(both).alias("overlap")).crossJoin(F.broadcast(first)).select(F.lit(a).alias("axis"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def raw_overlap(spans: DataFrame) -> DataFrame:
    """Pairs of a training and a test interval [start, end) of one series that overlap, as a count by series; series without
    any are left out. Empty intervals overlap nothing.

    Nothing is paired: a test interval overlaps the training intervals that start before its end, less those that end no
    later than its start. Both are running sums over all ends in order, so the work grows with the number of intervals,
    however long or dense they are.
    """
    own = spans.where(F.col("start") < F.col("end"))
    event = lambda kind, at, turn, weight: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at"), F.lit(turn).alias("turn"), F.lit(weight).alias("weight"))
    # At one place, a start comes behind a test interval's end, and an end before a test interval's start.
    train, test = F.array(event("starts", "start", 1, 1), event("ends", "end", 0, 1)), F.array(event("starts", "end", 0, 0), event("ends", "start", 1, 0))
    e = own.where(F.col("role").isin("train", "test")).select("series", F.explode(F.when(F.col("role") == "train", train).otherwise(test)).alias("e")).select("series", "e.*")
    met = ranking.by_value(e, ["series", "kind"], ["at", "turn"], F.col("weight")).where("weight = 0")
    n = met.groupBy("series").agg(F.sum(F.when(F.col("kind") == "starts", F.col("before")).otherwise(-F.col("before"))).alias("overlaps"))
    return n.where("overlaps > 0")


def stratified_inner(frame: DataFrame, y: str, key: str, share: float = 0.75, seed: int = 2026) -> DataFrame:
    """frame with role inner or val: in each class the first max(1, floor(share n)) rows of a pseudo-random order are inner."""
    x = ranking.by_hash(frame, [y], group_order(key, seed), [key])
    cut = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("total")))
    return x.withColumn("role", F.when(F.col("before") < cut, "inner").otherwise("val")).drop("before", "total")
