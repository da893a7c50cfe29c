"""Running sums and ranks over large groups in two levels: sums of ranges of the order first, then sums inside each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

#: Hexadecimal digits of a hash that make a range; ranges of numbers, and values that their ends are chosen from, on average.
DIGITS, RANGES, SAMPLE = 3, 256, 4096

#: Rows of a key that one task orders: keys of no more have no ranges, and ends of ranges, 2 kB a key of more rows, are broadcast.
ALONE = 1 << 16


def running(frame: DataFrame, keys: list[str], part: Column, order: list, weight: Column | None = None, before: str = "before", total: str = "total") -> DataFrame:
    """frame with `before`, the weight (rows: 1) of what comes earlier in the order among rows of the same keys, and `total`.

    part: a range of the order, never falling along it. Only ranges' sums (a row each) are summed by one task a key. What a
    range begins with is a row before its own ones, so that rows are shuffled once, to where they are ordered, and never joined.
    Rows whose keys are null stay, as a key of their own.
    """
    x = frame.withColumn("__part", part).withColumn("__w", weight if weight is not None else F.lit(1))
    sums = x.groupBy(*keys, "__part").agg(F.sum("__w").alias("__s"))
    level = Window.partitionBy(*(keys or [F.lit(0)]))
    begin = F.coalesce(F.sum("__s").over(level.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "__part", begin.alias("__w"), F.sum("__s").over(level).alias("__t"), F.lit(0).alias("__own"))
    both = x.withColumn("__own", F.lit(1)).unionByName(sums, allowMissingColumns=True)
    inner = Window.partitionBy(*keys, "__part").orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn(total, F.first("__t").over(inner)).withColumn(before, F.sum("__w").over(inner))
    return out.where("__own = 1").select(*frame.columns, total, before)


def by_hash(frame: DataFrame, keys: list[str], hashed: Column, order: list | None = None, weight: Column | None = None) -> DataFrame:
    """running() in the order of a hash in hexadecimal digits, then of `order`."""
    x = frame.withColumn("__h", hashed)
    return running(x, keys, F.substring("__h", 1, DIGITS), ["__h", *(order or [])], weight).drop("__h")


def splitters(frame: DataFrame, keys: list[str], v: Column, order: list[str], out: str = "__ends", over: int = 0) -> DataFrame:
    """keys (as __e0, __e1, ...) and the sorted inner ends of RANGES ranges that about as many rows of the key lie in each, for
    keys of over so many rows.

    They are taken from rows that a hash of the order's columns picks, about SAMPLE of each key: the same ones on any
    partitioning, so that a plan may compute them twice.
    """
    names = [F.col(k).alias(f"__e{i}") for i, k in enumerate(keys)]
    x = frame.select(*names, v.alias("__v"), F.xxhash64(*order).alias("__h"))
    held = [f"__e{i}" for i in range(len(keys))]
    size = x.groupBy(*held).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / SAMPLE)).cast("long").alias("__m"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > over)
    same = F.lit(True)
    sized = size.select(*(F.col(k).alias(f"{k}_") for k in held), "__m")
    for k in held:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    x = x.join(F.broadcast(sized) if over else sized, same) if keys else x.crossJoin(F.broadcast(sized))
    some = x.where(F.col("__v").isNotNull() & (F.pmod("__h", "__m") == 0)).groupBy(*held).agg(F.sort_array(F.collect_list("__v")).alias("__s"))
    return some.select(*held, F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.get("__s", F.floor(i * F.size("__s") / RANGES).cast("int"))).alias(out))


def by_value(frame: DataFrame, keys: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """running() in the order of columns. If the first one is a number or a time, its ranges hold about as many rows each,
    whatever its distribution, and keys of few rows are one range; if not, they are cut by its first two letters."""
    first = F.col(order[0])
    kind = frame.schema[order[0]].dataType
    if not isinstance(kind, NumericType | TimestampType | DateType):
        return running(frame, keys, F.substring(first.cast("string"), 1, 2), order, weight)
    v = (F.unix_micros(first.cast("timestamp")) if isinstance(kind, TimestampType | DateType) else first).cast("double")
    v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
    ends = splitters(frame, keys, v, order, over=ALONE)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__e{i}"))
    x = frame.join(F.broadcast(ends), same, "left")
    # How many ends lie at or below the value, by halving.
    halves = F.array(*(F.lit(RANGES >> k) for k in range(1, RANGES.bit_length())))
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("__ends", at + step - 1) <= v, at + step).otherwise(at))
    part = F.when(first.isNull(), -1).when(v.isNull(), RANGES + 1).otherwise(below)
    # Ends have served once a row has its range: they are not shuffled with it.
    x = x.withColumn("__range", part).drop("__ends", *(f"__e{i}" for i in range(len(keys))))
    return running(x, keys, F.col("__range"), order, weight).drop("__range")
