"""Tests and intervals over grouped moments and ranks."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quefrency.operators import ranking


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2)


def wilcoxon_exact_p(w_plus: float, n: int) -> float:
    """P(W+ >= w_plus) without ties: subset sums of 1 .. n, by counting."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] += ways[:-k].copy()
    return float(ways[int(np.ceil(w_plus)) :].sum() / 2.0**n)


def normal_sf(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def average_rank(x: DataFrame, value: str, keys: list[str], out: str = "rank") -> DataFrame:
    """Ranks by keys, tied values sharing their mean rank. Values are counted before they are ordered, range by range."""
    n = x.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    r = ranking.by_value(n, keys, [value], F.col("ties"))
    return x.join(r.select(*keys, value, "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias(out)), [*keys, value])


def chi2_tail(x: str, df: str) -> Column:
    """Upper tail of a chi-square variable, for the few rows of a finished statistic."""
    return F.pandas_udf(lambda a, b: pd.Series([None if pd.isna(u) or pd.isna(v) else chi2_p(float(u), float(v)) for u, v in zip(a, b, strict=True)], dtype=float), "double")(x, df)


def kruskal(x: DataFrame, y: str, value: str, keys: list[str]) -> DataFrame:
    """Tie-corrected H by keys, with k, n, eta2 = (H - k + 1) / (n - k) and p, its chi-square tail with k - 1 degrees."""
    r = average_rank(x, value, keys)
    by = r.groupBy(*keys, y).agg(F.sum("rank").alias("rs"), F.count(F.lit(1)).alias("ni"))
    h = by.groupBy(*keys).agg(F.sum(F.col("rs") * F.col("rs") / F.col("ni")).alias("q"), F.sum("ni").alias("n"), F.count(F.lit(1)).alias("k"))
    t = r.select(*keys, value, F.col("ties").cast("double").alias("t")).distinct().groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("t"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    out = h.join(t, keys) if keys else h.crossJoin(t)
    return out.select(*keys, "n", "k", (raw / (1 - F.col("t") / (n * n * n - n))).alias("h")).withColumn("eta2", (F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).withColumn("__df", F.col("k") - 1).withColumn("p", chi2_tail("h", "__df")).drop("__df")


def anova(x: DataFrame, y: str, value: str, keys: list[str]) -> DataFrame:
    """One-way F and eta2 = SSB / SST, from moments by class."""
    by = x.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("ni"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by = by.withColumn("gm", F.sum(F.col("ni") * F.col("m")).over(w) / F.sum("ni").over(w))
    s = by.groupBy(*keys).agg(F.sum(F.col("ni") * F.pow(F.col("m") - F.col("gm"), F.lit(2.0))).alias("ssb"), F.sum(F.col("ni") * F.col("v")).alias("ssw"), F.sum("ni").alias("n"), F.count(F.lit(1)).alias("k"))
    return s.select(*keys, ((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f"), (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta2"))


def wilcoxon_w(pairs: DataFrame, diff: str, keys: list[str]) -> DataFrame:
    """W+, the number of nonzero differences, and ties: the sum of t^3 - t over groups of t equal magnitudes."""
    d = pairs.where(F.col(diff) != 0).withColumn("__a", F.abs(diff))
    r = average_rank(d, "__a", keys)
    t = F.col("ties").cast("double")
    return r.groupBy(*keys).agg(F.sum(F.when(F.col(diff) > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.count(F.lit(1)).alias("n"), F.sum(t * t - 1).alias("ties"))


def wilcoxon_p(w_plus: float, n: int, ties: float = 0.0, exact_up_to: int = 50) -> float:
    """One-sided p of W+: exact for up to 50 untied differences, else by the normal approximation with its tie correction."""
    if not n:
        return 1.0
    if not ties and n <= exact_up_to:
        return wilcoxon_exact_p(w_plus, n)
    return normal_sf((w_plus - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24))


def draw(n, *parts):
    """A reproducible number in 0 .. n - 1 from a hash of parts, the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") % n


def bootstrap_means(values: DataFrame, value: str, repeats: int, seed: int, keys: list[str]) -> DataFrame:
    """Mean of each resample, by keys. values is a small table with 0-based i: one row a split, not a row of data."""
    n = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    r = n.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r")).select(*keys, "n", "r", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("j"))
    r = r.withColumn("i", draw(F.col("n"), F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string")))
    return r.join(values, [*keys, "i"]).groupBy(*keys, "r").agg(F.avg(value).alias("mean"))


def paired_cells(pred: DataFrame, keys: list[str] = (), y: str = "y", a: str = "a", b: str = "b") -> DataFrame:
    """keys, y, a, b, n: how many rows have each true label with each pair of predictions; at most classes^3 rows a key."""
    return pred.groupBy(*keys, F.col(y).alias("y"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def hashed_resamples(pred: DataFrame, order: str, repeats: int, seed: int) -> DataFrame:
    """r, y, a, b, n: cells of each resample of the rows, drawn by a hash of resample and place (rows numbered in their order)."""
    x = ranking.by_value(pred.select(order, "y", "a", "b"), [], [order])
    r = x.select("total", F.col("before").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r"))
    r = r.select("r", draw(F.col("total"), F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string")).alias("before"))
    return r.groupBy("r", "before").agg(F.count(F.lit(1)).alias("m")).join(x, "before").groupBy("r", "y", "a", "b").agg(F.sum("m").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


#: Below which share of 2^32 a draw is 0, 1, 2, ...: the distribution function of counts with mean 1, up to 12.
POISSON = np.cumsum([exp(-1 - lgamma(k + 1)) for k in range(13)])


def poisson_weights(ids: np.ndarray, repeats: int, seed: int) -> np.ndarray:
    """(rows, repeats): how often each row is drawn in each resample, independent counts with mean 1 by a hash of row and resample."""
    own = _mixed((ids.astype(np.int64) % (1 << 32)).astype(np.uint32) ^ np.uint32(seed % (1 << 32)))
    step = (np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x9E3779B9) % np.uint64(1 << 32)).astype(np.uint32)
    return np.searchsorted(POISSON, _mixed(own[:, None] ^ step) / 2.0**32, "right")


def weighted_resamples(pred: DataFrame, row: str, repeats: int, seed: int, keys: list[str] = ()) -> DataFrame:
    """keys, r, y, a, b, n: cells of resamples in which each row has a count of its own with mean 1. `row` is a whole number that
    tells rows apart. No row is copied: a task sends one vector of all resamples' counts for each cell, and those are summed."""
    names = [*keys, "y", "a", "b"]
    kinds = ", ".join(f"{c} {pred.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for cell, rows in b.groupby(names, dropna=False).groups.items():
                ids = b.loc[rows, row].to_numpy()
                n = sum(poisson_weights(ids[at : at + 4096], repeats, seed).sum(axis=0) for at in range(0, len(ids), 4096))
                held[cell] = held[cell] + n if cell in held else n
        yield pd.DataFrame([(*cell, n) for cell, n in held.items()], columns=[*names, "n"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*(rows[c].iloc[0] for c in names), np.sum(rows["n"].to_list(), axis=0))], columns=[*names, "n"])

    parts = pred.select(row, *names).mapInPandas(run, f"{kinds}, n array<long>").groupBy(*names).applyInPandas(add, f"{kinds}, n array<long>")
    return parts.select(*keys, "y", "a", "b", F.posexplode("n").alias("r", "n")).where("n > 0").select(*keys, "r", "y", "a", "b", "n")


def multinomial_resamples(cells: DataFrame, repeats: int, seed: int, keys: list[str] = ()) -> DataFrame:
    """keys, r, y, a, b, n from paired_cells(), drawn at once for each cell, so that a resample costs its cells and not its rows."""
    names = [*keys, "y", "a", "b"]
    rows = sorted((tuple(r[c] for c in names), r["n"]) for r in cells.collect())  # at most classes^3 a key
    groups: dict[tuple, list] = {}
    for cell, n in rows:
        groups.setdefault(cell[: len(keys)], []).append((cell, n))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch["id"]:
                for i, own in enumerate(groups.values()):
                    n = np.array([k for _, k in own], float)
                    m = np.random.default_rng([seed + i, int(r)]).multinomial(int(n.sum()), n / n.sum())
                    out += [(int(r), *cell, int(k)) for (cell, _), k in zip(own, m, strict=True) if k]
            yield pd.DataFrame(out, columns=["r", *names, "n"])

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in names)
    return cells.sparkSession.range(repeats).mapInPandas(run, f"r int, {kinds}, n long")


def paired_bootstrap(cells: DataFrame, resamples: DataFrame, metric: str = "macro_f1", keys: list[str] = ()) -> DataFrame:
    """keys, delta (of b over a), p_value (two-sided), ci_low, ci_high, significant. A resample's macro-F1 is over its own labels."""
    from quefrency.operators.metrics import macro_f1

    if metric not in ("macro_f1", "accuracy"):
        raise ValueError(f"unknown metric {metric!r}")

    def delta(c: DataFrame, by: list[str]) -> DataFrame:
        side = c.select(*by, "y", "n", F.explode(F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("side", "p"))
        m = macro_f1(side, [*by, "side"], weight="n")
        return m.groupBy(*by).agg(F.sum(F.when(F.col("side") == "b", F.col(metric)).otherwise(-F.col(metric))).alias("d"))

    d = delta(resamples, [*keys, "r"])
    ends = d.groupBy(*keys).agg(F.avg((F.col("d") <= 0).cast("double")).alias("lo"), F.avg((F.col("d") >= 0).cast("double")).alias("hi"), F.percentile("d", 0.025).alias("ci_low"), F.percentile("d", 0.975).alias("ci_high"))
    own = delta(cells, list(keys))
    both = own.join(ends, list(keys)) if keys else own.crossJoin(F.broadcast(ends))
    out = both.select(*keys, F.col("d").alias("delta"), (2 * F.least("lo", "hi")).alias("p_value"), "ci_low", "ci_high")
    return out.withColumn("significant", (F.col("p_value") < 0.05) & (F.col("delta") > 0))
