"""Scores of predictions, from confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pred: DataFrame, keys: list[str] = (), y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """How many rows (or how much weight) each pair of true and predicted label has."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return pred.groupBy(*keys, F.col(y).alias("y"), F.col(p).alias("p")).agg(n.alias("n"))


def class_report(pred: DataFrame, keys: list[str] = (), y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """precision, recall, f1, support of each label that is true or predicted; 0/0 is 0."""
    s = _label_counts(pred, keys, y, p, weight)
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select(*keys, "label", part(F.col("tp"), F.col("np")).alias("precision"), part(F.col("tp"), F.col("ny")).alias("recall"), part(2 * F.col("tp"), F.col("np") + F.col("ny")).alias("f1"), F.col("ny").alias("support"))


def _label_counts(pred: DataFrame, keys, y: str, p: str, weight: str | None) -> DataFrame:
    """label, tp, np, ny: each confusion count goes to its true label and to its predicted one, in one pass."""
    c, none = confusion(pred, keys, y, p, weight), F.lit(0)
    side = lambda label, tp, np, ny: F.struct(F.col(label).alias("label"), tp.alias("tp"), np.alias("np"), ny.alias("ny"))
    n = F.col("n")
    both = F.array(side("y", F.when(F.col("y") == F.col("p"), n).otherwise(none), n * 0, n), side("p", n * 0, n, n * 0))
    return c.select(*keys, F.inline(both)).groupBy(*keys, "label").agg(*(F.sum(k).alias(k) for k in ("tp", "np", "ny")))


def macro_f1(pred: DataFrame, keys: list[str] = (), y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """Mean F1 over the labels that are true or predicted, and accuracy: all from one count of pairs."""
    s, total = _label_counts(pred, keys, y, p, weight), F.col("np") + F.col("ny")
    return s.groupBy(*keys).agg(F.avg(F.when(total > 0, 2 * F.col("tp") / total).otherwise(0.0)).alias("macro_f1"), (F.sum("tp") / F.sum("ny")).alias("accuracy"))


def vote(pred: DataFrame, window: str, p: str = "p") -> DataFrame:
    """Most frequent prediction of each window; ties go to the smallest label."""
    n = pred.groupBy(window, p).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(window).agg(F.min_by(p, F.struct(-F.col("n"), F.col(p))).alias("p"))


def mean_probability(prob: DataFrame, window: str, label: str = "label", value: str = "prob") -> DataFrame:
    """Label with the largest mean probability in each window; ties go to the first label."""
    m = prob.groupBy(window, label).agg(F.avg(value).alias("m"))
    return m.groupBy(window).agg(F.min_by(label, F.struct(-F.col("m"), F.col(label))).alias("p"))


def under_fir(scores: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Clean score, mean score at severities from `least` on, their ratio, and whether 85 percent are kept."""
    clean = F.max(F.when(F.col("severity") == 1, F.col("f1")))
    under = F.avg(F.when(F.col("severity") >= least, F.col("f1")))
    x = scores.groupBy(*keys).agg(clean.alias("clean"), under.alias("under"))
    r = F.col("under") / F.greatest(F.col("clean"), F.lit(1e-9))
    return x.select(*keys, "clean", "under", r.alias("retention"), (r >= 0.85).alias("kept"))


def best_per_split(scores: DataFrame, split: str, choice: str, order: str, score: str) -> DataFrame:
    """The choice with the largest score, ties to the first in order."""
    rank = F.row_number().over(Window.partitionBy(split).orderBy(F.desc(score), order))
    return scores.withColumn("__r", rank).where("__r = 1").select(split, choice, score)


def advantage(scores: DataFrame, incumbent: str, challenger: str, least: int = 3, kept: float = 0.85, gain: float = 0.10) -> DataFrame:
    """split, both representations' retention, and whether the challenger keeps enough and that much more than the incumbent."""
    r = under_fir(scores.where(F.col("rep").isin(incumbent, challenger)), ["split", "rep"], least)
    of = lambda rep: F.max(F.when(F.col("rep") == rep, F.col("retention")))
    x = r.groupBy("split").agg(of(incumbent).alias("incumbent"), of(challenger).alias("challenger"))
    return x.withColumn("passed", (F.col("challenger") >= kept) & (F.col("challenger") - F.col("incumbent") >= gain))
