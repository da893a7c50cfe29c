"""Connected components of a link table, by smallest label and pointer jumping; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.llm.scratch import keep


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node of links (a, b), which are read both ways.

    Nulls take no part; loops and repeated links do no harm; no links give an empty table.
    """
    some = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = keep(some.union(some.select("b", "a")).distinct())
    labels = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("of"), F.col("comp").alias("far"))
        new = keep(step.join(jump, F.col("comp") == F.col("of")).select("node", "was", F.least("comp", "far").alias("comp")))
        labels = new.select("node", "comp")
        if not new.where("was <> comp").limit(1).count():
            return labels
