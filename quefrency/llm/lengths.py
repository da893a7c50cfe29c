"""Exact histogram of encoded lengths, and what it answers for every context limit by suffix sums."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quefrency.llm.tokens import encoded

#: Lengths that one window of sums spans; the sums of whole blocks are added by a second, small window.
BLOCK = 64


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length (end id included). Tasks count before the shuffle.

    Null text is empty and has length 1; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for _, ids in encoded(batches, tokenizer):
            count.update(len(x) // 4 for x in ids)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], ["n_tokens", "n_docs"])

    own = docs.select(F.lit(0).alias("none"), F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return own.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: docs_at_least and tokens_at_least (suffix sums), docs_over and tokens_cut if the
    limit is L, tokens_kept (total of the truncated lengths), and quantile (share of documents of length L or less).

    The histogram is read twice: give one that is written or small to compute.
    Limits between two lengths a < b follow from b's row: tokens_kept(L) = tokens_kept(b) - (b - L) * docs_at_least(b).
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("bd", "bt")), F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    x = h.join(blocks, "block").select("n_tokens", "n_docs", "all_docs", "all_tokens", (F.sum("n_docs").over(own) + F.col("bd_after")).alias("docs_at_least"), (F.sum("tokens").over(own) + F.col("bt_after")).alias("tokens_at_least"))
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return x.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("docs_at_least") - F.col("n_docs")).alias("docs_over"), kept.alias("tokens_kept"), (F.col("all_tokens") - kept).alias("tokens_cut"), ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, tokens_kept, tokens_cut for any limits, between lengths too: one pass over the histogram."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    rows = [F.struct(F.lit(x).cast("long").alias("limit"), of(F.when(n > x, d)).alias("docs_over"), of(F.least(n, F.lit(x)) * d).alias("tokens_kept"), of(F.greatest(n - x, F.lit(0)) * d).alias("tokens_cut")) for x in limits]
    return histogram.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def quantile_lengths(table: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents does not exceed, from limit_table()."""
    rows = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return table.agg(F.array(*rows).alias("all")).select(F.inline("all"))
