"""A training-data pipeline over `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quefrency.llm import decontamination, fmindex, jaccard, langid, packing
from quefrency.llm.queries import labelled_fold, table
from quefrency.llm.scratch import keep, mark, release
from quefrency.llm.tokens import LEAN_PIECES, vocabulary

#: The result has no SQL form: it needs a learned language model and a tokenizer. Tests hold it against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, or far from every learned language, go."""
    return langid.accepted(docs, langid.fit(labelled_fold(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 75 percent."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words that occur twice; those left without words go."""
    return fmindex.without_repeated_words(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 4096 tokens. Executors come to it with heaps that the stages before have filled, so
    its workers remember fewer encoded pieces than those of a packing alone."""
    return packing.pack(docs, vocabulary(), memo_pieces=LEAN_PIECES)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_free), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what a stage kept goes with it."""
    docs, begin = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
        release(spark, begin, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
