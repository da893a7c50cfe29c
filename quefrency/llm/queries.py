"""Registered queries of this subpackage: each numbered operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quefrency.llm import alignment, decontamination, fmindex, jaccard, langid, lengths, licenses, neighbours, packing, ranked, sql, suffixes, tokenfiles, toxicity
from quefrency.llm.scratch import keep
from quefrency.llm.tokens import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def labelled_fold(frame: DataFrame) -> DataFrame:
    """The rows that models may learn from."""
    return frame.where(F.col("doc_id").isNotNull() & (_fold() != 0))


def op1_packing(spark, sf_dir):
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return neighbours.search(v, v.where("vec_id % 20 = 0"), k=20)


def op3_decontamination(spark, sf_dir):
    x = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(labelled_fold(docs)))
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_suffix_dedup(spark, sf_dir):
    x = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op6_token_files(spark, sf_dir):
    return tokenfiles.token_file_round_trip(table(spark, sf_dir, "documents"), vocabulary()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, labelled_fold(table(spark, sf_dir, "labels"))))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_token_counts(spark, sf_dir):
    return lengths.limit_table(keep(lengths.length_histogram(table(spark, sf_dir, "documents"), vocabulary())))


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    x = fmindex.remove_repeated_words(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op11_licenses(spark, sf_dir):
    return licenses.labelled(licenses.scan(table(spark, sf_dir, "documents")))


def op12_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark, sf_dir):
    return alignment.link_statistics(table(spark, sf_dir, "documents"), alignment.vocabularies())


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_neighbours, op3_decontamination, op4_language, op5_suffix_dedup, op6_token_files, op7_toxicity, op8_token_counts, op9_ngram_jaccard, op10_substring_dedup, op11_licenses, op12_ranked_search, op13_alignment, pipeline)}
ORACLE = sql.ORACLE
