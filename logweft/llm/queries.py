"""The queries of this folder's operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm import chat_views, collocations, exact_dedup, language_id, language_model, near_dedup, periodic_runs, permutation_index, quality_rules, sentencepiece_codec, source_mixing, token_counts, token_files


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(_table(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(_table(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(_table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(_table(spark, sf_dir))
    return files.read(token_files.ids_crc32).select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))


def op9_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_views.chat_views(_table(spark, sf_dir, "conversations"))
    return views.withColumn("mask_runs", F.array_join(F.col("mask_runs").cast("array<string>"), ","))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(_table(spark, sf_dir), looped=periodic_runs.looped_tail)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece_codec, op3_language_id, op4_language_model, op5_near_dedup, op6_exact_dedup, op7_source_mixing, op8_token_files, op9_chat_views, op10_token_counts, op11_nearest_neighbours, op12_collocations, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": near_dedup.ORACLE, "op6_exact_dedup": OP6_SQL, "op7_source_mixing": source_mixing.ORACLE, "op9_chat_views": chat_views.ORACLE, "op12_collocations": collocations.ORACLE}
