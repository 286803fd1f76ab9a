"""The corpus pipeline: each stage reads what the one before kept, and its decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A stage's result is written as Parquet and read again for the next. Null texts and texts without a letter go in the
first stage; an empty table passes through all stages; further columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm import exact_dedup, language_id, near_dedup, sentencepiece_codec, source_mixing
from logweft.llm.store import materialize


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return language_id.keep_known(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs, near_dedup.near_dedup(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as the mix takes it, the one at a source's cut in part (see `source_mixing.draw`)."""
    return source_mixing.draw(docs, source_mixing.mix(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, and whether these decode to the text."""
    coded = sentencepiece_codec.encode(docs, check="round_trip", keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can't express language ID by fitted n-gram filters; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
