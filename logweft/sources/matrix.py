"""The environment matrix: which sources there are, and what can be selected."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.functions.columns import slug
from logweft.plans.config import TIERS, Selection

SCHEMA = "environment string, country string, code string, host string, shares array<string>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The matrix from one JSON array, with each entry's place in it."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("entry", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The matrix from CSV with a header and ``;`` between shares."""
    flat = spark.read.schema(SCHEMA.replace("array<string>", "string")).csv(path, header=True)
    shares = F.filter(F.transform(F.split("shares", ";"), lambda s: F.trim(s)), lambda s: s != "")
    return flat.withColumn("shares", shares).withColumn("entry", F.monotonically_increasing_id())


def source_options(matrix: DataFrame) -> DataFrame:
    """environment and its countries, both in locale order."""
    pairs = matrix.select("environment", "country").distinct()
    in_order = F.array_sort(F.collect_list(F.struct(F.collate("country", "UNICODE").alias("k"), "country")))
    return pairs.groupBy("environment").agg(F.transform(in_order, lambda p: p["country"]).alias("countries")).orderBy(F.collate("environment", "UNICODE"))


def _absolute(share: Column, base_dir: str) -> Column:
    return F.when(share.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*://)"), share).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), share))


def resolve_sources(matrix: DataFrame, selection: Selection, base_dir: str | None = None) -> DataFrame:
    """A row for each share of the selected environment and country; none for a selection that isn't valid.

    id, name, directory, environment, country, project, date, tier and source_ord (order of the matrix, then of the
    shares). Relative shares are under ``base_dir`` (the working directory by default).
    """
    if "entry" not in matrix.columns:
        matrix = matrix.withColumn("entry", F.monotonically_increasing_id())
    rows = matrix.where(F.lit(selection.valid) & (F.col("environment") == selection.environment) & (F.col("country") == selection.country))
    rows = rows.select("*", F.posexplode("shares").alias("share_no", "share"))
    path = _absolute(F.col("share"), base_dir or os.getcwd())
    parts = [F.col("environment"), F.col("country"), F.col("code"), F.lit(selection.name), F.col("share_no").cast("string"), F.lit(selection.tier)]
    return rows.select(
        F.concat_ws("-", *map(slug, parts)).alias("id"),
        F.format_string("[%s] %s", "code", path).alias("name"),
        F.concat_ws("/", path, F.lit("Java"), F.lit(f"apache-tomcat-{selection.tier}"), F.lit("logs")).alias("directory"),
        "environment",
        "country",
        F.lit(selection.name).alias("project"),
        F.lit(selection.date).alias("date"),
        F.lit(selection.tier).alias("tier"),
        (F.col("entry") * 1000 + F.col("share_no")).alias("source_ord"),
    )


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TIERS], "tier string")
