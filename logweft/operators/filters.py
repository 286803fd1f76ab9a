"""Predicates on events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.functions.regex import is_valid, literal, search_pattern
from logweft.plans.config import LogFilter


def searchable() -> Column:
    """What text filters look at: time, source, level, message and the fields in their order, a space between any two."""
    return F.concat_ws(" ", "timestamp", "source_name", "level", "message", F.map_values("fields"))


def level_is(levels: tuple[str, ...], level: Column | None = None) -> Column | None:
    return (F.col("level") if level is None else level).isin(*levels) if levels else None


def text_matches(spark: SparkSession, wanted: LogFilter, hay: Column | None = None) -> Column | None:
    """A pattern if asked for and valid, else the text itself; case counts only if asked for."""
    if not wanted.text:
        return None
    hay = searchable() if hay is None else hay
    if wanted.regex and is_valid(spark, pattern := search_pattern(wanted.text, wanted.case_sensitive)):
        return hay.rlike(pattern)
    return F.contains(hay, F.lit(wanted.text)) if wanted.case_sensitive else F.contains(F.lower(hay), F.lower(F.lit(wanted.text)))


def predicate(spark: SparkSession, wanted: LogFilter, hay: Column | None = None) -> Column:
    """The filter as one condition, the cheap test of the level first."""
    tests = [t for t in (level_is(wanted.levels), text_matches(spark, wanted, hay)) if t is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(True)


def apply_filter(events: DataFrame, wanted: LogFilter) -> DataFrame:
    return events.where(predicate(events.sparkSession, wanted))


def whole_word(hay: Column, word: str) -> Column:
    return hay.rlike(rf"(?iu)\b{literal(word)}\b")


def attribute_is(**wanted: str) -> Column:
    """Equality on attributes of the event, or on its fields by name."""
    base = {"source_id", "source_name", "file_path", "level"}
    return reduce(lambda a, b: a & b, ((F.col(k) if k in base else F.element_at("fields", F.lit(k))) == v for k, v in wanted.items()), F.lit(True))
