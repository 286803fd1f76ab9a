"""Lines to event attributes with a configured pattern; native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.functions.columns import event_time, level_of, timestamp_text
from logweft.plans.config import ParserConfig

_BETWEEN = "\x01\x1f\x01"


def _packed(line: Column, config: ParserConfig) -> tuple[Column, Column, dict[str, int]]:
    """Whether the line begins an event, all its captures as one array from a single pass, and the place of each attribute in it."""
    pattern, names = config.java()
    order = [a for a in names if a != "message"] + ["message"] * ("message" in names)  # last, so that separators in it do no harm
    before, rest = ("" if pattern.startswith("^") else r"\A(?s:.*?)"), ("" if pattern.endswith(r"\z") else r"(?s:.*)\z")
    one = F.regexp_replace(line, f"{before}(?:{pattern}){rest}", _BETWEEN.join("${%s}" % names[a] for a in order))
    return line.rlike(pattern), F.split(one, _BETWEEN, len(order)), {a: i + 1 for i, a in enumerate(order)}


def parse_lines(lines: DataFrame, *configs: ParserConfig, value: str = "value") -> DataFrame:
    """``lines`` with is_header and, for headers, timestamp, event_ts, level, message and fields.

    Of the configurations for a line's source (by source_id; those that name no sources are for all), the first that
    matches the line is taken.

    Each pattern runs once for the test and, on headers, once for all captures: the steps are projections of their
    own, which Spark doesn't merge when an expensive one is used more than once.
    """
    configs = configs or (ParserConfig(),)
    packed = [_packed(F.col(value), c) for c in configs]
    own = [F.col("source_id").isin(*c.sources) if c.sources else F.lit(True) for c in configs]
    rows = lines.select("*", *(F.coalesce(own[i] & begins, F.lit(False)).alias(f"_is{i}") for i, (begins, _, _) in enumerate(packed)))
    rows = rows.select("*", *(F.when(F.col(f"_is{i}"), parts).alias(f"_parts{i}") for i, (_, parts, _) in enumerate(packed)))

    def attribute(i: int, name: str) -> Column:
        place = packed[i][2].get(name)
        return F.lit("") if place is None else F.coalesce(F.element_at(f"_parts{i}", place), F.lit(""))

    def fields(i: int) -> Column:
        pairs = [x for f in configs[i].extra_fields for x in (F.lit(f), attribute(i, f))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    def first(make) -> Column:
        return F.coalesce(*(F.when(F.col(f"_is{i}"), make(i)) for i in range(len(configs))))

    rows = rows.select(
        *(rows[c] for c in lines.columns),
        reduce(lambda a, b: a | b, (F.col(f"_is{i}") for i in range(len(configs)))).alias("is_header"),
        first(lambda i: timestamp_text(attribute(i, "timestamp"))).alias("timestamp"),
        first(lambda i: level_of(attribute(i, "level"))).alias("level"),
        first(lambda i: attribute(i, "message")).alias("message"),
        first(fields).alias("fields"),
    )
    return rows.select(*lines.columns, "is_header", "timestamp", event_time(F.col("timestamp")).alias("event_ts"), "level", "message", "fields")
