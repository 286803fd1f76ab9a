"""What tables show of events: columns, values and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.functions.columns import label
from logweft.plans.config import ParserConfig

# Attribute by the name that schemas use, and the base columns (field, label, width, hideable).
ATTRIBUTES = {"id": "event_id", "timestamp": "timestamp", "receivedAt": "received_at", "sourceId": "source_id", "sourceName": "source_name", "filePath": "file_path", "level": "level", "message": "message"}
BASE_COLUMNS = (("timestamp", "Time", 188, False), ("sourceName", "Source", 240, True), ("level", "Level", 90, False), ("message", "Message", 520, False))
EXTRA_WIDTH, EXTRA_GROUP = 180, ("parsed-fields", "Parsed fields")

COLUMN_SCHEMA = "position int, id string, label string, field string, width int, hideable boolean, group_id string, group_label string"


def column_schema(spark: SparkSession, config: ParserConfig | None = None) -> DataFrame:
    """The columns a table of these events has, in order; without a configuration, the base columns."""
    base = [(f, title, f, width, hideable, "base", "Base") for f, title, width, hideable in BASE_COLUMNS]
    extra = [(f, None, f, EXTRA_WIDTH, True, *EXTRA_GROUP) for f in (config.extra_fields if config else [])]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(base[:3] + extra + base[3:])], COLUMN_SCHEMA)
    return rows.withColumn("label", F.coalesce("label", label(F.col("field"))))


def field_value(name: str) -> Column:
    """An attribute, else the field of that name, else an empty text."""
    if name in ATTRIBUTES:
        return F.coalesce(F.col(ATTRIBUTES[name]).cast("string"), F.lit(""))
    return F.coalesce(F.element_at("fields", F.lit(name)), F.lit(""))


def reconciled(order: list[str], known: list[str]) -> list[str]:
    """A stored order of columns, without those that are gone and with new ones at the end."""
    kept = [c for c in order if c in known]
    return kept + [c for c in known if c not in kept]


def table_view(events: DataFrame, config: ParserConfig | None = None, order: list[str] | None = None, hidden: set[str] | None = None) -> DataFrame:
    """The visible columns in order; columns that aren't hideable stay."""
    columns = [(r["id"], r["hideable"]) for r in column_schema(events.sparkSession, config).orderBy("position").collect()]  # a row for each column
    fixed = {c for c, hideable in columns if not hideable}
    shown = [c for c in reconciled(order or [], [c for c, _ in columns]) if c in fixed or c not in (hidden or set())]
    return events.select(*(field_value(c).alias(c) for c in shown))


def selected(events: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    return events.join(ids.select(key), key, "left_semi")


def event_object() -> Column:
    names = ("id", "timestamp", "receivedAt", "sourceId", "sourceName", "filePath", "level", "message")
    return F.struct(*(F.col(ATTRIBUTES[n]).alias(n) for n in names), "fields")


def event_json(pretty: bool = False) -> Column:
    return F.to_json(event_object(), {"pretty": str(pretty).lower()})


def export_text(events: DataFrame, ids: DataFrame, path: str) -> None:
    """The selected events as indented JSON with a blank line between, in the timeline's order."""
    from logweft.operators.timeline import ordering

    rows = selected(events, ids).orderBy(*ordering()).select(event_json(True).alias("value"))
    rows.write.mode("overwrite").text(path, lineSep="\n\n")


def _listed(rows: DataFrame, item: Column, *order: Column) -> DataFrame:
    """One row with all items as a list ``items`` in the given order. ``rows`` are a page's, or the sources or columns of one view."""
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), item.alias("item"))
    return numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item")), lambda a, b: a["n"] - b["n"]), lambda x: x["item"]).alias("items"))


def page_json(rows: DataFrame, has_more: bool, append: str = "bottom") -> DataFrame:
    """A page as one message, its events in the timeline's order and their fields as an object. It holds a page's rows at most."""
    from logweft.operators.timeline import ordering

    message = F.struct(F.lit(append).alias("append"), F.col("items").alias("events"), F.lit(has_more).alias("hasMore"))
    return _listed(rows, event_object(), *ordering()).select(F.to_json(message).alias("value"))


def snapshot_json(rows: DataFrame, has_more: bool, sources: DataFrame, columns: DataFrame) -> DataFrame:
    """What a view begins with as one message: the newest page, the sources and the columns of its table."""
    from logweft.operators.timeline import ordering

    events = _listed(rows, event_object(), *ordering()).withColumnRenamed("items", "events")
    kept = ("id", "name", "directory", "environment", "country", "project", "date", "tier")
    known = _listed(sources, F.struct(*(c for c in kept if c in sources.columns)), F.col("source_ord")).withColumnRenamed("items", "sources")
    named = F.struct("id", "label", "field", "width", "hideable", F.col("group_id").alias("groupId"), F.col("group_label").alias("groupLabel"))
    schema = _listed(columns, named, F.col("position")).withColumnRenamed("items", "columns")
    # Three tables of one row each, side by side.
    both = events.withColumn("_one", F.lit(1)).join(known.withColumn("_one", F.lit(1)), "_one").join(schema.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.to_json(F.struct("events", F.lit(has_more).alias("hasMore"), "sources", F.struct("columns").alias("schema"))).alias("value"))
