"""Counts of what was ingested, and statistics of the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.sources.staging import stage


def file_stats(lines: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Lines, headers and bytes by source and file; with rejected lines, their number too."""
    keys = ["source_id", "file_path"]
    out = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.max("file_size").alias("n_bytes"))
    if rejected is None:
        return out
    return out.join(rejected.groupBy(*keys).agg(F.count("*").alias("n_rejects")), keys, "left").fillna(0, ["n_rejects"])


def source_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("source_id").agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"))


def per_window(events: DataFrame, width: str = "1 second", time: str = "event_ts", failures: DataFrame | None = None) -> DataFrame:
    """Events, warnings, errors and parser failures by window of time, and how many sources and files were active.

    ``failures``: rejected lines as events, with a time in the same column (for live ones, when they came). Counted by
    window, source and file first, so the distinct counts are exact and nothing but counts is shuffled.
    """
    columns = [F.col(time).alias("_time"), "source_id", "file_path", "level"]
    rows = events.select(*columns, F.lit(0).alias("_failed"))
    if failures is not None:
        rows = rows.unionByName(failures.select(*columns, F.lit(1).alias("_failed")))
    is_level = lambda *levels: F.count(F.when((F.col("_failed") == 0) & F.col("level").isin(*levels), 1))
    by_file = rows.groupBy(F.window("_time", width)["start"].alias("start"), "source_id", "file_path").agg(
        F.count(F.when(F.col("_failed") == 0, 1)).alias("n_events"), is_level("WARN").alias("n_warnings"), is_level("ERROR", "FATAL").alias("n_errors"), F.sum("_failed").alias("n_failures")
    )
    by_source = by_file.groupBy("start", "source_id").agg(*(F.sum(c).alias(c) for c in ("n_events", "n_warnings", "n_errors", "n_failures")), F.count("*").alias("n_files"))
    return by_source.groupBy("start").agg(*(F.sum(c).alias(c) for c in ("n_events", "n_warnings", "n_errors", "n_failures")), F.count("*").alias("n_sources"), F.sum("n_files").alias("n_files"))


def instances(events: DataFrame) -> DataFrame:
    """Files and latest activity by source."""
    return events.groupBy("source_id").agg(F.countDistinct("file_path").alias("n_files"), F.count("*").alias("n_events"), F.max("event_ts").alias("latest"))


def pairs_in(message):
    """``name=value`` pairs of a message, each once."""
    names, values = (F.regexp_extract_all(message, F.lit(r"(\w+)=(\S+)"), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.arrays_zip(names.alias("key"), values.alias("value")))


def correlate(events: DataFrame, names: tuple[str, ...] = ("requestId", "sessionId", "playerId", "transactionId", "threadId")) -> DataFrame:
    """A row for each event and correlation key in it: key, value, and the event's attributes."""
    pairs = events.withColumn("_p", F.explode(pairs_in(F.col("message"))))
    return pairs.select(F.col("_p.key").alias("key"), F.col("_p.value").alias("value"), *events.columns).where(F.col("key").isin(*names))


def traces(correlated: DataFrame) -> DataFrame:
    """Every correlated value's first and last time, events and sources."""
    return correlated.groupBy("key", "value").agg(F.min("event_ts").alias("first"), F.max("event_ts").alias("last"), F.count("*").alias("n_events"), F.countDistinct("source_id").alias("n_sources"))


_STEPS = ("event_ts", "source_ord", "file_path", "line_no")


def trace_steps(correlated: DataFrame) -> DataFrame:
    """Events of each correlated value numbered by time, with the time since the one before in seconds.

    A value of any number of events spreads over tasks: rows are range-partitioned by value and time and staged so,
    each part is numbered by itself, and of each part only its count and last row are handed to the ones after it.
    """
    order = ["key", "value", *_STEPS]
    parts = correlated.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    rows, _ = stage(parts, "steps")
    keys = ["key", "value", "_part"]
    before = Window.partitionBy("key", "value").orderBy("_part")  # a row for each part of a value
    borders = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.struct(*_STEPS)).alias("_last"))
    borders = borders.select(*keys, F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lag("_last.event_ts").over(before).alias("_carried"))
    by = Window.partitionBy(*keys).orderBy(*_STEPS)
    local = rows.select("*", F.row_number().over(by).alias("_row"), F.lag("event_ts").over(by).alias("_earlier")).join(borders, keys)
    earlier = F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.col("_earlier"))
    since = F.unix_millis(F.col("event_ts").cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))
    return local.select(*correlated.columns, (F.col("_base") + F.col("_row")).alias("step"), (since / 1000).alias("seconds_since"))


def live_rates(events: DataFrame, width: str = "1 second", late_by: str = "10 seconds", time: str = "event_ts", active_for: str | None = None) -> DataFrame:
    """The counts of `per_window` on a stream: a window comes once, when events are not expected any more (``late_by`` behind the newest).

    One state for each window, source and file, so a busy second spreads over its files; `roll_up` sums them. With
    ``active_for``, sessions instead of windows: how long each source was active without a pause of that length. A
    stream's rejected lines have no time and aren't counted here. Events that come later than ``late_by`` are dropped
    by Spark, which counts them (``numRowsDroppedByWatermark`` in the query's progress).
    """
    is_level = lambda *levels: F.count(F.when(F.col("level").isin(*levels), 1))
    rows = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late_by)
    span = F.window("_time", width) if active_for is None else F.session_window("_time", active_for)
    keys = ["source_id", "file_path"] if active_for is None else ["source_id"]
    counted = rows.groupBy(span.alias("_span"), *keys).agg(F.count("*").alias("n_events"), is_level("WARN").alias("n_warnings"), is_level("ERROR", "FATAL").alias("n_errors"))
    return counted.select(F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), *keys, "n_events", "n_warnings", "n_errors")


def roll_up(rates: DataFrame, width: str = "1 hour") -> DataFrame:
    """Stored `live_rates` as wider windows, as `per_window` counts them: sums, and exact numbers of sources and files."""
    sums = [F.sum(c).alias(c) for c in ("n_events", "n_warnings", "n_errors")]
    by_file = rates.groupBy(F.window("start", width)["start"].alias("start"), "source_id", "file_path").agg(*sums)
    by_source = by_file.groupBy("start", "source_id").agg(*sums, F.count("*").alias("n_files"))
    return by_source.groupBy("start").agg(*sums, F.count("*").alias("n_sources"), F.sum("n_files").alias("n_files"))


def normalised(message):
    """A message without what differs from event to event: values of pairs and numbers."""
    return F.regexp_replace(F.regexp_replace(message, r"(\w+)=\S+", "$1=?"), r"\d+", "#")


def only_in_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """Normalised messages of one set of events that another doesn't have, with their number."""
    shape = lambda e: e.select(normalised(F.col("message")).alias("shape"))
    return shape(first).groupBy("shape").count().join(shape(second).distinct(), "shape", "left_anti")
