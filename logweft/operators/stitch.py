"""Continuation lines attached to the event before them in the same file.

`number_by_chunk` is the form to use at scale: a file of any size is numbered in parts (its splits) by adding
what came in the parts before, so no task gets a whole file. `number_by_window` states the same with one window
for each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.functions.columns import event_id

KEYS = ("source_id", "file_path")
UNBOUNDED = (Window.unboundedPreceding, Window.currentRow)


def number_by_window(lines: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("chunk", "pos"), wanted: Column | None = None, distance: bool = False) -> DataFrame:
    """``lines`` with line_no (from 0) and event_seq (0 before the first header); with ``wanted``, a test of headers, whether the event's header passes; with ``distance``, after_header (lines since the header)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    line_no, so_far = (F.row_number().over(by) - 1).cast("long"), by.rowsBetween(*UNBOUNDED)
    out = lines.select("*", line_no.alias("line_no"), F.sum(F.col("is_header").cast("long")).over(so_far).alias("event_seq"))
    if distance:
        out = out.withColumn("after_header", F.col("line_no") - F.max(F.when(F.col("is_header"), F.col("line_no"))).over(so_far))
    return out if wanted is None else out.withColumn("wanted", F.last(F.when(F.col("is_header"), F.coalesce(wanted, F.lit(False))), ignorenulls=True).over(so_far))


def number_by_chunk(lines: DataFrame, keys: tuple[str, ...] = KEYS, chunk: str = "chunk", pos: str = "pos", wanted: Column | None = None, distance: bool = False) -> DataFrame:
    """The same as `number_by_window`, worked out chunk by chunk.

    after_header is exact in the header's own chunk; in later ones it counts the lines since that chunk's end, which is
    no more than the true number.
    """
    is_header = F.col("is_header")
    passes = F.coalesce(F.lit(True) if wanted is None else wanted, F.lit(False))
    counts = lines.groupBy(*keys, chunk).agg(F.sum(is_header.cast("long")).alias("_h"), F.count("*").alias("_n"), F.max_by(F.when(is_header, passes), F.when(is_header, F.col(pos))).alias("_ok"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    counts = counts.withColumn("_line", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    base = counts.select(
        *keys,
        chunk,
        "_line",
        F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_seq"),
        F.max(F.when(F.col("_h") > 0, F.col("_line") + F.col("_n"))).over(before).alias("_end"),
        F.last("_ok", ignorenulls=True).over(before).alias("_carried"),
    )
    by = Window.partitionBy(*keys, chunk).orderBy(pos)
    so_far = by.rowsBetween(*UNBOUNDED)
    local = lines.select("*", (F.row_number().over(by) - 1).alias("_row"), F.sum(is_header.cast("long")).over(so_far).alias("_heads"))
    if distance:
        local = local.withColumn("_head", F.max(F.when(is_header, F.col("_row"))).over(so_far))
    if wanted is not None:
        local = local.withColumn("_wanted", F.last(F.when(is_header, passes), ignorenulls=True).over(so_far))
    rows = local.join(base, [*keys, chunk])
    return rows.select(
        *lines.columns,
        (F.col("_line") + F.col("_row")).cast("long").alias("line_no"),
        (F.col("_seq") + F.col("_heads")).alias("event_seq"),
        *([F.coalesce(F.col("_row") - F.col("_head"), F.col("_line") + F.col("_row") - F.col("_end") + 1).cast("long").alias("after_header")] if distance else []),
        *([] if wanted is None else [F.coalesce("_wanted", "_carried").alias("wanted")]),
    )


def stitch(numbered: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "value", max_continuation_lines: int | None = None) -> DataFrame:
    """An event for each header: the keys, event_seq, line_no (the header's), n_lines, message (with continuations) and the header's other columns.

    Where lines were numbered with a test of headers, only events that pass are put together; the lines of the others
    go before the shuffle. ``max_continuation_lines`` cuts what is appended to one event; by default nothing is cut.
    Where they were numbered with distances, the cut comes before the gathering: of an event's lines, twice as many
    are gathered at most.
    """
    header = lambda c: F.first(F.when(F.col("is_header"), F.col(c)), ignorenulls=True).alias(c)
    text = F.struct("line_no", F.when(F.col("is_header"), F.col("message")).otherwise(F.coalesce(F.col(value), F.lit(""))).alias("text"))
    if max_continuation_lines is not None and "after_header" in numbered.columns:
        text = F.when(F.col("is_header") | (F.col("after_header") <= max_continuation_lines), text)
    carried = [c for c in ("timestamp", "event_ts", "level", "source_name", "source_ord", "generation") if c in numbered.columns and c not in keys]
    fields = [F.first(F.when(F.col("is_header"), F.map_entries("fields")), ignorenulls=True).alias("_fields")] if "fields" in numbered.columns else []
    kept = numbered.where("wanted") if "wanted" in numbered.columns else numbered
    rows = kept.where("event_seq > 0").groupBy(*keys, "event_seq").agg(*map(header, carried), *fields, F.min("line_no").alias("line_no"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(text)).alias("_lines"))
    lines = F.col("_lines") if max_continuation_lines is None else F.slice("_lines", 1, max_continuation_lines + 1)
    rows = rows.withColumn("message", F.array_join(F.transform(lines, lambda x: x["text"]), "\n")).drop("_lines")
    return rows.withColumn("fields", F.map_from_entries("_fields")).drop("_fields") if fields else rows


def rejects(numbered: DataFrame) -> DataFrame:
    """Continuations with no event before them in their file."""
    return numbered.where("event_seq = 0")


def as_events(stitched: DataFrame) -> DataFrame:
    """Events in the normalised schema, with stable ids."""
    generation = F.col("generation") if "generation" in stitched.columns else F.lit(0)
    return stitched.select(
        event_id(F.col("source_id"), F.col("file_path"), generation, F.col("line_no")).alias("event_id"),
        "timestamp",
        "event_ts",
        F.current_timestamp().alias("received_at"),
        "source_id",
        "source_name",
        "file_path",
        "level",
        "message",
        "fields",
        "source_ord",
        "line_no",
        generation.cast("int").alias("generation"),
    )


def reject_events(rejected: DataFrame) -> DataFrame:
    """Rejected lines as events of level WARN without a time."""
    return as_events(rejected.select("source_id", "source_name", "source_ord", "file_path", "line_no", F.lit("").alias("timestamp"), F.lit(None).cast("timestamp_ntz").alias("event_ts"), F.lit("WARN").alias("level"), F.concat(F.lit("Malformed line: "), F.coalesce("value", F.lit(""))).alias("message"), F.create_map().cast("map<string,string>").alias("fields")))
