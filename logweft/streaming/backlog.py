"""The backlog of a feed, read by batch: many tasks a file, and a stream that goes on from its end.

`plan` notes how far each file's whole lines reach. `read_backlog` deals these bytes out in spans (a line belongs to
the span that it begins in), stitches them within the tasks (`operators.fold`), and stores the events and the rejected
lines as batch 0. What a stream needs to go on is a row for each file: its end, its lines so far and the event that is
still open. These `seeds` are written last and make the backlog count; a run that ends before that is done again in
place of itself. The tailing source hands each seed to the stateful operator with its first batch, so event ids, line
numbers and an event that grows over the seam are those of one stream from the beginning.

A file that can't be read, or that is another one by then, has no seed: nothing of it is kept, and the stream reads it
from its beginning.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from logweft.functions.columns import base_name
from logweft.operators.fold import stitch_staged
from logweft.operators.parse import parse_lines
from logweft.operators.stitch import as_events
from logweft.operators.timeline_store import BatchLog
from logweft.plans.config import ParserConfig, Selection
from logweft.sources import shared_files
from logweft.sources.files import file_name_matches, name_glob, with_source
from logweft.streaming.tail import SCHEMA, Span, TailReader, head_of, line_end_after, lines_between

SPAN_BYTES = 32 << 20
KEYS = ("source_id", "file_path", "error")


@dataclass
class Spans(InputPartition):
    """What one task reads: spans of files, `SPAN_BYTES` together."""

    spans: list[Span]

    def __init__(self, spans: list[Span]):
        super().__init__(None)
        self.spans = spans


class BacklogReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.ends = json.loads(options["ends"])
        self.width = int(options.get("spanbytes", SPAN_BYTES))

    def partitions(self) -> list[Spans]:
        tasks, room = [], 0
        for path, (end, head) in sorted(self.ends.items()):
            for begin in range(0, end, self.width):
                span = Span(path, begin, min(begin + self.width, end), head, True)
                if room < span.end - begin:
                    tasks.append([])
                    room = self.width
                tasks[-1].append(span)
                room -= span.end - begin
        return [Spans(t) for t in tasks] or [Spans([])]

    def read(self, task: Spans) -> Iterator[tuple]:
        for span in task.spans:
            try:
                if head_of(span.path) != span.head:
                    raise OSError("begins with other bytes than before")
                end = self.ends[span.path][0]
                at = line_end_after(span.path, span.begin - 1, end) if span.begin else 0
                yield from lines_between(span, at, end)
            except OSError as e:
                yield None, span.path, os.path.basename(span.path), -1 - span.begin, span.head, True, str(e)


class BacklogSource(DataSource):
    """Options: ends (JSON, by file its end and the mark of its begin), spanBytes."""

    @classmethod
    def name(cls) -> str:
        return "logbacklog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BacklogReader:
        return BacklogReader(dict(self.options))


def plan(spark: SparkSession, sources: DataFrame, selection: Selection) -> DataFrame:
    """file_path, end and head of the selection's files that have whole lines. The driver opens them as the stream's planning does."""
    directories = [r["directory"] for r in sources.select("directory").collect()]
    found = TailReader({"directories": json.dumps(directories), "pattern": name_glob(selection)}).latestOffset()
    rows = spark.createDataFrame([(path, end, head) for path, (end, head, _) in found.items()], "file_path string, end bigint, head string")
    return rows.where(file_name_matches(base_name(F.col("file_path")), selection))


def backlog_lines(spark: SparkSession, planned: DataFrame, width: int = SPAN_BYTES) -> DataFrame:
    """The planned lines, with ``chunk`` (the span that a line begins in)."""
    spark.dataSource.register(BacklogSource)
    ends = {r["file_path"]: [r["end"], r["head"]] for r in planned.collect()}  # a row for each file of a selection
    lines = spark.read.format("logbacklog").options(ends=json.dumps(ends), spanBytes=str(width)).load()
    return lines.select("value", "file_path", "offset", F.floor(F.col("offset") / width).alias("chunk"), F.coalesce("error", F.lit("")).alias("error"))


def seeds_of(planned: DataFrame, events: DataFrame, splits: DataFrame, most: int | None) -> DataFrame:
    """file_path, end, head and seed (JSON) of each file that was read whole."""
    n_more = F.col("n_lines") - 1 if most is None else F.least(F.col("n_lines") - 1, F.lit(most))
    shown = F.struct(n_more.alias("n_more"), "line_no", "timestamp", F.col("event_ts").cast("string").alias("event_ts"), "level", "message", F.to_json("fields").alias("fields"))
    last = events.groupBy("file_path").agg(F.max_by(shown, "line_no").alias("event"))
    read = splits.groupBy("file_path").agg(F.max("n_all").alias("next_line"), F.max(F.col("error") != "").alias("broken"))
    rows = planned.join(read.where("NOT broken"), "file_path").join(last, "file_path", "left")
    return rows.select("file_path", "end", "head", F.to_json(F.struct("next_line", "event")).alias("seed"))


def has_seeds(spark: SparkSession, path: str) -> bool:
    return "_SUCCESS" in shared_files.names(spark, path)


def read_backlog(spark: SparkSession, sources: DataFrame, selection: Selection, timeline: BatchLog, rejects: BatchLog, path: str, *configs: ParserConfig, max_continuation_lines: int | None = None, width: int = SPAN_BYTES) -> dict[str, int]:
    """Store the backlog's events and rejected lines as batch 0, and its seeds under ``path``; its n_lines and n_bytes, or nothing if there is none."""
    planned = plan(spark, sources, selection).cache()
    try:
        if planned.isEmpty():
            return {}
        lines = parse_lines(with_source(backlog_lines(spark, planned, width), sources), *configs)
        done = stitch_staged(lines, KEYS, "chunk", "offset", max_continuation_lines=max_continuation_lines)
        try:
            whole = done.splits.groupBy("source_id", "file_path", "error").agg(F.sum("n_lines").alias("n_all"), F.sum("n_bytes").alias("n_bytes"))
            broken = whole.where("error <> ''").select("file_path").distinct()
            events, lost = (t.join(broken, "file_path", "left_anti") for t in (done.events, done.rejected))
            timeline.append(as_events(events), 0)
            rejects.append(lost.withColumn("generation", F.lit(0)), 0)
            seeds_of(planned, events, whole, max_continuation_lines).write.mode("overwrite").parquet(path)
            return whole.where("error = ''").agg(F.coalesce(F.sum("n_all"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes")).first().asDict()
        finally:
            done.release()
    finally:
        planned.unpersist()
