"""Live events: stateful stitching of tailed lines, and sinks with update semantics."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweft.functions.columns import event_id
from logweft.operators.filters import predicate
from logweft.operators.parse import parse_lines
from logweft.operators.timeline import append_version
from logweft.operators.timeline_store import BatchLog, TimelineStore
from logweft.operators.view import column_schema, event_json, snapshot_json
from logweft.plans.config import LogFilter, ParserConfig, Selection
from logweft.sources import shared_files
from logweft.sources.files import file_name_matches, name_glob, with_source
from logweft.sources.matrix import resolve_sources
from logweft.streaming.backlog import has_seeds, read_backlog
from logweft.streaming.tail import GONE, SEED, TailSource

_ATTRIBUTES = ("timestamp", "event_ts", "level", "message", "fields", "source_name", "source_ord")
STITCHED = (
    "kind string, source_id string, file_path string, generation int, line_no bigint, source_name string, source_ord bigint, "
    "timestamp string, event_ts timestamp_ntz, level string, message string, fields string, is_backfill boolean"
)
EVENT = "event_id string, timestamp string, event_ts timestamp_ntz, received_at timestamp, source_id string, source_name string, file_path string, level string, message string, fields map<string,string>, source_ord bigint, line_no bigint, generation int"
STATE = "generation int, next_line bigint, last_offset bigint, head string, has_event boolean, n_more bigint, line_no bigint, source_name string, source_ord bigint, timestamp string, event_ts string, level string, message string, fields string"

#: In place of an open event.
NOTHING = (0, None, 0, None, None, None, None, None)


def tail_lines(spark: SparkSession, sources: DataFrame, selection: Selection, **options) -> DataFrame:
    """Lines appended to the matching files of the sources, as they come. Files of other names aren't opened."""
    spark.dataSource.register(TailSource)
    rows = sources.collect()  # a row for each share of a selection; as a local table it can stand in a streaming plan
    directories = [r["directory"] for r in rows]
    sources = spark.createDataFrame(rows, sources.schema)
    lines = spark.readStream.format("logtail").options(**{"directories": json.dumps(directories), "pattern": name_glob(selection), **options}).load()
    return with_source(lines.where(file_name_matches(F.col("file_name"), selection)), sources)


def _stitch_file(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, most: int | None = None) -> Iterator[pd.DataFrame]:
    """New and grown events of one file, put together run by run from header to header. A file that begins anew is a new generation, whose lines are counted from 0.

    A batch holds `maxBytesPerFile` of the file at most; of an event, ``most`` continuation lines are kept. A seed is
    the state that a backlog's batch left. Of a file that is gone, the number of the generation is kept alone, so that
    a file by its name has ids of its own.
    """
    rows = pd.concat(list(parts), ignore_index=True).sort_values("offset", kind="stable")
    generation, next_line, last, head, has_event, n_more, *event = state.get if state.exists else (0, 0, -1, None, False, 0, *NOTHING)
    good, broken = rows[rows["offset"] >= 0].reset_index(drop=True), rows[rows["error"].notna()]
    if not state.exists and len(seeds := rows[rows["offset"] == SEED]):
        seed, r = json.loads(seeds["value"].iloc[0]), seeds.iloc[0]
        next_line, last, head = seed["next_line"], 0, r["head"]
        if open_event := seed.get("event"):
            has_event, n_more = True, open_event["n_more"]
            event = [open_event["line_no"], r["source_name"], int(r["source_ord"]), *(open_event.get(c) for c in ("timestamp", "event_ts", "level", "message", "fields"))]
    if len(good) and last >= 0 and (int(good["offset"].iloc[0]) <= last or good["head"].iloc[0] != head):
        generation, next_line, has_event = generation + 1, 0, False
    values, out = good["value"].fillna("").tolist(), []
    backfill = good["is_backfill"].astype(bool).tolist()
    heads = np.flatnonzero(good["is_header"].to_numpy(bool)).tolist()
    lead = heads[0] if heads else len(good)
    row = lambda kind, event, back: (kind, *key, generation, event[0], event[1], event[2], event[3], pd.Timestamp(event[4]) if event[4] else pd.NaT, *event[5:], back)

    def kept(n: int) -> int:
        """How many of n further lines the open event takes."""
        return n if most is None else max(0, min(n, most - n_more))

    if lead and has_event:
        event[6] = "\n".join([event[6], *values[: kept(lead)]])
        n_more += kept(lead)
        out.append(row("event", event, backfill[lead - 1]))
    elif lead:
        for i in range(lead):
            out.append(row("reject", [next_line + i, good["source_name"].iat[i], int(good["source_ord"].iat[i]), None, None, None, values[i], None], backfill[i]))
    for i, stop in zip(heads, [*heads[1:], len(good)]):
        n_more = 0
        n_more, r = kept(stop - i - 1), good.iloc[i]
        event = [next_line + i, r["source_name"], int(r["source_ord"]), r["timestamp"], None if pd.isna(r["event_ts"]) else str(r["event_ts"]), r["level"], "\n".join([r["message"], *values[i + 1 : i + 1 + n_more]]), r["fields"]]
        has_event = True
        out.append(row("event", event, backfill[stop - 1]))
    for r in broken.itertuples(index=False):
        out.append(row("error", [-1, r.source_name, int(r.source_ord), None, None, None, r.error, None], bool(r.is_backfill)))
    if len(good):
        next_line, last, head = next_line + len(good), int(good["offset"].iloc[-1]), good["head"].iloc[-1]
    if (rows["offset"] == GONE).any():
        generation, next_line, last, head, has_event, n_more, event = generation + (next_line > 0), 0, -1, None, False, 0, NOTHING
    if len(good) < len(rows) - len(broken) or len(good):
        state.update((generation, next_line, last, head, has_event, n_more, *event))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in STITCHED.split(", ")]).astype({"event_ts": "datetime64[us]"})


def live_events(lines: DataFrame, *configs: ParserConfig, max_continuation_lines: int | None = None) -> DataFrame:
    """Events as they begin or grow, with ``kind``: event, reject (a continuation before any event) or error (a file that couldn't be read).

    ``max_continuation_lines`` cuts what is appended to one event, as in batch, and so bounds what is kept of it.
    """
    parsed = parse_lines(lines, *configs).withColumn("fields", F.to_json("fields")).withColumn("event_ts", F.col("event_ts").cast("string"))
    whole = lambda key, parts, state: _stitch_file(key, parts, state, max_continuation_lines)
    stitched = parsed.groupBy("source_id", "file_path").applyInPandasWithState(whole, STITCHED, STATE, "update", GroupStateTimeout.NoTimeout)
    return stitched.select(
        "kind",
        event_id(F.col("source_id"), F.col("file_path"), F.col("generation"), F.col("line_no")).alias("event_id"),
        "timestamp",
        "event_ts",
        F.current_timestamp().alias("received_at"),
        "source_id",
        "source_name",
        "file_path",
        "level",
        "message",
        F.from_json("fields", "map<string,string>").alias("fields"),
        "source_ord",
        "line_no",
        "generation",
        "is_backfill",
    )


def store(live: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep events as versions under ``path`` (see `timeline.stored_timeline`); a batch that is replayed replaces itself."""
    write = lambda batch, n: append_version(batch.where("kind = 'event'").drop("kind", "is_backfill"), path, n)
    return live.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"processingTime": "1 second"})).start()


def deliver(live: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, wanted: Column | Callable[[], Column | None] | None = None, **trigger) -> StreamingQuery:
    """Give each batch's live events that pass the filter as JSON messages to ``send``; the filter sees events as grown, the backlog stays silent.

    ``wanted`` may be a function, which is asked anew for each batch.
    """

    def batch(rows: DataFrame, n: int) -> None:
        rows = rows.where("kind = 'event' and not is_backfill")
        test = wanted() if callable(wanted) and not isinstance(wanted, Column) else wanted
        send((rows if test is None else rows.where(test)).select(event_json().alias("value")), n)

    return live.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"processingTime": "1 second"})).start()


#: What a feed keeps of lines without an event, and of files that couldn't be read.
REJECT = "source_id string, source_name string, file_path string, generation int, line_no bigint, value string"
ERROR = "source_id string, source_name string, file_path string, message string"


def fan_out(live: DataFrame, timeline: TimelineStore, rejects: BatchLog, errors: BatchLog, send: Callable[[DataFrame, int], None], checkpoint: str, wanted: Callable[[], Column | None], compact_every: int = 20, **trigger) -> StreamingQuery:
    """One stateful query with several sinks: each batch is kept once while its events, rejected lines and errors are stored and its messages sent.

    The stores take a replayed batch in place of itself; messages are sent at least once. Each ``compact_every``
    batches the timeline is compacted, so what a page reads stays small. Batch 0 of the stores is the backlog's (see
    `backlog`), so the stream's are counted from 1 there.
    """

    def batch(rows: DataFrame, n: int) -> None:
        rows, n = rows.persist(), n + 1
        try:
            kinds = {r["kind"] for r in rows.select("kind").distinct().collect()}  # three at most
            if "event" in kinds:
                timeline.append(rows.where("kind = 'event'"), n)
            if "reject" in kinds:
                rejects.append(rows.where("kind = 'reject'").withColumnRenamed("message", "value"), n)
            if "error" in kinds:
                errors.append(rows.where("kind = 'error'"), n)
            if n % compact_every == 0:
                timeline.compact(n)
                timeline.vacuum(keep=3)
            if "event" in kinds:
                test, fresh = wanted(), rows.where("kind = 'event' AND NOT is_backfill")
                send((fresh if test is None else fresh.where(test)).select(event_json().alias("value")), n)
        finally:
            rows.unpersist()

    return live.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"processingTime": "1 second"})).start()


class Feed:
    """A selection that is followed: its events are stored, and live ones that pass the filter are sent on.

    Everything is under ``folder``: the stored timeline, rejected lines, errors and the checkpoint of the one query, by
    selection, so that a selection which is followed again goes on where it stood.
    """

    def __init__(
        self, spark: SparkSession, matrix: DataFrame, folder: str, send: Callable[[DataFrame, int], None], *configs: ParserConfig,
        base_dir: str | None = None, max_continuation_lines: int | None = 10_000, compact_every: int = 20, **trigger,
    ):
        self.spark, self.matrix, self.folder, self.send, self.configs = spark, matrix, folder.rstrip("/"), send, configs
        self.base_dir, self.most, self.compact_every, self.trigger = base_dir, max_continuation_lines, compact_every, trigger or {"processingTime": "1 second"}
        self.filter, self.selection, self.sources, self.queries, self.backlog = LogFilter(), None, None, [], {}

    def _path(self, name: str) -> str:
        s = self.selection
        mark = hashlib.sha256("|".join((s.environment, s.country, s.tier, s.name, s.date)).encode()).hexdigest()[:16]
        return f"{self.folder}/{mark}/{name}"

    def subscribe(self, selection: Selection, wanted: LogFilter | None = None) -> DataFrame:
        """Follow a selection in place of the one before; its sources. A selection that isn't valid has none, and nothing is followed.

        What the files hold when a selection is first followed is read by batch, before this returns.
        """
        self.unsubscribe()
        self.selection, self.filter = selection, wanted or LogFilter()
        self.sources = resolve_sources(self.matrix, selection, self.base_dir)
        if selection.valid:
            at, seeds = self._path("feed"), self._path("seeds")
            stores = self.timeline, self._log("rejects", REJECT), self._log("errors", ERROR)
            known = has_seeds(self.spark, seeds)
            if not known and not shared_files.names(self.spark, f"{at}/offsets"):
                self.backlog = read_backlog(self.spark, self.sources, selection, *stores[:2], seeds, *self.configs, max_continuation_lines=self.most)
                known = bool(self.backlog)
            lines = tail_lines(self.spark, self.sources, selection, checkpoint=at, **({"seeds": seeds} if known else {}))
            is_line = F.col("offset") >= 0
            lines = lines.observe("tailed", F.count_if(is_line).alias("n_lines"), F.coalesce(F.sum(F.when(is_line, F.octet_length("value") + 1)), F.lit(0)).alias("n_bytes"))
            live = live_events(lines, *self.configs, max_continuation_lines=self.most)
            self.queries = [fan_out(live, *stores, self.send, at, self._wanted, self.compact_every, **self.trigger)]
        return self.sources

    def _wanted(self) -> Column:
        return predicate(self.spark, self.filter)

    def set_filter(self, **changes) -> LogFilter:
        """Change the filter (see `LogFilter.merged`): it holds from the next batch on, and for snapshots."""
        self.filter = self.filter.merged(**changes)
        return self.filter

    def unsubscribe(self) -> None:
        for query in self.queries:
            query.stop()
        self.queries, self.selection, self.sources, self.backlog = [], None, None, {}

    @property
    def timeline(self) -> TimelineStore:
        return TimelineStore(self.spark, self._path("timeline"))

    def _log(self, name: str, schema: str) -> BatchLog:
        return BatchLog(self.spark, self._path(name), schema)

    def rejects(self) -> DataFrame:
        """Lines that came before any event of their file."""
        log = self._log("rejects", REJECT)
        return log.deltas(log.commits()).drop("version")

    def errors(self) -> DataFrame:
        """Each file that couldn't be read, once for each cause, with the first and the last batch in which that was so."""
        log = self._log("errors", ERROR)
        found = log.deltas(log.commits()).groupBy("source_id", "source_name", "file_path", "message")
        return found.agg(F.min("version").alias("first_batch"), F.max("version").alias("last_batch"))

    def progress(self) -> dict:
        """Lines and bytes of the last batch that had some, and its number (-1: the backlog); nothing before the first."""
        for p in reversed(self.queries[0].recentProgress if self.queries else []):
            seen = (p.observedMetrics or {}).get("tailed")
            if seen is not None and seen["n_lines"]:
                return {"batch": p.batchId, "n_lines": seen["n_lines"], "n_bytes": seen["n_bytes"]}
        return {"batch": -1, **self.backlog} if self.backlog else {}

    def snapshot(self) -> str:
        """The newest stored page that passes the filter, with sources and columns, as one message."""
        page = self.timeline.newest(self.filter)
        return snapshot_json(page.rows, page.has_more(), self.sources, column_schema(self.spark, *self.configs[:1])).first()[0]
