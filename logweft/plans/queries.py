"""The operators on the driver's tables, and the same in SQL.

The tables stand in for logs: `events` are rendered as log lines of three sources, `conversations` are files whose
turns are lines, `documents` are files of lines, `region` and `nation` are the environment matrix.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.functions.columns import base_name, label
from logweft.operators import alignment, filters, fold, metrics, paging, stitch, timeline, view
from logweft.operators.parse import parse_lines
from logweft.operators.timeline_store import TimelineStore
from logweft.plans.config import DEFAULT_PATTERN, FILE_KINDS, LogFilter, ParserConfig, Selection, toggled, until_input
from logweft.sources import files, matrix, shared_files
from logweft.sources.staging import stage, staging_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events as log lines ---------------------------------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.create_map(*(F.lit(x) for x in ("error", "ERROR", "signup", "WARN", "purchase", "INFO", "view", "DEBUG", "click", "TRACE")))[F.col("event_type")]
    number = (F.col("user_id") % 3).cast("string")
    return e.select(
        F.format_string(
            "%s %s [worker-%s] app.%s - value=%s requestId=R%s sessionId=S%s",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), level, (F.col("user_id") % 8).cast("string"), F.col("event_type"),
            F.col("value").cast("decimal(18,2)").cast("string"), F.col("event_id").cast("string"), (F.col("user_id") % 50).cast("string"),
        ).alias("value"),
        F.concat(F.lit("source-"), number).alias("source_id"),
        F.concat(F.lit("[S"), number, F.lit("] /share/"), number).alias("source_name"),
        (F.col("user_id") % 3).alias("source_ord"),
        F.concat(F.lit("/share/"), number, F.lit("/app.log")).alias("file_path"),
        F.floor(F.col("event_id") / 500).cast("long").alias("chunk"),
        F.col("event_id").alias("pos"),
    )


def log_events(spark: SparkSession, sf_dir: str, headers: Column | None = None) -> DataFrame:
    """``headers``: a test of headers; the lines of other events aren't gathered."""
    numbered = stitch.number_by_chunk(parse_lines(log_lines(spark, sf_dir)), wanted=headers)
    return stitch.as_events(stitch.stitch(numbered)).drop("received_at")


_LINES = """
SELECT event_id AS n, ts, user_id % 3 AS o, 'source-' || user_id % 3 AS source_id, '[S' || user_id % 3 || '] /share/' || user_id % 3 AS source_name,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS "timestamp", date_trunc('millisecond', ts::TIMESTAMP) AS event_ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END AS level,
 'worker-' || user_id % 8 AS thread, 'app.' || event_type AS logger, 'value=' || value::DECIMAL(18,2) || ' requestId=R' || event_id || ' sessionId=S' || user_id % 50 AS message,
 row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS line_no, event_id, user_id, event_type, value
FROM events"""
_HAY = "\"timestamp\" || ' ' || source_name || ' ' || level || ' ' || message || ' ' || thread || ' ' || logger"
_NEWEST = "ORDER BY event_ts DESC, o, line_no"


def _shown(events: DataFrame) -> DataFrame:
    return events.select("source_id", "line_no", "timestamp", "level", "message")


_SHOWN = 'source_id, line_no, "timestamp", level, message'


@query(f"SELECT {_SHOWN}, source_name, thread, logger FROM ({_LINES})")
def parse_lines_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log_events(spark, sf_dir)
    return e.select("source_id", "line_no", "timestamp", "level", "message", "source_name", e["fields"]["thread"].alias("thread"), e["fields"]["logger"].alias("logger"))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) {_NEWEST} LIMIT 50")
def timeline_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(paging.newest(log_events(spark, sf_dir)).rows)


def _filtered(spark: SparkSession, sf_dir: str, wanted: LogFilter) -> DataFrame:
    return _shown(filters.apply_filter(log_events(spark, sf_dir, filters.level_is(wanted.levels)), wanted))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE level IN ('ERROR', 'WARN')")
def filter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, LogFilter(levels=("ERROR", "WARN")))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE contains(lower({_HAY}), 'requestid=r12')")
def filter_text_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, LogFilter(text="REQUESTID=R12"))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE contains({_HAY}, 'worker-3 app.click')")
def filter_text_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match over the border of two fields."""
    return _filtered(spark, sf_dir, LogFilter(text="worker-3 app.click", case_sensitive=True))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE regexp_matches({_HAY}, 'VALUE=\\d{{1,2}}\\.\\d+ .*app\\.(view|click)$', 'i')")
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, LogFilter(text=r"VALUE=\d{1,2}\.\d+ .*app\.(view|click)$", regex=True))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE contains(lower({_HAY}), '[s1')")
def filter_bad_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that isn't valid is looked for as text."""
    return _filtered(spark, sf_dir, LogFilter(text="[S1", regex=True))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE level = 'ERROR' AND contains(lower({_HAY}), 'sessionid=s7')")
def filter_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, LogFilter().merged(text="SessionId=S7", levels=["ERROR"]))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE source_id = 'source-1' AND thread = 'worker-2'")
def filter_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(log_events(spark, sf_dir, filters.attribute_is(source_id="source-1", thread="worker-2")))


@query(f"SELECT coalesce(\"timestamp\", '') AS \"timestamp\", source_name AS \"sourceName\", level, message, thread, '' AS \"nothing\" FROM ({_LINES})")
def table_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ParserConfig(groups={"thread": "thread", "logger": "logger", "nothing": "nothing"})
    return view.table_view(log_events(spark, sf_dir), config, order=["gone", "message", "thread"], hidden={"logger", "message"})


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE event_id % 7 = 0 AND level <> 'TRACE'")
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log_events(spark, sf_dir)
    ids = e.where(F.regexp_extract("message", r"requestId=R(\d+)", 1).cast("long") % 7 == 0).where("level <> 'TRACE'").select("event_id")
    return _shown(view.selected(e, ids))


@query(f"WITH p AS (SELECT *, unnest([{{'key': 'requestId', 'value': 'R' || event_id}}, {{'key': 'sessionId', 'value': 'S' || user_id % 50}}]) AS pair FROM ({_LINES})) SELECT pair.key AS key, pair.value AS value, source_id, line_no FROM p")
def correlate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.correlate(log_events(spark, sf_dir)).select("key", "value", "source_id", "line_no")


@query(f"SELECT 'S' || user_id % 50 AS value, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%g') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%g') AS last, count(*) AS n_events, count(DISTINCT o) AS n_sources FROM ({_LINES}) GROUP BY user_id % 50")
def request_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.traces(metrics.correlate(log_events(spark, sf_dir), ("sessionId",)))
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(c)
    return t.select("value", at("first"), at("last"), "n_events", "n_sources")


@query(f"SELECT source_id, line_no, 'S' || user_id % 50 AS value, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_ts, o, line_no) AS step FROM ({_LINES})")
def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = metrics.trace_steps(metrics.correlate(log_events(spark, sf_dir), ("sessionId",)))
    return steps.select("source_id", "line_no", "value", "step")


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events, count(*) FILTER (level = 'WARN') AS n_warnings, count(*) FILTER (level = 'ERROR') AS n_errors, 0::BIGINT AS n_failures, count(DISTINCT o) AS n_sources, count(DISTINCT o) AS n_files FROM ({_LINES}) GROUP BY 1")
def events_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_window(log_events(spark, sf_dir), "1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) FILTER (level <> 'TRACE') AS n_events, count(*) FILTER (level = 'TRACE') AS n_failures, count(DISTINCT o) AS n_sources FROM ({_LINES}) GROUP BY 1")
def failures_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser that doesn't know the level TRACE: its lines fail, and are counted by the time when they came."""
    lines = log_lines(spark, sf_dir).withColumn("came", F.to_timestamp_ntz(F.substring("value", 1, 19)))
    parsed = parse_lines(lines, ParserConfig(pattern=DEFAULT_PATTERN.replace("TRACE|", "")))
    known = parsed.where("is_header").withColumn("event_ts", F.col("came"))
    failed = parsed.where("not is_header").withColumn("event_ts", F.col("came")).withColumn("level", F.lit("WARN"))
    w = metrics.per_window(known, "1 day", failures=failed)
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n_events", "n_failures", "n_sources")


@query(f"SELECT source_id, count(DISTINCT o) AS n_files, count(*) AS n_events, strftime(max(event_ts), '%Y-%m-%dT%H:%M:%S.%g') AS latest FROM ({_LINES}) GROUP BY source_id")
def instance_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.instances(log_events(spark, sf_dir)).withColumn("latest", F.date_format("latest", "yyyy-MM-dd'T'HH:mm:ss.SSS"))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) {_NEWEST} LIMIT 500")
def retain_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(timeline.retain_newest(log_events(spark, sf_dir), 500))


@query(
    "WITH m AS (SELECT user_id % 2 AS half, regexp_replace(regexp_replace('app.' || event_type || ' value=' || value::DECIMAL(18,2), '(\\w+)=\\S+', '\\1=?', 'g'), '\\d+', '#', 'g') || CASE WHEN user_id % 2 = 0 AND event_type = 'error' THEN ' first' ELSE '' END AS shape FROM events)"
    " SELECT shape, count(*) AS count FROM m WHERE half = 0 AND shape NOT IN (SELECT shape FROM m WHERE half = 1) GROUP BY shape"
)
def session_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("half", F.col("user_id") % 2)
    mark = F.when((F.col("half") == 0) & (F.col("event_type") == "error"), " first").otherwise("")
    e = e.select("half", F.concat(F.lit("app."), "event_type", F.lit(" value="), F.col("value").cast("decimal(18,2)").cast("string"), mark).alias("message"))
    return metrics.only_in_first(e.where("half = 0"), e.where("half = 1"))


@query()
def session_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions of what comes in each hour; SQL has no longest chain, so the operator is tested by brute force."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("half"), F.col("event_id").alias("step"), F.concat(F.date_format("ts", "dd HH "), "event_type").alias("shape"))
    return alignment.align(e.where("half = 0"), e.where("half = 1"))


_EVENT_JSON = (
    "to_json({'id': sha256(source_id || '|/share/' || o || '/app.log|0|' || line_no), 'timestamp': \"timestamp\", 'sourceId': source_id, 'sourceName': source_name, 'filePath': '/share/' || o || '/app.log',"
    " 'level': level, 'message': message, 'fields': {'thread': thread, 'logger': logger}})"
)


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without the time when they came, which differs from run to run."""
    return log_events(spark, sf_dir).withColumn("received_at", F.lit(None).cast("timestamp"))


@query(f"SELECT source_id, line_no, sha256(source_id || '|/share/' || o || '/app.log|0|' || line_no) AS event_id FROM ({_LINES})")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).select("source_id", "line_no", "event_id")


@query(f"SELECT {_EVENT_JSON}::VARCHAR AS value FROM ({_LINES})")
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sent(spark, sf_dir).select(view.event_json().alias("value"))


@query(f"WITH p AS (SELECT * FROM ({_LINES}) WHERE level = 'ERROR' {_NEWEST} LIMIT 50) SELECT to_json({{'append': 'bottom', 'events': list({_EVENT_JSON} {_NEWEST}), 'hasMore': (SELECT count(*) > 50 FROM events WHERE event_type = 'error')}})::VARCHAR AS value FROM p")
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = paging.newest(_sent(spark, sf_dir), LogFilter(levels=("ERROR",))).fetched()
    return view.page_json(page.rows, page.has_more())


@query(
    f"WITH p AS (SELECT * FROM ({_LINES}) {_NEWEST} LIMIT 50), e AS (SELECT list({_EVENT_JSON} {_NEWEST}) AS events FROM p),"
    " s AS (SELECT list(to_json({'id': n_name, 'name': '[' || n_name || ']', 'environment': 'E'}) ORDER BY n_nationkey) AS sources FROM nation),"
    " c AS (SELECT list(to_json({'id': f, 'label': l, 'field': f, 'width': w, 'hideable': h, 'groupId': g, 'groupLabel': k}) ORDER BY i) AS columns FROM (VALUES (0, 'timestamp', 'Time', 188, false, 'base', 'Base'), (1, 'sourceName', 'Source', 240, true, 'base', 'Base'), (2, 'level', 'Level', 90, false, 'base', 'Base'), (3, 'thread', 'Thread', 180, true, 'parsed-fields', 'Parsed fields'), (4, 'logger', 'Logger', 180, true, 'parsed-fields', 'Parsed fields'), (5, 'message', 'Message', 520, false, 'base', 'Base')) t(i, f, l, w, h, g, k))"
    " SELECT to_json({'events': events, 'hasMore': (SELECT count(*) > 50 FROM events), 'sources': sources, 'schema': {'columns': columns}})::VARCHAR AS value FROM e, s, c"
)
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.concat(F.lit("["), "n_name", F.lit("]")).alias("name"), F.lit("E").alias("environment"), F.col("n_nationkey").alias("source_ord"))
    seen = paging.snapshot(_sent(spark, sf_dir), LogFilter(), sources, view.column_schema(spark, ParserConfig()))
    page = seen.page.fetched()
    return view.snapshot_json(page.rows, page.has_more(), seen.sources, seen.columns)


@query(
    "WITH k AS (SELECT list_sort(list(DISTINCT event_type)) AS t FROM events), x AS (SELECT unnest(t) AS field, generate_subscripts(t, 1) + 2 AS position FROM k),"
    " b AS (SELECT * FROM (VALUES ('timestamp', 'Time', 0, 188, false), ('sourceName', 'Source', 1, 240, true), ('level', 'Level', 2, 90, false)) v(field, label, position, width, hideable))"
    " SELECT position::INT AS position, field, label, width, hideable, 'base' AS group_id FROM b"
    " UNION ALL SELECT position::INT, field, upper(field[1]) || field[2:], 180, true, 'parsed-fields' FROM x UNION ALL SELECT (SELECT max(position) + 1 FROM x)::INT, 'message', 'Message', 520, false, 'base'"
)
def column_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose extra fields are the types of events."""
    names = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())  # a few types
    schema = view.column_schema(spark, ParserConfig(groups={x: x for x in ("timestamp", "level", *names, "message")}))
    return schema.select("position", "field", "label", "width", "hideable", "group_id")


@query(
    f"SELECT {_SHOWN}, thread FROM (SELECT * REPLACE (CASE WHEN o = 1 THEN event_type ELSE message END AS message, CASE WHEN o = 1 THEN 'ERROR' ELSE level END AS level, CASE WHEN o = 1 THEN '' ELSE thread END AS thread) FROM ({_LINES}))"
)
def parsers_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source writes lines of another form, and has a parser of its own."""
    other = F.concat(F.substring("value", 1, 23), F.lit("|ERROR|"), F.regexp_extract("value", r"app\.(\w+) - ", 1))
    lines = log_lines(spark, sf_dir).withColumn("value", F.when(F.col("source_id") == "source-1", other).otherwise(F.col("value")))
    own = ParserConfig(r"^(?<at>[^|]+)\|(?<level>\w+)\|(?<message>.*)$", {"timestamp": "at", "level": "level", "message": "message"}, ("source-1",))
    events = stitch.as_events(stitch.stitch(stitch.number_by_chunk(parse_lines(lines, own, ParserConfig(sources=("source-0", "source-2"))))))
    return events.select("source_id", "line_no", "timestamp", "level", "message", F.coalesce(F.element_at("fields", F.lit("thread")), F.lit("")).alias("thread"))


@query(f"SELECT {_SHOWN} FROM ({_LINES}) WHERE level = 'WARN' AND contains({_HAY}, 'app.signup')")
def filter_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels switched on and off one by one, and then a text."""
    levels = reduce(toggled, ("ERROR", "WARN", "ERROR"), ())
    return _filtered(spark, sf_dir, LogFilter(levels=("DEBUG",)).merged(text="app.signup", levels=levels))


@query(f"SELECT sha256(source_id || '|/share/' || o || '/app.log|0|' || line_no) AS id, source_name, \"timestamp\", message, logger FROM ({_LINES}) WHERE level = 'ERROR'")
def export_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors as an export, read again."""
    events, path = _sent(spark, sf_dir), f"{staging_folder(spark)}/export-{uuid.uuid4().hex}"
    view.export_text(events, events.where("level = 'ERROR'").select("event_id"), path)
    text = spark.read.text(path, lineSep="\n\n")
    one = F.from_json("value", "id string, sourceName string, timestamp string, message string, fields map<string,string>")
    return text.select(one.alias("e")).select("e.id", F.col("e.sourceName").alias("source_name"), "e.timestamp", "e.message", F.col("e.fields")["logger"].alias("logger"))


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """The lines as log files in the folders of three shares, with a matrix that names them; where they are."""
    root = f"{staging_folder(spark)}/shares-{uuid.uuid4().hex}"
    lines = log_lines(spark, sf_dir).select("value", "source_ord", "pos").repartitionByRange("source_ord", "pos").sortWithinPartitions("source_ord", "pos")
    lines.drop("pos").write.partitionBy("source_ord").text(f"{root}/written")
    shares = [x for x in shared_files.names(spark, f"{root}/written") if x.startswith("source_ord=")]
    for share in shares:
        parts = [x for x in shared_files.names(spark, f"{root}/written/{share}") if x.startswith("part-")]
        for i, part in enumerate(parts):  # a file for each task that wrote some of the share
            shared_files.move(spark, f"{root}/written/{share}/{part}", f"{root}/{share[11:]}/Java/apache-tomcat-back/logs/APP-{FILE_KINDS[i % 3]}.2026-07-29-{i}.log")
    entry = {"environment": "E", "country": "C", "code": "c", "host": "h", "shares": [f"{root}/{x[11:]}" for x in shares]}
    shared_files.write_text(spark, f"{root}/matrix.json", json.dumps([entry]))
    return root


@query(f"SELECT o AS source_ord, \"timestamp\", level, message, thread, logger FROM ({_LINES})")
def files_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the matrix over its shares and their files to one timeline."""
    wanted = Selection("E", "C", "back", "app", "2026-07-29")
    sources = matrix.resolve_sources(matrix.read_json(spark, f"{log_files(spark, sf_dir)}/matrix.json"), wanted)
    events = timeline.load(spark, sources, wanted).events
    return events.select("source_ord", "timestamp", "level", "message", F.col("fields")["thread"].alias("thread"), F.col("fields")["logger"].alias("logger"))


@query("SELECT user_id % 3 AS source_ord, count(*) AS n_lines, 0::BIGINT AS n_failed FROM events GROUP BY 1")
def files_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each source's files, from the scan that loaded them."""
    wanted = Selection("E", "C", "back", "app", "2026-07-29")
    sources = matrix.resolve_sources(matrix.read_json(spark, f"{log_files(spark, sf_dir)}/matrix.json"), wanted)
    return timeline.load(spark, sources, wanted).sources.select("source_ord", "n_lines", "n_failed")


# --- paging with many equal times ------------------------------------------------------------------------------


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose times are cut to the hour, so that ties are common; event_id is the order of arrival."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("event_ts"), (F.col("user_id") % 3).alias("source_ord"), F.lit("/app.log").alias("file_path"), F.col("event_id").alias("line_no"), "event_type")


_HOURLY = "SELECT event_id, date_trunc('hour', ts::TIMESTAMP) AS t, user_id % 3 AS o, event_type, row_number() OVER (ORDER BY date_trunc('hour', ts) DESC, user_id % 3, event_id) AS r FROM events"


@query(f"WITH h AS ({_HOURLY}), c AS (SELECT r FROM h WHERE event_id = 77) SELECT event_id, o AS source_ord FROM h, c WHERE h.r > c.r AND h.r <= c.r + 200")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.after_cursor(hourly_events(spark, sf_dir), 77, 200).rows.select("event_id", "source_ord")


@query(f"SELECT event_id, o AS source_ord FROM ({_HOURLY}) WHERE r <= (SELECT min(r) FROM ({_HOURLY}) WHERE t <= (SELECT date_trunc('minute', max(ts::TIMESTAMP) - INTERVAL 1 DAY) FROM events))")
def until_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down to a time as it is typed, to the minute."""
    at = table(spark, sf_dir, "events").agg(F.date_format(F.max("ts") - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm")).first()[0]
    return paging.until(hourly_events(spark, sf_dir), until_input(at)).rows.select("event_id", "source_ord")


@query(f"SELECT event_id, o AS source_ord FROM ({_HOURLY}) WHERE r <= (SELECT min(r) FROM ({_HOURLY}) WHERE t <= (SELECT max(ts::TIMESTAMP) - INTERVAL 2 DAY FROM events))")
def until_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = e.agg(F.date_format(F.max("ts") - F.expr("INTERVAL 2 DAYS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()[0]
    return paging.until(hourly_events(spark, sf_dir), at).rows.select("event_id", "source_ord")


@query(
    "WITH a AS (SELECT event_id FROM events WHERE event_type IN ('click', 'view'))"
    " SELECT event_id, 0 AS side FROM a UNION ALL SELECT event_id, 1 AS side FROM events WHERE event_id NOT IN (SELECT event_id FROM a)"
)
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events come in; those of two types are there already."""
    h = hourly_events(spark, sf_dir)
    return timeline.merge_pages(h.where("event_type in ('click', 'view')"), h).select("event_id", F.col("_side").alias("side"))


@query(
    f"WITH h AS ({_HOURLY}), n AS (SELECT count(*) AS n FROM h), m AS (SELECT l, greatest(1, least(1000, coalesce(l, 50))) AS size FROM (VALUES (0), (1), (200), (1000000), (NULL)) v(l))"
    " SELECT coalesce(l, -1)::BIGINT AS asked, count(h.r) AS n_rows, any_value(n) > any_value(c.r) + any_value(size) AS has_more FROM m JOIN n ON true JOIN (SELECT r FROM h WHERE event_id = 77) c ON true LEFT JOIN h ON h.r > c.r AND h.r <= c.r + m.size GROUP BY l"
)
def page_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that are asked for are held to their bounds, and a page tells whether rows are left after it."""
    e, rows = hourly_events(spark, sf_dir), []
    for asked in (0, 1, 200, 1_000_000, None):
        page = paging.after_cursor(e, 77, asked)
        rows.append(page.rows.agg(F.lit(-1 if asked is None else asked).cast("long").alias("asked"), F.count("*").alias("n_rows")).withColumn("has_more", F.lit(page.has_more())))
    return reduce(DataFrame.unionByName, rows)


@query("SELECT user_id, event_id AS version, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return timeline.latest_versions(e, "user_id")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'changed' ELSE event_type END AS event_type FROM events")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return timeline.upsert(e, e.where("event_id % 5 = 0").withColumn("event_type", F.lit("changed")))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[TimelineStore, DataFrame]:
    """The events of `log_events` in a stored timeline: all but some in a first batch, which is compacted, then those and a later version of others."""
    store = TimelineStore(spark, f"{staging_folder(spark)}/timeline-{uuid.uuid4().hex}")
    events, _ = stage(_sent(spark, sf_dir), "sent")  # parsed once
    number = F.regexp_extract("message", r"requestId=R(\d+)", 1).cast("long")
    store.append(events.where(number % 10 != 3), 0)
    store.compact()
    late = events.where((number % 10 == 3) | (number % 10 == 4))
    store.append(late.withColumn("message", F.when(number % 10 == 4, F.concat("message", F.lit(" grown"))).otherwise(F.col("message"))), 1)
    return store, events


_GROWN = f"SELECT * REPLACE (message || CASE WHEN event_id % 10 = 4 THEN ' grown' ELSE '' END AS message) FROM ({_LINES})"


@query(f"SELECT {_SHOWN} FROM ({_GROWN})")
def stored_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows and newer versions over a compacted base, compacted once more."""
    store, _ = _stored(spark, sf_dir)
    store.compact()
    return _shown(store.events())


@query(f"WITH r AS (SELECT *, row_number() OVER ({_NEWEST}) AS r FROM ({_GROWN})) SELECT {_SHOWN} FROM r WHERE r > (SELECT r FROM r WHERE event_id = 777) AND r <= (SELECT r FROM r WHERE event_id = 777) + 200")
def page_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page deep in a stored timeline: its buckets are read alone, and what came since the last compaction."""
    store, events = _stored(spark, sf_dir)
    cursor = events.where("message LIKE '%requestId=R777 %'").select("event_ts", "source_ord", "file_path", "line_no").first()
    return _shown(store.after_cursor(cursor.asDict(), 200).rows)


@query(f"SELECT {_SHOWN} FROM ({_GROWN}) {_NEWEST} LIMIT 1000")
def stored_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _stored(spark, sf_dir)
    store.retain_newest(1000)
    return _shown(store.events())


@query("SELECT event_type AS name, upper(event_type[1]) || event_type[2:] || ' Request ID' AS label FROM (SELECT DISTINCT event_type FROM events)")
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type").distinct().select(F.col("event_type").alias("name"), label(F.concat("event_type", F.lit("_requestId"))).alias("label"))


# --- stitching -------------------------------------------------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("value"), (F.col("role") == "user").alias("is_header"), F.col("text").alias("message"))


_TURNS = "SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations"


@query(f"SELECT conv_id, s::BIGINT AS event_seq, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY turn) AS message FROM ({_TURNS}) WHERE s > 0 GROUP BY conv_id, s")
def stitch_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = stitch.number_by_window(_turns(spark, sf_dir), ("conv_id",), ("turn",))
    return stitch.stitch(numbered, ("conv_id",)).select("conv_id", "event_seq", "n_lines", "message")


@query(f"SELECT conv_id, turn, text AS value FROM ({_TURNS}) WHERE s = 0")
def stitch_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.rejects(stitch.number_by_window(_turns(spark, sf_dir), ("conv_id",), ("turn",))).select("conv_id", "turn", "value")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, in chunks of ten; long lines are headers."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return lines.select("*", F.floor(F.col("pos") / 10).cast("long").alias("chunk"), (F.length("value") >= 40).alias("is_header"), F.col("value").alias("message"))


_DOC_LINES = """SELECT *, sum((length(value) >= 40)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM
 (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"""


@query(f"SELECT doc_id, s::BIGINT AS event_seq, min(pos)::BIGINT AS line_no, count(*) AS n_lines, string_agg(value, chr(10) ORDER BY pos) AS message FROM ({_DOC_LINES}) WHERE s > 0 GROUP BY doc_id, s")
def stitch_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = stitch.number_by_chunk(document_lines(spark, sf_dir), ("doc_id",))
    return stitch.stitch(numbered, ("doc_id",)).select("doc_id", "event_seq", "line_no", "n_lines", "message")


@query(f"SELECT doc_id, s::BIGINT AS event_seq, min(pos)::BIGINT AS line_no, count(*) AS n_lines, string_agg(value, chr(10) ORDER BY pos) AS message FROM ({_DOC_LINES}) WHERE s > 0 GROUP BY doc_id, s")
def stitch_in_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as `stitch_prefix`, put together in the tasks that read the lines."""
    return fold.stitch_staged(document_lines(spark, sf_dir), ("doc_id",)).events.select("doc_id", "event_seq", "line_no", "n_lines", "message")


@query(f"SELECT doc_id, pos::BIGINT AS line_no, value FROM ({_DOC_LINES}) WHERE s = 0")
def stitch_prefix_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.rejects(stitch.number_by_chunk(document_lines(spark, sf_dir), ("doc_id",))).select("doc_id", "line_no", "value")


@query(f"SELECT doc_id, pos::BIGINT AS line_no, sha256(source || '|' || doc_id || '|0|' || pos) AS event_id, 'WARN' AS level, '' AS \"timestamp\", 'Malformed line: ' || value AS message FROM ({_DOC_LINES}) WHERE s = 0")
def reject_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = stitch.rejects(stitch.number_by_chunk(document_lines(spark, sf_dir), ("doc_id",)))
    named = rejected.select("value", "line_no", F.col("source").alias("source_id"), F.col("source").alias("source_name"), F.lit(0).cast("long").alias("source_ord"), F.col("doc_id").cast("string").alias("file_path"))
    return stitch.reject_events(named).select(F.col("file_path").cast("long").alias("doc_id"), "line_no", "event_id", "level", "timestamp", "message")


@query(f"SELECT source AS source_id, count(DISTINCT doc_id) AS n_files, count(*) AS n_lines, sum(strlen(value))::BIGINT AS n_bytes FROM ({_DOC_LINES}) GROUP BY source")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir).select(F.col("source").alias("source_id"), F.col("doc_id").alias("file_path"), F.octet_length("value").cast("long").alias("file_size"))
    by_file = lines.groupBy("source_id", "file_path").agg(F.sum("file_size").alias("file_size"), F.count("*").alias("k"))
    return metrics.source_stats(by_file.select("source_id", "file_path", F.col("k").alias("n_lines"), F.col("file_size").alias("n_bytes")))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '\\bTHE\\b', 'i') AND NOT contains(text, '$')")
def whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(filters.whole_word(F.col("text"), "THE") & ~F.contains("text", F.lit("$"))).select("doc_id")


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes FROM documents WHERE contains(lower(text), 'licensed')")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(filters.predicate(spark, LogFilter(text="Licensed"), F.col("text"))).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


# --- sources ---------------------------------------------------------------------------------------------------


def environment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey").cast("string")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("r_name").alias("environment"), F.col("n_name").alias("country"), F.concat(F.col("n_name"), F.lit("_"), key).alias("code"), F.lit("host").alias("host"),
        F.array(F.concat(F.lit("/mnt/"), key), F.concat(F.lit("share/"), key)).alias("shares"), F.col("n_nationkey").cast("long").alias("entry"),
    )


@query("SELECT r_name AS environment, n_name AS country, n_name || '_' || n_nationkey AS code, 'host' AS host, '/mnt/' || n_nationkey || ',share/' || n_nationkey AS shares FROM nation JOIN region ON n_regionkey = r_regionkey")
def matrix_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as CSV, read again."""
    path = f"{staging_folder(spark)}/matrix-{uuid.uuid4().hex}"
    environment_matrix(spark, sf_dir).drop("entry").withColumn("shares", F.array_join("shares", " ; ")).write.csv(path, header=True)
    return matrix.read_csv(spark, path).select("environment", "country", "code", "host", F.array_join("shares", ",").alias("shares"))


@query("SELECT r_name AS environment, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS countries FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def source_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.source_options(environment_matrix(spark, sf_dir)).withColumn("countries", F.array_join("countries", ","))


@query(
    "WITH m AS (SELECT r_name, n_name, n_nationkey, unnest(['/mnt/' || n_nationkey, '/base/share/' || n_nationkey]) AS share, unnest([0, 1]) AS i FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) AND n_name = (SELECT min(n_name) FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region ORDER BY r_name LIMIT 1)))"
    " SELECT array_to_string(list_transform([r_name, n_name, n_name || '_' || n_nationkey, 'SHOP API', i::VARCHAR, 'back'], lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')), '-') AS id,"
    " '[' || n_name || '_' || n_nationkey || '] ' || share AS name, share || '/Java/apache-tomcat-back/logs' AS directory, n_nationkey * 1000 + i AS source_ord FROM m"
)
def resolve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = environment_matrix(spark, sf_dir)
    environment, country = m.agg(F.min(F.struct("environment", "country"))).first()[0]
    found = matrix.resolve_sources(m, Selection(environment, country, "back", " SHOP API ", "2026-07-29"), "/base")
    return found.select("id", "name", "directory", "source_ord")


@query("SELECT page_id, regexp_matches('App-' || ['serveur', 'fwk', 'ui', 'other'][(page_id % 4 + 1)::INT] || '.2026-07-' || (28 + page_id % 3) || '-' || page_id || CASE WHEN page_id % 11 = 0 THEN '.gz' ELSE '.log' END, '^app-(serveur|fwk|ui)\\.2026-07-29-\\d+\\.log$', 'i') AS matches FROM pages")
def file_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ("serveur", "fwk", "ui", "other"))), (n % 4 + 1).cast("int"))
    name = F.concat(F.lit("/logs/App-"), kind, F.lit(".2026-07-"), (n % 3 + 28).cast("string"), F.lit("-"), n.cast("string"), F.when(n % 11 == 0, ".gz").otherwise(".log"))
    wanted = Selection("E", "C", "back", "aPP", "2026-07-29")
    return table(spark, sf_dir, "pages").select("page_id", files.file_name_matches(base_name(name), wanted).alias("matches"))


@query("SELECT doc_id, doc_id % 3 AS source_ord FROM documents WHERE doc_id % 5 < 3")
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to the first source whose directory holds them; the last source repeats a directory."""
    d = table(spark, sf_dir, "documents")
    n = d.select((F.col("doc_id") % 3).alias("source_ord")).distinct()
    named = n.select(F.concat(F.lit("s"), F.col("source_ord").cast("string")).alias("id"), F.lit("n").alias("name"), F.concat(F.lit("/d/"), F.col("source_ord").cast("string")).alias("directory"), "source_ord")
    sources = named.unionByName(named.where("source_ord = 0").withColumn("source_ord", F.lit(9).cast("long")))
    lines = d.select("doc_id", F.concat(F.lit("/d/"), F.when(F.col("doc_id") % 5 < 3, (F.col("doc_id") % 3).cast("string")).otherwise("x"), F.lit("/f.log")).alias("file_path"))
    return files.with_source(lines, sources).select("doc_id", "source_ord")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
