import ast
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from logweft.operators import timeline
from logweft.plans.config import Selection
from logweft.sources import matrix
from logweft.streaming import live
from logweft.streaming.tail import Span, TailReader, last_line_end

SELECTION = Selection("E", "C", "back", "APP", "2026-07-29")
NAME = "APP-ui.2026-07-29-0.log"


@pytest.fixture
def share(spark, tmp_path):
    logs = tmp_path / "s/Java/apache-tomcat-back/logs"
    logs.mkdir(parents=True)
    m = spark.createDataFrame([("E", "C", "c", "h", [str(tmp_path / "s")])], matrix.SCHEMA)
    return logs, matrix.resolve_sources(m, SELECTION), tmp_path


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


def event(i, more=0):
    return f"2026-07-29 10:00:{i % 60:02d} INFO event {i}\n" + "".join(f"  more {i}.{k}\n" for k in range(more))


def reader(logs, **options):
    return TailReader({"directories": json.dumps([str(logs)]), **options})


def lines(r, start, end):
    return [(v, o) for s in r.partitions(start, end) for v, _, _, o, *_ in r.read(s)]


def test_reader_positions(share):
    logs, *_ = share
    append(logs / NAME, "﻿one\r\ntwo\rtwo b\npart")
    r = reader(logs)
    first = r.latestOffset()
    assert [v for v, _ in lines(r, {}, first)] == ["one", "two", "two b"]
    append(logs / NAME, "ial\nnext\n")
    second = r.latestOffset()
    assert [v for v, _ in lines(r, first, second)] == ["partial", "next"]
    assert lines(r, second, second) == []
    append(logs / "other-ui.log", "new file\n")
    third = r.latestOffset()
    assert [v for v, _ in lines(r, second, third)] == ["new file"]
    (logs / NAME).write_text("anew\n")  # truncated
    fourth = r.latestOffset()
    assert [v for v, _ in lines(r, third, fourth)] == ["anew"]
    os.remove(logs / "other-ui.log")
    assert list(r.latestOffset()) == [str(logs / NAME)]


def test_reader_options_and_errors(share):
    logs, *_ = share
    append(logs / NAME, "a\nb\nopen end")
    assert [v for v, _ in lines(reader(logs, flushPartial="true"), {}, reader(logs, flushPartial="true").latestOffset())] == ["a", "b", "open end"]
    r = reader(logs, maxBytesPerFile="30")
    r.latestOffset()
    append(logs / NAME, "\n" + "".join(f"line {i}\n" for i in range(50)))
    seen, at = [], {str(logs / NAME): [0, r.seen[str(logs / NAME)][1]]}
    while (now := r.latestOffset()) != at:
        seen += lines(r, at, now)
        at = now
    assert [v for v, _ in seen][-1] == "line 49" and len(seen) == 53
    gone = list(r.read(Span(str(logs / "none.log"), 0, 9, "h", False)))
    assert gone[0][0] is None and gone[0][3] == -1 and "No such file" in gone[0][6]
    short = list(r.read(Span(str(logs / NAME), 0, 10**6, "h", False)))
    assert short[-1][3] == -1 and "before" in short[-1][6]
    assert last_line_end(str(logs / NAME), 1) == 0


def follow(spark, sources, store, checkpoint):
    query = live.store(live.live_events(live.tail_lines(spark, sources, SELECTION)), store, checkpoint, processingTime="0 seconds")
    return query


def drain(query):
    query.processAllAvailable()
    if query.exception():
        raise query.exception()


COLUMNS = ["event_id", "timestamp", "level", "message", "line_no", "generation"]


def stored(spark, store):
    return sorted(tuple(r) for r in timeline.stored_timeline(spark, store).select(COLUMNS).collect())


def batch(spark, sources):
    return sorted(tuple(r) for r in timeline.load_timeline(spark, sources, SELECTION)[0].select(COLUMNS).collect())


def test_stream_in_chunks_is_batch_and_survives_restarts(spark, share):
    logs, sources, tmp = share
    draw = random.Random(8)
    text = "orphan\n" + "".join(event(i, draw.randrange(3)) for i in range(40))
    store, checkpoint = str(tmp / "store"), str(tmp / "cp")
    cuts = sorted(draw.sample(range(1, len(text)), 3)) + [len(text)]
    query, begin = None, 0
    for n, end in enumerate(cuts):
        append(logs / NAME, text[begin:end])
        begin = end
        if n % 2 == 0:
            query = follow(spark, sources, store, checkpoint)
        drain(query)
        if n % 2 == 1:
            query.stop()
    query.stop()
    assert stored(spark, store) == batch(spark, sources)
    assert any(r[3].count("\n") == 2 for r in stored(spark, store))


def test_truncation_is_a_new_generation(spark, share):
    logs, sources, tmp = share
    store, checkpoint = str(tmp / "store"), str(tmp / "cp")
    append(logs / NAME, event(1, 1) + event(2))
    query = follow(spark, sources, store, checkpoint)
    drain(query)
    (logs / NAME).write_text(event(7, 1))
    drain(query)
    query.stop()
    append(logs / NAME, "  after a restart\n")
    query = follow(spark, sources, store, checkpoint)
    drain(query)
    query.stop()
    rows = stored(spark, store)
    assert sorted((r[5], r[4], r[3]) for r in rows) == [(0, 0, "event 1\n  more 1.0"), (0, 2, "event 2"), (1, 0, "event 7\n  more 7.0\n  after a restart")]
    assert len({r[0] for r in rows}) == 3


def test_live_messages_leave_out_the_backlog(spark, share):
    logs, sources, tmp = share
    append(logs / NAME, event(1) + event(2))
    sent = []
    send = lambda rows, n: sent.extend(json.loads(r["value"])["message"] for r in rows.collect())
    query = live.deliver(live.live_events(live.tail_lines(spark, sources, SELECTION)), send, str(tmp / "cp"), F.col("message").contains("more"), processingTime="0 seconds")
    drain(query)
    append(logs / NAME, event(3))
    drain(query)
    append(logs / NAME, "  more at last\n")  # the grown event starts to match
    drain(query)
    query.stop()
    assert sent == ["event 3\n  more at last"]
    assert time.time() > 0


def test_the_backlog_comes_in_bounded_steps(spark, share):
    """Under the bound, over a restart, and the lines are the batch's; what was there at first is no live message."""
    logs, sources, tmp = share
    store, checkpoint = str(tmp / "store"), str(tmp / "cp")
    append(logs / NAME, "".join(event(i, i % 3) for i in range(60)) + "long " + "x" * 900 + "\n")
    sizes = []

    def follow_bounded():
        lines = live.tail_lines(spark, sources, SELECTION, checkpoint=checkpoint, maxBytesPerFile="400")
        return live.store(live.live_events(lines), store, checkpoint, processingTime="0 seconds")

    query = follow_bounded()
    while len(query.recentProgress) < 3:
        time.sleep(0.2)
    query.stop()
    sizes += [p["sources"][0]["endOffset"] for p in query.recentProgress]
    query = follow_bounded()
    drain(query)
    append(logs / NAME, event(61, 2))
    drain(query)
    query.stop()
    assert stored(spark, store) == batch(spark, sources)
    ends = [ast.literal_eval(str(e))[str(logs / NAME)] for e in sizes + [p["sources"][0]["endOffset"] for p in query.recentProgress] if e]
    steps = [b[0] - a[0] for a, b in zip(ends, ends[1:])]
    assert ends[0][0] <= 400 and max(s for s in steps if s < 900) <= 400 and len([s for s in steps if s > 400]) <= 1


def test_reader_bounds_the_backlog_and_marks_it(share):
    logs, *_ = share
    append(logs / NAME, "".join(f"line {i}\n" for i in range(100)))
    size = os.path.getsize(logs / NAME)
    r, at, seen = reader(logs, maxBytesPerFile="50", checkpoint=str(logs / "none")), {}, []
    while (now := r.latestOffset()) != at:
        spans = r.partitions(at, now)
        assert all(s.is_backfill and s.end - s.begin <= 50 for s in spans)
        seen += lines(r, at, now)
        at = now
    assert [v for v, _ in seen] == [f"line {i}" for i in range(100)] and at[str(logs / NAME)][0] == size
    append(logs / NAME, "live\n")
    assert [s.is_backfill for s in r.partitions(at, r.latestOffset())] == [False]
    append(logs / NAME, "y" * 300 + "\nafter\n")  # a line over the bound comes whole
    at, now = r.seen, r.latestOffset()
    assert [v for v, _ in lines(r, at, now)] == ["y" * 300]
    with pytest.raises(ValueError, match="mounted"):
        TailReader({"directories": json.dumps(["hdfs://x/y"])})


def test_continuations_are_bounded_over_batches(spark, share):
    logs, sources, tmp = share
    append(logs / NAME, event(1, 2))
    live_rows = live.live_events(live.tail_lines(spark, sources, SELECTION), max_continuation_lines=3)
    query = live.store(live_rows, str(tmp / "store"), str(tmp / "cp"), processingTime="0 seconds")
    drain(query)
    append(logs / NAME, "".join(f"late {k}\n" for k in range(5)))
    drain(query)
    append(logs / NAME, "later\n" + event(2))
    drain(query)
    query.stop()
    assert [r[3] for r in sorted(stored(spark, str(tmp / "store")), key=lambda r: r[4])] == ["event 1\n  more 1.0\n  more 1.1\nlate 0", "event 2"]


def test_feed_follows_filters_and_lets_go(spark, share):
    logs, _, tmp = share
    m = spark.createDataFrame([("E", "C", "c", "h", [str(tmp / "s")])], matrix.SCHEMA)
    sent = []
    feed = live.Feed(spark, m, str(tmp / "feed"), lambda rows, n: sent.extend(json.loads(r["value"])["message"] for r in rows.collect()), processingTime="0 seconds")
    append(logs / NAME, event(1) + event(2))
    assert feed.subscribe(SELECTION).count() == 1
    assert json.loads(feed.snapshot())["schema"]["columns"]
    for q in feed.queries:
        drain(q)
    assert sent == [] and [e["message"] for e in json.loads(feed.snapshot())["events"]] == ["event 2", "event 1"]
    append(logs / NAME, event(3))
    for q in feed.queries:
        drain(q)
    feed.set_filter(text="event 5")
    append(logs / NAME, event(4) + event(5))
    for q in feed.queries:
        drain(q)
    assert sent == ["event 3", "event 5"] and [e["message"] for e in json.loads(feed.snapshot())["events"]] == ["event 5"]
    feed.unsubscribe()
    assert feed.queries == [] and feed.sources is None
    append(logs / NAME, event(6))
    feed.subscribe(SELECTION)  # goes on where it stood
    for q in feed.queries:
        drain(q)
    assert sent == ["event 3", "event 5", "event 6"] and len(json.loads(feed.snapshot())["events"]) == 6
    assert feed.subscribe(Selection("E", "C", "back", " ", "x")).count() == 0 and feed.queries == []


def test_a_feed_keeps_rejects_and_errors_and_compacts_itself(spark, share, monkeypatch):
    logs, _, tmp = share
    m = spark.createDataFrame([("E", "C", "c", "h", [str(tmp / "s")])], matrix.SCHEMA)
    sent = []
    feed = live.Feed(spark, m, str(tmp / "feed2"), lambda rows, n: sent.extend(json.loads(r["value"])["message"] for r in rows.collect()), compact_every=2, processingTime="0 seconds")
    append(logs / NAME, "orphan\n" + event(1))
    other = logs / NAME.replace("-0.log", "-1.log")
    other.symlink_to(logs)  # a folder by a file's name can't be read
    feed.subscribe(SELECTION)
    assert len(feed.queries) == 1  # the files are tailed and parsed once
    drain(feed.queries[0])
    assert [(r["line_no"], r["value"]) for r in feed.rejects().collect()] == [(0, "orphan")]
    assert feed.progress()["n_lines"] >= 2 and feed.progress()["n_bytes"] >= len("orphan\n" + event(1))
    for i in range(2, 7):
        append(logs / NAME, event(i) + "  more\n")
        drain(feed.queries[0])
    assert sent == [f"event {i}\n  more" for i in range(2, 7)]
    now = feed.timeline.manifest()
    assert now.number >= 2 and len(feed.timeline.commits(now.through)) <= 2
    assert [e["message"].split("\n")[0] for e in json.loads(feed.snapshot())["events"]] == [f"event {i}" for i in range(6, 0, -1)]
    broken = spark.createDataFrame([("s", "n", "/f", "no permission")] * 3, live.ERROR)
    log = feed._log("errors", live.ERROR)
    for batch in (3, 5, 5):
        log.append(broken, batch)
    assert [(r["message"], r["first_batch"], r["last_batch"]) for r in feed.errors().where("file_path = '/f'").collect()] == [("no permission", 3, 5)]
    feed.unsubscribe()
