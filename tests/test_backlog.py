import fnmatch
import json
import os
import random

import pandas as pd
import pytest

from logweft.plans.config import Selection
from logweft.sources import matrix
from logweft.sources.files import name_glob
from logweft.streaming import backlog, live
from logweft.streaming.tail import GONE, SEED, TailReader
from tests.test_streaming import NAME, SELECTION, append, batch, drain, event, share  # noqa: F401

COLUMNS = ["event_id", "timestamp", "level", "message", "line_no", "generation"]


def feed_of(spark, tmp, name, sent, **more):
    m = spark.createDataFrame([("E", "C", "c", "h", [str(tmp / "s")])], matrix.SCHEMA)
    send = lambda rows, n: sent.extend(json.loads(r["value"])["message"] for r in rows.collect())
    return live.Feed(spark, m, str(tmp / name), send, processingTime="0 seconds", **more)


def kept(feed):
    return sorted(tuple(r) for r in feed.timeline.events().select(COLUMNS).collect())


@pytest.mark.parametrize("width", [37, 400, 1 << 20])
def test_spans_hold_each_line_once(spark, tmp_path, width):
    draw = random.Random(width)
    text = "﻿orphan\r\n" + "".join(event(i, draw.randrange(3)) + "a\rb\rc" * draw.randrange(2) + "x" * draw.randrange(200) + "\n" for i in range(40)) + "open end"
    path = str(tmp_path / "a.log")
    append(path, text)
    other = str(tmp_path / "b.log")
    append(other, "one\ntwo\n")
    r = TailReader({"directories": json.dumps([str(tmp_path)])})
    end = r.latestOffset()
    want = [(x[1], x[3], x[0]) for s in r.partitions({}, end) for x in r.read(s)]
    b = backlog.BacklogReader({"ends": json.dumps({p: e[:2] for p, e in end.items()}), "spanBytes": str(width)})
    tasks = b.partitions()
    got = [(x[1], x[3], x[0]) for t in tasks for x in b.read(t)]
    assert got == want and all(sum(s.end - s.begin for s in t.spans) <= width for t in tasks)
    assert width == 1 << 20 or len(tasks) >= os.path.getsize(path) // width
    os.remove(other)
    append(path, "more\n")
    assert [x[0] for t in tasks for x in b.read(t) if x[1] == path] == [v for p, _, v in want if p == path]  # only up to the plan's end
    assert all(x[0] is None and x[3] < 0 and "No such file" in x[6] for t in tasks for x in b.read(t) if x[1] == other)
    with open(path, "r+b") as f:
        f.write(b"anothr")
    assert {x[6] for t in tasks for x in b.read(t) if x[1] == path} == {"begins with other bytes than before"}


def test_a_feed_goes_on_where_its_backlog_ended(spark, share, monkeypatch):  # noqa: F811
    """By many tasks a file, with an event that grows over the seam and a half line at it: ids as if read at once, and nothing twice or lost."""
    logs, sources, tmp = share
    monkeypatch.setattr(live, "read_backlog", lambda *a, **k: backlog.read_backlog(*a, width=300, **k))
    sent, draw = [], random.Random(3)
    append(logs / NAME, "orphan\n" + "".join(event(i, draw.randrange(4)) for i in range(50)) + event(50) + "  mo")
    headless = NAME.replace("-0.log", "-1.log")
    append(logs / headless, "no event here\n")
    feed = feed_of(spark, tmp, "feed", sent)
    feed.subscribe(SELECTION)
    assert len(kept(feed)) == 51  # before the stream's first batch
    drain(feed.queries[0])
    assert sent == [] and sorted(r["value"] for r in feed.rejects().collect()) == ["no event here", "orphan"]
    append(logs / NAME, "re at last\n" + event(51, 1))
    append(logs / headless, "none here\n" + event(1))
    drain(feed.queries[0])
    assert sorted(sent) == ["event 1", "event 50\n  more at last", "event 51\n  more 51.0"]
    feed.unsubscribe()
    append(logs / NAME, "  and after a restart\n")
    feed.subscribe(SELECTION)
    drain(feed.queries[0])
    assert kept(feed) == batch(spark, sources)
    assert sorted((r["line_no"], r["value"]) for r in feed.rejects().collect()) == [(0, "no event here"), (0, "orphan"), (1, "none here")]
    feed.unsubscribe()


def test_files_change_between_the_backlog_and_the_stream(spark, share, monkeypatch):  # noqa: F811
    """One is replaced and one goes (and comes again): new generations; a run that ended before its seeds is done again."""
    logs, sources, tmp = share
    names = [NAME, NAME.replace("-0.log", "-1.log"), NAME.replace("-0.log", "-2.log")]
    for i, n in enumerate(names):
        append(logs / n, event(10 * i + 1) + event(10 * i + 2))
    sent = []
    feed = feed_of(spark, tmp, "feed2", sent)
    failing = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        m.setattr(backlog, "seeds_of", failing)
        feed.subscribe(SELECTION)
    append(logs / names[0], event(3))

    def read(*a, **k):
        done = backlog.read_backlog(*a, **k)
        os.remove(logs / names[1])
        (logs / names[2]).write_text("2026-07-29 11:00:00 INFO another\n")
        return done

    monkeypatch.setattr(live, "read_backlog", read)
    feed.subscribe(SELECTION)
    drain(feed.queries[0])
    append(logs / names[1], event(30))
    drain(feed.queries[0])
    rows = feed.timeline.events().select("file_path", "generation", "line_no", "message").collect()
    got = sorted((names.index(os.path.basename(r[0])), *r[1:]) for r in rows)
    assert got == [
        (0, 0, 0, "event 1"), (0, 0, 1, "event 2"), (0, 0, 2, "event 3"),
        (1, 0, 0, "event 11"), (1, 0, 1, "event 12"), (1, 1, 0, "event 30"),
        (2, 0, 0, "event 21"), (2, 0, 1, "event 22"), (2, 1, 0, "another"),
    ]
    assert feed.timeline.events().select("event_id").distinct().count() == len(got) and sorted(sent) == ["another", "event 30"]
    feed.unsubscribe()


def test_only_files_of_the_selection_are_opened(spark, share):  # noqa: F811
    logs, sources, _ = share
    wanted = ["app-UI.2026-07-29-3.log", "APP-fwk.2026-07-29-0.LOG"]
    for name in [*wanted, "APP-ui.2026-07-28-0.log", "OTHER-ui.2026-07-29-0.log", "APP-ui.2026-07-29-0.log.gz", "xAPP-ui.2026-07-29-0.log"]:
        append(logs / name, event(1))
    found = TailReader({"directories": json.dumps([str(logs)]), "pattern": name_glob(SELECTION)}).latestOffset()
    assert sorted(map(os.path.basename, found)) == sorted(wanted)
    assert sorted(os.path.basename(r["file_path"]) for r in backlog.plan(spark, sources, SELECTION).collect()) == sorted(wanted)
    assert fnmatch.fnmatchcase("\u212aIO\u017f-ui.2026-07-29-1.log", name_glob(Selection("E", "C", "back", "kios", "2026-07-29")))
    odd = Selection("E", "C", "back", "a[1]*é?", "2026-07-29")
    assert fnmatch.fnmatchcase("A[1]*É?-serveur.2026-07-29-1.log", name_glob(odd)) and not fnmatch.fnmatchcase("A1xé?-ui.2026-07-29-1.log", name_glob(odd))


def test_a_file_that_cannot_be_read_has_no_seed(spark, share):  # noqa: F811
    logs, sources, tmp = share
    append(logs / NAME, event(1) + event(2))
    other = NAME.replace("-0.log", "-1.log")
    append(logs / other, "".join(event(i) for i in range(20)))
    planned = backlog.plan(spark, sources, SELECTION).collect()
    assert sorted(os.path.basename(r["file_path"]) for r in planned) == [NAME, other]
    feed = feed_of(spark, tmp, "feed3", [])
    feed.selection = SELECTION
    stores = feed.timeline, feed._log("rejects", live.REJECT)
    changed = [(r["file_path"], r["end"], "x" if r["file_path"].endswith(other) else r["head"]) for r in planned]
    table = spark.createDataFrame(changed, "file_path string, end bigint, head string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(backlog, "plan", lambda *a: table)
        assert backlog.read_backlog(spark, sources, SELECTION, *stores, str(tmp / "seeds"), width=100)
    assert [os.path.basename(r["file_path"]) for r in spark.read.parquet(str(tmp / "seeds")).collect()] == [NAME]
    assert feed.timeline.events().count() == 2 and stores[1].deltas(stores[1].commits()).count() == 0
    assert not backlog.read_backlog(spark, sources.limit(0), SELECTION, *stores, str(tmp / "none"))


class Kept:
    """A group's state, as the stateful operator sees it."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def fed(state, *rows):
    table = pd.DataFrame(rows, columns=["value", "offset", "head", "is_header", "error"])
    table = table.assign(source_name="s", source_ord=0, timestamp="t", event_ts=None, level="INFO", message=table["value"], fields="{}", is_backfill=False)
    return [r for t in live._stitch_file(("s", "/f"), iter([table]), state) for r in t[["kind", "generation", "line_no", "message"]].itertuples(index=False, name=None)]


def test_the_state_of_a_file_that_is_gone_is_its_generation_alone():
    """A thousand daily files with large open events leave little behind."""
    states = [Kept() for _ in range(1000)]
    for s in states:
        fed(s, ("head", 0, "h", True, None), ("x" * 10_000, 5, "h", False, None))
        assert fed(s, (None, GONE, "h", False, None)) == []
    assert sum(len(repr(s.value)) for s in states) < 100_000
    s = states[0]
    fed(s, (None, GONE, "h", False, None))
    assert fed(s, ("orphan", 0, "h", False, None), ("next", 7, "h", True, None)) == [("reject", 1, 0, "orphan"), ("event", 1, 1, "next")]
    assert fed(s, ('{"next_line": 9}', SEED, "h", False, None), ("more", 12, "h", False, None)) == [("event", 1, 1, "next\nmore")]  # a seed is for a state that isn't there
    assert [r[:3] for r in fed(s, (None, -1, "h", False, "no permission"))] == [("error", 1, -1)]


def test_a_stream_lets_go_of_removed_files(spark, share):  # noqa: F811
    logs, sources, tmp = share
    append(logs / NAME, event(1) + event(2, 1))
    sent = []
    feed = feed_of(spark, tmp, "feed4", sent)
    feed.subscribe(SELECTION)
    drain(feed.queries[0])
    os.remove(logs / NAME)
    drain(feed.queries[0])
    append(logs / NAME, event(2, 1) + event(3))
    drain(feed.queries[0])
    rows = [(r["generation"], r["line_no"], r["message"]) for r in feed.timeline.events().collect()]
    assert sorted(rows) == [(0, 0, "event 1"), (0, 1, "event 2\n  more 2.0"), (1, 0, "event 2\n  more 2.0"), (1, 2, "event 3")]
    feed.unsubscribe()
