import random
from datetime import datetime, timedelta

import pytest

from logweft.operators import timeline
from logweft.operators.timeline_store import TimelineStore
from logweft.plans.config import LogFilter
from logweft.sources import shared_files

START = datetime(2026, 7, 29, 0, 30)


def event(i, minute, level="INFO", message=None):
    time = None if minute is None else START + timedelta(minutes=minute)
    return (f"e{i:05d}", None if time is None else time.isoformat(), time, None, "s", "n", "/f", level, message or f"message {i}", {"k": str(i)}, 0, i, 0)


@pytest.fixture
def store(spark, tmp_path):
    return TimelineStore(spark, f"file://{tmp_path}/timeline")


def df(store, rows):
    return store.spark.createDataFrame(rows, store.schema).coalesce(1)


def keyed(events):
    return [(r["event_id"], r["message"]) for r in events.orderBy(*timeline.ordering()).collect()]


def expected(batches):
    last = {}
    for rows in batches:
        last |= {r[0]: r for r in rows}
    return [(r[0], r[8]) for r in sorted(last.values(), key=lambda r: (r[2] is None, -(r[2] - START).total_seconds() if r[2] else 0, r[10], r[6], r[11]))]


def files_of(rows):
    return {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles() if "bucket=" in f}


def test_feeding_replays_late_rows_and_compaction(store):
    draw, batches = random.Random(2), []
    for n in range(6):
        ids = draw.sample(range(80), 25)
        rows = [event(i, None if i == 7 else i * 9, draw.choice(["INFO", "ERROR"]), f"message {i} v{n}") for i in ids]
        batches.append(rows)
        store.append(df(store, rows), n)
        if n == 2:
            store.append(df(store, rows), n)  # a replay
        if n in (1, 4):
            store.compact()
        assert keyed(store.events()) == expected(batches)
    store.compact()
    store.append(df(store, [event(1, 9, message="not to be seen")]), 3)  # a replay of what is in the base
    store.vacuum()
    assert keyed(store.events()) == expected(batches)
    now = store.manifest()
    assert sum(now.rows(b) for b in now.buckets) == len(expected(batches)) and now.through == 5
    assert {x.split("-")[0] for x in shared_files.names(store.spark, f"{store.path}/base")} == {f.split("-")[0] for f, _ in now.buckets.values()}


def test_only_touched_buckets_are_written(store):
    store.append(df(store, [event(i, i * 30) for i in range(40)]), 0)
    first = store.compact()
    store.append(df(store, [event(3, 90, message="grown"), event(99, 95)]), 1)
    second = store.compact()
    changed = {b for b in second.buckets if second.buckets[b] != first.buckets.get(b)}
    assert len(changed) == 1 and len(first.buckets) == 21
    assert dict(keyed(store.events()))["e00003"] == "grown"


def test_a_crash_before_the_manifest_changes_nothing(store, monkeypatch):
    rows = [event(i, i) for i in range(20)]
    store.append(df(store, rows), 0)
    store.compact()
    store.append(df(store, [event(5, 5, message="grown")]), 1)
    write = shared_files.write_text
    monkeypatch.setattr(shared_files, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.compact()
    with pytest.raises(OSError):
        store.append(df(store, [event(6, 6, message="half")]), 2)
    monkeypatch.setattr(shared_files, "write_text", write)
    assert keyed(store.events()) == expected([rows, [event(5, 5, message="grown")]])
    store.compact()
    store.vacuum()
    assert keyed(store.events()) == expected([rows, [event(5, 5, message="grown")]])


def test_pages_read_their_buckets_only(store, monkeypatch):
    levels = ["INFO"] * 9 + ["ERROR"]
    rows = [event(i, i * 6, levels[i % 10], f"message {i}" + (" needle" if i == 3 else "")) for i in range(400)] + [event(900, None), event(901, None)]
    store.append(df(store, rows), 0)
    store.compact()
    late = [event(950, 3, message="late"), event(398, 398 * 6, message="grown")]
    store.append(df(store, late), 1)
    want = expected([rows, late])
    read, base = [], store._base
    monkeypatch.setattr(store, "_base", lambda m, buckets: (read.append(len(buckets)), base(m, buckets))[1])

    def page(p):
        return [(r["event_id"], r["message"]) for r in p.rows.collect()]

    got = store.newest(n=20)
    assert page(got) == want[:20] and got.has_more() and sum(read) <= 3
    read.clear()
    last = got.rows.collect()[-1].asDict()
    deep = store.after_cursor({**last, "event_ts": START + timedelta(minutes=1200), "line_no": 200}, 50)
    place = [x[0] for x in want].index("e00200")
    assert page(deep) == want[place + 1 : place + 51] and deep.has_more() and sum(read) <= 8
    read.clear()
    errors = [r for r in want if r[0] not in ("e00900", "e00901", "e00950", "e00398") and int(r[0][1:]) % 10 == 9]
    got = store.newest(LogFilter(levels=("ERROR",)), 5)
    assert page(got) == errors[:5] and got.has_more() and sum(read) <= 8
    got = store.newest(LogFilter(text="NEEDLE"), 5)
    assert page(got) == [("e00003", "message 3 needle")] and not got.has_more()
    everything = store.newest(n=1000)
    assert page(everything) == want and not everything.has_more()
    read.clear()
    at = START + timedelta(minutes=2200)
    newer = [x for x in want if int(x[0][1:]) < 900 and int(x[0][1:]) * 6 > 2200]
    got = store.until(at.isoformat())
    assert [(r["event_id"], r["message"]) for r in got.collect()] == want[: len(newer) + 1] and max(read) < 10
    assert store.until("2020-01-01T00:00:00").count() == len(want) == store.until("not a time").count()


def test_retention_cuts_by_counts(store, monkeypatch):
    rows = [event(i, i * 20) for i in range(100)] + [event(200, None)]
    store.append(df(store, rows), 0)
    store.compact()
    read, base = [], store._base
    monkeypatch.setattr(store, "_base", lambda m, buckets: (read.append(len(buckets)), base(m, buckets))[1])
    store.retain_newest(50)
    assert keyed(store.events()) == expected([rows])[:50] and read[0] == 1
    store.retain_newest(0)
    store.vacuum()
    assert store.events().count() == 0
    assert store.newest().rows.count() == 0


def test_a_compaction_is_one_shuffle_and_cuts_large_buckets_in_pieces(store, monkeypatch):
    from logweft.operators import timeline_store

    monkeypatch.setattr(timeline_store, "PIECE", 10, raising=False)
    plans, publish = [], store._publish
    monkeypatch.setattr(store, "_publish", lambda old, rows, *rest: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), publish(old, rows, *rest))[1])
    batches = [[event(i, i % 70) for i in range(120)], [event(i, i % 70, message=f"grown {i}") for i in range(0, 140, 3)] + [event(500, None)]]
    for n, rows in enumerate(batches):
        store.append(df(store, rows), n)
        store.compact()
        assert keyed(store.events()) == expected(batches[: n + 1])
    assert all(plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "SortAggregate" not in plan for plan in plans)
    now = store.manifest()
    assert sum(now.rows(b) for b in now.buckets) == len(expected(batches))


def test_grams_of_what_was_indexed_are_kept_and_not_read_again(store, monkeypatch):
    from logweft.operators import text_index

    read, postings = [], text_index.postings
    monkeypatch.setattr(text_index, "postings", lambda events, *known: (read.append(events.count()), postings(events, *known))[1])
    store.append(df(store, [event(i, i * 10, message="needle" if i == 4 else None) for i in range(30)]), 0)
    store.compact()
    store.append(df(store, [event(3, 30, message="haystack")]), 1)
    store.compact()
    assert read == [30, 1]
    for text, ids in (("NEEDLE", ["e00004"]), ("haystack", ["e00003"]), ("message 29", ["e00029"])):
        assert [r["event_id"] for r in store.search(LogFilter(text=text)).collect()] == ids
        assert len(store.candidates(store.manifest(), LogFilter(text=text))) == 1


def test_retention_cuts_before_it_compacts(store, monkeypatch):
    rows = [event(i, i * 20) for i in range(100)] + [event(200, None)]
    late = [event(10, 200, message="old and grown"), event(300, 5, message="old and new"), event(95, 1900, message="grown"), event(301, 2400, message="the newest")]
    store.append(df(store, rows), 0)
    store.compact()
    store.append(df(store, late), 1)
    wrote, publish = [], store._publish
    monkeypatch.setattr(store, "_publish", lambda old, rows, touched, *rest: (wrote.append(list(touched)), publish(old, rows, touched, *rest))[1])
    store.retain_newest(20)
    cut = store._bucket(START + timedelta(minutes=1500))
    assert keyed(store.events()) == expected([rows, late])[:20] and min(b for touched in wrote for b in touched) > cut
    assert store.manifest().through == 1 and min(store.manifest().buckets) > cut
    store.append(df(store, [event(302, 2500)]), 2)
    store.retain_newest(1000)  # more than there are
    assert keyed(store.events()) == [("e00302", "message 302"), *expected([rows, late])[:20]]


def test_a_page_takes_late_rows_of_its_buckets_only(store):
    store.append(df(store, [event(i, i * 60) for i in range(20)]), 0)
    store.compact()
    late = [event(100 + i, i * 60) for i in range(20)] + [event(7, 7 * 60, message="grown")]
    store.append(df(store, late), 1)
    at = store._bucket(START + timedelta(minutes=7 * 60))
    assert sorted(keyed(store._view(store.manifest(), [at], at, None, at))) == [("e00007", "grown"), ("e00107", "message 107")]
