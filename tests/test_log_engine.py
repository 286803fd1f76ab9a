import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweft.functions import columns, regex
from logweft.operators import filters, metrics, paging, stitch, timeline, view
from logweft.operators.parse import parse_lines
from logweft.plans.config import LogFilter, ParserConfig, Selection, page_size, toggled, until_input
from logweft.sources import files, matrix

BACK = """2026-07-29 10:00:00,000 INFO [main] shop.Boot - started requestId=R1 sessionId=SA
2026-07-29 10:00:01,125 WARN [w-1] shop.Invoice - slow export requestId=R2
2026-07-29 10:05:00,000 INFO [w-3] shop.Demo - live requestId=L1
2026-07-29 10:05:00,000 INFO [w-3] shop.Demo - live requestId=L1
2026-07-29 10:00:01,125 WARN [w-1] shop.Invoice - slow export requestId=R2
2026-07-29 12:05:00,000 INFO [w-3] shop.Demo - live requestId=L1
2026-07-29 12:06:00,000 INFO [w-3] shop.dz.Demo - live requestId=L9
"""
SELECTION = Selection("LOCAL", "SAMPLE", "back", "SHOP-API", "2026-07-29")


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)


@pytest.fixture
def shares(tmp_path):
    logs = lambda s, tier, name: tmp_path / s / "Java" / f"apache-tomcat-{tier}" / "logs" / name
    write(logs("a", "back", "SHOP-API-serveur.2026-07-29-0.log"), BACK)
    write(logs("b", "back", "shop-api-ui.2026-07-29-12.log"), "orphan line\r\n\r\n2026-07-29T10:00:03.300 ERROR Payment timeout transactionId=T4\r\n\tat x(Y.java:1)\r\n\r\nlast é without end")
    write(logs("b", "back", "SHOP-API-fwk.2026-07-29-1.log"), "﻿2026-02-31 10:00:00 INFO impossible date\n")
    write(logs("b", "back", "SHOP-API-fwk.2026-07-28-0.log"), "2026-07-28 10:00:00 INFO other day\n")
    write(logs("b", "back", "SHOP-API-x.2026-07-29-0.log"), "2026-07-29 10:00:00 INFO other kind\n")
    write(logs("b", "back", "SHOP-API-ui.2026-07-29-9.log"), "")
    write(tmp_path / "matrix.json", json.dumps([{"environment": "LOCAL", "country": "SAMPLE", "code": "L_S", "host": "h", "shares": ["a", "b", "missing"]}, {"environment": "LOCAL", "country": "OTHER", "code": "L_O", "host": "h", "shares": ["a"]}]))
    return tmp_path


@pytest.fixture
def loaded(spark, shares):
    m = matrix.read_json(spark, str(shares / "matrix.json"))
    sources = matrix.resolve_sources(m, SELECTION, str(shares))
    return sources, *timeline.load_timeline(spark, sources, SELECTION)


def test_sources(spark, shares, loaded):
    sources = loaded[0].orderBy("source_ord").collect()
    assert [r["id"] for r in sources] == [f"local-sample-l-s-shop-api-{i}-back" for i in range(3)]
    assert sources[0]["name"] == f"[L_S] {shares}/a" and sources[0]["directory"] == f"{shares}/a/Java/apache-tomcat-back/logs"
    m = matrix.read_json(spark, str(shares / "matrix.json"))
    for bad in (Selection("LOCAL", "SAMPLE", "back", "  ", "2026-07-29"), Selection("LOCAL", "SAMPLE", "back", "X", "29-07-2026"), Selection("LOCAL", "NONE", "back", "X", "2026-07-29")):
        assert matrix.resolve_sources(m, bad).count() == 0


def test_csv_matrix(spark, shares):
    write(shares / "m.csv", "environment,country,code,host,shares\nLOCAL,SAMPLE,L_S,h,a;b; missing\nLOCAL,OTHER,L_O,h,a\n")
    keep = ["environment", "country", "code", "host", "shares"]
    assert matrix.read_csv(spark, str(shares / "m.csv")).select(keep).collect() == matrix.read_json(spark, str(shares / "matrix.json")).select(keep).collect()


def test_source_options_in_locale_order(spark):
    m = spark.createDataFrame([("b", c) for c in "Éfbaa"] + [("a", "x")], "environment string, country string")
    assert [tuple(r) for r in matrix.source_options(m).collect()] == [("a", ["x"]), ("b", ["a", "b", "É", "f"])]


def test_timeline_of_files(loaded):
    _, events, rejected, status = loaded
    rows = events.orderBy(*timeline.ordering()).collect()
    assert len(rows) == 9 and len({r["event_id"] for r in rows}) == 9
    assert rows[0]["fields"] == {"thread": "w-3", "logger": "shop.dz.Demo"} and rows[0]["timestamp"] == "2026-07-29T12:06:00.000"
    assert rows[-1]["event_ts"] is None and rows[-1]["timestamp"] == "2026-02-31T10:00:00"
    error = next(r for r in rows if r["level"] == "ERROR")
    assert error["message"] == "Payment timeout transactionId=T4\n\tat x(Y.java:1)\n\nlast é without end" and error["fields"] == {"thread": "", "logger": ""}
    assert error["line_no"] == 2
    assert [r["value"] for r in rejected.orderBy("line_no").collect()] == ["orphan line", ""]
    assert [(r["readable"], r["message"]) for r in status.orderBy("source_ord").collect()] == [(True, None), (True, None), (False, "Failed to read source")]
    assert stitch.reject_events(rejected).where("level = 'WARN'").count() == 2


def test_stitching_doesn_t_depend_on_splits(spark, tmp_path):
    draw, text = random.Random(4), ""
    for i in range(400):
        text += f"2026-07-29 10:00:{i % 60:02d} INFO event {i}\n" + "".join(f"  more {i}.{k}\n" for k in range(draw.randrange(4)))
    write(tmp_path / "s/Java/apache-tomcat-back/logs/SHOP-API-ui.2026-07-29-0.log", "orphan\n" + text)
    m = spark.createDataFrame([("LOCAL", "SAMPLE", "c", "h", ["s"])], matrix.SCHEMA)
    sources = matrix.resolve_sources(m, SELECTION, str(tmp_path))
    found, old = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1500b", "7000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            events, rejected, _ = timeline.load_timeline(spark, sources, SELECTION)
            found.append((sorted(tuple(r) for r in events.select("event_id", "line_no", "message").collect()), rejected.count()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 400 and found[0][1] == 1


def test_prefix_stitch_is_window_stitch(spark):
    draw = random.Random(1)
    rows = [(f, c, p, draw.random() < 0.3, f"t{f}.{c}.{p}") for f in range(5) for c in range(6) for p in range(draw.randrange(1, 9))]
    df = spark.createDataFrame(rows, "file_path int, chunk int, pos int, is_header boolean, value string")
    one, other = stitch.number_by_window(df, ("file_path",)), stitch.number_by_chunk(df, ("file_path",))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.select(one.columns).collect()))


def test_limit_of_continuations(spark):
    df = spark.createDataFrame([(1, i, i == 0, f"l{i}", f"l{i}") for i in range(6)], "file_path int, pos int, is_header boolean, value string, message string")
    numbered = stitch.number_by_window(df, ("file_path",), ("pos",))
    assert stitch.stitch(numbered, ("file_path",), max_continuation_lines=2).first()["message"] == "l0\nl1\nl2"


def test_parser_configs(spark):
    odd = ParserConfig(r"(?<t_s>\d+)\|(?<lv>\w+)\|(?<message>.*)", {"timestamp": "t_s", "level": "lv", "request": "none"})
    lines = spark.createDataFrame([("x 12|warn|a\x01b|c",), ("2026-07-29 10:00:00 INFO m",), ("plain",), (None,)], "value string")
    rows = parse_lines(lines, odd, ParserConfig()).collect()
    assert [r["is_header"] for r in rows] == [True, True, False, False]
    assert (rows[0]["timestamp"], rows[0]["level"], rows[0]["message"], rows[0]["fields"]) == ("12", "WARN", "a\x01b|c", {"request": ""})
    assert (rows[1]["level"], rows[1]["message"]) == ("INFO", "m") and rows[2]["level"] is None
    unknown = ParserConfig(r"^(?<timestamp>\S+) (?<level>\S+) (?<message>.*)$")
    assert parse_lines(spark.createDataFrame([("t notice m",)], "value string"), unknown).first()["level"] == "UNKNOWN"


def test_patterns(spark):
    pattern, names = regex.java_pattern(r"^(?<a_b>x)(?<$c>y)\k<a_b>\$$")
    assert names == {"a_b": "ab", "$c": "c"} and pattern == r"^(?<ab>x)(?<c>y)\k<ab>\$\z"
    assert [regex.java_pattern(x)[0] for x in ("foo$|bar", "(a$)b[$]", r"\Qa$\E$", r"[\]$]$", "(?m)a$", "a[$")] == [r"foo\z|bar", r"(a\z)b[$]", r"\Qa$\E\z", r"[\]$]\z", "(?m)a$", "a[$"]
    assert regex.java_pattern(r"cost\$")[0] == r"cost\$" and regex.java_pattern("a\\\\$")[0] == "a\\\\\\z"
    odd = r"a.b\E[c"
    df = spark.createDataFrame([(odd,), ("axb",), ("a\n",)], "v string")
    assert [r[0] for r in df.select(F.col("v").rlike(regex.literal(odd))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(F.col("v").rlike(regex.java_pattern("a$")[0])).collect()] == [False] * 3
    assert regex.is_valid(spark, "a+") and not regex.is_valid(spark, "[a")


def test_file_names(spark):
    names = ["SHOP-API-serveur.2026-07-29-0.log", "shop-api-FWK.2026-07-29-10.LOG", "SHOP-API-ui.2026-07-29-.log", "SHOPXAPI-ui.2026-07-29-1.log", "xSHOP-API-ui.2026-07-29-1.log", "SHOP-API-ui.2026-07-29-1.log\n", "SHOP-API-ui.2026-07-30-1.log"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(files.file_name_matches(F.col("n"), SELECTION)).collect()] == [True, True] + [False] * 5


@settings(max_examples=30, deadline=None, suppress_health_check=[])
@given(st.lists(st.text(alphabet="aZ9-_ é", min_size=1, max_size=12), min_size=5, max_size=5))
def test_slugs_and_labels(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, slug, label in df.select("v", columns.slug(F.col("v")), columns.label(F.col("v"))).collect():
        assert slug == re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", v.lower()))
        words = [w for w in re.sub("[_-]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", v)).split(" ") if w]
        assert label == " ".join("ID" if w.lower() == "id" else w[0].upper() + w[1:] for w in words)


def test_labels(spark):
    df = spark.createDataFrame([("requestId",), ("thread",), ("user_name-x",)], "v string")
    assert [r[0] for r in df.select(columns.label(F.col("v"))).collect()] == ["Request ID", "Thread", "User Name X"]


def test_settings():
    assert [page_size(x) for x in (None, 0, -3, 7.9, 5000)] == [50, 1, 1, 7, 1000]
    assert toggled(("A",), "A") == () and toggled((), "B") == ("B",)
    assert until_input("2026-07-29T10:05") == "2026-07-29T10:05:00.000" and until_input("2026-07-29T10:05:09") == "2026-07-29T10:05:09.000" and until_input("2026-07-29") is None
    merged = LogFilter(("ERROR",), "x", True).merged(text="y")
    assert merged == LogFilter((), "y", True) and merged.merged(levels=["WARN"]) == LogFilter(("WARN",), "y", True)


def test_filters(spark, loaded):
    events = loaded[1]
    n = lambda **f: filters.apply_filter(events, LogFilter(**f)).count()
    assert n() == 9 and n(levels=("WARN", "ERROR")) == 3
    assert n(text="PAYMENT") == 1 and n(text="PAYMENT", case_sensitive=True) == 0
    assert n(text="É WITHOUT") == 1 and n(text=r"é.*END$", regex=True) == 0 and n(text=r"^2026.*DEMO$", regex=True) == 4
    assert n(text="[w-", regex=True) == 0 and n(text="x(y", regex=True) == 1
    assert n(text="w-1 shop.Invoice", case_sensitive=True) == 2  # over the border of two fields
    assert n(text="live", levels=("WARN",)) == 0
    assert events.where(filters.attribute_is(thread="w-3", level="INFO")).count() == 4
    assert events.where(filters.whole_word(F.col("message"), "slow")).count() == 2 and events.where(filters.whole_word(F.col("message"), "slo")).count() == 0


def keys(page):
    return [r["event_id"] for r in page.rows.collect()]


def test_paging(spark, loaded):
    events = loaded[1].drop("received_at")
    order = [r["event_id"] for r in events.orderBy(*timeline.ordering()).collect()]
    newest = paging.newest(events)
    assert keys(newest) == order and not newest.has_more()
    seen, cursor = order[:1], order[0]
    while True:
        page = paging.after_cursor(events, cursor, 2)
        got = keys(page)
        seen += got
        assert page.has_more() == (len(seen) < len(order))
        if not page.has_more():
            break
        cursor = got[-1]
    assert seen == order
    gone = paging.after_cursor(events, order[0], 2, LogFilter(levels=("ERROR",)))  # the cursor doesn't pass the filter
    assert keys(gone) == [] and not gone.has_more()
    page = paging.until(events, "2026-07-29T10:05:00.000")
    assert keys(page) == order[:3] and page.has_more()
    everything = paging.until(events, "2020-01-01T00:00:00.000")
    assert keys(everything) == order and not everything.has_more()
    assert keys(paging.until(events, "no time")) == order
    small = paging.first_rows(events, 4)
    assert keys(small) == order[:4] and small.has_more()


def test_merging_and_upserts(spark, tmp_path):
    rows = [(f"e{i}", i % 4, i) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id string, event_ts int, v int")
    merged = [(r["event_id"], r["_side"]) for r in timeline.merge_pages(df.where("v < 6"), df.where("v >= 4"), on_top=True).collect()]
    assert len(merged) == 12 and [dict(merged)[f"e{i}"] for i in range(12)] == [1] * 6 + [0] * 6
    times = [int(e[1:]) % 4 for e, _ in merged]
    assert times == sorted(times, reverse=True)
    assert all(merged[i][1] <= merged[i + 1][1] for i in range(11) if times[i] == times[i + 1])
    changed = timeline.upsert(df, spark.createDataFrame([("e1", 9, 100), ("new", 9, 101)], df.schema))
    assert {r["event_id"]: r["v"] for r in changed.collect()}["e1"] == 100 and changed.count() == 13
    path = str(tmp_path / "t")
    maps = df.withColumn("fields", F.create_map(F.lit("k"), F.col("v").cast("string")))
    timeline.append_version(maps, path, 1)
    for _ in range(2):  # a replay
        timeline.append_version(maps.where("v = 3").withColumn("v", F.lit(300)), path, 2)
    got = {r["event_id"]: (r["v"], r["fields"]) for r in timeline.stored_timeline(spark, path).collect()}
    assert len(got) == 12 and got["e3"] == (300, {"k": "3"}) and got["e4"] == (4, {"k": "4"})
    timeline.compact(spark, path, str(tmp_path / "u"))
    assert timeline.stored_timeline(spark, str(tmp_path / "u")).count() == 12


def test_views_and_exports(spark, loaded, tmp_path):
    _, events, _, _ = loaded
    schema = view.column_schema(spark, ParserConfig()).orderBy("position").collect()
    assert [r["id"] for r in schema] == ["timestamp", "sourceName", "level", "thread", "logger", "message"] and schema[3]["label"] == "Thread"
    assert [r["label"] for r in view.column_schema(spark).orderBy("position").collect()] == ["Time", "Source", "Level", "Message"]
    shown = view.table_view(events, ParserConfig(), ["gone", "message", "level"], {"level", "logger"})
    assert shown.columns == ["message", "level", "timestamp", "sourceName", "thread"]
    ids = events.where("level = 'WARN'").select("event_id")
    view.export_text(events, ids, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "x").glob("part*")))
    blocks = [json.loads(b) for b in text.strip().split("\n\n")]
    assert len(blocks) == 2 and blocks[0]["level"] == "WARN" and blocks[0]["fields"]["thread"] == "w-1" and '\n  "id"' in text
    message = json.loads(view.page_json(paging.first_rows(events, 2).rows, True).first()[0])
    assert message["hasMore"] is True and len(message["events"]) == 2


def test_messages_hold_objects_in_order(spark, loaded):
    sources, events, *_ = loaded
    page = paging.first_rows(events, 4)
    message = json.loads(view.page_json(page.rows.repartition(3), False, "top").first()[0])
    assert [e["id"] for e in message["events"]] == [r["event_id"] for r in page.rows.collect()] and message["append"] == "top"
    assert message["events"][0]["fields"] == {"thread": "w-3", "logger": "shop.dz.Demo"} and message["events"][0]["level"] == "INFO"
    seen = paging.snapshot(events, LogFilter(levels=("WARN",)), sources, view.column_schema(spark, ParserConfig()))
    whole = json.loads(view.snapshot_json(seen.page.rows, seen.page.has_more(), seen.sources, seen.columns).first()[0])
    assert [e["level"] for e in whole["events"]] == ["WARN", "WARN"] and whole["hasMore"] is False
    assert [x["id"][-6:] for x in whole["sources"]] == ["0-back", "1-back", "2-back"]
    assert [c["id"] for c in whole["schema"]["columns"]] == ["timestamp", "sourceName", "level", "thread", "logger", "message"]
    assert json.loads(view.page_json(events.limit(0), False).first()[0])["events"] == []


def test_files_that_cannot_be_read_are_named(spark, shares):
    folder = shares / "b/Java/apache-tomcat-back/logs"
    bad, gone, short = (folder / f"SHOP-API-ui.2026-07-29-{n}.log" for n in (20, 21, 22))
    for path in (bad, gone, short):
        write(path, BACK)
    (folder / f".{bad.name}.crc").write_bytes(b"crc\x00\x00\x00\x02\x00wrong")  # the store's own checksum doesn't fit
    directories = [str(folder)]
    listed, lines = files.list_files(spark, directories, SELECTION), files.read_lines(spark, directories, SELECTION)
    gone.unlink()
    write(short, BACK[:100])
    status = {r["file_path"].rsplit("/", 1)[1]: r for r in files.file_status(listed, lines).collect()}
    assert {n for n, r in status.items() if not r["readable"]} == {bad.name, gone.name, short.name}
    assert status[gone.name]["message"] == "Failed to read file" and f"of {len(BACK)} bytes" in status[short.name]["details"]
    fine = {n: r for n, r in status.items() if r["readable"]}
    assert set(fine) == {"shop-api-ui.2026-07-29-12.log", "SHOP-API-fwk.2026-07-29-1.log"} and all(r["message"] is None for r in fine.values())
    assert lines.count() == 6 + 1 + 2  # the others' lines came all the same
    m = matrix.read_json(spark, str(shares / "matrix.json"))
    report = files.file_report(spark, matrix.resolve_sources(m, SELECTION, str(shares)), SELECTION).collect()
    assert [(r["source_ord"], r["file_path"].rsplit("/", 1)[1]) for r in report if not r["readable"]] == [(1, bad.name)]


def test_a_load_tells_what_it_lost_from_the_same_scan(spark, shares, monkeypatch):
    folder = shares / "b/Java/apache-tomcat-back/logs"
    names = {x: f"SHOP-API-ui.2026-07-29-{n}.log" for n, x in enumerate(("bad", "gone", "cut", "short", "marked", "cr"), 20)}
    for name in names.values():
        write(folder / name, BACK)
    write(folder / names["marked"], "\ufeff" + BACK.rstrip("\n"))
    write(folder / names["cr"], BACK.replace("\n", "\r") + "end")
    (folder / f".{names['bad']}.crc").write_bytes(b"crc\x00\x00\x00\x02\x00wrong")
    listing = files.list_files

    def listed_before_they_change(*args):
        found = listing(*args)
        (folder / names["gone"]).unlink()
        write(folder / names["cut"], BACK[:-2])  # its line end and one byte
        write(folder / names["short"], BACK[:-4])  # as many bytes as a mark has, and the line end
        return found

    monkeypatch.setattr(timeline, "list_files", listed_before_they_change)
    m = matrix.read_json(spark, str(shares / "matrix.json"))
    got = timeline.load(spark, matrix.resolve_sources(m, SELECTION, str(shares)), SELECTION)
    status = {r["file_path"].rsplit("/", 1)[1]: r for r in got.files.collect()}
    assert {n for n, r in status.items() if not r["readable"]} == {names[x] for x in ("bad", "gone", "cut", "short")}
    assert status[names["cut"]]["details"] == f"{len(BACK) - 1} of {len(BACK)} bytes were read" and status[names["gone"]]["details"].startswith("vanished")
    assert status[names["cr"]]["n_lines"] == BACK.count("\n") + 1 and status[names["cr"]]["bytes_read"] == len(BACK) + 4
    by_source = {r["source_ord"]: r for r in got.sources.collect()}
    assert (by_source[1]["n_files"], by_source[1]["n_failed"]) == (8, 4) and by_source[2]["readable"] is False
    plan = got.events._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "text" not in got.files._jdf.queryExecution().executedPlan().toString().lower().split("filescan")[1][:5]
    assert got.events.where(f"file_path LIKE '%{names['cr']}'").count() == got.events.where(f"file_path LIKE '%{names['marked']}'").count()
    got.release()


@pytest.mark.parametrize("number", [stitch.number_by_window, stitch.number_by_chunk])
def test_headers_decide_before_lines_are_gathered(spark, number):
    draw = random.Random(4)
    rows = [(f, c, p, draw.random() < 0.15, f"line {c}.{p}", draw.choice(["INFO", "WARN"])) for f in "ab" for c in (0, 7, 9, 30, 31) for p in range(c % 5 * 4)]
    lines = spark.createDataFrame(rows, "source_id string, chunk bigint, pos bigint, is_header boolean, value string, level string").withColumn("message", F.col("value"))
    numbered = number(lines, ("source_id",), wanted=F.col("level") == "WARN", distance=True)
    have = {tuple(r) for r in stitch.stitch(numbered, ("source_id",), max_continuation_lines=3).select("source_id", "event_seq", "n_lines", "message").collect()}
    want, event = {}, None
    for f, c, p, is_header, value, level in rows:
        if (c, p) == min((x, y) for g, x, y, *_ in rows if g == f):
            event = None
        if is_header:
            event = [f, level, [value]]
            want[f, len([k for k in want if k[0] == f]) + 1] = event
        elif event:
            event[2].append(value)
    assert have == {(*k, len(v), "\n".join(v[:4])) for k, (_, level, v) in want.items() if level == "WARN"}
    assert any(len(v) > 8 for *_, v in want.values())


def test_parsers_of_their_own_by_source(spark):
    lines = spark.createDataFrame([("a", "1|one"), ("b", "1|one"), ("b", "2026-07-29 10:00:00 INFO two")], "source_id string, value string")
    own = ParserConfig.from_json({"linePattern": r"^(?<n>\d)\|(?<m>.*)$", "groups": {"timestamp": "n", "message": "m"}, "sources": ["a"]})
    got = parse_lines(lines, own, ParserConfig(sources=("b",))).collect()
    assert [(r["is_header"], r["message"]) for r in got] == [(True, "one"), (False, None), (True, "two")]


def test_statistics(spark, loaded, shares):
    sources, events, rejected, _ = loaded
    lines = parse_lines(files.load_lines(spark, sources, SELECTION)[0])
    stats = {r["file_path"].rsplit("/", 1)[1]: r for r in metrics.file_stats(lines, rejected).collect()}
    assert stats["SHOP-API-serveur.2026-07-29-0.log"]["n_lines"] == 7 and stats["SHOP-API-serveur.2026-07-29-0.log"]["n_bytes"] == len(BACK)
    assert stats["shop-api-ui.2026-07-29-12.log"]["n_rejects"] == 2
    per_source = {r["source_id"][-6:]: r["n_files"] for r in metrics.source_stats(metrics.file_stats(lines)).collect()}
    assert per_source == {"0-back": 1, "1-back": 2}
    linked = metrics.correlate(events)
    assert linked.where("key = 'requestId' and value = 'L1'").count() == 3
    assert metrics.traces(linked).where("value = 'L1'").first()["n_events"] == 3
    steps = [(r["step"], r["seconds_since"]) for r in metrics.trace_steps(linked).where("value = 'L1'").orderBy("step").collect()]
    assert steps == [(1, None), (2, 0.0), (3, 7200.0)]
    w = metrics.per_window(events, "1 hour").orderBy("start").collect()
    assert [(r["n_events"], r["n_errors"]) for r in w if r["start"]] == [(6, 1), (2, 0)]
    assert metrics.instances(events).count() == 2
    assert metrics.only_in_first(events.where("level = 'ERROR'"), events.where("level <> 'ERROR'")).count() == 1


def test_no_matching_directory(spark):
    m = spark.createDataFrame([("LOCAL", "SAMPLE", "c", "h", ["/no/such/share"])], matrix.SCHEMA)
    events, rejected, status = timeline.load_timeline(spark, matrix.resolve_sources(m, SELECTION), SELECTION)
    assert events.count() == 0 and rejected.count() == 0 and status.where("not readable").count() == 1


def test_other_files_are_not_opened(spark, shares):
    lines = files.read_lines(spark, [str(shares / "b/Java/apache-tomcat-back/logs")], SELECTION)
    rows = lines.groupBy("file_name").count()
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        inner = node.getClass().getSimpleName()
        if inner == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif inner.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
            if "FileSourceScan" in inner:
                scans.append(node.metrics().apply("numFiles").value())
    assert scans == [2]  # of five: one is of another day, one of another kind, one is empty
