import random

import pytest
from pyspark.sql import functions as F

from logweft.operators import fold, stitch
from logweft.operators.parse import parse_lines
from logweft.operators.timeline import load_timeline
from logweft.plans.config import Selection
from logweft.sources import files, matrix

HEADER = "2026-07-29 10:00:%02d.%03d %s [t%d] app.x - begins %d"


def lines_of(seed, files=4, n=200):
    draw, out = random.Random(seed), []
    for f in range(files):
        share = [0.9, 0.3, 0.02, 0.0][f % 4]
        for i in range(draw.randrange(1, n)):
            text = HEADER % (i % 60, f, draw.choice(["INFO", "ERROR"]), f, i) if draw.random() < share else draw.choice(["", "  at x.y(Z:%d)" % i, "é ß", None])
            out.append((f"s{f % 2}", f"/d/{f}.log", text, i))
    return out


def numbered(spark, rows, chunk, turns=False):
    """Lines cut into splits of ``chunk`` lines, each in one task, those of several files in turns if so wished."""
    tasks = {}
    for s, f, v, i in rows:
        tasks.setdefault(i // chunk if turns else (f, i // chunk), []).append((s, f, "n" + s, 1, v, i // chunk, i))
    parts = [sorted(x, key=lambda r: r[-1]) if turns else x for x in tasks.values()]
    schema = "source_id string, file_path string, source_name string, source_ord bigint, value string, chunk bigint, pos bigint"
    tasks = [[x for part in parts[k::8] for x in part] for k in range(min(8, len(parts)))]  # a task has several splits
    rdd = spark.sparkContext.parallelize(tasks, max(1, len(tasks))).flatMap(lambda x: x)
    return parse_lines(spark.createDataFrame(rdd, schema))


def listed(df, *columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


EVENT = ("file_path", "event_seq", "line_no", "n_lines", "message", "timestamp", "level", "source_name", "fields")


@pytest.mark.parametrize("chunk,turns", [(1, False), (3, True), (17, False), (10**6, False)])
def test_fold_equals_the_window(spark, chunk, turns):
    lines = numbered(spark, lines_of(chunk), chunk, turns)
    for most in (0, None):
        want = stitch.stitch(stitch.number_by_window(lines), max_continuation_lines=most)
        got = fold.stitch_staged(lines, max_continuation_lines=most)
        assert listed(got.events, *EVENT) == listed(want, *EVENT)
    lost = stitch.rejects(stitch.number_by_window(lines)).withColumn("value", F.coalesce("value", F.lit("")))
    assert listed(got.rejected, "file_path", "line_no", "value") == listed(lost, "file_path", "line_no", "value")
    wanted = F.col("level") == "ERROR"
    want = stitch.stitch(stitch.number_by_window(lines, wanted=wanted))
    assert listed(fold.stitch_staged(lines, wanted=wanted).events, *EVENT) == listed(want, *EVENT)
    assert got.splits.agg(F.sum("n_lines")).first()[0] == lines.count()


def test_one_scan_and_no_exchange_of_lines(spark, small):
    from logweft.plans import queries

    folded = fold.fold_splits(parse_lines(queries.log_lines(spark, small)))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Window" not in plan
    done = fold.stitch_staged(parse_lines(queries.log_lines(spark, small)))
    events = done.events._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in events and "SortMergeJoin" not in events.split("Union")[0]
    done.release()


def test_parts_that_overlap_are_an_error(spark):
    rows = [("s", "/f", "n", 1, "x", 0, i) for i in range(10)]
    schema = "source_id string, file_path string, source_name string, source_ord bigint, value string, chunk bigint, pos bigint"
    mixed = spark.createDataFrame(spark.sparkContext.parallelize(rows[::2] + rows[1::2], 2), schema)
    with pytest.raises(Exception, match="overlap"):
        fold.stitch_staged(parse_lines(mixed)).rejected.collect()


def test_a_task_holds_a_bounded_number_of_splits(spark):
    """More files take turns than a task holds open: splits are let go, come back, and nothing of them is lost."""
    n = fold.OPEN_SPLITS + 60
    rows = [(f"s{f % 2}", f"/d/{f}.log", HEADER % (i, f % 1000, "INFO", f, i) if (i + f) % 4 == 0 else f"  at x{i}", i) for i in range(8) for f in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        schema = "source_id string, file_path string, value string, pos bigint"
        lines = parse_lines(spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), schema).withColumns({"source_name": F.lit("n"), "chunk": F.lit(0)}))
        got = fold.stitch_staged(lines)
        want = stitch.stitch(stitch.number_by_window(lines))
        assert listed(got.events, *EVENT) == listed(want, *EVENT)
        lost = stitch.rejects(stitch.number_by_window(lines))
        assert listed(got.rejected, "file_path", "line_no", "value") == listed(lost, "file_path", "line_no", "value")
        assert got.splits.count() > n and got.splits.agg(F.sum("n_lines")).first()[0] == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing(spark):
    done = fold.stitch_staged(numbered(spark, [], 5))
    assert done.events.count() == 0 and done.rejected.count() == 0 and done.splits.count() == 0
