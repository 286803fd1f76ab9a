from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.operators import metrics

START = datetime(2026, 7, 29, 10)


def rows(spark, n=600):
    out = [("sessionId", "hot" if i % 3 == 0 else f"s{i % 40}", None if i % 97 == 5 else START + timedelta(milliseconds=i * 700 % 90_001), i % 2, f"/f{i % 5}", i // 5, ["INFO", "WARN", "ERROR"][i % 3], f"source-{i % 2}") for i in range(n)]
    return spark.createDataFrame(out, "key string, value string, event_ts timestamp_ntz, source_ord bigint, file_path string, line_no bigint, level string, source_id string").repartition(3)


def test_steps_of_a_hot_value_spread_over_tasks(spark):
    events = rows(spark)
    by = Window.partitionBy("key", "value").orderBy("event_ts", "source_ord", "file_path", "line_no")
    since = (F.unix_millis(F.col("event_ts").cast("timestamp")) - F.unix_millis(F.lag("event_ts").over(by).cast("timestamp"))) / 1000
    want = events.select("value", "file_path", "line_no", F.row_number().over(by).cast("long").alias("step"), since.alias("seconds_since"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = metrics.trace_steps(events)
        order = ["key", "value", "event_ts", "source_ord", "file_path", "line_no"]
        parts = events.repartitionByRange(*order).where("value = 'hot'").select(F.spark_partition_id()).distinct().count()
        assert parts > 2
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert metrics.trace_steps(events.limit(0)).count() == 0


def test_live_rates_equal_the_batch(spark, tmp_path):
    events = rows(spark).where("event_ts IS NOT NULL")
    first, second, late = (events.where(x).coalesce(1) for x in (f"event_ts < '{START + timedelta(seconds=40)}'", f"event_ts >= '{START + timedelta(seconds=40)}'", "line_no = 1"))
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = metrics.live_rates(live, "5 seconds", "10 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).start()
    try:
        for part in (first, second, late, second.limit(0)):
            part.write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
        dropped = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    finally:
        query.stop()
    assert dropped > 0  # what came late was told
    rates = spark.read.parquet(str(tmp_path / "out"))
    closed = rates.agg(F.max("end")).first()[0]
    assert closed >= START + timedelta(seconds=75)
    columns = ("start", "n_events", "n_warnings", "n_errors", "n_sources", "n_files")
    want = metrics.per_window(events, "5 seconds").where(F.col("start") < F.lit(closed)).withColumn("start", F.col("start").cast("timestamp"))
    assert sorted(map(str, metrics.roll_up(rates, "5 seconds").select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    whole = metrics.roll_up(rates, "1 minute").agg(F.sum("n_events")).first()[0]
    assert whole == want.agg(F.sum("n_events")).first()[0]
    active = metrics.live_rates(events, active_for="30 seconds").collect()
    assert {r["source_id"] for r in active} == {"source-0", "source-1"} and sum(r["n_events"] for r in active) == events.count()
