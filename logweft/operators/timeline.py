"""One timeline of all sources: order, merging, upserts and the stored form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.operators.fold import Stitched, stitch_staged
from logweft.operators.parse import parse_lines
from logweft.operators.stitch import as_events
from logweft.plans.config import ParserConfig, Selection
from logweft.sources.files import file_status, list_files, read_lines, source_status, with_marks, with_source

#: Newest first; ties in order of arrival: source, file, line. Times that don't exist come last.
ORDER = (("event_ts", True), ("source_ord", False), ("file_path", False), ("line_no", False))


def ordering(keys=ORDER) -> list:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]


@dataclass
class Loaded:
    """A selection as it was read: its ``events`` and ``rejected`` lines, and what became of its ``sources`` and ``files``."""

    events: DataFrame
    rejected: DataFrame
    sources: DataFrame
    files: DataFrame
    stitched: Stitched | None = None

    def release(self) -> None:
        """Delete what was staged; the tables can't be read any more."""
        if self.stitched:
            self.stitched.release()


def load(spark: SparkSession, sources: DataFrame, selection: Selection, *configs: ParserConfig, max_continuation_lines: int | None = None, headers: Column | None = None) -> Loaded:
    """Read all matching files in one scan, stitch within its tasks, and stage the events in the folder ``spark.checkpoint.dir``.

    ``files`` names every file that wasn't read whole, from the counts of that same scan, and ``sources`` has every
    source with its files, those that failed, lines and bytes. ``headers`` is a test of what an event's first line
    tells (level, source, fields, not the whole message): other events aren't put together.
    """
    status = source_status(spark, sources)
    directories = [r["directory"] for r in status.where("readable").select("directory").collect()]
    listed = list_files(spark, directories, selection)
    lines = parse_lines(with_source(read_lines(spark, directories, selection), sources), *configs)
    done = stitch_staged(lines, wanted=headers, max_continuation_lines=max_continuation_lines)
    read = done.splits.select("file_path", "n_lines", "n_bytes")
    files = with_source(file_status(with_marks(spark, listed, read), read), sources)
    by_source = files.groupBy("source_id").agg(
        F.count("*").alias("n_files"), F.count_if(~F.col("readable")).alias("n_failed"), F.sum("n_lines").alias("n_lines"), F.sum("bytes_read").alias("n_bytes")
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files", "n_failed", "n_lines", "n_bytes")]
    return Loaded(as_events(done.events), done.rejected, status.join(by_source, "source_id", "left").select(*status.columns, *counts), files, done)


def load_timeline(spark: SparkSession, sources: DataFrame, selection: Selection, *configs: ParserConfig, max_continuation_lines: int | None = None, headers: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events of all matching files, rejected lines, and the status of each source with its failed files counted (see `load`)."""
    got = load(spark, sources, selection, *configs, max_continuation_lines=max_continuation_lines, headers=headers)
    return got.events, got.rejected, got.sources


def merge_pages(current: DataFrame, incoming: DataFrame, on_top: bool = False, key: str = "event_id", time: str = "event_ts") -> DataFrame:
    """Both lists, newest first; incoming rows that are in the current list are left out. Ties favour the current list, or the incoming one if it comes ``on_top``.

    ``_side`` tells the lists apart and orders ties.
    """
    new = incoming.join(current.select(key), key, "left_anti").select(*current.columns)
    both = current.withColumn("_side", F.lit(int(on_top))).unionByName(new.withColumn("_side", F.lit(int(not on_top))))
    rest = [k for k in ORDER[1:] if k[0] in current.columns]
    return both.orderBy(F.col(time).desc_nulls_last(), "_side", *ordering(rest))


def latest_versions(versions: DataFrame, key: str = "event_id", version: str = "version") -> DataFrame:
    """The newest version of every event. Aggregation rather than a window: versions are reduced before the shuffle."""
    rest = [c for c in versions.columns if c not in (key, version)]
    plain = [c for c in rest if not versions.schema[c].dataType.simpleString().startswith("map")]
    maps = [c for c in rest if c not in plain]
    packed = F.struct(version, *plain, *(F.map_entries(c).alias(c) for c in maps))
    best = versions.groupBy(key).agg(F.max_by(packed, F.col(version)).alias("_v"))
    return best.select(key, f"_v.{version}", *(F.map_from_entries(f"_v.{c}").alias(c) if c in maps else F.col(f"_v.{c}") for c in rest))


def upsert(current: DataFrame, changes: DataFrame, key: str = "event_id") -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same key, and the others added."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes.select(*current.columns))


def append_version(events: DataFrame, path: str, batch_id: int) -> None:
    """Store a batch as its own partition; writing it again replaces it, so a replay adds nothing."""
    events.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stored_timeline(spark: SparkSession, path: str) -> DataFrame:
    return latest_versions(spark.read.parquet(path).drop("batch_id"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The newest versions alone, in time order within files so that times prune row groups, as batch 0 of ``target``."""
    rows = stored_timeline(spark, path).repartitionByRange("event_ts").sortWithinPartitions("event_ts")
    rows.write.mode("overwrite").parquet(f"{target}/batch_id=0")


def retain_newest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(*ordering()).limit(n)
