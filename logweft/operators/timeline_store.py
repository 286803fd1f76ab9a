"""A stored timeline that is compacted while it is fed, with an index of its pages.

Layout under a folder that all readers and the writer share:

- ``deltas/<batch>-<attempt>``: the events of a batch, as they were then. ``commits/<batch>`` names the attempt that
  counts; it is replaced as a whole, so a batch that is replayed replaces itself and no reader sees half of one.
- ``base/<compaction>/bucket=<b>``: events by bucket of time (`BUCKET` seconds), newest versions alone, each file sorted by time.
- ``manifests/<number>``: which folder holds each bucket, its rows by level, and up to which batch deltas are in. The
  highest number counts. A compaction writes only the buckets that its deltas touch, into a new folder, and the
  manifest last: what a crash leaves before that is not part of any manifest, and the next compaction does it again.

An event's time doesn't change from version to version: it is in its header, from which the id comes. So versions meet
within a bucket. Events without a time are a bucket of their own, the last.

The manifest is the page index: counts by bucket and level, newest first. A page, an until-page, whether more follows,
and the cut of a retention find their buckets by adding up counts, and only these are read (and the deltas since, of
which there are few). A filter that the counts don't tell about reads more buckets until it has enough, twice as many
each time; of a text or a pattern, ``grams/<compaction>`` (postings of three-letter grams by bucket) tells which
buckets can have it at all. One writer; any number of readers, who keep what they have begun to read until `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.functions.columns import event_time
from logweft.functions.literals import filter_tree, grams_of, holds
from logweft.functions.regex import is_valid, search_pattern
from logweft.operators import text_index
from logweft.operators.filters import predicate
from logweft.operators.paging import Page, after, read_page
from logweft.operators.timeline import ORDER, latest_versions, ordering
from logweft.plans.config import DEFAULT_PAGE, LogFilter, page_size
from logweft.sources import shared_files

BUCKET = 3600
#: So many rows of a bucket meet in one place of a compaction's shuffle, and go to one file.
PIECE = 100_000
#: The bucket of events without a time.
TIMELESS = -(1 << 40)
EVENT = "event_id string, timestamp string, event_ts timestamp_ntz, received_at timestamp, source_id string, source_name string, file_path string, level string, message string, fields map<string,string>, source_ord bigint, line_no bigint, generation int"


def bucket_of(time: Column, width: int = BUCKET) -> Column:
    return F.coalesce(F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time) / width), F.lit(TIMELESS)).cast("bigint")


@dataclass
class Manifest:
    """``buckets``: by bucket its folder, and its rows by level; ``through``: the last batch that is in."""

    number: int = 0
    through: int = -1
    buckets: dict[int, tuple[str, dict[str, int]]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"through": self.through, "buckets": [[b, folder, counts] for b, (folder, counts) in sorted(self.buckets.items())]})

    @classmethod
    def from_json(cls, number: int, text: str) -> Manifest:
        data = json.loads(text)
        return cls(number, data["through"], {b: (folder, counts) for b, folder, counts in data["buckets"]})

    def rows(self, bucket: int, levels: tuple[str, ...] = ()) -> int:
        counts = self.buckets[bucket][1]
        return sum(n for level, n in counts.items() if not levels or level in levels)

    def newest_first(self) -> list[int]:
        return sorted(self.buckets, reverse=True)


class BatchLog:
    """Rows by batch. A batch that comes again replaces itself, and readers see whole batches only."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.versioned = f"{schema}, version bigint"

    def append(self, rows: DataFrame, batch: int) -> None:
        folder = f"{batch:012d}-{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*columns, F.lit(batch).cast("bigint").alias("version")).write.parquet(f"{self.path}/deltas/{folder}")
        shared_files.write_text(self.spark, f"{self.path}/commits/{batch:012d}", folder)

    def commits(self, through: int = -1) -> dict[int, str]:
        """The batches after ``through``, and where they are."""
        later = [n for n in shared_files.names(self.spark, f"{self.path}/commits") if n.isdigit() and int(n) > through]
        return {int(n): shared_files.read_text(self.spark, f"{self.path}/commits/{n}") for n in later}

    def deltas(self, commits: dict[int, str]) -> DataFrame:
        return self._table([f"{self.path}/deltas/{f}" for f in commits.values()])

    def _table(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.versioned).parquet(*paths) if paths else self.spark.createDataFrame([], self.versioned)


class TimelineStore(BatchLog):
    def __init__(self, spark: SparkSession, path: str, schema: str = EVENT, width: int = BUCKET):
        super().__init__(spark, path, schema)
        self.width = width

    # --- writing (and `append`, which changes nothing of a batch that is compacted already) ---

    def compact(self, through: int | None = None) -> Manifest:
        """Bring the batches up to ``through`` (all, by default) into the base: the buckets that they touch are written anew."""
        return self._compact(self.manifest(), through)

    def _compact(self, old: Manifest, through: int | None = None, floor: int | None = None) -> Manifest:
        """Events older than the bucket ``floor``, if there is one, are left out."""
        new = {b: f for b, f in self.commits(old.through).items() if through is None or b <= through}
        if not new:
            return old
        deltas = self._bucketed(self.deltas(new))
        if floor is not None:
            deltas = deltas.where(F.col("bucket") >= floor)
            old = Manifest(old.number, old.through, {b: x for b, x in old.buckets.items() if b >= floor})
        sizes = {b: n for b, n in deltas.groupBy("bucket").count().collect()}  # hours that a few batches have
        held = [b for b in sizes if b in old.buckets]
        sizes |= {b: sizes[b] + old.rows(b) for b in held}
        rows = self._newest(self._bucketed(self._base(old, held)).unionByName(deltas), sizes)
        return self._publish(old, rows, list(sizes), max(new), old.through)

    def retain_newest(self, n: int) -> Manifest:
        """Keep the newest ``n`` events. Whole buckets go by their counts; only the one at the cut is read and written.

        The base's counts are of different events, and batches since can only add some. So the buckets that have ``n``
        of them are enough, and what is older goes before it is compacted.
        """
        old, sure, floor = self.manifest(), 0, None
        for b in old.newest_first():
            sure += old.rows(b)
            if sure >= n:
                floor = b
                break
        old, left = self._compact(old, floor=floor), n
        kept: dict[int, tuple[str, dict[str, int]]] = {}
        for b in old.newest_first():
            rows = old.rows(b)
            if rows <= left:
                kept[b] = old.buckets[b]
                left -= rows
                continue
            cut = Manifest(old.number, old.through, kept)
            rows = self._bucketed(self._base(old, [b]).orderBy(*ordering()).limit(left))
            return self._publish(cut, rows.repartitionByRange("bucket", "event_ts", "event_id"), [b] if left else [], old.through)
        return old

    def vacuum(self, keep: int = 1) -> None:
        """Delete what none of the newest ``keep`` manifests needs; readers of older states must be done."""
        states = [self._read(n) for n in self._numbers()[-keep:]]
        if not states:
            return
        through, used = states[0].through, {folder for s in states for folder, _ in s.buckets.values()}
        newest = states[-1].number
        for name in shared_files.names(self.spark, f"{self.path}/base"):
            if name not in used and int(name.split("-")[0]) <= newest:
                shared_files.delete(self.spark, f"{self.path}/base/{name}")
                shared_files.delete(self.spark, f"{self.path}/grams/{name}")
        live = set(self.commits(through).values())
        for name in shared_files.names(self.spark, f"{self.path}/deltas"):
            if name not in live and int(name.split("-")[0]) <= through:
                shared_files.delete(self.spark, f"{self.path}/deltas/{name}")
        for folder, old in (("commits", lambda n: n <= through), ("manifests", lambda n: n < states[0].number)):
            for name in shared_files.names(self.spark, f"{self.path}/{folder}"):
                if name.isdigit() and old(int(name)):
                    shared_files.delete(self.spark, f"{self.path}/{folder}/{name}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(F.col("event_ts"), self.width))

    def _newest(self, rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """The newest version of every event, in one shuffle: versions meet by bucket, or by piece of a bucket that has more than `PIECE` rows."""
        large, pieces = [(b, -(-n // PIECE)) for b, n in sizes.items() if n > PIECE], F.lit(1)
        if large:  # a row for each
            rows = rows.join(F.broadcast(self.spark.createDataFrame(large, "bucket bigint, pieces bigint")), "bucket", "left")
            pieces = F.coalesce("pieces", F.lit(1))
        dealt = rows.withColumn("piece", F.pmod(F.xxhash64("event_id"), pieces)).repartition("bucket", "piece")
        by = Window.partitionBy("bucket", "piece", "event_id").orderBy(F.desc("version"))
        return dealt.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r", "piece", "pieces")

    def _publish(self, old: Manifest, rows: DataFrame, touched: list[int], through: int, indexed: int = -1) -> Manifest:
        """A manifest with ``rows`` in place of the buckets ``touched``. Of versions up to ``indexed``, the old postings have the grams: those of a replaced version stay, and only add a bucket to look at."""
        folder = f"{old.number + 1:012d}-{uuid.uuid4().hex}"
        at = f"{self.path}/base/{folder}"
        buckets = dict(old.buckets)
        if touched:
            rows.sortWithinPartitions("bucket", "event_ts").write.partitionBy("bucket").parquet(at)
            written = self.spark.read.schema(f"{self.versioned}, bucket bigint").parquet(at)
            held = [b for b in touched if b in old.buckets]
            fresh = written.where(F.col("version") > indexed) if held else written
            text_index.postings(fresh, self._index(old, held) if held else None).write.parquet(f"{self.path}/grams/{folder}")
            counts: dict[int, dict[str, int]] = {}
            for b, level, n in written.groupBy("bucket", F.coalesce("level", F.lit("")).alias("level")).count().collect():  # buckets x levels
                counts.setdefault(b, {})[level] = n
            buckets |= {b: (folder, c) for b, c in counts.items()}
        new = Manifest(old.number + 1, through, buckets)
        shared_files.write_text(self.spark, f"{self.path}/manifests/{new.number:012d}", new.to_json())
        return new

    # --- reading ---

    def _numbers(self) -> list[str]:
        return [n for n in shared_files.names(self.spark, f"{self.path}/manifests") if n.isdigit()]

    def _read(self, number: str) -> Manifest:
        return Manifest.from_json(int(number), shared_files.read_text(self.spark, f"{self.path}/manifests/{number}"))

    def manifest(self) -> Manifest:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else Manifest()

    def _base(self, manifest: Manifest, buckets: list[int]) -> DataFrame:
        return self._table([f"{self.path}/base/{manifest.buckets[b][0]}/bucket={b}" for b in buckets])

    def _index(self, manifest: Manifest, buckets: list[int]) -> DataFrame:
        """The postings of these buckets."""
        folders = sorted({manifest.buckets[b][0] for b in buckets})
        parts = [self.spark.read.schema(text_index.SCHEMA).parquet(f"{self.path}/grams/{f}").withColumn("folder", F.lit(f)) for f in folders]
        held = self.spark.createDataFrame([(b, manifest.buckets[b][0]) for b in buckets], "bucket bigint, folder string")
        return reduce(DataFrame.unionByName, parts).join(F.broadcast(held), ["bucket", "folder"])  # a row for each bucket of the manifest

    def _view(self, manifest: Manifest, buckets: list[int], floor: int | None, commits: dict[int, str] | None = None, top: int | None = None) -> DataFrame:
        """The newest versions of these buckets' events, and of the deltas' from the bucket ``floor`` to ``top``."""
        base = self._base(manifest, buckets)
        commits = self.commits(manifest.through) if commits is None else commits
        if not commits:
            return base.drop("version")
        deltas = self.deltas(commits)
        if floor is not None:
            deltas = deltas.where(bucket_of(F.col("event_ts"), self.width) >= floor)
        if top is not None:
            deltas = deltas.where(bucket_of(F.col("event_ts"), self.width) <= top)
        return latest_versions(base.unionByName(deltas)).drop("version")

    def candidates(self, manifest: Manifest, wanted: LogFilter | None) -> list[int]:
        """The buckets, newest first, that may have events which pass: by their levels, and by the grams that the filter's text or pattern needs."""
        order = manifest.newest_first()
        if not wanted:
            return order
        order = [b for b in order if manifest.rows(b, tuple(wanted.levels))]
        is_pattern = wanted.regex and bool(wanted.text) and is_valid(self.spark, search_pattern(wanted.text, wanted.case_sensitive))
        tree = filter_tree(wanted, is_pattern)
        if tree is None or not order:
            return order
        has = text_index.found(self._index(manifest, order), grams_of(tree))
        return [b for b in order if holds(tree, has.get(b, set()))]

    def search(self, wanted: LogFilter) -> DataFrame:
        """All events that pass, read from the buckets that may have some, and from the deltas."""
        now = self.manifest()
        return self._filtered(self._view(now, self.candidates(now, wanted), None), wanted)

    def events(self) -> DataFrame:
        """The whole timeline."""
        now = self.manifest()
        return self._view(now, now.newest_first(), None)

    def _paged(self, n: int, wanted: LogFilter | None, top: int | None, test: Column | None) -> Page:
        """The first ``n`` rows that pass, of the bucket ``top`` and older ones."""
        now = self.manifest()
        commits = self.commits(now.through)
        order = [b for b in self.candidates(now, wanted) if top is None or b <= top]
        levels = tuple(wanted.levels) if wanted else ()
        passes = [predicate(self.spark, wanted)] if wanted and wanted != LogFilter() else []
        passes += [] if test is None else [test]
        take, sure = 0, 0
        while take < len(order) and sure < n + 1:
            sure += now.rows(order[take], levels)
            take += 1
        if test is not None and take < len(order):
            take += 1  # rows of the cursor's bucket before the cursor count, too
        while True:
            floor = order[take - 1] if 0 < take < len(order) else None
            rows = self._view(now, order[:take], floor, commits, top)
            rows = reduce(DataFrame.where, passes, rows) if passes else rows
            page = read_page(rows.orderBy(*ordering()).limit(n + 1), n)
            if page.known or take >= len(order):
                return page
            take = min(len(order), 2 * take + 1)

    def newest(self, wanted: LogFilter | None = None, n: int = DEFAULT_PAGE) -> Page:
        return self._paged(n, wanted, None, None)

    def after_cursor(self, cursor: dict, limit: float | None = None, wanted: LogFilter | None = None) -> Page:
        """Rows older than the one with the cursor's values of the order's columns (event_ts, source_ord, file_path, line_no)."""
        at = tuple(cursor[c] for c, _ in ORDER)
        top = TIMELESS if at[0] is None else self._bucket(at[0])
        return self._paged(page_size(limit), wanted, top, after(ORDER, at))

    def until(self, timestamp: str, wanted: LogFilter | None = None) -> DataFrame:
        """All rows newer than the time and the first that isn't; all, if none is that old or the time can't be read."""
        value = self.spark.range(1).select(event_time(F.lit(timestamp)).alias("t")).first()["t"]
        now = self.manifest()
        commits, order = self.commits(now.through), self.candidates(now, wanted)
        if value is None:
            return self._filtered(self._view(now, order, None, commits), wanted).orderBy(*ordering())
        older = self._paged_older(value, wanted)
        floor = self._bucket(value)
        newer = self._filtered(self._view(now, [b for b in order if b >= floor], floor, commits), wanted).where(F.col("event_ts") > F.lit(value))
        if older is None:
            return self._filtered(self._view(now, order, None, commits), wanted).orderBy(*ordering())
        return newer.unionByName(older).orderBy(*ordering())

    def _paged_older(self, value, wanted: LogFilter | None) -> DataFrame | None:
        page = self._paged(1, wanted, self._bucket(value), F.col("event_ts") <= F.lit(value))
        return None if page.rows.isEmpty() else page.rows

    def _filtered(self, rows: DataFrame, wanted: LogFilter | None) -> DataFrame:
        return rows.where(predicate(self.spark, wanted)) if wanted and wanted != LogFilter() else rows

    def _bucket(self, time) -> int:
        return (time - datetime(1970, 1, 1)) // timedelta(seconds=self.width)
