"""Pages of the timeline: the newest, those after a cursor, and all down to a time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.functions.columns import event_time
from logweft.operators.filters import apply_filter
from logweft.operators.timeline import ORDER, ordering
from logweft.plans.config import DEFAULT_PAGE, LogFilter, page_size


@dataclass
class Page:
    """``rows`` in order; ``has_more`` asks Spark whether rows are left after them, unless that is known."""

    rows: DataFrame
    more: DataFrame | None = None
    known: bool | None = None
    first: DataFrame | None = None  # the rows and one more
    size: int | None = None

    def has_more(self) -> bool:
        return self.known if self.known is not None else self.more is not None and not self.more.isEmpty()

    def fetched(self) -> Page:
        """The same page from a single run: its rows, and the one that may follow them, are read (1,001 at most)."""
        if self.known is not None or self.first is None:
            return self
        return read_page(self.first, self.size)


def read_page(first: DataFrame, size: int) -> Page:
    """A page of ``size`` rows from ``first``, which has one more if there is one; it is read here. Maps keep their order."""
    maps = {f.name for f in first.schema if f.dataType.typeName() == "map"}
    flat = first.select(*(F.map_entries(c).alias(c) if c in maps else F.col(c) for c in first.columns))
    rows = flat.collect()
    local = first.sparkSession.createDataFrame(rows[:size], flat.schema)
    return Page(local.select(*(F.map_from_entries(c).alias(c) if c in maps else F.col(c) for c in first.columns)), known=len(rows) > size)


def after(keys, values) -> Column:
    """Rows strictly after the one with these key values, nulls last: later in the first key, or equal in it and later in the next, and so on."""
    cases, equal = [], F.lit(True)
    for (name, down), value in zip(keys, values):
        c = F.col(name)
        if value is not None:
            later = (c < F.lit(value) if down else c > F.lit(value)) | c.isNull()
            cases.append(equal & later)
        equal = equal & c.eqNullSafe(F.lit(value))
    return reduce(lambda a, b: a | b, cases, F.lit(False))


def first_rows(events: DataFrame, n: int, keys=ORDER) -> Page:
    """The first n rows in order: a top-k in every task, then of their results."""
    rows = events.orderBy(*ordering(keys))
    return Page(rows.limit(n), rows.limit(n + 1).offset(n), first=rows.limit(n + 1), size=n)


def newest(events: DataFrame, wanted: LogFilter | None = None, keys=ORDER) -> Page:
    return first_rows(apply_filter(events, wanted) if wanted else events, DEFAULT_PAGE, keys)


def after_cursor(events: DataFrame, cursor: object, limit: float | None = None, wanted: LogFilter | None = None, key: str = "event_id", keys=ORDER) -> Page:
    """Rows older than the cursor's among those that pass the filter; none if the cursor isn't among them.

    The cursor is one row: its keys are read first and become literals, so that the scan can skip by time.
    """
    kept = apply_filter(events, wanted) if wanted else events
    found = kept.where(F.col(key) == F.lit(cursor)).select(*(c for c, _ in keys)).take(1)
    if not found:
        return Page(events.limit(0))
    return first_rows(kept.where(after(keys, tuple(found[0]))), page_size(limit), keys)


def until(events: DataFrame, timestamp: str, wanted: LogFilter | None = None, keys=ORDER) -> Page:
    """All rows newer than the time and the first that is not; all rows if none is that old or the time can't be read."""
    kept = apply_filter(events, wanted) if wanted else events
    time = keys[0][0]
    at = event_time(F.lit(timestamp)).cast(kept.schema[time].dataType)
    older = kept.where(F.col(time) <= at)
    stop = first_rows(older, 1, keys)
    if stop.rows.isEmpty():
        return Page(kept.orderBy(*ordering(keys)))
    rows = kept.where(F.col(time) > at).unionByName(stop.rows).orderBy(*ordering(keys))
    nulls = kept.where(F.col(time).isNull()).limit(1)
    return Page(rows, stop.more.limit(1).unionByName(nulls))


@dataclass
class Snapshot:
    page: Page
    sources: DataFrame
    columns: DataFrame


def snapshot(events: DataFrame, wanted: LogFilter, sources: DataFrame, columns: DataFrame) -> Snapshot:
    return Snapshot(newest(events, wanted), sources, columns)
