"""Stitching within the tasks that read the lines.

`fold_splits` runs in the task that scans a split: it puts the lines of each event together, run by run from header to
header, and never sends a line elsewhere. What a split can't know is small: how many lines came before it, and to
which event its leading lines without a header belong. So a split gives, beside its events, a row of counts and its
leading lines; `finish` adds up the counts in front of each split and brings leading lines to the event that was open
(the border exchange). Of a file within one split nothing is exchanged.

A split's lines are in order within its task, as Spark's file scan gives them; lines of several files may take turns.
A table that deals a split over several tasks may be folded, too, if each has a stretch of its own: the parts are
ordered by their first position, and overlapping ones are an error.

The fold holds the open events of the `OPEN_SPLITS` splits that had lines last; everything else goes on with the batch.
A split that is let go before its end is a part of its split, as if a task had ended there: should more of its lines
come, they are the next part. `stitch_staged` writes the folded rows once, so that events, rejected lines and counts all
come from a single scan of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from logweft.operators.stitch import KEYS
from logweft.sources.staging import remove, stage

#: So many rows of counts, one for each split, are broadcast at most; beyond it they are joined by a shuffle.
MOST_SPLITS = 100_000
#: A task holds so many splits that may go on. Of a file scan one does, or as many as there are files that take turns.
OPEN_SPLITS = 256
_OWN = "kind string, chunk bigint, first bigint, end bigint, row bigint, head bigint, n_lines bigint, n_headers bigint, n_lead bigint, n_bytes bigint, last boolean, message string, lines array<string>"
_NEVER = 1 << 62


@dataclass
class _Split:
    """What is known of a split so far."""

    start: pa.RecordBatch  # its first row
    first: int
    end: int = -1
    n_lines: int = 0
    n_headers: int = 0
    n_bytes: int = 0
    n_lead: int = 0
    header: pa.RecordBatch | None = None  # of the open event
    row: int = 0
    event_lines: int = 0
    texts: list[str] = field(default_factory=list)


class _Fold:
    def __init__(self, out: pa.Schema, named: list[str], most: int | None):
        self.out, self.named, self.most = out, named, _NEVER if most is None else most
        self.splits: dict[tuple, _Split] = {}

    def _batch(self, rows: pa.RecordBatch, **own) -> pa.RecordBatch:
        n = rows.num_rows
        columns = []
        for f in self.out:
            if f.name in own:
                x = own[f.name]
                columns.append(pa.array(x, f.type) if isinstance(x, (list, np.ndarray)) else pa.repeat(pa.scalar(x, f.type), n) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x)
            else:
                columns.append(rows.column(f.name) if f.name in self.named or f.name == "chunk" else pa.nulls(n, f.type))
        return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, self.out)], schema=self.out)

    def _closed(self, done: list[tuple[_Split, bool]]) -> Iterator[pa.RecordBatch]:
        """Open events that are complete, or the last of their split."""
        done = [(s, last) for s, last in done if s.header is not None and s.header.column("_wanted")[0].as_py()]
        if done:
            headers = pa.Table.from_batches([s.header for s, _ in done]).combine_chunks().to_batches()[0]
            own = {"first": [s.first for s, _ in done], "row": [s.row for s, _ in done], "head": [s.n_headers for s, _ in done], "n_lines": [s.event_lines for s, _ in done]}
            yield self._batch(headers, kind="event", last=[last for _, last in done], message=["\n".join(s.texts) for s, _ in done], **own)

    def add(self, batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
        code = np.zeros(batch.num_rows, np.int64)
        for k in [*keys, "chunk"]:
            one = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.unique(code * (one.max() + 1) + one, return_inverse=True)[1]
        came = np.arange(batch.num_rows)
        if (code[1:] < code[:-1]).any():  # files take turns
            came = np.argsort(code, kind="stable")
            batch, code = batch.take(pa.array(came)), code[came]
        n = batch.num_rows
        is_header = batch.column("is_header").to_numpy(zero_copy_only=False)
        position = batch.column("_pos").to_numpy(zero_copy_only=False)
        n_bytes = np.r_[0, np.cumsum(batch.column("_bytes").to_numpy(zero_copy_only=False))]
        begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[begins[1:], n]
        runs = np.flatnonzero(np.r_[True, code[1:] != code[:-1]] | is_header)  # from header to header, and what leads a split's rows
        size = np.diff(np.r_[runs, n])
        part = np.searchsorted(begins, runs, "right") - 1
        final = np.r_[part[1:] != part[:-1], True]
        texts, names = batch.column("_text"), [batch.column(k).take(pa.array(begins)).to_pylist() for k in [*keys, "chunk"]]
        base, first, heads = (np.zeros(len(begins), np.int64) for _ in range(3))
        run_of = np.searchsorted(runs, begins)
        closed, opened, lead = [], [], []
        names = list(zip(*names))
        for i, name in enumerate(names):
            b, e = int(begins[i]), int(ends[i])
            s = self.splits.get(name)
            if s is None:
                s = self.splits[name] = _Split(batch.slice(b, 1).take(pa.array([0])), int(position[b]))
            base[i], first[i], heads[i] = s.n_lines, s.first, s.n_headers
            r = int(run_of[i])
            if not is_header[b]:
                stop = b + int(size[r])
                if s.header is None:
                    lead.append((i, b, stop))
                    s.n_lead += stop - b
                else:
                    room = max(0, self.most + 1 - s.event_lines)
                    s.texts += texts.slice(b, min(stop - b, room)).to_pylist()
                    s.event_lines += stop - b
                r += 1
            if r < len(runs) and part[r] == i:
                if s.header is not None:
                    closed.append((_Split(s.start, s.first, n_headers=s.n_headers, header=s.header, row=s.row, event_lines=s.event_lines, texts=s.texts), False))
                z = int(runs[np.searchsorted(part, i, "right") - 1])
                opened.append((s, z, e))
            s.end, s.n_lines = int(position[e - 1]), s.n_lines + e - b
            s.n_headers += int(is_header[b:e].sum())
            s.n_bytes += int(n_bytes[e] - n_bytes[b])
        yield from self._closed(closed)
        for s, z, e in opened:
            s.header, s.row, s.event_lines = batch.slice(z, 1).take(pa.array([0])), s.n_lines - (e - z), e - z
            s.texts = texts.slice(z, min(e - z, self.most + 1)).to_pylist()
        wanted = batch.column("_wanted").to_numpy(zero_copy_only=False)
        picked = is_header[runs] & ~final & wanted[runs]
        if picked.any():
            at = runs[picked]
            within = np.arange(n) - np.repeat(runs, size)
            inside = np.repeat(picked, size) & (within <= self.most)
            offsets = np.r_[0, np.cumsum(np.minimum(size[picked], self.most + 1))].astype(np.int32)
            message = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts.filter(pa.array(inside)).cast(pa.string())), "\n")
            p = part[picked]
            ordinal = np.cumsum(is_header)[at] - np.r_[0, np.cumsum(is_header)][begins[p]] + heads[p]
            yield self._batch(batch.take(pa.array(at)), kind="event", first=first[p], row=at - begins[p] + base[p], head=ordinal, n_lines=size[picked], last=False, message=message)
        if lead:
            at = np.array([b for _, b, _ in lead])
            p = np.array([i for i, _, _ in lead])
            yield self._batch(batch.take(pa.array(at)), kind="lead", first=first[p], row=base[p], n_lines=[e - b for _, b, e in lead], lines=[texts.slice(b, e - b).to_pylist() for _, b, e in lead])
        for i in np.argsort(came[ends - 1]):  # those with the last lines stand last
            self.splits[names[i]] = self.splits.pop(names[i])
        yield from self.let_go(OPEN_SPLITS)

    def let_go(self, held: int = 0) -> Iterator[pa.RecordBatch]:
        """Open events and counts of all splits but the last ``held``."""
        gone = [self.splits.pop(name) for name in list(self.splits)[: max(0, len(self.splits) - held)]]
        yield from self._closed([(s, True) for s in gone])
        if gone:
            starts = pa.Table.from_batches([s.start for s in gone]).combine_chunks().to_batches()[0]
            yield self._batch(starts, kind="split", **{c: [getattr(s, c) for s in gone] for c in ("first", "end", "n_lines", "n_headers", "n_lead", "n_bytes")})


def fold_splits(lines: DataFrame, keys: tuple[str, ...] = KEYS, chunk: str = "chunk", pos: str = "pos", value: str = "value", wanted: Column | None = None, max_continuation_lines: int | None = None) -> DataFrame:
    """Rows of four kinds: event (``last`` of its split or not), lead (lines before a split's first header) and split (its counts).

    ``wanted`` is a test of headers: other events are dropped, and their lines counted. Of an event in one split,
    ``max_continuation_lines`` are kept after its header.
    """
    special = {*keys, chunk, pos, value, "is_header", "message", "n_bytes"}
    extra = [c for c in lines.columns if c not in special]
    size = F.col("n_bytes") if "n_bytes" in lines.columns else F.octet_length(value) + 1
    text = F.coalesce(F.when(F.col("is_header"), F.col("message")).otherwise(F.col(value)), F.lit(""))
    passes = F.coalesce(F.lit(True) if wanted is None else wanted, F.lit(False))
    rows = lines.select(*keys, *extra, F.coalesce("is_header", F.lit(False)).alias("is_header"), F.col(chunk).cast("bigint").alias("chunk"), F.col(pos).cast("bigint").alias("_pos"), text.alias("_text"), passes.alias("_wanted"), F.coalesce(size, F.lit(0)).cast("bigint").alias("_bytes"))
    schema = StructType([*(rows.schema[c] for c in (*keys, *extra)), *StructType.fromDDL(_OWN)])
    named = [*keys, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fold = _Fold(to_arrow_schema(schema), named, max_continuation_lines)
        for b in batches:
            if b.num_rows:
                yield from fold.add(b, list(keys))
        yield from fold.let_go()

    return rows.mapInArrow(run, schema)


@dataclass
class Stitched:
    """What a fold gives: ``events`` with line_no, event_seq and n_lines, ``rejected`` lines (line_no, value), and ``splits`` with their counts."""

    events: DataFrame
    rejected: DataFrame
    splits: DataFrame
    path: str | None = None

    def release(self) -> None:
        """Delete the staged rows; the tables can't be read any more."""
        if self.path:
            remove(self.events.sparkSession, self.path)


def finish(folded: DataFrame, keys: tuple[str, ...] = KEYS, max_continuation_lines: int | None = None, splits: int | None = None, plain: bool = False) -> Stitched:
    """Number the lines of each file through its splits, and append leading lines to the event that was open before them.

    ``splits`` is their number where it is known: up to `MOST_SPLITS`, their counts are broadcast. ``plain`` says that
    each file has one split, so that nothing is to be added up or appended.
    """
    own = [c.split()[0] for c in _OWN.split(", ")]
    extra = [c for c in folded.columns if c not in own and c not in keys]
    counts = folded.where("kind = 'split'").select(*keys, "chunk", "first", "end", "n_lines", "n_headers", "n_lead", "n_bytes")
    if plain:
        placed = folded.where("kind <> 'split'").withColumns({"_line": F.lit(0), "_seq": F.lit(0)})
    else:
        by = Window.partitionBy(*keys).orderBy("chunk", "first")  # a row for each split of a file
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        overlap = (F.lag("chunk").over(by) == F.col("chunk")) & (F.lag("end").over(by) >= F.col("first"))
        base = counts.select(
            *keys, "chunk", "first",
            F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("_line"),
            F.coalesce(F.sum("n_headers").over(before), F.lit(0)).alias("_seq"),
            F.last(F.when(F.col("n_headers") > 0, F.struct("chunk", "first")), ignorenulls=True).over(before).alias("_owner"),
            F.when(overlap, F.raise_error(F.lit("parts of a split overlap: its lines aren't in order"))).alias("_order"),
        )
        base = F.broadcast(base) if splits is not None and splits <= MOST_SPLITS else base
        placed = folded.where("kind <> 'split'").join(base, [*keys, "chunk", "first"]).where("_order IS NULL")
    shown = [*keys, (F.col("_seq") + F.col("head")).alias("event_seq"), (F.col("_line") + F.col("row")).alias("line_no"), "n_lines", "message", *extra]
    events, lost = placed.where("kind = 'event'"), placed.where("kind = 'lead'")
    if plain:
        whole = events.select(*shown)
    else:
        leads, lost = lost.where("_owner IS NOT NULL"), lost.where("_owner IS NULL")
        tail = F.array_sort(F.collect_list(F.struct("_line", "row", "lines")))
        tails = leads.groupBy(*keys, F.col("_owner.chunk").alias("chunk"), F.col("_owner.first").alias("first")).agg(tail.alias("_tail"), F.sum("n_lines").alias("_more"))
        lines = F.flatten(F.transform("_tail", lambda x: x["lines"]))
        if max_continuation_lines is not None:
            room = F.greatest(F.lit(0), F.lit(max_continuation_lines + 1) - F.col("n_lines")).cast("int")
            lines = F.slice(lines, F.lit(1), room)
        closing = events.where("last").join(tails, [*keys, "chunk", "first"], "left")
        grown = F.when(F.col("_tail").isNotNull() & (F.size(lines) > 0), F.concat("message", F.lit("\n"), F.array_join(lines, "\n"))).otherwise(F.col("message"))
        closing = closing.withColumns({"message": grown, "n_lines": F.col("n_lines") + F.coalesce("_more", F.lit(0))})
        whole = events.where("NOT last").select(*shown).unionByName(closing.select(*shown))
    lost = lost.select(*keys, *extra, (F.col("_line") + F.col("row")).alias("_at"), F.posexplode("lines").alias("_i", "value"))
    return Stitched(whole, lost.select(*keys, *extra, (F.col("_at") + F.col("_i")).alias("line_no"), "value"), counts)


def stitch_staged(lines: DataFrame, keys: tuple[str, ...] = KEYS, chunk: str = "chunk", pos: str = "pos", value: str = "value", wanted: Column | None = None, max_continuation_lines: int | None = None) -> Stitched:
    """Fold ``lines`` in one scan, keep the rows in the staging folder, and finish from there."""
    folded, path = stage(fold_splits(lines, keys, chunk, pos, value, wanted, max_continuation_lines), "folded")
    n, most = folded.where("kind = 'split'").groupBy(*keys).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    out = finish(folded, keys, max_continuation_lines, n, most <= 1)
    out.path = path
    return out
