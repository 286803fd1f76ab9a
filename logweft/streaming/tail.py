"""A streaming source that tails growing files by byte position.

Offsets are {file: [position after the last whole line, mark of its begin, end of its backlog]}, kept in the query's
checkpoint. A file that is shorter than its position, or begins with other bytes, is read anew; the stateful operator
sees that and counts a new generation. A half-written last line waits for its line feed. New files are found at each
trigger, and a file that can't be read gives an error row while the others go on. A file that is gone gives one row
(`GONE` in place of a position), by which its state can be let go. With the option `seeds` (see `backlog`), a new query
goes on where the backlog's batch ended: its first batch has a row for each seed (`SEED`).

A batch takes `maxBytesPerFile` of a file at most (a longer line whole), so a backlog of any size comes in bounded
steps. Spark doesn't tell a reader where a restarted query stands, so with the option `checkpoint` the position is
taken from there; without it, the bound holds for files that this reader has seen. What a file held when the first
batch of a new query was planned is its backlog.

Files are opened by their path on the driver and in the tasks: the folders are mounted on all of them, as log shares
are. Paths of other stores are refused.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file_path string, file_name string, offset bigint, head string, is_backfill boolean, error string"
HEAD = 64
BLOCK = 1 << 20
MOST_BYTES = 64 << 20
#: What stands for a position in rows that aren't lines; errors have negative ones, too.
GONE, SEED = -(1 << 61), -(1 << 62)


@dataclass
class Span(InputPartition):
    path: str
    begin: int
    end: int
    head: str
    is_backfill: bool
    note: int

    def __init__(self, path: str, begin: int, end: int, head: str, is_backfill: bool, note: int = 0):
        super().__init__(path)
        self.path, self.begin, self.end, self.head, self.is_backfill, self.note = path, begin, end, head, is_backfill, note


def last_line_end(path: str, size: int, floor: int = 0) -> int:
    """The position after the last line feed at or before ``size``, looked for backwards by blocks."""
    with open(path, "rb") as f:
        at = size
        while at > floor:
            begin = max(floor, at - BLOCK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return floor


def line_end_after(path: str, at: int, size: int) -> int:
    """The position after the first line feed from ``at`` on, or ``size``."""
    with open(path, "rb") as f:
        f.seek(at)
        while at < size:
            block = f.read(min(BLOCK, size - at))
            if not block:
                break
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
    return size


def local_path(uri: str) -> str:
    path = re.sub("^file:/+", "/", uri)
    if "://" in path:
        raise ValueError(f"{uri}: only mounted folders can be tailed")
    return path


def positions(checkpoint: str | None) -> dict[str, list]:
    """The offsets that a query with this checkpoint goes on from: its last planned batch's."""
    folder = os.path.join(local_path(checkpoint), "offsets") if checkpoint else ""
    planned = [int(n) for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
    if not planned:
        return {}
    with open(os.path.join(folder, str(max(planned))), encoding="utf-8") as f:
        last = f.read().rstrip("\n").split("\n")[-1]
    return json.loads(last) if last.startswith("{") else {}


def head_of(path: str) -> str:
    """A mark of the file's first line's first bytes: files are told apart by it once they have whole lines."""
    with open(path, "rb") as f:
        first = f.readline(HEAD)
    return hashlib.md5(first).hexdigest()


def lines_between(span: Span, at: int, most: int) -> Iterator[tuple]:
    """Rows of the lines that begin in the span, from the line at ``at`` on; none is read beyond ``most``."""
    name = os.path.basename(span.path)
    with open(span.path, "rb") as f:
        f.seek(at)
        while at < span.end:
            line = f.readline(most - at)
            if not line:
                raise OSError(f"ends at {at}, before {span.end}")
            begin, at = at, at + len(line)
            text = line.decode("utf-8", "replace")
            text = text.removeprefix("\ufeff") if begin == 0 else text
            text = text.removesuffix("\n").removesuffix("\r")
            for k, piece in enumerate(text.split("\r")):
                yield piece, span.path, name, begin + k, span.head, span.is_backfill, None


def seed_of(folder: str, path: str) -> str:
    """What the backlog's batch knows of a file."""
    return pq.read_table(local_path(folder), columns=["seed"], filters=[("file_path", "==", path)]).column("seed")[0].as_py()


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # Spark hands them on in lower case
        self.directories = [local_path(d) for d in json.loads(options["directories"])]
        self.pattern = options.get("pattern", "*.log")
        self.flush = options.get("flushpartial", "false").lower() == "true"
        self.seen = positions(options.get("checkpoint"))
        known = options.get("checkpoint") is not None
        self.most = int(options.get("maxbytesperfile", MOST_BYTES if known else 0))
        self.folder, self.seeds = options.get("seeds"), {}
        if self.folder:
            table = pq.read_table(local_path(self.folder), columns=["file_path", "end", "head"])  # a row for each file, as in the offsets
            self.seeds = {path: [end, head, 0] for path, end, head in zip(*(table.column(c).to_pylist() for c in ("file_path", "end", "head")))}
        self.from_start = known  # whether a file that isn't in ``seen`` is surely read from its begin

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out, first = {}, not self.seen
        known = self.seeds if first else self.seen
        for directory in self.directories:
            for path in sorted(glob.glob(os.path.join(glob.escape(directory), self.pattern))):
                try:
                    size = os.stat(path).st_size
                    old, old_head, backlog = [*known.get(path, (0, "", 0)), 0][:3]
                    head = head_of(path)
                    if old_head != head or size < old:
                        old, backlog = 0, 0
                    end = size if self.flush else last_line_end(path, size, old)
                    if not end:
                        continue
                    if first and not self.seeds:
                        backlog = end
                    bounded = self.most and (self.from_start or old_head == head)
                    if bounded and end - old > self.most:
                        cut = last_line_end(path, old + self.most, old)
                        end = cut if cut > old else min(end, line_end_after(path, old + self.most, size))
                    if old < backlog < end:
                        end = backlog
                    out[path] = [end, head, backlog]
                except OSError:
                    if path in known:
                        out[path] = known[path]
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = [Span(path, 0, 0, head, False, GONE) for path, (_, head, *_) in start.items() if path not in end]
        spans += [] if start else [Span(path, 0, 0, head, True, SEED) for path, (_, head, _) in self.seeds.items()]
        known = start or self.seeds
        for path, (stop, head, *more) in end.items():
            begin, old_head, *rest = known.get(path, (0, head))
            backlog = (rest or [0])[0] if start else (more or [stop])[0]
            if stop < begin or head != old_head:
                begin, backlog = 0, 0
            if stop > begin:
                spans.append(Span(path, begin, stop, head, begin < backlog))
        self.seen = self.seen or end  # a batch planned before a restart is run again
        return spans

    def read(self, span: Span) -> Iterator[tuple]:
        name = os.path.basename(span.path)
        if span.note:
            yield seed_of(self.folder, span.path) if span.note == SEED else None, span.path, name, span.note, span.head, span.is_backfill, None
            return
        try:
            yield from lines_between(span, span.begin, span.end)
        except OSError as e:
            yield None, span.path, name, -1, span.head, span.is_backfill, str(e)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: directories (JSON list), pattern (glob on base names), flushPartial, maxBytesPerFile, checkpoint, seeds."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
