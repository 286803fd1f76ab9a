"""Periodic stretches of words within documents, found by a suffix automaton whose access recolours last occurrences.

A run is a stretch of words with smallest period q and a length of at least max(`LEAST`, `EXPONENT` * q) that no
neighbouring word extends. Each slice of texts is searched in two steps, all within its task:

1. Windows that hold every run (`windows`). Within a run, after its first period, each three words came q words
   before. Stretches in which every three words come again, at most a third of the stretch's length apart, are
   found for all texts of the slice at once by one sort; nothing that can be part of a run is left out.
2. A suffix automaton of each window (`runs_of`). Words are appended one by one; the suffixes of what has been read
   are a path of the tree of suffix links, and the access recolours that path with the new end. What it finds there
   are segments of one older end each: a distance d from the older end to the new one within a segment of length at
   least d is a square, and the segment's length beyond it says how far the period reaches back. So a run is seen at
   each of its ends, the last of which is the run's own; d is its smallest period because a segment has the latest end.

Since a window is known before the search, its automaton is built first, so the tree stands still and needs no link
or cut: the access goes over heavy paths, each with a stack of its coloured segments (O(log n) paths a word, and as
many segments as it removes). A window's automaton is held whole: a document's run of n words takes about 1 KB a word.

Defined cases: null and empty texts have no words and no runs, and the digests of nothing; texts of any length are
searched whole; equal rows are searched each on its own; an empty table gives no rows. Only the id and the text are
read, so other columns can't clash. Ties for the run of greatest exponent go to the smallest start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.store import field_type
from logweft.llm.text import mix64, slices, words_of

EXPONENT, LEAST, GRAM = 4, 6, 3


def windows(codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges of words, none over a text's end, that hold every run of the texts that begin at ``starts``."""
    n = len(codes)
    if n < LEAST:
        return []
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(owner[: n - GRAM + 1] == owner[GRAM - 1 :])
    key = owner[at].astype(np.uint64)
    for k in range(GRAM):
        key = mix64(key, k) + codes[at + k].astype(np.uint64)  # grams that share a key can only add windows
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    apart = np.full(n, n + 1)
    apart[at[order[again + 1]]] = at[order[again + 1]] - at[order[again]]
    some = np.flatnonzero(apart <= n)
    while len(some):
        first = np.flatnonzero(np.r_[True, some[1:] != some[:-1] + 1])
        size = np.diff(np.r_[first, len(some)])
        longest = (size + GRAM - 1) // (EXPONENT - 1)  # a run of this many such places has no longer period
        longest[size < LEAST - GRAM] = 0
        keep = apart[some] <= np.repeat(longest, size)
        if keep.all():
            begin = np.maximum(some[first] - longest, starts[owner[some[first]]])
            end = some[first] + size + GRAM - 1
            break
        some = some[keep]
    else:
        return []
    apart_from = np.flatnonzero(np.r_[True, (begin[1:] >= np.maximum.accumulate(end)[:-1]) | (owner[begin[1:]] != owner[begin[:-1]])])
    return list(zip(begin[apart_from].tolist(), np.maximum.reduceat(end, apart_from).tolist()))


def _automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and longest lengths of the states, and the state of each prefix."""
    moves: list[dict[int, int]] = [{}]
    link, length, ends, last = [-1], [0], [], 0
    for w in words:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p != -1:
            q = moves[p][w]
            if length[q] != length[p] + 1:
                copy = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = copy
                while p != -1 and moves[p].get(w) == q:
                    moves[p][w] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
        ends.append(new)
    return link, length, ends


def _heavy_paths(link: list[int], length: list[int]) -> tuple[list[int], list[int], list[int]]:
    """By state its path and its place on it, and by path the state above its top (-1: none)."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size, heavy = [1] * len(link), [-1] * len(link)
    for v in reversed(order[1:]):  # a state is longer than the one it links to
        size[link[v]] += size[v]
    most = [0] * len(link)
    for v in order[1:]:
        if size[v] > most[link[v]]:
            most[link[v]], heavy[link[v]] = size[v], v
    path, place, above = [0] * len(link), [0] * len(link), [-1]
    for v in order[1:]:
        u = link[v]
        if heavy[u] == v:
            path[v], place[v] = path[u], place[u] + 1
        else:
            path[v] = len(above)
            above.append(u)
    return path, place, above


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period."""
    link, length, ends = _automaton(words)
    path, place, above = _heavy_paths(link, length)
    coloured: list[list[tuple[int, int, int]]] = [[] for _ in above]  # (last place, end, length there), the topmost last
    found: dict[tuple[int, int], int] = {}
    for end, v in enumerate(ends):
        below = -1  # the end of the segment last seen, further down
        while v > 0:
            own, i = coloured[path[v]], place[v]
            top = last = -1  # the end of this path's topmost segment, and the last place that was recoloured
            while own and own[-1][0] <= i:
                last, old, reach = own.pop()
                if top < 0:
                    top = old
                if old != below:  # else it goes on from further down, where it is longer
                    _note(found, end, end - old, reach)
            if own and last < i:
                old = own[-1][1]
                if old != below:
                    _note(found, end, end - old, length[v])
                if top < 0:
                    top = old
            if top >= 0:
                below = top
            own.append((i, end, length[v]))
            v = above[path[v]]
    return sorted((start, end - start + 1, period) for (start, period), end in found.items())


def _note(found: dict[tuple[int, int], int], end: int, period: int, reach: int) -> None:
    if reach >= (EXPONENT - 1) * period and reach + period >= LEAST:
        found[(end - reach - period + 1, period)] = end


def looped_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a text of n words begins to repeat, and its period, for the tenth of the documents that are given such a tail."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def search(texts: pa.Array, ids: list, looped: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs of each text, and each text's words without what a run repeats, joined by one space."""
    words = words_of(texts)
    codes, distinct = words.encode()
    codes = codes.astype(np.int64)
    starts = words.starts
    if looped:
        for k, (doc_id, n) in enumerate(zip(ids, words.counts.tolist())):
            if tail := looped(doc_id, n):
                a, p = int(starts[k]) + tail[0], tail[1]
                codes[a : starts[k + 1]] = np.resize(codes[a : a + p], int(starts[k + 1]) - a)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    dropped = np.zeros(len(codes) + 1, np.int64)
    for begin, end in windows(codes, starts):
        k = int(np.searchsorted(starts, begin, "right")) - 1
        for start, length, period in runs_of(np.unique(codes[begin:end], return_inverse=True)[1].tolist()):
            runs[k].append((begin - int(starts[k]) + start, length, period))
            dropped[begin + start + period] += 1
            dropped[begin + start + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    left = pa.ListArray.from_arrays(pa.array(before[starts].astype(np.int32)), distinct.take(pa.array(codes[kept])).cast(pa.string()))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in runs], [x.encode() for x in pc.binary_join(left, " ").to_pylist()]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", looped: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period) and collapsed (the text without repeated periods) of every document.

    ``looped`` gives texts a repeating tail before the search (see `looped_tail`).
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            runs, collapsed = search(b.column("text"), b.column("doc_id").to_pylist(), looped)
            listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), listed, pa.array([x.decode() for x in collapsed], pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {field_type(docs, doc_id)}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def run_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", looped: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """By document its number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text, so that neither leaves the task."""
    fields = ("start", "length", "period", "exponent_milli")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            runs, collapsed = search(b.column("text"), b.column("doc_id").to_pylist(), looped)
            best = [(*r, 1000 * r[1] // r[2]) if (r := _strongest(x)) else (None,) * 4 for x in runs]
            listed = ["".join(f"{s},{n},{p}\n" for s, n, p in x).encode() for x in runs]
            columns = [b.column("doc_id"), pa.array([len(x) for x in runs], pa.int64()), *(pa.array([x[i] for x in best], pa.int64()) for i in range(4))]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (listed, collapsed)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_runs", *fields, "runs_sha256", "collapsed_sha256"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {field_type(docs, doc_id)}, n_runs bigint, " + ", ".join(f"{f} bigint" for f in fields) + ", runs_sha256 string, collapsed_sha256 string")
