"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

The distinct marked words of a slice of texts are sorted, so that they are the paths of a trie in depth-first
order. The search keeps the state of each prefix of the current word: the best score that ends there, its last
piece, and the vocabulary nodes still open. The next word pops back to the common prefix and goes on from there, so
the forward scores of a prefix are worked out once for all words that share it. See `pieces` for scores, ties and
the cut into words. Ids of words stay in a cache from slice to slice that is bounded in bytes; a word takes 12 bytes
of state a character while it is searched.

Defined cases: null and empty texts have no ids and decode to an empty text; a text of any length is searched
whole, word by word; decoding gives back every text, with unknown characters through byte pieces; ids that aren't
pieces decode to nothing, and broken UTF-8 to U+FFFD. Rows are encoded each on its own, repeated ones alike; an
empty table gives no rows. `encode` keeps the other columns and takes a name for its own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.pieces import MARK, Vocabulary, load_vocabulary, marked_words, vocabulary_path
from logweft.llm.store import field_type
from logweft.llm.text import flat, slices

#: The cache of words is dropped after a slice that leaves it with more than so many bytes, a word counted as its length and `WORD_COST`.
CACHE_BYTES, WORD_COST = 40 << 20, 180
OPEN_DEPTH = 256  # open nodes are kept for so many characters of a word; deeper ones are walked again where two words part
CODE_SLICE = 2 << 20


class PrefixViterbi:
    """Best segmentations of words that come in sorted order."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.root = vocabulary, {}
        self.sizes = np.ones(len(vocabulary.surfaces), np.int32).tolist()
        for piece, value in vocabulary.pieces.items():
            self.sizes[value[0]] = len(piece)
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = value
        self.longest = max(map(len, vocabulary.pieces), default=1)
        self.last = ""
        # By prefix length: the best score and the id of its last piece (-1: an unknown character).
        self.score, self.piece = array("d", [0.0]), array("i", [-1])
        # By prefix length, up to `OPEN_DEPTH`: the open nodes by ascending start.
        self.open: list[list] = [[]]

    def _opened(self, word: str, i: int) -> list:
        """The open nodes after the first ``i`` characters, walked again where they weren't kept."""
        if i < len(self.open):
            return self.open[i]
        out = []
        for start in range(max(0, i - self.longest), i):
            node = self.root
            for c in word[start:i]:
                node = node.get(c)
                if node is None:
                    break
            else:
                out.append((start, self.score[start], node))
        return out

    def _extend(self, word: str, begin: int) -> None:
        """The states of all prefixes longer than ``begin``."""
        root, single, unknown, scores, pieces, kept = self.root, self.vocabulary.single, self.vocabulary.unknown_score, self.score, self.piece, self.open
        opened = self._opened(word, begin)
        for i in range(begin, len(word)):
            c, score = word[i], scores[i]
            best, piece, still = None, -1, []
            for start, base, node in [*opened, (i, score, root)]:
                node = node.get(c)
                if node is not None:
                    still.append((start, base, node))
                    value = node.get("")
                    if value is not None and (best is None or base + value[1] > best):
                        best, piece = base + value[1], value[0]
            if c not in single and (best is None or score + unknown > best):
                best, piece = score + unknown, -1
            scores.append(best)
            pieces.append(piece)
            if i + 1 < OPEN_DEPTH:
                kept.append(still)
            opened = still

    def forget(self) -> None:
        """Drop the states of the last word."""
        self.last = ""
        del self.score[1:], self.piece[1:], self.open[1:]

    def encode(self, word: str) -> array:
        """The ids of a word with marks; fastest after a word with a long common prefix."""
        same, end, last = 0, min(len(word), len(self.last)), self.last
        while same < end and word[same] == last[same]:
            same += 1
        del self.score[same + 1 :], self.piece[same + 1 :], self.open[same + 1 :]
        self._extend(word, same)
        self.last, out, end = word, array("i"), len(word)
        while end:
            piece = self.piece[end]
            if piece >= 0:
                out.append(piece)
                end -= self.sizes[piece]
            else:
                end -= 1
                out.extend(self.vocabulary.byte_ids[b] for b in reversed(word[end].encode()))
        out.reverse()
        return out


class Codec:
    def __init__(self, path: str):
        self.vocabulary = load_vocabulary(path)
        self.search = PrefixViterbi(self.vocabulary)
        sizes = np.array([len(s) for s in self.vocabulary.surfaces], np.int64)
        self.surface_size, self.surface_at = sizes, np.cumsum(sizes) - sizes
        self.surface = np.frombuffer(b"".join(self.vocabulary.surfaces), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.cost = 0

    def _add(self, new: list[str]) -> None:
        new.sort()
        ids, ends = array("i"), np.zeros(len(new), np.int64)
        for k, w in enumerate(new):
            ids.extend(self.search.encode(w.replace(" ", MARK)))
            ends[k] = len(ids)
        self.search.forget()
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.ends = np.concatenate([self.ends, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.int32)])
        self.cost += sum(map(len, new)) + WORD_COST * len(new)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin and end."""
        words = marked_words(texts, self.vocabulary.joined)
        codes, distinct = words.encode()
        distinct = distinct.to_pylist()
        if new := [w for w in distinct if w not in self.at]:
            self._add(new)
        place = np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))
        out = _gather(self.ids, np.append(0, self.ends), place[codes] if len(codes) else place, words.starts)
        if self.cost > CACHE_BYTES:
            self.clear()
        return out

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes end to end, and where each begins and ends; the space put before each text is taken off."""
        known = (ids >= 0) & (ids < len(self.surface_size))
        chars, ends = _gather(self.surface, np.append(self.surface_at, len(self.surface)), np.where(known, ids, 0), at)
        lead = ends[:-1][np.diff(ends) > 0]
        lead = lead[chars[lead] == 32]
        return np.delete(chars, lead), ends - np.searchsorted(lead, ends)


def _gather(values: np.ndarray, bounds: np.ndarray, place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[bounds[p]:bounds[p + 1]]`` for each p in ``place`` end to end, and the offsets of groups of them."""
    begin, size = bounds[:-1], np.diff(bounds)
    n = size[place]
    ends = np.append(0, np.cumsum(n))
    if not ends[-1]:
        return values[:0], ends[starts]
    some = np.flatnonzero(n)
    steps = np.ones(ends[-1], np.int32 if len(values) < 1 << 31 else np.int64)
    steps[ends[some]] = np.diff(begin[place[some]], prepend=0) - np.append(0, n[some][:-1] - 1)
    return values[np.cumsum(steps, dtype=steps.dtype, out=steps)], ends[starts]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each Python worker, kept from task to task."""
    return Codec(path)


def decodes_back(own: Codec, ids: np.ndarray, at: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text's ids decode to it, and the number of bytes they decode to."""
    back, ends = own.decode(ids, at)
    data, was = flat(texts)
    same = np.diff(ends) == np.diff(was)
    if same.all():
        wrong = np.searchsorted(np.flatnonzero(back != data), was)
        return wrong[1:] == wrong[:-1], np.diff(ends)
    return np.array([back[i:j].tobytes() == data[k:m].tobytes() for i, j, k, m in zip(ends, ends[1:], was, was[1:])], bool), np.diff(ends)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "piece_ids", check: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all) of ``docs`` and the ids of the whole text as array<int> in ``out``; with ``check``, in that column whether they decode to the text.

    Columns of these names are replaced. Only the columns kept and the text go to the tasks' Python.
    """
    path, kept = path or vocabulary_path(), [c for c in (docs.columns if keep is None else keep) if c not in (out, check)]
    docs = docs.select([F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, CODE_SLICE):
            ids, at = codec(path).encode(b.column(text))
            made = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
            if check:
                made.append(pa.array(decodes_back(codec(path), ids, at, b.column(text))[0], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], [*kept, out] + [check] * bool(check))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + [f"`{out}` array<int>"] + [f"`{check}` boolean"] * bool(check)
    return docs.mapInArrow(run, ", ".join(fields))


def _decoded(path: str, lists: pa.Array) -> pa.Array:
    at = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int32)
    chars, ends = codec(path).decode(ids, at - at[0])
    raw = chars.tobytes()
    return pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(ends.tolist(), ends[1:].tolist())], pa.string())


def decode(rows: DataFrame, path: str | None = None, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of the ids in ``out`` (in place of a column of that name); null ids decode to an empty text."""
    path, kept = path or vocabulary_path(), [c for c in rows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(ids)
            lists = lists if not lists.null_count else pa.array([x or [] for x in lists.to_pylist()], lists.type)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), _decoded(path, lists)], [*kept, out])

    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept] + [f"`{out}` string"]))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and decode every text: doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit), n_bytes (decoded), same (decoded equals the text)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=CODE_SLICE):
            own = codec(path)
            ids, at = own.encode(b.column("text"))
            same, n_bytes = decodes_back(own, ids, at, b.column("text"))
            raw, cut = memoryview(ids.astype("<u4")).cast("B"), (at * 4).tolist()
            crc = pa.array([zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), crc, pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "same"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {field_type(docs, doc_id)}, n_pieces bigint, ids_crc32 bigint, n_bytes bigint, same boolean")
