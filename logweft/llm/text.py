"""Vectorised text kernels over Arrow string arrays, used inside tasks.

White space is ``[\\x20\\x09-\\x0D]`` and a word is a run of anything else. All of these are single bytes in
UTF-8, so words are found on the raw buffers without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 2 << 20


def flat(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return (LOWER[data] if lower else data), at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text (one row at least), which bounds a task's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Words of some texts. Text ``i`` has the words ``starts[i]:starts[i + 1]``."""

    starts: np.ndarray
    begin: np.ndarray  # byte offset of each word in the flat texts
    offsets: np.ndarray  # of each word in chars
    chars: np.ndarray  # the words' bytes end to end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def array(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(self.offsets) - 1, pa.py_buffer(self.offsets), pa.py_buffer(self.chars))

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """Each word as a number, and the distinct words by number."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def split_words(data: np.ndarray, at: np.ndarray, cut: np.ndarray | None = None, white: np.ndarray = SPACE) -> Words:
    """``cut`` marks bytes before which a word also ends; ``white`` tells the bytes between words."""
    space = white[data]
    word = ~space
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = space
    edge[at[at < len(data)]] = True
    if cut is not None:
        edge[:-1] |= cut
    begin = np.flatnonzero(word & edge[:-1])
    edge = np.ones(len(data) + 1, bool)
    edge[:-1] = space
    edge[at] = True
    if cut is not None:
        edge[:-1] |= cut
    end = np.flatnonzero(word & edge[1:]) + 1
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    return Words(np.searchsorted(begin, at), begin, offsets, data[word])


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    return split_words(*flat(texts, lower))


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges that the offsets ``at`` mark (0 for empty ranges)."""
    if values.dtype.kind == "f":  # each range summed by itself, so that nothing is lost by differences
        out, some = np.zeros(len(at) - 1), np.flatnonzero(np.diff(at))
        if len(some):
            out[some] = np.add.reduceat(values[: at[-1]], at[some])
        return out
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True for the first byte of each code point."""
    return (data & 0xC0) != 0x80


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed 64-bit mixing of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
