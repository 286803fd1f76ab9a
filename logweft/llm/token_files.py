"""Token ids in Arrow files of equal-length sequences, and reading them back without copies.

Documents are range-sorted by doc_id (and the hash of the text) and tokenized in the tasks; each task writes one Arrow IPC file whose record
batches hold two fixed-size-list columns: ``tokens`` (uint16 or uint32) and ``mask`` (false on the padding after a
file's last token). The files in order are one stream of ids. A sequence or any span of ids is found by arithmetic
alone, so a memory-mapped file gives random access without copying. A file is written under a name of its own and
renamed when whole, so a repeated or speculative task leaves a whole file.

The tokenizer treats pre-tokens apart and drops white space, so each distinct piece (see `pre_units`) is encoded once
with the tokenizers library and its ids are reused; the ids are those of encoding the whole text.

Defined cases: a null text counts as empty and has the end id alone; rows that share a doc_id follow each other,
ordered by the hash of the text; a null doc_id comes first; a document of any length runs on over sequences; an empty table writes
no file and gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.llm.store import broadcast_if_small, field_type, fresh_path, materialize
from logweft.llm.text import flat, slices, split_words

SEQUENCE = 1024
BATCH_SEQUENCES = 256
END_ID = 1
CACHED_UNITS = 600_000
_KIND = np.zeros(256, np.uint8)  # 1: ASCII letter or digit; 2: ASCII punctuation but the apostrophe
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2


def pre_units(texts: pa.Array):
    """Pieces of the texts that the tokenizer surely treats apart, so that few distinct ones remain.

    Its pre-tokens never hold white space and never mix letters or digits with other characters, but for the
    apostrophe's; it lower-cases everything. Only its special tokens, which begin with ``<|``, break these rules: a
    slice in which that occurs is cut at white space alone.
    """
    data, at = flat(texts)
    if len(data) > 1 and ((data[:-1] == 60) & (data[1:] == 124)).any():
        return split_words(data, at)
    data, at = flat(texts, lower=True)
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = kind[1:] + kind[:-1] == 3
    return split_words(data, at, cut)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of texts; each distinct piece is encoded once while it stays in a bounded cache."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab_size(True) - 1, end_id) < 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.begin, self.size = [np.array([self.end_id], self.dtype)], [np.zeros(1, np.int64)], [np.ones(1, np.int64)]
        self.total = 1

    def _add(self, new: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.at.update(zip(new, range(len(self.at) + 1, len(self.at) + 1 + len(new))))
        self.ids.append(np.fromiter((i for e in encoded for i in e), self.dtype, int(size.sum())))
        self.begin.append(self.total + np.cumsum(size) - size)
        self.size.append(size)
        self.total += int(size.sum())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with the end id, and the number of ids of each text."""
        words = pre_units(texts)
        codes, distinct = words.encode()
        distinct = distinct.to_pylist()
        if len(self.at) + len(distinct) > CACHED_UNITS:
            self.clear()
        if new := [w for w in distinct if w not in self.at]:
            self._add(new)
        for name in ("ids", "begin", "size"):
            setattr(self, name, [np.concatenate(getattr(self, name))])
        ids, begin, size = self.ids[0], self.begin[0], self.size[0]
        place = np.fromiter(map(self.at.__getitem__, distinct), np.int32, len(distinct))
        place = np.insert(place[codes] if len(codes) else np.zeros(0, np.int32), words.starts[1:], 0)
        n = size[place]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        steps = np.ones(total, np.int32)  # through ids: on by one, and to the next piece where one ends
        if total:
            some = np.flatnonzero(n)
            first, heads = begin[place[some]], ends[some] - n[some]
            steps[heads] = np.diff(first, prepend=0) - np.append(0, n[some][:-1] - 1)
        out = ids[np.cumsum(steps, dtype=np.int32)]
        per = np.diff(np.append(0, ends[words.starts[1:] + np.arange(len(texts))]))
        return out, per


@functools.lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> PieceEncoder:
    """One for each Python worker, kept from task to task."""
    return PieceEncoder(path, end_id)


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Cuts a stream of ids into equal-length sequences and writes them as record batches."""

    def __init__(self, uri: str, dtype: type, length: int = SEQUENCE):
        self.fs, self.path = open_store(uri)
        self.own, self.length, self.n = f"{self.path}.{uuid.uuid4().hex}", length, 0
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.own)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.pending: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        self.n += len(ids)
        step = self.length * BATCH_SEQUENCES
        if self.waiting >= step:
            ids = np.concatenate(self.pending)
            whole = len(ids) // step * step
            for i in range(0, whole, step):
                self._write(ids[i : i + step])
            self.pending, self.waiting = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        full = np.zeros(rows * self.length, ids.dtype)
        full[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, np.arange(len(full)) < len(ids))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(np.concatenate(self.pending))
        self.writer.close()
        self.sink.close()
        self.fs.move(self.own, self.path)


class SequenceReader:
    """Random access to a file of sequences; arrays are views of the mapped file wherever a span lies in one record batch."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.step = self.length * BATCH_SEQUENCES

    def _values(self, batch: int, column: str) -> pa.Array:
        found = self.file.get_batch(batch).column(column)
        return found.values.slice(found.offset * self.length, len(found) * self.length)

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """The ids and the mask of sequence ``i``."""
        batch, row = divmod(i, BATCH_SEQUENCES)
        return tuple(self._values(batch, c).slice(row * self.length, self.length) for c in ("tokens", "mask"))

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the file's id ``start`` on."""
        out = []
        while n > 0:
            batch, at = divmod(start, self.step)
            got = self._values(batch, "tokens").slice(at, n).to_numpy()
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


@dataclass
class TokenFiles:
    """Where the files are, and ``spans``: doc_id, part (the file's number), at (first id in the file), n_tokens, start (ids of all documents before)."""

    folder: str
    spans: DataFrame

    def read(self, then) -> DataFrame:
        """``then(reader, at, n)`` of every document, with the files opened in the tasks: doc_id, start, n_tokens, value."""
        folder = self.folder

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: tuple[int | None, SequenceReader | None] = (None, None)
            for b in batches:
                found = []
                for part, at, n in zip(*(b.column(c).to_pylist() for c in ("part", "at", "n_tokens"))):
                    if opened[0] != part:
                        opened = part, SequenceReader(part_uri(folder, part))
                    found.append(then(opened[1], at, n))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(found, pa.int64())], ["doc_id", "start", "n_tokens", "value"])

        return self.spans.mapInArrow(look, f"doc_id {field_type(self.spans, 'doc_id')}, start bigint, n_tokens bigint, value bigint")


def part_uri(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.arrow"


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, length: int = SEQUENCE, text: str = "text", doc_id: str = "doc_id") -> TokenFiles:
    """Encode the texts and write the files in ascending doc_id order, by default to a new folder in the shared store.

    Rows of one doc_id, or without one, come in the order of their texts' hashes, and rows whose texts are equal, too, as
    they are read: their bytes are the same in any order, and so many of them spread over tasks and files.
    """
    folder, tokenizer = folder or fresh_path(docs.sparkSession, "tokens"), tokenizer or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, encoder = TaskContext.get().partitionId(), None, _encoder(tokenizer, end_id)
        for b in slices(batches, limit=8 << 20):
            if out is None:
                fs, path = open_store(folder)
                fs.create_dir(path, recursive=True)
                out = SequenceWriter(part_uri(folder, part), encoder.dtype, length)
            ids, n = encoder.encode(b.column("text"))
            at = out.n + np.cumsum(n) - n
            out.add(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at), pa.array(n)], ["doc_id", "part", "at", "n_tokens"])
        if out is not None:
            out.close()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("nth"))
    order = ["doc_id", "hash", "nth"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    spans = materialize(rows.mapInArrow(write, f"doc_id {field_type(docs, doc_id)}, part int, at bigint, n_tokens bigint"), "spans")
    parts = spans.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    parts = materialize(parts, "parts")  # a row for each file
    spans = spans.join(broadcast_if_small(parts, parts.count()), spans["part"] == parts["p"]).select("doc_id", "part", "at", "n_tokens", (F.col("base") + F.col("at")).alias("start"))
    return TokenFiles(folder, spans)


def ids_crc32(reader: SequenceReader, at: int, n: int) -> int:
    return zlib.crc32(reader.ids(at, n).astype("<u4").tobytes())
