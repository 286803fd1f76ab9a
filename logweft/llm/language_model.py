"""Scoring texts by a gated recurrent language model with a class-factored softmax.

1. Texts are split and words hashed once and written as numbers by slice. Every training token is counted over the
   whole corpus, by the word's 64-bit fingerprint. Words with at least
   1 / `HEAD` of all tokens (so at most `HEAD` of them) go to the tasks; the others, none of which is frequent, are
   joined by a shuffle when scoring.
2. The most frequent `TOP` words are units of their own, the others fall into `ENDINGS` units by their ending. Every
   text is written once as its units, two bytes a token, for all later steps. Counts of neighbouring units over all
   training texts put the units into classes.
3. A network (see `gated_network`) is trained on all training texts, each token once in every epoch: a round takes a
   part of the corpus, its texts dealt at random over shards; every shard trains from the same weights by truncated
   backpropagation and the weights are averaged by tokens. A shard has about `SHARD_TOKENS`, so shards grow in number
   with the data.
4. Every text is scored whole, the state carried from window to window:
   P(word) = P(class | state) P(slot | class, state) P(word | slot), where a slot is a top word or the class's
   rest, and within the rest words have their counts plus 0.1, unknown words together 0.1.

Defined cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+`` and each text has an end token; a null text
counts as empty and has the end alone; texts of any length are scored whole; repeated rows score alike; without
training texts the base is that of N = V = 0; an empty table gives no rows. Only doc_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.llm.gated_network import RATE, SCORE_LANES, WINDOW, Network, lay_out
from logweft.llm.store import discard, field_type, materialize
from logweft.llm.text import Words, per_text, slices, words_of

HEAD = 1 << 18
TOP, ENDINGS, NEIGHBOURS = 2048, 2048, 128
CLASSES = 64
ROUNDS, EPOCHS = 4, 1
SHARD_TOKENS = 1_500_000
PIECE = 1024
LEAST_UPDATES, TRAIN_LANES = 128, (8, 512)
FAN = 32
SMOOTH = 0.1
END_HASH = np.uint64(0x1F3D5B79A2C4E681)
CODE_SLICE, SCORE_TOKENS = 2 << 20, 3 << 20


def coded_words(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as codes, and the fingerprint and ending unit of each distinct word."""
    words = words_of(texts, lower=True)
    codes, distinct = words.encode()
    listed = distinct.to_pylist()
    if not listed:
        return words, codes, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = pd.util.hash_array(np.array(listed, object), categorize=False)
    endings = pd.util.hash_array(np.array([w.rstrip(".,;:!?")[-3:] for w in listed], object), categorize=False)
    return words, codes, hashed, (endings % np.uint64(ENDINGS)).astype(np.int64)


def with_end(words: Words | Slice, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values by word with the end token's after each text, and where each text's tokens end."""
    return np.insert(values, words.starts[1:], end), words.starts[1:] + np.arange(1, len(words.starts))


@dataclass
class Slice:
    """The words of some documents by number, with the fingerprint and ending unit of each number."""

    doc_id: pa.Array
    train: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    hashed: np.ndarray
    ending: np.ndarray

    @classmethod
    def of(cls, row: pa.RecordBatch) -> Slice:
        blob = lambda c: row.column(c)[0].as_py()
        n = np.frombuffer(blob("n_words"), "<i4")
        hashed = np.frombuffer(blob("hashed"), "<u8")
        codes = np.frombuffer(blob("codes"), "<u2" if len(hashed) <= 1 << 16 else "<i4")
        return cls(row.column("doc_id")[0].values, np.frombuffer(blob("train"), bool), np.append(0, np.cumsum(n, dtype=np.int64)), codes, hashed, np.frombuffer(blob("ending"), "<i2").astype(np.int64))


def number_words(docs: DataFrame) -> DataFrame:
    """A row for each slice of documents, so that texts are split and words hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=CODE_SLICE):
            words, codes, hashed, ending = coded_words(b.column("text"))
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id"))
            blobs = (b.column("train").to_numpy(zero_copy_only=False).tobytes(), words.counts.astype("<i4").tobytes(), np.asarray(codes).astype("<u2" if len(hashed) <= 1 << 16 else "<i4").tobytes(), np.asarray(hashed).astype("<u8").tobytes(), ending.astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in blobs)], ["doc_id", "train", "n_words", "codes", "hashed", "ending"])

    return docs.select("doc_id", "text", training_mark().alias("train")).mapInArrow(run, f"doc_id array<{field_type(docs, 'doc_id')}>, train binary, n_words binary, codes binary, hashed binary, ending binary")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for b in batches:
        for i in range(b.num_rows):  # each of about `CODE_SLICE` bytes of text
            yield Slice.of(b.slice(i, 1))


def count_tokens(numbered: DataFrame) -> DataFrame:
    """word (fingerprint), ending and n of every distinct word of the training documents, the end token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _numbered(batches):
            mine = s.codes if s.train.all() else s.codes[np.repeat(s.train, np.diff(s.starts))]
            n = np.bincount(mine, minlength=len(s.hashed)) if len(s.hashed) else np.zeros(0, np.int64)
            known = np.flatnonzero(n)
            rows = np.append(s.hashed[known], END_HASH), np.append(s.ending[known], 0).astype(np.int32), np.append(n[known], s.train.sum()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1]), pa.array(rows[2])], ["word", "ending", "n"])

    return numbered.mapInArrow(run, "word bigint, ending int, n bigint").where("n > 0").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Head words sorted by fingerprint, with their counts and units; the end token is unit 0."""

    hashed: np.ndarray
    count: np.ndarray
    unit: np.ndarray  # of top words, else -1
    tokens: int
    distinct: int

    @classmethod
    def gather(cls, counts: DataFrame) -> Lexicon:
        tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        head = counts.where(F.col("n") * HEAD >= tokens).select("word", "n").toPandas()  # at most HEAD rows
        head["word"] = head["word"].to_numpy(np.int64).view(np.uint64)
        head = head.sort_values("word", ignore_index=True)
        hashed, count = head["word"].to_numpy(np.uint64), head["n"].to_numpy(np.int64)
        order = np.lexsort((hashed, -count, hashed != END_HASH))
        unit = np.full(len(hashed), -1, np.int64)
        unit[order[:TOP]] = np.arange(min(TOP, len(order)))
        return cls(hashed, count, unit, int(tokens), int(distinct))

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not a head word) and top unit (or -1) of fingerprints."""
        if not len(self.hashed):
            return np.full(len(hashed), -1), np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        known = self.hashed[at] == hashed
        return np.where(known, self.count[at], -1), np.where(known, self.unit[at], -1)

    def units(self, hashed: np.ndarray, ending: np.ndarray) -> np.ndarray:
        top = self.find(hashed)[1]
        return np.where(top >= 0, top, TOP + ending)


def code_texts(numbered: DataFrame, lexicon: Lexicon) -> DataFrame:
    """By document: row (a number of its own), doc_id, n_tokens, n_known and head_log (sums that know the head words alone), rest_log (those of head words that aren't top words), tail (the other words' fingerprints) and units (all tokens, two bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        end_count = int(lexicon.find(np.array([END_HASH]))[0][0])
        end_log = math.log10(max(end_count, 0) + SMOOTH)
        for s in _numbered(batches):
            codes, hashed, ending = s.codes, s.hashed, s.ending
            count, top = lexicon.find(hashed)
            logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + SMOOTH), 0.0)
            pick = lambda by_word: by_word[codes] if len(codes) else by_word[:0]
            total = lambda by_word: per_text(pick(by_word), s.starts)
            units, ends = with_end(s, pick(np.where(top >= 0, top, TOP + ending).astype("<u2")), 0)
            at = np.append(0, ends)
            is_tail = pick(count < 0)
            tails = np.append(0, np.cumsum(is_tail))[s.starts]
            tail = pa.ListArray.from_arrays(pa.array(tails, pa.int32()), pa.array(pick(hashed)[is_tail].view(np.int64)))
            raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at * 2), pa.py_buffer(units.tobytes())]).cast(pa.binary())
            rows = np.arange(row, row + len(s.doc_id))
            row += len(s.doc_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), s.doc_id, pa.array(np.diff(at)), pa.array(total(count > 0) + int(end_count > 0)), pa.array(total(logs) + end_log), pa.array(total(np.where(top < 0, logs, 0.0))), tail, raw],
                ["row", "doc_id", "n_tokens", "n_known", "head_log", "rest_log", "tail", "units"],
            )

    kind = numbered.schema["doc_id"].dataType.elementType.simpleString()
    return numbered.mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, head_log double, rest_log double, tail array<bigint>, units binary")


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The units of all texts end to end, and where each text's end."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<u2")[at[0] // 2 : at[-1] // 2], (at[1:] - at[0]) // 2


def _token_slices(batches: Iterator[pa.RecordBatch], limit: int = SCORE_TOKENS) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``limit`` tokens (one text at least)."""
    return slices(batches, "units", 2 * limit)


def count_neighbours(units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """units x NEIGHBOURS: how often each unit has each of the most frequent ones within three tokens."""
    total = np.zeros((TOP + ENDINGS) * NEIGHBOURS, np.int64)
    text = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(np.append(0, ends)))
    often = np.flatnonzero(units < NEIGHBOURS)
    for k in (-3, -2, -1, 1, 2, 3):
        other = often + k
        near = (other >= 0) & (other < len(units))
        own, other = often[near], other[near]
        near = text[own] == text[other]
        total += np.bincount(units[other[near]].astype(np.int32) * NEIGHBOURS + units[own[near]], minlength=len(total))
    return total.reshape(-1, NEIGHBOURS)


def neighbour_counts(coded: DataFrame) -> np.ndarray:
    """`count_neighbours` over all the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TOP + ENDINGS) * NEIGHBOURS, np.int64)
        for b in _token_slices(batches):
            total += count_neighbours(*_units(b.column("units"))).ravel()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    cells = coded.select("units").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most one row for each cell
    out = np.zeros((TOP + ENDINGS) * NEIGHBOURS)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return out.reshape(-1, NEIGHBOURS)


def cluster(near: np.ndarray, weight: np.ndarray, classes: int = CLASSES, steps: int = 12) -> np.ndarray:
    """A class for each unit: the end token has class 0, the others are clustered by the direction of their neighbours.

    Half of the classes come from the clustering. Each of the others splits the class whose slots cost most, its tokens
    times its top words, at the median of its main direction.
    """
    rows = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    first = classes // 2
    centre = rows[np.argsort(-weight, kind="stable")[1:first]].copy()
    label = np.zeros(len(rows), np.int64)
    for _ in range(steps):
        label = (rows @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, label, rows * np.log1p(weight)[:, None])
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centre = np.where(size > 0, total / np.maximum(size, 1e-12), centre)
    label += 1
    label[0] = 0
    width = np.arange(len(rows)) < TOP
    for new in range(first, classes):
        cost = np.bincount(label, weight, classes) * np.bincount(label, width & (weight > 0), classes)
        own = np.flatnonzero(label == cost[1:].argmax() + 1)
        if not len(own):
            break
        off = rows[own] - rows[own].mean(axis=0)
        axis = off[np.argmax((off * off).sum(axis=1))]
        for _ in range(steps):
            axis = off.T @ (off @ axis)
            axis /= max(float(np.sqrt(axis @ axis)), 1e-12)
        along = off @ axis
        middle = np.median(along[width[own]]) if width[own].any() else np.median(along)
        label[own[along > middle]] = new
    return label


@dataclass
class Model:
    lexicon: Lexicon
    cls: np.ndarray  # by unit
    slot: np.ndarray  # by unit; ending units have the class's last slot
    log_rest: np.ndarray  # by class: log10 of the mass of its rest
    slots: np.ndarray
    weights: np.ndarray

    def network(self) -> Network:
        return Network(self.cls, self.slot, self.slots, flat=self.weights)

    @classmethod
    def start(cls, lexicon: Lexicon, near: np.ndarray, weight: np.ndarray, kinds: np.ndarray) -> Model:
        """Untrained: every word has its share. ``weight`` and ``kinds``: tokens and distinct words of each unit."""
        own_cls = cluster(near, weight)
        slot, slot_counts, log_rest = np.zeros(len(weight), np.int64), [], np.zeros(CLASSES)
        for k in range(CLASSES):
            own = np.flatnonzero(own_cls[:TOP] == k)
            own = own[weight[own] > 0]
            ends = TOP + np.flatnonzero(own_cls[TOP:] == k)
            slot[own], slot[ends] = np.arange(len(own)), len(own)
            slot_counts.append(np.append(weight[own], weight[ends].sum() + SMOOTH))
            log_rest[k] = math.log10((weight[ends] + SMOOTH * kinds[ends]).sum() + SMOOTH)
        network = Network(own_cls, slot, np.array([len(x) for x in slot_counts])).start(slot_counts)
        return cls(lexicon, own_cls, slot, log_rest, network.sizes, network.flat)


def unit_weights(lexicon: Lexicon, counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each unit."""
    weight, kinds = np.zeros(TOP + ENDINGS), np.zeros(TOP + ENDINGS)
    weight[lexicon.unit[lexicon.unit >= 0]] = lexicon.count[lexicon.unit >= 0]
    top = counts.sparkSession.createDataFrame([(int(x),) for x in lexicon.hashed[lexicon.unit >= 0].view(np.int64)], "word bigint")
    rest = counts.join(F.broadcast(top), "word", "left_anti").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()  # at most ENDINGS rows
    at = TOP + rest["ending"].to_numpy(np.int64)
    weight[at], kinds[at] = rest["n"], rest["kinds"]
    return weight, kinds


def average(trained: DataFrame, shards: int) -> np.ndarray | None:
    """The mean of the shards' weights by their tokens, taken in a tree of groups of `FAN`, so that no task and not the driver gets all."""

    def mean(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy().astype(np.float64)
        total = sum(np.frombuffer(w, np.float32) * k for w, k in zip(table["weights"].to_pylist(), n))
        return pa.table({"shard": table["shard"].slice(0, 1), "n": pa.array([int(n.sum())]), "weights": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    groups = max(2, shards)
    while groups > 1:
        groups = math.ceil(groups / FAN)
        trained = trained.withColumn("shard", F.pmod("shard", F.lit(groups))).groupBy("shard").applyInArrow(mean, trained.schema)
    rows = trained.select("weights").collect()  # one row
    return np.frombuffer(rows[0][0], np.float32) if rows else None


def train_shard(model: Model, units: np.ndarray, ends: np.ndarray, rate: float) -> np.ndarray:
    """The weights after one pass over a shard's texts.

    Long texts are learned in pieces of `PIECE` tokens, so that lanes end together. Small shards take fewer lanes, so
    that they have updates enough.
    """
    ends = np.union1d(ends, np.concatenate([np.arange(a, b, PIECE)[1:] for a, b in zip(np.append(0, ends), ends)]))
    lanes = int(np.clip(len(units) // (WINDOW * LEAST_UPDATES), *TRAIN_LANES))
    network = model.network()
    network.train(lay_out(units, ends, lanes), rate)
    return network.flat


def train(model: Model, coded: DataFrame, rounds: int = ROUNDS, epochs: int = EPOCHS) -> Model:
    """Each round trains on the rows of its ``round``; after it the weights are averaged by the shards' tokens. The rate falls from round to round."""
    shards = max(1, math.ceil(model.lexicon.tokens / rounds / SHARD_TOKENS))
    for r in range(rounds * epochs):
        now, rate = model, RATE * (1 - 0.8 * r / max(1, rounds * epochs - 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = [_units(b.column("units")) for b in batches if b.num_rows]
            if not read:
                return
            units = np.concatenate([u for u, _ in read])
            ends = np.cumsum(np.concatenate([np.diff(np.append(0, e)) for _, e in read]))
            flat = train_shard(now, units, ends, rate)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([len(units)], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["shard", "n", "weights"])

        own = coded.where(F.col("round") == r % rounds).select("row", "units").repartition(shards, "row").select("units")
        trained = average(own.mapInArrow(run, "shard bigint, n bigint, weights binary"), shards)
        if trained is not None:
            model = Model(model.lexicon, model.cls, model.slot, model.log_rest, model.slots, trained)
    return model


def fit(coded: DataFrame, counts: DataFrame, lexicon: Lexicon) -> Model:
    """``coded``: `code_texts` of the training documents, with their ``round``; ``counts``: their `count_tokens`, written."""
    return train(Model.start(lexicon, neighbour_counts(coded), *unit_weights(lexicon, counts)), coded)


def score_units(model: Model, network: Network, units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 P of each text, but for its words' shares of their class's rest that `code_texts` has summed."""
    own = np.where(np.arange(len(model.cls)) >= TOP, -model.log_rest[model.cls], 0.0)
    return network.score(lay_out(units, ends, SCORE_LANES)) / math.log(10) + per_text(own[units], np.append(0, ends))


def score_texts(coded: DataFrame, model: Model) -> DataFrame:
    """The rows of ``coded`` but for units and tail, and model_log: log10 P without the tail words' own."""
    columns = ["row", "doc_id", "n_tokens", "n_known", "head_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = model.network()
        for b in _token_slices(batches):
            found = score_units(model, network, *_units(b.column("units"))) + b.column("rest_log").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(found)], [*columns, "model_log"])

    return coded.select(*columns, "rest_log", "units").mapInArrow(run, f"row bigint, doc_id {field_type(coded, 'doc_id')}, n_tokens bigint, n_known bigint, head_log double, model_log double")


def training_mark(parts: int = 10) -> Column:
    """Whether a document is learned from; the others are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts != 0


def learn(docs: DataFrame) -> tuple[DataFrame, DataFrame, Model]:
    """All documents coded (see `code_texts`), the counts of the training ones' words, and the model trained on these. ``docs``: doc_id and text."""
    numbered = materialize(number_words(docs), "numbered")
    counts = materialize(count_tokens(numbered), "counts")
    lexicon = Lexicon.gather(counts)
    part = F.when(training_mark(), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(ROUNDS))).otherwise(-1).cast("int")
    coded = materialize(code_texts(numbered, lexicon).withColumn("round", part), "coded", by="round")
    discard(numbered)
    return coded, counts, fit(coded.where("round >= 0"), counts, lexicon)


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    coded, counts, model = learn(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    lexicon = model.lexicon
    # No tail word has 1 / HEAD of the tokens, so no key of this join is hot.
    tail = coded.select("row", F.explode("tail").alias("word")).join(counts.select("word", "n"), "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("tail_log"), F.count("n").alias("tail_known"))
    base = math.log10(lexicon.tokens + SMOOTH * (lexicon.distinct + 1))
    out = score_texts(coded, model).join(tail, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        "doc_id",
        (~training_mark()).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("model_log") + tail_log).alias("score"),
    )
