"""Language identification with bit-sliced Bloom filters over n-grams.

One table of bit masks serves all languages: bit l of a position belongs to language l. An n-gram's hashes pick a
few positions, and the AND of their masks is the set of languages whose filter holds the n-gram, in one look. For
each text the bits are counted by language; with a share f of falsely held n-grams, known from the filter's fill,
h hits of n n-grams are corrected to (h - n f) / (1 - f), and the largest wins.

N-grams are 3 and 5 bytes of the lower-cased text with every other character than a letter as one space; letters
may stand at the ends as spaces do. A language's filter holds the n-grams that make up at least `RATE` of its
sample, so there are at most 1 / RATE of each length. The sample is bounded: about `FIT_DOCS` labelled documents
of a language, picked by a hash of doc_id (of the text where that is null), read whole. All documents are scored.

Defined cases: a null text or one without a letter is `und` with score 0; ties, and texts too short for an
n-gram, go to the language with more labelled documents, then the first by code point; rows with a null label
aren't learned from; without labelled rows all is `und`. The score is the corrected share of n-grams that the language holds.
Repeated rows get the same prediction; an empty table gives no rows. Other columns are kept by `keep_known` and
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.llm.store import field_type, free_name
from logweft.llm.text import flat, mix64, per_text, slices

LENGTHS = (3, 5)
RATE = 5e-5
FIT_DOCS = 3000
POSITIONS = 1 << 18
HASHES = 3
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = flat(texts)
    out = _FOLD[data]
    if len(out) > 1:  # the two-byte capitals of Latin-1
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 0x20
    return out, at


def _grams(folded: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a length as numbers, and their places; they lie within one text and have letters inside."""
    n = len(folded) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = folded != 32
    ok = np.ones(n, bool)
    for k in range(1, length - 1):
        ok &= letter[k : k + n]
    for k in range(1, length):  # a text's last bytes
        ends = at[1:] - k
        ok[ends[(ends >= 0) & (ends < n) & (ends >= at[:-1])]] = False
    place = np.flatnonzero(ok)
    value = np.full(len(place), length, np.uint64)
    for k in range(length):
        value = (value << np.uint64(8)) | folded[place + k]
    return value, place


def has_letter(texts: pa.Array) -> np.ndarray:
    data, at = flat(texts)
    found = per_text(((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)), at) > 0
    for i in np.flatnonzero(~found & (np.diff(at) > 0)):
        found[i] = any(map(str.isalpha, bytes(data[at[i] : at[i + 1]]).decode("utf-8", "replace")))
    return found


@dataclass
class LanguageFilter:
    languages: list[str]  # those with more labelled documents first
    masks: np.ndarray  # positions x words of bits
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], order: list[str], positions: int = POSITIONS) -> LanguageFilter:
        width = next((w for w in (8, 16, 32, 64) if len(order) <= w), 64)
        words = max(1, -(-len(order) // width))
        masks, rate = np.zeros((positions, words), f"u{width // 8}"), np.zeros(len(order))
        for i, language in enumerate(order):
            held = np.zeros(positions, bool)
            for at in cls._places(grams.get(language, np.zeros(0, np.uint64)), positions):
                held[at] = True
            masks[held, i // width] |= masks.dtype.type(1 << (i % width))
            rate[i] = held.mean() ** HASHES
        return cls(order, masks, rate)

    @staticmethod
    def _places(grams: np.ndarray, positions: int) -> Iterator[np.ndarray]:
        mixed = mix64(grams)
        for k in range(HASHES):
            yield ((mixed >> np.uint64(21 * k)) % np.uint64(positions)).astype(np.int64)

    def holders(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of all languages that hold it."""
        return reduce(np.bitwise_and, (self.masks[at] for at in self._places(grams, len(self.masks))))

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits, texts x languages, and the number of n-grams of each text."""
        folded, at = _folded(texts)
        count, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        width = self.masks.dtype.itemsize * 8
        for length in LENGTHS:
            grams, place = _grams(folded, at, length)
            cut = np.searchsorted(place, at)
            count += np.diff(cut)
            held = self.holders(grams)
            for i in range(len(self.languages)):
                hits[:, i] += per_text((held[:, i // width] >> held.dtype.type(i % width)) & held.dtype.type(1), cut)
        return (hits - count[:, None] * self.false_rate) / (1 - self.false_rate), count

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        known = has_letter(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        corrected, count = self.hits(texts)
        best = corrected.argmax(axis=1)
        score = np.clip(corrected[np.arange(len(best)), best] / np.maximum(count, 1), 0, 1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, rate: float = RATE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageFilter:
    """Learn from a bounded sample of the labelled documents."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    order = sorted(counts, key=lambda x: (-counts[x], x))
    if not order:
        return LanguageFilter.build({}, [])
    pick = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(1 << 20))
    share = F.element_at(F.create_map(*(F.lit(v) for x in order for v in (x, int(min(1.0, fit_docs / counts[x]) * (1 << 20))))), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            folded, at = _folded(b.column("text"))
            coded = b.column("lang").dictionary_encode()
            codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            for length in LENGTHS:
                grams, place = _grams(folded, at, length)
                owner = codes[np.searchsorted(at, place, "right") - 1]
                for i, name in enumerate(names):
                    found, n = np.unique(grams[owner == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(np.full(len(found), length, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "length", "gram", "n"])

    grams = rows.where(pick < share).mapInArrow(count, "lang string, length int, gram bigint, n bigint").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    total = grams.groupBy("lang", "length").agg(F.sum("n").alias("total"))
    # At most 1 / rate n-grams of a language and length can have that share.
    common = grams.join(F.broadcast(total), ["lang", "length"]).where(F.col("n") >= rate * F.col("total")).select("lang", "gram").toPandas()
    return LanguageFilter.build({x: g["gram"].to_numpy(np.int64).view(np.uint64) for x, g in common.groupby("lang")}, order)


def training_mark(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """Whether a document is learned from; the others are held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts != 0


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", out: str = "predicted") -> DataFrame:
    """All columns of ``docs``, with lang_pred and score in a struct column ``out``, a name that they don't have."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            names, score = model.predict(b.column(text))
            made = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*columns, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out}` struct<lang_pred: string, score: double>"
    return docs.mapInArrow(run, fields)


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs.where(training_mark(doc_id)), fit_docs, text=text, lang=lang, doc_id=doc_id)
    rows = predict(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", (~training_mark("doc_id")).alias("held_out"), "predicted.lang_pred", "predicted.score")


def keep_known(docs: DataFrame, least_score: float = 0.3, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The documents in a language that was learned: those that are `und` or score under ``least_score`` go. Columns as given."""
    out = free_name(docs.columns, "predicted")
    model = fit(docs.where(training_mark(doc_id)), text=text, lang=lang, doc_id=doc_id)
    return predict(docs, model, text, out).where((F.col(f"{out}.lang_pred") != UNKNOWN) & (F.col(f"{out}.score") >= least_score)).drop(out)
