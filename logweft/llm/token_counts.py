"""Token counts by a Viterbi search that keeps counts only.

An Aho-Corasick automaton of the vocabulary runs over each distinct marked word and names, at every end, all pieces
that end there, the longest first. For each end the search keeps the best score and the number of pieces of the
path that has it; no path is kept. A path is replaced only by a strictly better one, so ties fall to the longest
last piece, as in the library's own search. See `pieces` for scores, unknown characters and the cut into words.
Counts of words stay in a bounded cache from slice to slice.

Defined cases: null and empty texts count 0; a text of any length is counted whole; rows are counted each on its
own, repeated ones alike; an empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.pieces import MARK, load_vocabulary, marked_words, vocabulary_path
from logweft.llm.store import field_type
from logweft.llm.text import per_text, slices

#: The cache of words is dropped after a slice that leaves it with more than so many bytes, a word counted as its length and `WORD_COST`.
CACHE_BYTES, WORD_COST = 96 << 20, 220


class Counter:
    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary = load_vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in self.vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[int, float]] = {}
        self.cost = 0

    def count(self, word: str) -> tuple[int, float]:
        """The number of pieces of a word's best segmentation, and its score."""
        single, unknown = self.vocabulary.single, self.vocabulary.unknown_score
        score: list[float | None] = [0.0] + [None] * len(word)
        pieces = [0] * (len(word) + 1)
        whole = True
        for c in word:
            if c not in single:
                whole = False
                break
        if whole:  # each end is reached by a piece of one character at least
            for end, (size, value) in self.automaton.iter(word):
                start = end + 1 - size
                value += score[start]
                old = score[end + 1]
                if old is None or value > old:
                    score[end + 1] = value
                    pieces[end + 1] = pieces[start] + 1
            return pieces[-1], score[-1]
        ending: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, found in self.automaton.iter(word):
            ending[end].append(found)
        for i, c in enumerate(word):
            for size, value in ending[i]:
                start = i + 1 - size
                if score[i + 1] is None or score[start] + value > score[i + 1]:
                    score[i + 1], pieces[i + 1] = score[start] + value, pieces[start] + 1
            if c not in single and (score[i + 1] is None or score[i] + unknown > score[i + 1]):
                score[i + 1], pieces[i + 1] = score[i] + unknown, pieces[i] + len(c.encode())
        return pieces[-1], score[-1]

    def count_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text."""
        words = marked_words(texts, self.vocabulary.joined)
        codes, distinct = words.encode()
        distinct = distinct.to_pylist()
        cache, count = self.cache, self.count
        for w in distinct:
            if w not in cache:
                cache[w] = count(w.replace(" ", MARK))
                self.cost += len(w) + WORD_COST
        found = [cache[w] for w in distinct]
        if self.cost > CACHE_BYTES:
            cache.clear()
            self.cost = 0
        n = np.fromiter((x[0] for x in found), np.int64, len(found))
        score = np.fromiter((x[1] for x in found), np.float64, len(found))
        return per_text(n[codes], words.starts), per_text(score[codes], words.starts)


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each Python worker, kept from task to task."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces and score (of the best segmentation) of every document."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=2 << 20):
            n, score = counter(path).count_texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_pieces", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {field_type(docs, doc_id)}, n_pieces bigint, score double")
