"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Each rule looks at one measure and votes bad (-1) where it is far off, good (1) where it is as usual, and abstains (0)
between. The rules overlap and err: a document may well have votes of both kinds. Votes are taken as independent given
the text's quality, and an abstention as saying nothing. A rule has two accuracies, the chance that its vote on a good
text is good and that its vote on a bad text is bad; so a rule that votes good on everything counts for nothing.
Expectation-maximisation estimates them and the class balance from the counts of vote patterns of the documents past
the base, which alone are judged: there are at most 3^rules patterns however many documents there are, so it is the
same on any size of input. It starts, and has its Beta prior, where each rule's votes agree somewhat more with the
quality than their shares alone would, so that rare votes tell the most and a rule that always says the same nothing.
The posterior probability of good quality decides, not any rule alone.

Defined cases: a null text has no words, like an empty one, and fails the base; a text on which no rule votes has
the class balance as its posterior and is kept if that is at least the threshold; a measure of a text without its
base (no words, letters or lines) gives no vote; with an empty table the accuracies are the prior's and no rows come out; repeated rows are judged alike, each on its own. Only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.llm.store import field_type, materialize
from logweft.llm.text import SPACE, code_points, flat, per_text, slices, split_words

SYMBOLS = b"#*$%&|<>"
THRESHOLD = 0.5
PRIOR_VOTES, LIFT = 10.0, 0.4
STEPS = 100

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_letters", "n_upper", "n_marks", "n_ends", "n_commas", "n_digits")


def _is(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _MARK, _END, _COMMA, _DIGIT = _is(SYMBOLS), _is(b"!"), _is(b".!?"), _is(b","), _is(b"0123456789")
_UPPER, _LETTER = _is(bytes(range(65, 91))), _is(bytes([*range(65, 91), *range(97, 123)]))


def _repeated_in(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the pair (owner, value) occurs more than once."""
    code, _ = pd.factorize(owner.astype(np.int64) * (int(value.max(initial=0)) + 1) + value)
    return np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)


def _first_seen(values: np.ndarray) -> np.ndarray:
    """Marks the first of equal values."""
    first = np.ones(len(values), bool)
    if len(values):
        code, _ = pd.factorize(values)  # numbers rise by order of first sight
        first[1:] = code[1:] > np.maximum.accumulate(code)[:-1]
    return first


def repeat_words(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks the words in three-word windows that their text has twice or more."""
    covered = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return covered
    at = np.flatnonzero(owner[:-2] == owner[2:])
    wide = codes.astype(np.int64)
    pair, _ = pd.factorize(wide[at] * (int(wide.max()) + 1) + wide[at + 1])
    triple, _ = pd.factorize(pair * (int(wide.max()) + 1) + wide[at + 2])
    again = at[_repeated_in(owner[at], triple)]
    for k in range(3):
        covered[again + k] = True
    return covered


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The text of each line, the lines, and whether they have a word; lines are split at \\n, one at least to a text."""
    feed = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([feed * 2 + 1, at[1:] * 2]))  # a text's end comes before a line feed that opens the next text
    is_feed, ends = ends % 2 == 1, ends // 2
    begin = np.append(0, ends[:-1] + is_feed[:-1])
    offsets = np.append(0, np.cumsum(ends - begin))
    chars = np.ascontiguousarray(data[data != 10])
    solid = np.append(0, np.cumsum(~SPACE[data]))
    owner = np.append(0, np.cumsum(~is_feed))[:-1]
    return owner, pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(chars)), solid[ends] > solid[begin]


def measure_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, at = flat(texts)
    words = split_words(data, at)
    codes, _ = words.encode()
    owner = words.owners()
    sums = lambda marks: per_text(marks, at)
    by_word = lambda marks: per_text(marks, words.starts)
    pair = owner * (int(codes.max(initial=0)) + 1) + codes
    line_owner, lines, has_word = lines_of(data, at)
    line, line_owner = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)[has_word], line_owner[has_word]
    new_line = _first_seen(line_owner * (int(line.max(initial=0)) + 1) + line)
    n = len(texts)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": sums(code_points(data) & ~SPACE[data]),
        "n_symbols": sums(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_owner[~new_line], minlength=n).astype(np.int64),
        "n_repeat_words": by_word(repeat_words(codes, owner)),
        "n_distinct": by_word(_first_seen(pair)),
        "n_lines": np.bincount(line_owner, minlength=n).astype(np.int64),
        "n_letters": sums(_LETTER[data]),
        "n_upper": sums(_UPPER[data]),
        "n_marks": sums(_MARK[data]),
        "n_ends": by_word(_END[words.chars[words.offsets[1:] - 1]]),
        "n_commas": sums(_COMMA[data]),
        "n_digits": sums(_DIGIT[data]),
    }


def measures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and MEASURES of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = measure_texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in MEASURES)], ["doc_id", *MEASURES])

    schema = f"doc_id {field_type(docs, doc_id)}, " + ", ".join(f"{c} bigint" for c in MEASURES)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(part: str, of: str, bad: tuple[float, float], good: tuple[float, float]) -> Column:
    """A vote on the percentage ``part`` of ``of``: bad under the first or over the second bound, good within the other two (both included)."""
    value, base = 100 * F.col(part), F.col(of)
    vote = F.when((value < bad[0] * base) | (value > bad[1] * base), -1).when((value >= good[0] * base) & (value <= good[1] * base), 1).otherwise(0)
    return F.when(base > 0, vote).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes by rule. Percentages are of words, letters or lines; those of word_chars and of n_words by line are means times 100."""
    whole = float("inf")
    return {
        "symbols": _vote("n_symbols", "n_words", (0, 20), (0, 2)),
        "capitals": _vote("n_upper", "n_letters", (0, 30), (0, 5)),
        "repetition": _vote("n_repeat_words", "n_words", (0, 20), (0, 2)),
        "repeated_lines": _vote("n_dup_lines", "n_lines", (0, 20), (0, 5)),
        "length": F.when(F.col("n_words") < 80, -1).when(F.col("n_words") >= 200, 1).otherwise(0),
        "word_length": _vote("word_chars", "n_words", (430, 700), (460, 600)),
        "exclamation": _vote("n_marks", "n_words", (0, 15), (0, 2)),
        "variety": _vote("n_distinct", "n_words", (55, whole), (70, whole)),
        "sentences": _vote("n_ends", "n_words", (4, 40), (6, 20)),
        "commas": _vote("n_commas", "n_words", (2, 40), (4, 12)),
        "line_words": _vote("n_words", "n_lines", (1200, 25_000), (2500, 12_000)),
        "digits": _vote("n_digits", "word_chars", (0, 5), (0, 0.5)),
    }


@dataclass
class Accuracies:
    """Of each rule: the chance that a vote on a good text is good, and that one on a bad text is bad; and the share of good texts."""

    good: np.ndarray
    bad: np.ndarray
    balance: float

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """What a good and a bad vote of each rule add to the evidence."""
        return np.log(self.good / (1 - self.bad)), np.log((1 - self.good) / self.bad)

    @property
    def start(self) -> float:
        """The evidence without votes."""
        return math.log(self.balance / (1 - self.balance))


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, prior_votes: float = PRIOR_VOTES, lift: float = LIFT, steps: int = STEPS) -> Accuracies:
    """EM over (votes, count) pairs. The start and the prior's mean lie ``lift`` of the way from the shares of a rule's votes to certainty."""
    votes, n = np.array([v for v, _ in patterns]).reshape(len(patterns), n_rules), np.array([c for _, c in patterns], float)
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    share = (n @ up + 1) / (n @ (up + down) + 2)
    first = found = Accuracies(share + lift * (1 - share), 1 - share + lift * share, float((n @ up).sum() + 1) / float((n @ (up + down)).sum() + 2))
    for _ in range(steps if patterns else 0):
        for_good, for_bad = found.weights()
        p = 1 / (1 + np.exp(-(found.start + up @ for_good + down @ for_bad)))
        good, bad = p * n, (1 - p) * n
        found = Accuracies((good @ up + prior_votes * first.good) / (good @ (up + down) + prior_votes), (bad @ down + prior_votes * first.bad) / (bad @ (up + down) + prior_votes), float((good.sum() + 1) / (n.sum() + 2)))
    return found


def quality(docs: DataFrame, rules: dict[str, Column] | None = None, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, MEASURES, a vote_<rule> column for each rule, p_good, base_failed and kept, a row for each document."""
    rules = default_rules() if rules is None else rules
    names = [f"vote_{r}" for r in rules]
    voted = materialize(measures(docs, text, doc_id), "measures").select("*", *(c.cast("int").alias(f"vote_{r}") for r, c in rules.items()))
    code = reduce(lambda a, b: a + b, ((F.col(c) + 1).cast("long") * 3**k for k, c in enumerate(names)), F.lit(0).cast("long"))
    counted = voted.where(~base_failed()).groupBy(code.alias("code")).count().collect()  # at most 3^rules rows
    patterns = [(tuple(r["code"] // 3**k % 3 - 1 for k in range(len(names))), r["count"]) for r in sorted(counted)]
    found = fit_accuracies(patterns, len(names))
    evidence = F.lit(found.start)
    for c, up, down in zip(names, *(w.tolist() for w in found.weights())):
        evidence = evidence + F.when(F.col(c) > 0, up).when(F.col(c) < 0, down).otherwise(0.0)
    p = 1 / (1 + F.exp(-evidence))
    return voted.withColumn("p_good", p).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.round("p_good", 9) >= threshold))
