"""Phrases whose words come together more often than by chance, mined with weighted acyclic automata.

Words are counted by hash, then pairs of frequent words, and bit maps of what is frequent enough for a phrase are made of
both (`frequent_bits`; they may let others through, never one too few). Each of these, and step 1, reads the texts anew
and splits them slice by slice, so no row is larger than a text or a slice's share of a range; the rows must be the same
each time. Then, by slice of texts:

1. *Shard transducers.* All word sequences of 1 to 5 words whose pairs are frequent are counted as paths from sorted
   keys, level by level, and each range of prefixes (by a hash of language and first two words, the first alone for
   single words) becomes an acyclic automaton of its own: equal continuations with equal weights are one state.
2. *Union.* All automata of a range meet in one task. They are unfolded together from the top, weights of equal paths
   are summed, and a path under `LEAST` is dropped with all that continue it, as these can't be more frequent.
   What is left is the range's count transducer, with exact counts over all texts. It is written to the shared folder.
3. *Composition.* Beginnings of a phrase are on its own path, other parts in other ranges. Each range asks once for
   each different part; the part's own range walks the questions through its transducer and answers. A question also
   carries the count of the longest-known phrase around the part, so its range learns which of its phrases a longer
   one covers; continuations on the same path tell the rest (a covering phrase covers by a single word more, too).

The number of ranges grows with the texts' bytes, so a range holds about `RANGE_WORDS` at any size, and repeated sequences
are counted in their slice before anything is shuffled: a hot passage sends one path a slice.

Defined cases: null texts are empty; a null language is ``und``; texts of any length are read whole; equal rows count
each; no table row, no phrase. Only text and lang are read, so other columns can't clash. Ties of cuts go to the
shortest first part; ties of phrases to the greater count, then the smaller phrase in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.store import broadcast_if_small, materialize
from logweft.llm.text import flat, mix64, slices, split_words

LONGEST, LEAST, FIRST = 5, 100, 2000
RANGE_WORDS, BYTES_A_WORD, SLICE = 2 << 20, 6, 4 << 20
#: Bits for each frequent word, and the greatest size of the map as a power of two (8 MB).
BITS_A_WORD, MOST_BITS = 16, 26

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WHITE = _ENDS.copy()
_WHITE[[9, 32]] = True


def _hashed(strings: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(strings.to_pylist(), object), categorize=False) if len(strings) else np.zeros(0, np.uint64)


def _lead(langs: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """A hash of language and first word, and the second word, from their own hashes."""
    out = mix64(mix64(langs, 1) ^ first)
    return out if second is None else mix64(out * np.uint64(31) + second, 2)


@dataclass
class Slice:
    """The words of some texts by number, a number for each word of a language; ``glued`` tells which are followed by another in the same piece."""

    langs: pa.Array
    tongue: np.ndarray  # by number, the language
    names: pa.Array  # by number, the word
    word: np.ndarray
    glued: np.ndarray
    _hashes: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Slice:
        data, at = flat(batch.column("text"), lower=True)
        found = split_words(data, at, white=_WHITE)
        word, words = found.encode()
        langs = pc.fill_null(batch.column("lang").cast(pa.string()), "und").dictionary_encode()
        owner = found.owners()
        ends = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_ENDS[data], out=ends[1:])
        glued = np.zeros(len(word), bool)
        if len(word):
            glued[:-1] = (owner[1:] == owner[:-1]) & (ends[found.begin[1:]] == ends[found.begin[:-1]])
        key = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner] * max(1, len(words)) + word
        number, spoken = pd.factorize(key)
        tongue, name = np.divmod(spoken, max(1, len(words)))
        return cls(langs.dictionary, tongue, words.cast(pa.string()).take(pa.array(name)), number, glued)

    def totals(self) -> np.ndarray:
        """By language, the number of words."""
        return np.bincount(self.tongue[self.word], minlength=len(self.langs))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """By number, hashes of the language and of the word."""
        if self._hashes is None:
            self._hashes = _hashed(self.langs)[self.tongue], _hashed(self.names)
        return self._hashes

    def words(self, ranges: int) -> np.ndarray:
        """By number, the `_numbered` hash of language and word."""
        return _numbered(_lead(*self.hashes()), ranges)

    def pairs(self, at: np.ndarray, ranges: int) -> np.ndarray:
        """The `_numbered` hash of the pair of words at each place and the next."""
        lang, word = self.hashes()
        lead = _lead(lang, word)
        return _numbered(mix64(lead[self.word[at]] * np.uint64(31) + word[self.word[at + 1]], 2), ranges)


def _numbered(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash in the upper half, 32 of its bits in the lower."""
    return (hashes % np.uint64(ranges)) << np.uint64(32) | hashes >> np.uint64(32)


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<i4" if not len(values) or values.max() < 2**31 else "<i8").tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<i4" if len(blob) == 4 * n else "<i8").astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    return map(Slice.read, slices(batches, limit=SLICE))


def frequent(texts: DataFrame, keys: Callable[[Slice], tuple[np.ndarray, np.ndarray]], least: int) -> DataFrame:
    """place: a hash of each of a slice's ``keys`` (`_numbered` hashes and how often each comes) that comes ``least`` times in all slices.

    Keys that share a number are counted as one, so none is missed. A slice sends each range its numbers as one packed
    row; a count of ``least`` decides by itself, so none is sent greater and most fit a byte. With the first of these
    rows go the words of each language: in other rows of the result, which have no place, lang and n of some slices.
    """
    width = np.uint8 if least < 256 else np.uint32
    kinds = pa.schema([("rng", pa.int32()), ("key", pa.binary()), ("n", pa.binary()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _read(batches):
            key, times = keys(s)
            order = np.argsort(key)
            key, times = key[order], times[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            n = np.minimum(np.add.reduceat(times, at), least).astype(width) if len(at) else times
            low, home = key[at].astype(np.uint32), (key[at] >> np.uint64(32)).astype(np.int32)
            begin = np.flatnonzero(np.r_[True, home[1:] != home[:-1]][: len(home)]).tolist()
            spans = list(zip(begin, [*begin[1:], len(home)]))
            more = [s.langs.to_pylist(), *[[]] * len(spans)], [s.totals().tolist(), *[[]] * len(spans)]
            rows = [(home[a], low[a:b].tobytes(), n[a:b].tobytes()) for a, b in spans] or [(0, b"", b"")]
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*row, *own))) for row, *own in zip(rows, *more)], kinds)

    def total(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in table["key"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, width) for x in table["n"].to_pylist()])
        key, which = np.unique(keys, return_inverse=True)
        often = key[np.bincount(which, counts) >= least]  # sums below 2^53 are exact
        place = _place(np.uint64(table["rng"][0].as_py()) << np.uint64(32) | often.astype(np.uint64))
        own = pa.table([pc.list_flatten(table[c]) for c in ("langs", "totals")], ["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
        langs, n = own["lang"].combine_chunks(), own["n_sum"].combine_chunks()
        return pa.table([pa.concat_arrays([pa.array(place.view(np.int64)), pa.nulls(len(langs), pa.int64())]), pa.concat_arrays([pa.nulls(len(place), pa.string()), langs]), pa.concat_arrays([pa.nulls(len(place), pa.int64()), n])], ["place", "lang", "n"])

    return texts.mapInArrow(count, "rng int, key binary, n binary, langs array<string>, totals array<bigint>").groupBy("rng").applyInArrow(total, "place bigint, lang string, n bigint")


def frequent_words(texts: DataFrame, ranges: int, least: int) -> DataFrame:
    return frequent(texts, lambda s: (s.words(ranges), np.bincount(s.word, minlength=len(s.names))), least)


def frequent_pairs(texts: DataFrame, bits: np.ndarray, ranges: int, least: int) -> DataFrame:
    """As `frequent_words`, of pairs of words that are in ``bits``."""

    def keys(s: Slice) -> tuple[np.ndarray, np.ndarray]:
        known = _has_bit(bits, _place(s.words(ranges)))[s.word]
        pair = s.pairs(np.flatnonzero(s.glued[:-1] & known[:-1] & known[1:]), ranges)
        return pair, np.ones(len(pair), np.int64)

    return frequent(texts, keys, least)


def _place(numbers: np.ndarray) -> np.ndarray:
    return mix64(numbers, 7)


def frequent_bits(places: DataFrame, n: int) -> np.ndarray:
    """A bit map of the hashes ``place``, of 8 MB at most, gathered as packed blocks."""
    width = min(MOST_BITS, max(16, (BITS_A_WORD * n).bit_length()))

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, bool)
        bits[table["low"].to_numpy()] = True
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slot = F.col("place").bitwiseAND(F.lit((1 << width) - 1))
    blocks = places.select(F.shiftright(slot, 16).cast("int").alias("block"), slot.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("low")).distinct()
    out = np.zeros((1 << width - 16, 1 << 13), np.uint8)
    for block, bits in blocks.groupBy("block").applyInArrow(pack, "block int, bits binary").collect():  # at most 1,024 rows of 8 KB
        out[block] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _has_bit(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    slot = (places & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


@dataclass
class Paths:
    """Counted word sequences as a trie by level. A sequence of level k has a parent (a place in level k - 1; at level 1 the language), a last word and a weight."""

    parent: list[np.ndarray] = field(default_factory=list)
    label: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)

    def add(self, parent: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        self.parent.append(parent)
        self.label.append(label)
        self.weight.append(weight)


def count_paths(s: Slice, frequent: np.ndarray, paired: np.ndarray) -> Paths:
    """All sequences of up to `LONGEST` words with their counts, of words that are ``frequent`` and each but the last ``paired`` with the next (tests by place)."""
    base, out = max(1, len(s.names)), Paths()
    at = np.flatnonzero(frequent)
    word, before, n = np.unique(s.word[at], return_inverse=True, return_counts=True)
    out.add(s.tongue[word], word, n)
    for k in range(1, LONGEST):
        on = paired[at + k - 1]
        at, before = at[on], before[on]
        key, before, n = np.unique(before * base + s.word[at + k], return_inverse=True, return_counts=True)
        out.add(key // base, key % base, n)
    return out


def _minimal(parent: list[np.ndarray], label: list[np.ndarray], weight: list[np.ndarray], heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The states of a trie's heads, and by state the first of its moves (one more at the end), and label, weight and target of each move.

    Levels go bottom up; two places whose moves agree in label, weight and target are one state. State 0 has no moves.
    """
    sizes = [heads, *map(len, label)]
    target = np.zeros(sizes[-1], np.int64)
    first, moves, known = [np.zeros(2, np.int64)], [[], [], []], {}
    made, ends = 1, 0
    for k in range(len(label) - 1, -1, -1):  # the moves into this level make the states of the one above
        own = np.zeros(sizes[k], np.int64)
        if sizes[k + 1]:
            begin = np.flatnonzero(np.r_[True, parent[k][1:] != parent[k][:-1]])
            marks = mix64(mix64(label[k].astype(np.uint64), 3) ^ mix64(weight[k].astype(np.uint64), 4) ^ mix64(target.astype(np.uint64), 5))
            one, two = np.add.reduceat(marks, begin), np.add.reduceat(mix64(marks, 6), begin)
            order = np.lexsort((two, one))
            new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
            which, size = order[new], np.diff(np.r_[begin, sizes[k + 1]])
            number = np.empty(len(which), np.int64)
            fresh = []
            for j, mark in enumerate(zip(one[which].tolist(), two[which].tolist())):
                if mark not in known:
                    known[mark] = made + len(fresh)
                    fresh.append(j)
                number[j] = known[mark]
            made += len(fresh)
            which = which[fresh]
            index = np.repeat(begin[which] - np.r_[0, np.cumsum(size[which])[:-1]], size[which]) + np.arange(size[which].sum())
            first.append(ends + np.cumsum(size[which]))
            ends += len(index)
            for side, values in zip(moves, (label[k], weight[k], target)):
                side.append(values[index])
            states = np.empty(len(begin), np.int64)
            states[order] = number[np.cumsum(new) - 1]
            own[parent[k][begin]] = states
        target = own
    return target, np.concatenate(first), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in moves)


_INTS = ("lang", "first_word", "second_word", "weight", "state", "first", "label", "move_weight", "target")


def transducers(s: Slice, paths: Paths, ranges: int) -> Iterator[dict]:
    """By range of prefixes its automaton: heads (language, first word, second word or -1, weight, state) and states' moves, with the words it uses."""
    lang_hash, word_hash = s.hashes()
    lang, first, second = paths.parent[0], paths.label[0], paths.label[1]
    lead = [_lead(lang_hash[first], word_hash[first])]
    lead.append(_lead(lang_hash[second], word_hash[first[paths.parent[1]]], word_hash[second]))
    home = [(x % np.uint64(ranges)).astype(np.int64) for x in lead]
    heads = [(lang, first, np.full(len(first), -1), paths.weight[0]), (lang[paths.parent[1]], first[paths.parent[1]], second, paths.weight[1])]
    order = [np.argsort(h, kind="stable") for h in home]
    cuts = [np.searchsorted(h[o], np.arange(ranges + 1)) for h, o in zip(home, order)]
    levels, at, cut = [], order[1], cuts[1]
    for k in range(2, LONGEST):  # places of a range stand together at each level
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        moved = place[paths.parent[k]]
        at = np.argsort(moved, kind="stable")
        levels.append((moved[at], paths.label[k][at], paths.weight[k][at]))
        cuts.append(np.searchsorted(moved[at], cut))
        cut = cuts[-1]
    for r in range(ranges):
        ones, twos = (order[i][cuts[i][r] : cuts[i][r + 1]] for i in (0, 1))
        if not len(ones) and not len(twos):
            continue
        spans = [(cuts[k][r], cuts[k][r + 1]) for k in range(1, LONGEST)]
        parent, label, weight = ([level[i][a:b] - (spans[j][0] if i == 0 else 0) for j, (level, (a, b)) in enumerate(zip(levels, spans[1:]))] for i in range(3))
        state, *moves = _minimal(parent, label, weight, len(twos))
        yield _blob(r, [np.concatenate([heads[0][i][ones], heads[1][i][twos]]) for i in range(4)], np.r_[np.zeros(len(ones), np.int64), state], moves, s.langs, s.names)


def _blob(r: int, heads: list[np.ndarray], state: np.ndarray, moves: list[np.ndarray], langs: pa.Array, words: pa.Array) -> dict:
    lang, first_word, second_word, weight = heads
    first, label, move_weight, target = moves
    used, number = np.unique(np.concatenate([first_word, second_word[second_word >= 0], label]), return_inverse=True)
    n, two = len(first_word), second_word >= 0
    renamed = np.full(n, -1)
    renamed[two] = number[n : n + two.sum()]
    spoken, lang = np.unique(lang, return_inverse=True)
    values = (lang, number[:n], renamed, weight, state, first, number[n + two.sum() :], move_weight, target)
    row = {name: _packed(x) for name, x in zip(_INTS, values)}
    return row | {"rng": r, "langs": langs.take(pa.array(spoken)).to_pylist(), "words": "\n".join(words.take(pa.array(used)).to_pylist()), "n_heads": n, "n_states": len(first) - 1, "n_moves": len(label)}


_FIELDS = [("rng", pa.int32()), ("langs", pa.list_(pa.string())), ("words", pa.string()), ("n_heads", pa.int32()), ("n_states", pa.int32()), ("n_moves", pa.int32()), *((x, pa.binary()) for x in _INTS)]
_KIND = "rng int, langs array<string>, words string, n_heads int, n_states int, n_moves int, " + ", ".join(f"{x} binary" for x in _INTS)


def shard_transducers(texts: DataFrame, bits: np.ndarray, pair_bits: np.ndarray, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _read(batches):
            frequent = _has_bit(bits, _place(s.words(ranges)))[s.word]
            paired = s.glued & frequent
            at = np.flatnonzero(paired[:-1] & frequent[1:])
            paired[:] = False
            paired[at] = _has_bit(pair_bits, _place(s.pairs(at, ranges)))
            yield pa.RecordBatch.from_pylist(list(transducers(s, count_paths(s, frequent, paired), ranges)), pa.schema(_FIELDS))

    return texts.mapInArrow(run, _KIND)


def _summed(key: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys whose weights sum to ``least``, these sums, and by row its key's place among them (-1: dropped)."""
    distinct, which = np.unique(key, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, weight)
    keep = total >= least
    place = np.where(keep, np.cumsum(keep) - 1, -1)
    return distinct[keep], total[keep], place[which] if len(which) else which


def union(table: pa.Table, least: int) -> tuple[list[str], list[str], Paths, np.ndarray]:
    """The languages, words and counted paths of all automata in ``table``, those of ``least`` alone; and level 2's first words, as its paths may lack their parents (other ranges have them)."""
    rows = table.to_pylist()
    words = pa.array("\n".join(r["words"] for r in rows).split("\n"), pa.string()).dictionary_encode()
    langs = pa.array([x for r in rows for x in r["langs"]], pa.string()).dictionary_encode()
    number, tongue = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    base = max(1, len(words.dictionary))
    parts: dict[str, list[np.ndarray]] = {x: [] for x in _INTS}
    w = t = states = moves = 0
    for r in rows:
        got = {x: _unpacked(r[x], r["n_states"] + 1 if x == "first" else r["n_moves"] if x in ("label", "move_weight", "target") else r["n_heads"]) for x in _INTS}
        for x in ("first_word", "second_word", "label"):
            got[x] = np.where(got[x] < 0, -1, number[got[x] + w])
        got["lang"] = tongue[got["lang"] + t]
        got["state"], got["target"] = got["state"] + states, got["target"] + states
        got["first"] = got["first"] + moves
        got["first"], count = got["first"][:-1], len(got["first"]) - 1
        w, t, states, moves = w + r["words"].count("\n") + 1, t + len(r["langs"]), states + count, moves + r["n_moves"]
        for x in _INTS:
            parts[x].append(got[x])
    a = {x: np.concatenate(v) if v else np.zeros(0, np.int64) for x, v in parts.items()}
    first = np.r_[a["first"], moves]
    alone = a["second_word"] < 0
    out = Paths()
    key, total, _ = _summed(a["lang"][alone] * base + a["first_word"][alone], a["weight"][alone], least)
    out.add(key // base, key % base, total)
    key, total, place = _summed((a["lang"][~alone] * base + a["first_word"][~alone]) * base + a["second_word"][~alone], a["weight"][~alone], least)
    out.add(key // base // base, key % base, total)
    lead, state = key // base % base, a["state"][~alone]
    for _ in range(2, LONGEST):
        on = place >= 0
        place, state = place[on], state[on]
        many = first[state + 1] - first[state]
        index = np.repeat(first[state] - np.r_[0, np.cumsum(many)[:-1]][: len(many)], many) + np.arange(many.sum())
        key, total, place = _summed(np.repeat(place, many) * base + a["label"][index], a["move_weight"][index], least)
        state = a["target"][index]
        out.add(key // base, key % base, total)
    return langs.dictionary.to_pylist(), words.dictionary.to_pylist(), out, lead


def _spelled(langs: list[str], words: list[str], paths: Paths, lead: np.ndarray) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """Every path as a row (lang, phrase, size, f, covered: by a continuation of the same count; firsts: the counts of its beginnings of two words and more), and each level's first row."""
    names, frames, held = np.array([*words, ""], object), [], []
    for k in range(LONGEST):
        up, last, f = paths.parent[k], names[paths.label[k]], paths.weight[k]
        if k == 0 or k == 1:
            lang = np.array([*langs, ""], object)[up]
            text = last if k == 0 else names[lead] + " " + last
            firsts = [()] * len(f)
        else:
            lang, text = frames[-1]["lang"].to_numpy(object)[up], frames[-1]["phrase"].to_numpy(object)[up] + " " + last
            before, counts = frames[-1]["firsts"].to_numpy(object), paths.weight[k - 1].tolist()
            firsts = [(*before[u], counts[u]) for u in up.tolist()]
        covered = np.zeros(len(f), bool)
        if 0 < k < LONGEST - 1:
            covered[paths.parent[k + 1][paths.weight[k + 1] == f[paths.parent[k + 1]]]] = True
        held = pd.Series(firsts, dtype=object)
        frames.append(pd.DataFrame({"lang": lang, "phrase": text, "size": k + 1, "f": f, "covered": covered, "firsts": held}))
    return pd.concat(frames, ignore_index=True), held


def _home(langs: list[str], parts: list[str], ranges: int) -> np.ndarray:
    """The range of each part."""
    cut = [p.split(" ", 2) for p in parts]
    lang, first = _hashed(pa.array(langs, pa.string())), _hashed(pa.array([c[0] for c in cut], pa.string()))
    second = _hashed(pa.array([c[1] if len(c) > 1 else "" for c in cut], pa.string()))
    two = np.array([len(c) > 1 for c in cut], bool)
    return (np.where(two, _lead(lang, first, second), _lead(lang, first)) % np.uint64(ranges)).astype(np.int32)


def count_transducers(shards: DataFrame, least: int) -> DataFrame:
    """One row for each range: the union of its automata, as paths of ``least`` and more."""

    def run(table: pa.Table) -> pa.Table:
        frame, _ = _spelled(*union(table, least))
        out = pa.Table.from_pandas(frame.assign(firsts=[list(x) for x in frame["firsts"]]), pa.schema(_PATHS), preserve_index=False)
        return out.add_column(0, "rng", pa.array(np.full(len(out), table["rng"][0].as_py()), pa.int32()))

    return shards.groupBy("rng").applyInArrow(run, f"rng int, {_PATH_KIND}")


_PATHS = [("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64()), ("covered", pa.bool_()), ("firsts", pa.list_(pa.int64()))]
_PATH_KIND = "lang string, phrase string, size int, f bigint, covered boolean, firsts array<bigint>"


def _parts(phrase: str) -> list[str]:
    """The first word, and what is left after each cut."""
    words = phrase.split(" ")
    return [words[0], *(" ".join(words[k:]) for k in range(1, len(words)))]


def questions(paths: DataFrame, ranges: int) -> DataFrame:
    """dst, src, lang, part and around (the greatest count of a phrase that is the part after one more word) for each different part a range asks for."""

    def run(table: pa.Table) -> pa.Table:
        asked: dict[tuple[str, str], int] = {}
        for lang, phrase, size, f in zip(*(table[c].to_pylist() for c in ("lang", "phrase", "size", "f"))):
            if size > 1:
                for i, part in enumerate(_parts(phrase)):
                    key = (lang, part)
                    asked[key] = max(asked.get(key, 0), f if i == 1 else 0)
        langs, parts = [k[0] for k in asked], [k[1] for k in asked]
        src = pa.array(np.full(len(asked), table["rng"][0].as_py()), pa.int32())
        return pa.table([pa.array(_home(langs, parts, ranges) if asked else [], pa.int32()), src, pa.array(langs, pa.string()), pa.array(parts, pa.string()), pa.array(list(asked.values()), pa.int64())], ["dst", "src", "lang", "part", "around"])

    return paths.groupBy("rng").applyInArrow(run, "dst int, src int, lang string, part string, around bigint")


def answers(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """src, lang, part and f of each question; a range tells itself by -1 which of its phrases a longer one covers."""

    def run(questions: pa.Table, own: pa.Table) -> pa.Table:
        counts = {(lang, phrase): f for lang, phrase, f in zip(*(own[c].to_pylist() for c in ("lang", "phrase", "f")))}
        out: list[tuple] = []
        for dst, src, lang, part, around in zip(*(questions[c].to_pylist() for c in ("dst", "src", "lang", "part", "around"))):
            f = counts[(lang, part)]
            out.append((src, lang, part, f))
            if around == f and " " in part:
                out.append((dst, lang, part, -1))
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))], ["src", "lang", "part", "f"])

    return asked.groupBy("dst").cogroup(paths.groupBy("rng")).applyInArrow(run, "src int, lang string, part string, f bigint")


def composed(paths: DataFrame, told: DataFrame) -> DataFrame:
    """lang, phrase, a, and by cut the counts of both parts (lefts, rights), of phrases that no longer one covers."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        counts: dict[tuple[str, str], int] = {}
        covered = set()
        for lang, part, f in zip(*(told[c].to_pylist() for c in ("lang", "part", "f"))):
            if f < 0:
                covered.add((lang, part))
            else:
                counts[(lang, part)] = f
        out = []
        for lang, phrase, size, f, lost, firsts in zip(*(own[c].to_pylist() for c in ("lang", "phrase", "size", "f", "covered", "firsts"))):
            if size > 1 and not lost and (lang, phrase) not in covered:
                head, *rest = _parts(phrase)
                out.append((lang, phrase, f, [counts[(lang, head)], *firsts], [counts[(lang, x)] for x in rest]))
        many = pa.list_(pa.int64())
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), many, many))], ["lang", "phrase", "a", "lefts", "rights"])

    return paths.groupBy("rng").cogroup(told.groupBy("src")).applyInArrow(run, "lang string, phrase string, a bigint, lefts array<bigint>, rights array<bigint>")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST, range_words: int = RANGE_WORDS) -> DataFrame:
    """Each language's ``first`` phrases: lang, rank, phrase, a, l, r, n and score."""
    texts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = 1 + n_bytes // (BYTES_A_WORD * range_words)
    words = materialize(frequent_words(texts, ranges, least), "words")
    totals = words.where("place IS NULL").groupBy("lang").agg(F.sum("n").cast("decimal(20,0)").alias("n"))
    words, tongues = words.where("place IS NOT NULL").select("place"), totals.count()
    bits = frequent_bits(words, words.count())
    pairs = materialize(frequent_pairs(texts, bits, ranges, least).where("place IS NOT NULL").select("place"), "pairs")
    pair_bits = frequent_bits(pairs, pairs.count())
    paths = materialize(count_transducers(shard_transducers(texts, bits, pair_bits, ranges), least), "paths")
    told = answers(questions(paths, ranges), paths)
    found = composed(paths, told).join(broadcast_if_small(totals, tongues), "lang")
    scored = F.expr("transform(arrays_zip(lefts, rights), (x, k) -> struct(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(20,0)) * n div (CAST(x.lefts AS DECIMAL(19,0)) * CAST(x.rights AS DECIMAL(19,0))) AS score, k AS k, x.lefts AS l, x.rights AS r))")
    found = found.withColumn("cut", F.array_min(scored))
    by = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("n").cast("bigint").alias("n"), "cut.score")


ORACLE = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
phrases AS (SELECT lang, w[i:i + size - 1] AS w, size FROM places, (SELECT unnest(range(1, 6)) AS size) WHERE i + size - 1 <= len(w)),
f AS (SELECT lang, w, size, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, w, size, f AS a, array_to_string(w, ' ') AS phrase FROM f WHERE size > 1),
left_out AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates d ON c.lang = d.lang AND d.size > c.size AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
cuts AS (SELECT c.*, k, x.f AS l, y.f AS r FROM candidates c, (SELECT unnest(range(1, 5)) AS k) JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:] WHERE k < c.size),
scored AS (SELECT *, (1000::HUGEINT * a * n // (l::HUGEINT * r))::BIGINT AS score FROM cuts JOIN totals USING (lang)),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN left_out USING (lang, phrase) WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
