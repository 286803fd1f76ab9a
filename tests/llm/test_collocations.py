import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from logweft.llm import collocations, store
from tests.llm.edge import edge_docs, listed, lower, nothing


def brute(rows, least, first=2000):
    """The contract's words, counted in plain dictionaries."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            f[lang].update(words[i : i + k] for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p in candidates for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (i, j) != (0, len(p)) and 100 * candidates[p] >= 100 * counts[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:first])]
    return sorted(out, key=str)


def prose(seed, n):
    draw = random.Random(seed)
    stock = [" ".join(draw.choice("abcdefgh") * draw.randrange(1, 3) for _ in range(draw.randrange(2, 8))) for _ in range(6)]
    out = []
    for _ in range(n):
        out.append(draw.choice(stock) if draw.random() < 0.5 else " ".join(draw.choice("abcdefghijkl") for _ in range(draw.randrange(1, 9))))
        out.append(draw.choice([". ", ", ", "\n", " ", "\t", " A ", "!"]))
    return "".join(out)


def test_equals_brute_force_over_many_ranges_and_slices(spark, monkeypatch):
    rows = [(prose(s, 60), [None, "en", "und", "de"][s % 4]) for s in range(60)] + [(None, "en"), ("", None), ("\x0b \x1c b\xa0c  b\xa0c", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for least in (2, 15):
        assert listed(collocations.collocations(docs, least=least, range_words=300)) == brute(rows, least)
    assert listed(collocations.collocations(docs, least=2, first=7)) == brute(rows, 2, 7)


def test_odd_rows_and_extra_columns(spark):
    docs = edge_docs(spark)
    want = brute([(r["text"], r["lang"]) for r in docs.collect()], 3)
    assert want and listed(collocations.collocations(docs, least=3)) == want
    assert listed(collocations.collocations(nothing(spark))) == []


def test_states_with_equal_continuations_are_one_and_keep_their_weights():
    text = " ".join(f"{a} x y z w ." for a in "abcdefgh")
    s = collocations.Slice.read(pa.RecordBatch.from_pydict({"text": pa.array([text]), "lang": pa.array(["en"])}))
    (blob,) = collocations.transducers(s, collocations.count_paths(s, np.ones(len(s.word), bool), s.glued), 1)
    assert blob["n_heads"] == 12 + 11  # words, and pairs
    assert blob["n_moves"] == 5  # y, z, w once for all of 'a x' to 'h x', and z, w once for 'x y' and 'y z'
    langs, words, paths, lead = collocations.union(pa.Table.from_pylist([blob, blob], pa.schema(collocations._FIELDS)), 1)
    frame, _ = collocations._spelled(langs, words, paths, lead)
    got = dict(zip(frame["phrase"], frame["f"]))
    assert got["x y z w"] == 16 and got["h x y z w"] == 2 and len(got) == 12 + 11 + 10 + 9 + 8


def test_scores_past_64_bits(spark):
    rows = [("u v w " * 3_000, "en")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert listed(collocations.collocations(docs, least=50)) == brute(rows, 50)


def test_no_row_between_steps_holds_a_slice(spark):
    draw = random.Random(5)
    rows = [(" ".join(f"{draw.choice('abcdefghij')}{draw.randrange(900)}" for _ in range(40_000)), "en") for _ in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    root = Path(store.shared_root(spark).removeprefix("file://"))
    old = set(root.rglob("*.parquet"))
    assert listed(collocations.collocations(docs, least=12)) == brute(rows, 12)
    chunks = [(g.column(i).total_uncompressed_size, g.num_rows) for p in set(root.rglob("*.parquet")) - old if p.is_file() for m in [pq.read_metadata(p)] for g in map(m.row_group, range(m.num_row_groups)) for i in range(m.num_columns)]
    assert chunks and max(size / max(1, n) for size, n in chunks) < 16_384  # a slice of 4 MB had its words in one row


def test_counts_of_more_than_a_byte_and_many_languages(spark):
    rows = [(prose(s, 400), "en") for s in range(30)] + [(f"a b c{s} a b", f"l{s}") for s in range(2_000)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    for least in (2, 255, 256, 300):
        want = brute(rows, least)
        assert want and listed(collocations.collocations(docs, least=least, range_words=3_000)) == want
