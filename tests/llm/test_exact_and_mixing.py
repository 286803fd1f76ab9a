import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweft.llm import exact_dedup as ed
from logweft.llm import source_mixing as sm
from tests.llm.edge import WORD, edge_docs, listed, nothing, rows, squeezed


def brute_groups(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(squeezed(t), []).append((d, t))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        out += [(d, keep, len(own), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("history", ["none", "half", "all"])
def test_exact_dedup_is_the_same_for_any_history(spark, history):
    mark = {"none": F.lit(False), "half": None, "all": F.lit(True)}[history]
    got = ed.exact_dedup(edge_docs(spark), mark).drop("in_history")
    assert listed(got) == brute_groups([(r[0], r[1]) for r in rows()])


def test_exact_dedup_of_nothing(spark):
    assert ed.exact_dedup(nothing(spark)).count() == 0


def test_keep_first_keeps_columns_and_one_of_repeats(spark):
    docs = edge_docs(spark)
    kept = ed.keep_first(docs, ed.exact_dedup(docs))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.select("doc_id").collect()) == sorted({k if k is not None else -1 for _, k, *_ in brute_groups([(r[0], r[1]) for r in rows()])})


def test_perfect_hash_is_minimal_and_checked():
    draw = np.random.default_rng(0)
    digests = np.unique(draw.integers(0, 256, (5000, 32), dtype=np.uint8), axis=0)
    hashed = ed.PerfectHash.from_bytes(ed.PerfectHash.build(digests).to_bytes())
    assert sorted(hashed.slots(digests)) == list(range(len(digests)))
    same_half = digests[:3].copy()
    same_half[:, 16:] = 0  # equal in all that is hashed
    several = np.concatenate([digests[:3], same_half])
    assert sorted(ed.PerfectHash.from_bytes(ed.PerfectHash.build(several).to_bytes()).slots(several)) == list(range(6))


def brute_mix(docs, weights=(5, 2, 1), most=3):
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size(t) for _, t, x in docs if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    left = sum(words.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= most * words[s]}
        for s in over:
            target[s] = float(most * words[s])
            left -= most * words[s]
            open_.discard(s)
        if not over:
            break
    return target | (share if open_ else {}), words


def test_mixing_meets_each_budget(spark):
    docs = [(r[0], r[1], r[3]) for r in rows()]
    target, words = brute_mix(docs)
    got = sm.mix(edge_docs(spark)).collect()
    assert len(got) == len(docs)
    for s in words:
        own = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in own) == words[s] == own[0]["source_size"]
        assert own[0]["target"] == pytest.approx(target[s])
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 1e-9)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert listed(sm.mix(edge_docs(spark))) == sorted(map(tuple, got), key=str)  # reruns agree


def test_mixing_a_limited_source(spark):
    docs = [(i, "w " * 10, "a") for i in range(2)] + [(9 + i, "w " * 100, "b") for i in range(10)] + [(50, "w " * 200, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    target, _ = brute_mix(docs)
    got = {r["source"]: r["target"] for r in sm.mix(df).collect()}
    assert got == pytest.approx(target) and got["a"] == 60


def test_drawn_documents_have_the_words_taken(spark):
    docs = edge_docs(spark)
    mixed = sm.mix(docs)
    drawn = sm.draw(docs, mixed)
    assert drawn.columns == docs.columns
    count = lambda df, c: {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(c)).collect()}
    words = drawn.withColumn("n", F.size(F.filter(F.split("text", "[\x20\x09-\x0d]+"), lambda w: w != "")))
    assert count(words, "n") == {s: n for s, n in count(mixed, "taken").items() if n}


def test_names_that_clash(spark):
    docs = edge_docs(spark).selectExpr("doc_id", "text", "lang", "source", "1 as _SHA", "2 as _nth_row", "3 as _size", "4 as _taken", "5 as row", "6 as share", "7 as nth", "8 as id", "'f' as `from`", "9 as words")
    kept = ed.keep_first(docs, ed.exact_dedup(docs))
    assert kept.columns == docs.columns and kept.count() == ed.keep_first(edge_docs(spark), ed.exact_dedup(edge_docs(spark))).count() > 0
    drawn = sm.draw(docs, sm.mix(docs))
    assert drawn.columns == docs.columns
    mine = [r[:14] for r in (tuple(r) for r in drawn.collect())]
    assert mine and {r[4:] for r in mine} == {(1, 2, 3, 4, 5, 6, 7, 8, "f", 9)}


def test_rows_without_an_id_are_drawn_by_source_and_size(spark):
    """A third of the rows and more have no doc_id: every source still gets its words, and no text takes another's share."""
    rows = [(None, " ".join(f"n{i}x{k}" for k in range(i % 7 + 1)), "ab"[i % 2]) for i in range(60)] + [(i, "one two three", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    mixed = sm.mix(docs)
    want = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = sm.draw(docs, mixed).collect()
    for s, n in want.items():
        assert sum(len(r["text"].split()) for r in got if r["source"] == s) == n


def test_mixing_of_nothing(spark):
    assert sm.mix(nothing(spark)).count() == 0
    assert zlib.crc32(b"") == 0
