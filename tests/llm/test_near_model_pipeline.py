import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweft.llm import gated_network as gn
from logweft.llm import language_model as lm
from logweft.llm import near_dedup as nd
from tests.llm.edge import SCHEMA, EXTRA, WORD, edge_docs, lower, nothing, rows, sentence


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    name = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            name[root(i)] = min(d, name.get(root(i), d))
    return sorted(((d, len(s), name.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_dedup(df).collect()), key=str)


def test_near_dedup_of_edge_documents(spark):
    assert found(edge_docs(spark)) == brute_components([(r[0], r[1]) for r in rows()])
    assert nd.near_dedup(nothing(spark)).count() == 0
    got = nd.near_dedup(edge_docs(spark)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def near_copies(n, seed, words=80):
    """A chain-like group: each copy changes a word of the one before, and some of others."""
    out, now = [], sentence(seed, words).split(" ")
    for i in range(n):
        now = list(now)
        now[(7 * i) % words] = f"edit{seed}x{i}"
        out.append(" ".join(now))
    return out


@pytest.mark.parametrize("crowd, shingles, sought", [(256, 1 << 21, 1 << 20), (8, 1 << 21, 1 << 20), (8, 100, 0), (256, 100, 1 << 20)])
def test_near_dedup_of_groups(spark, monkeypatch, crowd, shingles, sought):
    monkeypatch.setattr(nd, "CROWD", crowd)
    monkeypatch.setattr(nd, "PART_SHINGLES", shingles)
    monkeypatch.setattr(nd, "SOUGHT", sought)
    base = sentence(9, 100).split(" ")
    star = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(0, 100, 2)]
    texts = near_copies(25, 1) + near_copies(25, 2) + star + [sentence(100 + i, 60) for i in range(40)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "en", "a", 1, *EXTRA) for d, t in docs], SCHEMA).repartition(3)
    assert found(df) == brute_components(docs)


def test_many_repeats_of_a_pair(spark):
    """1,000 rows of each text of a pair under its doc_id: one set a class, one link, and every row comes back."""
    base = sentence(21, 120).split(" ")
    texts = {5: " ".join(base), 3: " ".join([*base[:60], "other", *base[61:]]), 8: sentence(22, 60)}
    df = spark.createDataFrame([(d, t) for d, t in texts.items() for _ in range(1000)], "doc_id bigint, text string").repartition(4)
    got = Counter(tuple(r) for r in nd.near_dedup(df).collect())
    assert got == {(d, len(shingles(t)), 8 if d == 8 else 3, d != 5): 1000 for d, t in texts.items()}
    classes = spark.createDataFrame([(d, nd._set_digest(nd.shingle_sets(pa.array([t]))[0])) for d, t in texts.items()], "class_id bigint, set_digest binary")
    pairs = spark.createDataFrame([(3, 5)], "a bigint, b bigint")
    sets = nd.full_sets(pairs, classes, df)
    assert sorted(r[0] for r in sets.select("class_id").collect()) == [3, 5]
    assert nd.confirm(pairs, sets).count() == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_shingles_by_brute_force(spark, parts):
    draw = np.random.default_rng(9)
    sets = [np.unique(draw.integers(-(2**62), 2**62, 200).tolist() + draw.integers(0, 500, 60).tolist()) for _ in range(40)]
    df = spark.createDataFrame([(s.tolist(),) for s in sets], "shingles array<bigint>").repartition(parts)
    n = Counter(int(x) for s in sets for x in s)
    every = np.array(list(n), np.int64)
    bits = nd.repeated_shingles(df, sum(map(len, sets)))
    may = dict(zip(every.tolist(), nd._may_repeat(every, bits)))
    assert all(may[x] for x, k in n.items() if k > 1)
    single = [may[x] for x, k in n.items() if k == 1]
    assert np.mean(single) < 0.2
    assert nd.repeated_shingles(df, 1 << 40) is None and nd._may_repeat(every, None).all()
    assert not nd._may_repeat(every, nd.repeated_shingles(df.limit(0), 0)).any()


def crowded(n=3000, every=20, own=20):
    """Texts that share a passage (similarity about 0.68), and among them isolated pairs at 0.76 or so, far apart by id."""
    passage, texts = [f"shared{k}" for k in range(90)], []
    for i in range(n):
        texts.append([*passage, *(f"own{i}x{k}" for k in range(own))])
    for i in range(0, n // 2, every):
        texts[n - 1 - i] = [*texts[i][:96], *texts[n - 1 - i][96:]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("parts", [1, 16])
def test_isolated_pairs_in_a_crowded_region(spark, parts):
    docs = crowded()
    sets = [shingles(t) for _, t in docs[:21]]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert 0.66 < alike(sets[1], sets[2]) < 0.74 and 0.75 <= alike(sets[0], shingles(docs[-1][1])) < 0.78
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mate = {len(docs) - 1 - i: i for i in range(0, len(docs) // 2, 20)}
    assert got == {d: mate.get(d, d) for d, _ in docs}


def test_regions_cut_over_tasks_are_named_whole(spark):
    rows = [(0, b"same" * 4, i, bytes(nd.HASHES)) for i in range(6)] + [(1, b"%04d" % i * 4, i, bytes(nd.HASHES)) for i in range(6)]
    orders = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "tree tinyint, key binary, class_id bigint, brief binary")
    assert orders.rdd.glom().map(len).collect() == [3] * 4
    named = nd.forest_candidates(orders).where("kind = 3").groupBy("part").agg(F.sort_array(F.collect_set("a")).alias("a")).where("size(a) > 1").collect()
    assert [r["a"] for r in named] == [[0, 1, 2, 3, 4, 5]]


def test_keep_one_of_each_group(spark):
    docs = edge_docs(spark)
    kept = nd.keep_one(docs, nd.near_dedup(docs))
    assert kept.columns == docs.columns
    names = {c for _, _, c in brute_components([(r[0], r[1]) for r in rows()])}
    assert {r[0] for r in kept.select("doc_id").collect()} == names
    assert kept.where("doc_id is not null").count() == len(names - {None})


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in nd.components(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000, 1002: 1000}


def test_base_scores_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(r[0], r[1]) for r in rows() if r[0] is None or r[0] > 12], "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id") + 10**6))
    got = lm.score_documents(docs).collect()
    texts = [(r["doc_id"], WORD.findall(lower(r["text"])) + [None]) for r in docs.collect()]
    key = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10
    c = Counter(w for d, ws in texts if key(d) for w in ws)
    total, distinct = sum(c.values()), len(c)
    want = sorted(((str(d), len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)) for d, ws in texts))
    have = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    assert [x[3] for x in have] == pytest.approx([x[3] for x in want], rel=1e-9)
    assert {r["train_tokens"] for r in got} == {total}
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_nothing(spark):
    assert lm.score_documents(nothing(spark)).count() == 0


def test_scores_token_by_token(spark, small):
    """The model's formulas in double precision, one token after another, against the windows and lanes of `score`."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "qqzz unheard-of words, Qqzz")], "doc_id bigint, text string"))
    coded, counts, model = lm.learn(docs)
    net, count = model.network(), {r["word"] % 2**64: r["n"] for r in counts.collect()}
    v = {k: x.astype(float) for k, x in net.views.items()}
    want = {}
    for d, text in docs.collect():
        if d % 25 and d >= 0:
            continue
        words, codes, hashed, ending = lm.coded_words(pa.array([text]))
        units = np.append(model.lexicon.units(hashed, ending)[codes] if len(codes) else [], 0).astype(int)
        own = [count.get(int(hashed[c]), 0) for c in codes] + [0]
        h, given, total = np.zeros(net.hidden), net.begin, 0.0
        for u, n in zip(units, own):
            x = v["embed"][given] @ v["enter"][:-1] + v["enter"][-1]
            z, r = np.split(1 / (1 + np.exp(-(x[: 2 * net.hidden] + h @ v["gates"]))), 2)
            h = (1 - z) * h + z * np.tanh(x[2 * net.hidden :] + (r * h) @ v["inner"])
            cls = int(model.cls[u])
            for name, at, place in (("out", slice(None), cls), ("slots", slice(net.first[cls], net.first[cls + 1]), int(model.slot[u]))):
                o = h @ v[name][:-1, at] + v[name][-1, at]
                total += (o[place] - np.log(np.exp(o).sum())) / math.log(10)
            if u >= lm.TOP:
                total += math.log10(n + 0.1) - model.log_rest[cls]
            given = u
        want[d] = total
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    assert len(want) > 8
    assert [got[d] for d in want] == pytest.approx(list(want.values()), rel=1e-4)


def test_training_beats_the_untrained_network(spark, small):
    sf = os.path.join(os.path.dirname(small), "sf0.01")
    if not os.path.isdir(sf):
        pytest.skip("needs the middle table set")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    coded, counts, model = lm.learn(docs)
    weight, kinds = lm.unit_weights(model.lexicon, counts)
    fresh = lm.Model.start(model.lexicon, lm.neighbour_counts(coded.where("round >= 0")), weight, kinds)
    held, mean = coded.where("round = -1"), F.sum("model_log") / F.sum("n_tokens")
    before, after = (lm.score_texts(held, m).agg(mean).first()[0] for m in (fresh, model))
    assert after > before + 0.35


def test_every_training_text_trains(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    coded, counts, model = lm.learn(docs)
    learned = [r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 10]
    assert sorted(r["doc_id"] for r in coded.where(F.col("round").between(0, lm.ROUNDS - 1)).collect()) == sorted(learned)
    assert coded.where("round >= 0").agg(F.sum("n_tokens")).first()[0] == model.lexicon.tokens == counts.agg(F.sum("n")).first()[0]


def test_neighbours_by_brute_force():
    draw = np.random.default_rng(2)
    ends = np.cumsum(draw.integers(1, 9, 40))
    units = draw.choice([0, 1, 5, 127, 128, 3000], ends[-1]).astype(np.uint16)
    want = Counter()
    for a, b in zip(np.append(0, ends), ends):
        for i in range(a, b):
            for j in range(max(a, i - 3), min(b, i + 4)):
                if i != j and units[j] < lm.NEIGHBOURS:
                    want[int(units[i]), int(units[j])] += 1
    got = lm.count_neighbours(units, ends)
    assert {(int(i), int(j)): int(got[i, j]) for i, j in zip(*np.nonzero(got))} == want


def network(seed=0):
    counts = [np.array([5.0]), np.array([3.0, 2.0, 9.0]), np.array([1.0, 4.0])]
    return gn.Network([0, 1, 1, 1, 2, 2], [0, 0, 1, 2, 0, 1], [1, 3, 2], hidden=5, embedded=4).start(counts, seed)


def test_slots_share_all_probability():
    net = network()
    for scale in (0.5, 60):  # with large weights the softmax takes the maximum off first
        net.flat += np.random.default_rng(3).normal(0, scale, len(net.flat)).astype(np.float32)
        states = np.random.default_rng(4).uniform(-1, 1, (6, 6)).astype(np.float32)
        states[:, -1] = 1
        total = sum(np.exp(net._logs(states, np.full(6, unit))[0]) for unit in range(6))
        assert total == pytest.approx(np.ones(6), rel=1e-5)


def test_scores_don_t_depend_on_lanes_or_windows(monkeypatch):
    net = network()
    draw = np.random.default_rng(5)
    ends = np.cumsum(draw.integers(1, 60, 30))
    units = draw.integers(0, 6, ends[-1])
    want = None
    for lanes, window, settled in ((1, 1, 1), (4, 16, 100), (64, 7, 10**6)):
        monkeypatch.setattr(gn, "SETTLED", settled)
        got = net.score(gn.lay_out(units, ends, lanes), window)
        want = got if want is None else want
        assert got == pytest.approx(want, rel=1e-4)


def test_gradient_by_differences():
    net = network(2)
    draw = np.random.default_rng(6)
    net.flat += draw.normal(0, 0.3, len(net.flat)).astype(np.float32)
    ends = np.array([6, 12, 16])
    units = draw.integers(0, 6, 16)
    lanes = gn.lay_out(units, ends, 2)
    given, unit, _, begins, real = next(lanes.windows(20, net.begin))
    assert not real.all()
    before, slope = net.flat.copy(), net.gradient(given, unit, begins, real, np.zeros((2, 5), np.float32))[1]
    for i in range(0, len(before), 2):
        loss = []
        for d in (1e-2, -1e-2):
            other = gn.Network(net.cls, net.slot, net.sizes, 5, 4, before)
            other.flat[i] += d
            loss.append(-other.score(lanes).sum())
        assert slope[i] == pytest.approx((loss[0] - loss[1]) / 2e-2, rel=0.02, abs=5e-3), i


def test_training_learns_a_pattern():
    net = network(1)
    units = np.tile([3, 4, 3, 3, 4, 0], 400)
    lanes = gn.lay_out(units, np.arange(6, len(units) + 1, 6), 16)
    before = net.score(lanes).sum()
    for _ in range(20):
        net.train(lanes, rate=0.02)
    assert net.score(lanes).sum() > 0.3 * before


def test_pipeline_against_brute_force(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    from logweft.llm import language_id, source_mixing
    from logweft.llm.store import materialize
    from tests.llm.edge import squeezed

    docs = materialize(spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "12 34 !", "en", "src0", 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint")), "t")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "sentencepiece"]
    stages = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, small), name)
        stages[name] = docs
        if name != "sentencepiece":
            assert docs.columns == before.columns
    texts = {r["doc_id"]: r["text"] for r in stages["language_id"].collect()}
    named = {r["doc_id"] for r in language_id.identify(spark.read.parquet(f"{small}/documents.parquet")).where("lang_pred <> 'und' and score >= 0.3").collect()}
    assert set(texts) == named
    best = {}
    for d, t in texts.items():
        best[squeezed(t)] = min(best.get(squeezed(t), (0, 10**9)), (-len(t), d))
    assert {r["doc_id"] for r in stages["exact_dedup"].collect()} == {d for _, d in best.values()}
    left = [(r["doc_id"], r["text"]) for r in stages["exact_dedup"].collect()]
    assert {r["doc_id"] for r in stages["near_dedup"].collect()} == {c for _, _, c in brute_components(left)}
    mixed = source_mixing.mix(stages["near_dedup"])
    want = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixed.where("taken > 0").collect()}
    assert Counter(r["doc_id"] for r in stages["source_mixing"].collect()) == want
    last = stages["sentencepiece"]
    assert last.count() == sum(want.values()) and last.where("not round_trip").count() == 0


def test_shingle_sets_by_brute_force():
    texts = [r[1] for r in rows()]
    assert [len(s) for s in nd.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("empty", [True, False])
def test_stages_take_odd_tables(spark, small, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    from logweft.llm.store import materialize

    docs = materialize(nothing(spark) if empty else edge_docs(spark), "odd")
    columns, sizes = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), name)
        sizes.append(docs.count())
        assert name == "sentencepiece" or docs.columns == columns
    if empty:
        assert sizes == [0] * 5
    else:
        letters = sum(any(map(str.isalpha, r[1] or "")) for r in rows())
        assert sizes[0] <= letters and sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[4] == sizes[3]
        assert docs.where("not round_trip").count() == 0
