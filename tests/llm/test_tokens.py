import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweft.llm import sentencepiece_codec as sc
from logweft.llm import token_counts as tc
from logweft.llm import token_files as tf
from logweft.llm.pieces import PLACEHOLDER, load_vocabulary, vocabulary_path
from tests.llm.edge import edge_docs, listed, nothing, rows

ODD = ["", None, "  a  b ", "\n\n", "x\ty z\r\n日本 語", "\x00\x7f", "don't STOP's!'s a.b,c  É.x É. ", "≠ a≠b x y 12a3.b —.a—", "it's 'S 'LL ab'd.c İ KK!s", "<|endoftext|>x A<|b", "ÀÉ x́", " ", "🙂🙂 a🙂b"]


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The library with the same pieces as a unigram model, placeholders floored so that its float sums are exact."""
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(vocabulary_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    lowest = min(p.score for p in model.pieces if p.type == 1 and p.score > PLACEHOLDER)
    for p in model.pieces:
        if p.score <= PLACEHOLDER:
            p.score = lowest - 1
    return sp.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_codec_and_counts_agree_with_the_library(library, spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + ODD
    own, counter = sc.codec(vocabulary_path()), tc.counter(vocabulary_path())
    ids, at = own.encode(pa.array(texts))
    n, score = counter.count_texts(pa.array(texts))
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert ids[at[i] : at[i + 1]].tolist() == want, t
        assert n[i] == len(want)
    words = texts[0].split()[:80]
    assert counter.count_texts(pa.array(words))[1] == pytest.approx([sum(map(library.get_score, library.encode(w))) for w in words])


def test_words_in_any_order_and_a_full_cache(monkeypatch):
    words = [w for t in ODD for w in (t or "").split(" ")] + ["the", "then", "there", "thermal", "a", "the"]
    fresh = [sc.Codec(vocabulary_path()).encode(pa.array([w]))[0].tolist() for w in words[:8]]
    own = sc.Codec(vocabulary_path())
    monkeypatch.setattr(sc, "CACHE_BYTES", 3 * sc.WORD_COST)
    monkeypatch.setattr(sc, "OPEN_DEPTH", 3)
    random.Random(3).shuffle(words)
    for w in words:
        own.encode(pa.array([w]))
    assert [own.encode(pa.array([w]))[0].tolist() for w in [w for t in ODD for w in (t or "").split(" ")][:8]] == fresh


@pytest.mark.parametrize("depth", [1, 4, 256])
def test_prefixes_deeper_than_the_open_nodes(monkeypatch, depth):
    monkeypatch.setattr(sc, "OPEN_DEPTH", depth)
    stem = "internationalisation" * 3
    words = sorted(["▁" + stem[:k] + end for k in (3, 9, 20, 41, 60) for end in ("", "ally", "é", "zq")])
    vocabulary = load_vocabulary(vocabulary_path())
    search = sc.PrefixViterbi(vocabulary)
    assert [list(search.encode(w)) for w in words] == [list(sc.PrefixViterbi(vocabulary).encode(w)) for w in words]


def test_an_unbroken_run_takes_bounded_state():
    """Twelve bytes of state a character; Python's own peak, with the run and its ids, stays under 60."""
    run = "abcdefghij" * 100_000
    own = sc.Codec(vocabulary_path())
    tracemalloc.start()
    ids, at = own.encode(pa.array([run]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.decode(ids, at)[0].tobytes().decode() == run
    assert peak < 60 * len(run)
    assert not own.at or own.cost <= sc.CACHE_BYTES


def test_round_trip_of_every_text(spark):
    docs = edge_docs(spark)
    got = sc.round_trip(docs).collect()
    assert len(got) == len(rows()) and all(r["same"] for r in got)
    coded = sc.decode(sc.encode(docs))
    assert [c for c in coded.columns if c not in ("piece_ids", "decoded")] == docs.columns
    assert coded.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    crc = {(r["doc_id"], r["n_pieces"]): r["ids_crc32"] for r in got}
    for r in coded.select("doc_id", "piece_ids").collect():
        assert crc[r["doc_id"], len(r["piece_ids"])] == zlib.crc32(np.array(r["piece_ids"], "<u4").tobytes())
    assert sc.round_trip(nothing(spark)).count() == 0


def test_decoding_odd_ids(spark):
    df = spark.createDataFrame([([-1, 99_999_999],), (None,), ([3 + 0xE6],)], "piece_ids array<int>")
    assert [r[1] for r in sc.decode(df).collect()] == ["", "", "�"]


def test_counts_of_edge_documents(spark):
    got = [(str(r["doc_id"]), r["n_pieces"]) for r in tc.token_counts(edge_docs(spark)).collect()]
    coded = [(str(r["doc_id"]), len(r["piece_ids"])) for r in sc.encode(edge_docs(spark)).collect()]
    assert sorted(got) == sorted(coded)
    assert tc.token_counts(nothing(spark)).count() == 0


def test_no_piece_spans_a_cut():
    vocabulary = load_vocabulary(vocabulary_path())
    for piece in vocabulary.pieces:
        raw = piece.replace("▁", " ").encode()
        assert all(vocabulary.joined[a, b] for a, b in zip(raw, raw[1:]))


def brute_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tf.tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_pieces_encode_as_whole_texts():
    own = tf.PieceEncoder(tf.tokenizer_path())
    for texts in (ODD, ODD[:-4]):
        ids, n = own.encode(pa.array(texts))
        want = brute_ids(texts)
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_token_files(spark, tmp_path):
    docs = [r for r in rows() if r[0] is not None][:-1]
    files = tf.write_tokens(edge_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]), folder=f"file://{tmp_path}/t")
    got = sorted(map(tuple, files.read(tf.ids_crc32).collect()))
    start, want = 0, []
    for (d, *_), ids in zip(docs, brute_ids([r[1] for r in docs])):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    stream = [i for ids in brute_ids([r[1] for r in docs]) for i in ids]
    found = []
    for name in sorted(os.listdir(tmp_path / "t")):
        reader = tf.SequenceReader(f"file://{tmp_path}/t/{name}")
        assert reader.file.schema.field("tokens").type == pa.list_(pa.uint16(), tf.SEQUENCE)
        for b in range(reader.file.num_record_batches):
            for i in range(b * tf.BATCH_SEQUENCES, b * tf.BATCH_SEQUENCES + reader.file.get_batch(b).num_rows):
                tokens, mask = reader.sequence(i)
                assert len(tokens) == len(mask) == tf.SEQUENCE
                found += [t for t, m in zip(tokens.to_pylist(), mask.to_pylist()) if m]
    assert found == stream


def test_token_files_of_odd_tables(spark):
    assert tf.write_tokens(nothing(spark)).read(tf.ids_crc32).count() == 0
    repeated = tf.write_tokens(edge_docs(spark)).read(tf.ids_crc32)
    assert repeated.count() == len(rows())
    spans = sorted((r["start"], r["n_tokens"]) for r in repeated.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert listed(repeated.select("n_tokens")) == sorted(((len(x),) for x in brute_ids([r[1] for r in rows()])), key=str)


def test_a_hot_doc_id_spreads_over_files(spark):
    """A third of the rows without an id, and a third with one and the same text: in order, again the same, and no file has most of them."""
    table = [(None, f"text {i}") for i in range(400)] + [(7, "copies")] * 400 + [(i, f"own {i}") for i in range(400)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        first, again = (tf.write_tokens(docs) for _ in range(2))
        spread = first.spans.groupBy("doc_id").agg(F.countDistinct("part").alias("files")).where("doc_id is null or doc_id = 7").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == 2 and min(r["files"] for r in spread) > 1
    got, other = (sorted((r["start"], r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["value"]) for r in x.read(tf.ids_crc32).collect()) for x in (first, again))
    assert got == other and [r[1:3] for r in got] == sorted(r[1:3] for r in got) and len(got) == len(table)
