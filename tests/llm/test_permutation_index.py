import math

import numpy as np
from pyspark.sql import functions as F

from logweft.llm import permutation_index, queries


def exact(rows, asked, k):
    """All neighbours by the exact product: {query_id: [(score, vec_id), ...]}."""
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in sound:
        if asked(i):
            out[i] = sorted((-float((v * w).sum()), j) for j, w in {(j, tuple(w)): w for j, w in sound}.items() if j[0] != i)[:k]
            out[i] = [(-s, j[0]) for s, j in out[i]]
    return out


def test_recall_and_form(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, got = exact(rows, lambda i: i % 20 == 0, 20), {}
    found = queries.op11_nearest_neighbours(spark, small)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want) and all(len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[0], x[1])) for q in want)
    vectors = {i: np.array(v, float) for i, v in rows}
    assert all(abs(s - float((vectors[q] * vectors[i]).sum())) < 1e-12 for q, found in got.items() for s, i in found)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_many_blocks_find_what_one_does(spark, monkeypatch):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 24))
    vectors = centres[draw.integers(0, 30, 3000)] + 0.3 * draw.normal(size=(3000, 24))
    vectors *= draw.uniform(0.5, 2, (3000, 1))  # lengths differ, so the largest product isn't the smallest angle
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    monkeypatch.setattr(permutation_index, "SMALLEST_BLOCK", 300)
    monkeypatch.setattr(permutation_index, "LARGEST_BLOCK", 300)
    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", 40)
    monkeypatch.setattr(permutation_index, "RERANK", 64)
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = {}
    for r in permutation_index.nearest(docs, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_copies_ties_and_rows_that_take_no_part(spark):
    odd = [(None, [1.0, 0.0]), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (105, [None, 1.0]), (106, [1.0]), (107, [])]
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(i, [0.5, 1.0 + i]) for i in range(60, 64)] + odd
    rows.append(rows[3])
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, n int, score string")
    want = exact([r for r in rows if r[0] != 106], lambda i: i % 20 == 0, 20)
    got = {}
    for r in permutation_index.nearest(docs, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == want
    assert permutation_index.nearest(docs.limit(0), F.lit(True)).collect() == []
    alone = permutation_index.nearest(docs.where("vec_id IN (60, 61)"), F.lit(True)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in alone) == [(60, 1, 61), (61, 1, 60)]
