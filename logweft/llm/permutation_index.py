"""Nearest neighbours by inner product from a permutation index.

A vector is represented by the order in which a set of pivots is near to it: the `PREFIX` nearest pivots, the nearest
first. Equal vectors are indexed once, with as many of their ids as a result can show. The index is cut into blocks of
vectors by a hash; in a block each pivot has an inverted file that posts the vectors near to it with their places.
For a query, the files of its own nearest pivots give the footrule distance to every vector of the block (a pivot that
one side lacks counts as next after its prefix), the `SHARE` of the block's vectors with the smallest distance, and at
least `RERANK`, are ranked anew by their inner products in double precision, and each block hands on its best.

Pivots are fitted on a bounded sample: of the `SAMPLE` vectors with the smallest hash, `PIVOTS` are picked one by one,
each the least similar to those before. Everything else covers all vectors. Queries are searched against all vectors
in blocks of both; blocks grow with the table up to `LARGEST_BLOCK`, so the work is as for any search without a bound
on distances: queries times vectors. Recall on the given tables is 0.9 and more (a test; README has figures).

Defined cases: vectors that are null or zero, hold null or non-finite components, or aren't as long as most vectors
are (ties: the longer) take no part, neither do rows without an id. Repeated rows are one candidate, and a query each;
but for such rows, ids are taken to be unique. Ties of the score go to the smaller id. A table with fewer candidates gives all; an empty one gives no rows. Only the id
and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.store import field_type, materialize

PIVOTS, SAMPLE, PREFIX = 512, 4096, 64
SHARE, RERANK, NEAREST = 0.125, 512, 20
SMALLEST_BLOCK, LARGEST_BLOCK, QUERY_BLOCK = 1024, 1 << 15, 1 << 14


def usable(rows: DataFrame, vector: str, vec_id: str, is_query: Column) -> DataFrame:
    """vec_id, vector (doubles) and asked of the rows that take part, with two hashes of the vector."""
    known = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    sound = known.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    length = sound.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    same = sound.where(F.size("vector") == (length[0]["length"] if length else 0))
    return same.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")})


def distinct_vectors(rows: DataFrame, shown: int) -> DataFrame:
    """One row for each vector with its smallest ids, ``shown`` at most. A task sends no more than these of a vector, however often it has it."""
    by = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.withColumn("_n", F.dense_rank().over(by)).where(F.col("_n") <= shown)
    return few.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def pick_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` directions of the sample, each the least similar to those before it."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    near, out = np.full(len(unit), -np.inf), [0]
    for _ in range(min(n, len(unit)) - 1):
        near = np.maximum(near, unit @ unit[out[-1]])
        near[out[-1]] = np.inf
        out.append(int(near.argmin()))
    return unit[out]


class Index:
    """The inverted files of a block of vectors."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray):
        self.pivots, self.prefix = pivots, min(PREFIX, max(1, len(pivots) // 2))
        order = self.nearest(vectors)
        n = len(vectors)
        posted = np.argsort(order.ravel(), kind="stable")
        self.rows = posted // self.prefix  # by pivot, the vectors near to it
        self.place = (self.prefix - posted % self.prefix).astype(np.int32)  # the nearest has most
        self.at = np.searchsorted(order.ravel()[posted], np.arange(len(pivots) + 1))
        self.vectors, self.keep = vectors, min(n, max(RERANK, int(np.ceil(SHARE * n))))

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The pivots nearest to each vector, the nearest first."""
        near = np.empty((len(vectors), self.prefix), np.int32)
        for i in range(0, len(vectors), 4096):
            near[i : i + 4096] = np.argsort(-(vectors[i : i + 4096] @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix]
        return near

    def search(self, query: np.ndarray, own: np.ndarray, shown: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors (by place) that may be nearest, and their inner products.

        Footrule distance is twice what all places sum to, less what query and vector have in common at each pivot.
        """
        spans = [(self.at[p], self.at[p + 1], self.prefix - i) for i, p in enumerate(own.tolist())]
        rows = np.concatenate([self.rows[a:b] for a, b, _ in spans])
        common = np.concatenate([np.minimum(self.place[a:b], w) for a, b, w in spans])
        shared = np.bincount(rows, common, len(self.vectors))
        near = np.arange(len(shared))
        if self.keep < len(shared):
            least = np.partition(shared, len(shared) - self.keep)[len(shared) - self.keep]
            near = np.flatnonzero(shared >= least)  # ties are all ranked anew
        score = (self.vectors[near] * query).sum(axis=1)
        if len(score) > shown:
            best = score >= np.partition(score, len(score) - shown)[len(score) - shown]
            near, score = near[best], score[best]
        return near, score


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search_blocks(vectors: DataFrame, queries: DataFrame, pivots: np.ndarray, shown: int) -> DataFrame:
    """h1, h2 (of a query vector), vec_id and score: each block's best ``shown`` for each query."""

    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(base) and len(asked):
            index, ids = Index(_matrix(base["vector"]), pivots), base["ids"].to_pylist()
            points = _matrix(asked["vector"])
            orders, h1, h2 = index.nearest(points), asked["h1"].to_numpy(), asked["h2"].to_numpy()
            for q in range(len(points)):
                near, score = index.search(points[q], orders[q], shown)
                best = sorted((-s, i) for s, k in zip(score.tolist(), near.tolist()) for i in ids[k])[:shown]
                out[0].append(int(h1[q]))
                out[1].append(int(h2[q]))
                out[2].append([i for _, i in best])
                out[3].append([-s for s, _ in best])
        kinds = pa.int64(), pa.int64(), base.schema.field("ids").type, pa.list_(pa.float64())
        return pa.table([pa.array(x, kind) for x, kind in zip(out, kinds)], ["h1", "h2", "found", "scores"])

    kind = f"h1 bigint, h2 bigint, found {field_type(vectors, 'ids')}, scores array<double>"
    n, asked = vectors.count(), queries.count()
    size = min(LARGEST_BLOCK, max(SMALLEST_BLOCK, int(16 * n**0.5)))
    blocks, groups = 1 + n // size, 1 + asked // QUERY_BLOCK
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.select("ids", "vector", F.pmod("h1", F.lit(blocks)).cast("int").alias("block"), every(groups).alias("group"))
    right = queries.select("h1", "h2", "vector", every(blocks).alias("block"), F.pmod("h2", F.lit(groups)).cast("int").alias("group"))
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(run, kind)


def nearest(rows: DataFrame, is_query: Column, vector: str = "embedding", vec_id: str = "vec_id", k: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` found nearest to each row of which ``is_query`` holds, those of its own id left out."""
    marked = usable(rows, vector, vec_id, is_query)
    vectors = materialize(distinct_vectors(marked, k + 1), "vectors")
    asked = marked.where("asked")
    sample = vectors.orderBy("h2", "h1").select("vector").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    pivots = pick_pivots(_matrix(sample["vector"])) if len(sample) else np.zeros((0, 0))
    hits = search_blocks(vectors, asked.dropDuplicates(["h1", "h2"]), pivots, k + 1)
    hits = hits.select("h1", "h2", F.explode(F.arrays_zip("found", "scores")).alias("hit")).select("h1", "h2", F.col("hit.scores").alias("score"), F.col("hit.found").alias("vec_id"))
    by = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    best = best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))  # k + 1 at most
    found = asked.select("h1", "h2", F.col("vec_id").alias("query_id")).join(best, ["h1", "h2"])  # a hot vector's queries are split by the join
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = found.select("query_id", F.posexplode(others).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
