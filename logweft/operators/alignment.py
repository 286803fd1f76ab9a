"""Two sessions side by side: which steps both have, and which one added, left out or moved.

Shapes of messages that come once in each session are anchors. The longest chain of anchors that are in the same order
in both holds the sessions together; anchors off the chain have moved. Between two neighbours of the chain, other steps
are matched by shape, the first with the first. What is left over on both sides with the same shape has moved, too, the
rest is missing (in the first session alone) or added (in the second).

Only anchors meet in one task, as arrays of two numbers each: one for each shape at most, and shapes are what a program's
log statements differ in, not its events. Steps are dealt by shape and gap, and their gap is looked up in the chain.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def longest_chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The places of the longest chain that rises in both; of equally long ones, the one that ends lowest in the second."""
    order = np.argsort(first, kind="stable")
    tails: list[int] = []
    at: list[int] = []
    before = np.full(len(order), -1)
    for i, value in enumerate(second[order].tolist()):
        k = bisect_left(tails, value)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(value)
            at.append(i)
        else:
            tails[k], at[k] = value, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return order[np.array(out[::-1], np.int64)]


def align(first: DataFrame, second: DataFrame, step: str = "step", shape: str = "shape") -> DataFrame:
    """side (1 or 2), step, shape, change (same, moved, missing or added) and other_step (in the other session, if it has one) of every step.

    Steps are numbered without repetition within a session (`metrics.trace_steps`); null shapes are one shape.
    """
    both = _together(first, second, step, shape)
    once = both.groupBy("shape").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"), F.max(F.when(F.col("side") == 1, F.col("step"))).alias("p1"), F.max(F.when(F.col("side") == 2, F.col("step"))).alias("p2"))
    anchors = once.where("n1 = 1 AND n2 = 1").select("p1", "p2").toArrow()  # a row for each shape at most
    p1, p2 = anchors["p1"].to_numpy(), anchors["p2"].to_numpy()
    chain = longest_chain(p1, p2)
    posts = {1: np.sort(p1[chain]), 2: np.sort(p2[chain])}

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side, at = b.column("side").to_numpy(), b.column("step").to_numpy()
            left = np.where(side == 1, np.searchsorted(posts[1], at, "left"), np.searchsorted(posts[2], at, "left"))
            right = np.where(side == 1, np.searchsorted(posts[1], at, "right"), np.searchsorted(posts[2], at, "right"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(left + right)], [*b.schema.names, "gap"])  # odd: on the chain itself

    placed = both.mapInArrow(gaps, "side int, step bigint, shape string, gap bigint")
    matched = _matched(placed, ["shape", "gap"])
    kept = matched.where("other_step IS NOT NULL").withColumn("change", F.lit("same"))
    moved = _matched(matched.where("other_step IS NULL").drop("other_step"), ["shape"])
    alone = F.when(F.col("side") == 1, "missing").otherwise("added")
    moved = moved.withColumn("change", F.when(F.col("other_step").isNotNull(), "moved").otherwise(alone))
    columns = ("side", "step", "shape", "change", "other_step")
    return kept.select(*columns).unionByName(moved.select(*columns))


def _together(first: DataFrame, second: DataFrame, step: str, shape: str) -> DataFrame:
    one, two = (d.select(F.lit(k).alias("side"), F.col(step).cast("bigint").alias("step"), F.coalesce(F.col(shape), F.lit("")).alias("shape")) for k, d in ((1, first), (2, second)))
    return one.unionByName(two)


def _matched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with other_step: the step of the other side with the same keys and the same rank among them."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("side", *keys).orderBy("step")))
    other = ranked.select((3 - F.col("side")).alias("side"), *keys, "_n", F.col("step").alias("other_step"))
    return ranked.join(other, ["side", *keys, "_n"], "left").drop("_n")
