"""Which buckets of a stored timeline may hold a text: postings of three-letter grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.functions.literals import folded
from logweft.operators.filters import searchable

SCHEMA = "gram int, bucket bigint"
#: A task keeps the marks of so many buckets (256 KB each) before it hands them on.
OPEN_BUCKETS = 64


def number(gram: str) -> int:
    a, b, c = gram.encode()
    return a << 14 | b << 7 | c


def _numbers(texts: pa.Array) -> np.ndarray:
    """The grams of all texts; those over a text's border or with other than ASCII bytes are left out."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.int32)
    if len(data) < 3:
        return np.zeros(0, np.int32)
    ends = np.zeros(len(data) + 1, bool)
    ends[at - at[0]] = True
    fine = (data[:-2] < 128) & (data[1:-1] < 128) & (data[2:] < 128) & ~ends[1:-2] & ~ends[2:-1]
    return (data[:-2] << 14 | data[1:-1] << 7 | data[2:])[fine]


def postings(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """gram and bucket of all events (with their ``bucket``) and of the ``known`` postings, each pair once, sorted by gram so that a look-up reads little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for bucket, bits in marks.items():
                found = np.flatnonzero(np.unpackbits(bits)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), bucket))], ["gram", "bucket"])
            marks.clear()

        for b in batches:
            bucket = b.column("bucket").to_numpy(zero_copy_only=False)
            for own in np.unique(bucket):
                seen = np.zeros(1 << 21, bool)
                seen[_numbers(b.column("hay").filter(pa.array(bucket == own)))] = True
                packed = np.packbits(seen)
                marks[int(own)] = marks[int(own)] | packed if int(own) in marks else packed
            if len(marks) > OPEN_BUCKETS:
                yield from out()
        yield from out()

    pairs = events.select("bucket", folded(searchable()).alias("hay")).mapInArrow(run, SCHEMA)
    pairs = (pairs if known is None else pairs.unionByName(known.select("gram", "bucket"))).distinct()
    return pairs.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket")


def found(index: DataFrame, grams: set[str]) -> dict[int, set[str]]:
    """By bucket, which of the grams it has. Only these grams' postings are read."""
    names = {number(g): g for g in grams}
    rows = index.where(F.col("gram").isin(sorted(names))).groupBy("bucket").agg(F.collect_set("gram").alias("grams"))  # as many as the filter has
    return {r["bucket"]: {names[g] for g in r["grams"]} for r in rows.collect()}
