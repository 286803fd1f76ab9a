"""Exact deduplication against a history that a minimal perfect hash indexes.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. The history's distinct
digests are cut into shards, and each shard gets a minimal perfect hash whose slots hold the full 32-byte digest
and a locator of the winning row. A later row is looked up in its shard; the digest in the slot is compared byte
for byte, so a slot that belongs to another text never matches. Members join the history's group; nonmembers
are grouped among themselves.

Defined cases: a null text counts as empty, and all empty or blank texts are equal. Of equal texts the row with
the most code points stays, then the smallest doc_id, a null doc_id last. Rows repeated with the same doc_id and
text are both marked as kept by `exact_dedup`; `keep_first` returns one of them. An empty table gives no rows.
Other columns are never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.llm.store import broadcast_if_small, field_type, free_name, materialize
from logweft.llm.text import code_points, flat, mix64, per_text, slices, SPACE

SHARD_DIGESTS = 50_000
GAMMA = 1.5
LEVELS = 40


def text_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, digest (SHA-256 of the normalised UTF-8 text), n_points (code points of the original)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, at = flat(b.column("text"))
            solid = ~SPACE[data]
            kept = np.zeros(len(data) + 1, np.int64)
            np.cumsum(solid, out=kept[1:])
            own, cut = memoryview(np.ascontiguousarray(data[solid])), kept[at].tolist()
            found = [hashlib.sha256(own[i:j]).digest() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary()), pa.array(per_text(code_points(data), at))], ["doc_id", "digest", "n_points"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(digest, f"doc_id {field_type(docs, doc_id)}, digest binary, n_points bigint")


class PerfectHash:
    """Minimal perfect hash over distinct digests: cascaded bit levels, each holding the keys that are alone in their place."""

    def __init__(self, levels: list[np.ndarray], rest: dict[bytes, int]):
        self.levels, self.rest = levels, rest
        ones = [np.cumsum(x, dtype=np.int64) for x in levels]
        base = np.cumsum([0] + [int(c[-1]) for c in ones])
        self.ranks = [c - 1 + b for c, b in zip(ones, base)]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys[:, 0] ^ mix64(keys[:, 1], level), level) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """``digests``: n x 32 bytes, all distinct."""
        keys, levels = digests[:, :16].copy().view(np.uint64), []
        left = np.arange(len(keys))
        while len(left) and len(levels) < LEVELS:
            size = max(8, math.ceil(GAMMA * len(left)))
            at = cls._place(keys[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        placed = sum(int(x.sum()) for x in levels)
        return cls(levels, {digests[i].tobytes(): placed + k for k, i in enumerate(left)})

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, or -1; a digest that isn't in the set may get any slot."""
        keys = digests[:, :16].copy().view(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        for i in left if self.rest else ():
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *(len(x) for x in self.levels)], np.int64)
        return b"".join([head.tobytes(), *(np.packbits(x).tobytes() for x in self.levels), *(k + np.int64(v).tobytes() for k, v in self.rest.items())])

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n, rest = np.frombuffer(blob, np.int64, 2)
        sizes, at, levels = np.frombuffer(blob, np.int64, n, 16), 16 + 8 * int(n), []
        for size in sizes.tolist():
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels, {blob[k : k + 32]: int(np.frombuffer(blob, np.int64, 1, k + 32)[0]) for k in range(at, at + 40 * int(rest), 40)})


def _digest_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def winners(digests: DataFrame) -> DataFrame:
    """digest, keep_id (of the row that stays), points (its code points) and n (the group's size). Spark reduces within each task before the shuffle."""
    least = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")))
    found = digests.groupBy("digest").agg(least.alias("best"), F.count("*").alias("n"))
    return found.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("points"), "n")


def _shard(shards: int) -> Column:
    return F.pmod(F.crc32("digest"), F.lit(shards)).cast("int")


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """The perfect-hash index of `winners` rows: a row for each shard, with slots of full digests and winner locators."""

    def build(table: pa.Table) -> pa.Table:
        digests = _digest_rows(table["digest"])
        hashed = PerfectHash.build(digests)
        order = np.argsort(hashed.slots(digests))
        table = table.take(pa.array(order))
        listed = {c: pa.array([table[c].to_pylist()], pa.list_(table[c].type)) for c in ("keep_id", "points", "n")}
        return pa.table({"shard": table["shard"].slice(0, 1), "hash": pa.array([hashed.to_bytes()], pa.binary()), "slots": pa.array([digests[order].tobytes()], pa.binary())} | listed)

    schema = f"shard int, hash binary, slots binary, keep_id array<{field_type(distinct, 'keep_id')}>, points array<bigint>, n array<bigint>"
    return distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, schema)


def look_up(distinct: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Merge later rows' `winners` into the index: all groups, with ``in_history`` telling where each began."""

    def merge(old: pa.Table, new: pa.Table) -> pa.Table:
        digests = _digest_rows(new["digest"])
        keep, points, n = (new[c].to_pylist() for c in ("keep_id", "points", "n"))
        slots, at, member = np.zeros((0, 32), np.uint8), np.zeros(len(digests), np.int64), np.zeros(len(digests), bool)
        all_keep, all_points, all_n = [], [], []
        if old.num_rows:
            slots = np.frombuffer(old["slots"][0].as_py(), np.uint8).reshape(-1, 32)
            all_keep, all_points, all_n = (old[c][0].as_py() for c in ("keep_id", "points", "n"))
            at = PerfectHash.from_bytes(old["hash"][0].as_py()).slots(digests)
            member = at >= 0
            member[member] = (slots[at[member]] == digests[member]).all(axis=1)
        for i in np.flatnonzero(member).tolist():
            k = int(at[i])
            all_n[k] += n[i]
            # A null doc_id is last among rows of equal length.
            if points[i] > all_points[k] or points[i] == all_points[k] and keep[i] is not None and (all_keep[k] is None or keep[i] < all_keep[k]):
                all_keep[k], all_points[k] = keep[i], points[i]
        alone = np.flatnonzero(~member).tolist()
        return pa.table(
            {
                "digest": pa.array([x.tobytes() for x in slots] + [digests[i].tobytes() for i in alone], pa.binary()),
                "keep_id": pa.array(all_keep + [keep[i] for i in alone], new.schema.field("keep_id").type),
                "group_size": pa.array(all_n + [n[i] for i in alone], pa.int64()),
                "in_history": pa.array([True] * len(slots) + [False] * len(alone), pa.bool_()),
            }
        )

    schema = f"digest binary, keep_id {field_type(distinct, 'keep_id')}, group_size bigint, in_history boolean"
    return index.groupBy("shard").cogroup(distinct.withColumn("shard", _shard(shards)).groupBy("shard")).applyInArrow(merge, schema)


def exact_dedup(docs: DataFrame, history: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Group equal texts. Returns doc_id, keep_id, group_size, kept, text_sha256, in_history, a row for each document.

    ``history`` marks the rows that are indexed first; the result is the same whichever they are. By default it is
    the half of the documents whose crc32 of the doc_id is even.
    """
    mark = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 2 == 0 if history is None else history
    rows = materialize(text_digests(docs.select(F.col(text).alias("text"), F.struct(F.col(doc_id).alias("doc_id"), F.coalesce(mark, F.lit(False)).alias("old")).alias("doc_id"))), "digests")
    rows = rows.select("doc_id.doc_id", "doc_id.old", "digest", "n_points")
    old, new = winners(rows.where("old")), winners(rows.where("not old"))
    count = rows.count()
    shards = max(1, math.ceil(count / SHARD_DIGESTS))
    groups = materialize(look_up(new, materialize(build_index(old, shards), "index"), shards), "groups")
    # At most 1,000 groups can hold a thousandth of the rows each: these go to every task, and the others have no hot key.
    hot = groups.where(F.col("group_size") * 1000 >= count).where("group_size > 1")
    found = rows.join(broadcast_if_small(hot, 1000), "digest").unionByName(rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups, "digest"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


def keep_first(docs: DataFrame, groups: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that `exact_dedup` keeps, with all their columns; a row repeated with the same doc_id comes once.

    Rows without a doc_id are told apart by their text.
    """
    kept = groups.where("kept")
    ids = kept.where("doc_id is not null").groupBy("doc_id").count()
    single, several = ids.where("count = 1").select("doc_id"), ids.where("count > 1").select("doc_id")
    on = lambda right: docs[doc_id] == right["doc_id"]
    nameless = kept.where("doc_id is null").select("text_sha256").distinct()
    own = F.sha2(F.regexp_replace(F.coalesce(docs[text], F.lit("")), "[\\x20\\x09-\\x0D]", ""), 256)
    sha = free_name(docs.columns, "_sha")
    rest = docs.where(docs[doc_id].isNull()).withColumn(sha, own)
    rest = rest.join(nameless, rest[sha] == nameless["text_sha256"], "left_semi").dropDuplicates([sha]).drop(sha)
    return docs.join(single, on(single), "left_semi").unionByName(docs.join(several, on(several), "left_semi").dropDuplicates([doc_id])).unionByName(rest)
