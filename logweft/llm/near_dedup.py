"""Near-duplicate detection with a MinHash LSH forest, links confirmed on full shingle sets.

1. Every text becomes its set of 64-bit fingerprints of 5-word shingles (two different shingles share one with a
   chance of 2^-64). Texts with the same set are one class, reduced within tasks before the shuffle.
2. A class's MinHash signature gives `TREES` keys of `DEPTH` hashes each. For each tree the classes are range-sorted
   by key, a sorted order cut over tasks wherever it is crowded; classes that share the first `LEAST_DEPTH` hashes
   are neighbours in it. Where more than `CROWD` share them, the region is taken deeper, hash by hash, and at the
   full depth by windows over the order of signatures. The heads of such parts, also of those that end at a
   task's border, are compared with each other. This only finds links early: all members of such regions are named
   for step 4.
3. Within a part, pairs whose signatures agree in `LEAST_AGREEING` places or more are candidates. At first only a
   spanning forest of them is taken, so that a group of n near copies costs n pairs, and confirmed on full sets.
   Then the members of candidate pairs that still lie in two components are brought together by part, with their
   full sets, and each part looks for the links left among them: no rows of pairs are made, however many there are.
4. Regions of more than `CROWD` classes, or cut over tasks, whose members still lie in two components go to an exact join on full sets
   (`pairs_across`): each set's rarest shingles, as many as a linked pair can't all lack (those of one set alone, known
   by a bit map of bounded size, come first and are dropped), with a bound by position on what two sets can share. Lists of a frequent shingle are dealt over cells, and members of one component are never
   compared; of a region's largest component only rows that the others can meet are made. Parts whose sets are too
   large for one task go the same way. So no pair that shares a region is lost to its size or to where tasks end.
5. Components come from repeated star contraction of the confirmed links, in tables written to the shared folder.

A pair at similarity 0.75 shares no two-hash prefix in any of 16 trees with a chance of 2 in a million, and falls
under the signature threshold with a chance of about 1 in 20,000.

Defined cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words has its whole
sequence as its one shingle; a null text or one without words has an empty set, is linked with nothing and is
kept. Equal sets are linked at any size. doc_ids name documents: rows repeated whole fall into one component.
A null doc_id is never a component's name unless nothing else is. An empty table gives no rows. Only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.llm.store import broadcast_if_small, discard, field_type, materialize
from logweft.llm.text import mix64, slices, words_of

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
TREES, DEPTH, LEAST_DEPTH = 16, 4, 2
HASHES = TREES * DEPTH
CROWD = 256
LEAST_AGREEING = 34
HOT_SHINGLES = 1 << 18
CELL = 1 << 14
PART_SHINGLES = 1 << 21  # a part whose sets have more in all is not compared within one task
SOUGHT = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_FACTORS = [np.uint64(int(x) | 1) for x in mix64(np.arange(1, HASHES + 1, dtype=np.uint64), 77)]


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    words = words_of(texts, lower=True)
    codes, distinct = words.encode()
    n = words.counts
    if not len(codes):
        return [np.zeros(0, np.uint64)] * len(texts)
    value = pd.util.hash_array(np.array(distinct.to_pylist(), object), categorize=False)[codes]
    owner = words.owners()
    begin = np.flatnonzero(owner[: 1 - size] == owner[size - 1 :]) if len(owner) >= size else np.zeros(0, np.int64)
    mixed = np.full(len(begin), size, np.uint64)
    for k in range(size):
        mixed = mixed * _STEP + value[begin + k]
    mixed = mix64(mixed)
    ends = np.searchsorted(begin, words.starts)
    out = []
    for i, count in enumerate(n.tolist()):
        if count >= size:
            own = np.sort(mixed[ends[i] : ends[i + 1]])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif count:
            short = np.full(1, count, np.uint64)
            for v in value[words.starts[i] : words.starts[i + 1]]:
                short = short * _STEP + v
            out.append(mix64(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures, sets x HASHES, of sets that aren't empty."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        for k, factor in enumerate(_FACTORS):
            out[:, k] = np.minimum.reduceat((flat * factor) >> np.uint64(32), starts)
    return out


def _set_digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else b""


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, set_digest (empty for an empty set) and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"))
            some = [i for i, s in enumerate(sets) if len(s)]
            signed = [b""] * len(sets)
            for i, row in zip(some, signatures([sets[i] for i in some])):
                signed[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(_set_digest, sets)), pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "n_shingles", "set_digest", "signature"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {field_type(docs, doc_id)}, n_shingles bigint, set_digest binary, signature binary")


def sorted_orders(classes: DataFrame) -> DataFrame:
    """A row for each class and tree, range-sorted by the tree's key; ``brief`` has a byte of each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            brief = pa.array([x.tobytes() for x in signed.astype(np.uint8)], pa.binary())
            for t in range(TREES):
                keys = np.ascontiguousarray(signed[:, t * DEPTH : (t + 1) * DEPTH].astype(">u4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int8)), pa.array([x.tobytes() for x in keys], pa.binary()), b.column("class_id"), brief], ["tree", "key", "class_id", "brief"])

    rows = classes.select("class_id", "signature").mapInArrow(run, f"tree tinyint, key binary, class_id {field_type(classes, 'class_id')}, brief binary")
    return rows.repartitionByRange("tree", "key", "class_id").sortWithinPartitions("tree", "key", "class_id")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def agreeing(brief: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that agree in `LEAST_AGREEING` places, those that agree most first."""
    same = np.zeros((len(brief), len(brief)), np.uint8)
    for column in brief.T:
        same += column[:, None] == column[None, :]
    i, j = np.nonzero(np.triu(same >= LEAST_AGREEING, 1))
    order = np.argsort(-same[i, j].astype(np.int64), kind="stable")
    return i[order], j[order], same[i, j][order]


class _Parts:
    """Collects the pairs, leftover members and border heads of one task's stretch of the sorted orders."""

    def __init__(self):
        self.rows: list[tuple[int, bytes, object, object, bytes]] = []

    def part(self, name: bytes, ids: list, brief: np.ndarray) -> None:
        i, j, _ = agreeing(brief)
        forest = _Forest(len(ids))
        taken = 0
        for a, b in zip(i.tolist(), j.tolist()):
            if forest.join(a, b):
                self.rows.append((0, name, ids[a], ids[b], b""))
                taken += 1
        if taken < len(i):
            for k in np.unique(np.concatenate([i, j])).tolist():
                self.rows.append((1, name, ids[k], None, brief[k].tobytes()))

    def members(self, name: bytes, ids: list) -> None:
        self.rows.extend((3, name, x, None, b"") for x in ids)

    def heads(self, name: bytes, ids: list, brief: np.ndarray) -> None:
        """Heads of neighbouring parts, however many: windows of them."""
        step = CROWD // 2
        for k in range(0, max(1, len(ids) - step), step):
            self.part(name + b"/%d" % k, ids[k : k + CROWD], brief[k : k + CROWD])

    def region(self, name: bytes, ids: list, keys: np.ndarray, brief: np.ndarray, depth: int) -> None:
        if len(ids) <= CROWD:
            return self.part(name, ids, brief)
        if depth == DEPTH:
            order = np.lexsort(brief.T)
            return self.heads(name + b"=", [ids[k] for k in order.tolist()], brief[order])
        cuts = np.flatnonzero(np.append(True, keys[1:, depth] != keys[:-1, depth]))
        for k, m in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)]):
            if m - k > 1:
                self.region(name + keys[k, depth].tobytes(), ids[k:m], keys[k:m], brief[k:m], depth + 1)
        self.heads(name + b"+", [ids[k] for k in cuts.tolist()], brief[cuts])

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], kind), pa.array(columns[3], kind), pa.array(columns[4], pa.binary())], ["kind", "part", "a", "b", "brief"])


def forest_candidates(orders: DataFrame) -> DataFrame:
    """kind, part, a, b, brief: pairs (0), members of parts with pairs left over (1), heads at a task's borders (2), and members of regions not compared whole (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rest, kind, first = _Parts(), None, None, True
        width = 1 + 4 * LEAST_DEPTH

        def close(names: np.ndarray, ids: list, keys: np.ndarray, brief: np.ndarray, at_end: bool) -> None:
            nonlocal first
            cuts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            stops = np.append(cuts[1:], len(ids))
            border = ({0} if first else set()) | ({len(cuts) - 1} if at_end else set())  # may go on in another task
            for k in border:
                parts.rows.append((2, names[cuts[k]].tobytes(), ids[cuts[k]], None, b""))
                if stops[k] - cuts[k] <= CROWD:
                    parts.members(names[cuts[k]].tobytes(), ids[cuts[k] : stops[k]])
            first = False
            for k, m in zip(cuts[stops - cuts > 1].tolist(), stops[stops - cuts > 1].tolist()):
                if m - k > CROWD:
                    parts.members(names[k].tobytes(), ids[k:m])
                parts.region(names[k].tobytes(), ids[k:m], keys[k:m], brief[k:m], LEAST_DEPTH)

        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("class_id").type
            raw = np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(-1, 4 * DEPTH)
            tree = b.column("tree").to_numpy(zero_copy_only=False).astype(np.uint8)[:, None]
            names = np.ascontiguousarray(np.concatenate([tree, raw[:, : width - 1]], axis=1)).view(f"V{width}").ravel()
            rows = (names, b.column("class_id").to_pylist(), np.ascontiguousarray(raw).view(">u4").reshape(-1, DEPTH), np.frombuffer(b"".join(b.column("brief").to_pylist()), np.uint8).reshape(-1, HASHES))
            if rest is not None:
                rows = tuple(x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(rest, rows))
            last = int(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))[-1])  # the last bucket may go on
            if last:
                close(*(x[:last] for x in rows), at_end=False)
            rest = tuple(x[last:] for x in rows)
            if parts.rows:
                yield parts.batch(kind)
        if rest is not None:
            close(*rest, at_end=True)
            yield parts.batch(kind)

    kind = field_type(orders, "class_id")
    return orders.mapInArrow(run, f"kind int, part binary, a {kind}, b {kind}, brief binary")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def full_sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """class_id, n and shingles (sorted, n of them) of every class in the pairs, one row each. ``docs`` has doc_id and text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    wanted = ids.join(classes.select("class_id", "set_digest"), "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"))
            right = [_set_digest(s) == d for s, d in zip(sets, b.column("set_digest").to_pylist())]
            rows = pa.array([s.view(np.int64) if r else None for s, r in zip(sets, right)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("class_id"), pa.array(list(map(len, sets)), pa.int64()), rows], ["class_id", "n", "shingles"]).filter(pa.array(right, pa.bool_()))

    found = docs.join(wanted, docs["doc_id"] == wanted["class_id"]).select("class_id", "set_digest", "text")
    sets = materialize(found.mapInArrow(run, f"class_id {field_type(classes, 'class_id')}, n bigint, shingles array<bigint>"), "sets")
    if sets.groupBy("class_id").count().where("count > 1").isEmpty():
        return sets
    return materialize(sets.dropDuplicates(["class_id"]), "sets")  # rows repeated under one doc_id


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    linked = DENOMINATOR * both >= NUMERATOR * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as a star around the least node of each component that they form; u > v."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    kind = None
    for b in batches:
        kind = b.column("a").type
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    stars = [(x, r) for x in up if (r := root(x)) != x]
    for k in range(0, len(stars), 100_000):
        u, v = zip(*stars[k : k + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node with a link, by large-star and small-star contraction."""

    def summary(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(edges: DataFrame, large: bool, total: int) -> DataFrame:
        """Edges (u, v) with u > v; each node's neighbours (all and those above it, or those below it) go to the least of them.

        Nodes with a thousandth of the edges or more, of which there are 2,000 at most, go to every task; the others
        are joined by a shuffle without a hot key.
        """
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select(F.col("u").alias("n"), F.least("n", "m").alias("m"), "degree")
        hot = F.broadcast(least.where(F.col("degree") * 1000 >= total))
        edge = near.where("v > u") if large else near
        cold = edge.join(hot.select("n"), edge["u"] == F.col("n"), "left_anti")
        moved = edge.join(hot, edge["u"] == hot["n"]).select("v", "m").unionByName(cold.join(least, cold["u"] == least["n"]).select("v", "m"))
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        return moved.where("u > v").distinct()

    kind = field_type(links, "a")
    near = links.select("a", "b").repartition("a", "b").mapInArrow(_contract, f"u {kind}, v {kind}")
    edges = materialize(near.distinct(), "edges")
    seen = summary(edges)
    while seen[0]:
        large = materialize(star(edges, True, seen[0]), "edges")
        small = materialize(star(large, False, seen[0]), "edges")
        discard(edges)
        discard(large)
        edges = small
        now = summary(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def left_over(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, node and label of the members of candidate pairs that lie in two components; of parts with the same members, one."""
    members = found.where("kind = 1").select("part", F.col("a").alias("node"), "brief")
    members = members.join(labels, "node", "left").select("part", "node", "brief", F.coalesce("label", "node").alias("label"))
    mixed = members.groupBy("part").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("part")
    kind = field_type(members, "node")

    def run(table: pa.Table) -> pa.Table:
        brief = np.frombuffer(b"".join(table["brief"].to_pylist()), np.uint8).reshape(-1, HASHES)
        i, j, _ = agreeing(brief)
        label = pd.factorize(np.array(table["label"].to_pylist(), object))[0]
        apart = label[i] != label[j]
        some = np.unique(np.concatenate([i[apart], j[apart]]))
        own = table.select(["node", "label"]).take(pa.array(some)).sort_by("node").combine_chunks()
        rows = pa.StructArray.from_arrays([own["node"].combine_chunks(), own["label"].combine_chunks()], ["node", "label"]) if len(some) else None
        return pa.table({"part": table["part"].slice(0, int(len(some) > 0)), "members": pa.array([rows.to_pylist()] if rows is not None else [], pa.list_(pa.struct([("node", own.schema.field("node").type), ("label", own.schema.field("label").type)])))})

    parts = members.join(mixed, "part").groupBy("part").applyInArrow(run, f"part binary, members array<struct<node: {kind}, label: {kind}>>")  # a part has `CROWD` members at most
    parts = parts.groupBy("members").agg(F.min("part").alias("part"))
    return parts.select("part", F.explode("members").alias("m")).select("part", "m.node", "m.label")


def links_within(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of a part that lie in two components, by full sets: enough of them to join the components that are linked.

    A part has `CROWD` members and `PART_SHINGLES` shingles at most.
    """
    kind = field_type(members, "node")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["shingles"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(size) - size
        _, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        label = pd.factorize(np.array(table["label"].to_pylist(), object))[0]
        node, forest, out = table["node"].to_pylist(), _Forest(len(label)), []
        holds = np.zeros(int(code.max(initial=0)) + 1, bool)
        for i in range(len(label) - 1):
            others = [j for j in range(i + 1, len(label)) if forest.root(label[i]) != forest.root(label[j]) and min(size[i], size[j]) * DENOMINATOR >= NUMERATOR * max(size[i], size[j])]
            if others:
                holds[:] = False
                holds[code[starts[i] : starts[i] + size[i]]] = True
                for j in others:
                    both = int(holds[code[starts[j] : starts[j] + size[j]]].sum())
                    if DENOMINATOR * both >= NUMERATOR * (size[i] + size[j] - both) and forest.join(label[i], label[j]):
                        out.append((node[i], node[j]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, table.schema.field("node").type), "b": pa.array(b, table.schema.field("node").type)})

    return members.join(sets.select(F.col("class_id").alias("node"), "shingles"), "node").groupBy("part").applyInArrow(run, f"a {kind}, b {kind}")


def by_weight(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the parts that one task can compare, and node, label and sought of the others'."""
    sizes = members.join(sets.select(F.col("class_id").alias("node"), "n"), "node").groupBy("part").agg(F.sum("n").alias("shingles"))
    heavy = materialize(sizes.where(F.col("shingles") > PART_SHINGLES).select("part"), "heavy")
    heavy = broadcast_if_small(heavy, heavy.count())
    return members.join(heavy, "part", "left_anti"), members.join(heavy, "part", "left_semi").select("node", "label", F.lit(True).alias("sought"))


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels after more links."""
    if more.isEmpty():
        return labels
    return materialize(components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "labels")


def apart_in_regions(found: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label and sought of the members of regions not compared whole that lie in two components or more.

    Of each region the largest component needs no comparing with itself: only its other members are ``sought``, and a
    pair across components has one of these at least.
    """
    members = found.where("kind = 3").select("part", F.col("a").alias("node")).join(labels, "node", "left").select("part", "node", F.coalesce("label", "node").alias("label"))
    members = materialize(members, "members")
    own = members.groupBy("part", "label").agg(F.count("*").alias("n"))
    mixed = own.groupBy("part").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most")).where("labels > 1")
    mixed = materialize(mixed.select("part", F.col("most.label").alias("most")), "mixed")
    # A part may hold most members: beyond the broadcast's size it is dealt over 32 places.
    n = mixed.count()
    spread = F.lit(0) if n <= 100_000 else F.pmod(F.xxhash64("node"), F.lit(32)).cast("int")
    places = F.array(F.lit(0)) if n <= 100_000 else F.sequence(F.lit(0), F.lit(31))
    apart = members.withColumn("place", spread).join(broadcast_if_small(mixed.withColumn("place", F.explode(places)), n), ["part", "place"])
    return apart.groupBy("node", "label").agg(F.max(F.col("label") != F.col("most")).alias("sought"))


def repeated_shingles(own: DataFrame, total: int) -> np.ndarray | None:
    """Bits by the lowest part of a shingle's mixed value: whether more than one set may have it. None with so many shingles that most bits would be set."""
    width = min(27, max(16, math.ceil(math.log2(16 * max(1, total)))))
    if total > 4 << width:
        return None

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, n = np.unique(_places(b.column("shingles").flatten().to_numpy(zero_copy_only=False), width), return_counts=True)
            place = np.repeat(place, np.minimum(n, 2))
            first = np.flatnonzero(np.append(True, place[1:] >> 16 != place[:-1] >> 16)) if len(place) else np.zeros(0, np.int64)
            low = [x.astype("<u2").tobytes() for x in np.split(place & 0xFFFF, first[1:])] if len(place) else []
            yield pa.RecordBatch.from_arrays([pa.array(place[first] >> 16, pa.int32()), pa.array(low, pa.binary())], ["block", "places"])

    def merge(table: pa.Table) -> pa.Table:
        n = np.bincount(np.frombuffer(b"".join(table["places"].to_pylist()), "<u2"), minlength=1 << 16)
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([np.packbits(n > 1).tobytes()], pa.binary())})

    blocks = own.select("shingles").mapInArrow(mark, "block int, places binary").groupBy("block").applyInArrow(merge, "block int, bits binary")
    bits = np.zeros((1 << width - 16, 1 << 13), np.uint8)
    for block, row in blocks.collect():  # 2,048 blocks of 8 kB at most
        bits[block] = np.frombuffer(row, np.uint8)
    return bits.ravel()


def _places(shingles: np.ndarray, width: int) -> np.ndarray:
    return (mix64(shingles.view(np.uint64), 5) & np.uint64((1 << width) - 1)).astype(np.int64)


def _may_repeat(shingles: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.ones(len(shingles), bool)
    place = _places(shingles, (8 * len(bits)).bit_length() - 1)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _prefixes(batches: Iterator[pa.RecordBatch], hot: np.ndarray, hot_count: np.ndarray, repeated: np.ndarray | None, sought: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """shingle, cell, node, label, size and left (shingles from this one on, rarest first) of each set's first shingles.

    Those that no other set has come first in the order and give no row; with ``sought``, its shingles alone give one.
    """
    for b in batches:
        flat, ends = b.column("shingles").flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column("shingles").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(flat):
            continue
        size = np.diff(ends, prepend=0)
        starts, owner = ends - size, np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(hot, flat), max(0, len(hot) - 1))
        count = np.where(hot[at] == flat, hot_count[at], 0) if len(hot) else np.zeros(len(flat), np.int64)
        shared = _may_repeat(flat, repeated)
        order = np.lexsort((flat, count, shared, owner))
        left = size[owner] - (np.arange(len(flat)) - starts[owner])
        own = left * DENOMINATOR >= NUMERATOR * size[owner]  # a linked set shares one of these at least
        own &= shared[order]
        if sought is not None:
            own &= np.isin(flat[order], sought)
        shingle, count, owner, left = flat[order][own], count[order][own], owner[own], left[own]
        blocks = 1 + count // CELL
        block = (mix64(np.add.reduceat(flat.view(np.uint64), starts))[owner] % blocks.astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(shingle)), blocks)
        other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        cell = np.minimum(block[row], other) << 24 | np.maximum(block[row], other)
        who = pa.array(owner[row])
        yield pa.RecordBatch.from_arrays([pa.array(shingle[row]), pa.array(cell), b.column("node").take(who), b.column("label").take(who), pa.array(size[owner[row]]), pa.array(left[row])], ["shingle", "cell", "node", "label", "size", "left"])


def _same(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each row but the first is as the one before."""
    return pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).astype(bool)


def _meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """a and b of pairs in one list and two components that can share enough; whole lists, sorted by shingle, cell and label."""
    table = table.combine_chunks()
    listed = _same(table["shingle"]) & _same(table["cell"])
    ends = lambda same: np.repeat(c := np.flatnonzero(np.append(~same, True)) + 1, np.diff(c, prepend=0))
    stop, nxt = ends(listed), ends(listed & _same(table["label"]))
    size, left = table["size"].to_numpy(), table["left"].to_numpy()
    i, j, some, taken = np.arange(len(stop)), nxt, [], 0

    def batch() -> pa.RecordBatch:
        a, b = (pa.array(np.concatenate(x)) for x in zip(*some))
        node = table["node"].combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(a), node.take(b)], ["a", "b"])

    while len(i):
        live = j < stop[i]
        i, j = i[live], j[live]
        near = (NUMERATOR + DENOMINATOR) * np.minimum(left[i], left[j]) >= NUMERATOR * (size[i] + size[j])
        some.append((i[near], j[near]))
        taken += int(near.sum())
        if taken > 1 << 18:
            yield batch()
            some, taken = [], 0
        j = j + 1
    if taken:
        yield batch()


def _counted(batches: Iterator[pa.RecordBatch], repeated: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts by batch of the shingles that more than one set may have."""
    for b in batches:
        flat = b.column("shingles").flatten().to_numpy(zero_copy_only=False)
        shingle, n = np.unique(flat[_may_repeat(flat, repeated)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(n)], ["shingle", "n"])


def pairs_across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a and b of all pairs of members in two components, one of them sought, that may be linked by their full sets: none that is linked is missing."""
    kind = field_type(members, "node")
    own = materialize(members.join(sets.select(F.col("class_id").alias("node"), "n", "shingles"), "node"), "own")
    total = own.agg(F.sum("n")).first()[0] or 0
    repeated = repeated_shingles(own, total)
    counts = own.select("shingles").mapInArrow(lambda batches: _counted(batches, repeated), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(64, total // HOT_SHINGLES + 1)).toPandas()  # at most HOT_SHINGLES rows
    counts = counts.sort_values("shingle")
    hot, hot_count = counts["shingle"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    looked_for = None
    if (own.where("sought").agg(F.sum("n")).first()[0] or 0) <= SOUGHT:  # then the others' rows are only those that these can meet
        first = own.where("sought").select("node", "label", "shingles").mapInArrow(lambda batches: _prefixes(batches, hot, hot_count, repeated, None), f"shingle bigint, cell bigint, node {kind}, label {kind}, size bigint, left bigint")
        looked_for = np.sort(first.select("shingle").distinct().toPandas()["shingle"].to_numpy(np.int64))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            rest = now if rest is None else pa.concat_tables([rest, now])
            listed = _same(now["shingle"]) & _same(now["cell"])
            if not listed.all() or rest["shingle"][0] != now["shingle"][0] or rest["cell"][0] != now["cell"][0]:
                last = rest.num_rows - now.num_rows + int(np.flatnonzero(np.append(True, ~listed))[-1])  # the last list may go on
                if last:
                    yield from _meet(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None:
            yield from _meet(rest)

    lists = own.select("node", "label", "shingles").mapInArrow(lambda batches: _prefixes(batches, hot, hot_count, repeated, looked_for), f"shingle bigint, cell bigint, node {kind}, label {kind}, size bigint, left bigint")
    return lists.repartition("shingle", "cell").sortWithinPartitions("shingle", "cell", "label").mapInArrow(meet, f"a {kind}, b {kind}")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(fingerprints(docs, "text", "doc_id"), "prints")
    total = prints.count()
    classes = prints.where("n_shingles > 0").groupBy("set_digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    named = classes.where("class_id is not null")
    found = materialize(forest_candidates(sorted_orders(named)), "candidates")
    border = found.where("kind = 2").groupBy("part").agg(F.array_sort(F.collect_set("a")).alias("heads")).where("size(heads) > 1")  # two rows for each task at most
    border = border.select(F.explode(F.arrays_zip(F.slice("heads", F.lit(1), F.size("heads") - 1).alias("a"), F.slice("heads", F.lit(2), F.size("heads") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    pairs = materialize(_pairs(found.where("kind = 0").select("a", "b").unionByName(border)), "pairs")
    regions = found.where("kind = 3").select("a", F.col("a").alias("b"))
    sets = full_sets(pairs.unionByName(regions), named, docs)
    labels = materialize(components(materialize(confirm(pairs, sets), "links")), "labels")
    left, heavy = by_weight(materialize(left_over(found, labels), "left"), sets)
    labels = _joined(labels, materialize(links_within(left, sets), "links"))
    heavy = heavy.select("node", "sought").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "sought")
    apart = materialize(apart_in_regions(found, labels).unionByName(heavy).groupBy("node", "label").agg(F.max("sought").alias("sought")), "apart")
    if not apart.isEmpty():
        labels = _joined(labels, materialize(confirm(materialize(_pairs(pairs_across(apart, sets)), "pairs"), sets), "links"))
    groups = classes.join(labels, classes["class_id"] == labels["node"], "left").select("set_digest", "n", F.coalesce("label", "class_id").alias("component_id"))
    rows = prints.select("doc_id", "n_shingles", "set_digest")
    # At most 1,000 classes can hold a thousandth of the rows each: these go to every task, and the others have no hot key.
    groups = materialize(groups, "groups")
    hot = groups.where(F.col("n") * 1000 >= total).where("n > 1")
    some = rows.where("n_shingles > 0")
    out = some.join(broadcast_if_small(hot, 1000), "set_digest").unionByName(some.join(F.broadcast(hot.select("set_digest")), "set_digest", "left_anti").join(groups, "set_digest"))
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that `near_dedup` keeps, with all their columns; a row repeated with the same doc_id comes once.

    Rows without a doc_id can't be named by a component, and all stay.
    """
    ids = groups.where("kept and doc_id is not null").groupBy("doc_id").count()
    single, several = ids.where("count = 1").select("doc_id"), ids.where("count > 1").select("doc_id")
    on = lambda right: docs[doc_id] == right["doc_id"]
    return docs.join(single, on(single), "left_semi").unionByName(docs.join(several, on(several), "left_semi").dropDuplicates([doc_id])).unionByName(docs.where(docs[doc_id].isNull()))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, md5(unnest(sh)) AS k FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.c = g.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
