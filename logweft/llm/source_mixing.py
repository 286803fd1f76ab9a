"""Mix sources to target weights by hash-random order, distributed prefix sums and an exact cut.

Every row gets a hash-random key. Rows are range-sorted by source and key, so a source of any size spreads over
many tasks; each task sums its own part, and the parts' totals (a row for each task and source in it) give the
offset of each part. With every row's prefix sum known, a source with budget B and size S repeats B div S whole
epochs, then takes rows in key order up to B mod S; the row at the cut is taken in part, so the budget is exact.

Defined cases: size is the number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0); null is a source of its own
and comes last; rows of size 0 are never taken; a source without words has target 0; equal keys are ordered by
doc_id and size, so reruns agree; repeated rows count separately; an empty table gives no rows. Only doc_id, text
and source are read, so other columns can't clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.llm.store import broadcast_if_small, field_type, free_name, materialize
from logweft.llm.text import slices, words_of

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-0:"


def word_sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source and size of every document."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(words_of(b.column("text")).counts.astype(np.int64))], ["doc_id", "source", "size"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).mapInArrow(size, f"doc_id {field_type(docs, doc_id)}, source {field_type(docs, source)}, size bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: a row for each source.

    Sharing the excess again until no target is above its limit ends where the limited sources are those whose
    limit is small for their weight: in order of limit by weight they are a prefix, found by running sums.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    given = F.array(*(F.lit(w).cast("long") for w in weights))
    t = total.withColumn("weight", F.element_at(given, ((rank - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * most_epochs)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    t = t.withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("left_words", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("limited", F.col("most") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    first = F.min(F.when(~F.col("limited"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("source").isNull().alias("none"), F.col("source"), F.col("left_words").alias("words"), F.col("left_weight").alias("weight")))).over(Window.partitionBy())
    share = F.col("weight") * first["words"] / first["weight"]
    return t.withColumn("target", F.when(F.col("limited"), F.col("most").cast("double")).otherwise(share.cast("double"))).select("source", "source_size", "target")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sizes before each row within its source and this task; rows come sorted by source."""
    part, last, carry = TaskContext.get().partitionId(), object(), 0
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column("size").to_numpy(zero_copy_only=False)
        source = b.column("source").dictionary_encode()
        code = source.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        before = np.cumsum(size) - size
        start = np.repeat(before[first], np.diff(np.append(first, len(code))))
        before = before - start
        head = b.column("source")[0].as_py()
        if last == head:
            before[: first[1] if len(first) > 1 else len(code)] += carry
        carry, last = int(before[-1] + size[-1]), b.column("source")[b.num_rows - 1].as_py()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("size"), pa.array(before), pa.array(np.full(len(code), part, np.int32))], ["doc_id", "source", "size", "before", "part"])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, budget and taken of every document."""
    sizes = materialize(word_sizes(docs, text, source, doc_id), "sizes")
    targets = materialize(source_targets(sizes, weights, most_epochs), "targets")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    by = ["source", "key", "doc_id", "size"]
    kind, name = field_type(sizes, "doc_id"), field_type(sizes, "source")
    rows = sizes.withColumn("key", key).repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "source", "size")
    rows = materialize(rows.mapInArrow(_running, f"doc_id {kind}, source {name}, size bigint, before bigint, part int"), "running")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    parts = parts.join(targets, parts["source"].eqNullSafe(targets["source"])).select(parts["source"].alias("p_source"), F.col("part").alias("p_part"), "offset", "source_size", "target")
    parts = materialize(parts, "parts")
    # A row for each source in each task: the tasks' number and the sources' bound it.
    out = rows.join(broadcast_if_small(parts, parts.count()), rows["source"].eqNullSafe(parts["p_source"]) & (rows["part"] == parts["p_part"]))
    out = out.withColumn("budget", F.floor("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.expr("budget % source_size")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("before")))
    return out.select("doc_id", "source", "size", "source_size", "target", "budget", (whole * F.col("size") + last).cast("long").alias("taken"))


_WORD = re.compile("[^\x20\x09-\x0d]+")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    last = next(itertools.islice(_WORD.finditer(text), n - 1, None), None)
    return text[: last.end()] if last else text


def _paired(rows: DataFrame, shares: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """Rows, in a struct ``row``, with the struct ``share`` of one of their shares: the n-th of those with the same keys gets the n-th."""
    nth = lambda of, by: of.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0))))
    left, right = nth(rows, own).alias("l"), nth(shares, keys).where("share.taken > 0").alias("r")
    same = [F.col(f"l.{a}").eqNullSafe(F.col(f"r.{b}")) for a, b in zip([*own, "nth"], [*keys, "nth"])]
    return left.join(right, same).select("l.row", "r.share")


def draw(docs: DataFrame, mixed: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix as documents, with the columns of ``docs``: each as often as `mix` takes it, and the one at a cut also up to its last word taken.

    Rows that share a doc_id are taken for copies of one text, and each gets one of their shares. Rows without a
    doc_id are known by their source and number of words: each gets a share of that source and size.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("from"), F.col(text).alias("words"))
    shares = mixed.select(F.struct("size", "taken").alias("share"), F.col("doc_id").alias("id"), F.col("source").alias("from"), "size")
    named = _paired(rows.where("id is not null").select("row", "id"), shares.where("id is not null"), ["id"], ["id"])
    sized = rows.where("id is null").select("row", "from", F.size(F.regexp_extract_all(F.coalesce("words", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).cast("long").alias("size"))
    nameless = _paired(sized, shares.where("id is null"), ["from", "size"], ["from", "size"])
    rows = named.unionByName(nameless).select(*(F.col("row")[c] for c in columns), F.col("share")["size"], F.col("share")["taken"])
    rows = rows.toDF(*columns, *(free_name(columns, x) for x in ("_size", "_taken")))
    place = columns.index(text)

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            size, taken = (b.column(len(columns) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            own = pa.RecordBatch.from_arrays(b.columns[: len(columns)], columns)
            yield own.take(pa.array(np.repeat(np.arange(b.num_rows), taken // size)))
            if len(at := np.flatnonzero(taken % size)):
                cut = own.take(pa.array(at))
                texts = pa.array([first_words(t, int(n)) for t, n in zip(cut.column(place).to_pylist(), (taken % size)[at])], cut.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(cut.columns)], columns)

    return rows.mapInArrow(repeat, docs.schema)


ORACLE = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-0:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s GROUP BY source),
u AS (SELECT *, source_size * 3 AS most, (source_size * 3)::DOUBLE / weight AS r FROM t),
v AS (SELECT *, sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS lw,
  (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lt FROM u),
x AS (SELECT *, most * lw <= weight * lt AS limited FROM v),
f AS (SELECT lt AS flt, lw AS flw FROM x WHERE NOT limited ORDER BY r, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN limited THEN most::DOUBLE ELSE (weight * flt)::DOUBLE / flw END AS target FROM x LEFT JOIN f ON true),
p AS (SELECT s.doc_id, s.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken FROM p
"""
