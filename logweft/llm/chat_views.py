"""Chat formatting by perspective: each participant's view of a dialogue, with that speaker as the assistant.

For every participant of a conversation (every speaker but ``system``) the dialogue is rendered once: the
participant's turns as ``assistant``, everyone else's as ``user`` with the speaker's name, ``system`` as it is. The
mask tells the characters to learn from: the participant's own contents with their end marks.

All of it is DataFrame functions. The turns are shuffled once, by conversation and part: a part is `PART_TURNS`
turn numbers, so a conversation of any length spreads over many groups; most dialogues are a single part. Where many
rows share turn numbers (those without a conversation, say) and a part has more than `PART_ROWS` rows, it comes in
pieces of that many: only such parts are range-sorted, and their rows numbered by adding up the tasks' counts. So each
group is bounded. Speakers are reduced to one row for each conversation and speaker before any join.

Defined cases: a null text is an empty content; a null speaker is ``anonymous``; null turns come first, in part 0;
rows with the same turn are ordered by speaker and text, and repeated rows are rendered as often as they come; a
null conv_id is a conversation of its own; a line feed in a speaker's name is shown as ``\\n``; a conversation of ``system`` alone has no view; an empty table gives no
rows. Marks in a text are broken with a backslash, so no text can end its turn. Only the four columns are read, so
others can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweft.llm.store import broadcast_if_small, materialize

PART_TURNS = 4096
PART_ROWS = 4096
BEGIN, END = "<|turn|>", "<|end|>"
SYSTEM, NOBODY = "system", "anonymous"


def _escaped(text: Column) -> Column:
    for mark in (BEGIN, END):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("|", "\\|", 1)))
    return text


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def _in_pieces(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``piece``: 0, or in parts of more than ``most`` rows the number of the piece."""
    crowded = materialize(rows.groupBy("conv_id", "part").count().where(F.col("count") > most).select("conv_id", "part"), "crowded")
    n = crowded.count()
    if not n:
        return rows.withColumn("piece", F.lit(0).cast("long"))
    crowded = broadcast_if_small(crowded, n)
    calm = rows.join(crowded, _same(rows, crowded, "conv_id", "part"), "left_anti").withColumn("piece", F.lit(0).cast("long"))
    order = ["conv_id", "part", "turn", "speaker", "text", "nth"]  # equal rows are told apart as they come
    some = rows.join(crowded, _same(rows, crowded, "conv_id", "part"), "left_semi").withColumn("nth", F.monotonically_increasing_id())
    some = some.repartitionByRange(*order).sortWithinPartitions(*order).drop("nth").withColumn("at", F.monotonically_increasing_id())
    some = materialize(some.withColumn("task", F.shiftright("at", 33)), "numbered")
    counts = some.groupBy("conv_id", "part", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = materialize(counts.select("conv_id", "part", "task", (F.col("first") - F.coalesce(earlier, F.lit(0))).alias("base")), "bases")
    base = broadcast_if_small(base, base.count())
    some = some.join(base, _same(some, base, "conv_id", "part", "task")).select(*(some[c] for c in rows.columns), F.floor((some["at"] - base["base"]) / most).cast("long").alias("piece"))
    return calm.unionByName(some)


def chat_views(turns: DataFrame, part_turns: int = PART_TURNS, part_rows: int = PART_ROWS, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, assistant, part, piece, n_turns, rendered and mask_runs, a row for each participant and piece of a part of a conversation.

    ``mask_runs`` has two numbers for every turn: the characters that are off, then those that are on.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.floor(F.coalesce(F.col(turn), F.lit(0)) / part_turns).cast("long").alias("part"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit(NOBODY)).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = _in_pieces(rows, part_rows)
    parts = rows.select("conv_id", "part", "piece").distinct()
    speakers = rows.select("conv_id", "speaker").where(F.col("speaker") != SYSTEM).distinct()
    speakers = speakers.groupBy("conv_id").agg(F.array_sort(F.collect_list("speaker")).alias("speakers"))
    views = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["conv_id"])).select(parts["conv_id"].alias("v_conv"), parts["part"].alias("v_part"), parts["piece"].alias("v_piece"), "speakers")
    dialogues = rows.groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    both = dialogues.join(views, dialogues["conv_id"].eqNullSafe(views["v_conv"]) & (dialogues["part"] == views["v_part"]) & (dialogues["piece"] == views["v_piece"]))
    both = both.select("conv_id", "part", "piece", "turns", F.explode("speakers").alias("assistant"))

    def head(t: Column) -> Column:
        other = F.when(t["speaker"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.replace(_escaped(t["speaker"]), F.lit("\n"), F.lit("\\n"))))
        return F.concat(F.lit(BEGIN), F.when(t["speaker"] == F.col("assistant"), F.lit("assistant")).otherwise(other), F.lit("\n"))

    said = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_escaped(t["text"]), F.lit(END + "\n")).alias("body"), (t["speaker"] == F.col("assistant")).alias("own")))
    both = both.withColumn("said", said)
    width = lambda s: F.char_length(s["head"]) + F.when(s["own"], 0).otherwise(F.char_length(s["body"]))
    runs = F.flatten(F.transform("said", lambda s: F.array(width(s), F.when(s["own"], F.char_length(s["body"])).otherwise(0))))
    return both.select(
        "conv_id",
        "assistant",
        "part",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
        runs.alias("mask_runs"),
    )


ORACLE = r"""
WITH r AS (SELECT conv_id, coalesce(turn, 0) // 4096 AS part, turn, coalesce(role, 'anonymous') AS speaker,
  replace(replace(coalesce(text, ''), '<|turn|>', '<\|turn|>'), '<|end|>', '<\|end|>') || '<|end|>' || chr(10) AS body, text FROM conversations),
v AS (SELECT DISTINCT conv_id AS c, speaker AS assistant FROM r WHERE speaker <> 'system'),
x AS (SELECT conv_id, assistant, part, turn, speaker, text, body, speaker = assistant AS own,
  '<|turn|>' || CASE WHEN speaker = assistant THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || replace(replace(replace(speaker, '<|turn|>', '<\|turn|>'), '<|end|>', '<\|end|>'), chr(10), '\n') END || chr(10) AS head
  FROM r JOIN v ON r.conv_id IS NOT DISTINCT FROM v.c),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, assistant, part ORDER BY turn NULLS FIRST, speaker, text NULLS FIRST) - 1) // 4096 AS piece FROM x)
SELECT conv_id, assistant, part, piece, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn NULLS FIRST, speaker, text) AS rendered,
  string_agg((length(head) + CASE WHEN own THEN 0 ELSE length(body) END) || ',' || CASE WHEN own THEN length(body) ELSE 0 END, ',' ORDER BY turn NULLS FIRST, speaker, text) AS mask_runs
FROM p GROUP BY conv_id, assistant, part, piece
"""
