"""Chat formatting: each conversation rendered once for every speaker, who becomes the assistant; the others are named users.

A turn becomes a head line, its text and an end mark. System turns keep their role in every rendering; the system is no
speaker. The mask lists the spans that a model is to learn (code points, end exclusive): the assistant's texts with their end
marks.

The turns of a conversation are gathered once; its renderings are made from that list, so turns are shuffled once whatever the
number of speakers. A rendering is one row, so a group is no larger than one row of the result. Where dialogues are too long
for that, part cuts them by turn number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import table

END, SYSTEM, NAMELESS = "<|end|>\n", "system", "unknown"
#: Characters that a speaker's name must not bring into a head line, and what stands for each.
MARKS, PLAIN = "<|>\n\r", "(/)  "


def perspectives(turns: DataFrame, part: int | None = None) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_own, text, spans array<struct<s, e>>) from conv_id, turn, role, text.

    part: None renders whole dialogues (column part is 0); a number cuts each after so many turn numbers. Turns are ordered
    by number (null first), speaker and text; repeated rows are rendered as often as they stand. Text null: empty. "<|" in a
    text is written "< |", and marks and line ends in a name as brackets, strokes and spaces, so neither can forge a head or
    an end. Role null or empty: speaker "unknown". A row without conv_id belongs to no other: it is a conversation of one
    turn. A conversation of system turns only has no rendering. Empty table: no rows."""
    speaker = F.when(F.coalesce("role", F.lit("")) == "", NAMELESS).otherwise(F.col("role"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    number = F.lit(0).cast("long") if part is None else F.floor(F.col("turn") / part)
    rows = turns.select("conv_id", number.alias("part"), F.struct("turn", speaker.alias("speaker"), body.alias("body")).alias("x"))
    whole = rows.where("conv_id is not null")
    groups = whole.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    if part is None:
        people = F.array_distinct(F.transform("turns", lambda x: x["speaker"]))
        groups = groups.select("*", F.explode(people).alias("perspective"))
    else:  # every part is rendered for every speaker of the dialogue
        people = whole.select(F.col("conv_id").alias("c"), F.col("x.speaker").alias("perspective")).distinct()
        groups = groups.join(people, groups["conv_id"] == people["c"]).drop("c")
    alone = rows.where("conv_id is null").select("conv_id", "part", F.array("x").alias("turns"), F.col("x.speaker").alias("perspective"))
    groups = groups.unionByName(alone).where(F.col("perspective") != SYSTEM)

    def own(x: Column) -> Column:
        return x["speaker"] == F.col("perspective")

    def head(x: Column) -> Column:
        named = F.concat(F.lit("<|user name="), F.translate(x["speaker"], MARKS, PLAIN), F.lit("|>\n"))
        return F.when(own(x), F.lit("<|assistant|>\n")).when(x["speaker"] == SYSTEM, F.lit("<|system|>\n")).otherwise(named)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(head(x))
        end = begin + F.length(x["body"]) + len(END)
        spans = F.when(own(x), F.concat(state["spans"], F.array(F.struct(begin.alias("s"), (end - 1).alias("e"))))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("spans"))
    return groups.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", own)).cast("long").alias("n_own"),
        F.array_join(F.transform("turns", lambda x: F.concat(head(x), x["body"], F.lit(END))), "").alias("text"),
        F.aggregate("turns", start, step, lambda s: s["spans"]).alias("spans"),
    )


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("spans", shown).withColumnRenamed("spans", "mask").drop("part")


OP2_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS c, turn, CASE WHEN coalesce(role, '') = '' THEN '{NAMELESS}' ELSE role END AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), people AS (
  SELECT DISTINCT c, speaker AS perspective FROM turns WHERE speaker <> '{SYSTEM}'
), pieces AS (
  SELECT conv_id, c, perspective, speaker = perspective AS own,
    row_number() OVER (PARTITION BY c, perspective ORDER BY turn NULLS FIRST, speaker, body) AS k,
    CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = '{SYSTEM}' THEN '<|system|>' ELSE '<|user name=' || translate(speaker, '<|>' || chr(10) || chr(13), '{PLAIN}') || '|>' END || chr(10) AS head, body || '<|end|>' || chr(10) AS rest
  FROM turns JOIN people USING (c)
), placed AS (
  SELECT *, sum(length(head) + length(rest)) OVER (PARTITION BY c, perspective ORDER BY k) AS upto FROM pieces
)
SELECT any_value(conv_id) AS conv_id, perspective, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || rest, '' ORDER BY k) AS text,
  coalesce(string_agg((upto - length(rest))::BIGINT || ':' || (upto - 1)::BIGINT, ',' ORDER BY k) FILTER (own), '') AS mask
FROM placed GROUP BY c, perspective
"""
