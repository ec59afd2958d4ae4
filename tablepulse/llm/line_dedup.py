"""Line dedup: repeated runs of lines found in a suffix array over line numbers; later copies are deleted.

A text is the sequence of its lines (cut at \\n). The suffixes of all sequences are ranked by distributed prefix doubling:
rank 0 orders positions by their line, rank k + 1 by the pair of rank k here and 2^k lines on; ranks are made by a range sort
of the distinct pairs, so they keep the suffixes' order and no task holds them all. Positions whose line, or pair of ranks,
occurs once fall away at each step.

A run counts from MIN_WORDS words on. It's a later copy if the same lines stand at an earlier place (a smaller doc_id, or the
same text further up) that ends before it begins. Every line within a later copy is deleted. The suffixes that begin a run of
n lines are sorted as in the suffix array: by rank k at their first line, then by rank k at 2^k lines before the run's end,
where 2^k is the greatest power up to n; equal ones by place. The longest common prefix of two neighbours reaches n lines
exactly where both ranks agree (two blocks of 2^k lines cover the run), so a scan of neighbours cuts the array into the
intervals of that depth, and the first of each interval is the earliest copy.

Each line is looked at through the shortest runs of MIN_WORDS words that begin or end at it: a run is a later copy if those
within it are, and they cover it. Where they overlap or touch, they join to the maximal repeated run. Only the shortest
qualifying depth is needed of the intervals that are nested in one another, and their number is that of the lines.

Only DataFrame functions run here. Hot lines are counted before the shuffle and joined in splittable joins; a passage with
many copies is cut by the range sort wherever a partition is full; other windows work within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, table

MIN_WORDS = 50
#: The document: its id (null: after all others) and its text's hash. Rows that repeat both are one document.
DOC = ("d", "t")


def doc_key(text: Column) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("t")]


def ordered_ranks(keys: DataFrame, rows: int, *by: str) -> DataFrame:
    """keys, all different and rows at most, with a number r that grows with their order."""
    return cut(keys.orderBy(*by).withColumn("r", F.monotonically_increasing_id()), rows)


def repeated_positions(docs: DataFrame) -> DataFrame:
    """(d, t, pos, words, r): lines that occur twice or more anywhere, with rank 0."""
    lines = docs.where("text is not null").select(*doc_key(F.col("text")), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = cut(lines.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    n = lines.count()
    often = lines.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return cut(lines.join(ordered_ranks(often, n // 2, "h1", "h2"), ["h1", "h2"]).select(*DOC, "pos", "words", "r").distinct(), n)


def shortest_runs(positions: DataFrame, min_words: int) -> DataFrame:
    """(d, t, s, n): runs of n lines from line s, of repeated lines only, that have min_words words but not without their first or last line."""
    text = Window.partitionBy(*DOC).orderBy("pos")
    stretch = positions.withColumn("g", F.col("pos") - F.row_number().over(text))
    in_stretch = Window.partitionBy(*DOC, "g").orderBy("pos")
    last = F.lead("pos").over(in_stretch).isNull()
    with_end = stretch.withColumn("last", last).select(*DOC, "g", F.explode(F.when(F.col("last"), F.array(F.struct("pos", "words"), F.struct((F.col("pos") + 1).alias("pos"), F.lit(0).alias("words")))).otherwise(F.array(F.struct("pos", "words")))).alias("x")).select(*DOC, "g", "x.*")
    counted = with_end.withColumn("before", F.coalesce(F.sum("words").over(in_stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    up, down = Window.partitionBy(*DOC, "g").orderBy("before"), Window.partitionBy(*DOC, "g").orderBy(F.desc("before"))
    found = counted.select(
        *DOC,
        "pos",
        F.min("pos").over(down.rangeBetween(Window.unboundedPreceding, -min_words)).alias("end"),
        F.max("pos").over(up.rangeBetween(Window.unboundedPreceding, -min_words)).alias("start"),
    )
    runs = F.array(F.struct(F.col("pos").alias("s"), (F.col("end") - F.col("pos")).alias("n")), F.struct(F.col("start").alias("s"), (F.col("pos") - F.col("start")).alias("n")))
    return found.where("end is not null or start is not null").select(*DOC, F.explode(runs).alias("x")).select(*DOC, "x.*").where("s is not null and n is not null").distinct()


def later_copies(positions: DataFrame, min_words: int) -> DataFrame:
    """(d, t, s, e): shortest runs that are later copies, as lines s to e (exclusive)."""
    n = positions.count()
    runs = cut(shortest_runs(positions, min_words).withColumn("k", F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int")), 2 * n)
    deepest, n_runs = runs.agg(F.max("k"), F.count("*")).first()
    rank, named = positions.select(*DOC, "pos", "r"), []
    for k in range(0 if deepest is None else deepest + 1):
        here = runs.where(F.col("k") == k)
        first = rank.select(*DOC, F.col("pos").alias("s"), F.col("r").alias("r1"))
        tail = rank.select(*DOC, F.col("pos").alias("tail"), F.col("r").alias("r2"))
        named.append(here.join(first, [*DOC, "s"]).withColumn("tail", F.col("s") + F.col("n") - (1 << k)).join(tail, [*DOC, "tail"]).select(*DOC, "s", "n", "r1", "r2"))
        if k < deepest:
            further = rank.select(*DOC, (F.col("pos") - (1 << k)).alias("pos"), F.col("r").alias("r2"))
            pairs = cut(rank.withColumnRenamed("r", "r1").join(further, [*DOC, "pos"]), n)
            n = pairs.count()
            often = pairs.groupBy("r1", "r2").count().where("count > 1").select("r1", "r2")
            rank = cut(pairs.join(ordered_ranks(often, n // 2, "r1", "r2"), ["r1", "r2"]).select(*DOC, "pos", "r"), n)
    if not named:
        return runs.select(*DOC, "s", F.col("n").alias("e"))
    intervals = named[0]
    for more in named[1:]:
        intervals = intervals.unionByName(more)
    placed = interval_starts(intervals, n_runs)
    later = (F.col("d") != F.col("first.d")) | (F.col("t") != F.col("first.t")) | (F.col("s") >= F.col("first.s") + F.col("n"))
    return placed.where(later).select(*DOC, "s", (F.col("s") + F.col("n")).alias("e"))


#: What tells an interval of the suffix array, and the order of places.
DEPTH, PLACE = ("n", "r1", "r2"), ("d", "t", "s")


def interval_starts(runs: DataFrame, n_runs: int) -> DataFrame:
    """runs (d, t, s, n, r1, r2) with first, the earliest place in each one's interval.

    The runs are sorted by range; neighbours are compared within partitions. An interval that goes on from one partition to
    the next is handed on: the driver gets two rows a partition, its first and its last."""
    array = cut(runs.orderBy(*DEPTH, *PLACE).withColumn("part", F.spark_partition_id()), n_runs)
    order = Window.partitionBy("part").orderBy(*DEPTH, *PLACE)
    here = F.struct(*DEPTH)
    # the common prefix with the suffix before reaches n lines where both ranks agree
    reaches = F.coalesce(F.lag(here).over(order) == here, F.lit(False))
    marked = array.withColumn("opens", F.when(~reaches, F.struct(*PLACE)))
    found = marked.withColumn("first", F.last("opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = found.groupBy("part").agg(F.min(here).alias("low"), F.max(F.struct(*DEPTH, *PLACE, "first")).alias("high")).orderBy("part").collect()
    handed, before = [], None
    for e in edges:
        goes_on = before is not None and tuple(e.low) == before[0]
        if goes_on:
            handed.append((e.part, *before[0], before[1]))
        last = tuple(e.high[c] for c in DEPTH)
        before = last, before[1] if goes_on and last == before[0] else e.high["first"]
    if not handed:
        return found.drop("opens", "part")
    given = runs.sparkSession.createDataFrame(handed, "part int, n int, r1 long, r2 long, earlier struct<d: long, t: long, s: int>")
    return found.join(F.broadcast(given), ["part", *DEPTH], "left").withColumn("first", F.coalesce("earlier", "first")).drop("earlier", "opens", "part")


def deleted_ranges(copies: DataFrame) -> DataFrame:
    """(d, t, gone array<struct<s, e>>): the lines to delete from each text, as ranges that neither touch nor overlap."""
    text = Window.partitionBy(*DOC).orderBy("s", "e")
    reach = F.max("e").over(text.rowsBetween(Window.unboundedPreceding, -1))
    islands = copies.withColumn("new", (F.col("s") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = islands.groupBy(*DOC, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return ranges.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, whose text lacks the lines of later copies, with further columns _n_lines, _n_deleted and _deleted (ranges).

    Text null: stays null, no lines. Text empty: one empty line, which stays. A text all of whose lines go is empty.
    Rows with one doc_id and text are one document, and all of them keep their lines or lose them. Other columns pass."""
    gone = deleted_ranges(later_copies(repeated_positions(docs), min_words))
    keys = doc_key(F.col("text"))
    found = docs.select("*", keys[0].alias("_d"), keys[1].alias("_t")).join(gone.select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("gone").alias("_deleted")).hint("merge"), ["_d", "_t"], "left")
    lines, ranges = F.split("text", "\n", -1), F.col("_deleted")
    n = F.size("_deleted")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(ranges, i - 1)["e"])
    end = lambda i, size: F.when(i == n, size).otherwise(F.get(ranges, i)["s"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, begin(i) + 1, end(i, F.size(lines)) - begin(i))))
    text = F.when(ranges.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_deleted = F.coalesce(F.aggregate(ranges, F.lit(0), lambda a, x: a + x["e"] - x["s"]), F.lit(0)).cast("long")
    more = [n_lines.alias("_n_lines"), n_deleted.alias("_n_deleted"), F.coalesce(F.array_join(F.transform(ranges, lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ","), F.lit("")).alias("_deleted")]
    return found.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), *more)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), F.col("_deleted").alias("deleted"), "text")


#: All pairs of equal lines, joined along diagonals to maximal runs: another way than the suffix array's.
OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, (unnest(range(len(l))))::BIGINT AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines
), upto AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM counted
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, b.pos - a.pos AS shift, b.pos AS pos, b.words, b.c FROM upto a JOIN upto b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))
), diagonal AS (
  SELECT *, pos - row_number() OVER (PARTITION BY a, b, shift ORDER BY pos) AS g FROM pairs
), stretches AS (
  SELECT a, b, shift, min(pos) AS s, max(pos) + 1 AS e FROM diagonal GROUP BY a, b, shift, g HAVING sum(words) >= {MIN_WORDS}
), starts AS (
  SELECT b, unnest(CASE WHEN a = b AND e - s > shift THEN range(s, e - shift + 1) ELSE [s] END) AS s, CASE WHEN a = b THEN least(shift, e - s) ELSE e - s END AS n FROM stretches
), runs AS (
  SELECT DISTINCT x.b AS doc_id, x.s, x.s + x.n AS e FROM starts x JOIN upto l ON l.doc_id = x.b AND l.pos = x.s JOIN upto r ON r.doc_id = x.b AND r.pos = x.s + x.n - 1 WHERE r.c - l.c + l.words >= {MIN_WORDS}
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM runs f JOIN lines l ON l.doc_id = f.doc_id AND l.pos >= f.s AND l.pos < f.e
), islands AS (
  SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g
), ranges AS (
  SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS deleted, sum(e - s)::BIGINT AS n_deleted FROM islands GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(r.n_deleted, 0)::BIGINT AS n_deleted, coalesce(r.deleted, '') AS deleted,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN ranges r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
