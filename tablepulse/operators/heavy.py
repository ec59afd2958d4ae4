"""The most frequent values of a column, proved by a summary of frequent items.

A mergeable frequent-items sketch names candidates and, of all other values, bounds how often they stand: no more than twice the
sketch's error, a known part of the rows, or the estimate of the last candidate when the list is full. The candidates are counted exactly. If
the last of the wanted values stands more often than that bound, or the candidates are all the values there are, the answer is proved and
only candidates were shuffled. Else (a near-unique column, many ties) every value is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.operators.frame import Table, same_rows

#: Items that a sketch keeps track of, and the part of the rows that its estimates are off by at most.
TRACKED = 10_000
ERROR = 3.5 / (1 << (TRACKED * 4 // 3).bit_length())
#: Types whose values come back from the driver as they were.
SAFE = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.DecimalType)


def candidates(k: int) -> int:
    """Values that are asked of the sketch for k of them."""
    return min(4 * k + 16, 1000)


def exact_counts(table: Table, i: int) -> DataFrame:
    """(value, n, text) of all present values."""
    values = table.df.select(table.value(i).alias("value")).where("value is not null")
    return values.groupBy("value").agg(F.count("*").alias("n")).withColumn("text", F.col("value").cast("string"))


def most_frequent(table: Table, i: int, k: int) -> DataFrame:
    """(value, n, text) of the k most frequent values, ties by their text, in that order."""
    found = _proved(table, i, k) if isinstance(table.kind(i), SAFE) and k <= 250 and same_rows(table.df) else None
    if found is None:
        return exact_counts(table, i).orderBy(F.desc("n"), "text").limit(k)
    schema = T.StructType([T.StructField("value", table.kind(i)), T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])
    return table.df.sparkSession.createDataFrame(found, schema)


def _proved(table: Table, i: int, k: int) -> list[tuple] | None:
    values = table.df.select(table.value(i).alias("value")).where("value is not null")
    most = candidates(k)
    seen = values.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(value, {most}, {TRACKED})").alias("top")).first()
    if not seen.n:
        return []
    if not seen.top:
        return None
    bound = max(2 * ERROR * seen.n, min(r["count"] for r in seen.top) if len(seen.top) == most else 0)
    counts = values.where(F.col("value").isin([r.item for r in seen.top])).groupBy("value").agg(F.count("*").alias("n")).withColumn("text", F.col("value").cast("string"))
    rows = sorted(counts.collect(), key=lambda r: (-r.n, r.text.encode()))
    complete = sum(r.n for r in rows) == seen.n
    if complete or (len(rows) >= k and rows[k - 1].n > bound):
        return [tuple(r) for r in rows[:k]]
    return None
