"""Facts of columns and of the whole table: counts of rows, nulls, distinct values and duplicates.

Each column is grouped by its value once; from that come its rows, nulls and distinct values. Up to WIDE columns are read apart, so
all of them together read the table once, nothing is expanded, and values are counted before they are shuffled. More columns share
one stage and one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.operators.frame import Table
from tablepulse.operators.repeats import duplicate_flags, duplicate_rows  # noqa: F401
from tablepulse.operators.wide import counted, countable

#: Columns up to which each is an aggregate of its own.
WIDE = 16


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)


def value_counts(table: Table, i: int) -> DataFrame:
    """(value, n): how often each value of a column stands; all missing values are one null."""
    return table.df.select(table.value(i).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def _one(table: Table, i: int) -> DataFrame:
    if table.is_comparable(i):
        counts = value_counts(table, i).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("value").alias("distinct_count"))
    else:
        counts = table.df.agg(F.count("*").alias("row_count"), F.count_if(table.missing(i)).alias("null_count")).withColumn("distinct_count", F.lit(None).cast("long"))
    return counts.select(F.lit(i).alias("position"), F.lit(table.names[i]).alias("column_name"), F.lit(table.dtype(i)).alias("dtype"), "row_count", "null_count", "distinct_count")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def column_facts(df: DataFrame | Table) -> DataFrame:
    """A row per column: position, column_name, dtype, row_count, null_count, non_null_count, distinct_count,
    missing_percentage (of all rows) and distinct_ratio (of non-missing values; null without any)."""
    table = Table.of(df)
    if len(table) > WIDE and countable(table):
        n, found = counted(table)
        known = [(i, table.names[i], table.dtype(i), n, n - found[i][0], found[i][1]) for i in range(len(table))]
        rows = table.df.sparkSession.createDataFrame(known, "position int, column_name string, dtype string, row_count long, null_count long, distinct_count long")
    else:
        rows = union([_one(table, i) for i in range(len(table))])
    present = F.col("row_count") - F.col("null_count")
    return rows.select(
        "position", "column_name", "dtype", "row_count", "null_count", present.alias("non_null_count"), "distinct_count",
        percent(F.col("null_count"), F.col("row_count")).alias("missing_percentage"), F.try_divide("distinct_count", present).alias("distinct_ratio"),
    )


def missing_counts(df: DataFrame | Table) -> DataFrame:
    """Missing values of every column in one pass: column_name, position, null_count, non_null_count, missing_percentage."""
    table = Table.of(df)
    counted = table.df.agg(F.count("*").alias("rows"), *(F.count_if(table.missing(i)).alias(f"m{i}") for i in range(len(table))))
    columns = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.col(f"m{i}").alias("null_count")) for i, n in enumerate(table.names)))
    each = counted.select("rows", F.explode(columns).alias("x")).select("rows", "x.*")
    return each.select("column_name", "position", "null_count", (F.col("rows") - F.col("null_count")).alias("non_null_count"), percent(F.col("null_count"), F.col("rows")).alias("missing_percentage"))


def dataset_summary(df: DataFrame | Table) -> DataFrame:
    """One row: rows, columns, cells, missing cells and duplicates. data_bytes estimates the values' size, not that of objects in memory."""
    table = Table.of(df)
    n = len(table)
    size = [F.sum(F.octet_length(F.col(f"_c{i}"))) if table.is_text(i) else F.count(F.col(f"_c{i}")) * 8 for i in range(n)]
    missing = sum((F.count_if(table.missing(i)) for i in range(n)), F.lit(0))
    data = sum((F.coalesce(s, F.lit(0)) for s in size), F.lit(0))
    counted = table.df.agg(F.count("*").alias("row_count"), missing.alias("missing_cell_count"), data.alias("data_bytes"))
    cells = F.col("row_count") * n
    both = counted.join(duplicate_rows(table), "row_count")  # a row each, of the same table
    return both.select("row_count", F.lit(n).cast("long").alias("column_count"), cells.alias("cell_count"), "missing_cell_count", percent(F.col("missing_cell_count"), cells).alias("missing_percentage"), "duplicate_row_count", "duplicate_row_percentage", "data_bytes")


def identifier_duplicates(df: DataFrame | Table, name: str) -> DataFrame:
    """One row: non_null_count, duplicate_identifier_count (beyond each first) and its percentage of non-missing values."""
    table = Table.of(df)
    counts = value_counts(table, table.position(name)).where("value is not null")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("non_null_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_identifier_count"))
    return total.withColumn("duplicate_percentage", percent(F.col("duplicate_identifier_count"), F.col("non_null_count")))


def type_histogram(types: DataFrame) -> DataFrame:
    """(effective_type, n) in the types' own order, without types that don't occur, of a frame with column effective_type."""
    from tablepulse.operators.semantic import TYPES

    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("effective_type"))
    return types.groupBy("effective_type").agg(F.count("*").alias("n")).withColumn("rank", rank).orderBy("rank").drop("rank")
