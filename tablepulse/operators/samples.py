"""Evenly spaced samples and what is read from them: rising sequences, text features, scatter points, missing-value maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.functions.text import has_punctuation, has_whitespace, matches
from tablepulse.operators.facts import missing_counts
from tablepulse.operators.frame import Table, evenly_spaced, in_scan_order
from tablepulse.operators.numeric import top_classes


def rising(df: DataFrame, name: str, *order: str, size: int = 10_000) -> DataFrame:
    """One row: inspected and strictly_increasing, over an evenly spaced sample of non-missing values in order."""
    sample = evenly_spaced(df.select(*{name, *order}).where(F.col(name).isNotNull()), size, *order)
    before = F.lag(name).over(Window.orderBy("_pos"))  # size rows at most
    return sample.select((F.col(name) > before).alias("up")).agg(F.count("*").alias("inspected"), F.coalesce(F.min("up"), F.lit(True)).alias("strictly_increasing"))


def text_features(df: DataFrame | Table, name: str) -> DataFrame:
    """One row: n, average_length, and the shares of values with white space and with punctuation."""
    table = Table.of(df)
    c = table.value(table.position(name))
    return table.df.select(c.alias("v")).where("v is not null").agg(
        F.count("*").alias("n"), F.avg(F.length("v")).alias("average_length"), F.avg(has_whitespace(F.col("v")).cast("double")).alias("whitespace_share"), F.avg(has_punctuation(F.col("v")).cast("double")).alias("punctuation_share")
    )


def pattern_shares(df: DataFrame | Table, name: str, patterns: dict[str, str]) -> DataFrame:
    """One row: n and, for each pattern, how many stripped values are of it."""
    table = Table.of(df)
    c = table.value(table.position(name))
    return table.df.select(c.alias("v")).where("v is not null").agg(F.count("*").alias("n"), *(F.count_if(matches(F.col("v"), p)).alias(k) for k, p in patterns.items()))


def scatter(df: DataFrame | Table, x: str, y: str, target: str | None = None, points: int = 400, order: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, class_number): up to points evenly spaced rows where both are finite; of the ten most frequent classes of target."""
    table = Table.of(df)
    by = [f"_c{table.position(o)}" for o in order]
    columns = [table.finite(table.position(x)).alias("x"), table.finite(table.position(y)).alias("y"), *map(F.col, by)]
    if target:
        t = table.position(target)
        top = top_classes(table, t).select(F.col("value").alias("class"), "class_number")
        rows = table.df.select(*columns, table.value(t).alias("class")).join(F.broadcast(top), "class")
    else:
        rows = table.df.select(*columns, F.lit(None).cast("int").alias("class_number"))
    return evenly_spaced(rows.where("x is not null and y is not null"), points, *by).select("_pos", "x", "y", "class_number")


def missing_map(df: DataFrame | Table, rows: int = 60, columns: int = 20, order: tuple[str, ...] = ()) -> DataFrame:
    """(row_number, column_name, missing) of evenly spaced rows and the columns that miss most."""
    table = Table.of(df)
    worst = missing_counts(table).orderBy(F.desc("missing_percentage"), "position").limit(columns).select("position").collect()
    sample = evenly_spaced(table.df, rows, *(f"_c{table.position(o)}" for o in order))
    cells = F.array(*(F.struct(F.lit(table.names[r.position]).alias("column_name"), table.missing(r.position).alias("missing")) for r in worst))
    return sample.select((F.col("_pos") + 1).alias("row_number"), F.explode(cells).alias("x")).select("row_number", "x.*")


def missing_ranking(df: DataFrame | Table, most: int = 5) -> DataFrame:
    return missing_counts(df).orderBy(F.desc("missing_percentage"), "position").limit(most)


def top_and_other(df: DataFrame | Table, name: str, most: int = 10) -> DataFrame:
    """(rank, label, n): the most frequent values, and all others together."""
    table = Table.of(df)
    i = table.position(name)
    top = top_classes(table, i, most).select(F.col("class_number").alias("rank"), F.col("text").alias("label"), "n")
    every = table.df.agg(F.count(table.value(i)).alias("n"))
    rest = every.join(F.broadcast(top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown")))).select((F.col("n") - F.col("shown")).alias("n"))  # a row each
    return top.unionByName(rest.where("n > 0").select(F.lit(most + 1).alias("rank"), F.lit("Other (remaining categories)").alias("label"), "n"))


def first_values(df: DataFrame | Table, name: str, most: int = 5_000) -> DataFrame:
    """(position, value): a column's first non-missing values in scan order."""
    table = Table.of(df)
    values = table.df.select(table.value(table.position(name)).alias("value")).where("value is not null")
    return in_scan_order(values).where(F.col("_pos") < most).select(F.col("_pos").alias("position"), "value")
