"""Repeated rows: found by 128-bit digests, then proved on the values of the rows whose digest repeats.

Only digests and counts are shuffled, whatever a row's width. A digest that stands once belongs to a row that stands once; the
others' rows, which a scan picks by a broadcast of the digests (up to REPEATED of them, else by a join), are grouped by their values, so
two rows that share a digest by chance still count as two. Rows as narrow as a digest, tables of up to SMALL bytes by the planner's
estimate, and plans that may give other rows when they run again are grouped by their values at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.operators.frame import FRACTIONAL, Table, same_rows

#: Repeated digests, of 16 bytes each, up to which they are broadcast.
REPEATED = 500_000
#: Bytes of a table, as far as the planner knows them, that are shuffled sooner than read twice.
SMALL = 64 << 20
#: Bytes of a digest; rows of fixed width up to that are their own.
DIGEST_BYTES = 16
WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}
DUPLICATES = "row_count long, duplicate_row_count long, duplicate_row_percentage double"


def digest(table: Table, columns: list[int]) -> tuple[Column, Column]:
    """Two hashes of a row's values, missing ones told from others and equal to each other, as are both zeros."""
    values = [table.value(i) + F.lit(0.0) if isinstance(table.kind(i), FRACTIONAL) else table.value(i) for i in columns]
    parts = [x for v in values for x in (v.isNull(), v)]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def narrow(table: Table, columns: list[int]) -> bool:
    widths = [WIDTHS.get(type(table.kind(i))) for i in columns]
    return None not in widths and sum(w for w in widths if w) <= DIGEST_BYTES


def at_once(table: Table, columns: list[int]) -> bool:
    """Whether rows are grouped by their values, without digests."""
    size = int(str(table.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return narrow(table, columns) or size <= SMALL or not same_rows(table.df)


def marked(table: Table, columns: list[int], more: list[str]) -> DataFrame:
    """The columns more and the digest of columns, as _a and _b."""
    a, b = digest(table, columns)
    return table.df.select(*more, a.alias("_a"), b.alias("_b"))


def _of_digests(rows: DataFrame, digests: DataFrame, number: int, how: str) -> DataFrame:
    """rows joined with digests of that number."""
    return rows.join(F.broadcast(digests) if number <= REPEATED else digests.hint("merge"), ["_a", "_b"], how)


def duplicates(table: Table) -> tuple[int, int]:
    """(rows, rows beyond the first of their kind)."""
    columns = list(range(len(table)))
    values = [table.value(i).alias(f"_c{i}") for i in columns]
    named = [f"_c{i}" for i in columns]
    if at_once(table, columns):
        found = table.df.select(*values).groupBy(*named).count().agg(F.sum("count").alias("rows"), F.sum(F.col("count") - 1).alias("more")).first()
        return found.rows or 0, found.more or 0
    groups = marked(table, columns, []).groupBy("_a", "_b").count()
    found = groups.agg(F.sum("count").alias("rows"), F.count_if(F.col("count") > 1).alias("digests"), F.sum(F.when(F.col("count") > 1, F.col("count"))).alias("n")).first()
    if not found.digests:
        return found.rows or 0, 0
    repeated = groups.where("count > 1").select("_a", "_b")
    kinds = _of_digests(marked(table, columns, values), repeated, found.digests, "left_semi").groupBy(*named).agg(F.lit(1)).count()
    return found.rows, found.n - kinds


def duplicate_rows(df: DataFrame | Table) -> DataFrame:
    """One row: row_count, duplicate_row_count (beyond each first, missing values equal) and its percentage. Null if rows can't be compared."""
    table = Table.of(df)
    if not all(map(table.is_comparable, range(len(table)))):
        n, more = table.df.count(), None
    elif not len(table):
        n = table.df.count()
        more = max(n - 1, 0)
    else:
        n, more = duplicates(table)
    share = None if more is None else more * 100.0 / n if n else 0.0
    return table.df.sparkSession.createDataFrame([(n, more, share)], DUPLICATES)


def duplicate_flags(df: DataFrame | Table, *order: str) -> DataFrame:
    """df with is_duplicate: whether a row equals an earlier one (missing values equal), earlier by the columns of order, which tell rows apart.

    Digests that repeat come with the first of their rows; all other rows are firsts. Should different rows share a digest, the rows'
    values are the key. A first is an aggregate, made before the shuffle as well, so a frequent row's group is in no one task."""
    table = Table.of(df)
    by = [f"_c{table.position(o)}" for o in order]
    same = [i for i in range(len(table)) if f"_c{i}" not in by]
    first = F.min(F.struct(*by)).alias("first")
    groups = marked(table, same, by).groupBy("_a", "_b").agg(F.count("*").alias("n"), first).where("n > 1")
    keys = [table.value(i).alias(f"k{i}") for i in same]
    named = [f"k{i}" for i in same]
    shown = [F.col(f"_c{i}").alias(n) for i, n in enumerate(table.names)]
    direct, number = at_once(table, same), 0
    if not direct:
        number = groups.count()
        kinds = _of_digests(marked(table, same, keys), groups.select("_a", "_b"), number, "left_semi").groupBy("_a", "_b", *named).agg(F.lit(1))
        direct = number and kinds.groupBy("_a", "_b").count().where("count > 1").count()  # different rows of one digest
    if direct:
        firsts = table.df.groupBy(*keys).agg(first)
        equal = reduce(lambda a, b: a & b, [table.value(i).eqNullSafe(F.col(f"k{i}")) for i in same])
        return table.df.join(firsts, equal).select(*shown, (F.struct(*by) != F.col("first")).alias("is_duplicate"))
    rows = marked(table, same, [F.col(f"_c{i}") for i in range(len(table))])
    found = _of_digests(rows, groups.select("_a", "_b", "first"), number, "left")
    return found.select(*shown, F.coalesce(F.struct(*by) != F.col("first"), F.lit(False)).alias("is_duplicate"))
