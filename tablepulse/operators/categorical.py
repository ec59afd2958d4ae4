"""Statistics of categories, dates and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tablepulse.functions.dates import iso_text, native_micros, read_text
from tablepulse.functions.text import WHITESPACE, display, normalized
from tablepulse.operators.facts import percent, union, value_counts
from tablepulse.operators.frame import Table
from tablepulse.operators.heavy import most_frequent


def stacked_counts(table: Table, names: list[str]) -> DataFrame:
    """(column_name, value, n): how often each value of each column stands, values as text, missing ones left out."""
    return union([value_counts(table, table.position(c)).where("value is not null").select(F.lit(c).alias("column_name"), F.col("value").cast("string").alias("value"), "n") for c in names])


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column, ties by text; Spark keeps no more than k rows of a column in a task."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_values(df: DataFrame | Table, names: list[str], k: int = 10, display_length: int = 200) -> DataFrame:
    """(column_name, rank, value, n, percentage, truncated, original_length, fingerprint) of the k most frequent values of each column,
    and of all its values non_null_count, category_count and entropy_bits."""
    counts = stacked_counts(Table.of(df), names)
    totals = _totals(counts)
    shown = _ranked(counts, k).join(F.broadcast(totals), "column_name").withColumn("shown", display(F.col("value"), display_length))  # one row a column
    return shown.select("column_name", "rank", F.col("shown.value").alias("value"), "n", percent(F.col("n"), F.col("non_null_count")).alias("percentage"), "shown.truncated", "shown.original_length", "shown.fingerprint", "non_null_count", "category_count", "entropy_bits")


def _totals(counts: DataFrame) -> DataFrame:
    found = counts.groupBy("column_name").agg(F.sum("n").alias("non_null_count"), F.count("*").alias("category_count"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return found.select("column_name", "non_null_count", "category_count", F.greatest(F.log2("non_null_count") - F.col("s") / F.col("non_null_count"), F.lit(0.0)).alias("entropy_bits"))


def summarized(names: list[str], top: list[Row]) -> dict[str, dict]:
    """The summary of each column, from the rows of top_values."""
    out: dict[str, dict] = {c: {"non_null_count": 0, "category_count": 0, "mode": None, "mode_count": None, "top_category_share": None, "other_value_count": 0, "entropy_bits": None, "high_cardinality": False, "top_values": []} for c in names}
    for r in sorted(top, key=lambda r: (r.column_name, r.rank)):
        x = out[r.column_name]
        if r.rank == 1:
            x |= {"non_null_count": r.non_null_count, "category_count": r.category_count, "mode": r.value, "mode_count": r.n, "top_category_share": r.percentage, "other_value_count": r.non_null_count, "entropy_bits": r.entropy_bits, "high_cardinality": r.category_count > max(20, int(r.non_null_count * 0.5))}
        x["other_value_count"] -= r.n
        x["top_values"].append({k: r[k] for k in ("rank", "value", "n", "percentage", "truncated", "original_length", "fingerprint")})
    return out


def frequencies(df: DataFrame | Table, name: str, k: int = 10, display_length: int = 200) -> DataFrame:
    """(rank, value, n, percentage, truncated, original_length, fingerprint): the k most frequent values of a column."""
    table = Table.of(df)
    i = table.position(name)
    total = table.df.agg(F.count(table.value(i)).alias("total"))
    order = Window.orderBy(F.desc("n"), "text")
    top = most_frequent(table, i, k).select(F.row_number().over(order).alias("rank"), "n", display(F.col("text"), display_length).alias("shown"))  # k rows
    shown = top.join(F.broadcast(total))  # one row
    return shown.select("rank", F.col("shown.value").alias("value"), "n", percent(F.col("n"), F.col("total")).alias("percentage"), "shown.truncated", "shown.original_length", "shown.fingerprint")


def category_summary(df: DataFrame | Table, names: list[str], k: int = 10) -> DataFrame:
    """(column_name, non_null_count, category_count, mode, mode_count, top_category_share, other_value_count, entropy_bits,
    high_cardinality) per column, all in one job."""
    counts = stacked_counts(Table.of(df), names)
    total = _totals(counts)
    top = _ranked(counts, k).groupBy("column_name").agg(F.sum("n").alias("top"), F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("mode"), F.max("n").alias("mode_count"))
    every = total.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
    joined = every.join(F.broadcast(total), "column_name", "left").join(F.broadcast(top), "column_name", "left")  # one row a column
    n = F.coalesce("non_null_count", F.lit(0))
    return joined.select(
        "column_name", n.alias("non_null_count"), F.coalesce("category_count", F.lit(0)).alias("category_count"), "mode", "mode_count", F.when(n > 0, percent(F.col("mode_count"), n)).alias("top_category_share"),
        (n - F.coalesce("top", F.lit(0))).alias("other_value_count"), "entropy_bits",
        (F.coalesce("category_count", F.lit(0)) > F.greatest(F.lit(20), F.floor(n * 0.5))).alias("high_cardinality"),
    )


def collisions(df: DataFrame | Table, *names: str) -> DataFrame:
    """(column_name, non_null_count, collision_groups, affected_rows), of values that differ but are alike once trimmed and case-folded."""
    counts = stacked_counts(Table.of(df), list(names)).withColumn("folded", normalized(F.col("value")))
    groups = counts.groupBy("column_name", "folded").agg(F.count("*").alias("forms"), F.sum("n").alias("n"))
    several = F.col("forms") > 1
    found = groups.groupBy("column_name").agg(F.sum("n").alias("non_null_count"), F.count_if(several).alias("collision_groups"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("affected_rows"))
    every = found.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
    return every.join(F.broadcast(found), "column_name", "left").na.fill(0)  # one row a column


DATETIMES = "column_name string, parsed_count long, unparsed_count long, ambiguous_count long, timezone_state string, earliest string, latest string, span_seconds double"


def datetime_summary(df: DataFrame | Table, *names: str) -> DataFrame:
    """A row for each column: parsed_count, unparsed_count, ambiguous_count, timezone_state (none, naive, aware, mixed), earliest, latest
    (ISO; aware ones in UTC) and span_seconds; no range across mixed states.

    Date and time columns take one aggregate together; of texts, each distinct value is read once."""
    table = Table.of(df)
    at = [table.position(n) for n in names]
    found: dict[int, tuple] = {}  # parsed, unparsed, ambiguous, naive, aware, low, high
    if native := [i for i in at if table.is_temporal(i)]:
        micros = {i: native_micros(table.value(i), table.dtype(i)) for i in native}
        r = table.df.agg(*(x for i, m in micros.items() for x in (F.count(m).alias(f"n{i}"), F.min(m).alias(f"low{i}"), F.max(m).alias(f"high{i}")))).first()
        for i in native:
            n, aware = r[f"n{i}"], table.dtype(i) == "timestamp"
            found[i] = (n, 0, 0, 0 if aware else n, n if aware else 0, r[f"low{i}"], r[f"high{i}"])
    of = lambda *s: F.coalesce(F.sum(F.when(F.col("x.state").isin(*s), F.col("n"))), F.lit(0))
    for i in at:
        if i not in found:
            unread = F.struct(F.lit("unparsed").alias("state"), F.lit(None).cast("long").alias("micros"))
            read = value_counts(table, i).where("value is not null").select("n", (read_text(F.col("value")) if table.is_text(i) else unread).alias("x"))
            found[i] = tuple(read.agg(of("naive", "aware"), of("unparsed"), of("ambiguous"), of("naive"), of("aware"), F.min("x.micros"), F.max("x.micros")).first())
    rows = []
    for name, i in zip(names, at, strict=True):
        parsed, unparsed, ambiguous, naive, aware, low, high = found[i]
        zone = "none" if not parsed else "mixed" if naive and aware else "aware" if aware else "naive"
        ranged = zone in ("naive", "aware")
        earliest, latest = (iso_text(x, zone == "aware") if ranged else None for x in (low, high))
        rows.append((name, parsed, unparsed, ambiguous, zone, earliest, latest, (high - low) / 1e6 if ranged else None))
    return table.df.sparkSession.createDataFrame(rows, DATETIMES)


def text_summary(df: DataFrame | Table, names: list[str]) -> DataFrame:
    """(column_name, minimum_length, maximum_length, average_length, median_length, empty_string_count, whitespace_only_count)
    per column, lengths in code points; one pass, but for the median, which counts lengths."""
    table = Table.of(df)
    frames = []
    for name in names:
        c = table.value(table.position(name)).cast("string")
        size = F.length(c)
        by = table.df.select(size.alias("size"), (c == "").alias("empty"), c.rlike(f"^{WHITESPACE}+$").alias("blank")).where("size is not null").groupBy("size").agg(F.count("*").alias("n"), F.count_if("empty").alias("empty"), F.count_if("blank").alias("blank"))
        frames.append(
            by.agg(
                F.lit(name).alias("column_name"), F.min("size").alias("minimum_length"), F.max("size").alias("maximum_length"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("average_length"),
                F.percentile("size", F.lit(0.5), F.col("n")).alias("median_length"), F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_string_count"), F.coalesce(F.sum("blank"), F.lit(0)).alias("whitespace_only_count"),
            )
        )
    return union(frames)
