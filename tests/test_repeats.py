import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablepulse.operators import repeats
from tablepulse.operators.frame import Table, same_rows

SCHEMA = "id long, a string, b double, c string, d decimal(20,2), a2 string"


def rows_of(n):
    rng = random.Random(4)
    return [(i, rng.choice(["x", "", None]), rng.choice([0.0, -0.0, float("nan"), None, 1.5]), rng.choice(["x", None]), None, rng.choice(["", "xx", None])) for i in range(n)]


def kind(row):
    return tuple(None if v != v else v for v in row[1:])


@pytest.fixture(params=["digests", "all alike", "joined", "at once"])
def digests(request, monkeypatch):
    """Digests that tell rows apart, one digest for all rows, more repeated digests than are broadcast, and no digests."""
    monkeypatch.setattr(repeats, "SMALL", (1 << 70) if request.param == "at once" else -1)
    if request.param == "all alike":
        monkeypatch.setattr(repeats, "digest", lambda table, columns: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    if request.param == "joined":
        monkeypatch.setattr(repeats, "REPEATED", 1)


@pytest.mark.parametrize("n", [0, 1, 3, 400])
def test_counts(spark, digests, n):
    rows = rows_of(n)
    found = repeats.duplicate_rows(spark.createDataFrame(rows, SCHEMA).repartition(3).drop("id")).first()
    more = n - len({kind(r) for r in rows})
    assert tuple(found) == (n, more, more * 100.0 / n if n else 0.0)


def test_flags(spark, digests):
    rows = rows_of(300)
    seen, want = Counter(), {}
    for r in rows:
        want[r[0]] = seen[kind(r)] > 0
        seen[kind(r)] += 1
    got = repeats.duplicate_flags(spark.createDataFrame(rows, SCHEMA).repartition(3), "id")
    assert got.columns == ["id", "a", "b", "c", "d", "a2", "is_duplicate"]
    assert {r.id: r.is_duplicate for r in got.collect()} == want and any(want.values())
    none = spark.createDataFrame([(i, str(i), None, None, None, None) for i in range(5)], SCHEMA)
    assert not any(r.is_duplicate for r in repeats.duplicate_flags(none, "id").collect())


def test_values_that_only_change_places(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("", None), (None, "")], "a string, b string")
    assert repeats.duplicate_rows(df).first().duplicate_row_count == 0


def test_only_digests_are_shuffled(spark):
    """The rows of pages have kilobytes each."""
    table = Table.of(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    groups = repeats.marked(table, [0, 1, 2], []).groupBy("_a", "_b").count()
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert not repeats.narrow(table, [0, 1, 2]) and "hashpartitioning(_a" in plan
    sent = groups._jdf.queryExecution().optimizedPlan().children().apply(0).output().toString()
    assert "_c" not in sent and "_a" in sent


def test_rows_that_change_are_counted_in_one_job(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b")).where(F.rand() < 0.5)
    assert not same_rows(df) and not same_rows(df.limit(3)) and same_rows(spark.range(5).repartition(2))
    found = repeats.duplicate_rows(df).first()
    assert 0 < found.row_count < 1000 and found.duplicate_row_count == 0


def test_incomparable_rows(spark):
    df = spark.createDataFrame([([1],)], "a array<int>")
    assert tuple(repeats.duplicate_rows(df).first()) == (1, None, None)
    assert tuple(repeats.duplicate_rows(spark.range(3).select()).first())[:2] == (3, 2)
