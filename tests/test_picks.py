import datetime
import random
from decimal import Decimal

import pytest

from tablepulse.operators import picks
from tablepulse.operators.frame import Table
from tablepulse.operators.semantic import infer_types

SCHEMA = "a long, b string, c double, d date, e decimal(12,3), f boolean, g string"


def rows_of(n):
    rng = random.Random(2)
    some = lambda x, share: x if rng.random() < share else None
    return [(i, some(f"v{i} é", 0.5), some(rng.choice([i / 3, float("nan")]), 0.9), some(datetime.date(2020, 1, 1) + datetime.timedelta(i), 0.02), some(Decimal(i) / 8, 0.7), some(i % 3 == 0, 0.3), None) for i in range(n)]


def plain(rows, column, size):
    values = [r[column] for r in rows if r[column] is not None and r[column] == r[column]]
    n = len(values)
    return values if n <= size else [values[i * (n - 1) // (size - 1)] for i in range(size)] if size > 1 else values[:1]


@pytest.mark.parametrize("size", [1, 2, 25, 300, 5000])
def test_places_of_every_column(spark, tmp_path, size):
    rows = rows_of(1000)
    for k, at in enumerate(range(0, 1000, 170)):  # files in order, partitions of one or several of them
        spark.createDataFrame(rows[at : at + 170], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/t/k={k}")
    df = spark.read.parquet(f"{tmp_path}/t").select("a", "b", "c", "d", "e", "f", "g")
    order = [r.a for r in df.collect()]
    rows = sorted(rows, key=lambda r: order.index(r[0]))
    table = Table.of(df)
    present = {i: sum(r[i] is not None and r[i] == r[i] for r in rows) for i in range(7)}
    assert picks.picked_values(table, present, size) == {i: plain(rows, i, size) for i in range(7)}


def test_counts_of_another_table_are_refused(spark):
    table = Table.of(spark.range(10))
    with pytest.raises(RuntimeError, match="id"):
        picks.picked_values(table, {0: 12}, 100)


def jobs_of(spark, work):
    context, group = spark.sparkContext, f"g{random.random()}"
    context.setJobGroup(group, "")
    work()
    found = len(context.statusTracker().getJobIdsForGroup(group))
    context.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_jobs_do_not_grow_with_the_columns(spark):
    def types(columns):
        df = spark.range(30_000).selectExpr(*(f"CASE WHEN id % {k + 2} > 0 THEN id * {k + 1} END AS c{k}" for k in range(columns)))
        table = Table.of(df)
        present = {i: 30_000 - -(-30_000 // (i + 2)) for i in range(columns)}
        return jobs_of(spark, lambda: picks.picked_values(table, present, 1000))

    assert types(2) == types(12)


def test_types_as_of_all_values(spark):
    """A sampled column keeps the type that it has when all of it is looked at."""
    df = spark.range(30_000).selectExpr("id AS user_id", "CASE WHEN id % 3 > 0 THEN 'ab-' || id END AS code", "CASE WHEN id % 2 > 0 THEN date_format(date_add(DATE'2020-01-01', int(id % 900)), 'yyyy-MM-dd') END AS day")
    from tablepulse.config import SemanticConfig

    some, every = (infer_types(df, SemanticConfig(inspected_values=n)) for n in (1000, 40_000))
    assert [t.semantic_type for t in some] == [t.semantic_type for t in every] and all(t.sampled for t in some)
