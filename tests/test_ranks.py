import datetime
import random
from decimal import Decimal

import numpy as np
import pytest

from tablepulse.operators import frame, lineage, ranks

SCHEMA = "a long, b double, c string, d date, e decimal(10,2), f boolean, _c0 int"


def rows_of(n, seed=1):
    rng = random.Random(seed)
    texts = ["", "a", "a\x00", "ab", "é", "aaaaaaa", "aaaaaaab", "z" * 20, "日本", None]
    numbers = [0.0, -0.0, 1.5, -1.5, float("nan"), float("inf"), -float("inf"), 5e-324, None]
    day = datetime.date(2024, 1, 1)
    return [(rng.choice([None, -(2**63), 2**63 - 1, 3, 3, 3, i]), rng.choice(numbers), rng.choice(texts), rng.choice([None, day + datetime.timedelta(rng.randint(0, 3))]), rng.choice([None, Decimal(rng.randint(-300, 300)) / 100]), rng.choice([None, True, False]), rng.randint(0, 5)) for i in range(n)]


def key_of(row, places):
    def one(v):
        if v is None:
            return (0,)
        if isinstance(v, float):
            return (1, v != v, 0.0 if v != v else v + 0.0)
        return (1, v.encode()) if isinstance(v, str) else (1, v)

    return tuple(one(row[p]) for p in places)


@pytest.mark.parametrize(("order", "size"), [(["a"], 7), (["b"], 40), (["c"], 40), (["d", "e"], 1), (["f", "c", "b"], 40), (["e", "a", "c", "_c0"], 7), (["_c0"], 5000)])
def test_as_a_sort(spark, monkeypatch, order, size):
    """Few rows may be sorted and few cells counted, so that every step is taken."""
    monkeypatch.setattr(ranks, "SORTED", 10)
    monkeypatch.setattr(ranks, "CELLS", 32)
    rows = rows_of(900)
    got = sorted(frame.evenly_spaced(spark.createDataFrame(rows, SCHEMA).repartition(3), size, *order).collect(), key=lambda r: r._pos)
    n = len(rows)
    places = range(n) if size >= n else [0] if size == 1 else [i * (n - 1) // (size - 1) for i in range(size)]
    at = [SCHEMA.split(", ").index(next(f for f in SCHEMA.split(", ") if f.startswith(f"{o} "))) for o in order]
    wanted = sorted(key_of(r, at) for r in rows)
    assert [r._pos for r in got] == list(places)
    assert [key_of(r, at) for r in got] == [wanted[p] for p in places]


def test_ties_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SORTED", 10)
    df = spark.createDataFrame(rows_of(700), SCHEMA)
    picked = [sorted(map(repr, frame.evenly_spaced(df.repartition(k), 30, "f").collect())) for k in (1, 2, 5)]
    assert picked[0] == picked[1] == picked[2]


def test_long_text_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SORTED", 10)
    monkeypatch.setattr(ranks, "CELLS", 16)
    words = ["x" * 60 + str(i % 50) for i in range(400)]
    got = sorted(ranks.at_places(spark.createDataFrame([(w,) for w in words], "t string"), ["t"], [0, 9, 200, 399, 400]).collect(), key=lambda r: r._pos)
    assert [(r.t, r._pos) for r in got] == [(sorted(words)[p], p) for p in (0, 9, 200, 399)]
    same = spark.createDataFrame([(1, "x")] * 500 + [(0, "y"), (2, "z")], "k int, t string").repartition(4)
    got = sorted(frame.evenly_spaced(same, 6, "k").collect(), key=lambda r: r._pos)
    assert [(r.k, r._pos) for r in got] == [(0, 0), (1, 100), (1, 200), (1, 300), (1, 400), (2, 501)]


def test_no_rows(spark):
    assert frame.evenly_spaced(spark.createDataFrame([], SCHEMA), 5, "c", "a").collect() == []


def test_neither_written_nor_sorted(spark, monkeypatch):
    for module in (frame, lineage):
        monkeypatch.setattr(module, "written", lambda df: pytest.fail("the table is written"))
    df = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    picked = frame.evenly_spaced(df, 100, "l_extendedprice", "l_orderkey", "l_linenumber")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan
    places = np.array([r._pos for r in picked.collect()])
    assert sorted(places) == [i * (df.count() - 1) // 99 for i in range(100)]


def test_what_may_be_read_twice(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    small = spark.createDataFrame([("F",)], "o_orderstatus string")
    assert frame.repeatable(df) and frame.repeatable(df.where("o_orderkey > 5").select("o_orderkey")) and frame.repeatable(df.join(F.broadcast(small), "o_orderstatus"))
    assert frame.repeatable(spark.createDataFrame([(1,)], "a int")) and frame.repeatable(lineage.written(df))
    assert not frame.repeatable(df.where(F.rand() > 0.5)) and not frame.repeatable(df.repartition(3)) and not frame.repeatable(df.mapInArrow(lambda b: b, df.schema)) and not frame.repeatable(df.limit(5))
