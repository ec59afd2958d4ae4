import datetime
import random
from decimal import Decimal

import pyarrow as pa

from tablepulse.operators import facts, wide
from tablepulse.operators.frame import Table

SCHEMA = "a string, b binary, c boolean, d tinyint, e smallint, f int, g bigint, h float, i double, j decimal(20,3), k date, l timestamp, m timestamp_ntz, n array<int>, o string"


def rows_of(n):
    rng = random.Random(7)
    some = lambda x: None if rng.random() < 0.2 else x
    z = lambda: rng.randint(-3, 3)
    day = datetime.datetime(2024, 3, 31, 1, 30)
    return [
        (some("é" * abs(z())), some(bytes(abs(z()))), some(z() > 0), some(z()), some(z()), some(z()), some(z() * 10**12), some(rng.choice([0.0, -0.0, float("nan"), 0.5])), some(rng.choice([0.0, -0.0, float("nan"), float("inf"), 1e-300])),
         some(Decimal(z()) / 8), some(day.date() + datetime.timedelta(z())), some(day + datetime.timedelta(hours=z())), some(day + datetime.timedelta(hours=z())), some([z()]), some("x" * rng.choice([63, 64, 65, 66, 5000])))
        for _ in range(n)
    ]


def test_as_one_aggregate_a_column(spark, monkeypatch):
    for n in (0, 1, 700):
        df = spark.createDataFrame(rows_of(n), SCHEMA).repartition(3)
        found = []
        for most in (50, 0):
            monkeypatch.setattr(facts, "WIDE", most)
            found.append(sorted(map(tuple, facts.column_facts(df).collect())))
        assert found[0] == found[1] and len(found[0]) == 15


def test_one_shuffle_of_values_for_any_number_of_columns(spark):
    plans = []
    for columns in (20, 1000):
        table = Table.of(spark.range(100).selectExpr(*(f"id % {k + 2} AS c{k}" for k in range(columns))))
        rows = wide.value_rows(table, list(range(columns))).groupBy("c", "value").count()
        plans.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert plans == [1, 1]
    n, found = wide.counted(table)
    assert n == 100 and found == {k: (100, min(k + 2, 100)) for k in range(1000)}


def test_long_values_are_told_apart():
    digest = wide.as_bytes(pa.array(["x" * 65]))[0].as_py()
    assert len(set(wide.as_bytes(pa.array([digest, b"x" * 65, b"y" * 65, b"x" * 64, b""])).to_pylist())) == 5
