"""Trimming and case folding are expressions of Spark, equal to Python's for every character."""

from pyspark.sql import functions as F

from tablepulse.functions.text import normalized
from tablepulse.operators import categorical


def test_every_character(spark):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = []
    for at in range(0, len(points), 40):
        some = [chr(p) for p in points[at : at + 40]]
        texts += [" " + "".join(some), "ẞaß".join(some) + " "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalized(F.col("t")).alias("n")).collect()
    assert all(r.n == r.t.strip().casefold() for r in got)


def test_single_texts(spark):
    texts = ["", " ", "\x1c Straße \x85", "ŉ İstanbul ΣΑΣ ς", "ﬃ", "𐐀Ꭰꭰ", "a\x00B", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalized(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [None if t is None else t.strip().casefold() for t in texts]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("A ",), ("a",), ("ß",), ("SS",), ("b",)], "v string")
    found = categorical.collisions(df, "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert tuple(found.first())[1:] == (5, 2, 4)
