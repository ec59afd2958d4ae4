import math
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablepulse.operators import categorical, facts, numeric, samples
from tablepulse.operators.frame import Table, evenly_spaced

SETS = [[1, 2, 3, 4, 5], [-9, -2, 0, 3, 11], [2, 2, 2, 5, 5, 9], [0.125, 0.5, 1.25, 2.75, 9.875], [1e150, 1.1e150, 1.2e150, 1.3e150, 1.4e150], [-1e308, -5e307, 5e307, 1e308], [8e307, 9e307, 1e308], [7], [1, 2], [3, 3, 3, 3]]


def one(spark, values, dtype="double"):
    return spark.createDataFrame([(None if v is None else float(v),) if dtype == "double" else (v,) for v in values], f"x {dtype}")


def test_infinite_and_missing_numbers(spark):
    r = numeric.moments(one(spark, [-2, 0, 2, math.inf, -math.inf, None, math.nan])).first()
    assert (r.finite_count, r.positive_infinity_count, r.negative_infinity_count, r.zero_count, r.positive_count, r.negative_count) == (3, 1, 1, 1, 1, 1)
    assert (r.mean, r.variance, r.standard_deviation, r.minimum, r.maximum) == (0, 4, 2, -2, 2)
    q = numeric.quartiles(one(spark, [-2, 0, 2, math.inf])).first()
    assert (q.first_quartile, q["median"], q.third_quartile, q.interquartile_range) == (-1, 0, 1, 2)


@pytest.mark.parametrize("values", SETS)
def test_moments_against_formulas(spark, values):
    r = numeric.moments(one(spark, values)).first()
    n, scale = len(values), max(map(abs, values))
    v = [x / scale for x in values]
    mean = math.fsum(v) / n
    close = lambda a, b: a == pytest.approx(b, rel=1e-10, abs=1e-12)
    assert close(r.mean, mean * scale)
    if n == 1:
        assert r.variance is None and r.standard_deviation is None
        return
    s2 = statistics.variance(v)
    assert close(r.standard_deviation, math.sqrt(s2) * scale)
    assert r.variance is None if scale > 1e154 and s2 * scale > 1e308 / scale else close(r.variance, s2 * scale * scale)
    m2, m3, m4 = (math.fsum((x - mean) ** k for x in v) / n for k in (2, 3, 4))
    if n >= 3:
        assert close(r.skewness, 0.0 if m2 == 0 else m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2))
    else:
        assert r.skewness is None
    if n >= 4:
        assert close(r.kurtosis, 0.0 if m2 == 0 else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6))
    else:
        assert r.kurtosis is None


@pytest.mark.parametrize("how", ["linear", "lower", "higher", "midpoint", "nearest"])
def test_quantiles_of_five_kinds(spark, how):
    import pandas as pd

    for values in ([3, 1, 2, 2, 10, 7], [5], [1, 1, 9], list(range(101)), [0.1, 0.2, 0.30000001, 4]):
        for limit in (10**6, 0):
            got = numeric.quantiles(one(spark, values), "x", interpolation=how, limit=limit)
            assert got == pytest.approx([pd.Series(values, dtype=float).quantile(p, interpolation=how) for p in (0.25, 0.5, 0.75)]), (values, limit)
    assert numeric.quantiles(one(spark, [None, math.inf]), "x", interpolation=how) == [None] * 3


def test_frequencies_and_entropy(spark):
    df = one(spark, ["b", "a", "c", "b", "a", None], "string")
    for d in (df, df.orderBy("x"), df.repartition(5)):
        r = categorical.category_summary(d, ["x"], 2).first()
        assert (r.mode, r.mode_count, r.other_value_count, r.category_count) == ("a", 2, 1, 3) and r.entropy_bits == pytest.approx(1.5219280948873621)
        assert [(x.value, x.n, x.percentage) for x in categorical.frequencies(d, "x", 2).collect()] == [("a", 2, 40.0), ("b", 2, 40.0)]
    assert categorical.category_summary(one(spark, [None], "string"), ["x"]).first().category_count == 0
    long = categorical.frequencies(one(spark, ["y" * 300], "string"), "x").first()
    assert long.truncated and long.original_length == 300 and len(long.fingerprint) == 64


@pytest.mark.parametrize(("values", "n"), [([1, 2, 3], 0), ([1, 1], 1), ([1, 1, 1], 2), ([None, None, 1], 1), ([math.nan, None], 1), ([], 0), ([5], 0)])
def test_duplicates(spark, values, n):
    assert facts.duplicate_rows(one(spark, values)).first().duplicate_row_count == n
    s = facts.dataset_summary(one(spark, values)).first()
    assert (s.row_count, s.duplicate_row_count) == (len(values), n)


def test_facts_by_position_with_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, 2.0, "y")], "a long, b double, c string").toDF("A", "a", "A")
    rows = facts.column_facts(Table.of(df)).orderBy("position").collect()
    assert [(r.column_name, r.null_count, r.distinct_count) for r in rows] == [("A", 0, 1), ("a", 1, 1), ("A", 0, 2)]
    assert facts.column_facts(spark.createDataFrame([([1],), ([2],)], "v array<int>")).first().distinct_count is None


def test_dates(spark):
    r = categorical.datetime_summary(one(spark, [f"2024-01-0{i}" for i in range(1, 10)] + ["not-a-date"], "string"), "x").first()
    assert (r.parsed_count, r.unparsed_count, r.earliest, r.span_seconds) == (9, 1, "2024-01-01T00:00:00", 8 * 86400)
    r = categorical.datetime_summary(one(spark, ["01/02/2024", "03/04/2024", "05/06/2024"], "string"), "x").first()
    assert (r.parsed_count, r.ambiguous_count, r.timezone_state, r.earliest) == (0, 3, "none", None)
    r = categorical.datetime_summary(one(spark, ["03/03/2024", "2024-1-5", "20240101"], "string"), "x").first()
    assert (r.parsed_count, r.ambiguous_count, r.unparsed_count) == (2, 0, 1)
    r = categorical.datetime_summary(one(spark, ["2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00Z"], "string"), "x").first()
    assert (r.timezone_state, r.earliest, r.span_seconds) == ("aware", "2024-01-01T00:00:00+00:00", 0)
    assert categorical.datetime_summary(one(spark, ["2024-01-01T00:00:00Z", "2024-01-01"], "string"), "x").first().timezone_state == "mixed"
    r = categorical.datetime_summary(one(spark, [datetime(1969, 12, 31, 23, 59, 59, 5), None], "timestamp_ntz"), "x").first()
    assert r.earliest == "1969-12-31T23:59:59.000005"


def test_texts_and_collisions(spark):
    r = categorical.text_summary(one(spark, ["", "  \x1c", "🔥a", None, "abc"], "string"), ["x"]).first()
    assert (r.minimum_length, r.maximum_length, r.average_length, r.median_length, r.empty_string_count, r.whitespace_only_count) == (0, 3, 2.0, 2.5, 1, 1)
    r = categorical.collisions(one(spark, ["Straße", "STRASSE ", "ς", "Σ", "b", "b", None], "string"), "x").first()
    assert (r.collision_groups, r.affected_rows, r.non_null_count) == (2, 4, 6)


@pytest.mark.parametrize("expressions", [100, 0])
def test_correlations(spark, monkeypatch, expressions):
    monkeypatch.setattr(numeric, "EXPRESSION_PAIRS", expressions)
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, math.inf), (100.0, 200.0, 5.0, 2.0)], "x double, y double, c double, m double")
    got = {(r.left, r.right): (r.coefficient, r.observation_count) for r in numeric.correlations(df, ["x", "y", "c", "m"]).collect()}
    assert got[("x", "y")] == (pytest.approx(1.0), 4) and set(got) == {("x", "y"), ("x", "m"), ("y", "m")} and got[("x", "m")][1] == 2


def test_many_pairs_as_few(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_partkey", "l_quantity * 1e6 + 1e9 AS q", "l_extendedprice", "if(l_linenumber = 3, null, l_tax) AS t", "1e300 * l_discount AS d", "5 AS c", "if(l_linenumber = 1, 7, null) AS k")
    both = []
    for most in (100, 0):
        monkeypatch.setattr(numeric, "EXPRESSION_PAIRS", most)
        both.append({(r.left, r.right): (r.coefficient, r.observation_count) for r in numeric.correlations(df, df.columns).collect()})
    few, many = both
    many = {p: v for p, v in many.items() if "d" not in p}  # products near 1e300 overflow in the expression only
    few = {p: v for p, v in few.items() if "d" not in p}
    assert set(few) == set(many) and len(few) == 6
    for p, (r, n) in few.items():
        assert many[p] == (pytest.approx(r, abs=1e-9), n)


def test_histogram_and_boxes(spark):
    got = numeric.histogram(one(spark, [0, 1, 2, 3, 4, 10, None, math.inf]), "x").collect()
    assert [r["count"] for r in got] == [4, 1, 1] and got[0].low == 0 and got[-1].high == 10
    assert [r["count"] for r in numeric.histogram(one(spark, [7, 7]), "x").collect()] == [2]
    assert numeric.histogram(one(spark, [None]), "x").count() == 0
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("a", 100.0), ("b", 1.0)], "k string, v double")
    r = {x["class"]: x for x in numeric.grouped_boxes(df, "v", "k").collect()}
    assert r["a"].outlier_count == 1 and r["a"].upper_whisker == 9 and r["b"].n == 1
    assert numeric.outliers(df, ["v"]).first().outlier_count == 1


@pytest.mark.parametrize(("n", "size"), [(10, 10), (11, 10), (101, 10), (5, 2), (3, 2), (1000, 999), (9, 1), (0, 5)])
def test_evenly_spaced(spark, n, size):
    want = [i * (n - 1) // (size - 1) for i in range(size)] if n > size > 1 else [0] * min(n, 1) if size == 1 else list(range(n))
    assert sorted(r._pos for r in evenly_spaced(spark.range(n).repartition(3), size).collect()) == want


def test_rising_and_maps(spark):
    assert samples.rising(spark.range(50), "id", "id").first().strictly_increasing
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(100)], "k long, v long")
    got = samples.missing_map(df, 10, 1, order=("k",)).collect()
    assert len(got) == 10 and {r.column_name for r in got} == {"v"}
    assert samples.top_and_other(one(spark, list("aabbc"), "string"), "x", 2).orderBy("rank").collect()[-1].n == 1


@pytest.mark.parametrize("advisory", ["64m", "2k"])
def test_evenly_spaced_after_a_shuffle(spark, advisory):
    """Rows that a shuffle has dealt out keep one order, however small the partitions that adaptive execution makes."""
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, advisory)
    try:
        left = spark.range(20_000).selectExpr("id * 7919 % 20011 AS k", "id AS v")
        joined = left.join(spark.range(20_011).hint("merge").withColumnRenamed("id", "k"), "k")
        want = [i * 19_999 // 999 for i in range(1000)]
        assert sorted(r._pos for r in evenly_spaced(joined, 1000).collect()) == want
        ordered = evenly_spaced(joined, 1000, "k").collect()
        keys = sorted(r.k for r in joined.collect())
        assert {r._pos: r.k for r in ordered} == {p: keys[p] for p in want}
    finally:
        spark.conf.set(conf, before)


def test_duplicate_flags(spark):
    rows = [(1, "a", 1.0), (2, None, math.nan), (3, "a", 1.0), (4, None, None), (5, "a", 2.0), (0, "a", 1.0)]
    got = facts.duplicate_flags(spark.createDataFrame(rows, "i long, x string, y double"), "i").collect()
    assert {r.i: r.is_duplicate for r in got} == {0: False, 1: True, 2: False, 3: True, 4: True, 5: False}


@pytest.mark.parametrize("columns", [1, 8])
def test_quartiles_take_two_scans_of_any_number_of_columns(spark, columns):
    """Of 200,000 rows, far more than are looked at one by one."""
    df = spark.range(200_000).selectExpr(*(f"CAST(pmod(xxhash64(id, {k}), 1000000007) AS double) / 7 AS c{k}" for k in range(columns)))
    context = spark.sparkContext
    context.setJobGroup(f"quartiles{columns}", "")
    got = numeric.quantiles_of(df, [F.col(f"c{k}") for k in range(columns)])
    jobs = len(context.statusTracker().getJobIdsForGroup(f"quartiles{columns}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    want = df.agg(*(F.percentile(f"c{k}", F.array(*map(F.lit, numeric.QUARTERS))) for k in range(columns))).first()
    assert [pytest.approx(w) for w in want] == got
    assert jobs <= 4  # a shuffle's map side may be a job of its own


def test_a_sketch_that_errs_is_noticed(spark, monkeypatch):
    """Brackets too narrow for their places, and more values in them than may be looked at, lead to further scans."""
    monkeypatch.setattr(numeric, "SKETCH", 8)
    monkeypatch.setattr(numeric, "SKETCH_ERROR", 1e-6)
    df = spark.range(5000).selectExpr("CAST(pmod(xxhash64(id), 997) AS double) AS a", "CAST(id % 3 AS double) AS b", "CASE WHEN id % 2 = 0 THEN -1e300 ELSE 1e300 END AS c", "CAST(NULL AS double) AS d")
    shares = (0.0, 0.3, 1.0)
    for looked_at in (5, 400):
        got = numeric.quantiles_of(df, [F.col(c) for c in "abcd"], shares, "lower", looked_at)
        for name, found in zip("abc", got, strict=False):
            values = sorted(r[0] for r in df.select(name).collect())
            assert found == [values[int(4999 * s)] for s in shares]
        assert got[3] == [None] * 3
