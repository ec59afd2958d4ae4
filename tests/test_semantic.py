import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablepulse.config import SemanticConfig
from tablepulse.functions.text import identifier_component, insight_id, name_tokens
from tablepulse.operators.semantic import TYPES, infer_types, types_frame


def frame(spark, **columns):
    n = len(next(iter(columns.values()))[1])
    schema = ", ".join(f"`{k}` {t}" for k, (t, _) in columns.items())
    return spark.createDataFrame([tuple(v[i] for _, v in columns.values()) for i in range(n)], schema)


def kind(spark, name, dtype, values, config=None):
    return infer_types(frame(spark, **{name: (dtype, values)}), config)[0]


def test_customer_table(spark):
    day = [f"2026-01-{i:02d}" for i in range(1, 13)]
    df = frame(
        spark, CustomerID=("bigint", list(range(1001, 1013))), Age=("bigint", [30, 31, 32, 33, 34, 35, 36] + [30] * 5), Gender=("string", ["Female", "Male"] * 6), AnnualIncome=("double", [1.5, 2.25, 3.1, 4.7, 5.9, 6.3] * 2), SignupDate=("string", day),
        IsActive=("boolean", [True, False] * 6), Region=("string", ["North", "South", "West"] * 4), CustomerComment=("string", [f"This customer wrote a rather long sentence, number {i}." for i in range(12)]),
    )
    want = ["identifier", "numeric_discrete", "categorical", "numeric_continuous", "datetime", "boolean", "categorical", "free_text"]
    types = infer_types(df)
    assert [t.semantic_type for t in types] == want
    assert [r.semantic_type for r in types_frame(df, types).orderBy("position").collect()] == want


def test_loan_table(spark):
    df = frame(spark, Loan_ID=("string", [f"LN-{i:05d}" for i in range(12)]), ApplicantIncome=("bigint", list(range(2000, 8000, 500))), Credit_History=("bigint", [0, 1] * 6), Property_Area=("string", ["a", "b", "c"] * 4), Loan_Status=("string", ["Y1", "N1"] * 6))
    got = infer_types(df)
    assert [t.semantic_type for t in got] == ["identifier", "numeric_continuous", "numeric_discrete", "categorical", "categorical"]
    assert got[0].confidence == "high" and "BINARY_NUMERIC_AMBIGUITY" in got[2].warnings


NAMES = [
    ("customer_id", "bigint", list(range(50)), "identifier"), ("customer_number", "bigint", list(range(50)), "identifier"), ("account_number", "string", [f"AC{i:04d}" for i in range(50)], "identifier"), ("invoice_no", "string", [f"INV-{i}" for i in range(50)], "identifier"),
    ("order_code", "string", [f"O-{i}" for i in range(50)], "identifier"), ("identity_score", "bigint", list(range(50)), "numeric_continuous"), ("number_of_children", "bigint", list(range(50)), "numeric_continuous"), ("account_balance", "double", [i + 0.5 for i in range(50)], "numeric_continuous"),
    ("postal_code", "string", [f"P{i}" for i in range(50)], "unknown"), ("phone_number", "string", [f"P-{i}" for i in range(50)], "identifier"), ("reference", "string", [f"R-{i}" for i in range(50)], "identifier"), ("reference", "string", [chr(97 + i // 26) + chr(97 + i % 26) for i in range(50)], "unknown"),
    ("is_active", "bigint", [0, 1] * 25, "boolean"), ("is_active", "string", ["0", "1"] * 25, "boolean"), ("loan_status", "bigint", [0, 1] * 25, "numeric_discrete"), ("loan_status", "string", ["0", "1"] * 25, "categorical"), ("flag", "string", ["Yes", " no"] * 25, "boolean"),
    ("mixed", "string", ["True", "true", "FALSE"] * 20, "categorical"), ("d", "string", ["2026-99-99", "99/99/2026"] * 6, "categorical"), ("d", "string", ["13/02/2026", "14/02/2026"] * 6, "datetime"), ("d", "string", ["01/02/2024", "03/04/2024", "05/06/2024"], "datetime"),
    ("n", "bigint", [i % 20 for i in range(100)], "numeric_discrete"), ("n", "bigint", [i % 21 for i in range(100)], "numeric_continuous"), ("s", "string", [f"v{i % 20}" for i in range(100)], "categorical"), ("s", "string", [f"v{i % 21}" for i in range(100)], "unknown"),
    ("e", "string", [None, None], "empty"), ("c", "string", ["a", None, "a"], "constant"), ("when", "date", [dt.date(2024, 1, i) for i in range(1, 13)], "datetime"), ("v", "double", [1.0, float("nan"), 2.5] * 5, "numeric_continuous"), ("arr", "array<int>", [[1], [2], None], "unknown"),
    ("note", "string", [f"short note {i}, with end" for i in range(30)], "free_text"), ("uuid_col", "string", ["4f2f1c9e-8a37-4b0e-9a35-0d7f2c1d1a%02d" % (i % 5) for i in range(20)], "identifier"),
]


def test_name_and_value_rules(spark):
    for name, dtype, values, want in NAMES:
        got = kind(spark, name, dtype, values)
        assert got.semantic_type == want, (name, dtype, got)
        assert ("INSUFFICIENT_OBSERVATIONS" in got.warnings) == (0 < got.non_null_count < 10 and want not in ("empty", "constant"))


def test_ambiguous_dates_and_confidence(spark):
    got = kind(spark, "d", "string", ["01/02/2024", "03/04/2024", "05/06/2024"])
    assert got.confidence == "low" and "AMBIGUOUS_DATE_ORDER" in got.warnings
    got = kind(spark, "d", "string", [f"2024-01-0{i}" for i in range(1, 10)] + ["not-a-date"])
    assert (got.semantic_type, got.confidence, got.warnings) == ("datetime", "medium", ("PARTIAL_DATE_PARSE",))


def test_sample_has_both_ends(spark):
    values = [0.5] + [float(i) for i in range(1, 100)] + [100.5]
    df = frame(spark, x=("double", values)).coalesce(1)
    got = infer_types(df, SemanticConfig(inspected_values=10))[0]
    assert got.sampled and got.sample_count == 10 and any(e.code == "NUMERIC_FRACTIONAL_VALUES" for e in got.evidence)


def test_confirmed_types_names_and_ids():
    assert name_tokens("CustomerID") == {"customer", "id"} and name_tokens("custkey") == {"custkey"} and name_tokens("a-b C") == {"a", "b", "c"}
    assert identifier_component("é ü!x") == "E_U_X" and identifier_component("日本").startswith("VALUE_") and insight_id("A", "x") != insight_id("A", "X ")
    assert len(TYPES) == 10
    with pytest.raises(ValueError):
        SemanticConfig(identifier_candidate_ratio=0.99)


def test_order_of_partitions_changes_nothing(spark):
    df = frame(spark, k=("string", ["b", "a", "c", "a", None] * 20), v=("double", [1.0, 2.5, float("inf"), None, -3.0] * 20))
    want = None
    for n in (1, 7, 16):
        got = [(t.semantic_type, t.confidence, t.null_count, t.distinct_count) for t in infer_types(df.repartition(n))]
        assert want in (None, got)
        want = got


def test_name_tokens_as_a_column(spark):
    from tablepulse.functions.text import name_tokens_column

    names = ["CustomerID", "custkey", "order_date", "isActive2", "l_extendedprice", "HTTPServer", "é_code"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", name_tokens_column(F.col("n")).alias("t")).collect()
    assert {r.n: set(r.t) for r in got} == {n: set(name_tokens(n)) for n in names}
