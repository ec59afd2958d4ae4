"""What plans must look like: narrow scans, no row-by-row joins, Python only where it is said."""

import re

import pytest

from tablepulse.operators import categorical, facts, numeric
from tablepulse.operators.frame import evenly_spaced

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(LINEITEM)


def scans(text):
    return [re.findall(r"(\w+):", x) for x in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_each_column_is_read_once_and_counted_before_the_shuffle(lineitem):
    text = plan(facts.column_facts(lineitem))
    read = scans(text)
    assert all(len(c) <= 1 for c in read) and len(read) == 11
    assert text.count("partial_count(1)") >= 11 and "Expand" not in text and "Join" not in text


def test_missing_values_take_one_pass(lineitem):
    text = plan(facts.missing_counts(lineitem))
    assert text.count("ReadSchema: ") == 1 and text.count("Exchange SinglePartition") == 1 and "Python" not in text


def test_only_needed_columns_are_scanned(lineitem):
    text = plan(facts.identifier_duplicates(lineitem, "l_partkey"))
    assert scans(text) == [["l_partkey"]] and "IsNotNull(l_partkey)" in text
    assert scans(plan(numeric.correlations(lineitem, ["l_tax", "l_discount"]))) == [["l_discount", "l_tax"]]


def test_top_values_are_cut_before_the_shuffle(lineitem):
    text = plan(categorical.top_values(lineitem, ["l_returnflag", "l_shipdate"]))
    assert "WindowGroupLimit" in text and "BatchEvalPython" not in text


def test_samples_need_no_global_window(lineitem):
    text = plan(evenly_spaced(lineitem.select("l_orderkey"), 100))
    assert "Window" not in text and "Exchange" not in text


def test_summaries_join_two_rows(lineitem):
    text = plan(facts.dataset_summary(lineitem))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
