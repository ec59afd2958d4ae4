import os

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tablepulse.plans import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_as_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    wanted = duck.sql(Q.SQL[name])
    assert sorted(wanted.columns) == names
    place = [wanted.columns.index(c) for c in names]
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in place) for r in wanted.fetchall()), key=repr)
    assert got or name.startswith("check_dq_")  # some checks find nothing in these tables


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_known_types(spark):
    want = {
        "nation": "numeric_continuous unknown numeric_discrete", "customer": "numeric_continuous unknown numeric_continuous numeric_continuous categorical", "orders": "numeric_continuous numeric_continuous categorical numeric_continuous datetime categorical",
        "events": "identifier datetime numeric_continuous categorical numeric_continuous unknown", "documents": "identifier free_text categorical categorical numeric_continuous", "embeddings": "identifier unknown numeric_discrete", "pages": "identifier free_text free_text",
    }
    for table, types in want.items():
        rows = entry.queries()[f"semantic_types_{table}"](spark, SF).orderBy("position").collect()
        assert [r.semantic_type for r in rows] == types.split(), table


def test_entry(spark):
    assert entry.entry(spark).count() == 11 and set(entry.oracle_sql()) <= set(entry.queries())


def test_a_changed_table_is_analysed_anew(spark, tmp_path):
    folder = str(tmp_path)
    for t in Q.TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    first = Q.analysis(spark, folder, "orders")
    assert Q.analysis(spark, folder, "orders") is first
    os.remove(f"{folder}/orders.parquet")
    pq.write_table(pq.read_table(f"{SF}/orders.parquet").slice(0, 50), f"{folder}/orders.parquet")
    assert Q.analysis(spark, folder, "orders").profile.summary["row_count"] == 50 != first.profile.summary["row_count"]
