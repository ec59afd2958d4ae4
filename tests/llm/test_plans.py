import pytest

from tablepulse.llm import common, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_cross_joins_and_native_where_asked(spark, name, monkeypatch):
    """In the last plan and in those of all that is written on the way."""
    plans, write = [], common.written

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(common, "written", written)
    df = queries.queries()[name](spark, SF)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 or not name.startswith(("op3_", "op4_"))
    for text in plans:
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        if name.startswith(("op2_", "op4_", "op8_")):
            assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
