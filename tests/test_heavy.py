import random
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest

from tablepulse.operators import heavy
from tablepulse.operators.frame import Table


def plain(values, k):
    counts = Counter(v for v in values if v is not None)
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return sorted(((v, n, text(v)) for v, n in counts.items()), key=lambda r: (-r[1], r[2].encode()))[:k]


def column(kind):
    rng = random.Random(3)
    zipf = [int(200 / (rng.random() * 199 + 1)) for _ in range(3000)]
    return {
        "string": [None, *(f"é{z}" for z in zipf), *["tie a", "tie b"] * 7],
        "bigint": zipf,
        "boolean": [z > 1 for z in zipf] + [None],
        "date": [date(2020, 1, 1 + z % 28) for z in zipf],
        "decimal(9,2)": [Decimal(z) / 4 for z in zipf],
        "double": [z / 2 for z in zipf],
    }[kind]


@pytest.mark.parametrize("kind", ["string", "bigint", "boolean", "date", "decimal(9,2)", "double"])
def test_as_counting_all(spark, kind):
    values = column(kind)
    df = Table.of(spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3))
    for k in (1, 10):
        got = [tuple(r) for r in heavy.most_frequent(df, 0, k).collect()]
        want = plain(values, k)
        # text of decimals is Spark's
        assert [r[:2] for r in got] == [r[:2] for r in want] and (kind.startswith("decimal") or got == want)


def test_what_the_summary_proves(spark, monkeypatch):
    """A skewed column is proved without counting every value; a near-unique one, and a tie with what was left out, are not."""
    skewed = Table.of(spark.range(40_000).selectExpr("CASE WHEN id % 2 = 0 THEN id % 8 ELSE id END AS v"))
    unique = Table.of(spark.range(20_000).selectExpr("id AS v"))
    assert heavy._proved(skewed, 0, 4) == [(v, 5000, str(v)) for v in (0, 2, 4, 6)]
    assert heavy._proved(skewed, 0, 5) is None and heavy._proved(unique, 0, 3) is None
    monkeypatch.setattr(heavy, "candidates", lambda k: k)
    ties = Table.of(spark.range(900).selectExpr("id % 30 AS v"))
    assert heavy._proved(ties, 0, 5) is None
    assert [r.text for r in heavy.most_frequent(ties, 0, 5).collect()] == ["0", "1", "10", "11", "12"]
    monkeypatch.undo()
    monkeypatch.setattr(heavy, "exact_counts", lambda *_: pytest.fail("every value is counted"))
    assert heavy.most_frequent(skewed, 0, 2).count() == 2


def test_no_values(spark):
    assert heavy.most_frequent(Table.of(spark.createDataFrame([(None,)], "v string")), 0, 3).collect() == []
