import math
import random
import statistics

import pytest

from tablepulse.streaming import incremental as I

SCHEMA = "a double, b string, c int"


def frame(spark, values):
    return spark.createDataFrame([(v, "x" if v else None, 7) for v in values], SCHEMA)


@pytest.mark.parametrize("batches", [[[1e9, 1e9 + 1, 1e9 + 2]], [[1e9], [1e9 + 1], [1e9 + 2]], [[1e15, 1e15 + 2], [], [None], [1e15 + 4], [float("nan"), float("inf")]], [[None], []], [[5.0]]])
def test_variance_of_batches(spark, tmp_path, batches):
    sink = I.FactsSink(str(tmp_path / "s"))
    for k, values in enumerate(batches):
        sink(frame(spark, values), k)
    got = {r.column_name: r for r in sink.facts(spark).collect()}["a"]
    finite = [v for b in batches for v in b if v is not None and math.isfinite(v)]
    assert got.row_count == sum(map(len, batches)) and got.finite_count == len(finite)
    assert got.null_count == sum(v is None or v != v for b in batches for v in b)
    assert got.mean == (pytest.approx(statistics.fmean(finite), rel=1e-15) if finite else None)
    assert got.variance == (pytest.approx(statistics.variance(finite)) if len(finite) > 1 else None)


def test_stored_batches_are_merged(spark, tmp_path, monkeypatch):
    """Few folders stay, a batch that comes again counts once, and results are those of all rows."""
    monkeypatch.setattr(I, "STORED", 3)
    rng, path = random.Random(1), tmp_path / "s"
    sink, latest = I.FactsSink(str(path)), I.LatestSink(str(tmp_path / "l"), "b")
    batches = [[1e8 + rng.random() for _ in range(rng.randrange(5))] for _ in range(12)]
    for k, values in enumerate(batches):
        for _ in range(1 + (k % 4 == 3)):
            sink(frame(spark, values), k)
            latest(spark.createDataFrame([("same", k), (f"own{k}", k)], "b string, n int"), k)
    assert len(list(path.iterdir())) <= 5
    got = {r.column_name: r for r in sink.facts(spark).collect()}["a"]
    every = [v for b in batches for v in b]
    assert got.finite_count == len(every) and got.variance == pytest.approx(statistics.variance(every), rel=1e-6)
    assert {(r.b, r.n) for r in latest.rows(spark).collect()} == {("same", 11), *((f"own{k}", k) for k in range(12))}
