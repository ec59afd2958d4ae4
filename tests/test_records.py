import csv
import io
import random

import pytest

from tablepulse.sources import errors as E
from tablepulse.sources import records
from tablepulse.sources.csv import ingest_csv, read_csv

PIECES = ["a", "é\n", '"', ",", "\n", "\r\n", " ", "日本", "", "x" * 40, '\n"\n', "1"]


def written(rows, end):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def rows_of(seed, n):
    rng = random.Random(seed)
    return [["".join(rng.choices(PIECES, k=rng.randrange(1, 6))) or "v", f"n{i}", rng.choice(["1", "22", "text"])] for i in range(n)]


@pytest.mark.parametrize("size", [60, 1000, 1 << 20])
def test_records_across_splits(spark, tmp_path, monkeypatch, size):
    """Splits smaller than a record and larger than the file, ends of lines of both kinds, several files, small blocks."""
    monkeypatch.setattr(records, "BLOCK", 100)
    want = []
    for k, end in enumerate(["\n", "\r\n"]):
        rows = rows_of(k, 60)
        want += rows
        text = written([["x", "y,\n z", "w"], *rows], end)
        (tmp_path / f"{k}.csv").write_bytes((text if k else "\n\n" + text.removesuffix(end)).encode())
    (tmp_path / "2.csv").write_bytes(b"")
    for key, value in {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1}.items():
        spark.conf.set(key, str(value))
    try:
        source = read_csv(spark, str(tmp_path), multiline=True)
        assert source.table.names == ("x", "y,\n z", "w") and source.row_count == 120
        got = source.table.df.collect()
        if size == 60:
            assert source.table.df.rdd.getNumPartitions() > 20
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
    assert sorted(tuple(r) for r in got) == sorted(map(tuple, want))


def test_as_an_upload(spark, tmp_path):
    content = "﻿a,b\n1,\"two\nlines\"\n\n2,\"\"\n3,\n".encode()
    (tmp_path / "t.csv").write_bytes(content)
    one, other = ingest_csv(spark, content).table, read_csv(spark, str(tmp_path / "t.csv"), multiline=True).table
    assert one.names == other.names and sorted(one.df.collect()) == sorted(other.df.collect())


@pytest.mark.parametrize(("content", "error"), [(b'a,b\n1,"open\n2,3\n', E.MalformedSource), (b"a,b\n1,2,3\n", E.MalformedSource), (b"", E.EmptySource), (b"\n \n", E.EmptySource), (b"a,b\n", E.NoDataRows), (b'a,b\n1,"\xff\n"\n', E.InvalidEncoding)])
def test_what_is_refused(spark, tmp_path, content, error):
    (tmp_path / "t.csv").write_bytes(content)
    with pytest.raises(error):
        read_csv(spark, str(tmp_path / "t.csv"), multiline=True)


def test_files_that_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(E.MalformedSource):
        read_csv(spark, str(tmp_path), multiline=True)


def test_starts_of_splits():
    """Odd, even and closing splits: which of them began the record that reaches into the next ones."""
    got = records._starts({("f", 0): (True, True), ("f", 10): (False, False), ("f", 20): (True, True), ("f", 30): (False, True), ("f", 40): (True, True), ("f", 50): (True, True), ("g", 0): (False, False)})
    assert got == {("f", 0): (False, -1), ("f", 10): (True, 0), ("f", 20): (True, 0), ("f", 30): (False, 0), ("f", 40): (False, 0), ("f", 50): (True, 40), ("g", 0): (False, -1)}
    with pytest.raises(records.OpenQuote):
        records._starts({("f", 0): (True, True), ("g", 0): (False, False)})
