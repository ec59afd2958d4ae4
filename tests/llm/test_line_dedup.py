import random
import re

import pytest

from tablepulse.llm import line_dedup as L


def brute(rows, least):
    """rows: [(doc_id, text)], ids different. Deletes every line within a run of least words or more that stands earlier, without overlap."""
    split = {d: (t.split("\n") if t is not None else []) for d, t in rows}
    order = sorted(split, key=lambda d: (d is None, d or 0))
    places = {}
    for d in order:
        for i, line in enumerate(split[d]):
            places.setdefault(line, []).append((d, i))
    gone = {d: set() for d in order}
    for n, d in enumerate(order):
        before = set(order[:n])
        lines = split[d]
        for i in range(len(lines)):
            longest = 0
            for e, j in places[lines[i]]:
                if not (e in before or (e == d and j < i)):
                    continue
                k = 0
                while i + k < len(lines) and j + k < len(split[e]) and lines[i + k] == split[e][j + k] and (e != d or j + k < i):
                    k += 1
                longest = max(longest, k)
            if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines[i : i + longest]) >= least:
                gone[d] |= set(range(i, i + longest))
    return {d: (None if t is None else "\n".join(x for i, x in enumerate(split[d]) if i not in gone[d]), len(gone[d])) for d, t in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, docs_of, seed):
    rng = random.Random(seed)
    lines = ["", " ", "a", "b b", "c c c", "d d d d d", "e\r", "é é é é é é"]
    blocks = [[rng.choice(lines) for _ in range(rng.randrange(1, 20))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a\n" * 40), (4, "\n" * 100 + "a b c d e f g h i j k l")]
    rows += [(5, "\n" * 100 + "a b c d e f g h i j k l"), (6, "x y z " * 30), (7, "x y z " * 30), (8, "one")]
    for i in range(9, 40):
        parts = [rng.choice([rng.choice(blocks), [f"own {i} {rng.random()}"], [rng.choice(lines)]]) for _ in range(rng.randrange(0, 6))]
        rows.append((i * 3 if i % 4 else -i, "\n".join(x for p in parts for x in p)))
    rows.append((None, rows[-1][1]))
    got = {r.doc_id: (r.text, r._n_deleted) for r in L.dedup_lines(docs_of(rows, d="clash", r1=2, gone="x"), 12).collect()}
    assert got == brute(rows, 12)
    assert sum(n for _, n in got.values()) > 50


@pytest.mark.parametrize("files", [3, 50_000])
def test_intervals_go_on_over_partitions(spark, monkeypatch, files):
    from tablepulse.llm import common

    monkeypatch.setattr(common, "FILE_ROWS", files)
    rng = random.Random(files)
    runs = [(d, rng.randrange(-5, 5), s, n, n * 10, rng.randrange(2)) for d in range(40) for s, n in ((d % 3, 2), (7, rng.randrange(1, 4)))]
    conf, before = "spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set(conf, "false")  # keeps all partitions of the range sort
    try:
        got = L.interval_starts(spark.createDataFrame(runs, "d long, t long, s int, n int, r1 long, r2 long"), len(runs)).collect()
    finally:
        spark.conf.set(conf, before)
    want = {}
    for d, t, s, *key in runs:
        want[tuple(key)] = min(want.get(tuple(key), (99, 0, 0)), (d, t, s))
    assert len(got) == len(runs) and all(tuple(r["first"]) == want[r.n, r.r1, r.r2] for r in got)


def test_intervals_go_on_in_documents(spark, docs_of, monkeypatch):
    """The same with the columns, never null, that documents give."""
    from tablepulse.llm import common

    monkeypatch.setattr(common, "FILE_ROWS", 40)
    passage = "\n".join(f"line {i} of the passage" for i in range(12))
    rows = [(d, f"own {d}\n{passage}\nend {d}") for d in range(200)]
    conf, before = "spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set(conf, "false")
    try:
        got = {r.doc_id: r._n_deleted for r in L.dedup_lines(docs_of(rows).repartition(4), 20).collect()}
    finally:
        spark.conf.set(conf, before)
    assert got == {d: 12 * (d > 0) for d in range(200)}


def test_very_long_text(spark, docs_of):
    lines = [f"word{i} " * 3 for i in range(30_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own"] + lines[100:29_000] + ["end"])), (3, "\n".join(lines[:10]))]
    got = {r.doc_id: (r.text, r._n_deleted) for r in L.dedup_lines(docs_of(rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("own\nend", 28_900), 3: (rows[2][1], 0)}


def test_repeated_rows_and_empty_table(spark, docs_of):
    text = "w " * 30 + "\n" + "v " * 30
    got = L.dedup_lines(docs_of([(4, text), (4, text), (4, "own\n" + text), (9, text + "\nend")], extra=1))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "_n_lines", "_n_deleted", "_deleted"]
    texts = sorted((r.doc_id, r.text) for r in got.collect())
    assert (9, "end") in texts and texts.count((4, text)) in (0, 2) and sum("w w" in t for _, t in texts) in (1, 2)
    assert L.dedup_lines(docs_of([])).count() == 0


def test_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, n_lines, n_deleted, deleted, text from ({L.OP4_SQL})").fetchall())
    got = sorted(tuple(r) for r in L.op4_line_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == want and sum(x[2] for x in got) > 0
