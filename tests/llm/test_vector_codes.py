import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablepulse.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, rounds=6):
    """(vec_id, code, error, label_error, sha) by comparing every part with every entry; rows: (vec_id, vector, label)."""
    whole = [(i, [vc.exact_floor(x) for x in v], label) for i, v, label in rows]
    ids = {}
    for i, v, _ in sorted((w for w in whole if w[0] is not None), key=lambda w: w[:2]):
        ids.setdefault(i, v)
    first = [ids[i] for i in sorted(ids)[:16]]
    w = len(first[0]) // 8
    books = [[v[p * w : p * w + w] for v in first] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            mine = defaultdict(list)
            for _, v, _ in whole:
                x = v[p * w : p * w + w]
                mine[near(x, book)[1]].append(x)
            new.append([[sum(c) // len(mine[e]) for c in zip(*mine[e], strict=True)] if mine[e] else y for e, y in enumerate(book)])
        books = new
    out, sums = [], Counter()
    for i, v, label in whole:
        found = [near(v[p * w : p * w + w], books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        sums[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return Counter((i, code, error, sums[label], sha) for i, code, error, label in out)


def rows_of(df, **more):
    return Counter(map(tuple, vc.compress(df, **more).collect()))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 16), st.integers(1, 4), st.integers(0, 2**32), st.sampled_from([3, 50, 10**6, 10**12]))
def test_search_finds_the_nearest(k, width, seed, most):
    rng = random.Random(seed)
    entries, x = (np.array([[rng.randint(-most, most) for _ in range(width)] for _ in range(n)], object) for n in (k, 40))
    x, entries = vc.fitting(x, entries)
    index, apart = vc.Codebook(entries).nearest(x)
    for row, e, d in zip(x.tolist(), index.tolist(), apart.tolist(), strict=True):
        assert (d, e) == min((sum((a - b) ** 2 for a, b in zip(row, y, strict=True)), i) for i, y in enumerate(entries.tolist()))


def test_search_passes_entries_over(monkeypatch):
    """Fewer distances than entries, on clustered parts."""
    rng, seen = np.random.default_rng(1), []
    centres = rng.integers(-4000, 4000, (16, 4))
    x = centres[rng.integers(0, 16, 1000)] + rng.integers(-20, 20, (1000, 4))
    book = vc.Codebook(centres)
    real = vc.distances
    monkeypatch.setattr(vc, "distances", lambda a, b: seen.append(len(a)) or real(a, b))
    book.nearest(x)
    assert sum(seen) < 0.6 * 16 * len(x)


@pytest.mark.parametrize("labels", [vc.LABELS, 0])
def test_rows_and_what_is_dropped(spark, labels):
    rng = random.Random(5)
    good = [(i, [float(np.float32(rng.gauss(i % 5, 0.3))) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(200)]
    good += [good[7], (7, [0.5] * 16, 1), (None, [0.25] * 16, None), (300, [-0.0] * 16, 2), (301, [float(np.float32(3e38))] + [0.0] * 15, None)]
    bad = [(-5, None, 1), (-4, [None] + [0.0] * 15, 1), (-3, [float("nan")] * 16, 1), (-2, [float("inf")] + [0.0] * 15, 1), (-1, [1.0] * 15, 1), (400, [1.0] * 8, 1), (401, [], 1)]
    want = plain(good)
    largest = vc.LARGEST
    want = Counter({(i, c, min(e, largest), min(s, largest), sha): n for (i, c, e, s, sha), n in want.items()})
    df = spark.createDataFrame([(*r, "clash") for r in good + bad], SCHEMA).repartition(3)
    got = rows_of(df, labels=labels)
    assert {r[:3] + r[4:] for r in got} == {r[:3] + r[4:] for r in want} and got.total() == want.total()
    near = {r for r in want if r[0] != 301 and r[3] < largest}
    assert near and near <= set(got)


def test_few_or_none(spark):
    few = [(i, [i / 7] * 8, None) for i in range(3)]
    assert rows_of(spark.createDataFrame([(*r, "x") for r in few], SCHEMA)) == plain(few)
    assert rows_of(spark.createDataFrame([], SCHEMA)) == Counter()
    assert rows_of(spark.createDataFrame([(None, [1.0] * 8, 1, "x"), (3, None, 1, "x")], SCHEMA)) == Counter()


def test_sums_travel_whole():
    for value in (0, 5, -5, 1 << 40, -(1 << 95) + 3, (1 << 200) + 1):
        assert sum(digit << (vc.LIMB * place) for place, digit in vc.limbs(value)) == value


def test_as_sql(spark):
    path = "/root/testdata/sf0.01"
    got = sorted(map(tuple, vc.op13_orchard_codes(spark, path).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    assert got == sorted(con.sql(vc.OP13_SQL).fetchall())
