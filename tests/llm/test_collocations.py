import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tablepulse.llm import collocations as co


def plain(rows, min_count, top):
    """By counting every phrase and looking at every pair of candidates; rows: (text, lang)."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for d in range(1, 6):
                    if i + d <= len(w):
                        counts[lang, tuple(w[i : i + d])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, w), a in candidates.items():
        n = totals[lang]
        score, k = min((1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(x == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in candidates.items())
        if not inside:
            out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], n, score))
    ranked, seen = [], Counter()
    for lang, phrase, *rest in sorted(out, key=lambda r: (-r[6], -r[2], r[1].encode())):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, *rest))
    return sorted(ranked)


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "a", "cat", "Ä", "ä", "x\x01", "x", "\x00", "日本", "of", "on", "one-two", "'s", "é"]
    fixed = ["the cat of one-two on", "a ä 日本", "x x x x x x x"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice([rng.choice(words), rng.choice(fixed), rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 40)))
        out.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return [*out, (None, "en"), ("", None), (" .,\n", "de"), ("the cat " * 3000, "en"), out[0], out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, words string, n long")


@pytest.mark.parametrize(("budget", "bits", "top"), [(co.BUDGET, 16, 2000), (5, 16, 7), (40, 4, 2000)])
def test_as_counting_all(spark, budget, bits, top):
    """With one group or many, with a prefix table that holds apart and one that lets nearly all through."""
    rows = texts(budget)
    got = co.collocations(frame(spark, rows).repartition(3), 8, top, budget, bits)
    want = plain(rows, 8, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > (10 if top == 7 else 40)


def test_tasks_that_count_in_parts(spark, monkeypatch):
    monkeypatch.setattr(co, "WAITING", 50)
    monkeypatch.setattr(co, "LEAF_WORDS", 8)
    monkeypatch.setattr(co, "PREFIXES", 3)
    rows = texts(9)
    assert sorted(map(tuple, co.collocations(frame(spark, rows).repartition(2), 8, 50, 30, 12).collect())) == plain(rows, 8, 50)


def test_no_rows(spark):
    assert co.collocations(frame(spark, []), 8).collect() == []
    assert co.collocations(frame(spark, [(None, None), ("", "en")]), 1).collect() == []


def test_exact_beyond_64_bits(spark):
    """Products of counts as those of a large corpus."""
    big = 3_000_000_000_000
    counts = [("en", [], 10 * big), ("en", ["a"], big), ("en", ["b"], big - 1), ("en", ["a", "b"], big // 2 + 1)]
    df = spark.createDataFrame(counts, "lang string, words array<string>, n long")
    real, co.frequent_phrases = co.frequent_phrases, lambda *_: df
    try:
        row = co.collocations(df).first()
    finally:
        co.frequent_phrases = real
    assert row.score == 1000 * (big // 2 + 1) * 10 * big // (big * (big - 1)) and row.l == big


def test_clipped_counts_never_lose_a_prefix():
    rows, n = co.equal_rows(np.array([[1, 2], [0, 5], [1, 2], [1, 0]], np.int32))
    assert rows.tolist() == [[0, 5], [1, 0], [1, 2]] and n.tolist() == [1, 1, 2]


def test_as_sql(spark):
    path = "/root/testdata/sf0.01"
    got = sorted(map(tuple, co.op11_phrases(spark, path).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = sorted(con.sql(co.OP11_SQL).fetchall())
    assert got == want and len(got) > 50


@pytest.fixture
def small_batches(spark):
    """A chunk is no larger than a batch, so tasks of these have many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def test_leaves_are_sent_once_by_a_task(spark, monkeypatch, small_batches):
    """However often a task counts, whatever rare words it meets and into however many splits the texts are cut."""
    monkeypatch.setattr(co, "WAITING", 60)
    monkeypatch.setattr(co, "LEAF_WORDS", 30)
    rows = [(f"the cat sat on r{i}a r{i}b the cat r{i}c. " * (2 if i % 7 else 1), "en" if i % 3 else None) for i in range(400)]
    df = frame(spark, rows).repartition(40)
    sent = spark.sparkContext.broadcast(co.frequent_slots(df, 50, 16))
    leaves = co.leaves(df, sent, 16).collect()
    times, totals = Counter((r.lang, tuple(r.words)) for r in leaves), Counter()
    for r in leaves:
        totals[r.lang, tuple(r.words)] += r.n
    n = Counter()
    for text, lang in rows:
        n[lang or "und"] += len(text.replace(".", "").split())
    assert max(times.values()) <= 2 * spark.sparkContext.defaultParallelism < 40
    assert {lang: sum(x for (mine, _), x in totals.items() if mine == lang) for lang in n} == n
    assert totals["en", ("the", "cat", "sat", "on")] == sum(text.count("sat") for text, lang in rows if lang)


@pytest.mark.parametrize(("waiting", "words"), [(50, 300_000), (1_000_000, 12), (2_000, 30)])
def test_tasks_that_count_again_and_again(spark, monkeypatch, small_batches, waiting, words):
    monkeypatch.setattr(co, "WAITING", waiting)
    monkeypatch.setattr(co, "LEAF_WORDS", words)
    rows = texts(waiting + words)
    rows += [(f"{text} r{i} {i}r of on", lang) for i, (text, lang) in enumerate(rows)]
    assert sorted(map(tuple, co.collocations(frame(spark, rows).repartition(3), 8, 60, 40, 14).collect())) == plain(rows, 8, 60)


def test_too_many_different_suffixes_are_sent_earlier(spark, monkeypatch, small_batches):
    monkeypatch.setattr(co, "WAITING", 60)
    rows = texts(4)
    sent = spark.sparkContext.broadcast(np.full(1 << 9, 255, np.uint8))  # lets all through
    leaves = co.leaves(frame(spark, rows).repartition(1), sent, 12).collect()
    times = Counter((r.lang, tuple(r.words)) for r in leaves)
    assert max(times.values()) > 1 and sum(r.n for r in leaves) == sum(len(re.findall(r"[^ \t.,;:!?\n-\r]+", text or "")) for text, _ in rows)


def test_sums_of_equal_rows_of_many_bits():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (500, 5)).astype(np.int32) * np.int32(1 << 29)
    got, n = co.equal_rows(rows, np.arange(500))
    want = Counter()
    for row, w in zip(rows.tolist(), range(500), strict=True):
        want[tuple(row)] += w
    assert [tuple(r) for r in got.tolist()] == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
    assert [len(x) for x in co.equal_rows(np.zeros((0, 5), np.int32))] == [0, 0]


def test_prefix_table_fills_with_frequent_phrases_not_with_the_corpus(spark):
    """Hundreds of rare prefixes for each bit, found more often in all than a frequent phrase."""
    rng = random.Random(5)
    rows = [(" ".join(f"r{rng.randrange(10**9)}" for _ in range(200)) + ". the cat sat on it", "en") for _ in range(150)]
    bits = 10
    found = co.frequent_slots(frame(spark, rows).repartition(4), 100, bits)
    assert 0 < np.unpackbits(found).sum() <= 2 * 15  # two for each phrase of "the cat sat on it"
    sent = spark.sparkContext.broadcast(found)
    leaves = co.leaves(frame(spark, rows).coalesce(1), sent, bits).collect()
    assert len(leaves) < 500 and sum(r.n for r in leaves) == 150 * 205  # each of 30,000 words began a leaf where all passed
    assert sum(r.n for r in leaves if r.words == ["the", "cat", "sat", "on", "it"]) == 150


@pytest.mark.parametrize(("min_count", "held"), [(8, 37), (300, 64), (300, 1000)])
def test_prefix_table_has_all_frequent_prefixes(spark, monkeypatch, small_batches, min_count, held):
    """However few hashes a task holds; counts of 256 and more take four bytes."""
    monkeypatch.setattr(co, "HELD", held)
    rows, bits = texts(held), 14
    table = co.frequent_slots(frame(spark, rows).repartition(3), min_count, bits)
    counts = Counter()
    for text, lang in rows:
        for _, found in co.prefix_hashes(co.hashed([(text or "").encode()]), lang or "und"):
            counts.update(found.tolist())
    frequent = {h for h, n in counts.items() if n >= min_count}
    passed = {h for h in counts if co.let_through(np.array([h], np.uint64), table, bits)[0]}
    assert frequent and frequent <= passed and len(passed) < len(frequent) + len(counts) // 5


def test_hashes_of_words_as_the_vocabulary_has_them():
    some = [t.encode() for t, _ in texts(2) if t] + [b"x" * n + b" x" for n in (7, 8, 9, 63, 64, 65, 300)] + [b"a\x00 a \x00a", b"", b" . "]
    known = co.Vocabulary()
    words = known.read(some)
    inside = (words > 0) | (np.concatenate([[1], words[:-1]]) > 0)  # one 0 between pieces
    assert np.array_equal(np.trim_zeros(co.hashed(some)), np.trim_zeros(known.hashes[words[inside]]))
    assert len(set(known.hashes.tolist())) == len(known) and len(co.hashed([])) == len(co.hashed([b"", b" ."])) == 0


@pytest.mark.parametrize("number_bits", [co.NUMBER_BITS, 3])
def test_suffixes_by_key_and_by_row(monkeypatch, number_bits):
    """Equal however often they are counted and numbered anew, also with more words than a key takes."""
    monkeypatch.setattr(co, "NUMBER_BITS", number_bits)
    some, seen = [t.encode() for t, _ in texts(3, 60) if t], []
    for every in (5, 1000):
        known, found, totals = co.Vocabulary(), {"en": co.Suffixes()}, Counter()
        for i, text in enumerate(some):
            found["en"].add(known.read([text]), known, "en", np.full(1 << 5, 255, np.uint8), 8)
            if i % every == every - 1:
                known, held = co.count_all(found, known)
                assert held == len(found["en"].keys) + len(found["en"].rows[0])
        names = list(known)
        for rows, n in found["en"].counted(7):
            for row, times in zip(rows.tolist(), n.tolist(), strict=True):
                totals[b" ".join(names[w] for w in row if w)] += times
        seen.append(totals)
    want = Counter()
    for text in some:
        for piece in re.split(rb"[.,;:!?\n-\r]", text.lower()):
            w = piece.split()
            want.update(b" ".join(w[i : i + co.LONGEST]) for i in range(len(w)))
    assert seen == [want, want]
