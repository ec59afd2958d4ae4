import random
import re
from zlib import crc32

import numpy as np
import pytest

from tablepulse.llm import quality_rules as Q
from tablepulse.llm import tokens

rng = random.Random(1)
VOCAB = ["the", "of", "thand", "érst", "on,", "in.", "a", "ndre***", "x|", "$$$", "<b>"]
TEXTS = [None, "", " \n\t", "one", " ", "a b c d e " * 9, "a b c d e f", "l1 x\n\nl1 x\n \nl1 x\r\nl1 x", "x " * 5000] + ["\n".join(" ".join(rng.choice(VOCAB[: rng.choice([3, 11])]) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 1000 else set(windows)
    marked = {i + j for i, w in enumerate(windows) if w in often for j in range(5)}
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def grams(text):
    parts = [crc32(p.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for p in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff]+", w)]
    m = (1 << 64) - 1
    return [p % Q.BUCKETS for p in parts] + [((a * 0x9E3779B97F4A7C15 & m) ^ (b * 0xC2B2AE3D27D4EB4F & m)) >> 48 for a, b in zip(parts, parts[1:], strict=False)]


@pytest.mark.parametrize("limit", [Q.BROADCAST_LIMIT, 0])
def test_against_brute_force(spark, docs_of, monkeypatch, limit):
    monkeypatch.setattr(Q, "BROADCAST_LIMIT", limit)
    docs = docs_of(list(enumerate(TEXTS)), score=1, kept="clash", bucket=2)
    trusted = {i for i in range(len(TEXTS)) if i % 3}
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(len(TEXTS))] * 2 + [(None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.apply(docs, Q.fit(docs, Q.trusted_ids(labels))).collect()}
    raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for i, t in enumerate(TEXTS):
        for g in grams(t):
            raw[g] += 1
            target[g] += i in trusted
    ratio = [np.log((target[b] + 20) / (raw[b] * target.sum() / raw.sum() + 20)) for b in range(Q.BUCKETS)]
    for i, t in enumerate(TEXTS):
        r, g = got[i], grams(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        score = sum(ratio[b] for b in g) / max(1, len(g))
        assert abs(r.score - score) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= -0.05)


def test_tables_are_trimmed(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_LIMIT", 5)
    monkeypatch.setattr(tokens, "TABLE_KEPT", 3)
    few, many = tokens.Words(), [str(i).encode() * 2 + b"* x" + str(i % 7).encode() for i in range(50)]
    for text in many:
        numbers, counts = few.read([text, b"", text])
        parts, part_counts = few.part_hashes(numbers, counts)
        assert part_counts.tolist() == [len(grams(text.decode())) // 2 + 1, 0, len(grams(text.decode())) // 2 + 1]
        assert Q.buckets(parts, part_counts)[0].tolist() == 2 * grams(text.decode())[: part_counts[0]]


def test_empty_and_repeated(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.apply(docs_of([]), Q.fit(docs_of([]), none)).count() == 0
    docs = docs_of([(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (None, "z")])
    got = Q.apply(docs, Q.fit(docs, none)).collect()
    assert sorted((r.doc_id or -1, r.kept, r.score) for r in got) == [(-1, False, 0.0), (1, True, 0.0), (1, True, 0.0)]


def test_colliding_windows_are_compared(monkeypatch):
    numbers = np.array([1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5] * 1)
    counts = np.array([12])
    want = Q.repeated_words(numbers, counts).tolist()
    monkeypatch.setattr(np, "flatnonzero", lambda x, f=np.flatnonzero: np.arange(len(x)) if len(x) == 7 else f(x))
    assert Q.repeated_words(numbers, counts).tolist() == want == [10]


def test_junk_is_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.apply(docs, Q.fit(docs, Q.trusted_ids(labels))).join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) > 0.93 * len(good) and sum(bad) < 0.05 * len(bad)
