import random
import time
import tracemalloc

import numpy as np
import pytest

from tablepulse.llm import decontamination as D

#: The share of passages at similarity 0.8 or more that the fingerprints find, of items with up to three edits.
RECALL = 0.95
rng = random.Random(6)
VOCAB = [b"w%d" % i for i in range(60)] + [b"the", b"of"] * 15


def text(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def brute(docs, items):
    """All windows of item size, at each word, by exact similarity."""
    out = {}
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            if len(item) < D.LEAST_WORDS:
                continue
            want = D.shingles(item)
            best = max((D.similarity(want, D.shingles(words[max(a, 0) : a + len(item)])) for a in range(-len(item) // 4, len(words))), default=0)
            if best >= D.MIN_SIMILARITY:
                out[d, i] = best
    return out


def planted():
    items = [text(n) for n in (8, 9, 13, 20, 30, 44, 48, 60, 61, 100, 150, 3)] + [[], text(260)]
    docs = [text(rng.randrange(0, 120)) for _ in range(30)]
    for k in range(160):
        item = list(rng.choice(items))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at, how = rng.randrange(len(item) + 1), rng.randrange(4)
            if how == 0:
                item[at : at + 1] = [b"edit"]
            elif how == 1:
                item.insert(at, b"new")
            elif how == 2:
                del item[at : at + 1]
            else:
                item = item[: max(1, int(len(item) * 0.95))]
        docs.append(text(rng.randrange(0, 40)) + item + text(rng.randrange(0, 40)) + (item if k % 9 == 0 else []))
    return docs, items


def found(docs, items):
    """Similarities by (text, item number)."""
    known = D.Items(list(range(len(items))), items)
    return {(t, i): s for t, k, s, *_ in D.leaks([b" ".join(d) for d in docs], known) for i in known.ids[k]}


def test_planted_items_against_all_windows(monkeypatch):
    there = right = 0
    for seed in range(2):
        monkeypatch.setitem(globals(), "rng", random.Random(seed))
        docs, items = planted()
        got, want = found(docs, items), brute(docs, items)
        assert set(got) <= set(want) and len(want) > 70
        assert all(k in got for k, s in want.items() if s == 1.0)
        assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) > 0.95 * len(got)
        there, right = there + len(want), right + len(got)
    assert right > RECALL * there


def test_passages_at_the_ends_of_texts():
    item = text(60)
    docs = [item[:56], item[4:], text(30) + item[:57], item[3:] + text(30), item[:40], item]
    assert {t for t, _ in found(docs, [item])} == {0, 1, 2, 3, 5} == {t for t, _ in brute(docs, [item])}


def test_long_and_repetitive_texts():
    item, phrase = text(50), text(7)
    docs = [text(100_000) + item + text(1000), phrase * 20_000, []]
    near = [(phrase * 5)[k : k + 30] for k in range(7)] + [phrase * 4, (phrase * 6)[:40], item, list(item), item[:-1] + [b"other"]]
    got = found(docs, near)
    assert {k: s for k, s in got.items() if s == 1.0} == {**{(1, i): 1.0 for i in range(9)}, (0, 9): 1.0, (0, 10): 1.0}
    assert set(got) - {(0, 11)} == {(1, i) for i in range(9)} | {(0, 9), (0, 10)}


def test_similarities_of_all_windows():
    r = random.Random(3)
    for _ in range(200):
        words, item = ([b"w%d" % r.randrange(4) for _ in range(n)] for n in (r.randrange(60), r.randrange(8, 40)))
        hashes = lambda x: D.run_sums(np.array([D.hashed(w) for w in x], np.uint64), D.SHINGLE)
        grams = hashes(words) if len(words) >= D.SHINGLE else np.zeros(0, np.uint64)
        first = r.randrange(-45, 60)
        last = first + r.randrange(40)
        got = D.similarities(grams, *np.unique(hashes(item), return_counts=True), first, last)
        for a, s in zip(range(first, last + 1), got.tolist(), strict=True):
            window = words[max(a, 0) : max(a + len(item), 0)]
            assert s == (D.similarity(D.shingles(item), D.shingles(window)) if len(window) >= D.SHINGLE else 0.0)


@pytest.mark.parametrize("repeated", [False, True])
def test_very_long_items(repeated):
    """One of 20,000 words with edits; of words that all differ, or of a phrase over and over. Time and memory follow its length."""
    r = random.Random(4)
    phrase = [b"p%d" % k for k in range(11)]
    item = (phrase * 2000)[:20_000] if repeated else [b"v%d" % r.randrange(5000) for _ in range(20_000)]
    doc = list(item)
    for at in r.sample(range(20_000), 100):
        doc[at] = b"edit"
    known, texts = D.Items([1], [item]), [b" ".join(doc), b" ".join(doc[:15_000])]
    D.leaks(texts[:1], D.Items([1], [item[:50]]))  # the worker's words are known
    tracemalloc.start()
    began = time.process_time()
    found = D.leaks(texts, known)
    took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:2] for x in found] == [(0, 0)] and found[0][2] == pytest.approx(D.similarity(D.shingles(item), D.shingles(doc)))
    assert most < 300e6 and took < (30 if repeated else 10), (took, most)  # tracing memory slows it


def test_short_items_against_all_windows():
    r = random.Random(9)
    for _ in range(20):
        words = [b"w%d" % i for i in range(r.choice([2, 3, 6]))]
        items = [[r.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 7, 8)] + [[b"a", b"b", b"c", b"a", b"b", b"c", b"a"], [b"only"], []]
        docs = [[r.choice(words) for _ in range(r.randrange(30))] for _ in range(20)] + [[b"b", b"c", b"a", b"b", b"c", b"a", b"b"], [b"ONLY!"], []]
        docs += [[b"x"] * 3 + i + [b"y"] * 3 for i in items[:8]]
        got = found(docs, items)
        want = brute([D.plain_words(b" ".join(d)) for d in docs], items)
        short = lambda x: {k: v for k, v in x.items() if len(items[k[1]]) < 8}
        assert short(got) == short(want) and len(short(want)) > 8
    item = D.plain_words(b"To be, or not to be?")
    assert D.leaks([b"", b"He said: to be or NOT to be. To be or not to be!"], D.Items([7], [item])) == [(1, 0, 1.0, 2, 0)]


def test_run_prints():
    hashes = np.array([rng.getrandbits(64) for _ in range(90)], np.uint64)
    for sizes in ([4], [6, 8, 12], [24, 25, 26, 27, 89], [90], [1, 2], [128]):
        for size, got in D.run_prints(hashes, sizes):
            want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[i : i + size]) > size) for i in range(90 - size + 1)]
            assert got.tolist() == want
    begins, sizes = np.array([0, 30, 32]), np.array([30, 2, 58])
    pairs = [D.pair_hashes(hashes[a : a + n]) for a, n in zip(begins, sizes, strict=True)]
    assert D.whole_prints(hashes, begins, sizes).tolist() == [int(dict(D.run_prints(p, [len(p)]))[len(p)][0]) for p in pairs]


def test_lookup_finds_all_within_radius(monkeypatch):
    base = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    probes = np.array([int(x) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(15))) for x in base], np.uint64)
    index = D.Index(base, np.arange(300), np.zeros(300, np.int64))
    want = {(i, j) for i in range(300) for j in range(300) if (int(probes[i]) ^ int(base[j])).bit_count() <= D.RADIUS}
    for at_once in (D.COMPARED, 5):
        monkeypatch.setattr(D, "COMPARED", at_once)
        assert {x for part in index.near(probes) for x in zip(*(y.tolist() for y in part), strict=True)} == want
    assert index.known(probes)[[i for i, _ in want]].all()
    assert D.RADIUS == 11 and [D.window_size(n) for n in (8, 31, 32, 33, 63, 64, 65, 68, 1000)] == [8, 31, 32, 32, 62, 64, 64, 68, 992]


@pytest.mark.parametrize("block", [20_000, 3])
def test_rows(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(D, "item_blocks", lambda items, f=D.item_blocks: f(items, block))
    docs, items = planted()
    rows = [(i, b" ".join(d).decode().upper() + " !!") for i, d in enumerate(docs)]
    frame = spark.createDataFrame([(i, b" ".join(x).decode()) for i, x in enumerate(items)] + [(99, None), (None, None)], "item_id long, text string")
    documents = docs_of([*rows, (None, rows[40][1]), (500, None)], item_id=7, similarity="clash")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents, frame).collect()}
    want = set(found([[w.upper() for w in d] + [b"!!"] for d in docs], items))
    assert want <= set(brute(docs, items))
    assert {x for x in got if x[0] is not None} == want and {i for d, i in got if d is None} == {i for t, i in want if t == 40}
    left = D.decontaminate(documents, frame)
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.collect()} - {None} == {i for i, _ in rows} - {t for t, _ in want} | {500}
    assert D.find_leaks(docs_of([]), frame).count() == D.find_leaks(documents, frame.limit(0)).count() == 0
    assert D.decontaminate(documents, frame.limit(0)).count() == documents.count()
