from zlib import crc32

import numpy as np

from tablepulse.llm import classifier as C


def test_context_sums_against_loops():
    texts = [b"a b a c", b"", b"b** c", b"d", b"a b c d e f g a"]
    places, signs = C.index_vectors()
    assert all(len(set(p)) == C.NONZERO for p in places.tolist())
    rows, counts = C.read_rows(texts)
    want, at = np.zeros((C.WORDS, C.SIZE)), 0
    for n in counts.tolist():
        own = rows[at : at + n]
        for i in range(n):
            for j in range(n):
                if 0 < abs(i - j) <= C.REACH:
                    for s in range(C.NONZERO):
                        want[own[i], places[own[j], s]] += signs[own[j], s]
        at += n
    assert (C.context_sums(rows, counts, places, signs) == want).all()


def test_pooling_against_loops():
    vectors = np.random.default_rng(1).normal(size=(C.WORDS, C.SIZE)).astype(np.float32)
    texts = [b"", b"a a b", b" ", b"x** y"]
    got = C.pooled(texts, vectors)
    assert not got[0].any() and not got[2].any() and (got == np.concatenate([C.pooled([t], vectors) for t in texts])).all()
    rows, _ = C.read_rows([b"a a b"])
    mean = vectors[rows].mean(axis=0)
    assert np.allclose(got[1], [*mean, np.log(4), 2 / 3, np.linalg.norm(mean), 2 / 3], atol=1e-5)
    assert not C.pooled([b""], vectors).any()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(16000, C.SIZE + C.EXTRA)).astype(np.float32)
    p = 1 / (1 + np.exp(-2 * (x[:, 0] * x[:, 1] + x[:, 2])))
    y = (rng.random(16000) < p).astype(float)
    net = C.train(x[:14000], y[:14000])
    q = net.probabilities(x[14000:])
    assert np.mean((q > 0.5) == (p[14000:] > 0.5)) > 0.8
    assert abs(q.mean() - y[14000:].mean()) < 0.05
    logits = rng.normal(size=5000) * 3
    assert abs(C.calibrate(logits, (rng.random(5000) < 1 / (1 + np.exp(-logits / 2))).astype(float)) - 2) < 0.3
    assert (C.train(x[:0], y[:0]).probabilities(x[:3]) == 0.5).all()


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = C.fit(docs, labels)
    got = {r.doc_id: r for r in C.score(docs, model).collect()}
    assert len(got) == docs.count() and all(r.held_out == (crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    known = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    right = [r.predicted == q for q, r in known]
    assert len(right) > 50 and sum(right) > 0.93 * len(right)
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in C.score(docs, C.fit(docs, turned)).collect()}
    assert again == {d: r.score for d, r in got.items()}


def test_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, None, 0), (None, 1, 0), (4, 5, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b c"), (1, "a b c"), (2, None), (None, ""), (8, "x " * 30000)], score=1, predicted="clash", x=2)
    got = C.score(docs, C.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = C.fit(docs_of([]), labels.limit(0))
    assert C.score(docs_of([]), none).count() == 0


def test_epochs_change_smoothly():
    many = [C.epochs(n) for n in range(1, 20001)]
    assert C.epochs(C.FULL) == C.EPOCHS and many == sorted(many, reverse=True)
    assert all(a - b <= max(1, a / n) for n, (a, b) in enumerate(zip(many, many[1:], strict=False), 1))
    steps = [C.epochs(n) * n for n in (1, 10, 100, 1000, 2000, 4000, 20000)]
    assert steps == sorted(steps)
