import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from tablepulse.llm import decontamination as D
from tablepulse.llm import quality_rules as Q
from tablepulse.llm import stages
from tests.llm.test_bpe import PATH
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_quality_rules import base, grams
from tests.llm.test_simhash_pivots import brute_components, brute_fingerprint


def fixture(path):
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in ("th", "er", "on") for b in ("an", "ing", "é", "ou") for c in ("st", "e", "ly", "nd.")] + ["The", "of", "and"] * 4
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(n) for n in (14, 25, 52)]
    shared = [say(60), say(35) + "\n" + say(30), say(20)]
    texts = []
    for i in range(120):
        body = [say(rng.randrange(8, 50)) for _ in range(rng.randrange(1, 6))]
        if i % 6 == 0:
            body.insert(rng.randrange(len(body) + 1), shared[i % 3])
        if i % 11 == 3:
            body.append(say(5) + " " + items[i % 3] + " " + say(5))
        if i % 8 == 5:
            body = [" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in x.split()) for x in body]
        if i % 13 == 7:
            body = [("und " * 20) + ("der " * 20)]
        if i % 17 == 9:
            body = ["short"]
        texts.append("\n".join(body))
    texts += [texts[0], texts[1] + " end", texts[1], None, ""]
    long = [say(600) for _ in range(4)]
    texts += [x + end for x in long for end in (" one", " two", "")]  # near copies of one line each
    labels = [(i, int(i % 8 != 5), 0) for i in range(0, 120, 2)] + [(i, int(i % 8 != 5), 0) for i in range(5, 120, 8)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), f"{path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), f"{path}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([7, 8, 9], pa.int64()), "text": items}), f"{path}/benchmark.parquet")
    return dict(enumerate(texts)), {x[0] for x in labels if x[1]}, items


def brute(texts, trusted, items):
    raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for d, t in texts.items():
        for g in grams(t):
            raw[g] += 1
            target[g] += d in trusted
    ratio = np.log((target + Q.PRIOR) / (raw * target.sum() / raw.sum() + Q.PRIOR))
    good = {d: t for d, t in texts.items() if not base(t)[-1] and np.mean(ratio[grams(t)]) >= Q.THRESHOLD}
    yield good
    cut = {d: t for d, (t, n) in brute_lines(list(good.items()), 50).items() if not n or t.split()}
    yield cut
    kept = {d: c for d, c in brute_components({d: brute_fingerprint(t) for d, t in cut.items()}).items()}
    alone = {d: t for d, t in cut.items() if kept[d] == d}
    yield alone
    order = list(alone)
    held = {order[t] for t, _ in brute_leaks([D.plain_words(alone[d].encode()) for d in order], [D.plain_words(x.encode()) for x in items])}
    clean = {d: t for d, t in alone.items() if d not in held}
    yield clean
    lib = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for d, t in clean.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        out[d] = (len(ids), ids, sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    yield out


def test_every_stage_against_brute_force(spark, tmp_path):
    texts, trusted, items = fixture(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, last = docs.columns, len(texts)
    for k, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, brute(texts, trusted, items), strict=True)):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == columns, name
            rows = docs.collect()
            assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want), name
            assert all(r.n_chars == len(r.text) for r in rows)
            assert len(want) < last or name == "line dedup", name
            last = len(want)
        else:
            got = {r.doc_id: (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) for r in docs.collect()}
            assert got == want
            assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {d: w[2] for d, w in want.items()}


def test_near_copies_keep_texts_that_share_a_doc_id(spark, docs_of, tmp_path):
    say = lambda seed: " ".join(random.Random(seed).choice("abcdefghij") + str(random.Random(seed * 1000 + i).randrange(99)) for i in range(400))
    a, b, c = say(1), say(2), say(3)
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (None, c), (None, a + " end"), (4, None), (0, b + " end"), (0, "other words stand here"), (None, "nothing else like it"), (None, "and one more of them")]
    want = {(1, a), (0, b + " end"), (3, c), (4, None), (0, "other words stand here"), (None, "nothing else like it"), (None, "and one more of them")}
    docs = docs_of(rows, _key="clash", _0="clash", component_id="clash")
    got = stages.near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_odd_rows_pass_every_stage(spark, docs_of, tmp_path):
    fixture(tmp_path)
    text = "a b c d e f g h i j k l m n o p"
    for rows in ([], [(1, text), (1, text), (None, text + " q r s"), (None, None), (2, ""), (3, text + " x " * 2), (4, "y z " * 9000)]):
        docs = docs_of(rows, _key="clash", item_id=3, gone="x", score=0.5)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/odd{len(rows)}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/odd{len(rows)}-{k}")
            if k < 4:
                assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids))
