import random
from collections import defaultdict

import pytest
import xxhash

from tablepulse.llm import simhash_pivots as S


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    ids = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and ids[a] != ids[b]:
                    ids[a] = ids[b] = min(ids[a], ids[b])
                    changed = True
    return ids


def test_against_brute_force(spark, docs_of):
    rng = random.Random(3)
    base = " ".join(rng.choice("the of and erst onder wist abel corun") + str(rng.randrange(40)) for _ in range(300)).split()
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One"), (4, "one"), (5, "Two words"), (6, "  É é É é"), (7, "x " * 20000)]
    for i in range(8, 60):
        words = list(base)
        for _ in range(rng.randrange(3) * (i % 5 != 0)):
            words[rng.randrange(300)] = "edit%d" % rng.randrange(9)
        rows.append((i, " ".join(words)) if i % 3 else (i, " ".join(rng.choice(base) for _ in range(rng.randrange(1, 60)))))
    got = {r.doc_id: r for r in S.near_duplicates(docs_of(rows, fp="clash", component="clash")).collect()}
    prints = {d: brute_fingerprint(t) for d, t in rows}
    assert {d: r.fingerprint for d, r in got.items()} == {d: format(p, "016x") for d, p in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == brute_components(prints)
    assert len({r.component_id for r in got.values()}) < len(rows) - 10


def test_large_groups_are_dealt_again(spark):
    rng = random.Random(5)
    values = {0}
    while len(values) < 400:  # a ball of fingerprints, and chains that leave it
        x = rng.choice(list(values))
        values.add(x ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64)) * (rng.random() < 0.5))
    frame = spark.createDataFrame([(S.signed(x),) for x in values], "fp long")
    for limit in (4096, 16):
        got = defaultdict(set)
        for r in S.components(S.links(frame, group_limit=limit)).collect():
            got[r.component] |= {r.node, r.component}
        want = brute_components({S.signed(x): x for x in values})
        groups = defaultdict(set)
        for k, v in want.items():
            groups[v].add(k)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_chains_and_empty(spark, docs_of):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (7, 7)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in S.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 901: 900}
    assert S.near_duplicates(docs_of([])).count() == 0


def test_components_that_still_change_are_an_error(spark):
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        S.components(links, rounds=1)


def test_repeated_rows_and_ties(spark, docs_of):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A B c D"), (None, "a b c d")]
    assert sorted((r.doc_id or -1, r.component_id) for r in S.near_duplicates(docs_of(rows)).collect()) == [(-1, 3), (3, 3), (5, 3), (5, 3)]
