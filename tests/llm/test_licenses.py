import random
import re

import pytest

from tablepulse.llm import licenses as L

rng = random.Random(2)
BITS = ["GNU", "General", "public", "License", "apache", "MIT", "cc", "by", "NC", "é", "version", "3", "2.0", "-", "\n", "mité", "word", "ſ", "K"]
TEXTS = [None, "", "MIT License", "the MIT-license.", "MIT\nLicense\x00CC BY-NC 4.0", "smit license", "mit licenses", "mit license mit license", "cc by cc by cc", "x " * 30000 + "Apache License"] + [rng.choice([" ", "-", "  "]).join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(200)]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark, docs_of, tmp_path):
    docs_of(list(enumerate(TEXTS)) + [(None, "mit license"), (1, "")], labels="clash", score=3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op6_license_scan(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))
        assert 0 <= r.score <= 1
    assert got[None].base_labels == "mit"
    assert L.scan(docs_of([])).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("MIT", ["mit"], 0.9),
        ("MIT OR GPL-2.0-only AND Apache-2.0", ["mit", "gpl-2.0-only", "apache-2.0"], 0.9),
        ("(MIT OR GPL-2.0-only) AND Apache-2.0", ["mit", "gpl-2.0-only", "apache-2.0"], 0.9),
        ("GPL-2.0-only with Classpath-exception-2.0 and LGPL-2.1", ["gpl-2.0-only with classpath-exception-2.0", "lgpl-2.1"], 0.5),
        ("MIT AND", ["mit"], 0.9),
        ("((MIT) OR (AGPL-3.0)) */ text", ["mit", "agpl-3.0"], 0.9),
        ("(MIT OR AGPL-3.0", [], 0.0),
        ("AND MIT", [], 0.0),
        ("MIT this file", ["mit"], 0.9),
        ("CC-BY-NC-4.0", ["cc-by-nc-4.0"], 0.2),
        ("", [], 0.0),
        ("( ) MIT", [], 0.0),
        ("see the file", [], 0.0),
        ("TODO", [], 0.0),
        ("NONE", [], 0.0),
        ("mitigated", [], 0.0),
        ("MIT OR whatever", ["mit"], 0.9),
        ("GPLv2+ WITH care", ["gplv2+"], 0.3),
        ("LicenseRef-Own-1 OR DocumentRef-a.b:LicenseRef-x", ["licenseref-own-1", "documentref-a.b:licenseref-x"], 0.3),
        ("GPL-2.0-only WITH Linux-syscall-note", ["gpl-2.0-only with linux-syscall-note"], 0.65),
    ],
)
def test_expressions(text, labels, score):
    got = L.evaluate(L.postfix(text))
    assert got == (labels, pytest.approx(score))


def test_tags_and_notices():
    assert L.scan_text(b"// SPDX-License-Identifier: (MIT OR GPL-3.0-or-later) WITH x\nmore")[2:] == (["gpl-3.0-or-later", "mit"], [["mit", "gpl-3.0-or-later", "or"]], 0.9)
    assert L.scan_text(b"SPDX-License-Identifier: (GPL-2.0 WITH x-exception) WITH y-exception")[2:] == (["gpl-2.0 with x-exception"], [["gpl-2.0", "x-exception", "with"]], 0.65)
    n, places, labels, expressions, score = L.scan_text("Licensed under CC BY-NC 4.0.\n# SPDX-License-Identifier: Apache-2.0 AND MIT\nAll rights reserved.".encode())
    assert labels == ["all-rights-reserved", "apache-2.0", "cc-by", "cc-by-nc", "mit"] and expressions == [["apache-2.0", "mit", "and"]] and score == 0.0
    assert L.scan_text("Licensed under the Apache License, Version 2.0.".encode())[2] == ["apache", "apache-2.0"]


def test_long_expressions_and_many_tags_on_a_line():
    names = [f"MIT-{i}" for i in range(60000)]
    for text, last in ((" OR ".join([*names, "AGPL-3.0"]), 0.9), ("(" + " AND ".join([*names, "AGPL-3.0"]) + ")", 0.2), ("(" * 20000 + "AGPL-3.0" + ")" * 20000, 0.2)):
        labels, expressions, score = L.scan_text(f"x SPDX-License-Identifier: {text}\nGPL-2.0".encode())[2:]
        assert score == last and "agpl-3.0" in labels and len(expressions) == 1 and len(labels) == len(re.findall(r"MIT-|AGPL", text))
    with_ = L.scan_text(("SPDX-License-Identifier: GPL-2.0" + " WITH x-exception" * 60000).encode())
    assert with_[2] == ["gpl-2.0" + " with x-exception" * 60000]
    one = "SPDX-License-Identifier: MIT x SPDX-License-Identifier: GPL-3.0-only"
    assert L.scan_text(one.encode())[2:] == (["gpl-3.0-only", "mit"], [["mit"], ["gpl-3.0-only"]], 0.3)
    two = "SPDX-License-Identifier: MIT OR License-Expression=(ISC SPDX-License-Identifier: SPDX-License-Identifier:\tAGPL-3.0"
    assert L.scan_text(two.encode())[2:] == (["agpl-3.0", "mit"], [["mit"], ["agpl-3.0"]], 0.2)
    many = " ".join(f"SPDX-License-Identifier: MIT-{i} /" for i in range(20000))
    assert len(L.scan_text(many.encode())[3]) == 20000
