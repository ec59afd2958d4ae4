"""Licence scan: one Aho-Corasick pass finds notice phrases and identifier tags; a shunting-yard parser reads the expressions.

A text is lower-cased (A-Z) and reduced to its words with one space between them, so that a phrase is a run of whole words
whatever stood between. What follows an identifier tag in the text itself, up to the end of the line or the next tag and
however long, is read as a licence expression: identifiers of known families (or LicenseRef- names), parentheses, WITH (behind an
identifier, before a known exception) before AND before OR; other words end it, so prose behind a tag names nothing. An expression's freedom is a number from 0 to 1: OR gives the better of two sides, AND the worse, WITH lifts a licence half way
to 1. A text's score is the least freedom of what it names, 0 if it names nothing.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import map_texts, table

#: Fixed by the task: phrase and label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further notice phrases.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

TAGS = ("spdx license identifier", "license expression")
_TAG = re.compile(r"(?i:SPDX-License-Identifier|License-Expression)[ \t]*[:=]")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")

#: How freely a licence lets its text be used, by the start of its label; the longest fitting start counts.
FREEDOM = {
    "": 0.3, "0bsd": 1.0, "afl": 0.9, "agpl": 0.2, "all-rights-reserved": 0.0, "apache": 0.9, "artistic": 0.7, "bsd": 0.9, "bsl": 0.9, "cc-by": 0.8, "cc-by-nc": 0.2,
    "cc-by-nd": 0.1, "cc-by-sa": 0.5, "cc0": 1.0, "cddl": 0.5, "epl": 0.5, "gpl": 0.3, "isc": 0.9, "lgpl": 0.5, "mit": 0.9, "mpl": 0.6, "unlicense": 1.0, "wtfpl": 1.0, "zlib": 0.9,
}

#: Names of licence families in the public list of short identifiers, in lower case.
FAMILIES = """
0bsd aal afl agpl aladdin aml ampas antlr apache apl apsl artistic beerware bittorrent blessing blueoak bsd bsl busl bzip2 caldera catosl
cc-by cc-pddc cc0 cddl cdla cecill cern clartistic cnri cpal cpl cua curl d-fsl drl ecl efl eiffel elastic entessa epl erlpl etalab eudatagram eupl
fair fdk frameworx fsfap fsful ftl gfdl giftware gl2ps glide gpl gsoap hippocratic hpnd ibm icu ijg imagemagick imatix info-zip intel ipa
ipl isc jasper json lal latex2e leptonica lgpl libpng libtiff liliq linux-openib lpl lppl miros mit motosoto mpl mpi ms-lpl ms-pl ms-rl
mulanpsl multics nasa naumen ncsa netcdf ngpl nist nlod nokia npl nposl ntp oclc odbl odc-by ofl ogl oldap openssl opl osl parity pddl php
polyform postgresql psf python qhull qpl rpl rpsl ruby sax-pd scea sendmail sgi simpl sissl sleepycat smlnj sspl ssh tcl tmate
unicode unlicense upl vim vsl w3c watcom wtfpl x11 xfree86 xnet zend zimbra zlib zpl
""".split()
#: A family alone or with a version or variant; a name of the user's own, marked as such.
_LICENSE = re.compile(rf"(?:{'|'.join(map(re.escape, FAMILIES))})(?:[-+.0-9].*|v[0-9].*)?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
#: What may follow WITH.
_EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*|linux-syscall-note|shl-[0-9.]+|(?:documentref-[a-z0-9.-]+:)?additionref-[a-z0-9.-]+")

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RANK = {"or": 1, "and": 2, "with": 3}


def freedom(label: str) -> float:
    return FREEDOM[max((k for k in FREEDOM if label.startswith(k)), key=len)]


def postfix(text: str, at: int = 0, upto: int | None = None) -> list[str]:
    """The longest well-formed expression that begins text[at:upto] and stays on its line, operators after their operands;
    empty if there is none.

    Shunting-yard: operands go out at once, operators wait on a stack for those that bind tighter."""
    out: list[str] = []
    stack: list[str] = []
    best: tuple[int, list[str]] = (0, [])  # how much of out, and the operators that come after it: three at most
    operand, depth = False, 0  # operand: whether one has just ended
    plain = False  # whether it was an identifier: an exception belongs to one licence, not to a bracket
    upto = len(text) if upto is None else upto
    while m := _TOKEN.match(text, at, upto):  # a token never crosses the end of a line
        at, token = m.end(), m[1]
        word = token.lower()
        if word in _RANK:
            if not operand or (word == "with" and not plain):
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = False
        elif token == "(":
            if operand or stack[-1:] == ["with"]:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
            plain = False
        else:
            if operand or not (_EXCEPTION if stack[-1:] == ["with"] else _LICENSE).fullmatch(word):
                break
            out.append(word)
            operand = plain = True
        if operand and not depth:
            best = (len(out), stack[::-1])
    return out[: best[0]] + best[1]


def evaluate(expression: list[str]) -> tuple[list[str], float]:
    """(labels, freedom) of an expression in postfix order."""
    labels: list[list[str]] = []  # in the order of the text, each as the parts that WITH ties together
    stack: list[float] = []
    for token in expression:
        if token not in _RANK:
            labels.append([token])
            stack.append(freedom(token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # the exception belongs to the licence that it follows
            exception = labels.pop()
            labels[-1] += exception
            stack.append((1 + left) / 2)
        else:
            stack.append(max(left, right) if token == "or" else min(left, right))
    return [" with ".join(x) for x in labels], stack[0] if stack else 0.0


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE.items()), ("notice", NOTICES.items()), ("tag", ((t, "") for t in TAGS))):
        for phrase, label in phrases:
            found.setdefault(f" {phrase} ", []).append((kind, label))
    out = ahocorasick.Automaton()
    for phrase, meanings in found.items():
        out.add_word(phrase, (len(phrase), meanings))
    out.make_automaton()
    return out


def scan_text(text: bytes) -> tuple[int, list[tuple[int, str]], list[str], list[list[str]], float]:
    """(number of words, base places as (word, label), all labels, expressions in postfix order, score)."""
    words = text.translate(_WORD).split()
    plain = f" {b' '.join(words).decode('latin-1')} "
    places, labels, tagged = [], set(), False
    at = word = 0
    for end, (size, meanings) in sorted(automaton().iter(plain), key=lambda x: x[0] - x[1][0]):
        start = end - size + 1  # of the space before the phrase
        word += plain.count(" ", at, start)
        at = start
        for kind, label in meanings:
            if kind == "base":
                places.append((word, label))
            if kind == "tag":
                tagged = True
            else:
                labels.add(label)
    score = min(map(freedom, labels), default=None)
    expressions = []
    if tagged:
        decoded = text.decode()
        tags = [m.span() for m in _TAG.finditer(decoded)]
        for (_, at), (upto, _) in zip(tags, [*tags[1:], (len(decoded), 0)], strict=True):
            if expression := postfix(decoded, at, upto):
                named, free = evaluate(expression)
                labels.update(named)
                expressions.append(expression)
                score = free if score is None else min(score, free)
    return len(words), places, sorted(labels), expressions, score or 0.0


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base_places array<struct<word, label>>, labels array, expressions array, score.

    Text null or empty: no words, no places, no labels, score 0. Repeated rows give equal rows; a null doc_id stays."""

    def run(keys: list, texts: list[bytes]) -> dict[str, list]:
        found = list(map(scan_text, texts))
        return {
            "doc_id": keys,
            "n_words": [x[0] for x in found],
            "base_places": [[{"word": w, "label": name} for w, name in x[1]] for x in found],
            "labels": [x[2] for x in found],
            "expressions": [[" ".join(e) for e in x[3]] for x in found],
            "score": [x[4] for x in found],
        }

    return map_texts(docs, run, "doc_id long, n_words long, base_places array<struct<word:long,label:string>>, labels array<string>, expressions array<string>, score double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.col("base_places")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places["word"]).alias("first_word"),
        F.array_max(places["word"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(places["label"])), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join("expressions", ";").alias("expressions"),
    )
