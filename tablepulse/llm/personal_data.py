"""Personal data: fixed patterns, and a semi-Markov conditional random field over bounded runs of tokens.

Runs of letters and digits are tokens. Tokens that may be part of an entity (with a digit, long, in groups of hexadecimal
digits or of capitals, or tied to the next by a mark) make chains with at most two marks or spaces between neighbours. Every
run of up to MOST_TOKENS tokens of a chain, however long they are, is a segment that may be an entity of any type, with and
without the brackets or plus signs that stand before it; the edges of what the fixed patterns find cut chains. A segment without
a digit has twelve characters or more. Words in prose are in no chain, so they are plain text.

Features describe the whole segment (its form, check digits, tokens, digits, length, kinds of characters and what is between
them), the words before it, what touches its edges and whether it is assigned or quoted; each has a weight for each type. A
further weight stands for each pair of types that follow one another within ZONE characters. A labelling picks segments that
don't overlap; everything else is plain text with score zero. Decoding goes once over the sorted borders and keeps the best
score for each last type, so boundaries and types are chosen together in time linear in the number of segments. The weights
are trained here, by maximum likelihood on generated sentences with a fixed seed. What the fixed patterns find always stays;
the field adds what doesn't overlap it.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import map_texts, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn", "mac", "ipv6")
TYPES = KINDS[len(BASE_KINDS) :] + ("phone",)
MOST_TOKENS, ZONE = 16, 40

#: Fixed by the task.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # another start within a run of digits can't match if its first doesn't
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_PREFIX = re.compile(r"\+(?:[0-9]{1,3}[ .-]?)?\(?\Z")  # of a country
_TURN = re.compile(r"[a-z](?=[A-Z])")
#: Words before a span that tell its type.
CUES = ("key", "token", "secret", "password", "passwd", "ssn", "social", "iban", "account", "card", "visa", "phone", "call", "tel", "mail", "mac", "device")

#: Words before a number that is none of these.
OTHERS = ("order", "item", "part", "invoice", "isbn", "doi", "serial", "model", "ticket", "version")

#: A token that may be part of an entity, by its own characters or those next to it.
_TOKEN = r"(?:(?<![A-Za-z0-9])(?:[A-Za-z]*[0-9][A-Za-z0-9]*|[A-Za-z]{12,}|[A-Fa-f]{1,4}(?=[:-][A-Za-z0-9])|(?<=[:-])[A-Fa-f]{1,4}|[A-Z]{4}|[A-Za-z]+(?=[_/+-][A-Za-z0-9])|(?<=[_/+-])[A-Za-z]+)(?![A-Za-z0-9]))"
_CHAIN = re.compile(rf"[+(]{{0,2}}{_TOKEN}(?:[ ()./:+=_-]{{1,2}}{_TOKEN})*")
_ALNUM_RUN = re.compile(r"[A-Za-z0-9]+")
#: Texts without any of these have no fixed span and no segment: a token has a digit, twelve letters, four capitals, or a mark that
#: ties it to what is next to it; a fixed span has a digit or an at sign.
_MAY = re.compile(rb"[0-9@]|[A-Za-z]{12}|[:_/+-][A-Za-z]|[A-Z]{4}")

_FORMS = (
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    ("local phone", re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("long phone", re.compile(r"\+?[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("date", re.compile(r"[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}")),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")),
    ("mac", re.compile(r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}")),
    ("ipv6", re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?!.*::.*::)(?=.*::)(?:[0-9A-Fa-f]{1,4}::?){1,6}[0-9A-Fa-f]{1,4}")),
    ("digits", re.compile(r"[0-9]+")),
    ("number", re.compile(r"[+(]*[0-9](?:[ ()./-]{0,2}[0-9])+")),
    ("hex", re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}|(?=.*[0-9])(?=.*[A-F])[0-9A-F]{16,}")),
    ("letters", re.compile(r"[A-Za-z]+")),
    ("tied letters", re.compile(r"[A-Za-z_/+-]+")),
    ("mixed", re.compile(r"[A-Za-z0-9_/+-]+")),
    ("dotted", re.compile(r"[A-Za-z0-9_+-]{8,}(?:\.[A-Za-z0-9_+-]{8,}){2}")),
)

_ALL_DIGITS, _TIES = frozenset("0123456789"), frozenset("-_./:+()")
_LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")
_UPPER = frozenset(c.upper() for c in _LOWER)
_ALNUM, _NO_DIGITS = _ALL_DIGITS | _LOWER | _UPPER, dict.fromkeys(range(48, 58))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by kind and start."""
    out: list[Span] = []
    at = 0
    p = text.find("@")
    while p >= 0:
        head = text[at:p]
        start = at + len(head.rstrip(LOCAL))
        if start < p and (m := DOMAIN.match(text, p + 1)):
            out.append(("email", start, m.end()))
            at = m.end()
        else:
            at = p + 1
        p = text.find("@", at)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for kind, pattern, least, most in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = "".join(_DIGITS.findall(m[0]))
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def segments(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """(start, end) of all runs of tokens that may be an entity, by start and end, in the text around taken."""
    at = 0
    for start, end in [*sorted((s, e) for _, s, e in taken), (len(text), len(text))]:
        if start > at:
            part = text[at:start]
            for chain in _CHAIN.finditer(part):
                if chain.end() - chain.start() >= 7:
                    for s, e in _runs(part, chain.start(), chain.end()):
                        yield at + s, at + e
        at = max(at, end)


def _runs(part: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    tokens = [m.span() for m in _ALNUM_RUN.finditer(part, begin, end)]
    for i, (start, _) in enumerate(tokens):
        first = start
        while first > begin and start - first < 2 and part[first - 1] in "+(":
            first -= 1
        for s in range(first, start + 1):
            digit = False
            for a, e in tokens[i : i + MOST_TOKENS]:
                digit = digit or _DIGITS.search(part, a, e) is not None
                if e - s >= (7 if digit else 12):
                    yield s, e


def beside(text: str, at: int, step: int) -> str:
    """What touches a segment's edge: a letter or digit, a mark that ties one to it, a digit after a space, or none of these."""
    near = text[at : at + 1] if at >= 0 else ""
    if near in _ALNUM:
        return "token"
    far = text[at + step : at + step + 1] if at + step >= 0 else ""
    if near in _TIES and far in _ALNUM:
        return near
    return "digit" if near == " " and far in _ALL_DIGITS else "none"


def features(text: str, start: int, end: int) -> list[str]:
    """What the whole segment and its surroundings say."""
    span = text[start:end]
    form = next((name for name, p in _FORMS if p.fullmatch(span)), "other")
    kinds = set(span)
    digits = len(span) - len(span.translate(_NO_DIGITS)) if kinds & _ALL_DIGITS else 0
    upper, lower = bool(kinds & _UPPER), bool(kinds & _LOWER)
    # in dotted tokens the other marks are digits of base 64
    between = "." if form == "dotted" else "".join(sorted(kinds - _ALNUM))
    tokens = len(_ALNUM_RUN.findall(span))
    before = re.findall(r"[a-z]+", text[max(0, start - 24) : start].lower())[-2:]
    cue = next((c for c in CUES for w in before if w.startswith(c) or w.endswith(c)), "none")
    if cue == "none" and any(w.startswith(c) or w.endswith(c) for c in OTHERS for w in before):
        cue = "other"
    assigned = text[max(0, start - 3) : start].rstrip("\"' ")[-1:] in ("=", ":")
    quoted = text[start - 1 : start] in ('"', "'") and text[end : end + 1] in ('"', "'")
    left, right = beside(text, start - 1, -1), beside(text, end, 1)
    if _PREFIX.search(text, max(0, start - 6), start):
        left = "prefix"
    tied = f"{left in _TIES or left == 'token'} {right in _TIES or right == 'token'}"
    characters = f"{'u' * upper}{'l' * lower}{'d' * (digits > 0)}"
    long = min(end - start, 60) // 8
    told = cue not in ("none", "other") and assigned
    out = ["bias", f"form {form}", f"cue {cue}", f"digits {min(digits, 20) // 4}", f"length {long}", f"tokens {min(tokens, 8)}", f"between {between}", f"assigned {assigned} quoted {quoted}"]
    out += [f"left {left}", f"right {right}", f"form {form} tied {tied}", f"form {form} cue {cue}", f"form {form} characters {characters} length {long}", f"form {form} told {told}"]
    if form in ("number", "local phone", "long phone"):
        out += [f"brackets {span.count('(') - span.count(')')}", f"form {form} zero {span[0] == '0'} groups {tokens} digits {digits // 2}"]
    if form in ("letters", "tied letters", "mixed", "hex", "digits", "dotted"):
        # names of several words turn from small to capital letters less often than chance does; words have no digits inside
        turns = len(_TURN.findall(span)) * 7 > end - start
        out += [f"turns {turns} characters {characters}", f"form {form} turns {turns} cue {cue not in ('none', 'other')} assigned {assigned} quoted {quoted}", f"characters {characters} told {told} between {between}"]
    if form == "iban":
        out.append(f"check {iban_ok(span)}")
    return out


Weights = dict[str, float]


def zones(spans: Iterable[tuple[int, int]]) -> Iterator[Iterator[tuple[int, int]]]:
    """spans, sorted by start and end, in groups more than ZONE characters apart; none is held in memory."""
    reach, number = -ZONE - 1, 0

    def place(c: tuple[int, int]) -> int:
        nonlocal reach, number
        number += c[0] - reach > ZONE
        reach = max(reach, c[1])
        return number

    return (zone for _, zone in groupby(spans, place))


class Field(dict):
    """Weights by type and feature, and by pair of types."""

    @cached_property
    def by_feature(self) -> dict[str, list[float]]:
        """The weights of a feature for all types."""
        out: dict[str, list[float]] = {}
        for name, w in self.items():
            kind, bar, feature = name.partition("|")
            if bar:
                out.setdefault(feature, [0.0] * len(TYPES))[TYPES.index(kind)] = w
        return out


def options(text: str, zone: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, str, list[str]]]:
    """(start, end, type, feature names) of all segments of a zone with each type."""
    for start, end in zone:
        names = features(text, start, end)
        for kind in TYPES:
            yield start, end, kind, [f"{kind}|{n}" for n in names]


def scored(text: str, zone: Iterable[tuple[int, int]], weights: Field) -> Iterator[tuple[int, int, str, float, tuple]]:
    """(start, end, type, score) of all segments of a zone with each type."""
    known = weights.by_feature
    for start, end in zone:
        rows = [known[n] for n in features(text, start, end) if n in known]
        for kind, score in zip(TYPES, map(sum, zip(*rows, strict=True)) if rows else [0.0] * len(TYPES), strict=True):
            yield start, end, kind, score, ()


def decode(choices: Iterable[tuple[int, int, str, float, list[str]]], weights: Weights) -> list[Span]:
    """The best labelling: segments in order, none overlapping."""
    return decode_sorted(sorted(choices, key=lambda c: c[0]), weights)


def decode_sorted(choices: Iterable[tuple[int, int, str, float, list[str]]], weights: Weights) -> list[Span]:
    """The same for choices by start; only those that the last one overlaps are held."""
    best: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    open_: list[tuple[int, int, str, float, tuple]] = []  # by end
    for i, (start, end, kind, score, _) in enumerate(choices):
        while open_ and open_[0][0] <= start:
            _, _, ended, value, path = heapq.heappop(open_)
            if ended not in best or value > best[ended][0]:
                best[ended] = value, path
        value, path = max(((v + weights.get(f"{last}>{kind}", 0.0), p) for last, (v, p) in best.items()), key=lambda x: x[0])
        heapq.heappush(open_, (end, i, kind, value + score, (path, (kind, start, end))))
    _, path = max([*best.values(), *((v, p) for _, _, _, v, p in open_)], key=lambda x: x[0])
    out = []
    while path:
        path, span = path
        out.append(span)
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _log_add(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high + math.log1p(math.exp(low - high))


def _sums(choices: list, weights: Weights) -> tuple[list[dict[str, float]], list[float], float]:
    """Log sums over labellings: for each choice, those before it by last type; those up to and with it; all."""
    last: dict[str, float] = {"": 0.0}
    closing = sorted(range(len(choices)), key=lambda i: choices[i][1])
    opening = sorted(range(len(choices)), key=lambda i: choices[i][0])
    before: list[dict[str, float]] = [{}] * len(choices)
    upto = [0.0] * len(choices)
    k = 0
    for i in opening:
        while k < len(closing) and choices[closing[k]][1] <= choices[i][0]:
            kind, value = choices[closing[k]][2], upto[closing[k]]
            last[kind] = _log_add(last[kind], value) if kind in last else value
            k += 1
        before[i] = dict(last)
        kind, score = choices[i][2], choices[i][3]
        upto[i] = score + _log_sum([v + weights.get(f"{y}>{kind}", 0.0) for y, v in last.items()])
    return before, upto, _log_sum([0.0, *upto])


def _after(choices: list, weights: Weights) -> list[float]:
    """Log sum over what may follow each choice."""
    out = [0.0] * len(choices)
    following: dict[str, float] = {}
    opening = sorted(range(len(choices)), key=lambda i: -choices[i][0])
    k = 0
    for i in sorted(range(len(choices)), key=lambda i: -choices[i][1]):
        end, kind = choices[i][1], choices[i][2]
        while k < len(opening) and choices[opening[k]][0] >= end:
            j = opening[k]
            value, y = choices[j][3] + out[j], choices[j][2]
            following[y] = _log_add(following[y], value) if y in following else value
            k += 1
        out[i] = _log_sum([0.0, *(weights.get(f"{kind}>{y}", 0.0) + v for y, v in following.items())])
    return out


def marginals(choices: list, weights: Weights) -> tuple[list[float], dict[str, float]]:
    """The probability of each choice, and the expected count of each pair of types."""
    before, _, total = _sums(choices, weights)
    after, pairs, out = _after(choices, weights), {}, []
    for i, (_, _, kind, score, _) in enumerate(choices):
        here = 0.0
        for y, v in before[i].items():
            name = f"{y}>{kind}"
            p = math.exp(v + weights.get(name, 0.0) + score + after[i] - total)
            pairs[name] = pairs.get(name, 0.0) + p
            here += p
        out.append(here)
    return out, pairs


def expected(choices: list, weights: Weights) -> dict[str, float]:
    """Expected count of each feature and of each pair of types."""
    each, out = marginals(choices, weights)
    for p, (*_, names) in zip(each, choices, strict=True):
        for n in names:
            out[n] = out.get(n, 0.0) + p
    return out


def sentences(n: int = 240, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Generated training sentences with their entities, and look-alikes that are none."""
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(k - 3)) + "aB7"

    def iban() -> str:
        body = digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        whole = f"DE{check:02d}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, 22, 4)) if rng.random() < 0.5 else whole

    def word() -> str:
        return "".join(rng.choice(["an", "er", "th", "ion", "ou", "st", "é"]) for _ in range(rng.randrange(1, 4)))

    af = lambda k: "".join(rng.choice("abcdef") for _ in range(k))
    letters = lambda k: "".join(rng.choice("ABCDEFGHJKLMNOPQRSTUVWXYZabcdefghjkmnopqrstuvwxyz") for _ in range(k))
    parts = lambda: ["".join(rng.choice("abdefgilmnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(4, 6))]
    camel = lambda: "".join(w.capitalize() for w in parts())
    upper = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k - 1)) + "7"
    low = lambda k: "".join(rng.choice("abcdefghijkmnopqrstuvwxyz23456789") for _ in range(k - 2)) + "q4"
    slashed = lambda k: "".join(rng.choice("ABCDEFGHJKabcdefghjk0123456789/+") for _ in range(k - 3)) + "aB7"
    url = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + rng.choice(["", "_", "-_"]) * 2, k=k - 2)) + "w5"
    code = lambda: "-".join(upper(rng.randrange(2, 5)) for _ in range(rng.randrange(2, 4)))
    kinds = {
        "secret": [lambda: ('key = "', hexes(40), '"'), lambda: ("token: ", mixed(32), ""), lambda: ("api_key='", mixed(24), "'"), lambda: ("secret ", hexes(32), ""), lambda: ("password=", mixed(18), ""), lambda: ("", hexes(40), ""),
            lambda: ('key = "', letters(24), '"'), lambda: ("password=", letters(20), ""), lambda: ("token: ", letters(32), ""), lambda: ("secret '", letters(28), "'"), lambda: ("api_key='", letters(40), "'"),
            lambda: (rng.choice(["key ", "access key: ", "secret=", "", "token "]), upper(rng.randrange(16, 33)), ""), lambda: (rng.choice(["password=", "passwd: ", "secret = ", "token="]), low(rng.randrange(12, 30)), ""),
            lambda: (rng.choice(["password=", "passwd = ", "password: '", "password is: "]), "".join(rng.choice((str, str.upper, str.capitalize))(w) for w in parts()), ""),
            lambda: (rng.choice(["SECRET_KEY=", "access_key = ", "token: "]), slashed(40), ""), lambda: (rng.choice(["key ", "access key ", "key: "]), "AKIA" + "".join(rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 15)) + "7", ""),
            lambda: (rng.choice(["key ", "key = ", "token "]), (lambda x, k: "AKIA" + x[:k] + rng.choice("234567") + x[k:])("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=15)), rng.randrange(1, 15)), ""),
            lambda: (rng.choice(['secret = "', 'key: "']), hexes(rng.choice([64, 128, 256])), '"'), lambda: (rng.choice(["token=", "bearer ", "token: ", ""]), "eyJ" + ".".join(url(k) for k in (rng.randrange(17, 40), rng.randrange(40, 120), 43)), ""),
            lambda: (rng.choice(["token ", "key: ", "", "api_key = "]), rng.choice(["sk-", "ghp_", "xoxb-", "pk_live_"]) + mixed(rng.randrange(20, 37)), "")],
        "iban": [lambda: ("IBAN ", iban(), ""), lambda: ("", iban(), ""), lambda: ("account ", iban(), ".")],
        "ssn": [lambda: ("SSN ", f"{digits(3)}-{digits(2)}-{digits(4)}", ""), lambda: ("social security ", f"{digits(3)}-{digits(2)}-{digits(4)}", ".")],
        "phone": [lambda: (rng.choice(["call ", "phone ", "tel ", ""]), rng.choice([f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(4)} {digits(6)}"]), ""), lambda: ("call ", f"({digits(3)}) {digits(3)}-{digits(4)}", ""), lambda: ("phone ", f"{digits(3)}-{digits(3)}-{digits(4)}", ","), lambda: ("tel ", f"{digits(3)}.{digits(3)}.{digits(4)}", "")],
        "mac": [lambda: ("device ", ":".join(hexes(2) for _ in range(6)), ""), lambda: ("", ":".join(af(2) for _ in range(6)), ""), lambda: ("mac ", "-".join(af(2) for _ in range(6)), "")],
        "ipv6": [lambda: (rng.choice(["from ", "", "host "]), ":".join(hexes(rng.randrange(1, 5)) for _ in range(rng.randrange(1, 4))) + "::" + ":".join(hexes(rng.randrange(1, 5)) for _ in range(rng.randrange(1, 4))), ""), lambda: ("from ", ":".join(hexes(4) for _ in range(8)), ""), lambda: ("", ":".join(af(4) for _ in range(8)), "")],
        "": [
            lambda: ("", word() + "-" + "".join(word() for _ in range(8)), ""), lambda: ("order ", digits(12), ""), lambda: (rng.choice(["order ", "invoice ", "item ", "ticket no ", "serial "]), "-".join(map(digits, (3, 3, 4))), ""), lambda: (rng.choice(["doi ", "doi: ", "see "]), f"10.{digits(4)}/{digits(3)}-{digits(3)}-{digits(4)}", ""),
            lambda: ("", f"{rng.randrange(24)}:{digits(2)}:{digits(2)}", ""), lambda: ("std", "::vector::a1", ""), lambda: ("", digits(16), ""), lambda: ("in ", "2019-2024 1990", ""), lambda: ("", "_" * 20, ""),
            lambda: ("part ", f"{digits(4)}-{digits(4)}", ""), lambda: ("", "XX12 " + "ABCD EFGH IJKL", ""), lambda: ("", "".join(word() for _ in range(9)), ""), lambda: ("sum ", f"{digits(7)}", ""),
            lambda: (rng.choice(["item ", "key ", "model ", ""]), code(), ""), lambda: (rng.choice(["", "see ", "token "]), "/".join(parts()), ""), lambda: (rng.choice(["room ", "", "no. "]), upper(rng.randrange(7, 11)), ""),
            lambda: ("", camel(), ""), lambda: (rng.choice(["key ", "token = ", "secret: "]), camel(), ""), lambda: (rng.choice(["", "key ", "token: "]), "_".join(parts()), ""),
            lambda: (rng.choice(["", "secret ", "account: "]), "-".join(parts()), ""), lambda: (rng.choice(["", "key: ", "card "]), "".join(parts()), ""), lambda: ("", "-".join(af(2) for _ in range(9)), ""),
        ],
    }
    dashed = lambda *groups: "-".join(map(digits, groups))
    alone = [
        ("phone", lambda: f"({digits(3)}) {dashed(3, 4)}"), ("phone", lambda: dashed(3, 3, 4)), ("phone", lambda: ".".join(map(digits, (3, 3, 4)))), ("phone", lambda: f"+{rng.randrange(1, 99)} ({digits(3)}) {dashed(3, 4)}"),
        ("phone", lambda: f"+1-{dashed(3, 3, 4)}"), ("ssn", lambda: dashed(3, 2, 4)), ("ssn", lambda: dashed(3, 2, 4)), ("iban", iban), ("mac", lambda: ":".join(hexes(2) for _ in range(6))),
        ("ipv6", lambda: ":".join(hexes(4) for _ in range(8))), ("", lambda: f"{rng.randrange(1950, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"), ("", lambda: str(rng.randrange(1, 2030))),
        ("", lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4))), ("", lambda: digits(7)), ("", lambda: dashed(2, 3, 3, 4, 2)), ("", lambda: dashed(4, 3, 2, 4)), ("", lambda: dashed(3, 2, 4, 3)),
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        if rng.random() < 0.4:  # side by side, with at most a cue in front
            text = rng.choice(["", "", "SSN ", "call ", "from ", word() + " "])
            for _ in range(rng.randrange(2, 4)):
                kind, make = rng.choice(alone)
                body = make()
                if kind:
                    spans.append((kind, len(text), len(text) + len(body)))
                text += body + rng.choice([" ", " ", " ", ", ", "; ", "/"])
            out.append((text + word(), spans))
            continue
        for _ in range(rng.randrange(1, 4)):
            text += " ".join(word() for _ in range(rng.randrange(0, 6))) + " "
            kind = rng.choice(list(kinds))
            head, body, tail = rng.choice(kinds[kind])()
            if kind:
                spans.append((kind, len(text) + len(head), len(text) + len(head) + len(body)))
            text += head + body + tail + " "
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=1)
def trained(steps: int = 30, rate: float = 0.5, decay: float = 0.002) -> Field:
    """Weights of greatest likelihood on the generated sentences, by gradient ascent with a Gaussian prior."""
    number: dict[str, int] = {}
    zoned, flat, sizes, wanted = [], [], [], []
    for text, spans in sentences():
        there = set(spans)
        for zone in zones(segments(text, base_spans(text))):
            choices = list(options(text, zone))
            last, right = "", []
            for s, e, k, names in sorted(choices):
                if (k, s, e) in there:
                    right += [*names, f"{last}>{k}"]
                    last = k
            wanted += [number.setdefault(n, len(number)) for n in right]
            zoned.append([c[:3] for c in choices])
            sizes += [len(c[3]) for c in choices]
            flat += [number.setdefault(n, len(number)) for c in choices for n in c[3]]
    pairs = {f"{y}>{k}": number.setdefault(f"{y}>{k}", len(number)) for y in ("", *TYPES) for k in TYPES}
    index, counts = np.array(flat), np.array(sizes)
    begins = np.cumsum(counts) - counts
    goal = np.bincount(wanted, minlength=len(number)).astype(float)
    w, squares = np.zeros(len(number)), np.zeros(len(number))
    for _ in range(steps):
        scores = np.add.reduceat(w[index], begins).tolist()
        transitions = {name: w[i] for name, i in pairs.items()}
        slope, each, at = goal - decay * len(zoned) * w, [], 0
        for choices in zoned:
            own = [(*c, score, ()) for c, score in zip(choices, scores[at : at + len(choices)], strict=True)]
            at += len(choices)
            p, follow = marginals(own, transitions)
            each += p
            for name, v in follow.items():
                slope[pairs[name]] -= v
        slope -= np.bincount(index, np.repeat(each, counts), len(number))
        squares += slope * slope
        w += rate * slope / (np.sqrt(squares) + 1e-9)
    return Field({name: float(w[i]) for name, i in number.items() if w[i]})


def find(text: bytes, weights: Field) -> tuple[list[Span], list[Span]]:
    """(what the fixed patterns find, what the field adds), both by kind and start, in code points."""
    if not _MAY.search(text):
        return [], []
    decoded = text.decode()
    base = base_spans(decoded)
    added = [span for zone in zones(segments(decoded, base)) for span in decode_sorted(scored(decoded, zone, weights), weights)]
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base and added, each an array of structs kind, start, end (code points, end exclusive).

    Text null or empty: no spans. Repeated rows give equal rows; a null doc_id stays."""
    weights = trained()

    def run(keys: list, texts: list[bytes]) -> dict[str, list]:
        found = [find(t, weights) for t in texts]
        rows = [[[{"kind": k, "start": s, "end": e} for k, s, e in part] for part in pair] for pair in found]
        return {"doc_id": keys, "base": [r[0] for r in rows], "added": [r[1] for r in rows]}

    one = "array<struct<kind:string,start:long,end:long>>"
    return map_texts(docs, run, f"doc_id long, base {one}, added {one}")


def mask(text: str, found: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(order[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    found = spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(number, BASE_KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), F.array_join(F.array_distinct(every), ",").alias("spans"))
