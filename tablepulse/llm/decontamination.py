"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact check of weighted shingles.

Words are cut at ASCII white space, lower-cased (A-Z) and stripped of ASCII punctuation; what is left empty doesn't count. A
window's fingerprint has a bit set where over half of the hashes of its pairs of neighbouring words have it. Every text gives
the fingerprint of the window at each word, for each size that items have. Fingerprints are counted 64 bits at once: the bit
counts of windows of 1, 2, 4, ... pairs are kept as planes of a binary number and added as such, each size from the one below.
Sizes are whole up to 31 words; those of longer items are cut to five leading binary digits (6 % at most), and all their windows
of that size are indexed, so that few sizes serve all items. A text that is a little shorter than an item is a window of its own.

A fingerprint is cut in four blocks of 16 bits. Two fingerprints within RADIUS = 11 bits differ by two or fewer in some block,
so items are indexed under all values within two bits of each of their blocks, and looking up each block of a window misses
none of them; those found are compared whole. A survivor says where the item would begin; the item-sized window there, and
those shifted by a few words, are compared with the item by their five-word shingles, each weighing as often as it stands (sum
of minima over sum of maxima). From MIN_SIMILARITY on it's a leak. All windows around the places found are counted in one pass over
the text there, whatever their number and the item's length; the best one is then compared word by word.

Fingerprints find what is within RADIUS, which is not all that is similar: of a passage at similarity 0.8 about one bit in
seven differs. tests/llm/test_decontamination.py measures the share of similar passages found (RECALL there).

An item of fewer than WINDOW_WORDS words has three shingles at most, or is itself its only one, so at MIN_SIMILARITY all must
be equal. It is looked up exactly: by the sum of its shingles' hashes, at every word, without fingerprints.

Items are held in blocks of ITEM_BLOCK, one at a time on the driver; each block is looked for in all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import filter_texts, map_texts, table, worker_state
from tablepulse.llm.tokens import Growing, Words, ragged

SHINGLE, MIN_SIMILARITY, RADIUS, LEAST_WORDS, WINDOW_WORDS, ITEM_BLOCK = 5, 0.8, 11, 1, 8, 10_000
#: Leading binary digits of a window's size.
DIGITS = 5
#: Pairs of fingerprints that are compared at once, and words whose windows are counted at once (few, so that a processor's cache holds them).
COMPARED, STRETCH = 1 << 20, 1 << 14
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The values of a block that differ from it in a quarter of RADIUS bits or fewer, as differences.
NEARBY = np.array([sum(1 << b for b in bits) for n in range(RADIUS // 4 + 1) for bits in combinations(range(16), n)], np.uint16)
Planes = list[np.ndarray]


def plain(word: bytes) -> bytes:
    return word.lower().strip(PUNCTUATION)


def plain_words(text: bytes) -> list[bytes]:
    return [p for w in text.split() if (p := plain(w))]


def hashed(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word, 42) or 1) if word else 0


def reach(n: int) -> int:
    """Words that an item of n words may be shifted or lack at one end at similarity 0.8 or more."""
    return 1 + max(n - SHINGLE + 1, 0) // 9


def window_size(n: int) -> int:
    """The size of an item's windows: n, cut to DIGITS leading binary digits."""
    spare = max(n.bit_length() - DIGITS, 0)
    return n >> spare << spare


def least_words(n: int) -> int:
    """Words that a text needs to hold an item of n words at similarity 0.8 or more."""
    return int(np.ceil(MIN_SIMILARITY * (n - SHINGLE + 1))) + SHINGLE - 1


def add(total: Planes, part: Planes, most: int) -> Planes:
    """Sum of binary numbers, most at most, whose digits stand in planes, 64 of them side by side in each word; total is overwritten."""
    carry = None
    for i, a in enumerate(total):
        b = part[i] if i < len(part) else None
        if carry is None:
            carry = a & b
            a ^= b
        elif b is None:
            over = a & carry
            a ^= carry
            carry = over
        else:
            half = a ^ b
            over = (a & b) | (half & carry)
            np.bitwise_xor(half, carry, out=a)
            carry = over
    for i in range(len(total), most.bit_length()):
        if i < len(part):
            total, carry = [*total, part[i] ^ carry], part[i] & carry
        else:
            total, carry = [*total, carry], np.zeros_like(carry)
    return total


def above(planes: Planes, bound: int) -> np.ndarray:
    """Bits whose number is greater than bound: those that carry when its complement is added."""
    digits = max(len(planes), bound.bit_length())
    carry = np.zeros_like(planes[0])
    for i, digit in enumerate(planes):
        if bound >> i & 1:
            carry &= digit
        else:
            carry |= digit
    for i in range(len(planes), digits):
        if bound >> i & 1:
            carry[:] = 0
    return carry


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and the one that follows it."""
    mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ mixed >> np.uint64(32)


def run_prints(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """By size, ascending, the fingerprint of the run of so many hashes that begins at each of them: a bit is set where over half have it."""
    counts: list[Planes] = [[hashes]]  # of runs of 1, 2, 4, ...
    total: Planes = []
    done = 0
    for size in sorted(sizes):
        gap = size - done
        for k in range(gap.bit_length()):
            if k == len(counts):
                half, shift = counts[-1], 1 << k - 1
                n = max(len(half[0]) - shift, 0)
                counts.append(add([p[:n].copy() for p in half], [p[shift : shift + n] for p in half], 2 * shift))
            if gap >> k & 1:
                part = [p[done:] for p in counts[k]]
                n = min(len(part[0]), len(total[0])) if total else len(part[0])
                done += 1 << k
                total = add([p[:n] for p in total], [p[:n] for p in part], done) if total else [p.copy() for p in part]
        yield size, above(total, size // 2)


def run_sums(hashes: np.ndarray, n: int) -> np.ndarray:
    """For the run of n words that begins at each word, a number that is equal for runs of the same shingles."""
    size = min(n, SHINGLE)
    starts = max(len(hashes) - n + 1, 0)
    each = np.zeros(starts + n - size if starts else 0, np.uint64)
    for k in range(size):
        each = (each ^ hashes[k : k + len(each)]) * np.uint64(0x9E3779B97F4A7C15)
        each ^= each >> np.uint64(29)
    out = np.zeros(starts, np.uint64)
    for k in range(n - size + 1):
        out += each[k : k + starts]
    return out


def shingles(words: list[bytes]) -> Counter:
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / max(1, a.total() + b.total() - both)


class Index:
    """Fingerprints of one window size, looked up by any of their four blocks."""

    def __init__(self, prints: np.ndarray, items: np.ndarray, offsets: np.ndarray) -> None:
        self.prints, self.items, self.offsets = prints, items, offsets
        self.has, self.keys, self.entries = np.zeros((4, 65536), bool), [], []
        for b in range(4):
            values = (prints >> np.uint64(16 * b)).astype(np.uint16)[:, None] ^ NEARBY
            order = np.argsort(values, axis=None, kind="stable")
            self.keys.append(values.ravel()[order])
            self.entries.append((order // len(NEARBY)).astype(np.int32))
            self.has[b, self.keys[b]] = True

    def known(self, prints: np.ndarray) -> np.ndarray:
        """Which prints have a block that some entry has, nearly."""
        blocks = prints.view(np.uint16).reshape(-1, 4)
        some = self.has[0].take(blocks[:, 0].astype(np.int64), mode="clip")
        for b in range(1, 4):
            some |= self.has[b].take(blocks[:, b].astype(np.int64), mode="clip")
        return some

    def near(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index in prints, entry) of all pairs within RADIUS bits, in parts; a pair may come once for each block."""
        for b in range(4):
            block = (prints >> np.uint64(16 * b)).astype(np.uint16)
            hit = np.flatnonzero(self.has[b][block])
            low, high = (np.searchsorted(self.keys[b], block[hit], side=side) for side in ("left", "right"))
            upto = np.cumsum(high - low)
            at = 0
            while at < len(hit):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMPARED, side="right")))
                n = high[at:stop] - low[at:stop]
                where, found = np.repeat(hit[at:stop], n), self.entries[b][ragged(low[at:stop], n)]
                close = np.bitwise_count(prints[where] ^ self.prints[found]) <= RADIUS
                if close.any():
                    yield where[close], found[close]
                at = stop


@dataclass
class Items:
    """Items, each once, with the ids that stand for it."""

    ids: list
    words: list[list[bytes]]
    indexes: dict[int, Index] = field(init=False)
    least: dict[int, int] = field(init=False)  # by window size, the words that a text needs
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)  # by number of words: sums, ascending, and their items
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)  # of longer items: hashes of shingles, ascending, and how often each stands

    def __post_init__(self) -> None:
        same: dict[tuple, list] = {}
        for i, words in zip(self.ids, self.words, strict=True):
            same.setdefault(tuple(words), []).append(i)
        self.ids, self.words = list(same.values()), list(map(list, same))
        self.shingles = list(map(shingles, self.words))
        parts: dict[int, list] = {}
        short: dict[int, list] = {}
        self.least, self.grams = {}, {}
        for i, words in enumerate(self.words):
            n, hashes = len(words), np.array([hashed(w) for w in words], np.uint64)
            if LEAST_WORDS <= n < WINDOW_WORDS:
                short.setdefault(n, []).append((int(run_sums(hashes, n)[0]), i))
            elif n >= WINDOW_WORDS:
                self.grams[i] = np.unique(run_sums(hashes, SHINGLE), return_counts=True)
                size = window_size(n)
                prints = dict(run_prints(pair_hashes(hashes), [size - 1]))[size - 1]
                parts.setdefault(size, []).append((prints, np.full(len(prints), i), np.arange(len(prints))))
                self.least[size] = min(least_words(n), self.least.get(size, n))
        self.short = {n: (np.array([x for x, _ in p], np.uint64), np.array([i for _, i in p], np.int64)) for n, p in ((n, sorted(p)) for n, p in short.items())}
        self.indexes = {size: Index(*(np.concatenate(x) for x in zip(*p, strict=True))) for size, p in sorted(parts.items())}


class PlainHashes(Words):
    """Words whose fact is the hash of their plain form."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = Growing(np.uint64)

    def trim(self) -> None:
        super().trim()
        self.hashes.cut(len(self.numbers))

    def learn(self, fresh: list[bytes]) -> None:
        # words have no line break, so all of them are lower-cased at once
        self.hashes.add([hashed(w.strip(PUNCTUATION)) for w in b"\n".join(fresh).lower().split(b"\n")])


def whole_prints(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of all pairs of each text."""
    out = np.zeros(len(begins), np.uint64)
    for k, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist(), strict=True)):
        pairs = pair_hashes(hashes[begin : begin + size])
        bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * bits > len(pairs), bitorder="little").view(np.uint64)[0]
    return out


def places(items: Items, hashes: np.ndarray, text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, item, first word of the item in it, differing bits) of all windows within RADIUS bits of an item's."""
    left = (begins + sizes)[text] - np.arange(len(text))  # words from here to the text's end
    out = [np.zeros((0, 4), np.int64)]
    waiting: dict[int, list] = {}
    held = kept = 0

    def compare() -> None:
        nonlocal held
        for size, parts in waiting.items():
            index, (at, prints) = items.indexes[size], map(np.concatenate, zip(*parts, strict=True))
            for where, entry in index.near(prints):
                here, t = at[where], text[at[where]]
                bits = np.bitwise_count(prints[where] ^ index.prints[entry])
                keep(np.column_stack([t, index.items[entry], here - begins[t] - index.offsets[entry], bits]).astype(np.int64))
        waiting.clear()
        held = 0

    def keep(rows: np.ndarray) -> None:
        """Each text, item and place once: windows of a repetitive text or item meet there over and over."""
        nonlocal kept
        out.append(nearest(rows))
        kept += len(out[-1])
        if kept > 2 * COMPARED:
            out[:] = [nearest(np.concatenate(out))]
            kept = 0

    def look(size: int, prints: np.ndarray, counts: np.ndarray, at: np.ndarray) -> None:
        nonlocal held
        some = np.flatnonzero(items.indexes[size].known(np.ascontiguousarray(prints)) & counts)
        waiting.setdefault(size, []).append((at[some], prints[some]))
        held += len(some)
        if held > COMPARED:
            compare()

    pairs, longest, index = pair_hashes(hashes), max(items.indexes, default=0), np.arange(len(hashes))
    for start in range(0, len(pairs), STRETCH):
        for grams, prints in run_prints(pairs[start : start + STRETCH + longest], [size - 1 for size in items.indexes]):
            at = index[start : start + min(len(prints), STRETCH)]
            look(grams + 1, prints[: len(at)], left[at] > grams, at)
    small = np.flatnonzero((sizes >= min(items.least.values(), default=1)) & (sizes < longest))
    prints = whole_prints(hashes, begins[small], sizes[small])
    for size in items.indexes:
        look(size, prints, (sizes[small] < size) & (sizes[small] >= items.least[size]), begins[small])
    compare()
    return nearest(np.concatenate(out))


def nearest(rows: np.ndarray) -> np.ndarray:
    """Of rows (text, item, place, bits), those of fewest bits at each text, item and place, in that order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows


def similarities(grams: np.ndarray, hashes: np.ndarray, counts: np.ndarray, first: int, last: int) -> np.ndarray:
    """Similarity of an item and the window of its size at each word from first to last, which may lie beyond the text's ends.

    grams: the text's shingles; hashes and counts: the item's, ascending. All windows are counted together: a shingle of the text
    counts in those that hold it, but not so many earlier ones like it as the item has."""
    size = int(counts.sum())
    low, high = max(first, 0), min(last + size, len(grams))
    number = np.minimum(np.searchsorted(hashes, grams[low:high]), len(hashes) - 1)
    here = np.flatnonzero(hashes[number] == grams[low:high])
    number = number[here]
    order = np.argsort(number, kind="stable")
    place, number = here[order] + low, number[order]
    earlier = np.arange(len(place)) - counts[number]
    alike = (earlier >= 0) & (number[np.maximum(earlier, 0)] == number)
    begin = np.maximum(np.maximum(np.where(alike, place[np.maximum(earlier, 0)] + 1, first), place - size + 1), first)
    end = np.minimum(place, last)
    some = begin <= end
    steps = np.bincount(begin[some] - first, minlength=last - first + 2) - np.bincount(end[some] + 1 - first, minlength=last - first + 2)
    both = np.cumsum(steps)[:-1]
    starts = np.arange(first, last + 1)
    held = np.maximum(np.minimum(starts + size, len(grams)) - np.maximum(starts, 0), 0)
    return both / (size + held - both)


def best_window(grams: np.ndarray, hashes: np.ndarray, counts: np.ndarray, starts: np.ndarray, bits: np.ndarray, shift: int) -> tuple[float, int, int]:
    """(similarity, start, bits) of the most similar window within shift words of starts (ascending); of equal ones, the nearest in bits, then the first."""
    best = (0.0, 0, 0)
    gaps = np.flatnonzero(np.diff(starts) > 2 * shift + 1)
    for a, b in zip(np.append(0, gaps + 1), np.append(gaps, len(starts) - 1), strict=True):
        first = int(starts[a]) - shift
        found = similarities(grams, hashes, counts, first, int(starts[b]) + shift)
        most = found.max()
        if most < max(best[0], MIN_SIMILARITY):
            continue
        at = first + np.flatnonzero(found == most)
        for n in np.unique(bits[a : b + 1]).tolist():
            mine = starts[a : b + 1][bits[a : b + 1] == n]
            upto = np.searchsorted(mine, at + shift, side="right")
            near = at[upto > np.searchsorted(mine, at - shift)]
            if len(near):
                if most > best[0] or n < best[2]:
                    best = (float(most), int(near[0]), n)
                break
    return best


def leaks(texts: list[bytes], items: Items) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, differing bits) for each text and item of it, at its most similar place."""
    known = worker_state("plain hashes", PlainHashes)
    numbers, counts = known.read(texts)
    hashes = known.hashes.data[numbers]
    counted = hashes != 0
    text = np.repeat(np.arange(len(texts)), counts)[counted]
    hashes = hashes[counted]
    sizes = np.bincount(text, minlength=len(texts))
    begins = np.cumsum(sizes) - sizes
    left = (begins + sizes)[text] - np.arange(len(text))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for n, (sums, numbers) in items.short.items():
        found = run_sums(hashes, n)
        low = np.searchsorted(sums, found, side="left")
        at = np.flatnonzero((left[: len(found)] >= n) & (sums[np.minimum(low, len(sums) - 1)] == found))
        first, counts = low[at], np.searchsorted(sums, found[at], side="right") - low[at]
        at, item = np.repeat(at, counts), numbers[ragged(first, counts)]
        # all runs found are equal in their shingles, so the first of each text and item stands for the others
        _, once = np.unique(text[at] * len(items.words) + item, return_index=True)
        for a, i in zip(at[once].tolist(), item[once].tolist(), strict=True):
            best[int(text[a]), i] = (1.0, a - int(begins[text[a]]), 0)
    found = places(items, hashes, text, begins, sizes) if len(hashes) else np.zeros((0, 4), np.int64)
    if not len(found):
        return [(t, i, *x) for (t, i), x in best.items()]
    runs = run_sums(hashes, SHINGLE)
    words: dict[int, list[bytes]] = {}
    cuts = np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(axis=1)) + 1
    for rows in np.split(found, cuts):
        t, i = int(rows[0, 0]), int(rows[0, 1])
        if best.get((t, i), (0.0,))[0] == 1.0:
            continue
        n = len(items.words[i])
        grams = runs[begins[t] : begins[t] + max(sizes[t] - SHINGLE + 1, 0)]
        _, start, bits = best_window(grams, *items.grams[i], rows[:, 2], rows[:, 3], reach(n))
        if t not in words:
            words = {t: plain_words(texts[t])}
        low, high = max(start, 0), start + n
        # on the words themselves, so that no two shingles of one hash pass for equal
        s = similarity(items.shingles[i], shingles(words[t][low:high])) if high > 0 else 0.0
        if s >= MIN_SIMILARITY:
            best[t, i] = (s, low, bits)
    return [(t, i, *x) for (t, i), x in best.items()]


def item_blocks(items: DataFrame, size: int = ITEM_BLOCK) -> Iterator[Items]:
    """The benchmark, at most about size items at a time; one block at least."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    blocks = max(1, -(-rows.count() // size))
    for b in range(blocks):
        found = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Items([r.item_id for r in found], [plain_words(bytes(r.text or b"")) for r in found])


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each row of docs and item that it holds: doc_id, item_id, similarity, first_word, hamming.

    Text or item null or empty, or without a word: no match. Repeated rows or items give a row each; null ids stay null. Empty
    tables give no rows. A very long text is worked on whole."""
    out = None
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(keys: list, texts: list[bytes], sent=sent) -> dict[str, list]:
            found = [(t, one, *x) for t, i, *x in leaks(texts, sent.value) for one in sent.value.ids[i]]
            return {"doc_id": [keys[x[0]] for x in found], "item_id": [x[1] for x in found], "similarity": [x[2] for x in found], "first_word": [x[3] for x in found], "hamming": [x[4] for x in found]}

        rows = map_texts(docs, run, "doc_id long, item_id long, similarity double, first_word long, hamming int")
        out = rows if out is None else out.unionByName(rows)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold an item; all columns stay as they are."""
    for block in item_blocks(items):
        docs = filter_texts(docs, _clean(docs.sparkSession.sparkContext.broadcast(block)))
    return docs


def _clean(sent) -> Callable[[list[bytes]], list[bool]]:  # noqa: ANN001
    def keep(texts: list[bytes]) -> list[bool]:
        held = {t for t, *_ in leaks(texts, sent.value)}
        return [t not in held for t in range(len(texts))]

    return keep


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
