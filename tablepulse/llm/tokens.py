"""Texts as arrays of word numbers, with facts of each distinct word gathered once."""

from __future__ import annotations

import re
from itertools import islice
from zlib import crc32

import numpy as np

from tablepulse.llm.common import worker_state

#: Distinct words that a worker may know at once, and those, the first it met, that it keeps when there are more.
TABLE_LIMIT, TABLE_KEPT = 120_000, 80_000
#: Runs of letters and digits (anything beyond ASCII counts as a letter), and runs of other characters.
PARTS = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff]+").findall
SYMBOLS = b"#*$%&|<>"


class Numbers(dict):
    """Word to number, in order of appearance; new words wait in fresh."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Growing:
    """An array to which values are added at the end."""

    def __init__(self, dtype: type) -> None:
        self.data, self.size = np.zeros(1024, dtype), 0

    def add(self, values: list) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need - len(self.data), len(self.data)), self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need

    def cut(self, size: int) -> None:
        self.data, self.size = self.data[:size].copy(), size


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each of the ranges, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Words:
    """Numbers of a chunk's words. A word's parts are hashed with CRC-32."""

    def __init__(self) -> None:
        self.numbers = Numbers()
        self.chars, self.symbols = Growing(np.int32), Growing(np.int32)
        self.part_start, self.part_count, self.parts = Growing(np.int64), Growing(np.int32), Growing(np.uint32)

    def trim(self) -> None:
        """Only what was met first is kept: frequent words are among it."""
        kept = Numbers()
        kept.update(islice(self.numbers.items(), TABLE_KEPT))
        self.numbers = kept
        for facts in (self.chars, self.symbols, self.part_start, self.part_count):
            facts.cut(len(kept))
        self.parts.cut(int(self.part_start.data[-1] + self.part_count.data[-1]))

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, number of words of each)."""
        if len(self.numbers) > TABLE_LIMIT:
            self.trim()
        number = self.numbers.__getitem__
        found = [text.split() for text in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        out = np.empty(int(counts.sum()), np.int64)
        at = 0
        for words in found:
            out[at : at + len(words)] = list(map(number, words))
            at += len(words)
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if fresh:
            self.learn(fresh)
        return out, counts

    def learn(self, fresh: list[bytes]) -> None:
        split = list(map(PARTS, fresh))
        sizes = list(map(len, split))
        self.part_start.add((self.parts.size + np.cumsum(sizes) - sizes).tolist())
        self.part_count.add(sizes)
        self.parts.add([crc32(p) for parts in split for p in parts])
        self.chars.add([len(w) if w.isascii() else len(w.decode()) for w in fresh])
        self.symbols.add([len(w) - len(w.translate(None, SYMBOLS)) for w in fresh])

    def part_hashes(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(CRC-32 of the parts of all words in order, number of parts of each text)."""
        each = self.part_count.data[numbers].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(each)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return self.parts.data[ragged(self.part_start.data[numbers], each)], np.diff(upto[bounds])


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    upto = np.concatenate([[0], np.cumsum(values)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def shared_words() -> Words:
    """The one table of this Python worker, kept from task to task."""
    return worker_state("words", Words)
