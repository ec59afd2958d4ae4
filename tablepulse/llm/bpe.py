"""Byte-pair encoding and decoding with a public vocabulary file; merges by a pair occurrence index.

A batch's distinct words are laid out in one chain of symbols. An index holds, for each mergeable pair, all positions
where it stands. Active ranks are taken in ascending order; every live occurrence of that rank's pair is merged, left to
right, and the lists of the pairs that appear on either side are updated. Texts are then put together from the ids of their
words, and decoded again from those ids.

The file is one of the tokenizers library, of the kind that words end with a suffix: NFC, runs of white space, lower case,
a split pattern whose matches are kept, bytes as printable characters. Special tokens in a text are found before all that.
The library's parts follow different versions of Unicode; what they don't share with Python's is stated below.
Text null or empty: no ids, decoded text empty. Memory: a chunk of text and tables of up to TABLE_LIMIT words.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain, islice
from unicodedata import category, normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import give_back, in_chunks, table, text_rows, worker_state

#: Pieces of text that a worker may know at once, and those, the first it met, that it keeps when there are more.
TABLE_LIMIT, TABLE_KEPT = 120_000, 80_000


def _points(ranges: str) -> Iterator[int]:
    for one in ranges.split():
        first, _, last = one.partition("-")
        yield from range(int(first, 16), int(last or first, 16) + 1)


#: Fixed values, in hexadecimal: marks that came after Unicode 9, which the library neither reorders nor composes.
LATER_MARKS = """
7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e
11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef
"""
#: Letters and numbers of Unicode 16, which the library splits by and Python may not know yet.
LATER_LETTERS = """
1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0
13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0
"""
LATER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Capital letters of Unicode 16 and 17, and the small letters of each.
LATER_CAPITALS = "1c89 a7cb a7cc a7ce a7d2 a7d4 a7da a7dc 10d50-10d65 16ea0-16eb8"
LATER_SMALL = "1c8a 264 a7cd a7cf a7d3 a7d5 a7db 19b 10d70-10d85 16ebb-16ed3"

_APART = regex.compile("([" + "".join(map(chr, _points(LATER_MARKS))) + "])")
_LETTERS, _NUMBERS = frozenset(map(chr, _points(LATER_LETTERS))), frozenset(map(chr, _points(LATER_NUMBERS)))
#: The capital sigma is lower-cased by itself, so it has no final form.
_LOWER = dict(zip(_points(LATER_CAPITALS), map(chr, _points(LATER_SMALL)), strict=True)) | {0x3A3: "σ"}
_SPACE = regex.compile(r"\p{White_Space}")


class Classes(dict):
    """By character: itself if ASCII, else a character of the same class (white space, letter, number, other)."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = category(c)[0]
        self[point] = out = c if point < 128 else " " if _SPACE.match(c) else "é" if kind == "L" or c in _LETTERS else "²" if kind == "N" or c in _NUMBERS else "!"
        return out


def printable_bytes() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordTable(dict):
    """Pieces of text without ASCII white space, numbered as they come; new ones wait in pending."""

    def __init__(self) -> None:
        self.pending: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.pending.append(piece)
        return n


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.classes = Classes()
        shown = printable_bytes()
        self.inner, self.last = [vocab[c] for c in shown], [vocab[c + suffix] for c in shown]
        # by pair of ids: rank and id of what the merge makes
        self.merges: dict[int, tuple[int, int]] = {}
        self.pair_of: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            pair = vocab[a] << 20 | vocab[b]
            self.pair_of.append(pair)
            self.merges.setdefault(pair, (rank, vocab[a + b]))
        self.tokens = np.full(max(chain(vocab.values(), self.special.values())) + 1, "", dtype=object)
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        self.table = WordTable()
        self.words: dict[str, list[int]] = {}
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def trim(self) -> None:
        """Only what was met first is kept: frequent words are among it."""
        kept = WordTable()
        kept.update(islice(self.table.items(), TABLE_KEPT))
        self.table = kept
        self.words = dict(islice(self.words.items(), TABLE_KEPT))
        self.starts, self.counts = self.starts[:TABLE_KEPT].copy(), self.counts[:TABLE_KEPT].copy()
        self.flat = self.flat[: int(self.starts[-1] + self.counts[-1])].copy()

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by the pair occurrence index."""
        if not words:
            return []
        merges, symbols, begins = self.merges, [], []
        for word in words:
            raw = word.encode()
            begins.append(len(symbols))
            symbols += [self.inner[b] for b in raw[:-1]]
            symbols.append(self.last[raw[-1]])
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for begin in begins:
            before[begin] = -1
            if begin:
                after[begin - 1] = -1
        after[n - 1] = -1
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            if after[i] > 0 and (pair := symbols[i] << 20 | symbols[i + 1]) in merges:
                where.setdefault(pair, []).append(i)
        active = [merges[pair][0] for pair in where]
        heapq.heapify(active)
        while active:
            pair = self.pair_of[heapq.heappop(active)]
            at = where.pop(pair, None)
            if at is None:
                continue
            made = merges[pair][1]
            left, right = pair >> 20, pair & 0xFFFFF
            at.sort()
            for i in at:
                j = after[i]
                if j < 0 or symbols[i] != left or symbols[j] != right:
                    continue  # merged otherwise meanwhile
                symbols[i], symbols[j] = made, -1
                after[i] = k = after[j]
                after[j] = -1
                if k >= 0:
                    before[k] = i
                    if (new := made << 20 | symbols[k]) in merges:
                        if new not in where:
                            where[new] = []
                            heapq.heappush(active, merges[new][0])
                        where[new].append(i)
                if (k := before[i]) >= 0 and (new := symbols[k] << 20 | made) in merges:
                    if new not in where:
                        where[new] = []
                        heapq.heappush(active, merges[new][0])
                    where[new].append(k)
        out = []
        for begin, end in zip(begins, begins[1:] + [n], strict=True):
            out.append([s for s in symbols[begin:end] if s >= 0])
        return out

    def words_of(self, piece: bytes) -> list[str]:
        """Normalised and split as the file says."""
        text = piece.decode()
        if text.isascii():
            return self.pieces.findall(text.lower())
        text = "".join(normalize("NFC", part) for part in _APART.split(text)).translate(_LOWER).lower()
        return [text[m.start() : m.end()] for m in self.pieces.finditer(text.translate(self.classes))]

    def resolve(self) -> None:
        """Ids for all pending pieces."""
        pending, self.table.pending = self.table.pending, []
        if not pending:
            return
        split = [self.words_of(p) for p in pending]
        fresh = sorted({w for words in split for w in words}.difference(self.words))
        self.words.update(zip(fresh, self.merge(fresh), strict=True))
        ids = [[i for w in words for i in self.words[w]] for words in split]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (and the last's end)."""
        if len(self.table) > TABLE_LIMIT:
            self.trim()
        number, numbers, lengths, specials = self.table.__getitem__, [], [], {}
        for k, text in enumerate(texts):
            if b"<|" in text and self.special_pattern.search(decoded := text.decode()):
                got, at = [], 0  # negative: a special token
                for m in self.special_pattern.finditer(decoded):
                    got += [*map(number, decoded[at : m.start()].encode().split()), -1 - self.special[m[0]]]
                    at = m.end()
                specials[k] = got = got + list(map(number, decoded[at:].encode().split()))
            else:
                got = list(map(number, text.split()))
            numbers.append(np.array(got, dtype=np.int64))
            lengths.append(len(got))
        self.resolve()
        pieces = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        special = pieces < 0
        safe = np.where(special, 0, pieces)
        if len(self.counts):
            counts, starts = self.counts[safe], self.starts[safe]
        else:
            counts, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        counts = np.where(special, 1, counts)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(starts - (ends - counts), counts)
        if special.any():
            flat = self.flat[np.where(np.repeat(special, counts), 0, index)] if len(self.flat) else np.zeros(total, np.int32)
            flat[(ends - 1)[special]] = -1 - pieces[special]
        else:
            flat = self.flat[index]
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return flat, np.concatenate([[0], ends])[bounds]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space; special ones are kept."""
        return " ".join(self.tokens[ids].tolist()) if len(ids) else ""


def codec(path: str) -> Codec:
    return worker_state(("codec", path), lambda: Codec(path))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, decoded string."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for keys, texts in in_chunks(batches):
            flat, bounds = own.encode(texts)
            decoded = [own.decode(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, pa.array(decoded, pa.string())], schema=schema)
        give_back()

    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    return encode_decode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        *(["ids"] if with_ids else []),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
