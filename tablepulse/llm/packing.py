"""Best-fit packing: documents as token sequences of bounded length, by best-fit decreasing over all documents at once.

A document is its token ids and the end id. What is longer than a sequence is cut into pieces of that length; only the last may
be shorter. Lengths are whole numbers up to the sequence's, so documents of one length and open bins of one remaining capacity
are interchangeable. Best fit decreasing therefore runs over counts: lengths descend, a segment tree over remaining capacities
finds the tightest open bin, and all bins of that capacity take their pieces in one step. The plan is the same as that of one
pass over all pieces sorted by length, for any number of them, and its size depends on the sequence length only (see Plan).

Spark does the rest: ids are counted in one narrow pass, which also numbers the pieces of each length within its partition; the
rows (without ids) are written; counts by partition and length give each partition's first number; a piece's number of its
length is its place in the plan. The plan and the table of counts by length go through the driver, both bounded.

doc_id null: kept, null. Text null or empty: the end id alone. A very long text is as many pieces as it needs. Repeated rows:
each is packed. No rows: none. Which of several equally long pieces takes which place follows from partitions and their order;
the number of sequences and their fill don't. Memory: a chunk of text and a table of up to TABLE_LIMIT pieces of text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepulse.llm.bpe import Codec, printable_bytes
from tablepulse.llm.common import cut, give_back, in_chunks, table, text_rows, worker_state

SEQUENCE, END = 4096, 1
#: Pieces of text that a worker may know at once, and those, the first it met, that it keeps when there are more.
TABLE_LIMIT, TABLE_KEPT = 400_000, 200_000
#: Places of a piece's number below its length in a key of the plan.
RANK_BITS = 48


class Capacities:
    """A segment tree over remaining capacities 0 to size: which of them some open bin has."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = self.leaves + capacity
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of an open bin that is need or more."""
        at = self.leaves + need
        if self.open[at]:
            return need
        while at > 1:
            if not at & 1 and self.open[at + 1]:  # the right neighbour of a left child
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


class Plan:
    """Where the pieces of each length go: pieces low to high - 1 of a length fill sequences from first on, each pieces in each, from
    offset on.

    Bins are held as runs of numbers with one remaining capacity. A length makes at most three runs more (new bins, and the rest of
    a run that it uses in part), and a run is used by one length at most once for each distinct length that fits beside the others
    in one bin (fewer than sqrt(2 size)), so there are fewer than 3 size sqrt(2 size) entries, whatever the number of pieces."""

    def __init__(self, counts: dict[int, int], size: int = SEQUENCE) -> None:
        tree, runs, rows = Capacities(size), {}, []
        self.sequences = 0
        for length in sorted(counts, reverse=True):
            done, left = 0, counts[length]

            def put(run: tuple[int, int], capacity: int, each: int) -> None:
                """The bins of run take each pieces of this length; then they have less capacity."""
                nonlocal done, left
                n = run[1] * each
                rows.append((length << RANK_BITS | done, run[0], each, size - capacity))  # noqa: B023
                done, left = done + n, left - n
                rest = capacity - each * length  # noqa: B023
                if rest:
                    runs.setdefault(rest, []).append(run)
                    tree.add(rest, run[1])

            while left:
                capacity = tree.tightest(length)
                if capacity is None:
                    capacity, bins = size, -(-left // (size // length))
                    run, self.sequences = (self.sequences, bins), self.sequences + bins
                else:
                    run = runs[capacity].pop()
                    tree.add(capacity, -run[1])
                # after each piece a bin is tighter than all others, so it takes pieces as long as they fit
                each = capacity // length
                full, (first, bins) = min(run[1], left // each), run
                if full:
                    put((first, full), capacity, each)
                if full < bins and left:
                    put((first + full, 1), capacity, left)
                    full += 1
                if full < bins:
                    runs.setdefault(capacity, []).append((first + full, bins - full))
                    tree.add(capacity, bins - full)
        self.low, self.first, self.each, self.offset = np.array(sorted(rows) or np.zeros((0, 4)), np.int64).T.copy()

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these numbers of their lengths."""
        keys = lengths << RANK_BITS | ranks
        at = np.searchsorted(self.low, keys, side="right") - 1
        beyond = keys - self.low[at]
        return self.first[at] + beyond // self.each[at], self.offset[at] + beyond % self.each[at] * lengths


class WordIds(dict):
    """A word, split off already, to its ids as little-endian 32-bit numbers, merged by the library's model."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model, self.shown = Tokenizer.from_file(path).model, printable_bytes()

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        found = self.model.tokenize(word if plain else "".join(map(self.shown.__getitem__, word.encode())))
        self[word] = ids = _little([t.id for t in found])
        return ids


class Ids(dict):
    """A piece of text without ASCII white space to its ids."""

    def __init__(self, path: str) -> None:
        self.codec, self.words = Codec(path), WordIds(path)

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.words[piece.decode().lower()] if piece.isalpha() else b"".join(map(self.words.__getitem__, self.codec.words_of(piece)))
        self[piece] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        if b"<|" in text and self.codec.special_pattern.search(decoded := text.decode()):
            parts, at = [], 0
            for m in self.codec.special_pattern.finditer(decoded):
                parts += map(self.__getitem__, decoded[at : m.start()].encode().split())
                parts.append(_little([self.codec.special[m[0]]]))
                at = m.end()
            return b"".join([*parts, *map(self.__getitem__, decoded[at:].encode().split())])
        return b"".join(map(self.__getitem__, text.split()))

    def trim(self) -> None:
        """Only what was met first is kept: frequent pieces are among it."""
        for known in (self, self.words):
            if len(known) > TABLE_LIMIT:
                kept = list(islice(known.items(), TABLE_KEPT))
                known.clear()
                known.update(kept)


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and its number (rank) among those of its length in its part."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Ids = worker_state(("packing", path), lambda: Ids(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for keys, texts in in_chunks(batches):
            known.trim()
            rows = []
            for key, text in zip(keys, texts, strict=True):
                ids = memoryview(known.of(text) + last)
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    one = ids[at : at + 4 * size]
                    rows.append((key, k, k * size, len(one) // 4, crc32(one)))
            columns = list(zip(*rows, strict=True))
            lengths = np.array(columns[3])
            # numbers among equal lengths: places in a stable sort, less the place of the first
            order = np.argsort(lengths, kind="stable")
            some, first, counts = np.unique(lengths[order], return_index=True, return_counts=True)
            rank = np.empty(len(lengths), np.int64)
            rank[order] = np.arange(len(lengths)) + np.repeat(seen[some] - first, counts)
            seen[some] += counts
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, np.full(len(rank), part), rank], PIECES, strict=True)], schema=PIECES)
        give_back()

    return text_rows(docs).mapInArrow(run, f"{PIECE_COLUMNS}, part int, rank long")


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, path, size, end))
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    # a length has one row for each partition here
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    sent = docs.sparkSession.sparkContext.broadcast(plan)
    schema = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = sent.value.places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, where)], schema=schema)

    ranked = rows.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(run, f"{PIECE_COLUMNS}, sequence_id long, offset long")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
