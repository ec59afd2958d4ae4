"""Phrase collocation mining: phrases of up to five words that stand together more often than their parts would, by ERA-style vertical
partitioning of a depth-truncated suffix tree.

Every word of a piece begins a suffix of at most LONGEST words. Suffixes are told apart by language first, so a language is the
root's child and its count is that language's number of words.

1. Prefix table. Tasks count hashes of prefixes: of one and two words first, then of 3 to LONGEST words where all pairs of neighbours
   are frequent enough, since no other can be. A task sorts HELD hashes at a time and sends the distinct ones with their counts, by parts of
   their range; a part's counts are added up in one place, 32 bits of hash apart. Only what is found MIN_COUNT times in all sets its
   two bits in the table, which is broadcast. So the table fills with frequent phrases, not with the corpus. It only ever lets too much
   through, never too little. A prefix that it doesn't have ends its suffix.
2. Leaves. Every task cuts its suffixes at the table and counts equal ones; they are written with their counts. A task adds up all of its
   text, and sends earlier only if it has met too many different ones; splits are joined to TASKS_PER_CORE tasks for each core. So a leaf
   is sent once by each running task that has met it, and not again for each split or each WAITING words.
3. Vertical partitioning. Leaves are counted by a hash of their prefix. Prefixes of one word that have more than BUDGET leaves are
   extended to two words, and so on; the others are packed into groups of at most BUDGET leaves. The number of counters is fixed.
4. Subtrees. A group's leaves are dealt to one task and sorted there; one walk over them adds up the totals of all nodes. Only the
   path to the present leaf is held. Nodes above a group's prefix are added up over groups.
5. Scores. A phrase is joined with its two parts at each cut. The same rows tell which phrases lie in a longer one of the same count:
   if such a longer one exists, one with just one more word does. The best TOP of a language are chosen within parts of it first.

Arithmetic is in 38-digit decimals; a score is a long. Text null or empty, or without a word: nothing. lang null: "und". Repeated rows
count each time. A very long text is cut into suffixes like any other. No rows: none. Ties are ordered by phrase, so there are none.
Memory of a task: the prefix table, a chunk's words, HELD hashes or WAITING suffixes, LEAF_WORDS words. Where cores join later (dynamic allocation),
spark.default.parallelism tells for how many the tasks are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tablepulse.llm.common import cut, give_back, in_chunks, table, text_rows

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: Bits of the prefix table (a power of two), and parts of it (another) that are counted apart, each a row.
SLOT_BITS, PART_BITS = 27, 10
#: Hashes of prefixes that a task holds before it counts equal ones.
HELD = 1 << 23
#: Leaves that one group may have, and counters for each depth of prefix.
BUDGET, PREFIXES = 20_000, 1 << 14
#: Suffixes that a task holds before it counts equal ones, and words that it may know; it sends them if more than half are left then.
WAITING, LEAF_WORDS = 3_000_000, 800_000
#: Bits of a word's number in a key of three words; where there are more words, suffixes are rows.
NUMBER_BITS = 21
#: Tasks that read the texts, for each core; a task more sends its own count of each leaf.
TASKS_PER_CORE = 2
#: Languages up to which their totals are broadcast.
LANGS = 10_000
#: Parts of a language within which its best phrases are chosen first.
SPREAD = 64
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Ends a piece: a byte that UTF-8 doesn't have. Upper case goes, what ends a piece becomes it.
BREAK = b"\xff"
PLAIN = bytes(BREAK[0] if b in b".,;:!?\n\x0b\x0c\r" else b for b in bytes(range(256)).lower())
#: Which bytes are a word's, what keeps the first 0 to 8 bytes of a number, and the length of words from which they are hashed one by one.
IN_WORD = np.array([b not in b" \t" + BREAK for b in range(256)])
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 64


def extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of what came so far, and of what comes next, made one."""
    total = (hashes ^ words) * MIX
    total ^= total >> np.uint64(29)
    return total


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash, not 0, of each word of raw, which goes on for 8 bytes after the last."""
    size = ends - starts
    out, wide = extended(size.astype(np.uint64), np.uint64(len(BREAK))), np.ndarray(max(0, len(raw) - 7), "<u8", raw, strides=(1,))
    some = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        some = some[size[some] > k]
        if not len(some):
            break
        out[some] = extended(out[some], wide[starts[some] + k] & FIRST[np.minimum(size[some] - k, 8)])
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxh64_intdigest(raw[starts[i] : ends[i]])
    out ^= out >> np.uint64(32)
    return extended(out, np.uint64(0)) | np.uint64(1)


def hashed(texts: list[bytes]) -> np.ndarray:
    """Hashes of all words in order, as Vocabulary has them; 0 ends a piece."""
    raw = BREAK + BREAK.join(texts).translate(PLAIN) + 8 * BREAK
    letters = np.frombuffer(raw, np.uint8)
    inside = IN_WORD[letters]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(letters == BREAK[0]), starts)
    place = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)
    out = np.zeros(len(starts) and place[-1] + 1, np.uint64)
    out[place] = word_hashes(raw, starts, ends)
    return out


class Vocabulary(dict):
    """Word to number, in order of appearance; 0 ends a piece. Hashes by number."""

    def __init__(self) -> None:
        self[BREAK] = 0
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def read(self, texts: list[bytes]) -> np.ndarray:
        """Numbers of all words in order, pieces apart."""
        words = (b" \xff ".join(texts)).translate(PLAIN).replace(BREAK, b" \xff ").split()
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if len(self) > len(self.hashes):
            fresh = list(islice(reversed(self), len(self) - len(self.hashes)))[::-1]
            ends = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))
            starts = np.concatenate([[0], ends[:-1]])
            self.hashes = np.concatenate([self.hashes, word_hashes(b"".join(fresh) + 8 * BREAK, starts, ends)])
        return out

    def part(self, numbers: np.ndarray) -> Vocabulary:
        """The words of these numbers (ascending, 0 first), numbered anew in this order."""
        words, out = list(self), Vocabulary()
        for n in numbers[1:]:
            out[words[n]]
        out.hashes = self.hashes[numbers]
        return out


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts (column 1, null: empty) of each language (column 0) of a batch, a chunk at a time."""
    langs = pc.fill_null(batch.column(0).cast(pa.string()), "und")
    for lang in pc.unique(langs).to_pylist():
        mine = batch.filter(pc.equal(langs, lang))
        for _, texts in in_chunks([mine]):
            yield lang, texts


def prefix_hashes(words: np.ndarray, lang: str, longest: int = LONGEST, going: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... longest words: the places where so many stand in one piece, and a hash of them and the language.

    words: their hashes, 0 ends a piece. going: tells of hashes which prefixes go on."""
    at = np.flatnonzero(words)
    words = np.concatenate([words, np.zeros(longest, np.uint64)])
    total = np.full(len(at), np.uint64(xxh64_intdigest(lang)))
    for depth in range(longest):
        word = words[at + depth]
        if depth:
            inside = word != 0
            at, total, word = at[inside], total[inside], word[inside]
        total = extended(total, word)
        if going:
            passed = going(total)
            at, total = at[passed], total[passed]
        yield at, total


def longer_hashes(words: np.ndarray, lang: str, pairs: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Hashes of the prefixes of 3 to LONGEST words in which all pairs of neighbours are let through."""
    *_, (at, total) = prefix_hashes(words, lang, 2)
    passed = let_through(total, pairs, bits)
    at, total = at[passed], total[passed]
    pair = np.zeros(len(words) + LONGEST, bool)
    pair[at] = True
    for depth in range(2, LONGEST):
        inside = pair[at + depth - 1]
        at, total = at[inside], total[inside]
        total = extended(total, words[at + depth])
        yield total


def part_bits(bits: int) -> int:
    """A part has a byte of the table at least."""
    return max(0, min(PART_BITS, bits - 3))


def let_through(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have both of their bits in the table: the first and the last bits of the 32 that tell hashes of a part apart."""
    part = part_bits(bits)

    def are_set(slot: np.ndarray) -> np.ndarray:
        return (table[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8) & 1).astype(bool)

    out = are_set(hashes >> np.uint64(64 - bits))
    some = hashes[out]
    last = some >> np.uint64(32 - part) & np.uint64((1 << (bits - part)) - 1)
    out[out] = are_set(some >> np.uint64(64 - part) << np.uint64(bits - part) | last)
    return out


def sent_hashes(held: np.ndarray, part: int, most: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Distinct hashes (32 bits of them) of each part and how often each, clipped at most; held changes."""
    held.sort()
    held >>= np.uint64(32 - part)
    ends = np.searchsorted(held, np.arange((1 << part) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    for first in range(0, 1 << part, 64):
        some, packed = [], []
        for p in range(first, min(first + 64, 1 << part)):
            if ends[p] < ends[p + 1]:
                low = held[ends[p] : ends[p + 1]].astype(np.uint32)
                at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                n = np.minimum(np.diff(np.append(at, len(low))), most)
                some.append(p)
                packed.append(low[at].tobytes() + n.astype(kind).tobytes())
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])


def frequent_hashes(docs: DataFrame, min_count: int, bits: int, pairs: Broadcast | None = None) -> np.ndarray:
    """The prefix table for prefixes of one and two words; with pairs, such a table, for those of more words."""
    kind, part = np.dtype(np.uint8 if min_count < 256 else np.uint32), part_bits(bits)
    width = bits - part

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(HELD, np.uint64), 0
        for batch in batches:
            for lang, texts in by_language(batch):
                words = hashed(texts)
                all_found = (found for _, found in prefix_hashes(words, lang, 2)) if pairs is None else longer_hashes(words, lang, pairs.value, bits)
                for found in all_found:
                    while len(found):
                        some, found = found[: HELD - n], found[HELD - n :]
                        held[n : n + len(some)] = some
                        n += len(some)
                        if n == HELD:
                            yield from sent_hashes(held, part, min_count, kind)
                            n = 0
        yield from sent_hashes(held[:n], part, min_count, kind)
        del held
        give_back()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part stand together."""
        now, held = None, []

        def done() -> pa.RecordBatch:
            both = np.concatenate(held)
            both.sort()
            low = (both >> np.uint64(32)).astype(np.uint32)
            at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            low = low[at][np.add.reduceat(both & np.uint64((1 << 32) - 1), at) >= min_count]
            slots = np.zeros(1 << width, bool)
            slots[low >> np.uint32(32 - width)] = True
            slots[low & np.uint32((1 << width) - 1)] = True
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(slots).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for p, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != now:
                    if now is not None:
                        yield done()
                    now, held = p, []
                n = len(packed) // (4 + kind.itemsize)
                held.append(np.frombuffer(packed, np.uint32, n).astype(np.uint64) << np.uint64(32) | np.frombuffer(packed, kind, n, 4 * n))
        if now is not None:
            yield done()

    counted = lang_texts(docs).mapInArrow(count, "part int, counts binary")
    rows = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary")
    out = np.zeros((1 << part, (1 << width) // 8), np.uint8)
    for r in rows.collect():  # at most one for each part
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def frequent_slots(docs: DataFrame, min_count: int, bits: int = SLOT_BITS) -> np.ndarray:
    """The prefix table: the bits of all prefixes that are found min_count times or more."""
    pairs = frequent_hashes(docs, min_count, bits)
    sent = docs.sparkSession.sparkContext.broadcast(pairs)
    longer = frequent_hashes(docs, min_count, bits, sent)
    sent.unpersist()
    return pairs | longer


def lang_texts(docs: DataFrame) -> DataFrame:
    """lang and the text's bytes, sent to Python in small batches, by TASKS_PER_CORE tasks for each core at most."""
    text_rows(docs.limit(0))  # sets the batch size
    few = docs.coalesce(TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    return few.select("lang", F.col("text").cast("binary").alias("text"))


def equal_rows(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of numbers from 0, how often each or the sum of its weights)."""
    weights = np.ones(len(rows), np.int64) if weights is None else weights
    if not len(rows):
        return rows, weights
    bits = max(1, int(rows.max()).bit_length())
    keys = []
    for at in range(0, rows.shape[1], 63 // bits):  # so many columns are one key
        key = np.zeros(len(rows), np.int64)
        for column in rows.T[at : at + 63 // bits]:
            key = key << bits | column
        keys.append(key)
    order = np.lexsort(keys[::-1])
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(weights[order], first)


LEAF = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.int64())])


class Suffixes:
    """The suffixes of one language that a task has met: those of one word or none by its number, of two or three words as a key, longer ones as rows."""

    def __init__(self) -> None:
        self.ones, self.keys, self.n = (np.zeros(size, np.int64) for size in (1, 0, 0))  # keys are distinct and ascend
        self.fresh, self.rows, self.rows_n = [], [np.zeros((0, LONGEST), np.int32)], [np.zeros(0, np.int64)]

    def add(self, words: np.ndarray, known: Vocabulary, lang: str, frequent: np.ndarray, bits: int) -> int:
        """Each word's suffix, cut where a prefix is too rare. Gives the number of keys and rows that are held for them."""
        length = np.zeros(len(words), np.int8)
        for depth, (at, _) in enumerate(prefix_hashes(known.hashes[words], lang, going=lambda hashes: let_through(hashes, frequent, bits)), 1):
            length[at] = depth
        one = np.bincount(words[length == 1], minlength=len(self.ones))
        one[: len(self.ones)] += self.ones
        self.ones = one
        self.ones[0] += np.count_nonzero(words) - np.count_nonzero(length)
        keyed = 3 if len(known) <= 1 << NUMBER_BITS else 1
        words = np.concatenate([words, np.zeros(LONGEST, words.dtype)])
        at = np.flatnonzero((length > 1) & (length <= keyed))
        self.fresh.append((words[at].astype(np.int64) << NUMBER_BITS | words[at + 1]) << NUMBER_BITS | np.where(length[at] > 2, words[at + 2], 0))
        longer = np.flatnonzero(length > keyed)
        self.rows.append(np.where(np.arange(LONGEST) < length[longer, None], words[longer[:, None] + np.arange(LONGEST)], 0).astype(np.int32))
        self.rows_n.append(np.ones(len(longer), np.int64))
        return len(at) + len(longer)

    def count(self) -> int:
        """Only distinct suffixes are held on. Gives the number of keys and rows."""
        fresh = np.concatenate([self.keys[:0], *self.fresh])
        self.fresh = []
        fresh.sort()
        at = np.flatnonzero(np.concatenate([[True], fresh[1:] != fresh[:-1]])[: len(fresh)])
        keys, n = np.concatenate([self.keys, fresh[at]]), np.concatenate([self.n, np.diff(at, append=len(fresh))])
        del fresh
        order = np.argsort(keys, kind="stable")  # merges two sorted runs
        keys, n = keys[order], n[order]
        del order
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.keys, self.n = keys[at], np.add.reduceat(n, at) if len(at) else n
        rows, n = equal_rows(np.concatenate(self.rows), np.concatenate(self.rows_n))
        self.rows, self.rows_n = [rows], [n]
        return len(self.keys) + len(rows)

    def key_rows(self, part: slice = slice(None)) -> np.ndarray:
        """The words of the counted keys."""
        out, mask = np.zeros((len(self.keys[part]), LONGEST), np.int32), (1 << NUMBER_BITS) - 1
        for k in range(3):
            out[:, k] = self.keys[part] >> NUMBER_BITS * (2 - k) & mask
        return out

    def mark(self, used: np.ndarray) -> None:
        """Marks the words of counted suffixes."""
        used[np.flatnonzero(self.ones)] = True
        for k in range(3):
            used[self.keys >> NUMBER_BITS * k & ((1 << NUMBER_BITS) - 1)] = True
        used[self.rows[0]] = True

    def renumber(self, anew: np.ndarray, size: int) -> None:
        """Words get other numbers of the same order."""
        ones, some = np.zeros(size, np.int64), np.flatnonzero(self.ones)
        ones[anew[some]] = self.ones[some]
        keys, mask = np.zeros_like(self.keys), (1 << NUMBER_BITS) - 1
        for k in (2, 1, 0):
            keys = keys << NUMBER_BITS | anew[self.keys >> NUMBER_BITS * k & mask]
        self.ones, self.keys, self.rows = ones, keys, [anew[self.rows[0]]]

    def counted(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All distinct suffixes, size at a time, and how often each."""
        self.count()
        some = np.flatnonzero(self.ones)
        for at in range(0, len(some), size):
            rows = np.zeros((len(some[at : at + size]), LONGEST), np.int32)
            rows[:, 0] = some[at : at + size]
            yield rows, self.ones[some[at : at + size]]
        for at in range(0, len(self.keys), size):
            yield self.key_rows(slice(at, at + size)), self.n[at : at + size]
        for at in range(0, len(self.rows[0]), size):
            yield self.rows[0][at : at + size], self.rows_n[0][at : at + size]


def count_all(found: dict[str, Suffixes], known: Vocabulary) -> tuple[Vocabulary, int]:
    """Counts equal suffixes and numbers anew the words that are in one. Gives these words and the number of keys and rows that are held."""
    used = np.zeros(len(known), bool)
    used[0] = True
    held = 0
    for suffixes in found.values():
        held += suffixes.count()
        suffixes.mark(used)
    anew, numbers = (np.cumsum(used) - 1).astype(np.int32), np.flatnonzero(used)
    for suffixes in found.values():
        suffixes.renumber(anew, len(numbers))
    give_back()
    return known.part(numbers), held


def leaves(docs: DataFrame, table_bits: Broadcast, bits: int = SLOT_BITS) -> DataFrame:
    """lang, words (0 to LONGEST, as far as the prefix table lets through) and n: how many suffixes of a task are so."""

    def batches_of(found: dict[str, Suffixes], known: Vocabulary) -> Iterator[pa.RecordBatch]:
        names = np.array(["", *(w.decode() for w in list(known)[1:])], object)
        for lang, suffixes in found.items():
            for rows, n in suffixes.counted(50_000):
                ends = np.concatenate([[0], np.cumsum((rows > 0).sum(axis=1))])
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names[rows[rows > 0]], pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), words, pa.array(n, pa.int64())], schema=LEAF)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, held = Vocabulary(), {}, 0
        for batch in batches:
            for lang, texts in by_language(batch):
                if held > WAITING or len(known) > LEAF_WORDS:
                    known, held = count_all(found, known)
                    if held > WAITING // 2 or len(known) > LEAF_WORDS // 2:
                        yield from batches_of(found, known)
                        known, found, held = Vocabulary(), {}, 0
                held += found.setdefault(lang, Suffixes()).add(known.read(texts), known, lang, table_bits.value, bits)
        yield from batches_of(found, known)
        give_back()

    return lang_texts(docs).mapInArrow(run, "lang string, words array<string>, n long")


def grouped(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Leaves with depth, the length of the prefixes that they are grouped by, and group."""
    slot = [F.pmod(F.xxhash64("lang", F.slice("words", 1, d)), F.lit(PREFIXES)).cast("int") for d in range(1, LONGEST + 1)]
    depth, packed, group, held = F.lit(1), [], 0, 0
    for d in range(1, LONGEST + 1):
        heavy = []
        here = rows.where(depth == d).groupBy(slot[d - 1].alias("slot")).count().collect()
        for r in sorted(here):
            if r["count"] > budget and d < LONGEST:
                heavy.append(r.slot)
                continue
            if held and held + r["count"] > budget:
                group, held = group + 1, 0
            held += r["count"]
            packed.append((d, r.slot, group))
        if not heavy:
            break
        depth = F.when((depth == d) & slot[d - 1].isin(heavy), d + 1).otherwise(depth)
    # at most PREFIXES rows for each depth
    groups = F.broadcast(rows.sparkSession.createDataFrame(packed, "depth int, slot int, group int"))
    return rows.withColumn("depth", depth).withColumn("slot", F.element_at(F.array(*slot), F.col("depth"))).join(groups, ["depth", "slot"]).drop("slot")


def subtrees(dealt: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, words and n of the nodes of all groups' trees: whole totals of min_count or more, and parts of those above a group's prefix."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []  # words of the present leaf
        totals = [0]  # of the nodes on the path, so far; the root's first
        place, out = (None, None, 0), []  # group, language, depth

        def close(upto: int) -> None:
            while len(totals) > upto + 1:
                n, size = totals.pop(), len(path)
                totals[-1] += n
                if size < place[2] or n >= min_count:
                    out.append((place[1], list(path), n))
                path.pop()

        def end() -> None:
            close(0)
            if totals[0]:
                out.append((place[1], [], totals[0]))
            totals[0] = 0

        def sent() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LEAF, strict=True)], schema=LEAF)

        for batch in batches:
            for group, lang, words, depth, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, lang) != place[:2]:
                    end()
                    place = (group, lang, depth)
                same = 0
                while same < len(path) and same < len(words) and path[same] == words[same]:
                    same += 1
                close(same)
                for word in words[same:]:
                    path.append(word)
                    totals.append(0)
                totals[-1] += n
                place = (group, lang, max(place[2], depth))
            yield sent()
        end()
        yield sent()

    leaf = dealt.repartition("group").groupBy("group", "lang", "words", "depth").agg(F.sum("n").alias("n"))
    return leaf.sortWithinPartitions("group", "lang", "words").mapInArrow(walk, "lang string, words array<string>, n long")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, budget: int = BUDGET, bits: int = SLOT_BITS) -> DataFrame:
    """lang, words and n of all phrases of up to LONGEST words with n of min_count or more; words empty: all words of the language."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_slots(docs, min_count, bits))
    nodes = subtrees(grouped(cut(leaves(docs, sent, bits)), budget), min_count)
    return cut(nodes.groupBy("lang", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | (F.size("words") == 0)))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, budget: int = BUDGET, bits: int = SLOT_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    counts = frequent_phrases(docs, min_count, budget, bits)
    totals = counts.where(F.size("words") == 0).select("lang", F.col("n").alias("total"))
    parts = counts.where(F.size("words") > 0)
    cuts = counts.where(F.size("words") > 1).select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.lit(LONGEST))})
    both = cuts.join(parts.select("lang", F.col("words").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("words").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    both = cut(both)
    inside = both.where((F.col("k") == F.size("words") - 1) & (F.col("l") <= F.col("a"))).select("lang", F.col("left").alias("words"))
    inside = inside.union(both.where((F.col("k") == 1) & (F.col("r") <= F.col("a"))).select("lang", F.col("right").alias("words"))).where(F.size("words") > 1).distinct()
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "total", "l", "r")}
    # a row for each language; many languages are joined like any other keys
    totals = F.broadcast(totals) if totals.count() <= LANGS else totals
    scored = both.join(totals, "lang").withColumn("over", F.lit(1000).cast("decimal(4,0)") * (whole["a"] * whole["total"])).withColumn("under", whole["l"] * whole["r"])
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut")
    found = scored.groupBy("lang", "words", "a", F.col("total").alias("n")).agg(lowest).join(inside, ["lang", "words"], "left_anti")
    found = found.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    some = found.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
    WITH pieces AS (
      SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    counts AS MATERIALIZED (
      SELECT lang, phrase, count(*) AS n FROM (
        SELECT lang, array_to_string(w[i : i + d - 1], ' ') AS phrase
        FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), range(1, {LONGEST + 1}) t(d) WHERE i + d - 1 <= len(w))
      GROUP BY lang, phrase HAVING count(*) >= {MIN_COUNT}),
    split AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts),
    cuts AS MATERIALIZED (
      SELECT c.lang, c.phrase, a, k, x.n AS l, y.n AS r
      FROM (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM split WHERE len(w) > 1) c
      JOIN counts x ON x.lang = c.lang JOIN counts y ON y.lang = c.lang
      WHERE x.phrase = array_to_string(c.w[1 : c.k], ' ') AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
    scored AS (
      SELECT lang, phrase, a, min((1000::HUGEINT * a * n // (l::HUGEINT * r), k, l, r)) AS c, any_value(n) AS n
      FROM (SELECT cuts.*, totals.n FROM cuts JOIN totals USING (lang)) GROUP BY lang, phrase, a),
    covered AS (
      SELECT DISTINCT lang, array_to_string(w[i : j], ' ') AS phrase, a
      FROM (SELECT lang, w, a, unnest(range(1, len(w) + 1)) AS i FROM split), range(1, {LONGEST + 1}) t(j)
      WHERE j > i AND j <= len(w) AND j - i + 1 < len(w))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY c[1] DESC, a DESC, phrase) AS rank, phrase, a,
             c[3] AS l, c[4] AS r, n, c[1]::BIGINT AS score
      FROM scored s WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = s.lang AND v.phrase = s.phrase AND 100 * v.a >= 100 * s.a))
    WHERE rank <= {TOP}"""
