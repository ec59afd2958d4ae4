"""Quality rules: countable faults of a text, and a log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring word parts are hashed into BUCKETS. Two multinomials are counted over all rows: one of
trusted documents (the target), one of the raw corpus. The score of a text is the mean over its n-grams of the log ratio
of the two probabilities, so it doesn't grow with length; a text is kept if no countable fault stands against it and its
score is THRESHOLD or more. Each bucket's counts are smoothed by PRIOR target n-grams, so rare n-grams say nothing.

What travels: a row for each bucket and task, summed before and after the shuffle; the driver gets BUCKETS rows. Trusted ids
are broadcast up to BROADCAST_LIMIT. Of more ids a bit map is, so that the texts that meet the ids in a shuffle are the trusted
ones and the few others that the map lets through; the raw corpus is counted where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import filter_texts, give_back, in_chunks, map_texts, table, text_rows
from tablepulse.llm.tokens import Words, shared_words, sums

BUCKETS, PRIOR, THRESHOLD = 1 << 16, 20.0, -0.05
#: Trusted ids (16 to 24 bytes each) that are broadcast at most; of more, a bit map of up to FILTER_BITS bits is.
BROADCAST_LIMIT, FILTER_BITS = 1_000_000, 1 << 28
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEAT_PERCENT = 10, 5, 20


def buckets(parts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the single parts, and of each part with its successor in the same text (-1 at a text's end)."""
    single = (parts & np.uint32(BUCKETS - 1)).astype(np.int64)
    pair = np.full(len(parts), -1, np.int64)
    if len(parts) > 1:
        wide = parts.astype(np.uint64)
        mixed = (wide[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        pair[:-1] = (mixed >> np.uint64(48)).astype(np.int64)
        ends = np.cumsum(counts)
        pair[ends[(counts > 0)] - 1] = -1
    return single, pair


def repeated_words(numbers: np.ndarray, counts: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """For each text, its words that stand in windows found twice or more in that text."""
    n = len(numbers)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    if n < window:
        return np.zeros(len(counts), np.int64)
    inside = text[: n - window + 1] == text[window - 1 :]
    at = np.flatnonzero(inside)
    key = text[at].astype(np.uint64)
    for i in range(window):
        key = (key ^ numbers[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    left, right = at[order[same]], at[order[same + 1]]
    equal = text[left] == text[right]
    for i in range(window):
        equal &= numbers[left + i] == numbers[right + i]
    marks = np.zeros(n + 1, np.int64)
    if not equal.all():  # two windows with one hash: compare the windows themselves
        seen: dict[tuple, int] = {}
        repeated = []
        for p in np.unique(np.concatenate([left, right])).tolist():
            k = (int(text[p]), *numbers[p : p + window].tolist())
            if k in seen:
                repeated += [p, seen[k]]
            seen[k] = p
        starts = np.unique(np.array(repeated, np.int64))
    else:
        starts = np.unique(np.concatenate([left, right]))
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return sums((np.cumsum(marks[:-1]) > 0).astype(np.int64), np.diff(np.concatenate([[0], ends])))


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows of docs, and of those that are trusted, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = shared_words(), np.zeros((2, BUCKETS), np.int64)
        for trusted, texts in in_chunks(batches):
            parts, counts = _parts(words, texts)
            single, pair = buckets(parts, counts)
            in_target = np.repeat(np.array(trusted, dtype=bool), counts)
            for which, mask in ((0, slice(None)), (1, in_target)):
                total[which] += np.bincount(single[mask], minlength=BUCKETS) + np.bincount(pair[mask][pair[mask] >= 0], minlength=BUCKETS)
        found = np.flatnonzero(total[0])
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(t[found], pa.int64()) for t in total)], names=["bucket", "raw", "target"])

    rows = text_rows(docs.select(F.col("trusted").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _parts(words: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    numbers, counts = words.read(texts)
    return words.part_hashes(numbers, counts)


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """By bucket, the log of how much likelier the target is to use it; all zero without a target."""
    share = target.sum() / max(1, raw.sum())
    return np.log((target + prior) / (raw * share + prior))


def probable(ids: DataFrame, n: int) -> Callable[[DataFrame], DataFrame]:
    """A filter that keeps the rows whose doc_id is among the n ids, and few others: three bits of a map for each id."""
    size = min(FILTER_BITS, max(1 << 10, 1 << (12 * n).bit_length()))
    bits = F.array(*(F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(size)) for k in range(3)))
    one = F.expr("shiftleft(1, int(bit % 32))")
    words = ids.select(F.explode(bits).alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.bit_or(one).alias("ones"))
    found, held = words.toArrow(), np.zeros(size // 32, np.int32)  # size / 32 rows at most
    held[found["word"].to_numpy()] = found["ones"].to_numpy()
    sent = ids.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf("boolean")
    def among(places: pa.Array) -> pa.Array:
        p = places.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        return pa.array((sent.value[p >> 5] >> (p & 31).astype(np.int32) & 1).all(axis=1))

    return lambda docs: docs.where("doc_id is not null").where(among(bits))


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratios by bucket. trusted: doc_ids of the target; further columns and repeated ids don't matter."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    docs, n, total = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids.count(), np.zeros((2, BUCKETS))
    if n <= BROADCAST_LIMIT:
        marked = docs.join(F.broadcast(ids.withColumn("trusted", F.lit(True))), "doc_id", "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
        counted = [(marked, (0, 1))]
    else:
        target = probable(ids, n)(docs).join(ids, "doc_id", "left_semi")
        counted = [(docs.select(F.lit(False).alias("trusted"), "text"), (0,)), (target.select(F.lit(True).alias("trusted"), "text"), (1,))]
    for rows, which in counted:
        for r in ngram_counts(rows).collect():  # BUCKETS rows at most
            for k in which:
                total[k, r.bucket] = r[1 + k]
    return log_ratios(*total)


def judge(texts: list[bytes], ratio: np.ndarray, threshold: float = THRESHOLD) -> dict[str, np.ndarray | list]:
    """The facts, score and verdict of each text."""
    words = shared_words()
    numbers, counts = words.read(texts)
    parts, part_counts = words.part_hashes(numbers, counts)
    single, pair = buckets(parts, part_counts)
    gained = ratio[single] + np.where(pair >= 0, ratio[pair], 0.0)
    grams = np.maximum(2 * part_counts - 1, 1)
    score = np.add.reduceat(np.append(gained, 0.0), np.cumsum(part_counts) - part_counts) * (part_counts > 0) / grams
    repeat = repeated_words(numbers, counts)
    failed = (counts < LEAST_WORDS) | (100 * repeat > MOST_REPEAT_PERCENT * counts)
    return {
        "n_words": counts,
        "word_chars": sums(words.chars.data[numbers].astype(np.int64), counts),
        "n_symbols": sums(words.symbols.data[numbers].astype(np.int64), counts),
        "n_dup_lines": list(map(duplicate_lines, texts)),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "score": score,
        "kept": ~failed & (score >= threshold),
    }


def apply(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Text null or without words: all counts 0, base_failed, not kept, score 0. A null doc_id stays a row; repeated rows
    are judged alike."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))

    def run(keys: list, texts: list[bytes]) -> dict[str, list]:
        return {"doc_id": keys, **judge(texts, sent.value, threshold)}

    return map_texts(docs, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def reject(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that aren't kept; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))
    return filter_texts(docs, lambda texts: judge(texts, sent.value, threshold)["kept"].tolist())


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, trusted_ids(table(spark, sf_dir, "labels"))))
