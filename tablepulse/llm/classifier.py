"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Word parts are hashed into WORDS rows. Each has a sparse ternary index vector (NONZERO entries of +1 or -1 out of SIZE, fixed by
its number); its context vector is the sum of the index vectors of the parts within REACH places of it, over all documents.
A part's vector is both, each of length one, added up. A document is the mean over its parts, with four more
numbers: how many parts (log), how many differ, the mean's length and the share of the most frequent one.

Context vectors are counted over all rows: a row for each word row and task, summed before and after the shuffle; the driver
gets WORDS rows. The network is fitted in numpy on labelled rows, TRAIN_LIMIT at most (the first by hash of doc_id); CALIBRATION
of them set the temperature that its logits are divided by. n fitting rows are gone over EPOCHS * sqrt(FULL / n) times,
FULL being those of TRAIN_LIMIT labels: less often the more there are, without a jump at any size. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import in_chunks, map_texts, table, text_rows
from tablepulse.llm.tokens import shared_words

WORDS, SIZE, NONZERO, REACH = 8192, 48, 4, 2
TRAIN_LIMIT, CALIBRATION, HIDDEN, EPOCHS, BATCH, RATE, DECAY, THRESHOLD = 20_000, 0.2, 32, 30, 64, 3e-3, 1e-4, 0.3
FULL = int(TRAIN_LIMIT * (1 - CALIBRATION))
EXTRA = 4


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs): of each word row's nonzero entries; places of a row differ."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((WORDS, SIZE)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1.0, 1.0], (WORDS, NONZERO))


def read_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word rows of all parts, number of parts of each text)."""
    words = shared_words()
    parts, counts = words.part_hashes(*words.read(texts))
    return (parts & np.uint32(WORDS - 1)).astype(np.int64), counts


def context_sums(rows: np.ndarray, counts: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """WORDS x SIZE: for each word row, the sum of the index vectors around it, within its text."""
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(WORDS * SIZE)
    for far in range(1, REACH + 1):
        near = np.flatnonzero(text[far:] == text[:-far])
        for a, b in ((rows[near], rows[near + far]), (rows[near + far], rows[near])):
            for s in range(NONZERO):
                total += np.bincount(a * SIZE + places[b, s], weights=signs[b, s], minlength=WORDS * SIZE)
    return total.reshape(WORDS, SIZE)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all rows of docs, WORDS x SIZE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros((WORDS, SIZE))
        for _, texts in in_chunks(batches):
            total += context_sums(*read_rows(texts), places, signs)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(total[used, i]) for i in range(SIZE))], names=["row", *(f"v{i}" for i in range(SIZE))])

    columns = [f"v{i}" for i in range(SIZE)]
    summed = text_rows(docs).mapInArrow(run, "row int, " + ", ".join(f"{c} double" for c in columns)).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns))
    out = np.zeros((WORDS, SIZE))
    for r in summed.collect():  # WORDS rows at most, of whole numbers: their sum doesn't depend on order
        out[r.row] = r[1:]
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    places, signs = index_vectors()
    own = np.zeros((WORDS, SIZE))
    np.put_along_axis(own, places, signs, axis=1)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return (unit(own) + unit(contexts)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of SIZE + EXTRA numbers for each text; zeros for one without parts."""
    rows, counts = read_rows(texts)
    out = np.zeros((len(texts), SIZE + EXTRA), np.float32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begins = (np.cumsum(counts) - counts)[full]
    mean = np.add.reduceat(vectors[rows], begins, axis=0) / counts[full, None]
    key, often = np.unique(np.repeat(np.arange(len(counts)), counts) * WORDS + rows, return_counts=True)
    of = key // WORDS
    first = np.searchsorted(of, full)
    out[full, :SIZE] = mean
    out[full, SIZE] = np.log1p(counts[full])
    out[full, SIZE + 1] = np.bincount(of, minlength=len(counts))[full] / counts[full]
    out[full, SIZE + 2] = np.linalg.norm(mean, axis=1)
    out[full, SIZE + 3] = np.maximum.reduceat(often, first) / counts[full]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def epochs(n: int) -> int:
    """How often n fitting rows are gone over."""
    return round(EPOCHS * np.sqrt(FULL / n))


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.spread) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x.astype(np.float64)) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Fitted by Adam on all but the last CALIBRATION of the rows; without rows, every probability is one half."""
    x, rng = x.astype(np.float64), np.random.default_rng(seed)
    width = SIZE + EXTRA
    if not len(x):
        return Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    held = int(len(x) * CALIBRATION)
    fit_x, fit_y = x[: len(x) - held], y[: len(x) - held]
    mean, spread = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6
    z = (fit_x - mean) / spread
    rate = np.clip(fit_y.mean(), 0.01, 0.99)
    params = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array(np.log(rate / (1 - rate)))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs(len(z))):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            slope = (_sigmoid(hidden @ params[2] + params[3]) - fit_y[rows]) / len(rows)
            back = np.outer(slope, params[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ slope + DECAY * params[2], np.array(slope.sum())]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    out = Network(mean, spread, params[0], params[1], params[2], float(params[3]))
    if held:
        out.temperature = calibrate(out.logits(x[len(x) - held :]), y[len(x) - held :])
    return out


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature, 0.25 to 8, of least log loss."""
    choices = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    loss = [np.mean(np.logaddexp(0, -logits / t * (2 * y - 1))) for t in choices]
    return float(choices[int(np.argmin(loss))])


def held_out() -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.network.probabilities(pooled(texts, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT) -> Model:
    """labels: doc_id, quality (1 good, 0 bad; others and nulls don't count). Of repeated labels the larger counts; of several
    texts of one labelled doc_id the one whose pooled row is largest, so that the model doesn't depend on the rows' order."""
    vectors = word_vectors(context_vectors(docs))
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(keys: list, texts: list[bytes]) -> dict[str, list]:
        return {"doc_id": keys, "x": list(pooled(texts, sent.value))}

    # limit rows of two numbers are broadcast, and limit pooled rows come back
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    found = {r.doc_id: np.array(r.x, np.float32) for r in map_texts(chosen, run, "doc_id long, x array<float>").groupBy("doc_id").agg(F.max("x").alias("x")).collect()}
    rows = [(found[r.doc_id], r.quality) for r in some.collect() if r.doc_id in found]
    x = np.array([r[0] for r in rows], np.float32).reshape(len(rows), SIZE + EXTRA)
    return Model(vectors, train(x, np.array([r[1] for r in rows], np.float64)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. A null or empty text is scored as one without parts.

    Repeated rows get one score; a null doc_id stays a row (not held out)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(keys: list, texts: list[bytes]) -> dict[str, list]:
        found = sent.value.scores(texts)
        return {"doc_id": keys, "score": found, "predicted": (found >= threshold).astype(np.int32)}

    return map_texts(docs, run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
