"""Vector code compression: product codes in whole numbers, the nearest codebook entry found by Orchard's search.

A component x is floor(4096 x); a vector is cut into PARTS equal parts; each part position has ENTRIES entries, at first that part
of the smallest vec_ids' vectors. ROUNDS times every part goes to its nearest entry (squared Euclidean distance, ties to the lower
index) and each entry becomes its parts' floor(sum / count); then parts are assigned once more. All of it is exact.

Orchard's search keeps, for each entry, the others sorted by their distance from it. From a current entry at distance d it walks
that entry's list; a better entry becomes the current one and its list is walked from the start; entries met before are marked and
passed over; beyond twice d no entry of the list can be better, nor as good, and the search ends. A batch's parts are searched side
by side, and squares are compared (four times d squared), so nothing is rounded.

A round is one narrow pass. Each task sends its sums per entry as limbs of LIMB bits (a few rows for each component, whatever the
number of vectors), Spark adds them up, and the driver, who gets ENTRIES times the dimension of them, divides. The codes are
written once; sums of errors per label are joined by broadcast up to LABELS labels, else with the rows of a label spread over SALT keys.

Dropped: vectors that are null, hold null or non-finite components, are empty, are not a multiple of PARTS long, or are not as long as
that of the smallest vec_id. vec_id null: encoded, but never an entry at first. Rows that repeat a vec_id: each is encoded; the first
entries are those of distinct vec_ids, each of its smallest vector. Fewer than ENTRIES vec_ids: as many entries. Labels null: one
group. No rows: none. Errors beyond 63 bits (components of 10^5 and more) become the largest long; codes stay exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import cut, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits of a sum that travel as one number, so that sums of them over eight million tasks fit a long.
LIMB = 40
#: Labels up to which their sums are broadcast, and else the keys that the rows of a label are spread over.
LABELS, SALT = 100_000, 32
#: Vectors that a task works on at once.
STEP = 20_000
LARGEST = (1 << 63) - 1


class Codebook:
    """The entries of one part position, with their neighbours by distance."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, k = entries, len(entries)
        gaps = np.array([[distance(a, b) for b in entries] for a in entries], entries.dtype).reshape(k, k)
        # the others of each entry, nearest first (of equally near ones, the lower index)
        self.order = np.array([sorted((j for j in range(k) if j != i), key=lambda j, i=i: (gaps[i, j], j)) for i in range(k)], np.int64).reshape(k, k - 1)
        self.gaps = np.take_along_axis(gaps, self.order, axis=1) if k > 1 else gaps[:, :0]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        n, k = len(x), len(self.entries)
        current, best = np.zeros(n, np.int64), distances(x, self.entries[:1])
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        rows, place = np.arange(n), np.zeros(n, np.int64)
        while True:
            rows = rows[place[rows] < k - 1]
            at, here = place[rows], current[rows]
            going = self.gaps[here, at] <= 4 * best[rows] if len(rows) else np.zeros(0, bool)
            rows, other = rows[going], self.order[here[going], at[going]] if len(rows) else rows
            if not len(rows):
                return current, best
            place[rows] += 1
            new = ~marked[rows, other]
            tried, other = rows[new], other[new]
            marked[tried, other] = True
            found = distances(x[tried], self.entries[other])
            better = (found < best[tried]) | ((found == best[tried]) & (other < current[tried]))
            moved = tried[better]
            current[moved], best[moved], place[moved] = other[better], found[better], 0


def distance(a: np.ndarray, b: np.ndarray):  # noqa: ANN201  a number of the arrays' kind
    return ((a - b) ** 2).sum()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    apart = x - entries
    return np.einsum("ij,ij->i", apart, apart) if x.dtype != object else (apart * apart).sum(axis=1) if len(x) else np.zeros(0, object)


def fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """64-bit numbers if four times a squared distance fits them, else Python's."""
    width = max(a.shape[-1] for a in arrays)
    most = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    kind = np.int64 if 16 * width * most * most < 1 << 62 else object
    return [a.astype(kind) for a in arrays]


def whole_numbers(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the batch are kept, and floor(SCALE x) of their components. The vectors are column 0."""
    vectors = batch.column(0)
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(right)
    values = pc.list_flatten(vectors.take(pa.array(kept)))
    x = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(kept), dim)
    finite = np.isfinite(x).all(axis=1)
    kept, x = kept[finite], x[finite]
    if x.size and abs(x).max() >= 2.0**40:
        return kept, np.array([[exact_floor(v) for v in row] for row in x.tolist()], object).reshape(len(kept), dim)
    return kept, np.floor(x * SCALE).astype(np.int64)


def exact_floor(x: float) -> int:
    above, below = x.as_integer_ratio()
    return SCALE * above // below


def assigned(x: np.ndarray, codebooks: list[list[list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, indices, squared distances) of each part position."""
    width = x.shape[1] // PARTS
    for p, entries in enumerate(codebooks):
        part, entries = fitting(x[:, p * width : (p + 1) * width], np.array(entries, object))
        yield part, *Codebook(entries).nearest(part)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a number in base 2^LIMB, with its sign on each digit; digits of zero are left out."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if digit := value & ((1 << LIMB) - 1):
            yield place, sign * digit
        value, place = value >> LIMB, place + 1


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector can be encoded but for its length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & finite)


def first_entries(vectors: DataFrame) -> tuple[int, list[list[list[int]]]]:
    """(dimension, codebooks) of the smallest vec_ids; (0, []) without any."""
    kept = kept_vectors(vectors).where("vec_id IS NOT NULL")
    smallest = [r.vec_id for r in kept.groupBy("vec_id").agg(F.lit(1)).orderBy("vec_id").limit(1).collect()]
    if not smallest:
        first = kept_vectors(vectors).agg(F.min(F.size("embedding")).alias("dim")).first()
        return first.dim or 0, []
    dim = len(kept.where(F.col("vec_id") == smallest[0]).agg(F.min("embedding").alias("e")).first().e)
    kept = kept.where(F.size("embedding") == dim)
    ids = [r.vec_id for r in kept.groupBy("vec_id").agg(F.lit(1)).orderBy("vec_id").limit(ENTRIES).collect()]
    rows = sorted(kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("e")).collect())
    width = dim // PARTS
    whole = [[exact_floor(v) for v in r.e] for r in rows]
    return dim, [[v[p * width : (p + 1) * width] for v in whole] for p in range(PARTS)]


def trained(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[int, list[list[list[int]]]]:
    """(dimension, codebooks) after all rounds."""
    dim, codebooks = first_entries(vectors)
    if not codebooks:
        return dim, codebooks
    width = dim // PARTS

    def sums(books: list, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots are entries' components in order, and after them the entries' counts."""
        k = len(books[0])
        total, counts = np.zeros((PARTS, k, width), object), np.zeros((PARTS, k), object)
        for batch in stepped(batches):
            _, x = whole_numbers(batch, dim)
            for p, (part, index, _) in enumerate(assigned(x, books)):
                for e in np.unique(index).tolist():
                    mine = part[index == e]
                    counts[p, e] += len(mine)
                    total[p, e] += mine.sum(axis=0).astype(object)
        rows = [(slot, *one) for slot, value in enumerate([*total.ravel().tolist(), *counts.ravel().tolist()]) for one in limbs(int(value))]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["slot", "place", "digit"])

    for _ in range(rounds):
        sent = vectors.select("embedding").mapInArrow(lambda batches, books=codebooks: sums(books, batches), "slot int, place int, digit long")
        k = len(codebooks[0])
        found = [0] * (PARTS * k * (width + 1))
        for r in sent.groupBy("slot", "place").agg(F.sum("digit").alias("digit")).collect():
            found[r.slot] += r.digit << (LIMB * r.place)
        counts = found[PARTS * k * width :]
        new = []
        for p in range(PARTS):
            new.append([])
            for e in range(k):
                n, at = counts[p * k + e], (p * k + e) * width
                new[p].append([s // n for s in found[at : at + width]] if n else codebooks[p][e])
        codebooks = new
    return dim, codebooks


def stepped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def digest(codebooks: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for book in codebooks for entry in book for v in entry).encode()).hexdigest()


def encode(vectors: DataFrame, dim: int, codebooks: list[list[list[int]]]) -> DataFrame:
    """vec_id, label, code and error of every kept vector. Without codebooks (no vec_id at all) there are no rows."""
    label = vectors.schema["label"].dataType
    rows = vectors.select("embedding", F.col("vec_id").cast("long").alias("vec_id"), "label")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches):
            kept, x = whole_numbers(batch, dim)
            codes, errors = [], np.zeros(len(x), object)
            for _, index, apart in assigned(x, codebooks):
                codes.append(index.astype(np.uint8))
                errors += apart.astype(object)
            text = [row.tobytes().hex() for row in np.column_stack(codes)] if len(x) else []
            where = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(where), batch.column(2).take(where), pa.array(text, pa.string()), pa.array([min(e, LARGEST) for e in errors.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    return (rows if codebooks else rows.limit(0)).mapInArrow(run, f"vec_id long, label {label.simpleString()}, code string, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS, labels: int = LABELS) -> DataFrame:
    """A row for each kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    dim, codebooks = trained(vectors, rounds)
    rows = cut(encode(vectors, dim, codebooks))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy("label").agg(total.alias("label_error"))
    if sums.count() <= labels:
        found = rows.join(F.broadcast(sums.withColumnRenamed("label", "_label")), F.col("label").eqNullSafe(F.col("_label")))
    else:
        spread = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
        found = salted.join(spread.hint("merge"), F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out one after another, with every distance computed."""
    nearest = """
    a{r} AS MATERIALIZED (
      SELECT row, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT row, parts.p, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts JOIN c{r} ON parts.p = c{r}.p) GROUP BY row, p)"""
    update = """,
    c{n} AS MATERIALIZED (
      SELECT c{r}.p, c{r}.e, coalesce(s.y, c{r}.y) AS y FROM c{r} LEFT JOIN (
        SELECT p, e, list(y ORDER BY i) AS y FROM (
          SELECT parts.p, e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS y
          FROM parts JOIN a{r} USING (row, p), (SELECT unnest(range(1, len(x) + 1)) AS i FROM (SELECT x FROM parts LIMIT 1))
          GROUP BY ALL) GROUP BY p, e) s ON s.p = c{r}.p AND s.e = c{r}.e),"""
    steps = "".join(nearest.format(r=r) + (update.format(r=r, n=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
             list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (
      SELECT row, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)),
    c0 AS MATERIALIZED (
      SELECT p, row_number() OVER (PARTITION BY p ORDER BY row) - 1 AS e, x AS y FROM parts
      WHERE row IN (SELECT row FROM kept ORDER BY row LIMIT {ENTRIES})),{steps},
    coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY row),
    books AS (SELECT sha256(string_agg(list_aggregate(y, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (row), books"""


OP13_SQL = _sql()
