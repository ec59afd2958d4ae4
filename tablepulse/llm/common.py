"""What the training-data operators share: cut lineage, column picking, connected components.

Every operator reads only the columns that it names and gives back a schema of its own, so further
columns of the input, whatever they are called, neither clash nor travel through a shuffle.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.operators.lineage import shared_dir, written

#: Bytes of text that a Python worker works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of a checkpoint file, where their number is known.
FILE_ROWS = 50_000
#: Links that a task ties together at once.
LINKS = 500_000
#: Bytes of an Arrow batch, where the session has Spark's default.
BATCH_BYTES, DEFAULT_BATCH = 4 << 20, "67108864b"


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to the shared checkpoint folder, so that a lost executor costs no recomputation of what came before.

    rows: about how many there are at most; then no more files are written than hold FILE_ROWS each."""
    return written(df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS))))


class Relay:
    """Hands a frame on as a Parquet table in the shared folder; the table before it is removed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.last, self.n = spark, f"{shared_dir(spark)}/relay-{uuid.uuid4()}", None, 0

    def __call__(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path)
        if self.last:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
        self.last = path
        return self.spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_chunks(batches: Iterable[pa.RecordBatch], text: int = 1, size: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Keys (column 0) and texts (a binary column; null: empty), a few megabytes at a time."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(text)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(keys):
            start = int(sizes[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, start + size, side="right")))
            yield keys[at:upto], [x or b"" for x in texts.slice(at, upto - at).to_pylist()]
            at = upto


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the text's UTF-8 bytes, sent to Python in batches of BATCH_BYTES at most, so that long texts don't pile up."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == DEFAULT_BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def map_texts(docs: DataFrame, function: Callable[[list, list[bytes]], dict[str, list]], schema: str) -> DataFrame:
    """function gets doc_ids and UTF-8 texts (null: empty) and gives columns of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in in_chunks(batches):
            out = function(keys, texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    return text_rows(docs).mapInArrow(run, schema)


def filter_texts(docs: DataFrame, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of docs, with all their columns, whose text keep is true of; nothing is shuffled."""
    text_rows(docs.limit(0))  # sets the batch size
    name, schema = "text", docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
            mask: list[bool] = []
            for _, some in in_chunks([pa.RecordBatch.from_arrays([texts, texts], names=["key", "text"])]):
                mask += keep(some)
            yield batch.filter(pa.array(mask, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, schema)


_STATE: dict = {}


def give_back() -> None:
    """What a Python worker has freed goes back to the system: idle workers share their executor's memory with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps it for later use
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker_state(name: Hashable, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task; of one operator only, so that a pipeline's tables don't pile up."""
    if name not in _STATE:
        if _STATE:
            _STATE.clear()
            give_back()
        _STATE[name] = make()
    return _STATE[name]


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition, LINKS at a time, as stars: each node with the smallest node that these tie it to."""
    forest, n = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        n += batch.num_rows
        if n >= LINKS:
            yield from _stars(forest)
            forest, n = Forest(), 0
    yield from _stars(forest)


def _stars(forest: Forest) -> Iterator[pa.RecordBatch]:
    nodes = list(forest.up)
    roots = [forest.root(x) for x in nodes]
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000], pa.int64()), pa.array(roots[at : at + 100_000], pa.int64())], names=["a", "b"])


def components(links: DataFrame, nodes: int | None = None, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node but those smallest ones themselves.

    Large-star and small-star steps alternate until nothing changes. Each partition first ties its own links
    together, which shortens chains. No step holds the links of a node in one place: minima are pre-aggregated and
    joins on a frequent node can be split. Each round ends in a checkpoint. nodes: how many there are at most. An error
    is raised if something still changes in the last of rounds, far more than are needed."""
    stars = cut(links.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), nodes)
    seen = None
    for _ in range(rounds):
        most = nodes if seen is None else seen[0]
        # large star: larger neighbours of a node are hung on the smallest one in its neighbourhood
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written out, so that both sides of a join are dealt anew and a frequent node's rows can be split
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), most and 2 * most)
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), most and 2 * most)
        # small star: smaller neighbours and the node itself are hung on the smallest one
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), most)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        stars = cut(small.mapInArrow(_contract, "a long, b long").distinct(), most)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return stars.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
