"""Records of CSV files whose fields may hold line breaks, read in as many tasks as the files have splits.

A line break ends a record if an even number of quotes stands before it in the file. Whether that holds in a split isn't known
until all splits before it are counted, so there are two scans. The first notes for each split whether its quotes are even or odd in
number, and whether a line ends in it after an odd number of them; from that the driver tells each split's parity at its start, and
which earlier split began the record that reaches into it. The second cuts records at true record ends. What a split has of a record that
began before it or goes on behind it is put together from its pieces; all other records never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of lines that a task puts together at once.
BLOCK = 4 << 20
RECORDS = pa.schema([("file", pa.string()), ("first", pa.bool_()), ("opener", pa.int64()), ("split", pa.int64()), ("record", pa.binary())])


class OpenQuote(ValueError):
    """A file ends inside quotes."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("line"))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, split, some lines), in order; the lines of a split come in one or more parts."""
    for batch in batches:
        files, splits = batch.column(0), batch.column(1).to_numpy()
        names = files.dictionary_encode()
        change = np.flatnonzero((np.diff(splits) != 0) | (np.diff(names.indices.to_numpy()) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            if a < b:
                yield files[a].as_py(), int(splits[a]), batch.column(2).slice(a, b - a)


def _upto(lines: pa.Array, before: int) -> np.ndarray:
    """Parity of the quotes up to each line's end."""
    return (before + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) & 1


def _parities(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[bool, bool]]:
    """For each split: whether its quotes are odd in number, and whether a line in it ends after an odd number of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for file, split, lines in _chunks(batches):
            mine = found.setdefault((file, split), [False, False])
            parity = _upto(lines, int(mine[0]))
            found[file, split] = [bool(parity[-1]), mine[1] or bool(parity.any())]
        columns = list(zip(*((f, s, *x) for (f, s), x in found.items()), strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], names=["file", "split", "odd", "some"])

    rows = _lines(spark, path).mapInArrow(run, "file string, split long, odd boolean, some boolean").groupBy("file", "split").agg(F.max("odd").alias("odd"), F.max("some").alias("some"))
    return {(r.file, r.split): (r.odd, r.some) for r in rows.collect()}


def _starts(parities: dict[tuple[str, int], tuple[bool, bool]]) -> dict[tuple[str, int], tuple[bool, int]]:
    """For each split: whether it begins inside quotes, and the split where the record that reaches into it began."""
    out: dict[tuple[str, int], tuple[bool, int]] = {}
    now, inside, opener = None, False, -1
    for file, split in sorted(parities):
        if file != now:
            if inside:
                raise OpenQuote(now)
            now, inside, opener = file, False, -1
        out[file, split] = (inside, opener)
        odd, some = parities[file, split]
        # begun inside, a line that ends after an odd number of this split's quotes closes the record
        closed = some if inside else True
        inside ^= odd
        if inside and closed:
            opener = split
    if inside:
        raise OpenQuote(now)
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): all records that aren't blank, as bytes without their line end; first: the file's first one.

    Raises OpenQuote if a file ends inside quotes."""
    sent = spark.sparkContext.broadcast(_starts(_parities(spark, path)))  # two values a split

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"at": None}
        out: list[tuple] = []

        def put(record: bytes, opener: int | None) -> None:
            file, split = state["at"]
            first = opener is None and state["fresh"] and record.strip() != b""
            if first:
                state["fresh"] = False
            if opener is not None or record.strip():
                out.append((file, first, opener, split, record))

        def end() -> None:
            """What is left of a split: the part of a record that goes on behind it."""
            if state["at"] and state["open"]:
                put(b"\n".join(state["open"]), state["opener"] if state["head"] else state["at"][1])

        def sent_rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RECORDS, strict=True)], schema=RECORDS)

        size = 0
        for file, split, lines in _chunks(batches):
            if (file, split) != state["at"]:
                end()
                inside, opener = sent.value[file, split]
                state = {"at": (file, split), "parity": int(inside), "opener": opener, "head": inside, "open": [], "fresh": split == 0}
            parity = _upto(lines, state["parity"])
            state["parity"] = int(parity[-1])
            for line, odd in zip(lines.to_pylist(), parity.tolist(), strict=True):
                state["open"].append(line)
                size += len(line)
                if not odd:
                    put(b"\n".join(state["open"]), state["opener"] if state["head"] else None)
                    state["open"], state["head"] = [], False
            if size > BLOCK:
                yield sent_rows()
                size = 0
        end()
        yield sent_rows()

    found = _lines(spark, path).mapInArrow(run, "file string, first boolean, opener long, split long, record binary")
    pieces = found.where("opener IS NOT NULL").groupBy("file", "opener").agg(F.sort_array(F.collect_list(F.struct("split", "record"))).alias("p"))
    joined = pieces.select("file", F.lit(False).alias("first"), F.to_binary(F.array_join(F.transform("p", lambda x: F.hex(x["record"])), "0A"), F.lit("hex")).alias("record"))
    return found.where("opener IS NULL").select("file", "first", "record").unionByName(joined)
