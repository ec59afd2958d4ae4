"""Values of all columns at evenly spaced places among each column's present values: one count and one scan for any number of columns.

Present values are counted by partition and column. The driver turns each wanted place into a partition and a place among that
partition's present values of the column, so a task is told no more than it has to pick. A task keeps one counter for each column and
sends what it picked as one block a column, in Arrow's own types. What reaches the driver are the picked values alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from tablepulse.operators.frame import Table, settled

#: Columns that are counted in one aggregate.
COUNTED = 200


def spaced_places(n: int, size: int) -> np.ndarray:
    """Places of up to size values among n, evenly spaced, both ends included."""
    if n <= size:
        return np.arange(n)
    # n - 1 times size fits 64 bits up to 9e14 rows; Python's numbers go further
    return np.array([i * (n - 1) // (size - 1) for i in range(size)], np.int64) if size > 1 else np.zeros(min(n, 1), np.int64)


def _present_by_partition(table: Table, columns: list[int]) -> dict[int, dict[int, int]]:
    """For each partition, the present values of each column."""
    out: dict[int, dict[int, int]] = {}
    for some in itertools.batched(columns, COUNTED):
        for r in table.df.groupBy(F.spark_partition_id().alias("p")).agg(*(F.count(table.value(i)).alias(f"n{i}") for i in some)).collect():
            out.setdefault(r.p, {}).update({i: r[f"n{i}"] for i in some})
    return out


def picked_values(table: Table, present: dict[int, int], size: int) -> dict[int, list[Any]]:
    """Up to size present values of each column, by place. present: the number of present values of the columns wanted."""
    out: dict[int, list[Any]] = {i: [] for i in present}
    columns = [i for i in present if present[i]]
    if not columns:
        return out
    table = Table(settled(table.df), table.names)
    rows = table.df.select(*(table.value(i).alias(f"_c{i}") for i in columns))
    parts = _present_by_partition(table, columns)
    wanted: dict[int, dict[int, np.ndarray]] = {}
    before = dict.fromkeys(columns, 0)
    places = {i: spaced_places(present[i], size) for i in columns}
    for p in sorted(parts):
        for i in columns:
            low, n = before[i], parts[p][i]
            a, b = np.searchsorted(places[i], (low, low + n))
            if a < b:
                wanted.setdefault(p, {})[i] = places[i][a:b] - low
            before[i] += n
    sent = table.df.sparkSession.sparkContext.broadcast(wanted)  # size places a column at most

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        mine = sent.value.get(part, {})
        seen, done = dict.fromkeys(mine, 0), dict.fromkeys(mine, 0)
        found: dict[int, list[pa.Array]] = {i: [] for i in mine}
        for batch in batches:
            for i, at in mine.items():
                if done[i] == len(at):
                    continue
                values = batch.column(columns.index(i))
                n = len(values) - values.null_count
                upto = int(np.searchsorted(at, seen[i] + n))
                if upto > done[i]:
                    here = at[done[i] : upto] - seen[i]
                    values = values if n == len(values) else pc.drop_null(values)
                    found[i].append(values.take(pa.array(here)))
                    done[i] = upto
                seen[i] += n
        blocks = [(i, part, _block(chunks)) for i, chunks in found.items()]
        for block in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(block, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["c", "part", "block"])

    for r in sorted(rows.mapInArrow(pick, "c int, part int, block binary").collect(), key=lambda r: r.part):
        with pa.ipc.open_stream(r.block) as stream:
            out[r.c] += stream.read_all().column(0).to_pylist()
    short = [table.names[i] for i in columns if len(out[i]) != len(places[i])]
    if short:
        raise RuntimeError(f"the counts given for these columns are not the table's: {', '.join(short)}")
    return out


def _block(chunks: list[pa.Array]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("v", chunks[0].type)])) as stream:
        for chunk in chunks:
            stream.write_batch(pa.record_batch([chunk], names=["v"]))
    return sink.getvalue().to_pybytes()
