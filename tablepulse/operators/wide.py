"""Values of many columns counted in one stage and one shuffle.

A task turns each batch's columns into (column, value as bytes, count) rows; Spark adds equal ones up before and after the one shuffle
by column and value. So a thousand columns take as many stages as one, and a frequent value is no burden. Values longer than LONG bytes
travel as their SHA-256, so that long texts weigh no more than short ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.operators.frame import Table

#: Types whose values have bytes of their own.
KNOWN = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Bytes of a value that travels as it is.
LONG = 64
COUNTS = pa.schema([("c", pa.int32()), ("value", pa.binary()), ("n", pa.int64())])


def countable(table: Table) -> bool:
    """Whether every column that can be compared is of a known type."""
    return all(isinstance(table.kind(i), KNOWN) or not table.is_comparable(i) for i in range(len(table)))


def as_bytes(values: pa.Array) -> pa.Array:
    """Values without nulls as bytes, equal if and only if the values are (zeros are equal; digests stand for long values)."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        raw = values.cast(pa.binary())
        long = pc.greater(pc.binary_length(raw), LONG)
        if not pc.any(long).as_py():
            return raw
        return pa.array([b"#" + hashlib.sha256(v).digest() + b"#" * LONG if len(v) > LONG else v for v in raw.to_pylist()], pa.binary())
    if pa.types.is_boolean(kind):
        values = values.cast(pa.int8())
    elif pa.types.is_floating(kind):
        values = pa.array(values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0)
    width = values.type.bit_width // 8
    buffer = values.buffers()[1].slice(values.offset * width, len(values) * width)
    return pa.Array.from_buffers(pa.binary(width), len(values), [None, buffer]).cast(pa.binary())


def value_rows(table: Table, columns: list[int]) -> DataFrame:
    """(c, value, n) of the present values of these columns, counted by task; and a row of column -1 with the rows of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the number of rows is known from a column that has no nulls, the last one
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""]), pa.array([batch.num_rows], pa.int64())], schema=COUNTS)
            for k, i in enumerate(columns):
                values = batch.column(k).drop_null()
                if not len(values):
                    continue
                found = pc.value_counts(values)
                some, n = as_bytes(found.field(0)), found.field(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), some, n], schema=COUNTS)

    rows = table.df.select(*(table.value(i).alias(f"_c{i}") for i in columns), F.lit(True).alias("_row"))
    return rows.mapInArrow(run, "c int, value binary, n long")


def counted(table: Table) -> tuple[int, dict[int, tuple[int, int]]]:
    """(rows, for each column its present and distinct values; of columns that can't be compared, present ones only)."""
    columns = [i for i in range(len(table)) if table.is_comparable(i)]
    each = value_rows(table, columns).groupBy("c", "value").agg(F.sum("n").alias("n")).groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"))
    found = {r.c: (r.n, r.distinct) for r in each.collect()}
    rows = found.pop(-1, (0, 0))[0]
    out = {i: found.get(i, (0, 0)) for i in columns}
    others = [i for i in range(len(table)) if i not in out]
    if others:
        present = table.df.agg(*(F.count_if(~table.missing(i)).alias(f"n{i}") for i in others)).first()
        out |= {i: (present[f"n{i}"], None) for i in others}
    return rows, out
