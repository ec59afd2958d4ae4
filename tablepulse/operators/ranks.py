"""Rows at given places of a sorted order, without sorting: rank selection over composite keys.

A key is a list of codes, 64-bit numbers in the order of the key's columns: a number is its own code, text gives one for every
seven bytes, missing values come first. One pass counts the rows in equal cells between the smallest and the largest first code;
only cells that hold a wanted place are looked at again, cut up finer, and where one code is left of a cell, by the next code. What
remains around the places is a few rows each; these alone are sorted. A pass reads the key's columns, each task sends one row for each
cell that it met, and the driver gets CELLS rows at most.

Rows equal in the whole key are told apart by a hash of all their columns, so the choice doesn't depend on partitions; of rows equal in
all columns any will do, and as many as are wanted are taken from each partition first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that are counted in one pass, and rows around all places together that are few enough to be sorted.
CELLS, SORTED = 1 << 16, 20_000
#: Bytes of text in one code, and codes of a text column; of longer text only the sort of the last rows sees the rest.
TEXT_BYTES, TEXT_CODES = 7, 6
#: Types whose values are their own codes.
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def sortable(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of these; NaN is the largest, zeros are equal."""
    if values.dtype.kind != "f":
        return values.astype(np.int64)
    x = values.astype(np.float64) + 0.0
    bits = np.where(np.isnan(x), np.float64(np.nan), x).view(np.int64)
    return np.where(np.isnan(x), np.int64(0x7FF8 << 48), np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def _text_codes(c: Column, longest: int) -> list[Column]:
    """Each code: seven bytes and how many of them the text has, so that what ends sooner comes first."""
    out = []
    for k in range(min(TEXT_CODES, max(1, -(-longest // TEXT_BYTES)))):
        part = F.substring(c.cast("binary"), 1 + k * TEXT_BYTES, TEXT_BYTES)
        digits = F.conv(F.rpad(F.hex(part), 2 * TEXT_BYTES, F.lit("0")), 16, 10).cast("long")
        out.append(F.coalesce(digits * 8 + F.length(part), F.lit(0).cast("long")))
    return out


def codes_of(df: DataFrame, order: list[str]) -> tuple[int, list[Column], bool]:
    """(number of rows, codes, whether they tell all keys apart). Codes end with a column whose values they don't tell apart wholly;
    else a hash of the row is last."""
    kinds = {c: df.schema[c].dataType for c in order}
    texts = [c for c in order if isinstance(kinds[c], T.StringType | T.BinaryType)]
    first = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"n{j}") for j, c in enumerate(order)), *(F.max(F.octet_length(c)).alias(f"t{j}") for j, c in enumerate(texts))).first()
    codes: list[Column] = []
    for j, name in enumerate(order):
        c, kind = F.col(name), kinds[name]
        if first[f"n{j}"] < first.n:
            codes.append(c.isNotNull().cast("long"))
        if name in texts:
            longest = first[f"t{texts.index(name)}"] or 0
            codes += _text_codes(c, longest)
            if longest > TEXT_CODES * TEXT_BYTES:
                return first.n, codes, False
            continue
        if isinstance(kind, WHOLE):
            code = c.cast("long")
        elif isinstance(kind, T.FloatType | T.DoubleType):
            code = c.cast("double")
        elif isinstance(kind, T.DateType):
            code = F.unix_date(c).cast("long")
        elif isinstance(kind, T.TimestampType):
            code = F.unix_micros(c)
        elif isinstance(kind, T.BooleanType):
            code = c.cast("long")
        elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
            code = (c * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
        elif isinstance(kind, T.DecimalType):
            return first.n, [*codes, F.coalesce(c.cast("double"), F.lit(0.0))], False
        else:  # the sort of the last rows knows it
            return first.n, codes or [F.lit(0).cast("long")], False
        codes.append(F.coalesce(code, F.lit(0).cast("double" if isinstance(kind, T.FloatType | T.DoubleType) else "long")))
    return first.n, [*codes, row_hash(df)], True


def row_hash(df: DataFrame) -> Column:
    """Of all columns that can be hashed, nulls told from values."""
    known = [F.col(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    return F.xxhash64(*(x for c in known for x in (c.isNull(), c)))


@dataclass(frozen=True)
class Bracket:
    """Rows with codes path, then a code from low to high: n of them, after below others; places among them are wanted."""

    path: tuple[int, ...]
    low: int
    high: int
    below: int
    n: int
    places: tuple[int, ...]


@dataclass
class Node:
    """The brackets below one path: intervals of a code, each a bracket (by number) or the next node."""

    lows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    highs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    found: list = field(default_factory=list)

    @classmethod
    def of(cls, brackets: list[tuple[int, Bracket]], level: int = 0) -> Node:
        here: dict[tuple[int, int], list] = {}
        for number, b in brackets:
            here.setdefault((b.path[level],) * 2 if len(b.path) > level else (b.low, b.high), []).append((number, b))
        keys = sorted(here)
        found = [cls.of(here[k], level + 1) if len(here[k][0][1].path) > level else here[k][0][0] for k in keys]
        return cls(np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64), found)

    def locate(self, codes: np.ndarray, out: np.ndarray, rows: np.ndarray, level: int = 0) -> None:
        """The number of each row's bracket; rows of none stay as they are."""
        mine = codes[level, rows]
        at = np.searchsorted(self.lows, mine, side="right") - 1
        inside = (at >= 0) & (mine <= self.highs[at])
        rows, at = rows[inside], at[inside]
        flat = np.array([-1 if isinstance(f, Node) else f for f in self.found], np.int64)
        out[rows] = flat[at]
        for k in np.unique(at[flat[at] < 0]).tolist():
            self.found[k].locate(codes, out, rows[at == k], level + 1)


def _matrix(columns: Iterable[np.ndarray]) -> np.ndarray:
    return np.stack([sortable(c) for c in columns])


def _counted(rows: DataFrame, brackets: list[Bracket], cells: int) -> dict[int, list]:
    """For each bracket its cells that hold rows: (cell, rows, smallest and largest code in it, and of the next code)."""
    tree = Node.of(list(enumerate(brackets)))
    level = np.array([len(b.path) for b in brackets])
    low = np.array([b.low for b in brackets], np.int64)
    width = np.array([(b.high - b.low) // cells + 1 for b in brackets], np.uint64)
    most, least = np.int64(np.iinfo(np.int64).max), np.int64(np.iinfo(np.int64).min)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(brackets) * cells
        n, ends = np.zeros(size, np.int64), np.stack([np.full(size, x) for x in (most, least, most, least)])
        for batch in batches:
            codes = _matrix(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            number = np.full(batch.num_rows, -1)
            tree.locate(codes, number, np.arange(batch.num_rows))
            some = np.flatnonzero(number >= 0)
            number = number[some]
            mine, after = codes[level[number], some], codes[np.minimum(level[number] + 1, len(codes) - 1), some]
            # the difference of two codes needs all 64 bits, without a sign
            cell = number * cells + ((mine.view(np.uint64) - low[number].view(np.uint64)) // width[number]).astype(np.int64)
            np.add.at(n, cell, 1)
            for k, (ufunc, x) in enumerate(((np.minimum, mine), (np.maximum, mine), (np.minimum, after), (np.maximum, after))):
                ufunc.at(ends[k], cell, x)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found]), *(pa.array(e[found]) for e in ends)], names=["cell", "n", "a", "b", "c", "d"])

    sums = rows.mapInArrow(run, "cell long, n long, a long, b long, c long, d long").groupBy("cell").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"))
    out: dict[int, list] = {}
    for r in sorted(sums.collect()):
        out.setdefault(r.cell // cells, []).append(tuple(r))
    return out


def _narrowed(rows: DataFrame, brackets: list[Bracket], codes: int) -> list[Bracket]:
    """Brackets around the same places with fewer rows."""
    out = []
    counted = _counted(rows, brackets, max(2, CELLS // len(brackets)))
    for number, b in enumerate(brackets):
        below, places = b.below, list(b.places)
        for _, n, low, high, after, upto in counted[number]:
            here = []
            while places and places[0] < below + n:
                here.append(places.pop(0))
            if here:
                deeper = low == high and len(b.path) + 1 < codes
                out.append(Bracket((*b.path, low), after, upto, below, n, tuple(here)) if deeper else Bracket(b.path, low, high, below, n, tuple(here)))
            below += n
    return out


def at_places(df: DataFrame, order: list[str], places: list[int] | None, spaced: int = 0) -> DataFrame:
    """The rows of df at these places (ascending, distinct) in ascending order of the columns of order (nulls first), with their place
    as column _pos. With spaced, places are that many evenly spaced ones, both ends included (all, if there are no more rows)."""
    total, columns, told_apart = codes_of(df, order)
    if places is None:
        places = list(range(total)) if total <= spaced else [0] if spaced == 1 else [i * (total - 1) // (spaced - 1) for i in range(spaced)]
    places = [p for p in places if p < total]
    named = [f"_k{j}" for j in range(len(columns))]
    rows = df.select(*(c.alias(k) for c, k in zip(columns, named, strict=True)))
    brackets = [Bracket((), -(1 << 63), (1 << 63) - 1, 0, total, tuple(places))] if places else []
    settled: list[Bracket] = []
    if total > max(SORTED, 8 * len(places)) and brackets:
        ends = rows.agg(F.min("_k0").alias("a"), F.max("_k0").alias("b")).first()
        low, high = (int(sortable(np.array([x]))[0]) for x in ends)
        brackets = [Bracket((), low, high, 0, total, tuple(places))]
        while brackets and sum(b.n for b in [*brackets, *settled]) > max(SORTED, 8 * len(places)):
            brackets = _narrowed(rows, brackets, len(columns))
            alike = [b for b in brackets if b.low == b.high and len(b.path) + 1 == len(columns)]
            settled += alike
            brackets = [b for b in brackets if b not in alike]
            if not any(b.n > len(b.places) for b in brackets):
                break
    return _picked(df, order, columns, [*settled, *brackets], told_apart)


def _picked(df: DataFrame, order: list[str], columns: list[Column], brackets: list[Bracket], told_apart: bool) -> DataFrame:
    spark = df.sparkSession
    # rows alike in all codes and in their hash are equal
    whole = [told_apart and b.low == b.high and len(b.path) + 1 == len(columns) and b.n > SORTED for b in brackets]
    wanted = [(k, (j if w else p - b.below) + 1, p) for k, (b, w) in enumerate(zip(brackets, whole, strict=True)) for j, p in enumerate(b.places)]
    table = spark.createDataFrame(pa.table({"_b": pa.array([w[0] for w in wanted], pa.int32()), "_nth": pa.array([w[1] for w in wanted], pa.int32()), "_pos": pa.array([w[2] for w in wanted], pa.int64())}))
    tree = Node.of(list(enumerate(brackets)))

    @F.pandas_udf("int")
    def bracket(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            codes, number = _matrix(c.to_numpy() for c in part), np.full(len(part[0]), -1, np.int32)
            tree.locate(codes, number, np.arange(len(number)))
            yield pd.Series(number)

    found = df.withColumn("_b", bracket(*columns)).where("_b >= 0")
    key = [F.col(c).asc_nulls_first() for c in order] + [row_hash(df)]
    if any(whole):
        most = F.element_at(F.array(*(F.lit(len(b.places) if w else b.n) for b, w in zip(brackets, whole, strict=True))), F.col("_b") + 1)
        each = F.row_number().over(Window.partitionBy("_b", "_part").orderBy(*key))
        found = found.withColumn("_part", F.spark_partition_id()).withColumn("_nth", each).where(F.col("_nth") <= most).drop("_part")
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(*key))
    return found.withColumn("_nth", nth).join(F.broadcast(table), ["_b", "_nth"]).select(*df.columns, "_pos")  # a row for each place
