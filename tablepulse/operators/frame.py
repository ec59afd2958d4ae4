"""A DataFrame whose columns are addressed by position, so that any names, repeated ones too, are safe."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.operators.lineage import written
from tablepulse.operators.ranks import at_places

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Table:
    """df has columns _c0, _c1, ...; names has what they are called."""

    df: DataFrame
    names: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame | Table, names: list[str] | None = None) -> Table:
        if isinstance(df, Table):
            return df
        return cls(df.toDF(*(f"_c{i}" for i in range(len(df.columns)))), tuple(names or df.columns))

    def __len__(self) -> int:
        return len(self.names)

    def kind(self, i: int) -> T.DataType:
        return self.df.schema[i].dataType

    def dtype(self, i: int) -> str:
        return self.kind(i).simpleString()

    def position(self, name: str) -> int:
        if name not in self.names:
            raise ValueError(f"Unknown column: {name}")
        return self.names.index(name)

    def is_numeric(self, i: int) -> bool:
        return isinstance(self.kind(i), NUMERIC)

    def is_text(self, i: int) -> bool:
        return isinstance(self.kind(i), T.StringType)

    def is_temporal(self, i: int) -> bool:
        return isinstance(self.kind(i), TEMPORAL)

    def is_comparable(self, i: int) -> bool:
        """Whether values are told apart: nested ones are not."""
        return not isinstance(self.kind(i), T.ArrayType | T.StructType | T.MapType | T.VariantType)

    def missing(self, i: int) -> Column:
        """Null, or not a number."""
        c = F.col(f"_c{i}")
        return c.isNull() | F.isnan(c) if isinstance(self.kind(i), FRACTIONAL) else c.isNull()

    def value(self, i: int) -> Column:
        """The value; null if missing. Of types without NaN it's the bare column, so that filters reach the scan."""
        c = F.col(f"_c{i}")
        return F.when(~F.isnan(c), c) if isinstance(self.kind(i), FRACTIONAL) else c

    def number(self, i: int) -> Column:
        """As a double; null if missing or no number (text is read where it can be)."""
        c = self.value(i)
        if isinstance(self.kind(i), FRACTIONAL):
            return c.cast("double")
        number = c.try_cast("double") if self.is_numeric(i) or self.is_text(i) or isinstance(self.kind(i), T.BooleanType) else F.lit(None).cast("double")
        return F.when(~F.isnan(number), number)

    def finite(self, i: int) -> Column:
        """As a double; null if missing or infinite."""
        c = self.number(i)
        return F.when(F.abs(c) < float("inf"), c)


#: Steps that give the same rows in the same partitions each time they run over a scan.
REPEATABLE = {"AdaptiveSparkPlan", "WholeStageCodegen", "InputAdapter", "ColumnarToRow", "Project", "Filter", "Union", "BroadcastHashJoin", "BroadcastExchange", "Scan", "FileScan", "BatchScan", "LocalTableScan", "Range", "Coalesce"}


def repeatable(df: DataFrame) -> bool:
    """Whether every job reads df in the same partitions and order: scans with deterministic steps that stay within a partition. What
    is shuffled may be merged, split and bounded otherwise at run time; a limit, a Python step or a random filter may choose otherwise."""
    query = df._jdf.queryExecution()
    steps = {m[1] for line in query.executedPlan().toString().splitlines() if (m := re.match(r"[\s:+\-|]*(?:\*\(\d+\) )?([A-Za-z]+)", line))}
    known = steps <= REPEATABLE or (steps - REPEATABLE) <= {"LogicalRDD", "ExistingRDD"}
    plan = query.optimizedPlan()
    return known and "Python" not in plan.toString() and _deterministic(plan)


def _deterministic(plan) -> bool:  # noqa: ANN001
    children = plan.children()
    return plan.deterministic() and all(_deterministic(children.apply(k)) for k in range(children.size()))


def same_rows(df: DataFrame) -> bool:
    """Whether every job sees the same rows, in whatever partitions and order: no random step, no choice of some rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return not re.search(r"^[\s:+\-|]*(Global|Local|Tail)?(Limit|Sample)\b", plan.toString(), re.M) and _deterministic(plan)


def settled(df: DataFrame) -> DataFrame:
    """df, or what was written of it if two jobs could see other rows or partitions."""
    return df if repeatable(df) else written(df)


def _scan_position(df: DataFrame) -> tuple[DataFrame, int]:
    """df with _pos, the row's place in scan order (single-file sources: file order), and the number of rows.

    The id that Spark gives holds a partition's number and the place in it, so the rows before each partition are all that
    is counted: one number for each partition. df is repeatable."""
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = sorted((r.p, r["count"]) for r in marked.select(part.alias("p")).groupBy("p").count().collect())
    n = sum(c for _, c in counts)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    if len(counts) < 2:
        return marked.withColumn("_pos", place).drop("_id"), n
    before = np.cumsum([0, *(c for _, c in counts[:-1])])
    offsets = df.sparkSession.createDataFrame(pa.table({"_part": pa.array([p for p, _ in counts], pa.int64()), "_before": pa.array(before, pa.int64())}))
    placed = marked.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # two numbers a partition
    return placed.select(*df.columns, (F.col("_before") + place).alias("_pos")), n


def in_scan_order(df: DataFrame) -> DataFrame:
    """df with _pos, the row's place in scan order."""
    return _scan_position(settled(df))[0]


def evenly_spaced(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Up to size rows at positions i * (n - 1) // (size - 1), both ends included, with column _pos.

    order: columns whose ascending order counts, found by rank selection; without them the scan's order does."""
    if size < 1:
        raise ValueError("The sample's size must be positive")
    if order:
        return at_places(df, list(order), None, size)
    placed, n = _scan_position(settled(df))
    if n <= size:
        return placed
    if size == 1:
        return placed.where("_pos = 0")
    # position p is taken if some i < size has i * (n - 1) = p * (size - 1) + r with 0 <= r < size - 1
    i = F.expr(f"(_pos * {size - 1}L + {n - 2}L) div {n - 1}L")
    rest = i * (n - 1) - F.col("_pos") * (size - 1)
    return placed.where((i < size) & (rest < size - 1))
