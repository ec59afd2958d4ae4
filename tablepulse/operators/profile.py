"""The exact profile of a table: facts, and the statistics that fit each column's effective type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tablepulse.config import ProfileConfig
from tablepulse.operators import categorical, numeric
from tablepulse.operators.facts import dataset_summary
from tablepulse.operators.frame import Table
from tablepulse.operators.jobs import together
from tablepulse.operators.semantic import TYPES, ColumnType


class ProfileError(ValueError):
    """Types that don't belong to the table, or a table beyond the configured limits."""


@dataclass(frozen=True)
class ColumnProfile:
    column_name: str
    position: int
    dtype: str
    effective_type: str
    row_count: int
    null_count: int
    distinct_count: int | None
    kind: str | None = None
    statistics: dict[str, Any] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()

    @property
    def non_null_count(self) -> int:
        return self.row_count - self.null_count

    @property
    def missing_percentage(self) -> float:
        return self.null_count * 100.0 / self.row_count if self.row_count else 0.0

    @property
    def cardinality_ratio(self) -> float | None:
        count = self.statistics["category_count"] if self.kind == "categorical" else self.distinct_count
        return count / self.non_null_count if count is not None and self.non_null_count else None


@dataclass(frozen=True)
class DatasetProfile:
    summary: dict[str, Any]
    columns: tuple[ColumnProfile, ...]
    types: tuple[ColumnType, ...]
    config: ProfileConfig
    warnings: tuple[str, ...] = ()

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.column_name == name)

    @property
    def type_counts(self) -> list[tuple[str, int]]:
        found = [t.effective_type for t in self.types]
        return [(t, found.count(t)) for t in TYPES if t in found]


def statistics_kind(table: Table, column: ColumnType) -> str | None:
    """Which statistics a column gets. A constant one goes by its physical type."""
    t, i = column.effective_type, column.position
    if t in ("numeric_continuous", "numeric_discrete"):
        return "numeric"
    if t in ("categorical", "boolean"):
        return "categorical"
    if t == "datetime":
        return "datetime"
    if t in ("free_text", "identifier"):
        return "text"
    if t == "constant":
        return "numeric" if table.is_numeric(i) else "datetime" if table.is_temporal(i) else "categorical"
    return None


def check_types(table: Table, types: list[ColumnType], row_count: int) -> None:
    """Types of another or changed table are refused."""
    if [t.column_name for t in types] != list(table.names) or [t.position for t in types] != list(range(len(table))):
        raise ProfileError("the types are of other columns")
    for t in types:
        if t.dtype != table.dtype(t.position):
            raise ProfileError(f"column {t.position} has another physical type")
        if t.row_count != row_count:
            raise ProfileError("the types are of a table with other rows")


def profile_table(df: DataFrame | Table, types: list[ColumnType], config: ProfileConfig | None = None) -> DatasetProfile:
    """A handful of jobs, whatever the number of columns of a kind: one for the summary, and a few for each kind, side by side."""
    table, config = Table.of(df), config or ProfileConfig()
    for limit, size, what in ((config.most_columns, len(table), "columns"), (config.most_rows, max((t.row_count for t in types), default=0), "rows")):
        if limit is not None and size > limit:
            raise ProfileError(f"the table has {size} {what}; the limit is {limit}")
    check_types(table, types, types[0].row_count if types else 0)
    kinds = {t.position: statistics_kind(table, t) for t in types}
    # names may repeat, so statistics go by position
    by_position = Table(table.df, tuple(f"_c{i}" for i in range(len(table))))
    of = lambda kind: [f"_c{i}" for i, k in kinds.items() if k == kind]
    numbers, categories, texts, dates = map(of, ("numeric", "categorical", "text", "datetime"))
    by_name = lambda rows: {r.column_name: r.asDict() for r in rows}
    wanted: list[Callable[[], dict[str, dict]]] = []
    if numbers:
        wanted += [lambda: by_name(numeric.quartiles(by_position, numbers, config.interpolation).collect()), lambda: by_name(numeric.moments(by_position, numbers, config.ddof).collect())]
    if categories:
        wanted.append(lambda: categorical.summarized(categories, categorical.top_values(by_position, categories, config.top_values, config.display_length).collect()))
    if texts:
        wanted.append(lambda: by_name(categorical.text_summary(by_position, texts).collect()))
    if dates:
        wanted.append(lambda: by_name(categorical.datetime_summary(by_position, *dates).collect()))
    summary, *parts = together(table.df.sparkSession, lambda: dataset_summary(table).first().asDict(), *wanted)
    if config.most_cells is not None and summary["cell_count"] > config.most_cells:
        raise ProfileError(f"the table has {summary['cell_count']} cells; the limit is {config.most_cells}")
    check_types(table, types, summary["row_count"])
    found: dict[str, dict] = {}
    for part in parts:
        for name, facts in part.items():
            found[name] = found.get(name, {}) | facts
    columns = []
    for t in types:
        stats = {k: v for k, v in found.get(f"_c{t.position}", {}).items() if k not in ("column_name", "position")}
        warnings = []
        if stats.get("non_numeric_count"):
            warnings.append("NON_NUMERIC_VALUES_EXCLUDED")
        if stats.get("ambiguous_count"):
            warnings.append("AMBIGUOUS_DATETIME_VALUES_EXCLUDED")
        if stats.get("timezone_state") == "mixed":
            warnings.append("MIXED_DATETIME_AWARENESS")
        columns.append(ColumnProfile(t.column_name, t.position, t.dtype, t.effective_type, t.row_count, t.null_count, t.distinct_count, kinds[t.position], stats, tuple(warnings)))
    unknown = ("DUPLICATE_COUNT_UNAVAILABLE",) if summary["duplicate_row_count"] is None else ()
    return DatasetProfile(summary, tuple(columns), tuple(types), config, unknown)


PROFILE_SCHEMA = "position int, column_name string, dtype string, effective_type string, kind string, row_count long, null_count long, non_null_count long, missing_percentage double, distinct_count long, cardinality_ratio double, warnings array<string>"


def profile_frame(df: DataFrame | Table, profile: DatasetProfile) -> DataFrame:
    rows = [(c.position, c.column_name, c.dtype, c.effective_type, c.kind, c.row_count, c.null_count, c.non_null_count, c.missing_percentage, c.distinct_count, c.cardinality_ratio, list(c.warnings)) for c in profile.columns]
    return Table.of(df).df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
