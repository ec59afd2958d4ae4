"""What all sources share: names, sizes, the result, and the log."""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import PurePath

from pyspark.sql import DataFrame

from tablepulse.operators.frame import Table
from tablepulse.sources import errors as E

LOG = logging.getLogger("tablepulse.ingestion")
NAME_LIMIT = 255


class JsonFormatter(logging.Formatter):
    """One JSON object a line: fixed event names and numbers, never a value of the data."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "event": record.getMessage(), **getattr(record, "facts", {})}, sort_keys=True, default=str)


def configure_logging(level: str = "INFO") -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter())
    LOG.handlers[:] = [handler]
    LOG.setLevel(level)


@dataclass(frozen=True)
class Ingestion:
    """A source as a table, with what is known of it."""

    table: Table
    row_count: int
    source_type: str
    source_name: str
    source_bytes: int | None
    encoding: str | None = None
    format: dict = field(default_factory=dict)
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    ingested_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    duration_ms: float = 0.0

    @property
    def column_count(self) -> int:
        return len(self.table)


def display_name(name: str, fallback: str = "unnamed") -> str:
    """The last part of a path, printable, of NAME_LIMIT characters at most."""
    shown = "".join(c for c in PurePath(name.replace("\\", "/")).name if c.isprintable()).strip()
    return shown[:NAME_LIMIT] or fallback


def check_size(size: int, limit: int) -> None:
    if size > limit:
        raise E.SourceTooLarge(f"The source has {size} bytes; the limit is {limit}.", actual=size, limit=limit)


def check_count(rows: int | None, columns: int | None, limits) -> None:  # noqa: ANN001
    if columns is not None and columns > limits.columns:
        raise E.ColumnLimitExceeded(f"The source has {columns} columns; the limit is {limits.columns}.", observed=columns, limit=limits.columns)
    if rows is not None and rows > limits.rows:
        raise E.RowLimitExceeded(f"The source has more than {limits.rows} rows.", observed=rows, limit=limits.rows)


def check_names(names: Sequence[object]) -> list[str]:
    """The names, if all are text that isn't blank, and none stands twice. Positions are told from 1."""
    bad = tuple(i for i, n in enumerate(names, 1) if not isinstance(n, str) or not n.strip())
    if bad:
        raise E.InvalidColumnNames("Some column names are missing or blank.", positions=bad)
    twice = tuple(dict.fromkeys(n for n in names if list(names).count(n) > 1))
    if twice:
        raise E.DuplicateColumns("Some column names stand more than once.", names=twice)
    return [str(n) for n in names]


def check_loaded(df: DataFrame, rows: int, columns: int) -> int:
    """What was loaded is what was validated."""
    n = df.count()
    if n != rows or len(df.columns) != columns:
        raise E.IngestionConsistency("The loaded table isn't the one that was validated.", expected_rows=rows, actual_rows=n, expected_columns=columns, actual_columns=len(df.columns))
    return n


def logged(kind: str, name: str, size: int | None, load: Callable[[], Ingestion]) -> Ingestion:
    facts, began = {"source_type": kind, "source_name": name, "source_bytes": size}, time.perf_counter()
    spent = lambda: round((time.perf_counter() - began) * 1000, 3)
    LOG.info("ingestion_started", extra={"facts": facts})
    try:
        out = load()
    except E.IngestionError as error:
        LOG.warning("ingestion_failed", extra={"facts": facts | {"error_code": error.code, "duration_ms": spent()}})
        raise
    object.__setattr__(out, "duration_ms", spent())
    LOG.info("ingestion_succeeded", extra={"facts": facts | {"row_count": out.row_count, "column_count": out.column_count, "duration_ms": out.duration_ms}})
    return out


def extension(name: str) -> str:
    m = re.search(r"\.([A-Za-z0-9]+)$", name)
    return m[1].lower() if m else ""


def unique(values: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(values))
