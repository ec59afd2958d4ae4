"""Sources by their names, and the analysis of an upload."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import SparkSession

from tablepulse.config import ProfileConfig, ResourceLimits
from tablepulse.plans.analysis import Analysis, analyze_table
from tablepulse.sources import errors as E
from tablepulse.sources.common import Ingestion, extension
from tablepulse.sources.csv import ingest_csv, read_csv
from tablepulse.sources.parquet import ingest_parquet, read_parquet
from tablepulse.sources.xlsx import ingest_xlsx, read_xlsx


def ingest(spark: SparkSession, content: bytes, name: str, worksheet: str | None = None, limits: ResourceLimits | None = None) -> Ingestion:
    """An upload, by its name's extension."""
    kind = extension(name)
    if kind == "csv":
        return ingest_csv(spark, content, name, limits)
    if kind == "parquet":
        return ingest_parquet(spark, content, name, limits)
    if kind == "xlsx":
        return ingest_xlsx(spark, content, name, worksheet, limits)
    raise E.UnsupportedSource("Only CSV, XLSX and Parquet are read.")


def open_source(spark: SparkSession, path: str, worksheet: str | None = None) -> Ingestion:
    """A source on any storage, of any size (workbooks: within their limits)."""
    kind = extension(path.rstrip("/"))
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "xlsx":
        return read_xlsx(spark, path, worksheet)
    return read_parquet(spark, path)


def analyze_upload(spark: SparkSession, content: bytes, name: str, worksheet: str | None = None, limits: ResourceLimits | None = None, target: str | None = None) -> Analysis:
    """Everything about an upload; its identity is the digest of its bytes, which aren't kept."""
    source = ingest(spark, content, name, worksheet, limits)
    source.format["sha256"] = sha256(content).hexdigest()
    limits = limits or ResourceLimits()
    profile = ProfileConfig(most_rows=limits.rows, most_columns=limits.columns, most_cells=10_000_000)
    return analyze_table(source.table, source.source_name, target, profile=profile, ingestion=source)
