"""Parquet: flat tables. Uploads are checked by their footer before anything else is read; folders are read by the cluster."""

from __future__ import annotations

import io
import struct

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tablepulse.config import ResourceLimits
from tablepulse.operators.frame import Table
from tablepulse.sources import errors as E
from tablepulse.sources.common import Ingestion, check_count, check_loaded, check_names, check_size, display_name, logged

MAGIC = b"PAR1"


def check_footer(content: bytes, most: int) -> None:
    if len(content) < 12 or not content.startswith(MAGIC) or not content.endswith(MAGIC):
        raise E.MalformedParquet("The source is no Parquet file.")
    (size,) = struct.unpack("<I", content[-8:-4])
    if size > len(content) - 12:
        raise E.MalformedParquet("The footer's length is wrong.")
    if size > most:
        raise E.ParquetLimitExceeded(f"The footer has {size} bytes; the limit is {most}.", observed=size, limit=most)


def check_metadata(content: bytes, limits: ResourceLimits) -> tuple[int, list[str], dict]:
    """(rows, names, facts) by the footer alone."""
    try:
        file = pq.ParquetFile(io.BytesIO(content), pre_buffer=False, thrift_string_size_limit=limits.parquet_metadata_bytes, thrift_container_size_limit=max(1024, limits.columns * 8 + limits.parquet_row_groups * 4), page_checksum_verification=True)
        meta, schema = file.metadata, file.schema_arrow
    except (pa.ArrowException, OSError, ValueError, OverflowError) as error:
        raise E.MalformedParquet("The source can't be read as Parquet.") from error
    check_count(meta.num_rows, len(schema), limits)
    if meta.num_row_groups > limits.parquet_row_groups:
        raise E.ParquetLimitExceeded(f"The source has {meta.num_row_groups} row groups; the limit is {limits.parquet_row_groups}.", observed=meta.num_row_groups, limit=limits.parquet_row_groups)
    if not len(schema):
        raise E.EmptySource("The source has no columns.")
    if not meta.num_rows:
        raise E.NoDataRows("The source has columns but no rows.")
    names = check_names(schema.names)
    if nested := tuple(f.name for f in schema if pa.types.is_nested(f.type)):
        raise E.UnsupportedParquetSchema("Nested columns can't be analysed.", columns=nested)
    return meta.num_rows, names, {"row_groups": meta.num_row_groups, "version": meta.format_version, "schema": [f"{f.name}: {f.type}" for f in schema]}


def ingest_parquet(spark: SparkSession, content: bytes, name: str = "unnamed.parquet", limits: ResourceLimits | None = None) -> Ingestion:
    """An upload, small by its limit, so the driver reads it and hands the rows to Spark."""
    limits, shown = limits or ResourceLimits(), display_name(name, "unnamed.parquet")

    def load() -> Ingestion:
        check_size(len(content), limits.source_bytes)
        if not content:
            raise E.EmptySource("The source holds nothing.")
        check_footer(content, limits.parquet_metadata_bytes)
        rows, names, facts = check_metadata(content, limits)
        try:
            table = pq.read_table(io.BytesIO(content), use_threads=False, page_checksum_verification=True)
        except (pa.ArrowException, OSError, ValueError) as error:
            raise E.MalformedParquet("The source can't be read as Parquet.") from error
        plain = [c.cast(c.type.value_type) if pa.types.is_dictionary(c.type) else c for c in (table.column(i).combine_chunks() for i in range(table.num_columns))]
        df = spark.createDataFrame(pa.table(plain, names=[f"_c{i}" for i in range(len(names))]))
        return Ingestion(Table(df, tuple(names)), check_loaded(df, rows, len(names)), "parquet", shown, len(content), format=facts)

    return logged("parquet", shown, len(content), load)


def read_parquet(spark: SparkSession, path: str) -> Ingestion:
    """Parquet of any size on any storage; columns that aren't used later are never read."""
    shown = display_name(path, "unnamed.parquet")

    def load() -> Ingestion:
        df = spark.read.parquet(path)
        if not df.columns:
            raise E.EmptySource("The source has no columns.")
        check_names(df.columns)
        if nested := tuple(f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)):
            raise E.UnsupportedParquetSchema("Nested columns can't be analysed.", columns=nested)
        n = df.count()  # from the footers
        if not n:
            raise E.NoDataRows("The source has columns but no rows.")
        return Ingestion(Table.of(df), n, "parquet", shown, None, format={"schema": [f"{f.name}: {f.dataType.simpleString()}" for f in df.schema]})

    return logged("parquet", shown, None, load)

