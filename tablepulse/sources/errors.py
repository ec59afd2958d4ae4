"""Typed failures of reading a source. Messages never hold values of the data."""

from __future__ import annotations


class IngestionError(Exception):
    """code is stable; details holds the facts that a caller may act on."""

    code = "ingestion_error"

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.message = message
        self.details = details


def _kind(name: str, code: str) -> type[IngestionError]:
    return type(name, (IngestionError,), {"code": code, "__doc__": code.replace("_", " ")})


#: The codes of failures.
UnsupportedSource = _kind("UnsupportedSource", "unsupported_source")
SourceTooLarge = _kind("SourceTooLarge", "source_too_large")
EmptySource = _kind("EmptySource", "empty_source")
NoDataRows = _kind("NoDataRows", "no_data_rows")
InvalidEncoding = _kind("InvalidEncoding", "invalid_encoding")
MalformedSource = _kind("MalformedSource", "malformed_source")
RowLimitExceeded = _kind("RowLimitExceeded", "row_limit_exceeded")
ColumnLimitExceeded = _kind("ColumnLimitExceeded", "column_limit_exceeded")
DuplicateColumns = _kind("DuplicateColumns", "duplicate_columns")
InvalidColumnNames = _kind("InvalidColumnNames", "invalid_column_names")
IngestionConsistency = _kind("IngestionConsistency", "ingestion_consistency")
UnsupportedWorkbook = _kind("UnsupportedWorkbook", "unsupported_workbook_format")
MalformedWorkbook = _kind("MalformedWorkbook", "malformed_workbook")
ArchiveSafety = _kind("ArchiveSafety", "archive_safety_violation")
WorkbookLimitExceeded = _kind("WorkbookLimitExceeded", "workbook_limit_exceeded")
WorksheetSelectionRequired = _kind("WorksheetSelectionRequired", "worksheet_selection_required")
WorksheetNotFound = _kind("WorksheetNotFound", "worksheet_not_found")
NoUsableWorksheet = _kind("NoUsableWorksheet", "no_usable_worksheet")
EmptyWorksheet = _kind("EmptyWorksheet", "empty_worksheet")
UnsupportedWorksheet = _kind("UnsupportedWorksheet", "unsupported_worksheet_structure")
MalformedParquet = _kind("MalformedParquet", "malformed_parquet")
ParquetLimitExceeded = _kind("ParquetLimitExceeded", "parquet_limit_exceeded")
UnsupportedParquetSchema = _kind("UnsupportedParquetSchema", "unsupported_parquet_schema")
