"""CSV: strict, comma-delimited UTF-8 with a header. Uploaded bytes are checked whole on the driver; files of any size are read by the cluster."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.config import ResourceLimits
from tablepulse.operators.frame import Table
from tablepulse.sources import errors as E
from tablepulse.sources.common import Ingestion, check_count, check_loaded, check_names, check_size, display_name, logged
from tablepulse.sources.records import OpenQuote, records

BOM = b"\xef\xbb\xbf"
#: Text that stands for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")
INTEGER = r"^[ ]*[+-]?[0-9]+[ ]*$"
NUMBER = r"^[ ]*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ ]*$|^[ ]*[+-]?(?i:inf|infinity)[ ]*$"
_CORRUPT = "_corrupt"


def typed(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers, numbers, truth values or text: the first that all their values are. One pass decides for all.

    Dates stay text. Whole numbers beyond 64 bits are decimals up to 20 digits, else numbers."""
    columns = df.columns

    def facts(c: str) -> Column:
        v = _present(F.col(c))
        whole = v.rlike(INTEGER)
        return F.struct(F.count(v).alias("n"), F.count_if(whole & F.trim(v).try_cast("bigint").isNotNull()).alias("small"), F.count_if(whole & F.trim(v).try_cast("decimal(20,0)").isNotNull()).alias("whole"), F.count_if(v.rlike(NUMBER)).alias("number"), F.count_if(v.isin(*TRUE, *FALSE)).alias("truth")).alias(c)

    found = df.agg(*map(facts, columns)).first()

    def cast(c: str) -> Column:
        f, v = found[c], _present(F.col(c))
        if f.n == f.small:
            # a column without any value is one of missing numbers
            return (F.trim(v).try_cast("bigint") if f.n else F.lit(None).cast("double")).alias(c)
        if f.n == f.whole:
            return F.trim(v).try_cast("decimal(20,0)").alias(c)
        if f.n == f.number:
            return F.trim(v).try_cast("double").alias(c)
        if f.n == f.truth:
            return F.when(v.isNotNull(), v.isin(*TRUE)).alias(c)
        return v.alias(c)

    return df.select(*map(cast, columns))


def _present(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def validated_rows(content: bytes, limits: ResourceLimits) -> tuple[list[str], list[list[str]], str]:
    """(header, rows, encoding) of an upload; anything odd refuses it whole. Blank lines don't count, a quoted empty row does."""
    check_size(len(content), limits.source_bytes)
    encoding = "utf-8-sig" if content.startswith(BOM) else "utf-8"
    try:
        text = content.decode(encoding)
    except UnicodeDecodeError as error:
        raise E.InvalidEncoding("The source is not UTF-8.") from error
    if not text.strip():
        raise E.EmptySource("The source holds nothing.")
    if "\x00" in text:
        raise E.UnsupportedSource("The source holds NUL bytes, so it is no text.")
    rows: list[list[str]] = []
    header: list[str] | None = None
    try:
        for row in csv.reader(io.StringIO(text, newline=""), strict=True):
            if not row:
                continue
            if header is None:
                header = row
                check_count(None, len(header), limits)
                check_names(header)
                continue
            if len(row) != len(header):
                raise E.MalformedSource("Rows differ in width.")
            rows.append(row)
            check_count(len(rows), None, limits)
    except csv.Error as error:
        raise E.MalformedSource("Quotes or rows are malformed.") from error
    if header is None:
        raise E.EmptySource("The source holds nothing.")
    if not rows:
        raise E.NoDataRows("The source has a header but no rows.")
    return header, rows, encoding


def ingest_csv(spark: SparkSession, content: bytes, name: str = "unnamed.csv", limits: ResourceLimits | None = None) -> Ingestion:
    limits, shown = limits or ResourceLimits(), display_name(name, "unnamed.csv")

    def load() -> Ingestion:
        header, rows, encoding = validated_rows(content, limits)
        schema = ", ".join(f"_c{i} string" for i in range(len(header)))
        df = typed(spark.createDataFrame(rows, schema))
        n = check_loaded(df, len(rows), len(header))
        return Ingestion(Table(df, tuple(header)), n, "csv", shown, len(content), encoding)

    return logged("csv", shown, len(content), load)


def _unused(header: list[str]) -> str:
    """A name that no column has, whatever its case."""
    name, taken = _CORRUPT, {h.lower() for h in header}
    while name in taken:
        name += "_"
    return name


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> Ingestion:
    """CSV files of any size on any storage, by the same rules. Files are split; with multiline, fields may hold quoted line breaks.

    Rows of another width, bad quotes and files whose header differs from the others' are found in the pass that counts the rows."""
    shown = display_name(path, "unnamed.csv")

    def load() -> Ingestion:
        header, raw, wrong = _records(spark, path) if multiline else _lines(spark, path)
        values = [F.col(f"_c{i}") for i in range(len(header))]
        try:
            n, corrupt, odd = raw.agg(F.count("*"), F.count(_CORRUPT), F.count_if(wrong)).first()
        except Exception as error:
            if "CSV header does not conform" in str(error) or "Number of column in CSV header" in str(error):
                raise E.MalformedSource("Files differ in their headers.") from error
            raise
        if corrupt:
            raise E.MalformedSource("Rows differ in width or quotes are malformed.", rows=corrupt)
        # the replacement character may stand in the text itself, so the bytes decide
        if odd and (bad := odd if multiline else spark.read.text(path).where(~F.is_valid_utf8("value")).count()):
            raise E.InvalidEncoding("The source is not UTF-8.", rows=bad)
        if not n:
            raise E.NoDataRows("The source has a header but no rows.")
        return Ingestion(Table(typed(raw.select(*values)), tuple(header)), n, "csv", shown, None, "utf-8")

    return logged("csv", shown, None, load)


#: How rows are read, by either way.
_OPTIONS = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000"}


def _header(record: str) -> list[str]:
    try:
        header = next(csv.reader(io.StringIO(record.removeprefix("\ufeff"), newline=""), strict=True))
    except (csv.Error, StopIteration) as error:
        raise E.MalformedSource("The header is malformed.") from error
    check_names(header)
    return header


def _lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, Column]:
    """(header, rows and _CORRUPT, whether a row may hold bytes that are no UTF-8) of files whose records are lines."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not first:
        raise E.EmptySource("The source holds nothing.")
    header = _header(first[0].value)
    corrupt = _unused(header)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, corrupt)])
    # each file's header is held against the first one's
    raw = spark.read.csv(path, schema=schema, header=True, columnNameOfCorruptRecord=corrupt, enforceSchema=False, encoding="UTF-8", **_OPTIONS)
    named = raw.toDF(*(f"_c{i}" for i in range(len(header))), _CORRUPT)
    odd = F.lit(False)
    for i in range(len(header)):
        odd = odd | F.col(f"_c{i}").contains("\ufffd")  # what a byte that is no UTF-8 is read as
    return header, named, odd


def _records(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, Column]:
    """The same of files with quoted line breaks, cut at true record ends."""
    try:
        found = records(spark, path)
    except OpenQuote as error:
        raise E.MalformedSource("A file ends inside quotes.") from error
    text = F.regexp_replace(F.col("record").cast("string"), "\r$", "")
    headers = {tuple(_header(r.t)) for r in found.where("first").select(text.alias("t")).distinct().limit(100).collect()}
    if not headers:
        raise E.EmptySource("The source holds nothing.")
    if len(headers) > 1:
        raise E.MalformedSource("Files differ in their headers.")
    header = list(headers.pop())
    schema = ", ".join(f"_c{i} string" for i in range(len(header))) + f", {_CORRUPT} string"
    row = F.from_csv(text, schema, _OPTIONS | {"multiLine": "true", "columnNameOfCorruptRecord": _CORRUPT})
    rows = found.where("NOT first").select(row.alias("r"), (~F.is_valid_utf8(F.col("record").cast("string"))).alias("_wrong"))
    return header, rows.select("r.*", "_wrong"), F.col("_wrong")
