"""Dates in text: two grammars, one for guessing a column's type and one for its statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import UTC, date, datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablepulse.functions.text import ISO_DATE, SLASH_DATE

#: The orders in which a date with slashes may be read.
SLASH_ORDERS = ("%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d")
_ISO, _SLASH = re.compile(ISO_DATE, re.ASCII), re.compile(SLASH_DATE, re.ASCII)


def iso(value: str) -> datetime | None:
    try:
        return datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        pass
    try:
        return datetime.combine(date.fromisoformat(value), datetime.min.time())
    except ValueError:
        return None


def slash(value: str) -> list[datetime]:
    """Every reading of a date with slashes."""
    out = []
    for order in SLASH_ORDERS:
        try:
            out.append(datetime.strptime(value, order))
        except ValueError:
            continue
    return out


class DateShare(NamedTuple):
    parse_rate: float
    date_like: int
    ambiguous: bool


def date_share(values: Iterable[str]) -> DateShare:
    """For guessing: how many values parse, how many look like dates, and whether any can be read in two orders."""
    total = parsed = like = 0
    ambiguous = False
    for raw in values:
        total += 1
        value = raw.strip()
        if _ISO.fullmatch(value):
            like += 1
            parsed += iso(value) is not None
        elif _SLASH.fullmatch(value):
            like += 1
            readings = slash(value)
            parsed += bool(readings)
            ambiguous |= len(readings) > 1
    return DateShare(parsed / total if total else 0.0, like, ambiguous)


def read(value: str) -> tuple[datetime | None, bool]:
    """For statistics: the time, or that the value stands for more than one date."""
    value = value.strip()
    if "/" not in value:
        return iso(value), False
    readings = slash(value)
    if len({r.date() for r in readings}) > 1:
        return None, True
    return (readings[0] if readings else None), False


def read_text(c: Column) -> Column:
    return F.pandas_udf(read_series, "struct<state:string,micros:long>")(c)


def read_series(values: pd.Series) -> pd.DataFrame:
    """state naive, aware, ambiguous or unparsed; micros since 1970 (aware: in UTC). Meant for distinct values."""
    rows = []
    for value in values:
        if value is None:
            rows.append((None, None))
            continue
        parsed, ambiguous = read(value)
        if parsed is None:
            rows.append(("ambiguous" if ambiguous else "unparsed", None))
            continue
        aware = parsed.utcoffset() is not None
        try:
            gap = (parsed if aware else parsed.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
        except OverflowError:
            rows.append(("unparsed", None))
            continue
        rows.append(("aware" if aware else "naive", (gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds))
    return pd.DataFrame(rows, columns=["state", "micros"]).astype({"micros": "Int64"})


def iso_text(micros: int | None, aware: bool) -> str | None:
    """Micros since 1970 as an ISO time."""
    if micros is None:
        return None
    days, rest = divmod(micros, 86_400_000_000)
    moment = datetime.fromordinal(date(1970, 1, 1).toordinal() + days).replace(hour=rest // 3_600_000_000, minute=rest // 60_000_000 % 60, second=rest // 1_000_000 % 60, microsecond=rest % 1_000_000)
    return (moment.replace(tzinfo=UTC) if aware else moment).isoformat()


def native_micros(c: Column, dtype: str) -> Column:
    """A date or timestamp column as micros since 1970."""
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if dtype == "date":
        return F.unix_date(c).cast("long") * 86_400_000_000
    return F.unix_micros(c)
