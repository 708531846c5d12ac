"""Identifiers: UUID spelling, deterministic ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x{00A0}\x{2000}-\x{200B}\x{3000}\x{FEFF}]*"
#: One group: the 8-4-4-4-12 digits, whatever blanks, braces or urn prefix stand around them.
UUID_PATTERN = (
    rf"^{_BLANK}\{{?{_BLANK}(?:urn:uuid:)?{_BLANK}\{{?{_BLANK}"
    r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    rf"{_BLANK}\}}?{_BLANK}\}}?{_BLANK}$"
)


def uuid_of(c: Column | str) -> Column:
    """The UUID that a text spells, in lower case; null where it spells none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(F.lower(c), UUID_PATTERN, 1), F.lit(""))


def uuid_sql(expr: str) -> str:
    """The same in DuckDB's SQL."""
    return f"nullif(regexp_extract(lower({expr}), '{UUID_PATTERN}', 1), '')"


def row_key(c: Column | str) -> Column:
    """UUID where it is one, else the trimmed lower-case text: the name of a row itself."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(uuid_of(c), F.lower(F.trim(c)))


def utc_month(ts: Column) -> Column:
    """``yyyy-MM`` in UTC, whatever the session's time zone."""
    return F.date_format(F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int")), "yyyy-MM")


def utc_day(ts: Column) -> Column:
    """Calendar day in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))
