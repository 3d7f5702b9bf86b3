"""Calendar parts of a date-time (F1, F2) and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def year_int(c: Column) -> Column:
    return F.year(c).cast("int")


def month_int(c: Column) -> Column:
    return F.month(c).cast("int")


# Text parts are built from the calendar fields of the zone-free value, not
# with date_format: that would convert a timestamp_ntz through the session
# time zone and back, which shifts wall-clock times inside DST gaps of a
# non-UTC session.


def year_text(c: Column) -> Column:
    """``'2025'`` (four digits, zero-padded)."""
    return F.lpad(F.year(c).cast("string"), 4, "0")


def month_text(c: Column) -> Column:
    """Zero-padded ``'01'`` .. ``'12'``."""
    return F.lpad(F.month(c).cast("string"), 2, "0")


def year_month_text(c: Column) -> Column:
    """``'2025-01'``."""
    return month_key_text(F.year(c), F.month(c))


def month_key_text(year: Column, month: Column) -> Column:
    """``'2025-01'`` from integer year and month (NULL if either is NULL)."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def datetime_text(c: Column) -> Column:
    """``'2025-01-16 15:00:00'``, with the fraction of a second where there is one."""
    return c.cast("timestamp_ntz").cast("string")


# 'YYYY-MM-DD', optionally followed by ' HH:MM[:SS[.fff...]]' (or 'T' instead of
# the space) and 'Z' or an offset '+HH:MM': the date shapes of SQLite's date functions.
_DATETIME_RX = (r"^(\d{4})-(\d{2})-(\d{2})"
                r"(?:(?: +|T)(\d{2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)(?:(?<=\.\d{6})\d+)?)?(?: *(?:[Zz]|([+-])(\d{2}):(\d{2})))?)?$")
# The plain ones among them, which a cast reads alike; a second of 60 is left to the fields.
_PLAIN_RX = r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:[0-5]\d)?\z"


def parse_datetime(c: Column) -> Column:
    """Text to ``timestamp_ntz``; unparsable text or an impossible date gives
    NULL, never an error.  Digits beyond microseconds are cut; a time with an
    offset becomes the time at Greenwich, as SQLite takes it.  Built from the fields, so no time zone is involved
    (parsing to a zoned timestamp and casting back would move wall-clock
    times that fall in a DST gap of the session zone).  The plain shapes, a day or a day
    and a time in seconds, are cast: the fields cost a match each."""
    text = F.trim(c.cast("string"))

    def part(i: int, typ: str = "int") -> Column:
        return F.nullif(F.regexp_extract(text, _DATETIME_RX, i), F.lit("")).try_cast(typ)

    ts = F.try_make_timestamp_ntz(
        part(1), part(2), part(3),
        F.coalesce(part(4), F.lit(0)), F.coalesce(part(5), F.lit(0)),
        F.coalesce(part(6, "decimal(8,6)"), F.lit(0).cast("decimal(8,6)")),
    )
    hours, minutes = part(8), part(9)
    ahead = F.make_dt_interval(hours=hours, mins=minutes)
    moved = F.when(part(7, "string") == "-", ts + ahead).otherwise(ts - ahead)
    ts = F.when(hours.isNull(), ts).when((hours <= 14) & (minutes <= 59), moved)
    return F.when(text.rlike(_PLAIN_RX), text.try_cast("timestamp_ntz")).when(text.rlike(_DATETIME_RX), ts)


def ts_literal(value: str) -> Column:
    """A ``timestamp_ntz`` literal from ``'YYYY-MM-DD[ HH:MM:SS]'``."""
    fmt = DATETIME_FORMAT if len(value) > 10 else "yyyy-MM-dd"
    return F.to_timestamp_ntz(F.lit(value), F.lit(fmt))
