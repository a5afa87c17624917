"""Time parsing for the compact and dotted log formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-digit years at or above this pivot are 19xx (as Python's %y).
TWO_DIGIT_YEAR_PIVOT = 69


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_compact_date(d: Column | str) -> Column:
    """Yymmdd whose leading zero may be lost -> TIMESTAMP at midnight.

    Values longer than six characters are NULL (the surveyed code raises).
    Spark reads 'yy' as 20yy, so years >= the pivot move back a century.
    """
    s = _c(d).cast("string")
    padded = F.lpad(s, 6, "0")
    parsed = F.try_to_timestamp(padded, F.lit("yyMMdd"))
    yy = F.substring(padded, 1, 2).cast("int")
    fixed = F.when(yy >= TWO_DIGIT_YEAR_PIVOT, F.add_months(parsed, -1200).cast("timestamp")) \
        .otherwise(parsed)
    return F.when(F.length(s) <= 6, fixed)


def compact_time_seconds(t: Column | str) -> Column:
    """HHMMSS whose leading zeros may be lost -> seconds of the day."""
    s = _c(t).cast("string")
    padded = F.lpad(s, 6, "0")
    secs = (F.substring(padded, 1, 2).cast("int") * 3600
            + F.substring(padded, 3, 2).cast("int") * 60
            + F.substring(padded, 5, 2).cast("int"))
    return F.when(F.length(s) <= 6, secs)


def parse_compact_datetime(d: Column | str, t: Column | str) -> Column:
    """C1 + C2: date + time of day."""
    day = parse_compact_date(d)
    return F.timestamp_seconds(F.unix_seconds(day) + compact_time_seconds(t))


def coerce_datetime(d: Column | str, t: Column | str,
                    fmt: str = "yyyy.MM.dd HH:mm:ss") -> Column:
    """C3: 'Date Time' parsed with a format; anything invalid becomes NULL."""
    return F.try_to_timestamp(F.concat_ws(" ", _c(d), _c(t)), F.lit(fmt))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch (works for TIMESTAMP and TIMESTAMP_NTZ in UTC)."""
    return F.unix_micros(_c(ts).cast("timestamp"))
