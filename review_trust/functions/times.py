"""Review times as integers, independent of the session time zone."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000
EPOCH = "1970-01-01 00:00:00"


def epoch_micros(df: DataFrame, name: str = "timestamp") -> Column:
    """Microseconds since 1970 of a column in epoch milliseconds or of a date/time type.

    Dates and times without a zone are read as UTC, whatever the session's zone.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("long") * 1000
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long") * MICROS_PER_DAY
    if isinstance(kind, T.TimestampNTZType):
        since = F.col(name) - F.lit(EPOCH).cast("timestamp_ntz")
        day, hour, minute, second = (F.extract(F.lit(part), since) for part in ("DAY", "HOUR", "MINUTE", "SECOND"))
        seconds = (day.cast("long") * 24 + hour) * 3600 + minute * 60
        return seconds * 1_000_000 + (second * 1_000_000).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp"))


def instant(df: DataFrame, micros: int | None, name: str = "timestamp") -> Column:
    """``micros`` since 1970, UTC, as a constant of the column's own type, which a file reader can compare."""
    kind = df.schema[name].dataType
    if micros is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.DateType):
        return F.lit(str(datetime.date(1970, 1, 1) + datetime.timedelta(micros // MICROS_PER_DAY))).cast("date")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(str(datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=micros))).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(micros))
    raise TypeError(f"no constant of type {kind.simpleString()}")


def utc_day(micros: Column) -> Column:
    """Number of the UTC calendar day."""
    day = F.lit(MICROS_PER_DAY)
    return F.call_function("div", micros - F.pmod(micros, day), day)


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour periods between two instants, which is not the calendar difference."""
    return F.call_function("div", end - start, F.lit(MICROS_PER_DAY))
