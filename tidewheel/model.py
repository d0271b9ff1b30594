"""The record type, durations and defaults shared by every tier."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (key, value, ts) and the arrival number.
EVENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("seq", T.LongType())])

DEFAULT_PARALLELISM = 1
DEFAULT_CAPACITY = 16
DEFAULT_BOUND = timedelta(seconds=5)
#: The clock of an ended stream: later than any window.
END_OF_TIME = datetime(9999, 12, 31, 23, 59, 59)

_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def micros(duration: timedelta | int | float | str) -> int:
    """A duration in microseconds: a timedelta, seconds, or text like `250ms`,
    `1h30m`, `10 minutes`."""
    if isinstance(duration, timedelta):
        return (duration.days * 86_400 + duration.seconds) * 1_000_000 + duration.microseconds
    if isinstance(duration, (int, float)):
        return round(duration * 1_000_000)
    import re

    names = {"microsecond": "us", "millisecond": "ms", "second": "s", "sec": "s", "minute": "m", "min": "m", "hour": "h", "day": "d"}
    found = re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-z]+)", duration.strip().lower())
    if not found or re.sub(r"(-?\d+(?:\.\d+)?)\s*([a-z]+)|\s", "", duration.strip().lower()):
        raise ValueError(f"not a duration: {duration!r}")
    total = 0.0
    for number, unit in found:
        unit = names.get(unit.rstrip("s") if len(unit) > 2 else unit, unit)
        if unit not in _UNITS:
            raise ValueError(f"not a duration: {duration!r}")
        total += float(number) * _UNITS[unit]
    return round(total)


def epoch_us(ts) -> "F.Column":
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def from_us(us) -> "F.Column":
    """A zone-less timestamp from microseconds; sessions run in UTC."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def events(frame: DataFrame, key, value, ts, seq) -> DataFrame:
    """Bind any columns or expressions to the canonical event columns. This is
    map and keyBy at once; both stay expressions, so filters and projections
    reach the scan."""
    as_column = lambda x: F.expr(x) if isinstance(x, str) else x
    return frame.select(as_column(key).cast("string").alias("key"), as_column(value).cast("string").alias("value"), as_column(ts).cast("timestamp_ntz").alias("ts"), as_column(seq).cast("long").alias("seq"))
