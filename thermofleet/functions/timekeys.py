"""Time keys: five-minute rounding, local hours, day harmonics, hour windows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_timestamp(ts: Column) -> Column:
    """Session-zone timestamp; parquet files written without a zone load as TIMESTAMP_NTZ."""
    return ts.cast("timestamp")


def round5(ts: Column) -> Column:
    """Nearest five-minute mark of the whole minute (seconds dropped first; 58 rolls into the next hour)."""
    minute = F.floor(F.unix_seconds(ts) / 60)
    return F.timestamp_seconds(F.floor((minute + 2) / 5) * 300)


def floor_to(ts: Column, step_seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step_seconds) * step_seconds)


def add_seconds(ts: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def local_hour(ts: Column, zone: Column | str) -> Column:
    """Hour of day in an IANA zone; the session zone is UTC."""
    return F.hour(F.from_utc_timestamp(ts, zone))


def day_harmonics(ts: Column, zone: Column | str) -> dict[str, Column]:
    """sin/cos of the fractional local hour at 24 h and 12 h periods."""
    local = F.from_utc_timestamp(ts, zone)
    angle = (F.hour(local) + F.minute(local) / 60.0) * F.lit(2 * math.pi / 24)
    return {
        "tod_sin1": F.sin(angle),
        "tod_cos1": F.cos(angle),
        "tod_sin2": F.sin(angle * 2),
        "tod_cos2": F.cos(angle * 2),
    }


def hour_in_window(hour: Column, start: Column | int, end: Column | int) -> Column:
    """`[start, end)`; a start after the end wraps midnight."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    return F.when(start <= end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))
