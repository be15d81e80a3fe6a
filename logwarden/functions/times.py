"""Time helpers. All event times are TIMESTAMP_NTZ holding UTC, so that range
filters reach the parquet reader and no session zone can shift a result."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F


def ts_lit(moment: datetime) -> Column:
    """Zone-less timestamp literal."""
    return F.expr(f"timestamp_ntz '{moment:%Y-%m-%d %H:%M:%S.%f}'")


def before(as_of: datetime, *, hours: float = 0, days: float = 0, minutes: float = 0) -> Column:
    """Literal ``as_of`` minus a span, clamped to a year when the span overflows."""
    try:
        return ts_lit(as_of - timedelta(hours=hours, days=days, minutes=minutes))
    except OverflowError:
        return ts_lit(as_of - timedelta(days=365))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def from_epoch_text(value: Column) -> Column:
    """Epoch number, numeric text or ISO text to a timestamp; anything else is null."""
    number = value.try_cast("double")
    return F.coalesce(
        F.timestamp_micros(F.round(number * 1_000_000).cast("bigint")).cast("timestamp_ntz"),
        value.try_cast("timestamp_ntz"),
    )


def from_access_stamp(value: Column) -> Column:
    """``dd/Mon/yyyy:HH:mm:ss +zzzz`` with the offset left out of account."""
    return F.try_to_timestamp(F.split(value, " ")[0], F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz")


def from_syslog_stamp(value: Column, year: int) -> Column:
    """``Mon d HH:mm:ss`` in the given year; one or two blanks before the day."""
    text = F.concat(F.lit(f"{year} "), F.regexp_replace(value, r"\s+", " "))
    return F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")
