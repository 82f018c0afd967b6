"""Calendar parts, cyclic encoding and ages."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TURN = 2 * math.pi
# Age used when a birth date cannot be read, days in a mean year.
FALLBACK_AGE = 35.0
DAYS_PER_YEAR = 365.25
DATASET_YEAR = 2020


def txn_day(ts: Column) -> Column:
    return F.to_date(ts)


def parse_timestamp(text: Column) -> Column:
    """Timestamp or NULL; never an error under ANSI mode."""
    return text.try_cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    return text.try_cast("date")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970, the same number whatever the session time zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz"))


def as_instant(ts: Column) -> Column:
    """A wall-clock time as the instant it would be in UTC, whatever the session time zone."""
    return F.timestamp_micros(epoch_micros(ts))


def wall_clock(instant: Column) -> Column:
    """The inverse of `as_instant`."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), origin)


def _phase(part: Column, period: int) -> Column:
    return part.cast("double") * (TURN / period)


def cyclic_columns(ts: Column, decimal_hour: bool = False) -> dict[str, Column]:
    """Sine and cosine of hour, weekday (Monday 0) and month."""
    hour = F.hour(ts).cast("double")
    if decimal_hour:
        hour = hour + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    angles = {
        "hour": _phase(hour, 24),
        "weekday": _phase(F.weekday(ts), 7),
        "month": _phase(F.month(ts), 12),
    }
    return {
        f"{part}_{wave.__name__}": wave(angle)
        for part, angle in angles.items()
        for wave in (F.sin, F.cos)
    }


def decode_cycle(sine: Column, cosine: Column, period: int) -> Column:
    """The whole-number position in 0 .. period-1 that a sine/cosine pair encodes."""
    return F.pmod(_nearest(sine, cosine, period), F.lit(period))


def decode_month(sine: Column, cosine: Column) -> Column:
    """Month 1..12: December sits at angle zero."""
    month = F.pmod(_nearest(sine, cosine, 12), F.lit(12))
    return F.when(month == 0, F.lit(12)).otherwise(month)


def _nearest(sine: Column, cosine: Column, period: int) -> Column:
    turn = F.pmod(F.atan2(sine, cosine), F.lit(TURN))
    return F.bround(turn * (period / TURN), 0).cast("int")


def age(dob: Column, ts: Column | None = None, mode: str = "as_of_year", as_of_year: int = DATASET_YEAR) -> Column:
    """Age in years.

    as_of_year        a stated year minus the birth year (2020 by default; pass the
                      current year to get the wall-clock variant)
    transaction_year  year of the transaction minus the birth year
    elapsed           days lived at the transaction / 365.25, 35.0 when unreadable
    """
    if mode == "as_of_year":
        return F.lit(as_of_year) - F.year(dob)
    if ts is None:
        raise ValueError(f"age mode {mode!r} needs the transaction time")
    if mode == "transaction_year":
        return F.year(ts) - F.year(dob)
    if mode == "elapsed":
        return F.coalesce(F.datediff(F.to_date(ts), dob) / DAYS_PER_YEAR, F.lit(FALLBACK_AGE))
    raise ValueError(f"unknown age mode {mode!r}")
