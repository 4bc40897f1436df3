"""Calendar buckets, day ranges and the tie-breaking order of ticks.

Buckets are plain dates: a Gregorian bucket is a UTC day, a Jalali bucket a
Tehran day. Everything here is a built-in expression, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schema import GREGORIAN, PRICE, TEHRAN


def utc_date(ts: Column) -> Column:
    return F.to_date(ts)


def tehran_date(ts: Column) -> Column:
    """Local calendar day in Tehran, daylight saving included."""
    return F.to_date(F.from_utc_timestamp(ts, TEHRAN))


def local_date(ts: Column, calendar: Column) -> Column:
    return F.when(calendar == GREGORIAN, utc_date(ts)).otherwise(tehran_date(ts))


def saturday_start(day: Column) -> Column:
    return F.date_sub(day, F.dayofweek(day) % 7)


def gregorian_bucket(day: Column, timeframe: str) -> Column:
    """Bucket start of a UTC day; weeks start on Monday."""
    if timeframe == "1d":
        return day
    unit = {"1w": "week", "1m": "month", "1y": "year"}[timeframe]
    return F.trunc(day, unit)


def jalali_bucket(day: Column, timeframe: str) -> Column:
    """Bucket start of a Tehran day, given the calendar row joined to it.

    Days and weeks need no calendar row; months and years take its labels.
    """
    if timeframe == "1d":
        return day
    if timeframe == "1w":
        return saturday_start(day)
    return {"1m": F.col("jalali_month_start_date"), "1y": F.col("jalali_year_start_date")}[timeframe]


def utc_day_range(ts: Column, first: dt.date, last: dt.date) -> Column:
    """``first <= UTC day of ts <= last`` as a half-open range on ``ts``."""
    return (ts >= F.lit(first).cast("timestamp")) & (
        ts < F.lit(last + dt.timedelta(days=1)).cast("timestamp")
    )


def tehran_day_range(ts: Column, first: dt.date, last: dt.date) -> Column:
    """``first <= Tehran day of ts <= last`` as a half-open range on ``ts``.

    The bounds fold to literals, so the range reaches the parquet scan; a
    function applied to ``ts`` itself would not.
    """
    lower = F.to_utc_timestamp(F.lit(first).cast("timestamp"), TEHRAN)
    upper = F.to_utc_timestamp(F.lit(last + dt.timedelta(days=1)).cast("timestamp"), TEHRAN)
    return (ts >= lower) & (ts < upper)


# --- order of ticks -------------------------------------------------------
#
# The opening tick is the earliest one, the lowest value winning among equal
# instants; the closing tick is the latest, the highest value winning. Packing
# (ts, value) into one decimal makes that a plain min / max over a fixed-width
# buffer: a hash aggregate, where a struct would force a sort. Values are
# positive and below 10^10, instants are whole milliseconds.

_SHIFT = 10**11


def _shift() -> Column:
    return F.lit(_SHIFT).cast("decimal(12,0)")


def pack_tick(ts: Column, value: Column) -> Column:
    """DECIMAL(37,8) ordered by instant, then by value."""
    return F.unix_millis(ts).cast("decimal(15,0)") * _shift() + value.cast(PRICE)


def packed_value(key: Column) -> Column:
    return F.pmod(key, _shift()).cast(PRICE)


def packed_ts(key: Column) -> Column:
    return F.timestamp_millis(F.floor(key / _shift()).cast("bigint"))


def symbol_bucket(symbol: Column, buckets: int) -> Column:
    """Storage bucket of a symbol; of a literal it folds to a literal."""
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")
