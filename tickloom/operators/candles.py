"""Candles as mergeable states: build, merge, roll up, label, format."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.buckets import (
    gregorian_bucket,
    jalali_bucket,
    local_date,
    pack_tick,
    packed_ts,
    packed_value,
    tehran_date,
    utc_date,
)
from tickloom.functions.text import format_bucket, format_decimal
from tickloom.schema import GREGORIAN, JALALI, STATE_KEYS, STATE_MEASURES, TIMEFRAMES, TOTAL

_MEASURES = STATE_MEASURES.fieldNames()
_LABELS = ("jalali_year", "jalali_month", "jalali_day")


def _check_timeframe(timeframe: str) -> None:
    if timeframe not in TIMEFRAMES:
        raise ValueError("timeframe must be one of " + ", ".join(TIMEFRAMES))


def aggregate_ticks(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of raw ticks per ``keys``: one partial and one final hash aggregate."""
    return (
        ticks.withColumn("tick", pack_tick(F.col("ts"), F.col("value")))
        .groupBy(*keys)
        .agg(
            F.min("tick").alias("first_tick"),
            F.max("tick").alias("last_tick"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.sum(F.col("volume").cast(TOTAL)).cast(TOTAL).alias("volume"),
            F.count(F.lit(1)).alias("ticks"),
        )
    )


def merge_states(
    states: DataFrame, keys: Sequence[str] = STATE_KEYS, *more: Column
) -> DataFrame:
    """Combine states of equal keys, in any order and any number of times.

    ``more`` are further aggregates over the states of a key.
    """
    return states.groupBy(*keys).agg(
        F.min("first_tick").alias("first_tick"),
        F.max("last_tick").alias("last_tick"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").cast(TOTAL).alias("volume"),
        F.sum("ticks").alias("ticks"),
        *more,
    )


def open_close(states: DataFrame) -> DataFrame:
    """Add what the packed ticks hold: open and close, each with its instant."""
    first, last = F.col("first_tick"), F.col("last_tick")
    return states.withColumns(
        {
            "open": packed_value(first),
            "open_ts": packed_ts(first),
            "close": packed_value(last),
            "close_ts": packed_ts(last),
        }
    )


def with_calendar_row(df: DataFrame, day: Column, dim: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Left join of the date dimension; its size is fixed by the calendar range."""
    row = dim.select(F.col("gregorian_date").alias("_day"), *columns)
    return df.join(F.broadcast(row), day == F.col("_day"), "left").drop("_day")


def candle_states(
    ticks: DataFrame, calendar: str, timeframe: str, dim: DataFrame | None = None
) -> DataFrame:
    """States of one calendar and timeframe straight from ticks.

    Jalali months and years need ``dim``. Ticks on days it does not cover have
    no bucket there and are left to :func:`uncovered_ticks`.
    """
    _check_timeframe(timeframe)
    routed = ticks.filter(F.col("calendar") == calendar)
    if calendar == GREGORIAN:
        bucket = gregorian_bucket(utc_date(F.col("ts")), timeframe)
    else:
        day = tehran_date(F.col("ts"))
        if timeframe in ("1m", "1y"):
            column = {"1m": "jalali_month_start_date", "1y": "jalali_year_start_date"}[timeframe]
            if dim is None:
                raise ValueError("Jalali months and years need the date dimension")
            routed = with_calendar_row(routed, day, dim, [column]).filter(F.col(column).isNotNull())
        bucket = jalali_bucket(day, timeframe)
    # calendar and timeframe are constants here, so the key stays two columns
    states = aggregate_ticks(routed.withColumn("bucket_start", bucket), ["symbol", "bucket_start"])
    return states.select(
        "symbol",
        F.lit(calendar).alias("calendar"),
        F.lit(timeframe).alias("timeframe"),
        "bucket_start",
        *_MEASURES,
    )


def uncovered_ticks(ticks: DataFrame, dim: DataFrame) -> DataFrame:
    """Jalali ticks on days outside the dimension: in no month or year candle."""
    jalali = ticks.filter(F.col("calendar") == JALALI)
    days = F.broadcast(dim.select(F.col("gregorian_date").alias("_day")))
    return jalali.join(days, tehran_date(F.col("ts")) == F.col("_day"), "left_anti")


def day_states(ticks: DataFrame) -> DataFrame:
    """Day states of both calendars in one pass over the ticks."""
    keyed = ticks.withColumn("bucket_start", local_date(F.col("ts"), F.col("calendar")))
    states = aggregate_ticks(keyed, ["symbol", "calendar", "bucket_start"])
    return states.select(
        "symbol", "calendar", F.lit("1d").alias("timeframe"), "bucket_start", *_MEASURES
    )


def rebucket(
    days: DataFrame, dim: DataFrame, timeframes: Sequence[str] = TIMEFRAMES, more: Sequence[str] = ()
) -> DataFrame:
    """Every day state once per timeframe, under its coarser bucket, not yet merged; ``more`` columns are kept."""
    for timeframe in timeframes:
        _check_timeframe(timeframe)
    day = F.col("bucket_start")
    labelled = days
    if set(timeframes) & {"1m", "1y"}:
        labelled = with_calendar_row(
            days, day, dim, ["jalali_month_start_date", "jalali_year_start_date"]
        )
    targets = [
        F.struct(
            F.lit(tf).alias("timeframe"),
            F.when(F.col("calendar") == GREGORIAN, gregorian_bucket(day, tf))
            .otherwise(jalali_bucket(day, tf))
            .alias("bucket_start"),
        )
        for tf in timeframes
    ]
    target = F.explode(F.array(*targets)) if len(targets) > 1 else targets[0]
    repeated = labelled.select(
        "symbol", "calendar", target.alias("target"), *_MEASURES, *more
    ).select("symbol", "calendar", "target.timeframe", "target.bucket_start", *_MEASURES, *more)
    return repeated.filter(F.col("bucket_start").isNotNull())


def rollup(
    days: DataFrame, dim: DataFrame, timeframes: Sequence[str] = TIMEFRAMES
) -> DataFrame:
    """Day states of both calendars rolled up to ``timeframes``.

    One scan and one shuffle serve all timeframes. Several are merged where the days of a symbol
    lie together, a day once: shuffled by bucket, a day would go once for each timeframe, as tasks hold too few days of
    a symbol to collapse. A single timeframe merges before the shuffle what it can.
    """
    if len(timeframes) > 1:
        days = days.repartition("symbol", "calendar")
    return merge_states(rebucket(days, dim, timeframes))


def finish(states: DataFrame, *more: str) -> DataFrame:
    """Drop what only merging needs: the candle as it is served, and ``more``."""
    return open_close(states).select(
        *STATE_KEYS,
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.col("ticks").alias("tick_count"),
        *more,
    )


def with_jalali_labels(candles: DataFrame, labels: DataFrame) -> DataFrame:
    """Year, month and day of each Jalali bucket; NULL on Gregorian rows."""
    joined = with_calendar_row(candles, F.col("bucket_start"), labels, _LABELS)
    keep = F.col("calendar") == JALALI
    return joined.withColumns({c: F.when(keep, F.col(c)) for c in _LABELS})


def format_candles(candles: DataFrame) -> DataFrame:
    """Result strings: fixed eight-digit decimals, bucket by calendar."""
    strings = {c: format_decimal(F.col(c)) for c in ("open", "high", "low", "close", "volume")}
    strings["bucket_start"] = format_bucket(F.col("bucket_start"), F.col("calendar"))
    return candles.withColumns(strings)
