"""The Jalali date dimension, generated by Spark from a small table of years."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.buckets import saturday_start

FIRST_DAY = dt.date(1910, 1, 1)
LAST_DAY = dt.date(2100, 1, 1)

# Remainders modulo 33 of the leap years of the Jalali calendar.
_LEAP_REMAINDERS = (1, 5, 9, 13, 17, 22, 26, 30)
# Fixed value: Nowruz of the anchor year 1404.
_ANCHOR_YEAR, _ANCHOR_DAY = 1404, dt.date(2025, 3, 21)

# Dates the dimension must reproduce before it may be used.
ANCHORS = (
    (dt.date(1910, 1, 1), 1288, 10, 11, dt.date(1910, 1, 1)),
    (dt.date(2025, 3, 21), 1404, 1, 1, dt.date(2025, 3, 15)),
    (dt.date(2026, 9, 5), 1405, 6, 14, dt.date(2026, 9, 5)),
    (dt.date(2026, 9, 7), 1405, 6, 16, dt.date(2026, 9, 5)),
)


def _is_leap(year: int) -> bool:
    return year % 33 in _LEAP_REMAINDERS


def nowruz_days(first_year: int, last_year: int) -> list[tuple[int, dt.date]]:
    """First day of each Jalali year, counted from the anchor year."""
    days = {_ANCHOR_YEAR: _ANCHOR_DAY}
    for year in range(_ANCHOR_YEAR, last_year):
        days[year + 1] = days[year] + dt.timedelta(days=365 + _is_leap(year))
    for year in range(_ANCHOR_YEAR - 1, first_year - 1, -1):
        days[year] = days[year + 1] - dt.timedelta(days=365 + _is_leap(year))
    return [(year, days[year]) for year in range(first_year, last_year + 1)]


def _month(n: Column) -> Column:
    """Month of a zero-based day of the year: six of 31 days, then of 30."""
    return F.when(n < 186, F.floor(n / 31) + 1).otherwise(F.floor((n - 186) / 30) + 7).cast("int")


def _day_of_month(n: Column) -> Column:
    return F.when(n < 186, n % 31).otherwise((n - 186) % 30).cast("int") + 1


def build_jalali_calendar(
    spark: SparkSession, start: dt.date = FIRST_DAY, end: dt.date = LAST_DAY
) -> DataFrame:
    """One row per Gregorian day in ``[start, end]`` with its Jalali labels.

    Starts from one row per year; the days are exploded on the executors.
    """
    first_year, last_year = start.year - 622, end.year - 620
    starts = nowruz_days(first_year, last_year + 1)
    years = [(y, day, nxt) for (y, day), (_, nxt) in zip(starts, starts[1:])]
    table = spark.createDataFrame(years, "jalali_year int, year_start date, next_start date")
    day = F.col("gregorian_date")
    n = F.datediff(day, F.col("year_start"))
    return (
        table.select(
            "jalali_year",
            "year_start",
            F.explode(F.sequence("year_start", F.date_sub("next_start", 1))).alias("gregorian_date"),
        )
        .filter(day.between(F.lit(start), F.lit(end)))
        .select(
            "gregorian_date",
            "jalali_year",
            _month(n).alias("jalali_month"),
            _day_of_month(n).alias("jalali_day"),
            saturday_start(day).alias("jalali_week_start_date"),
            F.date_sub(day, _day_of_month(n) - 1).alias("jalali_month_start_date"),
            F.col("year_start").alias("jalali_year_start_date"),
        )
    )


def label_calendar(spark: SparkSession) -> DataFrame:
    """The dimension plus the days before it that its own buckets start on."""
    return build_jalali_calendar(spark, dt.date(1909, 3, 21), LAST_DAY)


def check_calendar(dim: DataFrame) -> DataFrame:
    """Return ``dim`` unchanged, or raise if an anchor date comes out wrong."""
    wanted = {a[0]: a[1:] for a in ANCHORS}
    found = {
        r["gregorian_date"]: (
            r["jalali_year"],
            r["jalali_month"],
            r["jalali_day"],
            r["jalali_week_start_date"],
        )
        for r in dim.filter(F.col("gregorian_date").isin(list(wanted))).collect()
    }
    if found != wanted:
        raise ValueError(f"calendar check failed: expected {wanted}, got {found}")
    return dim
