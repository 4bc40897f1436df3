from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions.buckets import (
    gregorian_bucket,
    saturday_start,
    tehran_date,
    tehran_day_range,
    utc_date,
    utc_day_range,
)
from tickloom.functions.jalali import (
    build_jalali_calendar,
    check_calendar,
    label_calendar,
    nowruz_days,
)


@pytest.fixture(scope="module")
def dim(spark):
    return build_jalali_calendar(spark).cache()


def test_range_and_anchors(dim):
    check_calendar(dim)
    first, last, n = dim.agg(
        F.min("gregorian_date"), F.max("gregorian_date"), F.count_distinct("gregorian_date")
    ).first()
    assert (first, last, n, dim.count()) == (dt.date(1910, 1, 1), dt.date(2100, 1, 1), 69398, 69398)


def test_a_wrong_dimension_is_refused(dim):
    with pytest.raises(ValueError):
        check_calendar(dim.withColumn("jalali_day", F.col("jalali_day") + 1))


def test_years_months_and_days_follow_each_other(spark):
    lengths = [
        (b - a).days for (_, a), (_, b) in zip(nowruz_days(1288, 1479), nowruz_days(1289, 1480))
    ]
    assert set(lengths) == {365, 366}
    dim = label_calendar(spark)
    months = dim.groupBy("jalali_year", "jalali_month").agg(
        F.count("*").alias("n"),
        F.min("gregorian_date").alias("first"),
        F.min("jalali_month_start_date").alias("a"),
        F.max("jalali_month_start_date").alias("b"),
        F.max("jalali_day").alias("last_day"),
    )
    whole = months.filter(F.col("jalali_year") < 1478)
    assert whole.filter((F.col("first") != F.col("a")) | (F.col("a") != F.col("b"))).count() == 0
    assert whole.filter(F.col("n") != F.col("last_day")).count() == 0
    by_month = whole.groupBy("jalali_month").agg(F.collect_set("n").alias("n")).collect()
    lengths = {r["jalali_month"]: set(r["n"]) for r in by_month}
    assert all(lengths[m] == {31} for m in range(1, 7))
    assert all(lengths[m] == {30} for m in range(7, 12))
    assert lengths[12] == {29, 30}


def test_edges_have_starts_before_the_range(dim):
    row = dim.filter(F.col("gregorian_date") == "1910-01-01").first()
    assert row["jalali_month_start_date"] == dt.date(1909, 12, 22)
    assert row["jalali_year_start_date"] == dt.date(1909, 3, 21)


def test_saturday_weeks(spark):
    days = [(dt.date(2026, 9, 5) + dt.timedelta(days=i),) for i in range(14)]
    rows = spark.createDataFrame(days, "d date").select("d", saturday_start(F.col("d")).alias("w"))
    for row in rows.collect():
        assert row["w"].weekday() == 5 and 0 <= (row["d"] - row["w"]).days < 7


def test_gregorian_buckets(spark):
    row = (
        spark.sql("SELECT timestamp '2026-09-06 23:59:59.999' AS ts")
        .select(*(gregorian_bucket(utc_date(F.col("ts")), t).cast("string") for t in ("1d", "1w", "1m", "1y")))
        .first()
    )
    assert tuple(row) == ("2026-09-06", "2026-08-31", "2026-09-01", "2026-01-01")


def test_tehran_day_has_daylight_saving(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (timestamp '2020-07-01 19:29:59'), (timestamp '2020-07-01 19:30:00'),"
        " (timestamp '2024-07-01 20:29:59'), (timestamp '2024-07-01 20:30:00') AS t(ts)"
    ).select(tehran_date(F.col("ts")).cast("string").alias("d"))
    assert [r["d"] for r in rows.collect()] == ["2020-07-01", "2020-07-02", "2024-07-01", "2024-07-02"]


@pytest.mark.parametrize("first,last", [("2020-03-20", "2020-03-22"), ("2021-09-20", "2021-09-23"), ("1977-10-20", "1977-10-22"), ("2024-03-01", "2024-03-02")])
def test_day_ranges_equal_the_date_tests(spark, first, last):
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    ts = spark.sql(
        f"SELECT explode(sequence(timestamp '{first}' - interval 3 days, timestamp '{last}' + interval 3 days,"
        " interval 10 minutes)) AS ts"
    )
    day = F.col("ts")
    wrong = ts.filter(
        (tehran_day_range(day, a, b) != tehran_date(day).between(F.lit(a), F.lit(b)))
        | (utc_day_range(day, a, b) != utc_date(day).between(F.lit(a), F.lit(b)))
    )
    assert wrong.count() == 0
