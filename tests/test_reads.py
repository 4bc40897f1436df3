from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import reads as R


@pytest.mark.parametrize(
    "text,day",
    [("2026-09-02", 2), ("2026-09-02T23:59:59", 2), ("2026-09-02T23:59:59Z", 2),
     (" 2026-09-02T23:59:59.123456789-11:00 ", 2), ("2026-09-02T00:00:00+23:59", 2)],
)
def test_bounds_are_taken_as_written(text, day):
    assert R.parse_range(text, "2026-12-31").first == dt.date(2026, 9, day)


@pytest.mark.parametrize("text", ["2026-9-2", "02/09/2026", "2026-09-31", "2026-09-02 10:00:00", "2026-09-02T25:00:00", "2026-09-02T10:00"])
def test_bad_bounds(text):
    with pytest.raises(R.ArgumentError, match="from must be a valid date"):
        R.parse_range(text, "2026-12-31")


def test_missing_and_reversed_bounds():
    with pytest.raises(R.ArgumentError, match="to is required"):
        R.parse_range("2026-09-02", " ")
    with pytest.raises(R.ArgumentError, match="before or equal"):
        R.parse_range("2026-09-02T10:00:00Z", "2026-09-02T09:00:00Z")
    # one instant written in two zones: no earlier, though its day is
    days = R.parse_range("2026-09-02T01:00:00+03:00", "2026-09-01T22:00:00Z")
    assert days.first > days.last


@pytest.mark.parametrize("page,limit", [(0, 1), (-1, 1), (1, 0), (1, 1001), ("1", 1), (True, 1)])
def test_page_arguments(page, limit):
    with pytest.raises(R.ArgumentError):
        R.check_page(page, limit)


def test_page_defaults():
    assert R.check_page(None, None) == (1, 1000)
    assert R.check_page(7, 5000, max_limit=5000) == (7, 5000)


def test_timeframes():
    with pytest.raises(R.ArgumentError):
        R.check_timeframe("5m")


@pytest.mark.parametrize("symbols", [[], [""], ["a", ""]])
def test_symbols_are_required(symbols):
    with pytest.raises(R.ArgumentError):
        R.symbols_predicate(symbols)


@pytest.mark.parametrize(
    "page,limit,rows,more", [(1, 10, 10, True), (2, 10, 10, True), (3, 10, 5, False), (1, 25, 25, False), (1, 24, 24, True), (9, 10, 0, False)]
)
def test_pages(spark, page, limit, rows, more):
    found = R.page_of(spark.range(25), ["id"], page, limit)
    assert [r["id"] for r in found.rows.collect()] == list(range(25))[(page - 1) * limit :][:limit]
    assert tuple(found.metadata.first()) == (page, limit, more, rows)


def test_keyset_pages_visit_every_row_once(spark):
    rows = spark.range(23).select((F.col("id") % 4).alias("a"), F.col("id").alias("b"))
    seen, after = [], None
    while True:
        found = (
            R.page_of(rows, ["a", "b"], 1, 5) if after is None else R.page_after(rows, ["a", "b"], after, 5)
        )
        part = [tuple(r) for r in found.rows.collect()]
        seen += part
        if not found.metadata.first()["has_more"]:
            break
        after = part[-1]
    assert seen == sorted((i % 4, i) for i in range(23))


def test_candles_of_an_earlier_start_are_left_out(spark):
    states = spark.sql("SELECT date '2026-08-31' AS bucket_start UNION ALL SELECT date '2026-09-07'")
    assert R.candles_in_range(states, R.parse_range("2026-09-01", "2026-09-07")).count() == 1


def test_page_plan_takes_ordered_rows_only(spark):
    rows = R.page_of(spark.range(100), ["id"], 3, 10).rows
    assert "TakeOrderedAndProject" in rows._jdf.queryExecution().executedPlan().toString()


def test_ranges_and_routes_reach_the_scan(spark, folder):
    path = folder + "/ticks"
    spark.sql(
        "SELECT 'a' AS symbol, calendar, timestamp '2024-01-05 20:30:00' AS ts"
        " FROM VALUES ('gregorian'), ('jalali') AS t(calendar)"
    ).write.partitionBy("calendar").parquet(path)
    ticks = spark.read.parquet(path)
    days = R.parse_range("2024-01-06", "2024-01-06")
    assert [r["calendar"] for r in R.ticks_in_range(ticks, days).collect()] == ["jalali"]
    wanted = R.ticks_in_range(ticks.filter(R.route_predicate({"a": "jalali"})), days)
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("\n")[0]
    assert "GreaterThanOrEqual(ts,2024-01-05 20:30:00" in pushed and "EqualTo(symbol,a)" in pushed
    assert "(calendar" in plan.split("PartitionFilters: ")[1].split("DataFilters")[0]
    assert wanted.count() == 1 and ticks.filter(R.route_predicate({})).count() == 0


@pytest.mark.parametrize("skip,rows", [(0, 1), (0, 30), (7, 5), (24, 6), (25, 100), (29, 1), (30, 1), (99, 5)])
def test_a_span_holds_exactly_the_rows_of_a_page(spark, skip, rows):
    """Thirty rows of three symbols over days of uneven size."""
    sizes = {("a", 1): 3, ("a", 2): 0, ("a", 5): 10, ("b", 2): 1, ("c", 1): 6, ("c", 9): 10}
    day = lambda d: dt.date(2026, 1, d)
    counts = spark.createDataFrame([(s, day(d), n) for (s, d), n in sizes.items()], "symbol string, day date, n long")
    every = [(s, day(d), i) for (s, d), n in sorted(sizes.items()) for i in range(n)]
    table = spark.createDataFrame(every, "symbol string, day date, i int")
    span = R.page_span(counts.unionByName(counts.limit(0)), skip, rows)
    if skip >= 30:
        assert span is None
        return
    near = sorted(tuple(r) for r in table.filter(R.in_span(span, F.col("day"))).collect())
    assert near[span.skip :][:rows] == every[skip : skip + rows]
    # no more than the days the page begins and ends in
    assert len(near) <= rows + 20 and (skip, rows) != (24, 6) or len(near) == 10


def test_newest_days(spark):
    counts = spark.sql("SELECT date_add(date '2026-01-01', CAST(id AS INT)) AS day, id % 3 AS n FROM range(10)")
    assert R.newest_days(counts, 1) == dt.date(2026, 1, 9) and R.newest_days(counts, 3) == dt.date(2026, 1, 8)
    assert R.newest_days(counts, 99) == dt.date(2026, 1, 2) and R.newest_days(counts.limit(0), 5) is None
