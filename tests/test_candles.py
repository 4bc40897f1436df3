from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.functions.buckets import pack_tick, packed_ts, packed_value
from tickloom.functions.jalali import build_jalali_calendar, label_calendar
from tickloom.operators import candles as C
from tickloom.schema import CALENDARS, GREGORIAN, JALALI, TICKS, TIMEFRAMES

UTC = dt.timezone.utc


def make_ticks(spark, n=400, seed=7):
    rng = random.Random(seed)
    start = dt.datetime(2019, 11, 1, tzinfo=UTC)
    rows = []
    for _ in range(n):
        calendar = rng.choice(CALENDARS)
        rows.append(
            (
                f"{calendar[0]}{rng.randrange(3)}",
                calendar,
                Decimal(rng.randrange(1, 10**6)).scaleb(-3),
                Decimal(rng.randrange(1, 10**4)).scaleb(-2),
                start + dt.timedelta(hours=rng.randrange(24 * 500)),  # many equal instants
            )
        )
    return spark.createDataFrame(rows, TICKS)


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def brute(rows):
    """Open, high, low, close, volume and count of a list of (ts, value, volume)."""
    first, last = min(r[:2] for r in rows), max(r[:2] for r in rows)
    values = [r[1] for r in rows]
    return first[1], max(values), min(values), last[1], sum(r[2] for r in rows), len(rows)


def test_candles_match_brute_force(spark):
    ticks = make_ticks(spark)
    got = C.finish(C.day_states(ticks)).filter(F.col("calendar") == GREGORIAN).collect()
    groups = {}
    for r in ticks.filter(F.col("calendar") == GREGORIAN).selectExpr("*", "date(ts) d").collect():
        groups.setdefault((r["symbol"], r["d"]), []).append((r["ts"], r["value"], r["volume"]))
    assert {
        (r["symbol"], r["bucket_start"]): (r["open"], r["high"], r["low"], r["close"], r["volume"], r["tick_count"])
        for r in got
    } == {key: brute(rows) for key, rows in groups.items()}


def test_any_split_merges_to_the_same_states(spark):
    ticks = make_ticks(spark)
    whole = rows_of(C.day_states(ticks))
    parts = [ticks.filter(F.pmod(F.hash("ts", "value"), F.lit(3)) == i) for i in range(3)]
    states = [C.day_states(p) for p in (parts[2], parts[0], parts[1])]
    merged = C.merge_states(states[0].unionByName(states[1]).unionByName(states[2]))
    assert rows_of(merged) == whole
    assert rows_of(C.merge_states(merged)) == whole


@pytest.mark.parametrize("calendar", CALENDARS)
@pytest.mark.parametrize("timeframe", TIMEFRAMES)
def test_rollup_equals_direct(spark, calendar, timeframe):
    ticks, dim = make_ticks(spark), label_calendar(spark)
    direct = C.candle_states(ticks, calendar, timeframe, dim)
    rolled = C.rollup(C.day_states(ticks), dim).filter(
        (F.col("calendar") == calendar) & (F.col("timeframe") == timeframe)
    )
    alone = C.rollup(C.day_states(ticks), dim, [timeframe]).filter(F.col("calendar") == calendar)
    assert rows_of(rolled) == rows_of(direct) == rows_of(alone)


def test_ties_are_settled_by_value(spark):
    at = dt.datetime(2024, 5, 1, 12, tzinfo=UTC)
    ticks = spark.createDataFrame(
        [("a", GREGORIAN, Decimal(v), Decimal(1), at) for v in (5, 3, 9, 4)], TICKS
    )
    row = C.finish(C.day_states(ticks)).first()
    assert (row["open"], row["close"]) == (Decimal(3), Decimal(9))


@pytest.mark.parametrize("ts", ["1901-02-03 04:05:06.789", "1969-12-31 23:59:59.999", "1970-01-01 00:00:00", "2299-12-31 23:59:59.999"])
@pytest.mark.parametrize("value", ["0.00000001", "9999999999.99999999", "123.45"])
def test_packing_is_exact(spark, ts, value):
    df = spark.sql(f"SELECT timestamp '{ts}' AS ts, cast('{value}' AS decimal(18,8)) AS v")
    key = pack_tick(F.col("ts"), F.col("v"))
    row = df.select("ts", "v", packed_ts(key).alias("ts2"), packed_value(key).alias("v2")).first()
    assert (row["ts"], row["v"]) == (row["ts2"], row["v2"])


def test_days_outside_the_dimension_are_reported_not_misplaced(spark):
    at = [dt.datetime(1905, 6, 1, tzinfo=UTC), dt.datetime(2024, 6, 1, tzinfo=UTC)]
    ticks = spark.createDataFrame([("a", JALALI, Decimal(1), Decimal(1), t) for t in at], TICKS)
    dim = build_jalali_calendar(spark)
    assert C.candle_states(ticks, JALALI, "1m", dim).count() == 1
    assert C.candle_states(ticks, JALALI, "1w").count() == 2
    assert C.rollup(C.day_states(ticks), dim, ["1y"]).count() == 1
    assert [r["ts"].year for r in C.uncovered_ticks(ticks, dim).collect()] == [1905]


def test_formatting(spark):
    at = dt.datetime(2025, 3, 21, 10, tzinfo=UTC)
    ticks = spark.createDataFrame(
        [(c, c, Decimal("123.45"), Decimal(1000), at) for c in CALENDARS], TICKS
    )
    rows = C.format_candles(C.with_jalali_labels(C.finish(C.day_states(ticks)), label_calendar(spark)))
    got = {r["symbol"]: r for r in rows.collect()}
    assert got[GREGORIAN]["bucket_start"] == "2025-03-21 00:00:00"
    assert got[GREGORIAN]["open"] == "123.45000000" and got[GREGORIAN]["jalali_year"] is None
    assert got[JALALI]["bucket_start"] == "2025-03-21"
    assert tuple(got[JALALI][c] for c in ("jalali_year", "jalali_month", "jalali_day")) == (1404, 1, 1)


def test_sums_beyond_28_digits_are_kept(spark):
    big = Decimal("9999999999.99999999")
    at = dt.datetime(2024, 1, 1, tzinfo=UTC)
    states = C.day_states(spark.createDataFrame([("a", GREGORIAN, Decimal(1), big, at)], TICKS))
    states = states.withColumn("volume", (F.lit("1e25").cast("decimal(38,8)"))).union(states)
    assert C.merge_states(states).first()["volume"] == Decimal("10000000000000009999999999.99999999")


def test_unknown_timeframe(spark):
    with pytest.raises(ValueError):
        C.candle_states(make_ticks(spark, 1), GREGORIAN, "5m")
