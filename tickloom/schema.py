"""Table schemas and fixed names of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

GREGORIAN = "gregorian"
JALALI = "jalali"
CALENDARS = (GREGORIAN, JALALI)
TIMEFRAMES = ("1d", "1w", "1m", "1y")

TEHRAN = "Asia/Tehran"

PRICE = T.DecimalType(18, 8)
TOTAL = T.DecimalType(38, 8)

MAX_BODY_BYTES = 10 << 20
DEFAULT_LIMIT = 1000
MAX_LIMIT = 1000

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("received_at", T.TimestampType(), False),
        T.StructField("body", T.StringType()),
    ]
)

TICKS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("calendar", T.StringType()),
        T.StructField("value", PRICE),
        T.StructField("volume", PRICE),
        T.StructField("ts", T.TimestampType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("calendar", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

JALALI_CALENDAR = T.StructType(
    [
        T.StructField("gregorian_date", T.DateType()),
        T.StructField("jalali_year", T.IntegerType()),
        T.StructField("jalali_month", T.IntegerType()),
        T.StructField("jalali_day", T.IntegerType()),
        T.StructField("jalali_week_start_date", T.DateType()),
        T.StructField("jalali_month_start_date", T.DateType()),
        T.StructField("jalali_year_start_date", T.DateType()),
    ]
)

# An instant and a value in one number, ordered by instant, then value.
PACKED_TICK = T.DecimalType(37, 8)

# One mergeable candle: each column combines with the same column of another
# state of the same key by min, max or sum (see operators.candles.merge_states).
STATE_MEASURES = T.StructType(
    [
        T.StructField("first_tick", PACKED_TICK),
        T.StructField("last_tick", PACKED_TICK),
        T.StructField("high", PRICE),
        T.StructField("low", PRICE),
        T.StructField("volume", TOTAL),
        T.StructField("ticks", T.LongType()),
    ]
)

STATE_KEYS = ("symbol", "calendar", "timeframe", "bucket_start")

CANDLE_STATE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("calendar", T.StringType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("bucket_start", T.DateType()),
        *STATE_MEASURES.fields,
    ]
)
