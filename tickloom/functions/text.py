"""Text in and out: trimming, decimals, RFC 3339 instants, result strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schema import GREGORIAN, PRICE

# Fixed value: the characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the shape of an RFC 3339 instant.
RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?"
    r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
)


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def parse_decimal(text: Column) -> Column:
    """Trimmed text as DECIMAL(18,8), digits past the eighth cut off; else NULL.

    Cutting happens on the text, where it is exact; a number written with an
    exponent is spelled out first.
    """
    clean = trimmed(text)
    spelled = F.when(
        clean.rlike("[eE]"), clean.try_cast("decimal(38,20)").cast("string")
    ).otherwise(clean)
    return F.regexp_replace(spelled, r"(\.\d{8})\d+$", "$1").try_cast(PRICE)


def parse_instant(text: Column) -> Column:
    """RFC 3339 text as a UTC instant in whole milliseconds; else NULL."""
    return F.when(
        text.rlike(RFC3339), F.date_trunc("millisecond", text.try_cast("timestamp"))
    )


def format_decimal(value: Column) -> Column:
    return value.cast("string")


def format_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def format_bucket(bucket: Column, calendar: Column) -> Column:
    """Gregorian buckets read as midnight, Jalali buckets as a date."""
    day = bucket.cast("string")
    return F.when(calendar == GREGORIAN, F.concat(day, F.lit(" 00:00:00"))).otherwise(day)
