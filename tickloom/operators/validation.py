"""Tick checks and whole-batch rejection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.text import parse_decimal, parse_instant, trimmed
from tickloom.schema import CALENDARS, GREGORIAN, JALALI

# The reasons a tick is refused, in the order they are checked.
TICK_REASONS = (
    "symbol must not be empty",
    "calendar must be gregorian or jalali",
    "value must be a positive decimal",
    "volume must be a positive decimal",
    "timestamp must be a valid RFC3339 value",
)
MALFORMED = "malformed JSON body"
NO_TICKS = "ticks must not be empty"
INVALID_REQUEST = "invalid_request"
CALENDAR_MISMATCH = "calendar_mismatch"

# Fixed value: the instant that counts as no timestamp at all.
_NO_INSTANT = "0001-01-01 00:00:00"


class Split(NamedTuple):
    """Ticks and claims of the requests that passed, one row per request that did not."""

    accepted: DataFrame
    rejected: DataFrame
    claims: DataFrame


def validate(ticks_raw: DataFrame) -> DataFrame:
    """Add the parsed columns and ``fault``: the first failed check, 0-based, or NULL.

    A timestamp that is given but unreadable makes the body malformed, as it
    fails while the body is decoded.
    """
    malformed = F.col("malformed") if "malformed" in ticks_raw.columns else F.lit(False)
    parsed = ticks_raw.withColumns(
        {
            "price": parse_decimal(F.col("value")),
            "size": parse_decimal(F.col("volume")),
            "ts": parse_instant(F.col("timestamp")),
        }
    )
    failed = (
        trimmed(F.col("symbol")) == "",
        ~F.col("calendar").isin(*CALENDARS),
        F.col("price").isNull() | (F.col("price") <= 0),
        F.col("size").isNull() | (F.col("size") <= 0),
        F.col("ts").isNull() | (F.col("ts") == F.lit(_NO_INSTANT).cast("timestamp")),
    )
    fault = F.coalesce(*(F.when(check, F.lit(i)) for i, check in enumerate(failed)))
    return parsed.withColumns(
        {
            "malformed": malformed | (F.col("timestamp").isNotNull() & F.col("ts").isNull()),
            "fault": F.when(F.col("pos").isNotNull(), fault),
        }
    )


def reason_of(fault: Column) -> Column:
    """The text of a fault number."""
    return F.get(F.array(*(F.lit(r) for r in TICK_REASONS)), fault.cast("int"))


def normalize(accepted: DataFrame) -> DataFrame:
    """Accepted raw ticks as typed ticks; the symbol is kept as written."""
    return accepted.select(
        "symbol",
        "calendar",
        F.col("price").alias("value"),
        F.col("size").alias("volume"),
        "ts",
    )


def distinct_symbols(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol").distinct()


def first_calendars(ticks: DataFrame, *keys: str, more: Sequence[Column] = ()) -> DataFrame:
    """First position of each calendar per ``keys``, and the calendar that came first."""
    pos, calendar = F.col("pos"), F.col("calendar")
    return (
        ticks.groupBy(*keys)
        .agg(
            F.min(F.when(calendar == GREGORIAN, pos)).alias("gregorian_pos"),
            F.min(F.when(calendar == JALALI, pos)).alias("jalali_pos"),
            *more,
        )
        .withColumn(
            "calendar",
            F.when(
                F.col("jalali_pos").isNull() | (F.col("gregorian_pos") < F.col("jalali_pos")),
                F.lit(GREGORIAN),
            ).otherwise(F.lit(JALALI)),
        )
        .withColumn("pos", F.least("gregorian_pos", "jalali_pos"))
    )


def _conflict_pos() -> Column:
    """Where a second calendar follows, if one does."""
    both = F.col("gregorian_pos").isNotNull() & F.col("jalali_pos").isNotNull()
    return F.when(both, F.greatest("gregorian_pos", "jalali_pos")).alias("conflict_pos")


def batch_claims(ticks: DataFrame) -> DataFrame:
    """One row per request and symbol: its first calendar and where another follows.

    Deliveries that share a request id are one request, received when the first was.
    """
    received = F.min("received_at").alias("received_at")
    return first_calendars(ticks, "request_id", "symbol", more=(received,)).select(
        "request_id", "received_at", "symbol", "calendar", "pos", _conflict_pos()
    )


def other_calendar(calendar: Column) -> Column:
    return F.when(calendar == GREGORIAN, F.lit(JALALI)).otherwise(F.lit(GREGORIAN))


def batch_conflicts(claims: DataFrame) -> DataFrame:
    """The first conflict inside each request: symbol, first and other calendar.

    The place is aggregated as a number; the few rows there are joined back. Where
    deliveries share a request id, the symbol that sorts first is told.
    """
    found = claims.filter(F.col("conflict_pos").isNotNull())
    first = found.groupBy("request_id").agg(F.min("conflict_pos").alias("conflict_pos"))
    told = F.row_number().over(W.partitionBy("request_id").orderBy("symbol"))
    return (
        found.select("request_id", "conflict_pos", "symbol", "calendar")
        .join(first, ["request_id", "conflict_pos"])
        .withColumn("_told", told)
        .filter("_told = 1")
        .select(
            "request_id",
            F.col("conflict_pos").cast("int").alias("pos"),
            "symbol",
            "calendar",
            other_calendar(F.col("calendar")).alias("other"),
        )
    )


def request_marks(validated: DataFrame) -> DataFrame:
    """One row per request and symbol with its ticks and all that may be wrong with it.

    The ticks of a request sit together, so they collapse before the first
    shuffle. Position and fault share one number, whose minimum is the first
    fault of the lowest tick.
    """
    fault = F.col("pos").cast("bigint") * len(TICK_REASONS) + F.col("fault")
    return first_calendars(
        validated,
        "request_id",
        "symbol",
        more=(
            F.min("received_at").alias("received_at"),
            F.count("pos").alias("ticks"),
            F.bool_or("malformed").alias("malformed"),
            F.bool_or(F.col("pos").isNull()).alias("empty"),
            F.min(fault).alias("worst"),
        ),
    ).withColumn("conflict_pos", _conflict_pos())


def _reason() -> Column:
    """What a request is told: its first failure, in the order of the checks."""
    slots = len(TICK_REASONS)
    pos = F.floor(F.col("worst") / slots).cast("string")
    return (
        F.when(F.col("malformed"), MALFORMED)
        .when(F.col("empty"), NO_TICKS)
        .when(
            F.col("worst").isNotNull(),
            F.concat(F.lit("ticks["), pos, F.lit("]: "), reason_of(F.col("worst") % slots)),
        )
        .otherwise(
            F.concat(
                F.lit("symbol "),
                F.col("symbol"),
                F.lit(" has conflicting calendars in batch: "),
                F.col("calendar"),
                F.lit(" and "),
                F.col("other"),
            )
        )
    )


def request_verdicts(marks: DataFrame) -> DataFrame:
    """One row per request: its ticks, and what is wrong with it.

    ``code`` is NULL for a sound request; a conflict of calendars is marked, the symbol it is
    about is left to :func:`told`.
    """
    found = marks.groupBy("request_id").agg(
        F.sum("ticks").alias("ticks"),
        F.bool_or("malformed").alias("malformed"),
        F.bool_or("empty").alias("empty"),
        F.min("worst").alias("worst"),
        F.min("conflict_pos").alias("conflict_pos"),
    )
    invalid = F.col("malformed") | F.col("empty") | F.col("worst").isNotNull()
    code = F.when(invalid, INVALID_REQUEST).when(F.col("conflict_pos").isNotNull(), CALENDAR_MISMATCH)
    return found.withColumn("code", code)


def told(verdicts: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``verdicts`` with the ``reason`` of each request that is refused.

    ``marks`` may be left out where no request is in conflict with itself.
    """
    if marks is None:
        nothing = F.lit(None).cast("string")
        known = verdicts.withColumns({name: nothing for name in ("symbol", "calendar", "other")})
    else:
        known = verdicts.join(batch_conflicts(marks).drop("pos"), "request_id", "left")
    reason = F.when(F.col("code").isNotNull(), _reason()).alias("reason")
    return known.select(*verdicts.columns, reason)


def rejected_requests(validated: DataFrame) -> DataFrame:
    """Requests with a bad tick, or with two calendars for one symbol, and why."""
    marks = request_marks(validated)
    wrong = request_verdicts(marks).filter(F.col("code").isNotNull())
    return told(wrong, marks).select("request_id", "code", "reason")


def split_batches(validated: DataFrame) -> Split:
    """Reject whole requests; keep the ticks and claims of the others."""
    rejected = rejected_requests(validated)
    claims = batch_claims(validated.filter(F.col("pos").isNotNull()))
    return Split(
        accepted=validated.join(rejected, "request_id", "left_anti"),
        rejected=rejected,
        claims=claims.join(rejected, "request_id", "left_anti").drop("conflict_pos"),
    )


def accepted_counts(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("request_id").agg(F.count(F.lit(1)).alias("accepted"))
