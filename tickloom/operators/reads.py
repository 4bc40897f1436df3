"""Range reads of ticks and candles, with paging."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.buckets import symbol_bucket, tehran_day_range, utc_day_range
from tickloom.functions.text import WHITESPACE, format_decimal, format_instant
from tickloom.operators.candles import finish, merge_states
from tickloom.schema import DEFAULT_LIMIT, GREGORIAN, JALALI, MAX_LIMIT, TIMEFRAMES

# The layouts a range bound may be written in.
_BOUND = re.compile(
    r"(?P<day>\d{4}-\d{2}-\d{2})"
    r"(?:T(?P<time>\d{2}:\d{2}:\d{2})(?P<frac>[.,]\d+)?(?P<zone>Z|[+-]\d{2}:\d{2})?)?"
)


class ArgumentError(ValueError):
    """A read was asked for with an argument it does not accept."""


class UnknownSymbolError(LookupError):
    """None of the symbols a read asked for is registered."""


class DayRange(NamedTuple):
    first: dt.date
    last: dt.date


class Page(NamedTuple):
    """One page of rows, its one-row metadata, and symbols asked for that are not registered."""

    rows: DataFrame
    metadata: DataFrame
    unknown: tuple[str, ...] = ()


def _parse_bound(text: str, field: str) -> dt.datetime:
    clean = (text or "").strip(WHITESPACE)
    if not clean:
        raise ArgumentError(f"{field} is required")
    match = _BOUND.fullmatch(clean)
    try:
        if match is None:
            raise ValueError(clean)
        instant = dt.datetime.fromisoformat(f"{match['day']}T{match['time'] or '00:00:00'}")
        if match["frac"]:
            micros = (match["frac"][1:] + "000000")[:6]
            instant = instant.replace(microsecond=int(micros))
        zone = match["zone"]
        if zone in (None, "Z"):
            return instant.replace(tzinfo=dt.timezone.utc)
        hours, minutes = int(zone[1:3]), int(zone[4:6])
        if hours > 23 or minutes > 59:
            raise ValueError(zone)
        offset = dt.timedelta(hours=hours, minutes=minutes) * (-1 if zone[0] == "-" else 1)
        return instant.replace(tzinfo=dt.timezone(offset))
    except ValueError as error:
        raise ArgumentError(f"{field} must be a valid date") from error


def parse_range(from_: str, to: str) -> DayRange:
    """Bounds as calendar days, taken as written: time and offset only order them."""
    first, last = _parse_bound(from_, "from"), _parse_bound(to, "to")
    if last < first:
        raise ArgumentError("from must be before or equal to to")
    return DayRange(first.date(), last.date())


def check_page(page: int | None, limit: int | None, max_limit: int = MAX_LIMIT) -> tuple[int, int]:
    page = 1 if page is None else page
    limit = DEFAULT_LIMIT if limit is None else limit
    for name, value in (("page", page), ("limit", limit)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ArgumentError(f"{name} must be a positive integer")
    if limit > max_limit:
        raise ArgumentError(f"limit must not exceed {max_limit}")
    return page, limit


def check_timeframe(timeframe: str) -> str:
    if timeframe not in TIMEFRAMES:
        raise ArgumentError("timeframe must be one of " + ", ".join(TIMEFRAMES))
    return timeframe


def symbols_predicate(symbols: Sequence[str], buckets: int | None = None) -> Column:
    """Symbol membership; with ``buckets``, also the storage buckets to visit."""
    if not symbols or any(s == "" for s in symbols):
        raise ArgumentError("symbol is required")
    wanted = F.col("symbol").isin(list(symbols))
    if buckets is not None:
        visited = [symbol_bucket(F.lit(s), buckets) for s in symbols]
        wanted = wanted & F.col("symbol_bucket").isin(visited)
    return wanted


def day_range(days: DayRange) -> Column:
    """The tick's day, in its own calendar's zone, lies in the range."""
    ts, calendar = F.col("ts"), F.col("calendar")
    return ((calendar == GREGORIAN) & utc_day_range(ts, *days)) | (
        (calendar == JALALI) & tehran_day_range(ts, *days)
    )


def ticks_in_range(ticks: DataFrame, days: DayRange) -> DataFrame:
    return ticks.filter(day_range(days))


def route_predicate(routes: Mapping[str, str]) -> Column:
    """Rows of the given symbols in the calendar each is registered with.

    Plain comparisons with literals, so that scans skip the files of the other
    calendar and of other symbols.
    """
    wanted = F.lit(False)
    for calendar in sorted(set(routes.values())):
        symbols = sorted(s for s, c in routes.items() if c == calendar)
        wanted = wanted | ((F.col("calendar") == calendar) & F.col("symbol").isin(symbols))
    return wanted


def ticks_in_utc_range(ticks: DataFrame, days: DayRange) -> DataFrame:
    return ticks.filter(F.col("calendar") == GREGORIAN).filter(utc_day_range(F.col("ts"), *days))


def ticks_in_tehran_range(ticks: DataFrame, days: DayRange) -> DataFrame:
    return ticks.filter(F.col("calendar") == JALALI).filter(tehran_day_range(F.col("ts"), *days))


def candles_in_range(states: DataFrame, days: DayRange) -> DataFrame:
    """States whose bucket *starts* in the range; earlier overlapping ones do not count."""
    return states.filter(F.col("bucket_start").between(F.lit(days.first), F.lit(days.last)))


def read_candles(states: DataFrame, days: DayRange, timeframe: str) -> DataFrame:
    """Finished candles of one timeframe whose bucket starts in the range."""
    check_timeframe(timeframe)
    return finish(merge_states(candles_in_range(states.filter(F.col("timeframe") == timeframe), days)))


def routed(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows of the symbols in ``routes``, however many, each in its registered calendar.

    Where both sides know the storage bucket it is joined on, so that scans skip buckets no route leads to.
    """
    keys = [c for c in ("symbol", "calendar", "symbol_bucket") if c in rows.columns and c in routes.columns]
    return rows.join(routes.select(*keys), keys, "left_semi")


def format_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.select(
        "symbol",
        format_decimal(F.col("value")).alias("value"),
        format_decimal(F.col("volume")).alias("volume"),
        format_instant(F.col("ts")).alias("timestamp"),
    )


def page_of(
    rows: DataFrame,
    order: Sequence[str],
    page: int | None = None,
    limit: int | None = None,
    max_limit: int = MAX_LIMIT,
    hold: bool = False,
) -> Page:
    """One page in ``order``, probing one row further to learn whether more follow.

    With ``hold`` the read runs at once and only once; its rows, a page and one, are kept by the caller.
    """
    page, limit = check_page(page, limit, max_limit)
    return _page(rows.orderBy(*order).offset((page - 1) * limit).limit(limit + 1), page, limit, hold)


def _page(probe: DataFrame, page: int, limit: int, hold: bool) -> Page:
    if hold:
        probe = probe.sparkSession.createDataFrame(probe.toArrow(), probe.schema)
    seen = F.count(F.lit(1))
    metadata = probe.agg(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        (seen > limit).alias("has_more"),
        F.least(seen, F.lit(limit)).alias("count"),
    )
    return Page(probe.limit(limit), metadata)


def page_after(
    rows: DataFrame,
    order: Sequence[str],
    after: Sequence[object],
    limit: int | None = None,
    max_limit: int = MAX_LIMIT,
    copies: int | None = None,
    hold: bool = False,
) -> Page:
    """The page following the row whose ``order`` values are ``after``.

    Costs the same at any depth, where an offset reads and drops all it skips.
    ``order`` must identify a row, as (symbol, bucket_start) does for candles, or be
    all that tells rows apart: then ``copies`` says how many equal rows were read.
    """
    _, limit = check_page(1, limit, max_limit)
    beyond = F.lit(copies is not None)
    for name, value in reversed(list(zip(order, after))):
        column, mark = F.col(name), F.lit(value).cast(rows.schema[name].dataType)
        beyond = (column > mark) | ((column == mark) & beyond)
    return _page(rows.filter(beyond).orderBy(*order).offset(copies or 0).limit(limit + 1), 1, limit, hold)


class Span(NamedTuple):
    """Where the rows of a page lie: from one symbol's day to another's, the first ``skip`` rows not counted."""

    first: tuple[str, dt.date]
    last: tuple[str, dt.date]
    skip: int


def _reached(counts: Sequence[tuple[object, int]], position: int) -> tuple[object, int] | None:
    """The key whose rows hold ``position``, and how many rows come before it."""
    before = 0
    for key, n in counts:
        if before + n > position:
            return key, before
        before += n
    return None


def page_span(counts: DataFrame, skip: int, rows: int) -> Span | None:
    """The span of ``rows`` rows after the first ``skip``, in order of symbol and day; nothing beyond the last.

    ``counts`` (symbol, day, n) tells how many rows each day has. What comes to the driver is a number for each
    symbol, and for each day of the two symbols the page begins and ends in.
    """
    by_symbol = counts.groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol")
    totals = [(r["symbol"], r["n"]) for r in by_symbol.collect()]
    total = sum(n for _, n in totals)
    if skip >= total:
        return None
    ends = [_reached(totals, at) for at in (skip, min(skip + rows, total) - 1)]
    wanted = counts.filter(F.col("symbol").isin([symbol for symbol, _ in ends]))
    by_day = wanted.groupBy("symbol", "day").agg(F.sum("n").alias("n")).orderBy("day").collect()
    places = []
    for (symbol, before), at in zip(ends, (skip, min(skip + rows, total) - 1)):
        day, earlier = _reached([(r["day"], r["n"]) for r in by_day if r["symbol"] == symbol], at - before)
        places.append(((symbol, day), before + earlier))
    return Span(places[0][0], places[1][0], skip - places[0][1])


def in_span(span: Span, day: Column) -> Column:
    """Rows of a span, by symbol and ``day``: plain comparisons, so that scans skip other symbols and days."""
    symbol = F.col("symbol")
    (first, first_day), (last, last_day) = span.first, span.last
    after = (symbol > first) | ((symbol == first) & (day >= F.lit(first_day)))
    before = (symbol < last) | ((symbol == last) & (day <= F.lit(last_day)))
    return symbol.between(first, last) & after & before


def page_in(
    rows: DataFrame,
    order: Sequence[str],
    counts: DataFrame,
    day: Column,
    page: int | None = None,
    limit: int | None = None,
    max_limit: int = MAX_LIMIT,
) -> tuple[Page, Span | None]:
    """One page by number, as :func:`page_of` with ``hold``, but only the days it lies in are read and sorted.

    ``order`` begins with the symbol and goes on by what ``day`` rises with; ``counts`` as in :func:`page_span`.
    """
    page, limit = check_page(page, limit, max_limit)
    span = page_span(counts, (page - 1) * limit, limit + 1)
    if span is None:
        return _page(rows.limit(0), page, limit, hold=True), None
    near = rows.filter(in_span(span, day)).orderBy(*order).offset(span.skip).limit(limit + 1)
    return _page(near, page, limit, hold=True), span


def newest_days(counts: DataFrame, n: int) -> dt.date | None:
    """The day from which on there are ``n`` rows, or the first; at most ``n`` days come to the driver."""
    by_day = counts.groupBy("day").agg(F.sum("n").alias("n")).filter("n > 0").orderBy(F.desc("day")).limit(n).collect()
    found = 0
    for row in by_day:
        found += row["n"]
        if found >= n:
            return row["day"]
    return by_day[-1]["day"] if by_day else None


def latest(rows: DataFrame, time: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` most recent rows, newest first."""
    return rows.orderBy(F.col(time).desc(), *ties).limit(n)
