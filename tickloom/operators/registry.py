"""The symbol registry: every symbol keeps the calendar it first came with."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.validation import CALENDAR_MISMATCH
from tickloom.schema import GREGORIAN, JALALI
from tickloom.session import scratch_path

REJECTED = "request_id string, code string, reason string"
#: Disputed claims that the driver decides one by one; more are decided in rounds first.
SMALL = 10_000


class Resolution(NamedTuple):
    """Requests refused by the registry, and the symbols the others register."""

    rejected: DataFrame
    new_symbols: DataFrame


def registry_resolve(versions: DataFrame) -> DataFrame:
    """One row per symbol out of many versions: the first registration stands.

    Instant and calendar share one integer, the calendar in its lowest bit, so
    the earliest is a plain minimum.
    """
    late = F.when(F.col("calendar") == JALALI, F.lit(1)).otherwise(F.lit(0))
    version = F.unix_micros("created_at") * 2 + late
    first = F.col("first")
    return (
        versions.groupBy("symbol")
        .agg(F.min(version).alias("first"))
        .select(
            "symbol",
            F.when(first.bitwiseAND(F.lit(1)) == 1, JALALI).otherwise(GREGORIAN).alias("calendar"),
            F.timestamp_micros(F.shiftright(first, 1)).alias("created_at"),
        )
    )


def calendar_mismatches(ticks: DataFrame, registry: DataFrame) -> DataFrame:
    """Ticks whose calendar differs from the registered one."""
    known = registry.select("symbol", F.col("calendar").alias("registered"))
    return ticks.join(known, "symbol").filter(F.col("calendar") != F.col("registered"))


def new_symbols(symbols: DataFrame, registry: DataFrame) -> DataFrame:
    return symbols.join(registry.select("symbol"), "symbol", "left_anti")


def symbol_lookup(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested symbols with their calendar; ``found`` tells unknown from idle."""
    known = registry.select("symbol", "calendar")
    return requested.join(known, "symbol", "left").withColumn("found", F.col("calendar").isNotNull())


def mismatch_text(symbol: Column, registered: Column, received: Column) -> Column:
    return F.concat(
        F.lit("symbol "),
        symbol,
        F.lit(" is registered as "),
        registered,
        F.lit(" but received "),
        received,
    )


def _stored(df: DataFrame, path: str, **observed: Column) -> tuple[DataFrame, dict]:
    """The rows, written and read again, and what was counted on the way."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in observed.items()))
    rows.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def _by_calendar(key: Column) -> tuple[Column, Column]:
    """The least ``key`` among the claims of each calendar."""
    return tuple(
        F.min(F.when(F.col("calendar") == c, key)).alias(f"first_{c}") for c in (GREGORIAN, JALALI)
    )


def served_in_turn(claims: Iterable[tuple[int, str, str]]) -> list[int]:
    """Turns of the requests refused when the claims (turn, symbol, calendar) are served one after the other."""
    requests: dict[int, list[tuple[str, str]]] = {}
    for turn, symbol, calendar in claims:
        requests.setdefault(turn, []).append((symbol, calendar))
    standing: dict[str, str] = {}
    refused = []
    for turn in sorted(requests):
        if any(standing.get(s, c) != c for s, c in requests[turn]):
            refused.append(turn)
        else:
            standing.update(requests[turn])
    return refused


def losers(claims: DataFrame, path: str, small: int = SMALL) -> DataFrame:
    """Turns of requests that lose a contested symbol to an earlier request.

    ``claims`` (turn, symbol, calendar), stored, are those on contested symbols; requests count by
    turn, as if served one by one: one is accepted unless an earlier accepted one
    claims a symbol of its own with the other calendar. A claim is free once no undecided
    request before it claims its symbol otherwise; it stays free. A request whose
    claims are all free is accepted and settles their symbols; those that claim them otherwise
    are refused.

    A round looks at the symbols of the requests decided in the round before and writes what is new: claims
    that became free, requests that were decided. So each claim is written once, however many rounds there are,
    and once more whenever half of the claims left are decided, to read no others from then on. The earliest undecided
    request is always accepted, so the rounds end. ``small`` claims or fewer are decided on the driver.
    """
    spark = claims.sparkSession
    # a request's claims fit one task: its body is limited in size
    size = F.count(F.lit(1)).over(W.partitionBy("turn")).alias("size")
    base, seen = _stored(claims.select("turn", "symbol", "calendar", size), f"{path}/claims")
    n_base = n_open = seen["rows"]
    read = lambda schema, paths: spark.read.schema(schema).parquet(*paths)
    rival = F.when(F.col("calendar") == GREGORIAN, F.col(f"first_{JALALI}")).otherwise(F.col(f"first_{GREGORIAN}"))
    frees, fates, recent, near, left = [], [], [], None, base
    while n_open > small:
        number = len(fates)
        touched = left if near is None else left.join(near, "symbol", "left_semi")
        firsts = touched.groupBy("symbol").agg(*_by_calendar(F.col("turn")))
        now = touched.join(firsts, "symbol").filter(rival.isNull() | (rival > F.col("turn"))).select(*base.columns)
        if frees:
            now = now.join(read(base.schema, frees).select("turn", "symbol"), ["turn", "symbol"], "left_anti")
        now, _ = _stored(now, f"{path}/free-{number}")
        frees.append(f"{path}/free-{number}")
        free = read(base.schema, frees)
        whole = free.join(now.select("turn"), "turn", "left_semi").groupBy("turn", "size").agg(F.count(F.lit(1)).alias("n"))
        accepted = whole.filter("n = size").select("turn", "size", F.lit(False).alias("refused"))
        settled = free.join(accepted, "turn", "left_semi").select("symbol", F.col("calendar").alias("settled")).distinct()
        against = left.join(settled, "symbol").filter(F.col("settled") != F.col("calendar"))
        refused = against.select("turn", "size", F.lit(True).alias("refused")).distinct()
        fate, counted = _stored(accepted.unionByName(refused), f"{path}/fates-{number}", claims=F.sum("size"))
        n_open -= counted["claims"]
        near = base.join(fate, "turn", "left_semi").select("symbol").distinct()
        fates.append(f"{path}/fates-{number}")
        recent.append(fates[-1])
        left = base.join(read(fate.schema, recent), "turn", "left_anti")
        if 2 * n_open <= n_base:
            near, _ = _stored(near, f"{path}/symbols-{number}")
            _stored(free.join(read(fate.schema, recent), "turn", "left_anti"), f"{path}/free-{number}-left")
            base, seen = _stored(left, f"{path}/claims-{number}")
            left, n_base, recent, frees = base, seen["rows"], [], [f"{path}/free-{number}-left"]
    rest = [tuple(r) for r in left.select("turn", "symbol", "calendar").collect()]
    lost = spark.createDataFrame([(t,) for t in served_in_turn(rest)], "turn long")
    if not fates:
        return lost
    return lost.unionByName(read("turn long, size long, refused boolean", fates).filter("refused").select("turn"))


def registrations(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per symbol claimed: its registration as it would be, and whether claims or the registry disagree.

    ``calendar`` and ``created_at`` are those of a symbol that is new and undisputed, else ``fresh`` is false.
    """
    known = registry.select("symbol", F.col("calendar").alias("registered"))
    asked = claims.groupBy("symbol").agg(*_by_calendar(F.unix_micros("received_at")))
    gregorian, jalali = F.col(f"first_{GREGORIAN}"), F.col(f"first_{JALALI}")
    new, both = F.col("registered").isNull(), gregorian.isNotNull() & jalali.isNotNull()
    against = F.when(F.col("registered") == GREGORIAN, jalali.isNotNull()).otherwise(gregorian.isNotNull())
    return asked.join(known, "symbol", "left").select(
        "symbol",
        F.when(gregorian.isNotNull(), GREGORIAN).otherwise(JALALI).alias("calendar"),
        F.timestamp_micros(F.least(gregorian, jalali)).alias("created_at"),
        (new & ~both).alias("fresh"),
        F.when(new, both).otherwise(against).alias("disputed"),
        "registered",
    )


def resolve(claims: DataFrame, registry: DataFrame) -> Resolution:
    """Check requests against the registry and register what they bring.

    ``claims`` has one row per request and symbol (request_id, received_at,
    symbol, calendar, pos), free of conflicts inside a request. A refused
    request registers nothing.

    The registry meets one row per symbol, however many requests name it; claims
    themselves are only joined to the few symbols something is wrong with, and
    not at all when nothing is.
    """
    asked = registrations(claims, registry)
    if asked.filter("disputed").isEmpty():
        # nobody disagrees: all requests stand
        session = claims.sparkSession
        return Resolution(session.createDataFrame([], REJECTED), asked.filter("fresh").select("symbol", "calendar", "created_at"))
    return settle(claims, registry)


def settle(claims: DataFrame, registry: DataFrame, small: int = SMALL) -> Resolution:
    """What :func:`resolve` does where claims are disputed; takes ``small`` to :func:`losers`."""
    path = scratch_path(claims.sparkSession, "disputes")
    # requests in order of arrival, numbered so that a number compares as (received_at, request_id)
    order = claims.groupBy("request_id").agg(F.min("received_at").alias("arrived")).orderBy("arrived", "request_id")
    turns, _ = _stored(order.select("request_id", "arrived", F.monotonically_increasing_id().alias("turn")), f"{path}/turns")
    claims, _ = _stored(claims.join(turns, "request_id").select("turn", "arrived", "symbol", "calendar", "pos"), f"{path}/claims")
    known = registry.select("symbol", F.col("calendar").alias("registered"))
    asked = claims.groupBy("symbol").agg(*_by_calendar(F.col("turn"))).join(known, "symbol", "left")
    both = F.col(f"first_{GREGORIAN}").isNotNull() & F.col(f"first_{JALALI}").isNotNull()
    registered = asked.filter(F.col("registered").isNotNull()).select("symbol", "registered")
    stale = claims.join(registered, "symbol").filter(F.col("registered") != F.col("calendar")).select("turn").distinct()
    stale, _ = _stored(stale, f"{path}/stale")
    contested = asked.filter(F.col("registered").isNull() & both).select("symbol")
    disputed = claims.join(contested, "symbol", "left_semi").join(stale, "turn", "left_anti")
    refused, _ = _stored(stale.unionByName(losers(disputed, f"{path}/rounds", small)), f"{path}/refused")

    # of a symbol all accepted claims have one calendar
    first = claims.join(refused, "turn", "left_anti").groupBy("symbol").agg(*_by_calendar(F.col("turn")))
    first = first.join(registered, "symbol", "left_anti").select(
        "symbol",
        F.when(F.col(f"first_{GREGORIAN}").isNotNull(), GREGORIAN).otherwise(JALALI).alias("calendar"),
        F.coalesce(f"first_{GREGORIAN}", f"first_{JALALI}").alias("since"),
    )
    first, _ = _stored(first, f"{path}/registered")
    new_symbols = first.join(turns.select(F.col("turn").alias("since"), "arrived"), "since").select(
        "symbol", "calendar", F.col("arrived").alias("created_at")
    )

    # What a request is told depends on the registry as it stood at its turn.
    standing = registered.select("symbol", F.col("registered").alias("standing"), F.lit(-1).cast("long").alias("since"))
    standing = standing.unionByName(first.select("symbol", F.col("calendar").alias("standing"), "since"))
    against = (
        claims.join(refused, "turn", "left_semi")
        .join(standing, "symbol")
        .filter((F.col("standing") != F.col("calendar")) & (F.col("since") < F.col("turn")))
        .select("turn", "pos", "symbol", "standing", "calendar")
    )
    # the first place is aggregated as a number; the few rows there are joined back
    place = against.groupBy("turn").agg(F.min("pos").alias("pos"))
    told = F.row_number().over(W.partitionBy("turn").orderBy("symbol"))
    reports = against.join(place, ["turn", "pos"]).withColumn("_told", told).filter("_told = 1")
    rejected = reports.join(turns, "turn").select(
        "request_id",
        F.lit(CALENDAR_MISMATCH).alias("code"),
        mismatch_text(F.col("symbol"), F.col("standing"), F.col("calendar")).alias("reason"),
    )
    return Resolution(rejected=rejected, new_symbols=new_symbols)
