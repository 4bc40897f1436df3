from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.text import parse_decimal, parse_instant
from tickloom.operators import registry as G
from tickloom.operators import validation as V
from tickloom.schema import CALENDARS, REGISTRY, REQUESTS
from tickloom.sources.requests import parse_requests

UTC = dt.timezone.utc
GOOD = {
    "symbol": "ABC",
    "value": "123.45",
    "volume": "1000",
    "calendar": "gregorian",
    "timestamp": "2026-09-02T10:15:30.123Z",
}


def requests(spark, bodies):
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    return spark.createDataFrame(
        [(str(i), at + dt.timedelta(seconds=i), body) for i, body in enumerate(bodies)], REQUESTS
    )


def verdicts(spark, bodies):
    """Reason per body, or the number of ticks taken in."""
    split = V.split_batches(V.validate(parse_requests(requests(spark, bodies))))
    found = {r["request_id"]: r["reason"] for r in split.rejected.collect()}
    found |= {r["request_id"]: r["accepted"] for r in V.accepted_counts(split.accepted).collect()}
    return [found.get(str(i)) for i in range(len(bodies))]


def body(*ticks):
    return json.dumps({"ticks": list(ticks)})


def tick(**changes):
    return {k: v for k, v in (GOOD | changes).items() if v is not ...}


CASES = [
    (body(GOOD), 1),
    (body(GOOD, tick(symbol="X", calendar="jalali")), 2),
    ('{"ticks":[]}', V.NO_TICKS),
    ('{"ticks":null}', V.NO_TICKS),
    ("{}", V.NO_TICKS),
    ("null", V.NO_TICKS),
    (" \n" + body(GOOD) + "\n ", 1),
    (json.dumps({"TICKS": [{k.upper(): v for k, v in GOOD.items()}]}), 1),
    ('{"ticks":[{"symbol":"","symbol":"A","value":"1","volume":"1","calendar":"jalali","timestamp":"2026-09-02T10:15:30Z"}]}', 1),
    # malformed bodies
    ("", V.MALFORMED),
    (None, V.MALFORMED),
    ("not json", V.MALFORMED),
    ("[]", V.MALFORMED),
    ("5", V.MALFORMED),
    (body(GOOD) + " x", V.MALFORMED),
    (body(GOOD) + body(GOOD), V.MALFORMED),
    (body(GOOD) + "," + body(GOOD), V.MALFORMED),
    (body(GOOD) + "]", V.MALFORMED),
    (body(GOOD) + "] [1", V.MALFORMED),
    (body(GOOD) + ",1] x", V.MALFORMED),
    (body(GOOD)[:-1], V.MALFORMED),
    (body(GOOD).replace('"', "'"), V.MALFORMED),
    (json.dumps({"ticks": [GOOD], "more": 1}), V.MALFORMED),
    ('{"ticks":5}', V.MALFORMED),
    ('{"ticks":{}}', V.MALFORMED),
    (body(5), V.MALFORMED),
    (body(GOOD, tick(note="x")), V.MALFORMED),
    (body(tick(value=123.45)), V.MALFORMED),
    (body(tick(volume=True)), V.MALFORMED),
    (body(tick(symbol=["A"])), V.MALFORMED),
    (body(tick(timestamp="2026-09-02")), V.MALFORMED),
    (body(tick(timestamp="2026-09-02T10:15:30")), V.MALFORMED),
    (body(tick(timestamp="2026-02-30T10:15:30Z")), V.MALFORMED),
    (body(tick(timestamp="")), V.MALFORMED),
    (body(tick(symbol=""), tick(timestamp="soon")), V.MALFORMED),
    # refused ticks
    (body(None), "ticks[0]: symbol must not be empty"),
    (body(tick(symbol="  \t")), "ticks[0]: symbol must not be empty"),
    (body(tick(symbol=...)), "ticks[0]: symbol must not be empty"),
    (body(tick(symbol=None)), "ticks[0]: symbol must not be empty"),
    (body(GOOD, tick(calendar="Gregorian")), "ticks[1]: calendar must be gregorian or jalali"),
    (body(tick(calendar=...)), "ticks[0]: calendar must be gregorian or jalali"),
    *(
        (body(tick(value=v)), "ticks[0]: value must be a positive decimal")
        for v in ("0", "-1", "abc", "", "  ", "1/3", "0x1", "0.000000001", "10000000000")
    ),
    (body(GOOD, GOOD, tick(volume="0")), "ticks[2]: volume must be a positive decimal"),
    (body(tick(value="0", volume="0")), "ticks[0]: value must be a positive decimal"),
    (body(tick(symbol="", value="0")), "ticks[0]: symbol must not be empty"),
    (body(tick(value="0"), tick(symbol="")), "ticks[0]: value must be a positive decimal"),
    (body(tick(timestamp=...)), "ticks[0]: timestamp must be a valid RFC3339 value"),
    (body(tick(timestamp=None)), "ticks[0]: timestamp must be a valid RFC3339 value"),
    (body(tick(timestamp="0001-01-01T00:00:00Z")), "ticks[0]: timestamp must be a valid RFC3339 value"),
    # two calendars in one body: the first conflict is told
    (
        body(GOOD, tick(symbol="Z"), tick(symbol="Z", calendar="jalali"), tick(calendar="jalali")),
        "symbol Z has conflicting calendars in batch: gregorian and jalali",
    ),
    (
        body(tick(calendar="jalali"), GOOD),
        "symbol ABC has conflicting calendars in batch: jalali and gregorian",
    ),
]


def test_request_bodies(spark):
    got = verdicts(spark, [b for b, _ in CASES])
    wrong = [(b, w, g) for (b, w), g in zip(CASES, got) if w != g]
    assert not wrong


def test_body_size_limit(spark):
    text = body(GOOD)
    parsed = parse_requests(requests(spark, [text, text + " "]), max_body_bytes=len(text))
    assert [r["malformed"] for r in parsed.orderBy("request_id").collect()] == [False, True]


def test_normalize(spark):
    text = body(
        tick(symbol=" A ", value=" 1.123456789\n", volume="1e3", timestamp="2026-09-02T10:15:30.123999+03:30")
    )
    row = V.normalize(V.split_batches(V.validate(parse_requests(requests(spark, [text])))).accepted)
    got = row.select("symbol", *(F.col(c).cast("string") for c in ("value", "volume", "ts"))).first()
    assert tuple(got) == (" A ", "1.12345678", "1000.00000000", "2026-09-02 06:45:30.123")


@pytest.mark.parametrize(
    "text,want",
    [("1.", "1.00000000"), (".5", "0.50000000"), ("+2", "2.00000000"), ("1.999999999", "1.99999999"),
     ("9999999999.999999999", "9999999999.99999999"), ("1.234567891e2", "123.45678910"), ("NaN", None), ("1 2", None)],
)
def test_decimals(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_decimal(F.col("t")).cast("string")).first()[0] == want


def test_instants(spark):
    texts = ["2026-09-02t10:15:30Z", "2026-09-02T24:00:00Z", "2026-09-02T10:15:30,5Z", "2026-09-02T10:15:30.1234567Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_instant(F.col("t")).cast("string")).collect()]
    assert got == [None, None, None, "2026-09-02 10:15:30.123"]


# --- registry -------------------------------------------------------------


def test_first_registration_stands(spark):
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    versions = spark.createDataFrame(
        [("a", "jalali", at + dt.timedelta(1)), ("a", "gregorian", at), ("b", "jalali", at)], REGISTRY
    )
    got = {r["symbol"]: r["calendar"] for r in G.registry_resolve(versions).collect()}
    assert got == {"a": "gregorian", "b": "jalali"}


def one_by_one(batches, registry):
    """What serving the requests in turn would do."""
    registry, rejected, new = dict(registry), {}, {}
    for name, _, claims in sorted(batches, key=lambda b: (b[1], b[0])):
        bad = [(s, c) for s, c in claims if registry.get(s, c) != c]
        if bad:
            symbol, calendar = bad[0]
            rejected[name] = f"symbol {symbol} is registered as {registry[symbol]} but received {calendar}"
        else:
            fresh = {s: c for s, c in claims if s not in registry}
            registry |= fresh
            new |= fresh
    return rejected, new


@pytest.mark.parametrize("seed", range(6))
def test_resolution_equals_serving_requests_in_turn(spark, seed):
    rng = random.Random(seed)
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    symbols = [f"s{i}" for i in range(rng.choice([3, 8, 30]))]
    # chains of disagreement on purpose: few symbols, many requests
    batches = []
    for i in range(40):
        chosen = rng.sample(symbols, rng.randint(1, 3))
        claims = [(s, rng.choice(CALENDARS)) for s in chosen]
        batches.append((f"r{i:02}", at + dt.timedelta(seconds=rng.randrange(20)), claims))
    registry = {s: rng.choice(CALENDARS) for s in symbols[::4]} if seed % 2 else {}
    claims = spark.createDataFrame(
        [(n, t, s, c, pos) for n, t, cl in batches for pos, (s, c) in enumerate(cl)],
        "request_id string, received_at timestamp, symbol string, calendar string, pos int",
    )
    stored = spark.createDataFrame([(s, c, at) for s, c in registry.items()], REGISTRY)
    resolution = G.resolve(claims, stored)
    rejected, new = one_by_one(batches, registry)
    assert {r["request_id"]: r["reason"] for r in resolution.rejected.collect()} == rejected
    assert {r["symbol"]: r["calendar"] for r in resolution.new_symbols.collect()} == new


def test_a_chain_is_resolved_to_its_end(spark):
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    batches = [
        (f"r{i}", at + dt.timedelta(seconds=i), [(f"s{i}", "gregorian"), (f"s{i + 1}", "jalali")])
        for i in range(7)
    ]
    claims = spark.createDataFrame(
        [(n, t, s, c, pos) for n, t, cl in batches for pos, (s, c) in enumerate(cl)],
        "request_id string, received_at timestamp, symbol string, calendar string, pos int",
    )
    resolution = G.resolve(claims, spark.createDataFrame([], REGISTRY))
    rejected, new = one_by_one(batches, {})
    assert sorted(rejected) == ["r1", "r3", "r5"]
    assert {r["request_id"]: r["reason"] for r in resolution.rejected.collect()} == rejected
    assert {r["symbol"]: r["calendar"] for r in resolution.new_symbols.collect()} == new


def _claims(spark, batches):
    return spark.createDataFrame(
        [(n, t, s, c, pos) for n, t, cl in batches for pos, (s, c) in enumerate(cl)],
        "request_id string, received_at timestamp, symbol string, calendar string, pos int",
    )


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_serving_requests_in_turn(spark, seed):
    rng = random.Random(100 + seed)
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    symbols = [f"s{i}" for i in range(12)]
    batches = [
        (f"r{i:02}", at + dt.timedelta(seconds=rng.randrange(30)), [(s, rng.choice(CALENDARS)) for s in rng.sample(symbols, rng.randint(1, 3))])
        for i in range(40)
    ]
    registry = {"s0": "jalali"} if seed else {}
    stored = spark.createDataFrame([(s, c, at) for s, c in registry.items()], REGISTRY)
    rejected, new = one_by_one(batches, registry)
    resolution = G.settle(_claims(spark, batches), stored, small=0)
    assert {r["request_id"]: r["reason"] for r in resolution.rejected.collect()} == rejected
    assert {r["symbol"]: r["calendar"] for r in resolution.new_symbols.collect()} == new


def test_a_round_writes_only_what_is_new(spark, folder):
    """Over a chain of links each decided after the one before, rows written grow with the claims."""
    written = {}
    for links in (8, 24):
        rows = [(i, f"s{i + k}", c) for i in range(links) for k, c in enumerate(CALENDARS)]
        path = f"{folder}/{links}"
        lost = G.losers(spark.createDataFrame(rows, "turn long, symbol string, calendar string"), path, small=0)
        assert sorted(r["turn"] for r in lost.collect()) == list(range(1, links, 2)) == G.served_in_turn(rows)
        written[links] = spark.read.option("recursiveFileLookup", "true").schema("turn long").parquet(path).count()
    assert written[24] <= 3.5 * written[8] and written[24] <= 6 * 2 * 24


def test_a_chain_of_many_links_is_one_look_for_the_driver(spark):
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    batches = [(f"r{i:03}", at, [(f"s{i}", "gregorian"), (f"s{i + 1}", "jalali")]) for i in range(200)]
    resolution = G.resolve(_claims(spark, batches), spark.createDataFrame([], REGISTRY))
    rejected, new = one_by_one(batches, {})
    assert {r["request_id"]: r["reason"] for r in resolution.rejected.collect()} == rejected
    assert {r["symbol"]: r["calendar"] for r in resolution.new_symbols.collect()} == new


def test_deliveries_with_one_id_are_one_request(spark):
    texts = [body(GOOD), body(tick(calendar="jalali"))]
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    both = spark.createDataFrame([("r", at + dt.timedelta(seconds=i), t) for i, t in enumerate(texts)], REQUESTS)
    split = V.split_batches(V.validate(parse_requests(both)))
    assert [r["code"] for r in split.rejected.collect()] == [V.CALENDAR_MISMATCH] and split.claims.isEmpty()


def test_what_a_batch_holds_has_no_more_partitions_than_its_size_calls_for(spark):
    from tickloom.streaming import ingest

    keys = ("spark.sql.shuffle.partitions", "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning")
    before = [spark.conf.get(key, None) for key in keys]
    spark.conf.set(keys[0], 64)
    held = ingest._held(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    try:
        assert held.count() == 100
        assert held.rdd.getNumPartitions() < 64
    finally:
        held.unpersist()
        spark.conf.set(keys[0], before[0])
    assert [spark.conf.get(key, None) for key in keys] == before
