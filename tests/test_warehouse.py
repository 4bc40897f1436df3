from __future__ import annotations

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators.candles import finish, merge_states
from tickloom.operators.reads import ArgumentError
from tickloom.schema import CANDLE_STATE, REQUESTS, TIMEFRAMES
from tickloom.sources.warehouse import Warehouse
from tickloom.streaming.ingest import ingest_batch, start_stream

UTC = dt.timezone.utc
SYMBOLS = {"BTC": "gregorian", "ETH": "gregorian", "IRR": "jalali", "GOLD": "jalali"}


def make_requests(spark, n, seed=1, symbols=SYMBOLS, start=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ticks = []
        for _ in range(rng.randint(1, 6)):
            symbol = rng.choice(list(symbols))
            at = dt.datetime(2020, 3, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 400))
            ticks.append(
                {
                    "symbol": symbol,
                    "value": f"{rng.randrange(1, 10**6) / 100}",
                    "volume": str(rng.randrange(1, 100)),
                    "calendar": symbols[symbol],
                    "timestamp": at.isoformat() + "Z",
                }
            )
        at = dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=start + i)
        rows.append((f"{start + i:05}", at, json.dumps({"ticks": ticks})))
    return spark.createDataFrame(rows, REQUESTS)


def served(warehouse):
    return sorted(map(str, finish(merge_states(warehouse.states(TIMEFRAMES))).collect()))


@pytest.fixture
def warehouse(spark, folder):
    return Warehouse.create(spark, folder + "/wh", buckets=4)


def test_batches_in_any_order_serve_the_same_candles(spark, folder):
    requests = make_requests(spark, 30)
    late = F.col("request_id") < "00012"
    one, two, three = (Warehouse.create(spark, f"{folder}/{n}", buckets=4) for n in "abc")
    ingest_batch(one, requests)
    for w in (two, three):
        ingest_batch(w, requests.filter(~late))
    three.compact()
    for w in (two, three):
        ingest_batch(w, requests.filter(late))
    want = served(one)
    assert served(two) == want and served(three) == want
    three.compact()
    three.vacuum()
    assert served(three) == want
    three.compact(complete=True)
    three.vacuum()
    assert served(three) == want
    assert three.ticks().count() == one.ticks().count()


def test_running_a_batch_again_changes_nothing(spark, warehouse):
    requests = make_requests(spark, 20)
    ingest_batch(warehouse, requests, 0)
    want, ticks = served(warehouse), warehouse.ticks().count()
    ingest_batch(warehouse, requests, 0)
    assert served(warehouse) == want and warehouse.ticks().count() == ticks
    # the same requests as a new batch count twice
    ingest_batch(warehouse, requests, 1)
    assert warehouse.ticks().count() == 2 * ticks


def test_a_batch_without_commit_is_not_seen(spark, warehouse, monkeypatch):
    ingest_batch(warehouse, make_requests(spark, 5))
    want = served(warehouse)
    monkeypatch.setattr(Warehouse, "commit", lambda *_, **__: None)
    ingest_batch(warehouse, make_requests(spark, 5, seed=2, symbols={"NEW": "jalali"}, start=100))
    assert served(warehouse) == want
    assert warehouse.registry().filter("symbol = 'NEW'").isEmpty()


def test_refused_requests_leave_nothing_behind(spark, warehouse):
    good = make_requests(spark, 4)
    at = dt.datetime(2026, 2, 1, tzinfo=UTC)

    def one(name, *ticks):
        full = [{"value": "1", "volume": "1", "timestamp": "2026-01-01T00:00:00Z"} | t for t in ticks]
        return name, at, json.dumps({"ticks": full})

    bad = spark.createDataFrame(
        [
            one("x1", {"symbol": "N1", "calendar": "jalali"}, {"symbol": "N2", "calendar": "solar"}),
            one("x2", {"symbol": "N3", "calendar": "jalali"}, {"symbol": "N3", "calendar": "gregorian"}),
            one("x3", {"symbol": "N4", "calendar": "jalali"}, {"symbol": "BTC", "calendar": "jalali"}),
            ("x4", at, "{}"),
        ],
        REQUESTS,
    )
    ingest_batch(warehouse, good)
    ticks = warehouse.ticks().count()
    ingest_batch(warehouse, bad)
    assert warehouse.ticks().count() == ticks
    assert warehouse.registry().filter("symbol like 'N%'").isEmpty()
    got = {r["request_id"]: (r["accepted"], r["code"]) for r in warehouse.responses(1).collect()}
    assert got == {
        "x1": (0, "invalid_request"),
        "x2": (0, "calendar_mismatch"),
        "x3": (0, "calendar_mismatch"),
        "x4": (0, "invalid_request"),
    }
    assert warehouse.responses(0).agg(F.sum("accepted")).first()[0] == ticks


def test_reads(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 40))
    page = warehouse.read_candles(["IRR", "BTC", "NONE"], "2020-01-01", "2021-12-31", "1m", limit=5)
    rows = page.rows.collect()
    assert page.metadata.first()["has_more"] and len(rows) == 5
    assert all(r["symbol"] == "BTC" and r["bucket_start"].endswith("-01 00:00:00") for r in rows)
    assert all(r["jalali_year"] is None for r in rows)
    irr = warehouse.read_candles(["IRR"], "2020-01-01", "2021-12-31", "1y").rows.collect()
    assert [(r["jalali_month"], r["jalali_day"]) for r in irr] == [(1, 1)] * len(irr)
    found = {r["symbol"]: r["found"] for r in warehouse.lookup(["IRR", "NONE"]).collect()}
    assert found == {"IRR": True, "NONE": False}
    more = warehouse.read_candles(
        ["BTC", "IRR"], "2020-01-01", "2021-12-31", "1m",
        after=(rows[-1]["symbol"], dt.date.fromisoformat(rows[-1]["bucket_start"][:10])), limit=3,
    )
    second = warehouse.read_candles(["BTC", "IRR"], "2020-01-01", "2021-12-31", "1m", limit=8)
    assert more.rows.collect() == second.rows.collect()[5:]
    for arguments in (("2020-01-01", "2019-01-01", "1d"), ("2020-01-01", "2021-01-01", "5m"), ("x", "2021-01-01", "1d")):
        with pytest.raises(ArgumentError):
            warehouse.read_candles(["BTC"], *arguments)


def test_tick_reads_follow_the_calendar_and_survive_compaction(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 40))
    all_ticks = warehouse.ticks()
    want = {
        name: all_ticks.filter(F.col("symbol") == name)
        .filter(f"to_date({expr}) BETWEEN '2020-05-01' AND '2020-09-30'")
        .count()
        for name, expr in (("BTC", "ts"), ("IRR", "from_utc_timestamp(ts, 'Asia/Tehran')"))
    }
    for _ in range(2):
        for name, n in want.items():
            assert warehouse.read_ticks([name], "2020-05-01", "2020-09-30").rows.count() == n > 0
        warehouse.compact()
        warehouse.vacuum()
    plan = warehouse.ticks(["BTC"])._jdf.queryExecution().executedPlan().toString()
    assert "symbol_bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_delete_and_register_anew(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 20))
    warehouse.compact()
    calendar = warehouse.calendar().count()
    summary = {r["name"]: (r["rows"] > 0, r["outcome"]) for r in warehouse.delete_symbols(["BTC"]).collect()}
    assert len(summary) == 10
    assert summary["ticks"] == (True, "dropped") and summary["symbols"] == (True, "deleted")
    assert summary["candles_1y_greg"] == (True, "dropped")
    assert summary["candles_1d_jalali"] == (False, "no-op")
    assert warehouse.ticks().filter("symbol = 'BTC'").isEmpty()
    assert warehouse.states().filter("symbol = 'BTC'").isEmpty()
    again = warehouse.delete_symbols(["BTC", "NEVER"]).collect()
    assert all(r["outcome"] == "no-op" for r in again)
    ingest_batch(warehouse, make_requests(spark, 5, seed=3, symbols={"BTC": "jalali"}, start=500))
    row = warehouse.registry().filter("symbol = 'BTC'").first()
    assert row["calendar"] == "jalali"
    want = served(warehouse)
    warehouse.compact(complete=True)
    warehouse.vacuum()
    assert served(warehouse) == want
    assert warehouse.calendar().count() == calendar == 69398


def test_deleting_every_symbol_leaves_nothing(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 10))
    warehouse.compact()
    warehouse.delete_symbols(list(SYMBOLS))
    assert {r["name"]: r["rows"] for r in warehouse.check().collect() if r["rows"]} == {"jalali_calendar": 69398}
    warehouse.compact(complete=True)
    warehouse.vacuum()
    assert warehouse.ticks().isEmpty() and warehouse.states().isEmpty()


def test_expiry_keeps_candles(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 20))
    warehouse.compact()
    want, before = served(warehouse), warehouse.ticks().count()
    as_of = dt.datetime(2020, 12, 15, tzinfo=UTC)
    old = warehouse.ticks().filter(F.col("ts") < F.lit("2020-12-08").cast("timestamp")).count()
    warehouse.expire_ticks(7, as_of)
    assert 0 < old and warehouse.ticks().count() == before - old
    assert served(warehouse) == want
    assert not warehouse.registry().isEmpty()


def test_check_lists_every_table(spark, warehouse):
    rows = {r["name"]: r["rows"] for r in warehouse.check().collect()}
    assert len(rows) == 11 and rows["jalali_calendar"] == 69398 and rows["ticks"] == 0
    assert {r["name"] for r in warehouse.check().filter("exists").collect()} == {"jalali_calendar"}
    ingest_batch(warehouse, make_requests(spark, 3))
    assert warehouse.check().filter("NOT exists").isEmpty() and warehouse.uncovered_days().isEmpty()
    early = '{"ticks":[{"symbol":"OLD","value":"1","volume":"1","calendar":"jalali","timestamp":"1905-01-01T00:00:00Z"}]}'
    at = dt.datetime(2026, 3, 1, tzinfo=UTC)
    ingest_batch(warehouse, spark.createDataFrame([("old", at, early)], REQUESTS))
    for _ in range(2):
        assert [tuple(r) for r in warehouse.uncovered_days().collect()] == [("OLD", dt.date(1905, 1, 1), 1)]
        warehouse.compact()
    warehouse.seed_calendar()
    assert warehouse.calendar().count() == 69398


def test_views_and_reset(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 10))
    warehouse.create_views()
    assert spark.sql("SELECT * FROM candles_1d_jalali ORDER BY bucket_start DESC LIMIT 50").count() > 0
    assert spark.sql("SELECT count(*) FROM symbols").first()[0] == 4
    with pytest.raises(ValueError):
        Warehouse.reset(spark, warehouse.path)
    fresh = Warehouse.reset(spark, warehouse.path, confirm=True)
    assert fresh.ticks().isEmpty() and fresh.calendar().count() == 69398


def test_opening_keeps_the_number_of_buckets(spark, warehouse):
    assert Warehouse.create(spark, warehouse.path, buckets=99).buckets == 4
    with pytest.raises(FileNotFoundError):
        Warehouse(spark, warehouse.path + "-elsewhere")


def test_stream_equals_batch_and_restarts(spark, folder):
    source, path = folder + "/requests", folder + "/wh"
    requests = make_requests(spark, 24)
    requests.filter("request_id < '00016'").repartition(2).write.parquet(source)
    Warehouse.create(spark, path, buckets=4)

    def run():
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
        start_stream(stream, path, folder + "/checkpoint", availableNow=True).awaitTermination()

    run()
    assert Warehouse(spark, path).snapshot().last_batch == 1
    requests.filter("request_id >= '00016'").coalesce(1).write.mode("append").parquet(source)
    run()
    whole = Warehouse.create(spark, folder + "/batch", buckets=4)
    ingest_batch(whole, requests)
    assert served(Warehouse(spark, path)) == served(whole)


def test_state_schema_is_stable(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 3))
    names = [f.name for f in CANDLE_STATE]
    assert warehouse.states().columns == names
    warehouse.compact()
    assert warehouse.states().columns == names


def scans(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "FileScan" in line]


def test_pages_by_number_equal_the_offset_form_and_read_no_more_far_in(spark, warehouse):
    from tickloom.operators import reads as R

    many = make_requests(spark, 200, symbols={"BTC": "gregorian", "IRR": "jalali"})
    ingest_batch(warehouse, many.filter("request_id < '00100'"))
    warehouse.compact()
    ingest_batch(warehouse, many.filter("request_id >= '00100'"))
    warehouse.expire_ticks(0, dt.datetime(2020, 6, 10, 9, tzinfo=UTC))
    ticks = R.ticks_in_range(warehouse.ticks(), R.parse_range("2020-04-01", "2021-03-01"))
    want = [tuple(r) for r in R.format_ticks(ticks.orderBy("symbol", "ts", "value", "volume")).collect()]
    for page in (1, len(want) // 60, 1 + len(want) // 30, 99):
        found = warehouse.read_ticks(["BTC", "IRR"], "2020-04-01", "2021-03-01", page=page, limit=30)
        part = want[30 * (page - 1) :][:30]
        assert [tuple(r) for r in found.rows.collect()] == part
        assert tuple(found.metadata.first()) == (page, 30, len(want) > 30 * page, len(part))
    candles = warehouse.read_candles(["BTC", "IRR"], "2020-04-01", "2021-03-01", "1d", limit=1000).rows.collect()
    for page in (4, len(candles) // 20 + 1, 99):
        found = warehouse.read_candles(["BTC", "IRR"], "2020-04-01", "2021-03-01", "1d", page=page, limit=20)
        assert found.rows.collect() == candles[20 * (page - 1) :][:20]


def test_a_far_page_sorts_a_few_days_only(spark, warehouse):
    from tickloom.operators import reads as R

    ingest_batch(warehouse, make_requests(spark, 300, symbols={"BTC": "gregorian"}))
    seen = warehouse.snapshot()
    total = warehouse.ticks().count()
    rows = warehouse.ticks(["BTC"], None, seen)
    day = F.to_date("ts")
    read = []
    for page in (1, total // 20):
        _, span = R.page_in(rows, ["symbol", "ts", "value", "volume"], warehouse._day_counts(["BTC"], seen), day, page, 10)
        read.append(rows.filter(R.in_span(span, day)).count())
    assert max(read) < 40 < total / 5


def test_latest_of_stored_rows(spark, warehouse):
    from tickloom.operators import reads as R

    assert warehouse.latest_ticks(5).isEmpty() and warehouse.latest_candles(5, "1m").isEmpty()
    many = make_requests(spark, 80)
    ingest_batch(warehouse, many.filter("request_id < '00040'"))
    warehouse.compact()
    ingest_batch(warehouse, many.filter("request_id >= '00040'"))
    for n, names in ((1, None), (25, None), (1000, None), (10, ["IRR", "NOPE"])):
        rows = warehouse.ticks() if names is None else warehouse.ticks().filter(F.col("symbol").isin(names))
        want = R.format_ticks(R.latest(rows, "ts", n, "symbol", "value", "volume")).collect()
        assert warehouse.latest_ticks(n, names).collect() == want
    states = warehouse.states(TIMEFRAMES)
    for timeframe, n in (("1d", 12), ("1m", 5), ("1y", 50)):
        every = finish(merge_states(states.filter(F.col("timeframe") == timeframe)))
        got = [(r["symbol"], r["bucket_start"][:10]) for r in warehouse.latest_candles(n, timeframe).collect()]
        assert got == [(r["symbol"], str(r["bucket_start"])) for r in R.latest(every, "bucket_start", n, "symbol").collect()]
    # older months are not read
    warehouse.compact()
    text = warehouse.latest_ticks(3)._jdf.queryExecution().executedPlan().toString()
    assert "(ts_month" in text.split("PartitionFilters")[1].split("]")[0]


def test_a_table_of_symbols_prunes_buckets(spark, folder):
    warehouse = Warehouse.create(spark, folder + "/wide", buckets=64)
    symbols = {f"s{i:03}": "gregorian" for i in range(300)}
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    tick = {"value": "1", "volume": "1", "calendar": "gregorian", "timestamp": "2026-01-01T00:00:00Z"}
    body = json.dumps({"ticks": [tick | {"symbol": s} for s in symbols]})
    ingest_batch(warehouse, spark.createDataFrame([("r", at, body)], REQUESTS))
    names = spark.createDataFrame([("s001",), ("s002",), ("NOPE",)], "symbol string")
    for _ in range(2):
        found, _ = warehouse.candles(names, "2026-01-01", "2026-01-01", "1d")
        text = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SubqueryAdaptiveBroadcast dynamicpruning#\d+, \[2\]", text)
        assert {r["symbol"] for r in found.collect()} == {"s001", "s002"}
        ticks = warehouse.read_ticks(names, "2026-01-01", "2026-01-01").rows
        assert ticks.count() == 2
        warehouse.compact()


def test_counts_read_keys_and_no_ticks(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 20))
    for _ in range(2):
        lines = scans(warehouse.check())
        assert sum("first_tick" in line or "high" in line for line in lines) == 0
        assert sum("/ticks/" in line for line in lines) == 0
        found = {r["name"]: r["rows"] for r in warehouse.check().collect()}
        assert found["ticks"] == warehouse.ticks().count() and found["symbols"] == 4
        warehouse.compact()
