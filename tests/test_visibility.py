"""What a reader may see: batches of several sources, attempts that stop, sessions in other zones."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_warehouse import UTC, make_requests, served

from tickloom.operators.reads import UnknownSymbolError
from tickloom.schema import REQUESTS
from tickloom.sources.warehouse import Warehouse
from tickloom.streaming.ingest import ingest_batch, start_stream


@pytest.fixture
def warehouse(spark, folder):
    return Warehouse.create(spark, folder + "/wh", buckets=4)


def whole(spark, folder, requests):
    other = Warehouse.create(spark, folder + "/whole", buckets=4)
    ingest_batch(other, requests)
    return other


def run_stream(spark, warehouse, requests, folder, name):
    requests.coalesce(1).write.mode("append").parquet(f"{folder}/{name}-source")
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}-source")
    start_stream(stream, warehouse.path, f"{folder}/{name}-checkpoint", availableNow=True).awaitTermination()


def test_batches_and_two_streams_keep_apart(spark, warehouse, folder):
    requests = make_requests(spark, 16)
    part = lambda a, b: requests.filter(F.col("request_id").between(f"{a:05}", f"{b:05}"))
    ingest_batch(warehouse, part(0, 3))
    warehouse.compact()
    run_stream(spark, warehouse, part(4, 7), folder, "one")
    run_stream(spark, warehouse, part(8, 11), folder, "two")
    ingest_batch(warehouse, part(12, 15))
    other = whole(spark, folder, requests)
    assert served(warehouse) == served(other)
    assert warehouse.ticks().count() == other.ticks().count()


def test_an_attempt_that_stops_stays_hidden_and_can_be_run_again(spark, warehouse, folder, monkeypatch):
    requests = make_requests(spark, 12)
    parts = [requests.filter(F.col("request_id").between(f"{4 * i:05}", f"{4 * i + 3:05}")) for i in range(3)]
    ingest_batch(warehouse, parts[0], 0)
    with monkeypatch.context() as stopped:
        stopped.setattr(Warehouse, "commit", lambda *_, **__: None)
        ingest_batch(warehouse, parts[1], 1)
    ingest_batch(warehouse, parts[2], 2)
    other = whole(spark, folder, parts[0].unionByName(parts[2]))
    assert served(warehouse) == served(other)
    warehouse.compact()
    # the middle one once more, then an early one that is there already
    ingest_batch(warehouse, parts[1], 1)
    ingest_batch(warehouse, parts[0], 0)
    everything = Warehouse.create(spark, folder + "/all", buckets=4)
    ingest_batch(everything, requests)
    assert served(warehouse) == served(everything)
    assert warehouse.ticks().count() == everything.ticks().count()


STEPS = ("write_batch", "write_day_states", "commit", "_rename")


class Stop(Exception):
    """A writer ends here."""


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_a_writer_that_stops_at_any_step_can_be_run_again(spark, warehouse, monkeypatch, step, after):
    requests = make_requests(spark, 2)
    real = getattr(Warehouse, step)

    def stopping(*args, **kwargs):
        if after:
            real(*args, **kwargs)
        raise Stop

    with monkeypatch.context() as stopped:
        stopped.setattr(Warehouse, step, stopping)
        with pytest.raises(Stop):
            ingest_batch(warehouse, requests, 7)
    shown = after and step in ("commit", "_rename")
    assert warehouse.ticks().isEmpty() != shown and warehouse.responses().isEmpty() != shown
    batch = ingest_batch(warehouse, requests, 7)
    assert batch in warehouse.snapshot().batches and ingest_batch(warehouse, requests, 7) == batch
    told = warehouse.responses().collect()
    assert sorted(r["request_id"] for r in told) == ["00000", "00001"] and {r["batch_id"] for r in told} == {batch}
    assert warehouse.ticks().count() == sum(r["accepted"] for r in told) == warehouse.commits().first()["ticks"]
    assert warehouse.commits().select("source", "number").collect() == [("batch", "7")]


def test_a_place_in_the_log_is_taken_once(spark, warehouse):
    assert warehouse._publish(0, "batch-0-a.json", "{}") and not warehouse._publish(0, "batch-1-b.json", "{}")
    assert [e.name for e in warehouse._log()] == ["batch-0-a.json"] and not warehouse._listed("pending")


def request_of(spark, name, second, *ticks):
    full = [{"value": "1", "volume": "1", "timestamp": "2026-01-01T00:00:00Z"} | t for t in ticks]
    at = dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=second)
    return spark.createDataFrame([(name, at, json.dumps({"ticks": full}))], REQUESTS)


def between(monkeypatch, act):
    """Run ``act`` once, after the next attempt is written and before it commits."""
    real, left = Warehouse.commit, [act]

    def commit(self, *args, **kwargs):
        if left:
            left.pop()()
        return real(self, *args, **kwargs)

    monkeypatch.setattr(Warehouse, "commit", commit)


def test_two_writers_give_what_one_after_the_other_does(spark, warehouse, monkeypatch):
    first = request_of(spark, "a", 0, {"symbol": "X", "calendar": "gregorian"})
    second = request_of(spark, "b", 1, {"symbol": "X", "calendar": "jalali"}).unionByName(
        request_of(spark, "c", 2, {"symbol": "Y", "calendar": "jalali"})
    )
    between(monkeypatch, lambda: ingest_batch(warehouse, first))
    ingest_batch(warehouse, second)
    told = {r["request_id"]: (r["accepted"], r["code"]) for r in warehouse.responses().collect()}
    assert told == {"a": (1, None), "b": (0, "calendar_mismatch"), "c": (1, None)}
    assert {r["symbol"]: r["calendar"] for r in warehouse.registry().collect()} == {"X": "gregorian", "Y": "jalali"}
    assert sorted((r["symbol"], r["calendar"]) for r in warehouse.ticks().collect()) == [("X", "gregorian"), ("Y", "jalali")]


def test_writers_of_other_symbols_do_not_wait(spark, warehouse, monkeypatch):
    between(monkeypatch, lambda: ingest_batch(warehouse, request_of(spark, "a", 0, {"symbol": "X", "calendar": "gregorian"})))
    ingest_batch(warehouse, request_of(spark, "b", 1, {"symbol": "Y", "calendar": "jalali"}))
    # two attempts, none of them repeated
    assert warehouse.snapshot().batches == (0, 1) and warehouse.ticks().count() == 2


def test_the_same_batch_from_two_writers_counts_once(spark, warehouse, monkeypatch):
    batch = request_of(spark, "a", 0, {"symbol": "X", "calendar": "gregorian"})
    between(monkeypatch, lambda: ingest_batch(warehouse, batch, 3))
    assert ingest_batch(warehouse, batch, 3) in warehouse.snapshot().batches
    assert warehouse.ticks().count() == 1 and warehouse.responses().count() == 1


@pytest.mark.parametrize("act", ["delete", "compact"])
def test_a_batch_beside_a_deletion_or_a_run_is_not_lost(spark, warehouse, monkeypatch, act):
    ingest_batch(warehouse, request_of(spark, "a", 0, {"symbol": "X", "calendar": "gregorian"}))

    def meanwhile():
        if act == "delete":
            warehouse.delete_symbols(["X"])
        else:
            ingest_batch(warehouse, request_of(spark, "c", 2, {"symbol": "Z", "calendar": "gregorian"}))
            warehouse.compact()

    between(monkeypatch, meanwhile)
    ingest_batch(warehouse, request_of(spark, "b", 1, {"symbol": "X", "calendar": "gregorian"}))
    kept = [r["symbol"] for r in warehouse.ticks().collect()]
    assert sorted(kept) == (["X"] if act == "delete" else ["X", "X", "Z"])
    assert "X" in {r["symbol"] for r in warehouse.registry().collect()}
    warehouse.compact()
    warehouse.vacuum(min_age=dt.timedelta(0))
    assert sorted(r["symbol"] for r in warehouse.ticks().collect()) == sorted(kept)


def test_vacuum_trims_marks_and_entries_no_row_lies_under(spark, warehouse):
    batch = request_of(spark, "a", 0, {"symbol": "X", "calendar": "gregorian"}, {"symbol": "Y", "calendar": "jalali"})
    first = ingest_batch(warehouse, batch, 1)
    warehouse.delete_symbols(["X"])
    warehouse.compact()
    # merged rows are clean, but runs written before might not be
    warehouse.compact(complete=True)
    warehouse.vacuum(min_age=dt.timedelta(0))
    assert warehouse.snapshot().deletions == () and [r["symbol"] for r in warehouse.ticks().collect()] == ["Y"]
    assert warehouse.responses().isEmpty() and len(warehouse._log()) <= 3
    # the source's batch is still known
    assert ingest_batch(warehouse, batch, 1) == first and warehouse.ticks().count() == 1
    ingest_batch(warehouse, request_of(spark, "b", 1, {"symbol": "X", "calendar": "jalali"}), 2)
    assert {r["symbol"]: r["calendar"] for r in warehouse.registry().collect()} == {"X": "jalali", "Y": "jalali"}


def test_an_undisputed_batch_takes_few_jobs(spark, warehouse):
    requests, group = make_requests(spark, 6), "one-batch"
    spark.sparkContext.setJobGroup(group, group)
    try:
        ingest_batch(warehouse, requests)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 20


def test_one_request_id_twice_gets_one_response(spark, warehouse):
    one = make_requests(spark, 1)
    batch = ingest_batch(warehouse, one.unionByName(one))
    ticks = warehouse.ticks().count()
    assert [tuple(r)[:2] for r in warehouse.responses(batch).select("request_id", "accepted").collect()] == [("00000", ticks)]
    assert warehouse.commits().first()["ticks"] == ticks


def test_another_session_zone_changes_nothing(spark, folder):
    requests = make_requests(spark, 6)
    want = served(whole(spark, folder, requests))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        there = Warehouse.create(spark, folder + "/there", buckets=4)
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        there = Warehouse(spark, folder + "/there")
        ingest_batch(there, requests)
        assert served(there) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unknown_symbols_are_told(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 8))
    page = warehouse.read_ticks(["BTC", "NOPE"], "2020-01-01", "2021-12-31")
    assert page.unknown == ("NOPE",) and page.rows.count() == warehouse.ticks().filter("symbol = 'BTC'").count()
    for read in (warehouse.read_ticks, lambda *a: warehouse.read_candles(*a, "1d")):
        with pytest.raises(UnknownSymbolError):
            read(["NOPE"], "2020-01-01", "2021-12-31")
    names = spark.createDataFrame([("BTC",), ("IRR",), ("NOPE",)], "symbol string")
    many = warehouse.read_candles(names, "2020-01-01", "2021-12-31", "1y").rows.collect()
    assert many == warehouse.read_candles(["BTC", "IRR"], "2020-01-01", "2021-12-31", "1y").rows.collect()


def test_walking_through_ticks_sees_each_once_resent_ones_too(spark, warehouse):
    requests = make_requests(spark, 5)
    for _ in range(3):
        ingest_batch(warehouse, requests)
    every = warehouse.read_ticks(["BTC", "ETH"], "2020-01-01", "2021-12-31").rows.collect()
    small = Warehouse(spark, warehouse.path, max_limit=4)
    with pytest.raises(ValueError):
        small.read_ticks(["BTC"], "2020-01-01", "2021-12-31", limit=5)
    got, after = [], None
    while True:
        page = small.read_ticks(["BTC", "ETH"], "2020-01-01", "2021-12-31", limit=4, after=after)
        rows = page.rows.collect()
        got += rows
        if not page.metadata.first()["has_more"]:
            break
        last = rows[-1]
        after = (last["symbol"], last["timestamp"].replace("Z", ""), last["value"], last["volume"], got.count(last))
    assert got == every


def test_many_symbols_over_many_buckets(spark, folder):
    warehouse = Warehouse.create(spark, folder + "/wide", buckets=1024)
    symbols = {f"s{i:03}": "gregorian" for i in range(200)}
    at = dt.datetime(2026, 1, 1, tzinfo=UTC)
    tick = {"value": "1", "volume": "1", "calendar": "gregorian", "timestamp": "2026-01-01T00:00:00Z"}
    body = json.dumps({"ticks": [tick | {"symbol": s} for s in symbols]})
    ingest_batch(warehouse, spark.createDataFrame([("r", at, body)], REQUESTS))
    for n in (1, 65, 200):
        assert warehouse.read_candles(sorted(symbols)[:n], "2026-01-01", "2026-01-01", "1d").rows.count() == n


def test_ticks_outside_the_calendar_are_counted(spark, warehouse):
    tick = {"symbol": "OLD", "value": "1", "volume": "1", "calendar": "jalali", "timestamp": "1905-01-01T00:00:00Z"}
    at = dt.datetime(2026, 3, 1, tzinfo=UTC)
    ingest_batch(warehouse, spark.createDataFrame([("old", at, json.dumps({"ticks": [tick, tick]}))], REQUESTS))
    assert warehouse.commits().first()["uncovered"] == 2


def test_a_reader_goes_on_after_compaction_and_vacuum(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 4))
    planned, n = warehouse.ticks(), warehouse.ticks().count()
    warehouse.compact()
    warehouse.vacuum()
    assert planned.count() == n
    warehouse.vacuum(min_age=dt.timedelta(0))
    assert warehouse.ticks().count() == n


def test_check_without_counts_reads_no_rows(spark, warehouse):
    ingest_batch(warehouse, make_requests(spark, 2))
    rows = warehouse.check(counts=False).collect()
    assert len(rows) == 11 and all(r["exists"] and r["rows"] is None for r in rows)
    warehouse._delete("symbols")
    with pytest.raises(RuntimeError):
        warehouse.check(counts=False)
