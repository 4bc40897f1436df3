"""Ingest of request batches, alone or as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.registry import registrations, settle
from tickloom.operators.validation import (
    normalize,
    request_marks,
    request_verdicts,
    told,
    validate,
)
from tickloom.sources.requests import parse_requests
from tickloom.sources.warehouse import RegistryMovedError, Snapshot, Warehouse


def ingest_batch(
    warehouse: Warehouse, requests: DataFrame, number: int | str | None = None, source: str = "batch"
) -> int:
    """Take in one batch of requests; the warehouse's number for it.

    ``source`` and ``number`` name the batch: one that was taken in before is not taken
    in again. Without a number it is a new batch. Everything is checked before anything is
    shown: requests that fail leave nothing but their response. Responses, symbols, ticks and
    day states are stored, and the commit makes all of them visible together. If another writer registered or
    deleted one of the symbols meanwhile, the batch is resolved anew. Deliveries
    with one request id get one response: refused if any is, else with all their ticks.
    """
    number = uuid.uuid4().hex if number is None else str(number)
    checked = _held(validate(parse_requests(requests)))
    marks = _held(request_marks(checked))
    try:
        while True:
            batch_id, seen = warehouse.begin(source, number)
            if seen is None:
                return batch_id
            told = _store(warehouse, batch_id, seen, checked, marks)
            try:
                return warehouse.commit(batch_id, source, number, *told, seen=seen, claimed=marks)
            except RegistryMovedError:
                # every time another writer got on; the next attempt reads what it left
                continue
    finally:
        marks.unpersist()
        checked.unpersist()


def _held(rows: DataFrame) -> DataFrame:
    """``rows`` persisted in as many partitions as their size calls for.

    Spark keeps a persisted result in all its shuffle partitions by default, and every job over it has as many tasks.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return rows.persist()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _store(warehouse: Warehouse, batch_id: int, seen: Snapshot, checked: DataFrame, marks: DataFrame) -> tuple[int, int, int]:
    """Write an attempt; its ticks, refused requests, and Jalali ticks outside the calendar.

    Each job counts what it writes. Most batches are undisputed: their responses are those of the checks
    alone, and their symbols are registered as they came. Where the counts say otherwise, these are written again.
    """
    verdicts = request_verdicts(marks)
    counted = _respond(warehouse, batch_id, told(verdicts))
    void = lambda: warehouse.read_batch("responses", batch_id).filter(F.col("code").isNotNull()).select("request_id")

    claims = marks.filter(F.col("pos").isNotNull()).select("request_id", "received_at", "symbol", "calendar", "pos")
    if counted["rejected"]:
        claims = claims.join(void(), "request_id", "left_anti")
    registry = warehouse.registry(seen)
    asked = registrations(claims, registry).filter("fresh OR disputed")
    disputes = warehouse.write_batch("symbols", batch_id, asked, disputed=F.count(F.when(F.col("disputed"), 1)))["disputed"]
    responses = told(verdicts, marks) if counted["conflicts"] else told(verdicts)
    if disputes:
        resolution = settle(claims, registry)
        warehouse.write_batch("symbols", batch_id, resolution.new_symbols)
        late = resolution.rejected.select("request_id", F.col("code").alias("late_code"), F.col("reason").alias("late_reason"))
        responses = responses.join(late, "request_id", "left").withColumns(
            {name: F.coalesce(name, f"late_{name}") for name in ("code", "reason")}
        )
    if disputes or counted["conflicts"]:
        counted = _respond(warehouse, batch_id, responses)

    good = checked.filter(F.col("pos").isNotNull())
    if counted["rejected"]:
        good = good.join(void(), "request_id", "left_anti")
    ticks = normalize(good)
    warehouse.write_ticks(ticks, batch_id)
    return counted["accepted"] or 0, counted["rejected"], warehouse.write_day_states(ticks, batch_id)


def _respond(warehouse: Warehouse, batch_id: int, responses: DataFrame) -> dict:
    """Store what each request is told, and count it."""
    accepted = F.when(F.col("code").isNull(), F.col("ticks")).otherwise(F.lit(0))
    return warehouse.write_batch(
        "responses",
        batch_id,
        responses.withColumn("accepted", accepted),
        accepted=F.sum("accepted"),
        rejected=F.count("code"),
        conflicts=F.count("conflict_pos"),
    )


def start_stream(
    requests: DataFrame, path: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Ingest a stream into the warehouse at ``path``; every late tick still finds its old candle.

    No watermark and no state store: what a batch adds to a candle is written
    as a partial state and merged when candles are read. The checkpoint's own id
    names the source, so a stream with a new checkpoint is a new source.
    ``trigger`` takes the arguments of ``DataStreamWriter.trigger``.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        about = session.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()
        ingest_batch(Warehouse(session, path), batch, batch_id, f"stream:{about['id']}")

    writer = requests.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
