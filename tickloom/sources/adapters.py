"""Supplied tables read as ticks or as ingest requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import GREGORIAN, JALALI, PRICE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts.cast("timestamp"))


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol per supplier and line status; finished lines trade in Jalali days."""
    shipped = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    ts = F.timestamp_seconds(shipped + F.col("l_orderkey") % 86400)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey"), F.lit("-"), F.col("l_linestatus")).alias("symbol"),
        F.when(F.col("l_linestatus") == "F", JALALI).otherwise(GREGORIAN).alias("calendar"),
        F.col("l_extendedprice").cast(PRICE).alias("value"),
        F.col("l_quantity").cast(PRICE).alias("volume"),
        ts.alias("ts"),
        F.col("l_linenumber").alias("batch_id"),
    )


def orders_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five symbols with many equal instants, arriving in order of the order key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.lit(GREGORIAN).alias("calendar"),
        F.col("o_totalprice").cast(PRICE).alias("value"),
        F.lit(1).cast(PRICE).alias("volume"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("batch_id"),
    )


def _event_calendar() -> Column:
    return F.when(F.col("event_type").isin("purchase", "signup"), JALALI).otherwise(GREGORIAN)


def _event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five busy symbols, each with about a fifth of all rows."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        _event_calendar().alias("calendar"),
        F.col("value").cast(PRICE).alias("value"),
        (_event_k() + 1).cast(PRICE).alias("volume"),
        _millis(F.col("ts")).alias("ts"),
    )


def event_inputs(spark: SparkSession, sf_dir: str, symbol: Column | None = None) -> DataFrame:
    """Events as raw tick texts, twenty consecutive ones to a request.

    A volume of "0" occurs, so some requests are invalid. ``symbol`` defaults to
    the event type, which fixes the calendar; any other choice makes calendars
    collide.
    """
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 20).cast("string").alias("request_id"),
        F.timestamp_seconds(F.floor(F.col("event_id") / 20)).alias("received_at"),
        (F.col("event_id") % 20).cast("int").alias("pos"),
        (F.col("event_type") if symbol is None else symbol).alias("symbol"),
        F.col("value").cast(PRICE).cast("string").alias("value"),
        _event_k().cast("string").alias("volume"),
        _event_calendar().alias("calendar"),
        F.date_format(
            F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
        ).alias("timestamp"),
    )


def as_requests(inputs: DataFrame) -> DataFrame:
    """Raw tick texts packed into JSON request bodies, as a client would send them."""
    fields = ["symbol", "value", "volume", "calendar", "timestamp"]
    return (
        inputs.groupBy("request_id", "received_at")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("tick")))).alias("t"))
        .select(
            "request_id",
            "received_at",
            F.to_json(F.struct(F.col("t.tick").alias("ticks"))).alias("body"),
        )
    )
