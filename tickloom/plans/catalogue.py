"""Every operator as a query over the supplied tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.buckets import (
    gregorian_bucket,
    saturday_start,
    tehran_date,
    utc_date,
)
from tickloom.functions.jalali import build_jalali_calendar, label_calendar
from tickloom.functions.text import format_decimal, format_instant
from tickloom.operators import candles as C
from tickloom.operators import lifecycle as L
from tickloom.operators import reads as R
from tickloom.operators import registry as G
from tickloom.operators import validation as V
from tickloom.schema import GREGORIAN, JALALI, PRICE, REGISTRY, TIMEFRAMES
from tickloom.session import configure, ensure_checkpoint_dir, scratch_path
from tickloom.sources import adapters as A
from tickloom.sources.requests import parse_requests
from tickloom.sources.warehouse import Warehouse
from tickloom.streaming.ingest import ingest_batch, start_stream

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
RANGE = R.parse_range("1996-03-20", "1998-09-30")


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        _QUERIES[name] = configured
        return configured

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _as_of() -> Column:
    return F.lit("2024-01-31").cast("timestamp")


def _candle_rows(states: DataFrame) -> DataFrame:
    return C.format_candles(C.finish(states))


def _symbol(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key))


def _low_balance_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both symbols of every supplier in debt."""
    status = F.explode(F.array(F.lit("F"), F.lit("O")))
    return (
        A.table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") < 0)
        .select("s_suppkey", status.alias("status"))
        .select(F.concat(_symbol("s_suppkey"), F.lit("-"), "status").alias("symbol"))
    )


# --- candles ----------------------------------------------------------------


def _candle_query(calendar: str, timeframe: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = label_calendar(spark)
        ticks = A.lineitem_ticks(spark, sf_dir)
        rows = C.finish(C.candle_states(ticks, calendar, timeframe, labels))
        if calendar == JALALI:
            rows = C.with_jalali_labels(rows, labels)
        return C.format_candles(rows).drop("calendar", "timeframe")

    return run


for _calendar in (GREGORIAN, JALALI):
    for _timeframe in TIMEFRAMES:
        query(f"candles_{_timeframe}_{_calendar}")(_candle_query(_calendar, _timeframe))


@query("candles_all_calendars")
def candles_all_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_calendar(spark)
    ticks = A.lineitem_ticks(spark, sf_dir)
    gregorian = C.finish(C.candle_states(ticks, GREGORIAN, "1m"))
    jalali = C.with_jalali_labels(C.finish(C.candle_states(ticks, JALALI, "1m", labels)), labels)
    both = gregorian.unionByName(jalali, allowMissingColumns=True)
    return C.format_candles(both).drop("timeframe")


@query("candles_formatted")
def candles_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_calendar(spark)
    days = C.finish(C.day_states(A.events_ticks(spark, sf_dir)))
    return C.format_candles(C.with_jalali_labels(days, labels))


def _day_key(df: DataFrame) -> DataFrame:
    return df.withColumn("day", utc_date(F.col("ts")))


@query("ohlcv_open_close")
def ohlcv_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = C.aggregate_ticks(_day_key(A.orders_ticks(spark, sf_dir)), ["symbol", "day"])
    return C.open_close(states).select(
        "symbol",
        F.col("day").cast("string").alias("day"),
        format_decimal(F.col("open")).alias("open"),
        format_decimal(F.col("close")).alias("close"),
        format_instant(F.col("open_ts")).alias("open_ts"),
        format_instant(F.col("close_ts")).alias("close_ts"),
    )


@query("ohlcv_high_low")
def ohlcv_high_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = C.aggregate_ticks(_day_key(A.events_ticks(spark, sf_dir)), ["symbol", "day"])
    return states.select(
        "symbol",
        F.col("day").cast("string").alias("day"),
        format_decimal(F.col("high")).alias("high"),
        format_decimal(F.col("low")).alias("low"),
    )


@query("ohlcv_volume_count")
def ohlcv_volume_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = C.aggregate_ticks(_day_key(A.events_ticks(spark, sf_dir)), ["symbol", "day"])
    return states.select(
        "symbol",
        F.col("day").cast("string").alias("day"),
        format_decimal(F.col("volume")).alias("volume"),
        "ticks",
    )


@query("merge_candle_states")
def merge_candle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day states written per batch, then merged as a read would."""
    ticks = A.lineitem_ticks(spark, sf_dir)
    keyed = ticks.withColumns(
        {
            "bucket_start": C.local_date(F.col("ts"), F.col("calendar")),
            "timeframe": F.lit("1d"),
        }
    )
    partial = C.aggregate_ticks(keyed, ["symbol", "calendar", "timeframe", "bucket_start", "batch_id"])
    return _candle_rows(C.merge_states(partial))


@query("rollup_from_days")
def rollup_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = C.day_states(A.lineitem_ticks(spark, sf_dir))
    return _candle_rows(C.rollup(days, label_calendar(spark)))


@query("late_ticks")
def late_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders come in by order key, so nearly every tick is late; weeks and how
    many batches added to each."""
    keyed = A.orders_ticks(spark, sf_dir).withColumns(
        {
            "bucket_start": gregorian_bucket(utc_date(F.col("ts")), "1w"),
            "timeframe": F.lit("1w"),
        }
    )
    partial = C.aggregate_ticks(keyed, ["symbol", "calendar", "timeframe", "bucket_start", "batch_id"])
    merged = C.merge_states(partial, C.STATE_KEYS, F.count(F.lit(1)).alias("batches"))
    return C.format_candles(C.finish(merged, "batches"))


# --- calendars --------------------------------------------------------------


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        A.table(spark, sf_dir, "orders")
        .groupBy(utc_date(F.col("o_orderdate").cast("timestamp")).alias("day"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


@query("jalali_calendar")
def jalali_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the dimension, and how many orders it has."""
    dim = build_jalali_calendar(spark)
    joined = dim.join(_order_days(spark, sf_dir), F.col("day") == F.col("gregorian_date"), "left")
    joined = joined.withColumn("orders", F.coalesce("orders", F.lit(0)))
    dates = [f.name for f in joined.schema if f.name.endswith("date")]
    return joined.drop("day").withColumns({c: F.col(c).cast("string") for c in dates})


@query("gregorian_to_jalali")
def gregorian_to_jalali(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped per Jalali date of the UTC day."""
    days = (
        A.table(spark, sf_dir, "lineitem")
        .groupBy(utc_date(F.col("l_shipdate").cast("timestamp")).alias("day"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    labels = ["jalali_year", "jalali_month", "jalali_day"]
    return C.with_calendar_row(days, F.col("day"), build_jalali_calendar(spark), labels).drop("day")


@query("jalali_buckets")
def jalali_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tehran day of every tick with the week, month and year it falls in."""
    columns = ["jalali_week_start_date", "jalali_month_start_date", "jalali_year_start_date"]
    days = (
        A.lineitem_ticks(spark, sf_dir)
        .groupBy(tehran_date(F.col("ts")).alias("local_date"))
        .agg(F.count(F.lit(1)).alias("ticks"))
    )
    joined = C.with_calendar_row(days, F.col("local_date"), build_jalali_calendar(spark), columns)
    return joined.withColumns({c: F.col(c).cast("string") for c in ["local_date", *columns]})


@query("bucket_functions")
def bucket_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = A.events_ticks(spark, sf_dir).unionByName(
        A.lineitem_ticks(spark, sf_dir).drop("batch_id")
    )
    days = ticks.groupBy(utc_date(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("ticks"))
    return days.select(
        *(gregorian_bucket(F.col("day"), tf).cast("string").alias(f"start_{tf}") for tf in TIMEFRAMES),
        "ticks",
    )


@query("tehran_local_date")
def tehran_local_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = A.events_ticks(spark, sf_dir).unionByName(
        A.lineitem_ticks(spark, sf_dir).drop("batch_id")
    )
    return (
        ticks.groupBy(tehran_date(F.col("ts")).alias("local_date"))
        .agg(F.count(F.lit(1)).alias("ticks"))
        .withColumn("local_date", F.col("local_date").cast("string"))
    )


@query("saturday_week")
def saturday_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_days(spark, sf_dir).select(
        F.col("day").cast("string").alias("day"),
        saturday_start(F.col("day")).cast("string").alias("week_start"),
        "orders",
    )


# --- reads ------------------------------------------------------------------


@query("ticks_by_symbol")
def ticks_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = A.events_ticks(spark, sf_dir)
    return R.format_ticks(ticks.filter(R.symbols_predicate(["purchase"])))


@query("symbols_in_list")
def symbols_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = A.events_ticks(spark, sf_dir)
    return R.format_ticks(ticks.filter(R.symbols_predicate(["click", "signup", "unknown"])))


@query("ticks_range_gregorian")
def ticks_range_gregorian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.format_ticks(R.ticks_in_utc_range(A.lineitem_ticks(spark, sf_dir), RANGE))


@query("ticks_range_jalali")
def ticks_range_jalali(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.format_ticks(R.ticks_in_tehran_range(A.lineitem_ticks(spark, sf_dir), RANGE))


@query("ticks_formatted")
def ticks_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.format_ticks(A.events_ticks(spark, sf_dir))


def _range_query(calendar: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ticks = A.lineitem_ticks(spark, sf_dir)
        states = C.candle_states(ticks, calendar, "1w")
        return _candle_rows(R.candles_in_range(states, RANGE))

    return run


query("candles_range_gregorian")(_range_query(GREGORIAN))
query("candles_range_jalali")(_range_query(JALALI))


@query("read_candles")
def read_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of all suppliers in debt, each by its registered calendar."""
    ticks = A.lineitem_ticks(spark, sf_dir)
    registry = G.registry_resolve(ticks.select("symbol", "calendar", F.col("ts").alias("created_at")))
    found = G.symbol_lookup(_low_balance_symbols(spark, sf_dir), registry).filter("found")
    labels = label_calendar(spark)
    # a month that starts in the range ends within a month of it
    days = C.day_states(ticks).filter(F.col("bucket_start").between(F.lit(RANGE.first), F.lit(RANGE.last + dt.timedelta(days=31))))
    candles = R.read_candles(C.rebucket(R.routed(days, found), labels, ["1m"]), RANGE, "1m")
    return C.format_candles(C.with_jalali_labels(candles, labels)).drop("timeframe")


def _event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.finish(C.day_states(A.events_ticks(spark, sf_dir)))


@query("ticks_page")
def ticks_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = R.page_of(A.events_ticks(spark, sf_dir), ["ts", "value", "volume", "symbol"], 3, 500)
    return R.format_ticks(page.rows)


@query("candles_page")
def candles_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = R.page_of(_event_days(spark, sf_dir), ["symbol", "bucket_start"], 2, 40)
    return C.format_candles(page.rows)


@query("page_has_more")
def page_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the first, a middle, the last and a page past the end."""
    ensure_checkpoint_dir(spark)
    days = _event_days(spark, sf_dir).checkpoint()
    order = ["symbol", "bucket_start"]
    pages = [R.page_of(days, order, n, 50).metadata for n in (1, 2, 4, 99)]
    result = pages[0]
    for metadata in pages[1:]:
        result = result.unionByName(metadata)
    return result


@query("latest_candles")
def latest_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.format_candles(R.latest(_event_days(spark, sf_dir), "bucket_start", 50, "symbol"))


# --- ingest -----------------------------------------------------------------


def _colliding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a symbol per user: calendars collide within and across requests."""
    return A.event_inputs(spark, sf_dir, F.concat(F.lit("U"), F.col("user_id")))


def _mixed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables read as ticks that fail in every way."""
    day = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    columns = ["request_id", "received_at", "pos", "symbol", "value", "volume", "calendar", "timestamp"]

    def inputs(name: str, key: str, **fields: Column) -> DataFrame:
        return A.table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}:"), F.col(key)).alias("request_id"),
            F.timestamp_seconds(F.col(key)).alias("received_at"),
            *(value.alias(field) for field, value in fields.items()),
        ).select(*columns)

    noon = F.lit("2024-01-01T12:00:00+03:30")
    events = A.event_inputs(spark, sf_dir)
    events = events.withColumn("request_id", F.concat(F.lit("events:"), "request_id"))
    customers = inputs(
        "customer",
        "c_custkey",
        pos=F.lit(0),
        symbol=F.col("c_name"),
        value=F.concat(F.lit(" "), F.col("c_acctbal").cast(PRICE).cast("string"), F.lit("\t")),
        volume=F.lit("1"),
        calendar=F.lit(GREGORIAN),
        timestamp=noon,
    )
    orders = inputs(
        "orders",
        "o_orderkey",
        pos=F.lit(0),
        symbol=F.col("o_orderpriority"),
        value=F.col("o_totalprice").cast(PRICE).cast("string"),
        volume=F.lit("1"),
        calendar=F.when(F.col("o_orderstatus") == "P", JALALI).otherwise(F.col("o_orderstatus")),
        timestamp=F.date_format(F.col("o_orderdate").cast("timestamp"), day),
    )
    turns = inputs(
        "conversations",
        "conv_id",
        pos=F.col("turn").cast("int"),
        symbol=F.when(F.col("role") == "user", F.lit("   ")).otherwise(F.col("role")),
        value=F.col("text"),
        volume=F.col("turn").cast("string"),
        calendar=F.lit(JALALI),
        timestamp=F.when(F.col("role") == "assistant", F.col("text")),
    )
    return events.unionByName(customers).unionByName(orders).unionByName(turns)


@query("validate_ticks")
def validate_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = V.validate(_mixed_inputs(spark, sf_dir))
    return checked.select(
        "request_id", "pos", "malformed", V.reason_of(F.col("fault")).alias("reason")
    )


@query("normalize_ticks")
def normalize_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = V.split_batches(V.validate(_mixed_inputs(spark, sf_dir))).accepted
    rows = V.normalize(accepted)
    return R.format_ticks(rows.withColumn("symbol", F.concat("calendar", F.lit("/"), "symbol")))


@query("reject_batches")
def reject_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.split_batches(V.validate(_mixed_inputs(spark, sf_dir))).rejected
    collided = V.split_batches(V.validate(_colliding_inputs(spark, sf_dir))).rejected
    return own.unionByName(collided)


@query("accepted_counts")
def accepted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = V.split_batches(V.validate(_colliding_inputs(spark, sf_dir)))
    return V.accepted_counts(split.accepted)


@query("batch_conflicts")
def batch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.batch_conflicts(V.batch_claims(_colliding_inputs(spark, sf_dir)))


@query("first_calendar")
def first_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _colliding_inputs(spark, sf_dir)
    return V.first_calendars(inputs, "request_id", "symbol").select(
        "request_id", "symbol", "calendar", "pos"
    )


@query("distinct_symbols")
def distinct_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.distinct_symbols(_colliding_inputs(spark, sf_dir))


@query("parse_tick_json")
def parse_tick_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real request bodies, JSON of another shape, and plain text."""
    sent = A.as_requests(A.event_inputs(spark, sf_dir))
    props = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("props:"), F.col("event_id")).alias("request_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.col("props").alias("body"),
    )
    texts = A.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("text:"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("request_id"),
        F.timestamp_seconds("conv_id").alias("received_at"),
        F.col("text").alias("body"),
    )
    return parse_requests(sent.unionByName(props).unionByName(texts)).drop("received_at")


# --- registry ---------------------------------------------------------------


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks by supplier alone, so that a symbol comes with both calendars."""
    ticks = A.lineitem_ticks(spark, sf_dir)
    return ticks.withColumn("symbol", F.substring_index("symbol", "-", 1))


def _supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _shipments(spark, sf_dir)
    return G.registry_resolve(ticks.select("symbol", "calendar", F.col("ts").alias("created_at")))


@query("registry_resolve")
def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_registry(spark, sf_dir).withColumn(
        "created_at", format_instant(F.col("created_at"))
    )


@query("calendar_mismatches")
def calendar_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ticks only count here, so they collapse before they meet the registry
    counted = _shipments(spark, sf_dir).groupBy("symbol", "calendar").agg(F.count(F.lit(1)).alias("ticks"))
    wrong = G.calendar_mismatches(counted, _supplier_registry(spark, sf_dir))
    return wrong.select("symbol", "registered", F.col("calendar").alias("received"), "ticks")


@query("new_symbols")
def new_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded suppliers not in a registry of those without debt."""
    registry = (
        A.table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") >= 0)
        .select(_symbol("s_suppkey").alias("symbol"))
    )
    return G.new_symbols(V.distinct_symbols(_shipments(spark, sf_dir)), registry)


@query("symbol_lookup")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys looked up among suppliers: some known, most not."""
    requested = A.table(spark, sf_dir, "customer").select(_symbol("c_custkey").alias("symbol"))
    return G.symbol_lookup(requested, _supplier_registry(spark, sf_dir))


@query("resolve_registrations")
def resolve_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order of arrival against a registry that starts empty."""
    inputs = _colliding_inputs(spark, sf_dir)
    split = V.split_batches(V.validate(inputs))
    resolution = G.resolve(split.claims, spark.createDataFrame([], REGISTRY))
    registered = resolution.new_symbols.select(
        F.lit("registered").alias("outcome"), F.col("symbol").alias("name"), F.col("calendar").alias("detail")
    )
    rejected = resolution.rejected.select(
        F.lit("rejected").alias("outcome"), F.col("request_id").alias("name"), F.col("reason").alias("detail")
    )
    return registered.unionByName(rejected)


# --- storage and streams ----------------------------------------------------


def _served(warehouse: Warehouse, timeframes: tuple[str, ...] = TIMEFRAMES) -> DataFrame:
    return _candle_rows(C.merge_states(warehouse.states(timeframes)))


@query("stream_candles")
def stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies streamed in several micro-batches into a new warehouse."""
    source, path = scratch_path(spark, "requests"), scratch_path(spark, "warehouse")
    requests = A.as_requests(A.event_inputs(spark, sf_dir))
    # as many files as the data calls for, several in any case
    requests.write.option("maxRecordsPerFile", 50_000).parquet(f"{source}/all")
    requests = spark.read.schema(requests.schema).parquet(f"{source}/all")
    requests = requests.coalesce(1 + requests.count() // 50_000)
    halves = F.pmod(F.crc32(F.col("request_id").cast("binary")), F.lit(2))
    requests.withColumn("half", halves).write.partitionBy("half").parquet(f"{source}/parts")
    source = f"{source}/parts/*"
    Warehouse.create(spark, path, buckets=4)
    # a file is one task's work: a micro-batch has one for each core, if that leaves several micro-batches
    files = min(spark.sparkContext.defaultParallelism, len(spark.read.parquet(source).inputFiles()) // 2)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", max(1, files)).parquet(source)
    run = start_stream(stream, path, scratch_path(spark, "stream"), availableNow=True)
    run.awaitTermination()
    return _served(Warehouse(spark, path))


@query("ingest_then_stream")
def ingest_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, then a stream with a checkpoint of its own over the rest."""
    source, path = scratch_path(spark, "requests"), scratch_path(spark, "warehouse")
    requests = A.as_requests(A.event_inputs(spark, sf_dir))
    third = F.pmod(F.crc32(F.col("request_id").cast("binary")), F.lit(3))
    warehouse = Warehouse.create(spark, path, buckets=4)
    for k in (0, 1):
        ingest_batch(warehouse, requests.filter(third == k))
    requests.filter(third == 2).write.parquet(source)
    stream = spark.readStream.schema(requests.schema).parquet(source)
    start_stream(stream, path, scratch_path(spark, "stream"), availableNow=True).awaitTermination()
    return _served(warehouse)


@query("stored_reads")
def stored_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of all registered symbols, read back from a warehouse as a user does."""
    warehouse = Warehouse.create(spark, scratch_path(spark, "warehouse"), buckets=4)
    ingest_batch(warehouse, A.as_requests(A.event_inputs(spark, sf_dir)))
    symbols = warehouse.registry().select("symbol")
    candles, _ = warehouse.candles(symbols, "2023-01-01", "2024-12-31", "1w")
    return C.format_candles(C.with_jalali_labels(candles, label_calendar(spark))).drop("timeframe")


def _stored_events(spark: SparkSession, sf_dir: str) -> Warehouse:
    """All events, half of them merged, and early ones expired."""
    warehouse = Warehouse.create(spark, scratch_path(spark, "warehouse"), buckets=4)
    requests = A.as_requests(A.event_inputs(spark, sf_dir))
    half = F.pmod(F.crc32(F.col("request_id").cast("binary")), F.lit(2))
    ingest_batch(warehouse, requests.filter(half == 0))
    warehouse.compact()
    ingest_batch(warehouse, requests.filter(half == 1))
    warehouse.expire_ticks(22, AS_OF)
    return warehouse


@query("stored_tick_pages")
def stored_tick_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by its number, and the latest ticks, read back from a warehouse."""
    warehouse = _stored_events(spark, sf_dir)
    symbols = ["click", "purchase", "signup", "view"]
    page = warehouse.read_ticks(symbols, "2024-01-05", "2024-01-28", page=4, limit=90).rows
    parts = {"page": page, "latest": warehouse.latest_ticks(70), "latest views": warehouse.latest_ticks(40, ["view"])}
    rows = [df.select(F.lit(name).alias("part"), "*") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("stored_candle_pages")
def stored_candle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by its number, and the latest candles of a timeframe, read back from a warehouse."""
    warehouse = _stored_events(spark, sf_dir)
    page = warehouse.read_candles(["click", "purchase", "view"], "2024-01-01", "2024-12-31", "1d", page=2, limit=20).rows
    parts = {"page": page, "latest": warehouse.latest_candles(9, "1w"), "latest jalali": warehouse.latest_candles(3, "1d", calendar=JALALI)}
    rows = [df.select(F.lit(name).alias("part"), "*") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("expired_ticks")
def expired_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks left per symbol when the last seven days are kept."""
    kept = L.unexpired(A.events_ticks(spark, sf_dir), 7, _as_of())
    return kept.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("ticks"), format_instant(F.min("ts")).alias("oldest")
    )


@query("old_tick_count")
def old_tick_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.old_tick_count(A.events_ticks(spark, sf_dir), _as_of())


@query("delete_symbols")
def delete_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt deleted after batch 3; what came later counts again."""
    gone = _low_balance_symbols(spark, sf_dir).withColumn("since", F.lit(3).cast("bigint"))
    left = L.undeleted(A.lineitem_ticks(spark, sf_dir), gone)
    return _candle_rows(C.rollup(C.day_states(left), label_calendar(spark), ["1y"]))


@query("delete_summary")
def delete_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = A.lineitem_ticks(spark, sf_dir).join(
        _low_balance_symbols(spark, sf_dir), "symbol", "left_semi"
    )
    return L.delete_summary(C.rollup(C.day_states(ticks), label_calendar(spark)))
