"""Tables on shared storage: batches as they arrive, and runs that merge them.

    <path>/settings                         one row, fixed when created
    <path>/jalali_calendar/version=V        the date dimension, the last version counts
    <path>/<table>/delta/batch_id=N/...     one folder per attempt to ingest a batch
    <path>/<table>/base/run=R/...           batches merged by ``compact``
    <path>/attempts/N                       numbers given out
    <path>/log/version=V/...                what changed, one entry after the other
    <path>/sources/<key>                    batches whose entries are no longer in the log
    <path>/retention                        ticks expired

The warehouse numbers its batches itself: every attempt gets a number of its own,
so no two sources and no two attempts share a folder. Whatever changes what readers see is an entry of the
log: a batch, a deletion, a run of merged batches. An entry is written aside and put in its
place by one renaming, which fails if the place is taken: so it is there as a whole or not
at all, and all entries have one order. A batch's entry names the source's batch, so that one that is run
again is found and nothing is done. A writer that finds entries later than those it read
looks whether they touch its symbols; if so its batch is resolved anew, as if it came after them.
Any number of readers and writers. Storage must rename a folder in one step, and only to a free
place (HDFS and local disks do).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.buckets import local_date, symbol_bucket, utc_day_range
from tickloom.functions.jalali import (
    FIRST_DAY,
    LAST_DAY,
    build_jalali_calendar,
    check_calendar,
    label_calendar,
)
from tickloom.operators.candles import (
    day_states,
    finish,
    format_candles,
    merge_states,
    rebucket,
    with_jalali_labels,
)
from tickloom.operators.lifecycle import (
    CANDLE_TABLES,
    delete_summary,
    kept_since,
    old_tick_count,
    table_counts,
    undeleted,
)
from tickloom.operators.reads import (
    DayRange,
    Page,
    UnknownSymbolError,
    candles_in_range,
    check_page,
    check_timeframe,
    format_ticks,
    latest,
    newest_days,
    page_after,
    page_in,
    page_of,
    parse_range,
    read_candles,
    route_predicate,
    routed,
    symbols_predicate,
    ticks_in_range,
)
from tickloom.operators.registry import registry_resolve, symbol_lookup
from tickloom.schema import CANDLE_STATE, GREGORIAN, JALALI, JALALI_CALENDAR, MAX_LIMIT, REGISTRY, TICKS, TIMEFRAMES
from tickloom.session import configure, scratch_path

#: Files that no reader needs any more stay this long, for readers that planned before.
MIN_AGE = dt.timedelta(hours=24)

_COMMITS = (
    "batch_id long, source string, number string, ticks long, rejected long, uncovered long, committed_at string"
)
_DELETIONS = "symbol string, since long, deleted_at timestamp"
_RETENTION = "cutoff timestamp"


def _partitioned(schema: T.StructType, *columns: tuple[str, T.DataType]) -> T.StructType:
    names = {name for name, _ in columns}
    return T.StructType(
        [f for f in schema.fields if f.name not in names]
        + [T.StructField(name, kind) for name, kind in columns]
    )


_BATCH = ("batch_id", T.LongType())
_BUCKET = ("symbol_bucket", T.IntegerType())
_RUN = ("run", T.StringType())
_TICKS_DELTA = _partitioned(TICKS, _BATCH, _BUCKET)
_TICKS_BASE = _partitioned(
    T.StructType(TICKS.fields + [T.StructField(*_BATCH)]),
    _RUN,
    _BUCKET,
    ("ts_month", T.StringType()),
)
_STATES_DELTA = _partitioned(CANDLE_STATE, _BATCH, _BUCKET)
_STATES_BASE = _partitioned(
    T.StructType(CANDLE_STATE.fields + [T.StructField(*_BATCH)]),
    _RUN,
    ("timeframe", T.StringType()),
    _BUCKET,
    ("calendar", T.StringType()),
)
_REGISTRY_DELTA = _partitioned(REGISTRY, _BATCH)
_REGISTRY_BASE = _partitioned(T.StructType(REGISTRY.fields + [T.StructField(*_BATCH)]), _RUN)
_RESPONSES_BATCH = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("accepted", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
_RESPONSES_DELTA = _partitioned(_RESPONSES_BATCH, _BATCH)
_BATCH_SCHEMAS = {
    "ticks": _partitioned(TICKS, _BUCKET),
    "states": _partitioned(CANDLE_STATE, _BUCKET),
    "symbols": REGISTRY,
    "responses": _RESPONSES_BATCH,
}


class RegistryMovedError(RuntimeError):
    """Another writer changed what a batch was checked against."""


class Entry(NamedTuple):
    """An entry of the log, told from its place and name alone.

    ``batch-<batch>-<key>``, ``deletion-<last batch hidden>``,
    ``run-<table>-<run>-<last batch merged>-<last version seen>-<1 if complete>``.
    """

    version: int
    name: str

    @property
    def kind(self) -> str:
        return self.name.split("-")[0]

    @property
    def parts(self) -> list[str]:
        return self.name.removesuffix(".json").split("-")[1:]

    @property
    def place(self) -> str:
        return f"log/version={self.version}/{self.name}"


class Run(NamedTuple):
    """Merged batches of a table: the folder, the last batch, and the log it was written from."""

    table: str
    run: str
    up_to: int
    seen: int
    complete: bool


class Snapshot(NamedTuple):
    """What is visible: the committed ``batches``, the runs standing for earlier ones, and what is hidden."""

    version: int
    last_batch: int
    batches: tuple[int, ...]
    runs: dict[str, tuple[list[str], int]]
    deletions: tuple[str, ...]
    cutoff: dt.datetime | None


class Warehouse:
    """Ticks, symbols, calendar and candles below one path."""

    def __init__(self, spark: SparkSession, path: str, max_limit: int = MAX_LIMIT):
        """Open the warehouse at ``path``; ``max_limit`` bounds the rows of a page.

        Days and buckets depend on the session's settings, so they are pinned here.
        """
        self.spark = configure(spark)
        self.path = path.rstrip("/")
        self.max_limit = max_limit
        if not self._exists("settings"):
            raise FileNotFoundError(f"no warehouse at {path}; use Warehouse.create")
        self.buckets = spark.read.schema("buckets int").json(self._at("settings")).first()["buckets"]

    # --- set up -----------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64) -> Warehouse:
        """Create what is missing; an existing warehouse is opened as it is."""
        configure(spark)
        path = path.rstrip("/")
        settings = f"{path}/settings"
        target = spark._jvm.org.apache.hadoop.fs.Path(settings)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            _one_row(spark, [(buckets,)], "buckets int").write.json(settings)
        warehouse = cls(spark, path)
        if not warehouse._versions():
            warehouse.seed_calendar()
        return warehouse

    @classmethod
    def reset(cls, spark: SparkSession, path: str, confirm: bool = False, buckets: int = 64) -> Warehouse:
        """Drop everything below ``path`` and create it anew."""
        if not confirm:
            raise ValueError("reset removes all data; pass confirm=True")
        warehouse = cls(spark, path)
        warehouse._delete("")
        return cls.create(spark, path, buckets)

    def seed_calendar(self) -> None:
        """Check the date dimension and write it beside the one in use, which it then replaces."""
        dim = check_calendar(build_jalali_calendar(self.spark))
        version = max(self._versions(), default=-1) + 1
        dim.coalesce(1).write.mode("overwrite").parquet(self._at("jalali_calendar", f"version={version}"))

    def _versions(self) -> list[int]:
        """Versions of the date dimension that are complete."""
        found = (f.removeprefix("version=") for f in self._children("jalali_calendar"))
        return [int(v) for v in found if v.isdigit() and self._exists("jalali_calendar", f"version={v}", "_SUCCESS")]

    # --- files ------------------------------------------------------------

    def _at(self, *parts: str) -> str:
        return "/".join([self.path, *(p for p in parts if p)])

    def _fs(self, *parts: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(*parts))
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, *parts: str) -> bool:
        fs, target = self._fs(*parts)
        return fs.exists(target)

    def _delete(self, *parts: str) -> None:
        fs, target = self._fs(*parts)
        fs.delete(target, True)

    def _listed(self, *parts: str):
        fs, target = self._fs(*parts)
        return list(fs.listStatus(target)) if fs.exists(target) else []

    def _children(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self._listed(*parts) if s.isDirectory()]

    def _create(self, text: str, *parts: str) -> bool:
        """Write a small file, unless it is there already."""
        fs, target = self._fs(*parts)
        try:
            out = fs.create(target, False)
        except Py4JJavaError:
            if fs.exists(target):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def _text(self, *parts: str) -> str | None:
        fs, target = self._fs(*parts)
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, version: int, name: str, text: str) -> bool:
        """Put an entry at ``version`` of the log, unless another is there; in one step, with its content."""
        aside = f"pending/{uuid.uuid4().hex}"
        self._create(text, aside, name)
        taken = self._rename(aside, f"log/version={version}")
        if not taken:
            self._delete(aside)
        return taken

    def _rename(self, source: str, target: str) -> bool:
        """Rename a folder in one step, unless the target is there."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        (fs, to), (_, origin) = self._fs(target), self._fs(source)
        fs.mkdirs(to.getParent())
        try:
            if fs.getUri().getScheme() == "file":
                # the system refuses to put a folder in the place of one that has files
                how = self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
                how[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
                path = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.move(path(origin), path(to), how)
            else:
                kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
                how = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
                how[0] = kind.getEnumConstants()[0]
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(origin, to, how)
        except Py4JJavaError:
            if fs.exists(to):
                return False
            raise
        return True

    def _read(self, schema, *parts: str, form: str = "parquet") -> DataFrame:
        if not self._exists(*parts):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(form).load(self._at(*parts))

    def _append(self, rows: list[tuple], schema: str, *parts: str) -> None:
        _one_row(self.spark, rows, schema).write.mode("append").json(self._at(*parts))

    # --- what is visible --------------------------------------------------

    def _log(self) -> list[Entry]:
        """The entries in order, by listing alone."""
        fs, target = self._fs("log", "version=*", "*.json")
        found = fs.globStatus(target) or []
        paths = [f.getPath() for f in found]
        return sorted(Entry(int(p.getParent().getName().removeprefix("version=")), p.getName()) for p in paths)

    @staticmethod
    def _runs(log: list[Entry]) -> dict[str, list[Run]]:
        """The runs of each table that count: the last complete one and those after it."""
        runs: dict[str, list[Run]] = {}
        for entry in log:
            if entry.kind == "run":
                table, run, up_to, seen, complete = entry.parts
                earlier = [] if complete == "1" else runs.get(table, [])
                runs[table] = [*earlier, Run(table, run, int(up_to), int(seen), complete == "1")]
        return runs

    def snapshot(self) -> Snapshot:
        log, cutoff = self._log(), None
        runs = {table: ([r.run for r in found], found[-1].up_to) for table, found in self._runs(log).items()}
        batches = sorted(int(e.parts[0]) for e in log if e.kind == "batch")
        if self._exists("retention"):
            cutoff = self._read(_RETENTION, "retention", form="json").agg(F.max("cutoff")).first()[0]
        last = max([*batches[-1:], *(up_to for _, up_to in runs.values())], default=-1)
        deletions = tuple(e.place for e in log if e.kind == "deletion")
        return Snapshot(log[-1].version if log else -1, last, tuple(batches), runs, deletions, cutoff)

    def _load(self, schema: T.StructType, root: str, folders: Sequence[str]) -> DataFrame:
        """Rows below those ``folders`` of ``root``; predicates on their columns prune them further."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [self._at(root, folder) for folder in folders]
        return self.spark.read.schema(schema).option("basePath", self._at(root)).parquet(*paths)

    def _delta(self, table: str, schema: T.StructType, seen: Snapshot) -> DataFrame:
        """Rows of the committed batches that no run holds: of these folders and no others."""
        merged = seen.runs.get(table, ([], -1))[1]
        return self._load(schema, f"{table}/delta", [f"batch_id={n}" for n in seen.batches if n > merged])

    def _base(self, table: str, schema: T.StructType, seen: Snapshot) -> DataFrame | None:
        runs = seen.runs.get(table, ([], -1))[0]
        return self._load(schema, f"{table}/base", [f"run={r}" for r in runs]) if runs else None

    def _deletions(self, places: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(_DELETIONS).json([self._at(p) for p in places])

    def _undeleted(self, rows: DataFrame, seen: Snapshot) -> DataFrame:
        return undeleted(rows, self._deletions(seen.deletions)) if seen.deletions else rows

    def ticks(
        self,
        symbols: Sequence[str] | None = None,
        days: DayRange | None = None,
        seen: Snapshot | None = None,
        more: Sequence[str] = (),
    ) -> DataFrame:
        """Visible ticks; ``symbols`` and ``days`` prune files, they do not refine rows."""
        seen = seen or self.snapshot()
        delta = self._delta("ticks", _TICKS_DELTA, seen)
        base = self._base("ticks", _TICKS_BASE, seen)
        if symbols is not None:
            wanted = symbols_predicate(symbols, self.buckets)
            delta = delta.filter(wanted)
            base = base if base is None else base.filter(wanted)
        if days is not None:
            # a day wider on both sides, whatever zone the days are meant in
            wide = DayRange(days.first - dt.timedelta(days=1), days.last + dt.timedelta(days=1))
            span = utc_day_range(F.col("ts"), *wide)
            delta = delta.filter(span)
            if base is not None:
                months = F.col("ts_month").between(f"{wide.first:%Y-%m}", f"{wide.last:%Y-%m}")
                base = base.filter(span & months)
        columns = [*TICKS.fieldNames(), "batch_id", *more]
        rows = delta.select(*columns)
        if base is not None:
            rows = rows.unionByName(base.select(*columns))
        if seen.cutoff is not None:
            rows = kept_since(rows, F.lit(seen.cutoff))
        return self._undeleted(rows, seen)

    def _state_rows(self, timeframes: Sequence[str], symbols: Sequence[str] | None, seen: Snapshot, more: Sequence[str]):
        """Visible states: of merged batches in all ``timeframes``, of later ones by day."""
        delta = self._delta("states", _STATES_DELTA, seen)
        base = self._base("states", _STATES_BASE, seen)
        base = base if base is None else base.filter(F.col("timeframe").isin(list(timeframes)))
        if symbols is not None:
            wanted = symbols_predicate(symbols, self.buckets)
            delta = delta.filter(wanted)
            base = base if base is None else base.filter(wanted)
        columns = [*CANDLE_STATE.fieldNames(), "batch_id", *more]
        delta = self._undeleted(delta.select(*columns), seen)
        if base is not None:
            base = self._undeleted(base.select(*columns), seen)
        return delta, base

    def states(
        self,
        timeframes: Sequence[str] = TIMEFRAMES,
        symbols: Sequence[str] | None = None,
        seen: Snapshot | None = None,
        days: DayRange | None = None,
        more: Sequence[str] = (),
    ) -> DataFrame:
        """Visible states of ``timeframes``, left to the reader to merge.

        ``symbols`` and ``days`` prune files, they do not refine rows.
        """
        delta, base = self._state_rows(timeframes, symbols, seen or self.snapshot(), more)
        if days is not None:
            # a bucket that starts in the range ends within a year of it
            last = days.last + dt.timedelta(days=366)
            delta = delta.filter(F.col("bucket_start").between(F.lit(days.first), F.lit(last)))
        columns = [*CANDLE_STATE.fieldNames(), *more]
        if list(timeframes) != ["1d"]:
            delta = rebucket(delta, self.calendar(), timeframes, more)
        delta = delta.select(*columns)
        return delta if base is None else delta.unionByName(base.select(*columns))

    def _registrations(self, seen: Snapshot) -> DataFrame:
        columns = [*REGISTRY.fieldNames(), "batch_id"]
        rows = self._delta("symbols", _REGISTRY_DELTA, seen).select(*columns)
        base = self._base("symbols", _REGISTRY_BASE, seen)
        return self._undeleted(rows if base is None else rows.unionByName(base.select(*columns)), seen)

    def registry(self, seen: Snapshot | None = None) -> DataFrame:
        return registry_resolve(self._registrations(seen or self.snapshot()))

    def calendar(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], JALALI_CALENDAR)
        return self._read(JALALI_CALENDAR, "jalali_calendar", f"version={max(versions)}")

    def responses(self, batch_id: int | None = None) -> DataFrame:
        """What the requests of committed batches were told; ``vacuum`` removes old ones with the batches it merges."""
        batches = self.snapshot().batches
        wanted = batches if batch_id is None else [n for n in batches if n == batch_id]
        return self._load(_RESPONSES_DELTA, "responses/delta", [f"batch_id={n}" for n in wanted])

    # --- batches ----------------------------------------------------------

    def write_batch(self, table: str, batch_id: int, rows: DataFrame, *partition_by: str, **observed: Column) -> dict:
        """Store rows of a batch; what ``observed`` counts on the way."""
        seen = Observation()
        if observed:
            rows = rows.observe(seen, *(column.alias(name) for name, column in observed.items()))
        rows = rows.select(*_BATCH_SCHEMAS[table].fieldNames())
        target = self._at(table, "delta", f"batch_id={batch_id}")
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
        return seen.get if observed else {}

    def read_batch(self, table: str, batch_id: int) -> DataFrame:
        """A batch as just written, committed or not."""
        folder = self._at(table, "delta", f"batch_id={batch_id}")
        return self.spark.read.schema(_BATCH_SCHEMAS[table]).parquet(folder)

    def write_ticks(self, ticks: DataFrame, batch_id: int) -> None:
        """Store typed ticks of one batch, clustered by (symbol, ts) in each bucket."""
        self.write_batch("ticks", batch_id, self._clustered(ticks, "ts"), "symbol_bucket")

    def write_day_states(self, ticks: DataFrame, batch_id: int) -> int:
        """Store the day states of a batch's ticks; how many Jalali ticks lie outside the date dimension."""
        outside = (F.col("calendar") == JALALI) & ~F.col("bucket_start").between(F.lit(FIRST_DAY), F.lit(LAST_DAY))
        uncovered = F.sum(F.when(outside, F.col("ticks")))
        states = self._clustered(day_states(ticks), "bucket_start")
        return self.write_batch("states", batch_id, states, "symbol_bucket", uncovered=uncovered)["uncovered"] or 0

    def _clustered(self, rows: DataFrame, time: str) -> DataFrame:
        """Lay rows out by bucket and month, so that a busy symbol spreads over
        tasks; the runtime splits what is still too large and joins what is small."""
        placed = rows.withColumn("symbol_bucket", symbol_bucket(F.col("symbol"), self.buckets))
        month = F.trunc(F.col(time), "month")
        return (
            placed.withColumn("_month", month)
            .hint("rebalance", "symbol_bucket", "_month")
            .drop("_month")
            .sortWithinPartitions("symbol_bucket", "symbol", time)
        )

    def begin(self, source: str, number: str) -> tuple[int, Snapshot | None]:
        """A new attempt at a source's batch, and what it is to be checked against; or the batch taken in, and None."""
        seen, log = self.snapshot(), self._log()
        done = self._standing(log, _key(source, number))
        if done is not None:
            return done, None
        given = [int(f.getPath().getName()) for f in self._listed("attempts")]
        hidden = [int(e.parts[0]) for e in log if e.kind == "deletion"]
        batch_id = max([*given, *hidden, seen.last_batch], default=-1) + 1
        while not self._create("", "attempts", str(batch_id)):
            batch_id += 1
        return batch_id, seen

    def _standing(self, log: list[Entry], key: str) -> int | None:
        """The batch that stands for a source's batch, if one does."""
        for entry in log:
            if entry.kind == "batch" and entry.parts[1] == key:
                return int(entry.parts[0])
        text = self._text("sources", key)
        return int(text) if text else None

    def commit(
        self,
        batch_id: int,
        source: str,
        number: str,
        ticks: int,
        rejected: int,
        uncovered: int,
        seen: Snapshot,
        claimed: DataFrame,
    ) -> int:
        """Make a written attempt stand for its source's batch, and visible; the batch that stands.

        ``seen`` is what the attempt was checked against and ``claimed`` has the symbols its requests named.
        If another writer has changed one of these since, :class:`RegistryMovedError` is raised.
        ``uncovered``: Jalali ticks outside the date dimension, which are in no month or year.
        """
        key = _key(source, number)
        entry = {
            "batch_id": batch_id, "source": source, "number": number, "ticks": ticks, "rejected": rejected,
            "uncovered": uncovered, "committed_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        }
        checked = seen.version
        while True:
            log = self._log()
            done = self._standing(log, key)
            if done is not None:
                return done
            self._check_unmoved(batch_id, [e for e in log if e.version > checked], claimed)
            checked = log[-1].version if log else -1
            if self._publish(checked + 1, f"batch-{batch_id}-{key}.json", json.dumps(entry) + "\n"):
                return batch_id

    def _check_unmoved(self, batch_id: int, later: list[Entry], claimed: DataFrame) -> None:
        if any(e.kind == "run" and int(e.parts[2]) >= batch_id for e in later):
            raise RegistryMovedError(f"later batches than {batch_id} were merged meanwhile")
        touched = []
        batches = [f"batch_id={e.parts[0]}" for e in later if e.kind == "batch"]
        if batches:
            touched.append(self._load(_REGISTRY_DELTA, "symbols/delta", batches).select("symbol"))
        deletions = [e.place for e in later if e.kind == "deletion"]
        if deletions:
            touched.append(self._deletions(deletions).select("symbol"))
        for symbols in touched:
            if not symbols.join(claimed.select("symbol").distinct(), "symbol", "left_semi").isEmpty():
                raise RegistryMovedError(f"symbols of batch {batch_id} were registered or deleted meanwhile")

    def commits(self) -> DataFrame:
        """What each visible batch took in, as far as the log goes back."""
        places = [self._at(e.place) for e in self._log() if e.kind == "batch"]
        if not places:
            return self.spark.createDataFrame([], _COMMITS)
        return self.spark.read.schema(_COMMITS).json(places)

    # --- reads ------------------------------------------------------------

    def lookup(self, symbols: Sequence[str] | DataFrame, seen: Snapshot | None = None) -> DataFrame:
        """Calendar of each symbol asked for, and whether it is known at all."""
        registry = self.registry(seen)
        if isinstance(symbols, DataFrame):
            return symbol_lookup(symbols.select("symbol").distinct(), registry)
        wanted = symbols_predicate(symbols)
        requested = self.spark.createDataFrame([(s,) for s in sorted(set(symbols))], "symbol string")
        return symbol_lookup(requested, registry.filter(wanted))

    def _routes(self, symbols: Sequence[str] | DataFrame, seen: Snapshot) -> tuple[DataFrame | dict[str, str], tuple[str, ...]]:
        """Calendars of the symbols asked for; and the unknown symbols.

        A list becomes literals that scans skip files by. A DataFrame, however
        many symbols it has, is joined; its unknown symbols have no rows.
        """
        found = self.lookup(symbols, seen)
        if isinstance(symbols, DataFrame):
            # stored, so that its size is known: if small it is broadcast, and buckets it does not lead to are not read
            path = scratch_path(self.spark, "routes")
            found.filter("found").withColumn("symbol_bucket", symbol_bucket(F.col("symbol"), self.buckets)).write.parquet(path)
            schema = "symbol string, calendar string, symbol_bucket int"
            return self.spark.read.schema(schema).parquet(path).filter(F.col("calendar").isin(GREGORIAN, JALALI)), ()
        # no more rows than the caller asked for
        routes = {r["symbol"]: r["calendar"] for r in found.collect()}
        unknown = tuple(sorted(s for s, c in routes.items() if c is None))
        if len(unknown) == len(routes):
            raise UnknownSymbolError("symbol not found: " + ", ".join(unknown))
        return {s: c for s, c in routes.items() if c}, unknown

    def _on(self, routes: DataFrame | dict[str, str], rows_of: Callable[..., DataFrame]) -> DataFrame:
        """Rows of the symbols in ``routes``, each in its registered calendar."""
        if isinstance(routes, DataFrame):
            return routed(rows_of(None, more=("symbol_bucket",)), routes).drop("symbol_bucket")
        return rows_of(list(routes)).filter(route_predicate(routes))

    def read_candles(
        self,
        symbols: Sequence[str] | DataFrame,
        from_: str,
        to: str,
        timeframe: str,
        page: int | None = None,
        limit: int | None = None,
        after: Sequence[object] | None = None,
    ) -> Page:
        """Candles of ``symbols`` in (symbol, bucket_start) order, as result strings.

        ``after`` continues behind a known (symbol, bucket_start) instead of
        counting pages. Symbols that are not registered are named in the page's
        ``unknown``; if none is, the read fails.
        """
        check_timeframe(timeframe)
        days = parse_range(from_, to)
        seen = self.snapshot()
        routes, unknown = self._routes(symbols, seen)
        states = self._on(routes, lambda names, **more: self.states([timeframe], names, seen, days, **more))
        candles = read_candles(states, days, timeframe)
        order = ["symbol", "bucket_start"]
        if after is not None:
            found = page_after(candles, order, after, limit, self.max_limit, hold=True)
        elif isinstance(symbols, DataFrame):
            found = page_of(candles, order, page, limit, self.max_limit, hold=True)
        else:
            keys = candles_in_range(states.filter(F.col("timeframe") == timeframe), days).select("symbol", F.col("bucket_start").alias("day"))
            counts = keys.distinct().withColumn("n", F.lit(1))
            found, _ = page_in(candles, order, counts, F.col("bucket_start"), page, limit, self.max_limit)
        rows = with_jalali_labels(found.rows, label_calendar(self.spark)).orderBy(*order)
        return Page(format_candles(rows).drop("timeframe"), found.metadata, unknown)

    def candles(self, symbols: Sequence[str] | DataFrame, from_: str, to: str, timeframe: str) -> tuple[DataFrame, tuple[str, ...]]:
        """All candles of a range, typed; and the symbols that are not registered."""
        check_timeframe(timeframe)
        days = parse_range(from_, to)
        seen = self.snapshot()
        routes, unknown = self._routes(symbols, seen)
        states = self._on(routes, lambda names, **more: self.states([timeframe], names, seen, days, **more))
        return read_candles(states, days, timeframe), unknown

    def read_ticks(
        self,
        symbols: Sequence[str] | DataFrame,
        from_: str,
        to: str,
        page: int | None = None,
        limit: int | None = None,
        after: Sequence[object] | None = None,
    ) -> Page:
        """Ticks of ``symbols`` in (symbol, ts) order; days follow each symbol's calendar.

        ``after`` continues behind a known (symbol, ts, value, volume, copies):
        ``copies`` of that very tick have been read. A tick sent again is a row of
        its own, but equal rows cannot be told apart, so counting them is enough.
        """
        days = parse_range(from_, to)
        seen = self.snapshot()
        routes, unknown = self._routes(symbols, seen)
        rows = self._on(routes, lambda names, **more: self.ticks(names, days, seen, **more))
        rows = ticks_in_range(rows, days).drop("batch_id")
        order = ["symbol", "ts", "value", "volume"]
        if after is not None:
            found = page_after(rows, order, after[:-1], limit, self.max_limit, copies=int(after[-1]), hold=True)
        elif isinstance(symbols, DataFrame):
            found = page_of(rows, order, page, limit, self.max_limit, hold=True)
        else:
            counts = self._day_counts(list(routes), seen, days).filter(route_predicate(routes))
            day = local_date(F.col("ts"), F.col("calendar"))
            found, _ = page_in(rows, order, counts, day, page, limit, self.max_limit)
        return Page(format_ticks(found.rows.orderBy(*order)), found.metadata, unknown)

    def _day_counts(self, symbols: Sequence[str] | None, seen: Snapshot, days: DayRange | None = None) -> DataFrame:
        """symbol, calendar, day, n: visible ticks of each day; from the day states, and where ticks expired from these."""
        states = self.states(["1d"], symbols, seen, days)
        if days is not None:
            states = candles_in_range(states, days)
        counts = states.select("symbol", "calendar", F.col("bucket_start").alias("day"), F.col("ticks").alias("n"))
        if seen.cutoff is None:
            return counts
        # days of either calendar that begin after the cutoff are whole
        whole = seen.cutoff.date() + dt.timedelta(days=2)
        about = DayRange(whole - dt.timedelta(days=4), whole - dt.timedelta(days=1))
        rest = self.ticks(symbols, about, seen).withColumn("day", local_date(F.col("ts"), F.col("calendar")))
        if days is not None:
            rest = rest.filter(F.col("day").between(F.lit(days.first), F.lit(days.last)))
        rest = rest.filter(F.col("day") < F.lit(whole)).groupBy("symbol", "calendar", "day").agg(F.count(F.lit(1)).alias("n"))
        return counts.filter(F.col("day") >= F.lit(whole)).unionByName(rest)

    def latest_ticks(self, n: int, symbols: Sequence[str] | None = None) -> DataFrame:
        """The ``n`` most recent ticks, newest first; ties by symbol, value and volume.

        The day states tell from which day on there are enough, so older months are not read.
        """
        _, n = check_page(1, n, self.max_limit)
        seen = self.snapshot()
        counts = self._day_counts(symbols, seen)
        day = newest_days(counts if symbols is None else counts.filter(symbols_predicate(symbols)), n)
        if day is None:
            return format_ticks(self.spark.createDataFrame([], TICKS))
        # a day of one calendar begins hours before that of the other
        rows = self.ticks(symbols, DayRange(day, dt.date(9000, 1, 1)), seen)
        if symbols is not None:
            rows = rows.filter(symbols_predicate(symbols))
        return format_ticks(latest(rows, "ts", n, "symbol", "value", "volume"))

    def latest_candles(self, n: int, timeframe: str, symbols: Sequence[str] | None = None, calendar: str | None = None) -> DataFrame:
        """The ``n`` most recent candles of a timeframe, newest first, then by symbol; others are not merged."""
        check_timeframe(timeframe)
        _, n = check_page(1, n, self.max_limit)
        seen = self.snapshot()
        wanted = F.col("timeframe") == timeframe
        if calendar is not None:
            wanted = wanted & (F.col("calendar") == calendar)
        if symbols is not None:
            wanted = wanted & symbols_predicate(symbols)
        keys = self.states([timeframe], symbols, seen).filter(wanted).select("symbol", "calendar", F.col("bucket_start").alias("day"))
        day = newest_days(keys.distinct().withColumn("n", F.lit(1)), n)
        if day is None:
            states = self.spark.createDataFrame([], CANDLE_STATE)
        else:
            states = self.states([timeframe], symbols, seen, DayRange(day, dt.date(9000, 1, 1)))
            states = states.filter(wanted & (F.col("bucket_start") >= F.lit(day)))
        rows = latest(finish(merge_states(states)), "bucket_start", n, "symbol")
        rows = with_jalali_labels(rows, label_calendar(self.spark)).orderBy(F.desc("bucket_start"), "symbol")
        return format_candles(rows).drop("timeframe")

    def old_tick_count(self, as_of: dt.datetime, days: int = 6) -> int:
        """Early warning: how many stored ticks are older than ``days`` before ``as_of``."""
        return old_tick_count(self.ticks(), F.lit(_utc(as_of)), days).first()[0]

    def create_views(self) -> None:
        """Temporary views under the table names users query, candles merged."""
        seen = self.snapshot()
        self.ticks(seen=seen).drop("batch_id").createOrReplaceTempView("ticks")
        self.registry(seen).createOrReplaceTempView("symbols")
        self.calendar().createOrReplaceTempView("jalali_calendar")
        for name, (calendar, timeframe) in CANDLE_TABLES.items():
            merged = merge_states(
                self.states([timeframe], seen=seen).filter(
                    (F.col("calendar") == calendar) & (F.col("timeframe") == timeframe)
                )
            )
            merged.drop("calendar", "timeframe").createOrReplaceTempView(name)

    # --- upkeep -----------------------------------------------------------

    def check(self, counts: bool = True) -> DataFrame:
        """One row per table, with its rows if ``counts``; raises where a table is missing.

        Raw ticks, states and symbols are there once a batch is committed. Without
        counts nothing but the calendar's first row is read.
        """
        seen = self.snapshot()
        calendar = self.calendar()
        if calendar.isEmpty():
            raise RuntimeError("jalali_calendar is empty; call seed_calendar")
        missing = [t for t in ("ticks", "states", "symbols") if seen.last_batch >= 0 and not self._exists(t)]
        if missing:
            raise RuntimeError("missing: " + ", ".join(missing))
        stored = ["jalali_calendar"]
        if seen.last_batch >= 0:
            stored += ["ticks", "symbols", *CANDLE_TABLES]
        if not counts:
            names = [*CANDLE_TABLES, "ticks", "symbols", "jalali_calendar"]
            return self.spark.createDataFrame([(n, n in stored, None) for n in names], "name string, exists boolean, rows long")
        # of states the keys and the number of ticks are read, of ticks nothing unless some have expired
        found = table_counts(self.states(seen=seen), None if seen.cutoff is None else self.ticks(seen=seen))
        days = calendar.agg(F.count(F.lit(1)).alias("rows"))
        found = found.unionByName(days.select(F.lit("jalali_calendar").alias("name"), "rows"))
        return found.select("name", F.col("name").isin(stored).alias("exists"), "rows")

    def uncovered_days(self) -> DataFrame:
        """Jalali days outside the calendar: served by day and week, in no month or year."""
        days = merge_states(self.states(["1d"])).filter(F.col("calendar") == JALALI)
        covered = F.col("bucket_start").between(F.lit(FIRST_DAY), F.lit(LAST_DAY))
        return days.filter(~covered).select("symbol", "bucket_start", "ticks")

    def delete_symbols(self, symbols: Sequence[str]) -> DataFrame:
        """Delete symbols everywhere but the calendar; one summary row per table.

        One small write hides all rows up to the last batch at once. The rows
        themselves leave the disk with the next complete compaction. A deleted
        symbol may register again with either calendar.
        """
        wanted = symbols_predicate(symbols)
        gone = sorted(set(symbols))
        while True:
            seen = self.snapshot()
            ticks = None if seen.cutoff is None else self.ticks(symbols, seen=seen).filter(wanted)
            summary = delete_summary(self.states(symbols=symbols, seen=seen).filter(wanted), ticks)
            # ten rows, counted before the deletion takes effect
            counted = [tuple(row) for row in summary.collect()]
            now = dt.datetime.now(dt.timezone.utc).isoformat()
            marks = [json.dumps({"symbol": s, "since": seen.last_batch, "deleted_at": now}) for s in gone]
            # a batch that came in between is counted too
            if self._publish(seen.version + 1, f"deletion-{seen.last_batch}.json", "\n".join(marks) + "\n"):
                return self.spark.createDataFrame(counted, summary.schema)

    def expire_ticks(self, days: int, as_of: dt.datetime) -> dt.datetime:
        """Hide ticks older than ``days`` before ``as_of``; candles and symbols stay.

        They leave the disk with the next complete compaction and vacuum.
        """
        cutoff = _utc(as_of) - dt.timedelta(days=days)
        self._append([(cutoff,)], _RETENTION, "retention")
        return cutoff

    def compact(self, complete: bool = False) -> None:
        """Merge what arrived since the last run into a new one.

        The usual run costs in proportion to the new batches; a ``complete`` one
        rewrites all visible rows and so drops deleted and expired ones.
        """
        jobs = {"ticks": self._tick_run, "states": self._state_run, "symbols": self._symbol_run}
        for table, rows_of in jobs.items():
            while not self._merged(table, rows_of, complete):
                pass

    def _merged(self, table: str, rows_of: Callable, complete: bool) -> bool:
        """Write and show one run; false if batches it should hold, or another run, came in between."""
        seen = self.snapshot()
        if not complete:
            if seen.runs.get(table, ([], -1))[1] >= seen.last_batch:
                return True
            # look at what no run holds yet
            seen = seen._replace(runs={t: ([], up_to) for t, (_, up_to) in seen.runs.items()})
        run = uuid.uuid4().hex
        rows, partition_by = rows_of(seen)
        rows.write.partitionBy(*partition_by).parquet(self._at(table, "base", f"run={run}"))
        checked = seen.version
        while True:
            log = self._log()
            later = [e for e in log if e.version > checked]
            if any(e.kind == "batch" and int(e.parts[0]) <= seen.last_batch for e in later):
                return False
            if any(e.kind == "run" and e.parts[0] == table for e in later):
                return False
            checked = log[-1].version if log else -1
            name = f"run-{table}-{run}-{seen.last_batch}-{seen.version}-{int(complete)}.json"
            if self._publish(checked + 1, name, ""):
                return True

    def _tick_run(self, seen: Snapshot) -> tuple[DataFrame, list[str]]:
        rows = (
            self.ticks(seen=seen)
            .withColumn("batch_id", F.lit(seen.last_batch))
            .withColumn("symbol_bucket", symbol_bucket(F.col("symbol"), self.buckets))
            .withColumn("ts_month", F.date_format("ts", "yyyy-MM"))
            .hint("rebalance", "symbol_bucket", "ts_month")
            .sortWithinPartitions("symbol_bucket", "ts_month", "symbol", "ts")
        )
        return rows, ["symbol_bucket", "ts_month"]

    def _state_run(self, seen: Snapshot) -> tuple[DataFrame, list[str]]:
        merged = merge_states(self.states(seen=seen))
        rows = (
            merged.withColumn("batch_id", F.lit(seen.last_batch))
            .withColumn("symbol_bucket", symbol_bucket(F.col("symbol"), self.buckets))
            .hint("rebalance", "timeframe", "symbol_bucket", "calendar")
            .sortWithinPartitions("timeframe", "symbol_bucket", "calendar", "symbol", "bucket_start")
        )
        return rows, ["timeframe", "symbol_bucket", "calendar"]

    def _symbol_run(self, seen: Snapshot) -> tuple[DataFrame, list[str]]:
        return self._registrations(seen).hint("rebalance"), []

    def vacuum(self, min_age: dt.timedelta = MIN_AGE) -> None:
        """Remove folders no new reader needs: merged batches, replaced runs, old calendars.

        Only what was written more than ``min_age`` ago goes, so that readers that
        planned before can finish; name an age that is longer than any read.
        """
        log = self._log()
        runs = self._runs(log)
        before = (dt.datetime.now(dt.timezone.utc) - min_age).timestamp() * 1000
        for table, found in runs.items():
            self._drop_batches(found[-1].up_to, before, table, "delta")
            self._drop(before, table, "base", keep={f"run={r.run}" for r in found})
        self._drop(before, "jalali_calendar", keep={f"version={max(self._versions(), default=0)}"})
        self._drop(before, "pending", keep=set())
        if {"ticks", "states", "symbols"} <= runs.keys():
            # a run stands for the batches it holds, their entries are not needed
            merged = min(found[-1].up_to for found in runs.values())
            self._drop_entries(log, runs, merged, before)
            self._drop_batches(merged, before, "responses", "delta")
            for entry in self._listed("attempts"):
                name = entry.getPath().getName()
                if int(name) < merged and entry.getModificationTime() <= before:
                    self._delete("attempts", name)

    def _drop_entries(self, log: list[Entry], runs: dict[str, list[Run]], merged: int, before: float) -> None:
        """Remove entries that no reader needs; the last stays, so that versions go on from it."""
        names = {r.run for found in runs.values() for r in found}
        # what was written from a log with the deletion in it holds no row under its marks
        clean = min(found[0].seen for found in runs.values())
        for entry in log[:-1]:
            folder = f"log/version={entry.version}"
            fs, target = self._fs(folder)
            if fs.getFileStatus(target).getModificationTime() > before:
                continue
            if entry.kind == "batch" and int(entry.parts[0]) <= merged:
                self._create(entry.parts[0], "sources", entry.parts[1])
                self._delete(folder)
            elif entry.kind == "deletion" and entry.version <= clean:
                self._delete(folder)
            elif entry.kind == "run" and entry.parts[1] not in names:
                self._delete(folder)

    def _drop(self, before: float, *parts: str, keep: set[str]) -> None:
        for entry in self._listed(*parts):
            name = entry.getPath().getName()
            if name not in keep and entry.getModificationTime() <= before:
                self._delete(*parts, name)

    def _drop_batches(self, up_to: int, before: float, *parts: str) -> None:
        batches = [f.removeprefix("batch_id=") for f in self._children(*parts) if f.startswith("batch_id=")]
        later = {f"batch_id={n}" for n in batches if int(n) > up_to}
        self._drop(before, *parts, keep=later)


def _key(source: str, number: str) -> str:
    return hashlib.sha256(f"{source}\0{number}".encode()).hexdigest()


def _utc(at: dt.datetime) -> dt.datetime:
    return at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at.astimezone(dt.timezone.utc)


def _one_row(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).coalesce(1)

