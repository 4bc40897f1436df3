"""Exact dedup of a table of files: a stream that remembers the digest of every text it has met.

The stream's keyed state lies on disk (RocksDB) and never expires. Of each digest it holds how
many rows had it, and of the row with the largest identifier the identifier and where its content
lies (file and row), never a text. What the state says of a digest that was met more than once is
checked on full bytes: its rows are grouped by digest and text, and a text that is not that at
the place the state names is a class of its own. Everything is DataFrame work.

A digest that a third of all rows share is spread over ``SALTS`` keys wherever texts or
rows meet the state, and its rows collapse in each task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stored
from tickloom.session import scratch_path

#: Keys that the rows of one digest are dealt to.
SALTS = 8

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # all partitions of an executor share one budget
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # each partition would set aside megabytes of disk for its logs, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, at (doc_id, file, row) and text, empty for null, of each row of a table of Parquet files."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # batch and stream write one path with different numbers of slashes
    file = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):/+", "$1:/")
    at = F.struct(F.col("doc_id").cast("long").alias("doc_id"), file.alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(digest(text.cast("binary")).alias("digest"), at.alias("at"), text.alias("text"))


def _pattern(path: str) -> str:
    """A pattern that only ``path`` matches: as such a file may be streamed as well as a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def remember(
    spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, files: int | None = None
) -> DataFrame:
    """Stream what is new below ``path`` into the state at ``state``; digest, keep (doc_id, file, row) and n of all met so far.

    ``state`` is a folder all executors share. A run that stopped goes on where it was when called again,
    and so does a later one with new files. ``files`` bounds the files of a micro-batch; without, all new ones are one.
    """
    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFileAge", "36500d")
        if files is not None:
            source = source.option("maxFilesPerTrigger", files)
        rows = _located(source.parquet(_pattern(path)), digest)
        met = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
        # the state itself is the result, so updates need no sink
        sink = met.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
        sink.trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").load(state)
        return stored(held.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n")), "digests")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))


def _on_all_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _place(at: str) -> Column:
    return F.struct(F.xxhash64(f"{at}.file").alias("file"), F.col(f"{at}.row").alias("row"))


def exact_duplicates(
    spark: SparkSession, path: str, state: str | None = None, digest: Callable[[Column], Column] = sha256, files: int | None = None
) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of every row of the Parquet table at ``path`` (doc_id, text).

    Rows with one text, null counting as empty, are a group; that with the largest doc_id stays. Rows
    without a doc_id stay behind all others; of rows that share doc_id and text just one stays, the last by place.
    ``digest`` may be any function of the bytes: texts are equal only if all their bytes are. Other columns are not read.
    """
    held = remember(spark, path, state or scratch_path(spark, "digest-state"), digest, files)
    rows = _located(spark.read.parquet(path), digest)

    met = held.filter("n > 1").select("digest", _place("keep").alias("place"))
    texts = _salted(rows).join(_on_all_salts(met), ["digest", "salt"])
    same = texts.groupBy("digest", "text").agg(F.max(_place("at") == F.col("place")).alias("holds"))
    # a digest with a text beside that at the place the state names
    split = stored(same.filter("NOT holds").select("digest").distinct(), "split-digests")

    groups = held.filter("n > 1").select("digest", _place("keep").alias("place"), F.col("keep.doc_id").alias("keep_id"), "n")
    rows_of = lambda df: _salted(df.drop("text"))
    if split.isEmpty():
        return _classed(rows_of(rows).join(_on_all_salts(groups), ["digest", "salt"], "left"))
    groups = groups.join(split, "digest", "left_anti")
    whole = rows_of(rows.join(split, "digest", "left_anti")).join(_on_all_salts(groups), ["digest", "salt"], "left")
    apart = rows.join(split, "digest", "left_semi")
    own = apart.groupBy("digest", "text").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    own = own.select("digest", "text", _place("keep").alias("place"), F.col("keep.doc_id").alias("keep_id"), "n")
    apart = _salted(apart).join(_on_all_salts(own), ["digest", "text", "salt"])
    return _classed(whole).unionByName(_classed(apart))


def _classed(rows: DataFrame) -> DataFrame:
    alone = F.col("n").isNull()
    return rows.select(
        F.col("at.doc_id").alias("doc_id"),
        "digest",
        F.when(alone, F.col("at.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("place") == _place("at"), F.lit(True)).alias("kept"),
    )
