"""What the operators share: written tables, slabs of text bytes, linked components."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path

#: Odd 64-bit constants of the mixing steps.
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
#: Bytes of text worked on at once; a longer text is a slab of its own.
SLAB = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """The rows, written to the shared folder and read again: survives lost executors. ``folders`` are columns to part them by."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _K1
    x = (x ^ (x >> np.uint64(29))) * _K3
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each ordered pair of names."""
    x = a * _K1 + b * _K2
    x = (x ^ (x >> np.uint64(31))) * _K3
    return x ^ (x >> np.uint64(29))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def slabs(column: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes: first row, end row, their bytes, offsets from 0."""
    if not len(column):
        return
    offsets, data = buffers(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[i]:bounds[i + 1]] as the bytes of row i."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    )


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values[bounds[i]:bounds[i + 1]] as the list of row i."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), pa.array(values, kind))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... of each length, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


def whole_keys(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables of a partition sorted by its keys, cut only where the key changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = [held[-1].column(k)[-1] for k in keys]
            if any(batch.column(k)[0] != v for k, v in zip(keys, last, strict=True)) and sum(
                b.num_rows for b in held
            ) >= rows:
                yield pa.Table.from_batches(held)
                held = []
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts) and sum(b.num_rows for b in held) + int(cuts[-1]) >= rows:
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (id, component), the smallest id reachable.

    In each round every id hooks on to its smallest neighbour, chains of hooks
    are shortened, and the links are drawn anew between what has been merged.
    Only ids with links come back. Every round is a written table.
    """
    links = stored(edges.filter("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        for _ in range(2):
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            hooks = stored(hooks.join(up, "p").select("a", F.col("pp").alias("p")), "hooks")
        to = lambda df, c: df.join(hooks.select(F.col("a").alias(c), F.col("p").alias("_p")), c, "left").withColumn(
            c, F.coalesce("_p", c)
        ).drop("_p")
        if labels is None:
            labels = hooks.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            labels = stored(to(labels, "component"), "labels")
        links = stored(to(to(links, "a"), "b").filter("a <> b").distinct(), "links")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    return labels.select("id", "component")


def once_per_worker(key: str, make):
    """make(), kept for the life of the Python worker: the functions here arrive anew with every task."""
    kept = sys.modules.setdefault("_tickloom_worker", types.ModuleType("_tickloom_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def carried(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``docs`` but its text as a struct ``row``, and ``text``, empty for null."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("string").alias("_")]
    return docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
