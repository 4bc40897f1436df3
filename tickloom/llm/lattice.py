"""Embedding near-dedup by E8 lattice hashing.

Each table projects unit vectors to eight dimensions by Gaussian directions and
takes the nearest point of the E8 lattice as a vector's cell. A vector also probes
the neighbouring cells it lies closest to. Two vectors meet in a table if one's
own cell is the other's own or probed one; pairs that meet are confirmed by cosine.

Equal vectors are one node with a weight. Cells in which nobody meets drop out. The
vectors of the other cells come together in blocks of bounded size, a crowded cell
in several, and a block compares its vectors at once. A pair that meets in
several tables counts in the first only. A block hands on link counts and the
links that hold its vectors together, not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import components, mix, stored, whole_keys

#: Tables, cells probed besides a vector's own in each, and cells to a unit of projected length.
TABLES, PROBES, SCALE = 6, 16, 1.6
#: Vectors of a cell that are compared in one block.
BLOCK = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of the lattice, times two."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((-1, 1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out, np.int64)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sums."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest lattice points to the rows of ``x``, times two, as integers."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    better = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.rint(2 * np.where(better[:, None], whole, half)).astype(np.int64)


def _named(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit names of lattice points (last axis)."""
    name = np.full(points.shape[:-1], table + 1, np.uint64)
    for i in range(8):
        name = mix(name + points[..., i].astype(np.uint64))
    return name.view(np.int64)


def directions(size: int) -> np.ndarray:
    """Of each table, eight directions for vectors of ``size`` components."""
    return np.random.default_rng([8, size]).standard_normal((TABLES, size, 8)) * SCALE


def cells(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: own cells (vectors x tables), probed cells (vectors x tables x probes)."""
    short = minimal_vectors()
    own, probed = np.empty((len(units), TABLES), np.int64), np.empty((len(units), TABLES, PROBES), np.int64)
    for t, way in enumerate(directions(units.shape[1])):
        x = units @ way
        point = nearest(x)
        lean = (x - point / 2) @ (short.T / 2)
        toward = np.argpartition(-lean, PROBES, axis=1)[:, :PROBES]
        own[:, t] = _named(point, t)
        probed[:, t] = _named(point[:, None, :] + short[toward], t)
    return own, probed


def _unit(x: np.ndarray) -> np.ndarray:
    # large or tiny components don't spoil the length
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _units(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one size with their unit vectors, for each size."""
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _unit(np.array([vectors[i] for i in rows], np.float64))


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cell of each vector, its own or a probed one."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            vectors = [np.asarray(v, np.float64) for v in part.column("vector").to_pylist()]
            for rows, units in _units(vectors):
                own, probed = cells(units)
                each = np.concatenate([own[:, :, None], probed], axis=2)
                is_own = np.zeros(each.shape, bool)
                is_own[:, :, 0] = True
                of = pa.array(np.repeat(rows, TABLES * (1 + PROBES)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(of),
                        pa.array(np.full(each.size, units.shape[1], np.int32)),
                        pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), len(rows))),
                        pa.array(each.reshape(-1)),
                        pa.array(is_own.reshape(-1)),
                        part.column("id").take(of),
                    ],
                    ["label", "size", "nth", "cell", "own", "id"],
                )


def _met(own: np.ndarray, probed: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Whether rows i and j meet in table t."""
    a, b = own[i, t], own[j, t]
    return (a == b) | (probed[i, t] == b[:, None]).any(axis=1) | (probed[j, t] == a[:, None]).any(axis=1)


def _forest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Those of the links that join what earlier ones have not."""
    top, kept = list(range(size)), []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        while top[b] != b:
            top[b] = top[top[b]]
            b = top[b]
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)


def _linked(least: float):
    """Of blocks of vectors: link counts, and links that hold together what is linked."""

    def block(units: np.ndarray, own_here: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that are near, one of them at home in this cell: of one part each pair once, of two parts across."""
        near = units @ units.T >= least
        near &= own_here[:, None] | own_here[None, :]
        if side[0] == 2:
            return np.nonzero(np.triu(near, 1))
        return np.nonzero(near & (side[:, None] == 0) & (side[None, :] == 1))

    def fresh(own: np.ndarray, probed: np.ndarray, i: np.ndarray, j: np.ndarray, t: int, cell: int) -> np.ndarray:
        """Pairs that meet in no earlier table, and in no smaller cell of this one."""
        out = np.ones(len(i), bool)
        for before in range(t):
            out &= ~_met(own, probed, i, j, before)
        mine, theirs = own[i, t], own[j, t]
        both = (mine != theirs) & (probed[i, t] == theirs[:, None]).any(axis=1) & (probed[j, t] == mine[:, None]).any(axis=1)
        return out & (~both | (cell == np.minimum(mine, theirs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_keys(batches, ["key"], 256):
            group = group.combine_chunks()
            key, ids, weight, own_here, side, nth, cell = (
                group[c].to_numpy() for c in ("key", "id", "weight", "own", "side", "nth", "cell")
            )
            vectors = group["vector"].combine_chunks()
            values, at = vectors.flatten().to_numpy().astype(np.float64), vectors.offsets.to_numpy()
            at = at - at[0]
            cuts = np.concatenate([[0], 1 + np.flatnonzero(key[1:] != key[:-1]), [len(key)]])
            found = []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                units = _unit(values[at[low] : at[high]].reshape(high - low, -1))
                i, j = block(units, own_here[low:high], side[low:high])
                if len(i):
                    found.append((low, high, units, i, j))
            # the cells of what is near, each vector's once
            known: dict[int, int] = {}
            fill: dict[int, list] = {}
            for low, _, units, i, j in found:
                for k in np.unique(np.concatenate([i, j])).tolist():
                    if int(ids[low + k]) not in known:
                        known[int(ids[low + k])] = len(known)
                        fill.setdefault(units.shape[1], []).append((int(ids[low + k]), units[k]))
            own, probed = np.empty((len(known), TABLES), np.int64), np.empty((len(known), TABLES, PROBES), np.int64)
            for rows in fill.values():
                for first in range(0, len(rows), 1024):
                    part = rows[first : first + 1024]
                    where = [known[k] for k, _ in part]
                    own[where], probed[where] = cells(np.array([u for _, u in part]))
            a, b, n = [], [], []
            for low, high, _, i, j in found:
                of = np.array([known.get(k, 0) for k in ids[low:high].tolist()])
                new = np.concatenate(
                    [fresh(own, probed, of[i[x : x + BLOCK]], of[j[x : x + BLOCK]], int(nth[low]), int(cell[low])) for x in range(0, len(i), BLOCK)]
                )
                i, j = i[new], j[new]
                here, heavy = ids[low:high], weight[low:high]
                count = (np.bincount(i, heavy[j], high - low) + np.bincount(j, heavy[i], high - low)).astype(np.int64)
                some, kept = np.flatnonzero(count), _forest(i, j, high - low)
                a += [here[some], here[i[kept]]]
                b += [here[some], here[j[kept]]]
                n += [count[some], np.zeros(len(kept), np.int64)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, n)], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal, and not null, their vectors equally long, and their cosine is at
    least ``least``. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Rows that share a vec_id are separate for counting and one
    for reaching; rows without a vec_id link with nothing.
    """
    clean = F.coalesce(F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), "label", (clean & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("ok"))
    # equal vectors by the bits of their values; 0 and -0 are one
    rows = rows.withColumn("name", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string"))), 256)))
    keyed = rows.select("vec_id", "label", "name")
    nodes = stored(rows.filter("ok").groupBy("label", "name").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")), "vectors")
    places = stored(nodes.select("label", "id", "vector").mapInArrow(_celled, f"label {dict(nodes.dtypes)['label']}, size int, nth int, cell long, own boolean, id long"), "cells")
    where = ["label", "size", "nth", "cell"]
    met = places.groupBy(*where).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).filter("n > 1 AND any_own").drop("any_own")
    met = met.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    crowd = places.join(met, where)
    # parts of a crowded cell meet in every combination; of a pair of parts the row knows its side
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    crowd = crowd.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64(*where, F.least("part", "other"), F.greatest("part", "other"))
    crowd = crowd.select("id", "own", "nth", "cell", "label", key.alias("key"), F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"))
    full = crowd.join(nodes.select("label", "id", "weight", "vector"), ["label", "id"])
    full = full.select("key", "id", "weight", "own", "side", "nth", "cell", "vector").repartition("key").sortWithinPartitions("key", "side", "id")
    found = stored(full.mapInArrow(_linked(least), "a long, b long, n long"), "found")
    links = found.filter("a <> b").select("a", "b")
    counts = found.filter("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    groups = components(links)
    of = nodes.select("label", "name", "id", "weight").join(counts, "id", "left").join(groups, "id", "left")
    of = of.select("label", "name", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.join(of, ["label", "name"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
