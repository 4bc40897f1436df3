"""MinHash near-dedup with an LSH forest.

Every document's set of word shingles gets a MinHash signature. A tree orders all
signatures by its own stretch of the signature; documents that share a long
prefix of a tree's order lie next to each other. Spark sorts the rows of all trees;
each sorted run with a common prefix of the least depth is a region. A region of
few rows is compared in full by signature. A larger one is cut deeper, at the
longer prefixes that its own rows share, until its parts are small: the depth
adapts to the region. Within a part the strongest links that hold it together
become candidates, and all rows of a large region are held against its most
central one. Candidates are confirmed on whole shingle sets.

Only what links to what counts in the end, so of all candidates each document's
strongest is confirmed first, and of the others those that would still join two
groups. What these cuts may have kept apart is then found exactly: the documents of
all regions that were not compared in full, or lie across the bound of a task, are
joined on their rarest shingles, of which two sets alike must share one, wherever
they are in different groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import binaries, buffers, components, mix, pair, ranges, slabs, stored

LENGTH, TREES, DEPTH, LEAST_DEPTH = 128, 16, 8, 3
#: Rows of a region that are compared in full by signature.
SMALL, PART = 16, 1024
#: Own strongest links of a row of a larger part, besides those that hold the part together.
OWN = 1
#: Sets whose shingles are counted, and how many of the frequent ones are told apart, to know which are rare.
SAMPLE, FREQUENT = 50_000, 65_536
#: Estimates this far below the threshold still become candidates: five standard errors. In larger
#: regions, whose rows are joined exactly later on, a smaller margin loses nothing.
SLACK, NEAR = 0.18, 0.12

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Of a slab of texts: a 64-bit name of every word, and the words' bounds by text."""
    letter = ~space[data]
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(letter & ~before)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    place = np.arange(len(data), dtype=np.int64)
    word = np.cumsum(letter & ~before) - 1
    place -= starts[np.maximum(word, 0)]
    longest = int(place[letter].max()) + 1
    powers = np.cumprod(np.full(longest, 0xD6E8FEB86659FD93, np.uint64))
    values = (mix(_LOWER.astype(np.uint64) + np.uint64(1)))[data]
    values[letter] *= powers[place[letter]]
    values[~letter] = 0
    return mix(np.add.reduceat(values, starts)), bounds


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a slab: each text's distinct shingles, sorted, and their bounds by text.

    A text of fewer words than ``size`` has one shingle, all its words; one without words has none.
    """
    found, bounds = words(data, offsets)
    counts = np.diff(bounds)
    heads = ranges(bounds[:-1], np.maximum(counts - size + 1, 0))
    got = found[heads]
    for i in range(1, size):
        got = pair(got, found[heads + i])
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = found[bounds[short]]
        for i in range(1, size - 1):
            more = counts[short] > i
            whole[more] = pair(whole[more], found[bounds[short[more]] + i])
        got = np.concatenate([got, mix(whole + counts[short].astype(np.uint64))])
        row = np.concatenate([row, short])
    order = np.lexsort((got, row))
    got, row = got[order], row[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
    got, row = got[new], row[new]
    return got, np.searchsorted(row, np.arange(len(counts) + 1))


def _signed(size: int):
    """Of each text: how many shingles, a 128-bit name of the set, its signature."""
    length = LENGTH
    seeds = mix(np.arange(1, length + 1, dtype=np.uint64))
    factors = mix(seeds) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slabs(batch.column("text")):
                got, bounds = shingles(data, offsets, size)
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                signature = np.zeros((len(counts), length), ">u2")
                names = [np.zeros(len(counts), np.int64) for _ in range(2)]
                if len(full):
                    heads = bounds[full]
                    for i in range(length):
                        least = np.minimum.reduceat((got ^ seeds[i]) * factors[i], heads)
                        # the high bits of a minimum hardly differ
                        signature[full, i] = (mix(least) >> np.uint64(48)).astype(np.uint16)
                    for name, key in zip(names, (1, 2), strict=True):
                        name[full] = np.add.reduceat(mix(got + np.uint64(key)), heads).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        pa.array(counts, pa.int64()),
                        *(pa.array(name) for name in names),
                        binaries(signature.reshape(-1).view(np.uint8), np.arange(len(counts) + 1) * 2 * length),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "signature"],
                )

    return run


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: its number and stretch of the signature first, to be sorted by."""
    wide = 2 * DEPTH
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, data = buffers(batch.column("signature"))
        signature = data[offsets[0] : offsets[-1]].reshape(batch.num_rows, 2 * LENGTH)
        for tree in range(TREES):
            key = np.empty((batch.num_rows, 1 + wide), np.uint8)
            key[:, 0] = tree
            key[:, 1:] = signature[:, tree * wide : (tree + 1) * wide]
            bounds = np.arange(batch.num_rows + 1) * (1 + wide)
            yield pa.RecordBatch.from_arrays([binaries(key.reshape(-1), bounds), *batch.columns], ["key", *batch.schema.names])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1, dtype=np.float32)


def _fits(size: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be alike at all."""
    return 100 * np.minimum(size, other) >= percent * np.maximum(size, other)


def _strongest(signature: np.ndarray, size: np.ndarray, least: float, percent: int) -> list[tuple[int, int, float]]:
    """Links of a forest of greatest estimates over rows and each row's own strongest ones, none below ``least``."""
    m = len(signature)
    best, by = np.full(m, -1.0, np.float32), np.zeros(m, np.int64)
    left, links, at = np.ones(m, bool), [], 0
    for _ in range(m):
        if best[at] >= least:
            links.append((int(by[at]), at, float(best[at])))
        left[at] = False
        near = _alike(signature, signature[at])
        near[~_fits(size, size[at], percent)] = -1
        near[at] = -1
        own = np.argpartition(near, -OWN)[-OWN:] if m > OWN else range(m)
        links += [(at, int(i), float(near[i])) for i in own if near[i] >= least]
        better = left & (near > best)
        best[better], by[better] = near[better], at
        at = int(np.argmax(np.where(left, best, -2)))
    return links


def _parts(keys: np.ndarray, low: int, high: int, depth: int) -> Iterator[tuple[int, int]]:
    """Cuts of sorted rows into parts: at a deeper prefix while too large, then by number."""
    if high - low <= PART:
        yield low, high
    elif depth >= DEPTH:
        for at in range(low, high, PART):
            yield at, min(at + PART, high)
    else:
        column = keys[low:high, 1 + 2 * depth : 3 + 2 * depth]
        cuts = low + 1 + np.flatnonzero((column[1:] != column[:-1]).any(axis=1))
        for a, b in zip([low, *cuts], [*cuts, high], strict=True):
            yield from _parts(keys, int(a), int(b), depth + 1)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table, tuple[bool, bool]]]:
    """Of a sorted partition: regions in order, as their bounds, keys, signatures and all columns.

    At last, whether the first and the last of them may go on in what came before or comes after.
    """
    held: list[pa.RecordBatch] = []
    cut = True
    for batch in _with_end(batches):
        if batch is not None and not batch.num_rows:
            continue
        held += [batch] if batch is not None else []
        if not held:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        matrix = lambda c, n: np.frombuffer(b"".join(rows[c].to_pylist()), np.uint8).reshape(n, -1)  # noqa: E731, B023
        keys, signature = (matrix(c, rows.num_rows) for c in ("key", "signature"))
        prefix = keys[:, : 1 + 2 * LEAST_DEPTH]
        edges = np.concatenate([[0], 1 + np.flatnonzero((prefix[1:] != prefix[:-1]).any(axis=1)), [len(keys)]])
        held = []
        ends = True
        if batch is not None:
            # the last region may go on in the next batch, unless it is large already
            if len(edges) == 2 and len(keys) < 16 * PART:
                held = rows.to_batches()
                continue
            if len(edges) > 2:
                held = rows.slice(int(edges[-2])).to_batches()
                edges = edges[:-1]
                ends = False
        yield edges, keys, np.ascontiguousarray(signature).view(np.uint16), rows, (cut, ends)
        cut = ends


def _pairs(ids: np.ndarray, links: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (ids[np.concatenate([x[i] for x in links])] for i in (0, 1))
    alike = np.concatenate([x[2] for x in links]).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(alike)], ["a", "b", "alike"])


def _candidates(percent: int):
    """Of a sorted partition: pairs of ids that share a prefix and whose signatures are alike.

    Of regions that may not give all such pairs, each id once more, paired with itself:
    those too large, and those that may go on in another partition or batch.
    """

    least, close = percent / 100 - SLACK, percent / 100 - NEAR

    def large(keys: np.ndarray, signature: np.ndarray, size: np.ndarray, low: int, high: int) -> list[tuple]:
        links = []
        for a, b in _parts(keys, low, high, LEAST_DEPTH):
            if b - a > 1:
                links += [(a + i, a + j, e) for i, j, e in _strongest(signature[a:b], size[a:b], close, percent)]
        if high - low > PART:
            mine = signature[low:high]
            usual = np.empty(mine.shape[1], mine.dtype)
            for i in range(mine.shape[1]):
                values, counts = np.unique(mine[:, i], return_counts=True)
                usual[i] = values[np.argmax(counts)]
            hub = low + int(np.argmax(_alike(mine, usual)))
            near = _alike(mine, signature[hub])
            links += [(low + int(i), hub, float(near[i])) for i in np.flatnonzero((near >= close) & _fits(size[low:high], size[hub], percent)) if low + i != hub]
        links = {(min(a, b), max(a, b)): e for a, b, e in links}
        return [(a, b, e) for (a, b), e in links.items()] + [(i, i, 0.0) for i in range(low, high)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, keys, signature, rows, (cut, ends) in _regions(batches):
            size = rows["n_shingles"].to_numpy()
            sizes, links = np.diff(edges), []
            some = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
            for m in np.unique(sizes[some]):
                i, j = np.triu_indices(int(m), 1)
                heads = edges[:-1][some[sizes[some] == m]]
                left, right = (heads[:, None] + i).ravel(), (heads[:, None] + j).ravel()
                for at in range(0, len(left), 1 << 16):
                    x, y = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
                    near = _alike(signature[x], signature[y])
                    good = (near >= least) & _fits(size[x], size[y], percent)
                    links.append((x[good], y[good], near[good]))
            for k in np.flatnonzero(sizes > SMALL):
                x, y, near = zip(*large(keys, signature, size, int(edges[k]), int(edges[k + 1])), strict=True)
                links.append((np.array(x), np.array(y), np.array(near)))
            for k in ({0} if cut else set()) | ({len(sizes) - 1} if ends else set()):
                i = np.arange(edges[k], edges[k + 1])
                links.append((i, i, np.zeros(len(i), np.float32)))
            if links:
                yield _pairs(rows["id"].to_numpy(), links)

    return run


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column("set"))
        yield pa.RecordBatch.from_arrays([pa.array(data[offsets[0] : offsets[-1]].view(np.int64))], ["shingle"])


def _rarest(percent: int, frequent: np.ndarray):
    """Of each set its rarest shingles, so many that any set alike shares one of them.

    Rare ones first, by value, then ``frequent`` in its order; place: how many of the set come before.
    Of two sets alike the smaller one shares one of its ``early`` shingles.
    """
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("set"))
            got = data[offsets[0] : offsets[-1]].view(np.uint64)
            bounds = (offsets - offsets[0]) // 8
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(got), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, got), len(values) - 1)
                rank = np.where(values[at] == got, by_value[at] + 1, 0)
            order = np.lexsort((got, rank, row))
            place = np.arange(len(got)) - bounds[row]
            kept = place <= (n + -percent * n // 100)[row]
            chosen, row, place = got[order[kept]], row[kept], place[kept]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chosen.view(np.int64)),
                    *(batch.column(c).take(of) for c in ("id", "label", "big")),
                    pa.array(n[row].astype(np.int32)),
                    pa.array(place.astype(np.int32)),
                    pa.array(place <= (n + -2 * percent * n // (100 + percent))[row]),
                ],
                ["shingle", "id", "label", "big", "n", "place", "early"],
            )

    return run


def _apart(sets: DataFrame, percent: int) -> DataFrame:
    """Of sets (id, label, set): all pairs (a, b) of different labels that may be alike, by the shingle they share first.

    Two sets alike share, from the first common shingle on, no more than what either has left.
    """
    rows = sets.count()
    sample = sets.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // SAMPLE))) == 0)
    counts = sample.mapInArrow(_shingles_of, "shingle long").groupBy("shingle").count().filter("count > 1")
    frequent = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).select("shingle").collect()
    frequent = np.array([r[0] for r in reversed(frequent)], np.int64).view(np.uint64)
    big = sets.groupBy("label").count().filter(F.col("count") > PART).select("label", F.lit(True).alias("big"))
    sets = sets.join(big, "label", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    kind = "shingle long, id long, label long, big boolean, n int, place int, early boolean"
    rare = stored(sets.mapInArrow(_rarest(percent, frequent), kind), "rare")

    def side(some: DataFrame, c: str, on: list[str]) -> DataFrame:
        return some.select(*on, *(F.col(k).alias(f"{k}_{c}") for k in ("id", "label", "n", "place") if k not in on))

    alike = F.expr(
        f"(n_x < n_y OR n_x = n_y AND id_x < id_y) AND 100L * n_x >= {percent}L * n_y"
        f" AND {100 + percent}L * least(n_x - place_x, n_y - place_y) >= {percent}L * (n_x + n_y)"
    )

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        both = side(x, "x", ["shingle"]).join(side(y, "y", ["shingle"]).hint("merge"), "shingle")
        return both.filter((F.col("label_x") != F.col("label_y")) & alike).select("id_x", "id_y")

    early, few, many = F.col("early"), ~F.col("big"), F.col("big")
    # rows of one large group never meet: of such groups, only where two of them share the shingle
    names = rare.filter(many).select("shingle", "label").distinct()
    shared = names.withColumnRenamed("label", "label_x").join(names.withColumnRenamed("label", "label_y").hint("merge"), "shingle").filter("label_x <> label_y")
    x, y = side(rare.filter(early & many), "x", ["shingle"]), side(rare.filter(many), "y", ["shingle"])
    two = shared.join(x.hint("merge"), ["shingle", "label_x"]).join(y.hint("merge"), ["shingle", "label_y"])
    pairs = met(rare.filter(early & few), rare).unionByName(met(rare.filter(early & many), rare.filter(few)))
    pairs = pairs.unionByName(two.filter(alike).select("id_x", "id_y"))
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slabs(batch.column("text")):
                got, bounds = shingles(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), binaries(got, bounds)], ["id", "set"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their sets of
    ``size``-word shingles. component_id: the smallest doc_id reachable over links; kept:
    it is the row's own. Texts without words, null ones included, have an empty set and
    no links. Rows with one doc_id are one document. A row without a doc_id has
    no links, no component and is kept. Equal sets are one node with any number of copies.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "doc_id long, n_shingles long, k1 long, k2 long, signature binary"
    signed = stored(docs.mapInArrow(_signed(size), kind), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    keys = ["n_shingles", "k1", "k2"]
    nodes = stored(full.groupBy(*keys).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "nodes")

    def sorted_trees(some: DataFrame) -> DataFrame:
        kind = T.StructType([T.StructField("key", T.BinaryType()), *some.schema.fields])
        return some.mapInArrow(_planted, kind).repartitionByRange("key").sortWithinPartitions("key")

    pairs = sorted_trees(nodes.select("id", "n_shingles", "signature")).mapInArrow(_candidates(percent), "a long, b long, alike float")
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")), "candidates")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # the same join at every size: a broadcast of ids would not last
    texts = docs.withColumnRenamed("doc_id", "id").join(ids.hint("merge"), "id")
    sets = stored(texts.mapInArrow(_sets(size), "id long, set binary"), "sets")

    def confirmed(some: DataFrame) -> DataFrame:
        one, other = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        return some.select("a", "b").join(one, "a").join(other, "b").mapInArrow(_confirmed(percent), "a long, b long")

    # of each document its strongest candidate, then whatever still joins two groups
    crowded = pairs.filter("a = b").select(F.col("a").alias("id"))
    pairs = pairs.filter("a <> b")
    turned = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))
    best = turned.groupBy("a").agg(F.max_by("b", F.struct("alike", "b")).alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(confirmed(best), "links")
    groups = components(links)
    of = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"{c}_of"))
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = F.coalesce("a_of", "a") != F.coalesce("b_of", "b")
    rest = rest.filter(apart).join(best, ["a", "b"], "left_anti")
    # equal sets of one id: rows that share a doc_id
    shared = full.join(nodes.select(*keys, "id"), keys).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b")
    shared = shared.join(full.groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("n")).filter("n > 1").select(F.col("doc_id").alias("a")), "a", "left_semi")
    links = stored(links.unionByName(confirmed(rest)).unionByName(shared), "more-links")
    groups = components(links)
    # of what may have been kept apart by cuts, every pair
    label = crowded.distinct().join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    last = _apart(stored(sets.join(label, "id"), "crowded"), percent)
    groups = components(links.unionByName(confirmed(last.join(pairs, ["a", "b"], "left_anti"))))
    member = full.join(nodes.select(*keys, "id"), keys).join(groups, "id", "left")
    member = member.select("doc_id", F.coalesce("component", "id").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles").join(member, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
