"""Exact BM25 top-k search over an inverted index with block-max pruning.

Terms are runs of letters and digits, A-Z lowered. Document frequencies, the number
of documents and their mean length are taken over all rows. Rows are dealt to
shards of a bounded number of postings, inverted once and written. Queries come in blocks of bounded size, which travel to
the shards; no shard is shuffled again. They come in rounds: a few shards first, then ``WIDER`` times as many; a round
starts from the bars that the rounds before it left, so that what shards find does not grow with their number. A shard
groups its documents by the frequent terms they have in common, and cuts its posting lists where a group, or ``BLOCK``
documents of it, end. Of each piece of a list it knows the greatest impact. A query skips what cannot reach the bar, its
k-th best score so far: the greatest impacts of its lists bound each block of documents, those of its pieces each part of
a block, blocks are opened from the highest bound down, and it ends where the next bound lies below the bar.

All queries that open a block are scored there together. Terms in more than one of ``COMMON`` documents of the block are
multiplied as matrices that bound what they add up to; other lists are added up. Sums that may reach the bar are added
up anew. Impacts are whole millionths, so that sums are exact in any order. Each shard's top k are merged.
"""

from __future__ import annotations

import contextlib
import hashlib
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import binaries, buffers, mix, pair, ranges, slabs, stored

K1, B = 1.2, 0.75
#: Whole units of score to one.
UNIT = 1_000_000
#: Postings of a shard, about; documents of a block of alike ones at most, unless that gave more than about ``BLOCKS`` blocks.
POSTINGS, BLOCK, BLOCKS = 1 << 21, 4096, 16
#: Parts of a block that have bounds of their own, looked at if the block's is less than so many times the bar.
PARTS, NEAR = 8, 2.5
#: Groups of alike documents of a shard at most, documents of one at least, frequent terms they are told by.
GROUPS, LEAST, FEATURES = 8, 64, 512
#: Blocks that a query opens before its bar is looked at again.
FIRST = 4
#: Shards of the first round, and how many times as many have been searched after each next one.
ROUND, WIDER = 8, 8
#: Bytes of a slice: a shard is one row on disk, but Spark counts the rows it passes on at once, not their bytes alone.
SLICE = 1 << 10
#: Rows that Spark passes on to Python at once: texts and terms of ten times as many take tens of megabytes on either side.
ROWS = 1000
#: Terms that are counted at once in a task.
HELD_TERMS = 1 << 21
#: Terms of queries whose bounds are held at once, numbers of a product of matrices, postings and sums.
HELD_ENTRIES, HELD, HELD_POSTINGS = 1 << 17, 1 << 20, 1 << 18
#: Terms of a block of queries, about: what the driver holds and sends to the shards at once.
BLOCK_TERMS = 3 << 20
#: A term in more than one of so many documents of a block is common there, but the most common only of more than ``MOST_COMMON``:
#: a number for each document and common term is held.
COMMON, MOST_COMMON = 16, 2047
#: Queries of a block are told apart by their number of common terms.
TERMS = (128, 512)
#: Adding a posting takes as long as so many common terms of a document in a product of matrices.
POSTING_COST = 400

#: Of each byte of a term its lower case, of others 0; of a term's last 8 bytes those that are its own.
_FOLDED = np.zeros(256, np.uint8)
for _first, _end in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _FOLDED[_first:_end] = np.arange(_first, _end)
_FOLDED[0x41:0x5B] += 32
_OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a term that is looked at 8 bytes at a time, with all others.
SHORT = 64


def _names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a slab of texts: a 64-bit name of every term, and the terms' bounds by text."""
    size = len(data)
    padded = np.zeros(size + 8, np.uint8)
    text = np.take(_FOLDED, data, out=padded[:size], mode="clip")
    letter = text != 0
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    # a text's first letter and its last
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = letter[edges]
    edges = offsets[1:][np.diff(offsets) > 0] - 1
    ends[edges] = letter[edges]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    eight = np.ndarray(size, "<u8", padded, strides=(1,))
    names = mix(eight[starts] & _OWN[np.minimum(sizes, 8)])
    at = np.flatnonzero(sizes > 8)
    for done in range(8, SHORT, 8):
        names[at] = pair(names[at], eight[starts[at] + done] & _OWN[np.minimum(sizes[at] - done, 8)])
        at = at[sizes[at] > done + 8]
    for i in at.tolist():
        names[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    return names, np.searchsorted(starts, offsets)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: its length in terms, its distinct terms and how often each occurs."""
    for batch in batches:
        for first, end, data, offsets in slabs(batch.column("text")):
            found, bounds = _names(data, offsets)
            # a text at a time: many times faster than one order of all
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                found[low:high].sort()
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            new[bounds[:-1][np.diff(bounds) > 0]] = True
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(found))).astype(np.uint32)
            cut = np.searchsorted(at, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(bounds), pa.int64()), binaries(found[at], cut), binaries(times, cut)],
                ["doc_id", "length", "terms", "times"],
            )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def index(docs: DataFrame) -> DataFrame:
    """doc_id, length, terms (sorted 64-bit names) and times of every row of ``docs`` (doc_id, text); null texts are empty."""
    return _texts(docs).mapInArrow(_indexed, "doc_id long, length long, terms binary, times binary")


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: in how many rows each term occurs; and, without a term, the number of rows and their length."""

    def counted(held: list[np.ndarray], docs: int, length: int) -> pa.RecordBatch:
        term, n = np.unique(np.concatenate(held), return_counts=True)
        none, zeros = np.append(np.zeros(len(term), bool), True), np.zeros(len(term), np.int64)
        columns = (pa.array(np.append(x, y)) for x, y in ((n, 0), (zeros, docs), (zeros, length)))
        return pa.RecordBatch.from_arrays([pa.array(np.append(term, 0), mask=none), *columns], ["term", "n", "docs", "length"])

    held, docs, length = [], 0, 0
    for batch in _indexed(batches):
        held.append(_flat(batch.column("terms"), np.int64))
        docs, length = docs + batch.num_rows, length + int(batch.column("length").to_numpy().sum())
        if sum(map(len, held)) >= HELD_TERMS:
            yield counted(held, docs, length)
            held, docs, length = [], 0, 0
    if held:
        yield counted(held, docs, length)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: a row for each of their distinct terms."""
    for batch in _indexed(batches):
        sizes = np.array([len(x) // 8 for x in batch.column("terms").to_pylist()], np.int64)
        of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), pa.array(_flat(batch.column("terms"), np.int64))], ["query_id", "term"])


def _alike(n: int, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of documents with these posting lists: a group each, those of a group having more of their frequent terms in common."""
    sizes = np.diff(ends, prepend=0)
    often = np.argsort(-sizes, kind="stable")[: min(FEATURES, (1 << 24) // n)]
    groups = min(GROUPS, n // LEAST)
    if groups < 2 or not len(often):
        return np.zeros(n, np.int64)
    has = np.zeros((n, len(often)), np.float32)
    has[doc[ranges(ends[often] - sizes[often], sizes[often])], np.repeat(np.arange(len(often)), sizes[often])] = 1
    weight = np.maximum(has.sum(axis=1), 1)
    has /= np.sqrt(weight)[:, None]
    # the first centres lie far apart, among documents that have enough to tell
    telling = np.flatnonzero(weight >= np.median(weight))
    seeds, near = [int(telling[0])], np.zeros(len(telling))
    while len(seeds) < groups:
        near = np.maximum(near, has[telling] @ has[seeds[-1]])
        seeds.append(int(telling[near.argmin()]))
    centres = has[seeds]
    for _ in range(4):
        group = (has @ centres.T).argmax(axis=1)
        kept = np.flatnonzero(np.bincount(group, minlength=len(centres)) >= LEAST)
        centres = np.stack([has[group == g].sum(axis=0) for g in kept]) if len(kept) else centres[:1]
        centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-9)[:, None]
    return (has @ centres.T).argmax(axis=1)


def inverted(ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Posting lists of the documents that have terms: their ids and lengths in their order in the shard, where each block
    of them ends, names of terms and where each list ends, its documents and times.
    """
    some = np.flatnonzero(sizes)
    ids, lengths, sizes = ids[some], lengths[some], sizes[some]
    n = len(ids)
    if not n:
        none = np.empty(0, np.int64)
        return ids, lengths, none, none, none.astype(np.int32), none, none
    by = np.argsort(terms, kind="stable")
    terms, times, doc = terms[by], _small(times)[by], np.repeat(np.arange(n, dtype=np.int32), sizes)[by]
    head = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    names, ends = terms[head], np.append(head[1:], len(terms))
    del by, terms
    group = _alike(n, doc, ends)
    order = np.lexsort((ids, lengths, group))
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    doc = place[doc]
    # each list in the order of the shard
    by = np.repeat(np.arange(len(head), dtype=np.int32 if len(head) * n < 1 << 31 else np.int64) * n, np.diff(ends, prepend=0))
    by += doc
    by = np.argsort(by, kind="stable")
    # where a group ends a block does
    most, begins = max(BLOCK, -(-n // BLOCKS)), np.flatnonzero(np.diff(group[order], prepend=-1))
    cuts = [np.append(np.arange(low + most, high, most), high) for low, high in zip(begins.tolist(), [*begins[1:].tolist(), n])]
    return ids[order], lengths[order], np.concatenate(cuts).astype(np.int64), names, ends.astype(np.int32), doc[by], times[by]


def _runs(sums: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of numbers with these running sums that add up to ``most``, or of one."""
    at = 0
    while at < len(sums):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _unpacked(got: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Units by query and document of products with :meth:`Shard._pairs`: no less than the common terms add, and little more."""
    n, half, both = len(step), len(step) // 2, got.astype(np.int32)
    units = np.empty((len(got), n))
    np.multiply(both[:, :half] & 4095, step[:half], out=units[:, :half])
    np.multiply(both[:, half:], step[half : n - half], out=units[:, half : n - half])
    np.multiply(both[:, :half] >> 12, step[n - half :], out=units[:, n - half :])
    return units


class Shard:
    """Posting lists of a shard for the sorted ``names`` of a block's terms with their weights, by blocks of alike documents.

    Of each list it knows what it holds in each block and the greatest impact there.
    """

    def __init__(self, lists: tuple[np.ndarray, ...], mean: float, names: np.ndarray, weights: np.ndarray):
        self.ids, lengths, cuts, mine, ends, doc, times = lists
        self.edges = np.concatenate([[0], cuts])
        sizes = np.diff(ends, prepend=0)
        at = np.searchsorted(names, mine)
        at[at == len(names)] = 0
        known = np.flatnonzero(names[at] == mine) if len(names) else at[:0]
        #: of each name its number here
        self.place = np.full(len(names), -1, np.int32)
        self.place[at[known]] = np.arange(len(known))
        posting, sizes = ranges(ends[known] - sizes[known], sizes[known]), sizes[known]
        blocks, n = len(cuts), len(known)
        doc, times, term = doc[posting], times[posting], np.repeat(np.arange(n, dtype=np.int32), sizes)
        # by block, so that what is looked up together lies together
        of = np.searchsorted(cuts, np.arange(len(self.ids)), "right").astype(np.uint8 if blocks < 256 else np.int32)
        by = np.argsort(of[doc], kind="stable")
        doc, term = doc[by], term[by]
        units = times[by].astype(np.float64)
        del posting, by, times
        under = (K1 * (1 - B + B * lengths / mean))[doc]
        under += units
        units *= K1 + 1
        units /= under
        units *= weights[at[known]][term]
        units *= UNIT
        units += 0.5
        #: millions of units and fewer
        self.units = np.floor(units, out=units).astype(np.int32)
        self.doc = (doc - self.edges[of[doc]]).astype(np.int32)
        del units, under
        # where a list or a block begins a piece does
        of = of[doc]
        head = np.flatnonzero(np.concatenate([[len(term) > 0], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]))
        piece = of[head] * np.int64(n) + term[head]
        self.most, self.sizes, self.starts = (np.zeros(n * blocks, np.int32) for _ in range(3))
        if len(head):
            self.most[piece] = np.maximum.reduceat(self.units, head)
            self.sizes[piece] = np.diff(np.append(head, len(term)))
            self.starts[piece] = head
        self.sizes, self.starts = self.sizes.reshape(blocks, n), self.starts.reshape(blocks, n)
        #: floats, not less
        self.most = np.ascontiguousarray(self.most.reshape(blocks, n).T, np.float32) * np.float32(1 + 2.0**-22)
        self.count = np.arange(1 << 16)

    def _opened(self, block: int) -> types.SimpleNamespace:
        """Of a block: where the lists begin and their sizes; each term's column among the common ones, or -1, and their units by document."""
        at = types.SimpleNamespace(low=int(self.edges[block]), n=int(self.edges[block + 1] - self.edges[block]))
        at.starts, at.sizes = self.starts[block].astype(np.int64), self.sizes[block].astype(np.int64)
        common = np.flatnonzero(at.sizes * COMMON > at.n)
        if len(common) > MOST_COMMON:
            common = np.sort(common[np.argsort(-at.sizes[common], kind="stable")[:MOST_COMMON]])
        at.columns, at.column = len(common), np.full(len(at.sizes), -1, np.int32)
        at.column[common] = np.arange(len(common))
        at.whole, at.pairs = np.zeros((at.n, len(common)), np.int32), {}
        posting = ranges(at.starts[common], at.sizes[common])
        at.whole[self.doc[posting], np.repeat(np.arange(len(common)), at.sizes[common])] = self.units[posting]
        # the greatest impacts in each part of the block
        some = np.flatnonzero(at.sizes)
        posting = slice(int(at.starts[some[0]]), int(at.starts[some[-1]] + at.sizes[some[-1]]))
        piece = np.repeat(np.arange(len(some)) * PARTS, at.sizes[some])
        piece += self.doc[posting].astype(np.int64) * PARTS // at.n
        head = np.flatnonzero(np.diff(piece, prepend=-1))
        most = np.zeros(len(some) * PARTS, np.int32)
        most[piece[head]] = np.maximum.reduceat(self.units[posting], head)
        at.most = np.zeros((len(at.sizes), PARTS), np.float32)
        at.most[some] = most.reshape(-1, PARTS) * (1 + 2.0**-22)
        return at

    def _pairs(self, at: types.SimpleNamespace, terms: int) -> tuple[np.ndarray, np.ndarray]:
        """For queries of at most so many common terms: the steps of these in a block's documents, two documents in one number, and
        the units of a step of each document.

        A float holds whole numbers below 2 ** 24. A document's units are counted in steps of its own, rounded up, so that so many
        terms of it are less than 2 ** 12 steps; a step of the block's second half is 2 ** 12 of the first half's.
        """
        if terms not in at.pairs:
            half, step, steps = at.n // 2, np.empty(at.n), np.empty(at.whole.shape, np.float32)
            for a in range(0, at.n, 256):
                whole = at.whole[a : a + 256]
                most = np.partition(whole, at.columns - terms, axis=1)[:, at.columns - terms :] if terms < at.columns else whole
                step[a : a + 256] = np.maximum(most.sum(axis=1, dtype=np.float64), 1) / (4095 - np.count_nonzero(most, axis=1))
                steps[a : a + 256] = np.ceil(whole / step[a : a + 256, None])
            pairs = np.concatenate([steps[at.n - half :], steps[half : at.n - half]])
            pairs[:half] *= 4096
            pairs[:half] += steps[:half]
            # a hair for the rounding of steps to units
            at.pairs[terms] = pairs, step * (1 + 2.0**-40)
        return at.pairs[terms]

    def _searched(
        self, at: types.SimpleNamespace, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, bars: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, ...]]:
        """Best rows of a block for some queries (their terms, one after the other, and how many each has); their bars are raised.

        Common terms are multiplied as matrices of bounds where that takes less time, and sums that may reach the bar added up anew.
        """
        out = []
        begins, size, column = np.cumsum(counts) - counts, at.sizes[terms], at.column[terms]
        every, common = np.add.reduceat(size, begins), np.add.reduceat(np.where(column >= 0, size, 0), begins)
        many = np.add.reduceat(column >= 0, begins, dtype=np.int64)
        dense = common * POSTING_COST > at.n * at.columns
        least = 0
        for most in (0, *(x for x in TERMS if x < at.columns), at.columns):
            of = np.flatnonzero(dense & (many > least) & (many <= most)) if most else np.flatnonzero(~dense)
            heavy = np.cumsum(at.n + at.columns + counts[of] if most else counts[of])
            for low, high in _runs(heavy, HELD):
                mine = of[low:high]
                by = ranges(begins[mine], counts[mine])
                row, hits, first = np.repeat(np.arange(len(mine)), counts[mine]), size[by], at.starts[terms[by]]
                asked = np.empty(0, np.int32)
                held, got, step = np.zeros(len(mine) + 1, np.int64), None, None
                if most:
                    is_common = np.flatnonzero(column[by] >= 0)
                    asked, held[1:] = column[by[is_common]], np.cumsum(many[mine])
                    matrix = np.zeros((len(mine), at.columns), np.float32)
                    matrix[row[is_common], asked] = 1
                    hits[is_common] = 0
                    pairs, step = self._pairs(at, most)
                    got = matrix @ pairs.T
                some = np.flatnonzero(hits)
                row, hits, first = row[some], hits[some], first[some]
                bounds = np.searchsorted(row, np.arange(len(mine) + 1))
                for a, b in _runs(np.cumsum(every[mine] - (common[mine] if most else 0) + at.n), HELD_POSTINGS):
                    part = slice(bounds[a], bounds[b])
                    left = self._left(at, row[part] - a, hits[part], first[part], b - a)
                    sums = left if got is None else left + _unpacked(got[a:b], step)
                    q, d, units = self._reached(at, left, sums, asked, held[a : b + 1], bars[rows[mine[a:b]]], k)
                    q, d, units = self.best(rows[mine[a:b]][q], d + at.low, units, k)
                    out.append((q, d, units))
                    # the k-th best of those that found k
                    kth = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
                    bars[q[kth]] = np.maximum(bars[q[kth]], units[kth])
            least = most
        return out

    def _left(self, at: types.SimpleNamespace, row: np.ndarray, sizes: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
        """Sums by query and document of pieces of lists, whole numbers far below 2 ** 53, which doubles hold exactly."""
        posting = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        if len(self.count) < len(posting):
            self.count = np.arange(len(posting))
        posting += self.count[: len(posting)]
        cell = self.doc.take(posting, mode="clip")
        cell += np.repeat((row * at.n).astype(np.int32), sizes)
        return np.bincount(cell, self.units.take(posting, mode="clip"), rows * at.n).astype(np.float64, copy=False).reshape(rows, at.n)

    def _reached(self, at: types.SimpleNamespace, left: np.ndarray, sums: np.ndarray, asked: np.ndarray, held: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Number of the query, document and units of what reaches the bar, the best k and perhaps more; ``sums`` are bounds."""
        found = sums >= bars[:, None]
        many = np.flatnonzero(np.count_nonzero(found, axis=1) > 4 * k)
        if len(many):
            # of k rows with the greatest bounds the least is reached by k
            likely = np.argpartition(sums[many], at.n - k, axis=1)[:, at.n - k :].ravel()
            sure = self._units(at, left, asked, held, np.repeat(many, k), likely).reshape(-1, k).min(axis=1)
            bars[many] = np.maximum(bars[many], sure)
            found[many] = sums[many] >= bars[many, None]
        cell = np.flatnonzero(found)
        q, d = cell // at.n, cell % at.n
        units = self._units(at, left, asked, held, q, d)
        best = np.flatnonzero(units >= bars[q])
        return q[best], d[best], units[best].astype(np.int64)

    def _units(self, at: types.SimpleNamespace, left: np.ndarray, asked: np.ndarray, held: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whole sums of these cells: what is left and the units of the query's common terms."""
        units, sizes = left[q, d], held[q + 1] - held[q]
        for a, b in _runs(np.cumsum(sizes), HELD) if len(asked) else ():
            column = asked[ranges(held[q[a:b]], sizes[a:b])]
            column = column + np.repeat(d[a:b] * at.columns, sizes[a:b])
            units[a:b] += np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), at.whole.ravel().take(column), b - a)
        return units

    def best(self, q: np.ndarray, d: np.ndarray, units: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Of each query the best k of these rows; of equal units the smaller ids."""
        by = np.lexsort((self.ids[d], -units, q))
        q, d, units = q[by], d[by], units[by]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[kept], d[kept], units[kept]

    def top(self, terms: np.ndarray, ends: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Number of the query, id and units of the best k rows for each query that reach its bar.

        ``terms`` are places of names, one query's after the other's, and ``ends`` where each ends. Blocks are opened from the highest
        bound down; one's matrices are held at a time.
        """
        ends, counts, found = np.concatenate([[0], ends]), np.zeros(len(bars), np.int64), []
        for a, b in _runs(ends[1:], HELD_ENTRIES):
            part = self.place[terms[ends[a] : ends[b]]]
            counts[a:b] = np.diff(np.concatenate([[0], np.cumsum(part >= 0)])[ends[a : b + 1] - ends[a]])
            found.append(part[part >= 0])
        terms = np.concatenate(found) if found else np.empty(0, np.int32)
        del found
        ends = np.concatenate([[0], np.cumsum(counts)])
        begins, blocks = ends[:-1], self.most.shape[1]
        bars, limit = bars.astype(np.float64), np.zeros((len(bars), blocks))
        some = np.flatnonzero(counts)
        for a, b in _runs(np.cumsum(counts[some]), HELD_ENTRIES):
            mine = some[a:b]
            limit[mine] = np.add.reduceat(self.most.take(terms[begins[mine[0]] : ends[mine[-1] + 1]], axis=0, mode="clip"), begins[mine] - begins[mine[0]])
        slack = 1 + (counts + 1) * 2.0**-22
        limit *= slack[:, None]
        turn = np.argsort(np.argsort(-limit, axis=1, kind="stable"), axis=1)
        out = [(np.empty(0, np.int64),) * 3]
        # without bars yet the highest few come first
        opened, many = 0, FIRST if (bars <= 1).any() else blocks
        while (wanted := (turn >= opened) & (limit >= bars[:, None])).any():
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero((turn[:, block] >= opened) & (turn[:, block] < opened + many) & (limit[:, block] >= bars))
                at = self._opened(block) if len(rows) else None
                for a, b in _runs(np.cumsum(counts[rows]), HELD_ENTRIES):
                    mine = rows[a:b]
                    # closed again if no part of the block can reach the bar
                    near = np.flatnonzero(limit[mine, block] < NEAR * bars[mine])
                    if len(near):
                        sizes = counts[mine[near]]
                        bounds = np.add.reduceat(at.most.take(terms[ranges(begins[mine[near]], sizes)], axis=0, mode="clip"), np.cumsum(sizes) - sizes)
                        mine = np.delete(mine, near[bounds.max(axis=1) * slack[mine[near]] < bars[mine[near]]])
                    if len(mine):
                        out += self._searched(at, mine, terms[ranges(begins[mine], counts[mine])], counts[mine], bars, k)
            opened, many = opened + many, many * 3
        q, d, units = self.best(*(np.concatenate(x) for x in zip(*out, strict=True)), k)
        return q, self.ids[d], units


_SHARD = "shard int, slices array<binary>"
_KINDS = (np.int64, np.int64, np.int64, np.int64, np.int32)
_FOUND = "query_id long, doc_id long, units long"


def _small(values: np.ndarray) -> np.ndarray:
    """The numbers, in as few bytes as hold the greatest."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _sliced(lists: tuple[np.ndarray, ...]) -> list[bytes]:
    """The arrays of :func:`inverted` one after the other, in slices of ``SLICE`` bytes; their sizes come first."""
    lists = (*lists[:5], *(_small(x) for x in lists[5:]))
    sizes = np.array([len(lists[0]), len(lists[2]), len(lists[3]), len(lists[5]), *(x.itemsize for x in lists[5:])], np.int64)
    whole = b"".join(x.tobytes() for x in (sizes, *lists))
    return [whole[at : at + SLICE] for at in range(0, len(whole), SLICE)]


def _joined(slices: list[bytes]) -> tuple[np.ndarray, ...]:
    """The arrays out of their slices."""
    whole = b"".join(slices)
    docs, blocks, terms, postings, *widths = np.frombuffer(whole, np.int64, 6).tolist()
    out, at = [], 48
    for kind, n in zip((*_KINDS, *(f"u{w}" for w in widths)), (docs, docs, blocks, terms, terms, postings, postings), strict=True):
        out.append(np.frombuffer(whole, kind, n, at))
        at += out[-1].nbytes
    return tuple(out)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard out of rows sorted by shard."""

    def done(shard: int, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(column) for column in zip(*rows, strict=True)]
        rows.clear()
        lists = inverted(*columns)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_sliced(lists)], pa.list_(pa.binary()))], ["shard", "slices"])

    at, rows = None, []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows]
        for low, high in zip(bounds, bounds[1:]):
            if low == high:
                continue
            if rows and shards[low] != at:
                yield done(int(at), rows)
            at, part = shards[low], batch.slice(low, high - low)
            (starts, terms), (_, times) = (buffers(part.column(c)) for c in ("terms", "times"))
            first, last = int(starts[0]), int(starts[-1])
            rows.append(
                (
                    part.column("doc_id").to_numpy(), part.column("length").to_numpy(), np.diff(starts) // 8,
                    np.frombuffer(terms[first:last].tobytes(), np.int64), np.frombuffer(times[first // 2 : last // 2].tobytes(), np.uint32),
                )
            )
    if rows:
        yield done(int(at), rows)


def _searched(k: int, mean: float, block, bars):
    """Of each shard: the best rows that reach its bar for each query of a block (ids, where their terms end, places of terms, names, weights)."""

    def searched(slices: list[bytes]) -> pa.RecordBatch:
        ids, ends, terms, names, weights = block.value
        lists = _joined(slices)
        slices.clear()
        shard = Shard(lists, mean, names, weights)
        del lists
        q, d, units = shard.top(terms, ends, bars.value, k)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], d, units)], ["query_id", "doc_id", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for number, part in zip(batch.column("number").to_pylist(), batch.column("slice").to_pylist(), strict=True):
                if held and not number:
                    yield searched(held)
                held.append(part)
        if held:
            yield searched(held)

    return run


@contextlib.contextmanager
def _batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run meanwhile pass ``ROWS`` rows on at once, or as few as the session says."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS if int(before) <= 0 else min(ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def top_k(docs: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: the best k rows for each row that ``queries`` (a condition on doc_id) holds for.

    A query is the set of terms of its whole text; it finds itself too. Ties go to the smaller
    doc_id. Rows without a shared term are not found. Rows without a doc_id count for the
    statistics but can't be found; rows that share one are found as they are.
    """
    with _batches(docs.sparkSession):
        return _top_k(docs, queries, k)


def _top_k(docs: DataFrame, queries: Column, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = index(docs)
    # texts are taken apart twice rather than written as terms
    counts = stored(_texts(docs).mapInArrow(_frequencies, "term long, n long, docs long, length long"), "frequencies")
    n, length, postings = counts.agg(F.sum("docs"), F.sum("length"), F.sum("n")).first()
    n, mean, shards = n or 0, (length or 0) / (n or 1) or 1.0, max(1, -(-(postings or 0) // POSTINGS))
    frequency = counts.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight")

    rounds, dealt = 1, F.pmod(F.xxhash64("doc_id", "length"), F.lit(shards)).cast("int")
    turn = F.lit(0)
    while ROUND * WIDER ** (rounds - 1) < shards:
        turn, rounds = turn + (F.col("shard") >= ROUND * WIDER ** (rounds - 1)).cast("int"), rounds + 1
    lists = rows.filter("doc_id IS NOT NULL").withColumn("shard", dealt).repartition("shard").sortWithinPartitions("shard")
    lists = stored(lists.mapInArrow(_inverted, _SHARD).withColumn("round", turn), "shards", "round")

    wanted = _texts(docs.filter(queries & F.col("doc_id").isNotNull()))
    wanted = wanted.mapInArrow(_terms, "query_id long, term long").distinct().join(frequency, "term")
    wanted = wanted.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", weight))).alias("t"))
    wanted = stored(wanted, "queries")
    blocks = max(1, -(-int(wanted.agg(F.sum(F.size("t"))).first()[0] or 0) // BLOCK_TERMS))
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("units"), "doc_id"))
    best = None
    for number in range(blocks):
        # a block's terms, a bounded number, go to all shards
        block = _block(wanted.filter(block_of == number).orderBy("query_id").toArrow())
        sent, bars, mine = spark.sparkContext.broadcast(block), np.ones(len(block[0]), np.int64), None
        for at in range(rounds):
            part = lists.filter(F.col("round") == at).select(F.posexplode("slices").alias("number", "slice"))
            found = part.mapInArrow(_searched(k, mean, sent, spark.sparkContext.broadcast(bars)), _FOUND)
            found = found if mine is None else mine.drop("rank").unionByName(found)
            mine = stored(found.withColumn("rank", rank).filter(F.col("rank") <= k), "found")
            # a number for each query of the block that found k rows
            bar = mine.filter(F.col("rank") == k).select("query_id", "units").toPandas()
            bars = bars.copy()
            bars[np.searchsorted(block[0], bar["query_id"].to_numpy(np.int64))] = bar["units"].to_numpy(np.int64)
        best = mine if best is None else best.unionByName(mine)
    return best.select("query_id", "rank", "doc_id", (F.col("units") / UNIT).alias("score"))


def _block(part: pa.Table) -> tuple[np.ndarray, ...]:
    """Queries' ids, where the terms of each end, the terms' places among their names, sorted; the names and their weights."""
    part = part.combine_chunks()
    if not part.num_rows:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.int32), none, np.empty(0)
    t = part["t"].chunk(0)
    ends = t.offsets.to_numpy().astype(np.int64)
    flat = t.flatten()
    names, first, at = np.unique(flat.field("term").to_numpy(), return_index=True, return_inverse=True)
    return part["query_id"].to_numpy(), ends[1:] - ends[0], at.astype(np.int32), names, flat.field("weight").to_numpy()[first]
