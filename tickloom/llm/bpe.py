"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of texts are laid out as one chain of symbols. An
inverted index holds, for each rank, the places where its pair stands. Merges are
replayed in rank order over all words at once: each touches the places of its
pair, links their neighbours anew and files the new pairs under their ranks.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import binaries, carried, once_per_worker, ranges

#: Bytes of text whose words are merged together.
BLOCK = 8 << 20
#: Words kept with their ids between blocks of a task.
KEPT_WORDS = 200_000

_NEVER = np.iinfo(np.int32).max


@dataclass
class Merges:
    """keys: sorted pairs (left * size + right) of ids; rank and merged id of each; whether a rank can be replayed in bulk."""

    size: int
    keys: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    bulk: np.ndarray

    @classmethod
    def of(cls, size: int, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> Merges:
        keys = left.astype(np.int64) * size + right
        order = np.argsort(keys)
        # the least rank of a pair that holds an id: if a merge can't make a pair of lower rank, its places don't depend on each other
        lowest = np.full(size, _NEVER, np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        bulk = np.ones(int(rank.max()) + 1 if len(rank) else 1, bool)
        bulk[rank[lowest[merged] <= rank]] = False
        by_rank = np.zeros(len(bulk), np.int64)
        by_rank[rank] = merged
        return cls(size, keys[order], rank[order].astype(np.int32), by_rank.astype(np.int32), bulk)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NEVER)


def _distinct(at: np.ndarray) -> np.ndarray:
    if len(at) < 2:
        return at
    at = np.sort(at)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return at[new]


def replay(symbols: np.ndarray, bounds: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The words ``symbols[bounds[i]:bounds[i + 1]]`` after all merges, and their new bounds."""
    n = len(symbols)
    if not n or not len(merges.keys):
        return symbols, bounds
    symbols = symbols.astype(np.int32)
    word = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    full = bounds[1:] > bounds[:-1]
    after[bounds[1:][full] - 1] = -1
    before[bounds[:-1][full]] = -1
    rank_at = np.full(n, _NEVER, np.int32)
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(at: np.ndarray) -> None:
        """Ranks of the pairs that begin at these places, filed in the index."""
        rank = merges.ranks(symbols[at], symbols[after[at]])
        rank_at[at] = rank
        some = rank < _NEVER
        if not some.all():
            at, rank = at[some], rank[some]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
        else:
            cuts = []
        for low, high in zip([0, *cuts], [*cuts, len(at)], strict=True):
            r = int(rank[low])
            if r in index:
                index[r].append(at[low:high])
            else:
                index[r] = [at[low:high]]
                heapq.heappush(heap, r)

    file(np.flatnonzero(after >= 0))
    while heap:
        r = heapq.heappop(heap)
        filed = index.pop(r)
        at = filed[0] if len(filed) == 1 else np.concatenate(filed)
        at = at[rank_at[at] == r]
        if not len(at):
            continue
        if len(at) > 1:
            at = _distinct(at)
            if merges.bulk[r]:
                # of places that overlap, every other one from the left
                joined = np.zeros(len(at), bool)
                joined[1:] = after[at[:-1]] == at[1:]
                if joined.any():
                    place = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(joined, 0, place))
                    at = at[(place - head) % 2 == 0]
            else:
                first = np.ones(len(at), bool)
                first[1:] = word[at[1:]] != word[at[:-1]]
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(heap, r)
                    at = at[first]
        right = after[at]
        symbols[at] = merges.merged[r]
        alive[right] = False
        rank_at[right] = rank_at[at] = _NEVER
        beyond = after[right]
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        left = before[at]
        new = np.concatenate([at[after[at] >= 0], left[left >= 0]])
        if len(new):
            file(_distinct(new))
    kept = np.concatenate([[0], np.cumsum(alive)])
    return symbols[alive], kept[bounds]


# --- splitting --------------------------------------------------------------

#: Characters whose classes differ between the two regular expression libraries, and all beyond the first plane.
_ODD = (
    "[\x1c-\x1f\U00010000-\U0010ffff"
    + "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in ("No", "Nl"))
    + "]"
)


def splitter(plain: str, exact: str) -> Callable[[str], list[str]]:
    """Splits by ``exact``; by ``plain``, which is the faster, where both agree."""
    odd, quick, sure = re.compile(_ODD).search, re.compile(plain).findall, regex.compile(exact).findall
    return lambda text: sure(text) if odd(text) else quick(text)


#: The word pattern of the rank files for the standard library, for texts without odd characters.
_PLAIN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


class Words:
    """Ids of texts: each text is split, and each new word of a block merged once."""

    def __init__(self, split: Callable[[str], list[str]], spell: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], merges: Merges):
        self.split, self.spell, self.merges = split, spell, merges
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their bounds."""
        known = len(self.index)
        index, split = self.index, self.split
        found = [np.array([index[w] for w in split(t)], np.int32) for t in texts]
        if len(index) > known:
            new = list(index)[known:]
            symbols, bounds = replay(*self.spell(new), self.merges)
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
            self.ids = np.concatenate([self.ids, symbols])
        sizes = np.diff(self.bounds)
        out, ends = [], [0]
        for mine in found:
            ids = self.ids[ranges(self.bounds[mine], sizes[mine])]
            out.append(ids)
            ends.append(ends[-1] + len(ids))
        if len(index) > KEPT_WORDS:
            self.clear()
        return (np.concatenate(out) if out else np.empty(0, np.int32)), np.array(ends, np.int64)


@dataclass
class Ranks:
    """A rank file: the bytes of each id."""

    tokens: dict[bytes, int]

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merges(self) -> Merges:
        """Every way to join two tokens into a token, with the token's rank."""
        found = [
            (self.tokens[token[:i]], self.tokens[token[i:]], rank)
            for token, rank in self.tokens.items()
            for i in range(1, len(token))
            if token[:i] in self.tokens and token[i:] in self.tokens
        ]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        return Merges.of(max(self.tokens.values()) + 1, left, right, rank, rank)

    def words(self, pattern: str) -> Words:
        single = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)

        def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            raw = [w.encode() for w in words]
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
            return single[np.frombuffer(b"".join(raw), np.uint8)], bounds

        return Words(splitter(_PLAIN, pattern), spell, self.merges())


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with about ``limit`` characters of text, and the texts."""
    for batch in batches:
        texts = batch.column("text")
        sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            used = sizes[first - 1] if first else 0
            end = max(int(np.searchsorted(sizes, used + limit, "right")), first + 1)
            yield batch.slice(first, end - first), texts.slice(first, end - first).to_pylist()
            first = end


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once_per_worker(f"ranks {path} {pattern}", lambda: Ranks.read(path).words(pattern))
        words.clear()
        for batch, texts in text_blocks(batches):
            ids, bounds = words.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), binaries(ids.astype("<u4"), bounds)], ["row", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``docs`` but text, with ``ids``: the text's ids as little-endian unsigned 32-bit numbers.

    ``path``: a rank file that every executor can open, as the tokenizer package's are.
    A null text is encoded as an empty one. Special tokens' strings are ordinary text.
    """
    rows = carried(docs.drop("ids"))
    kind = T.StructType([rows.schema["row"], T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(_encoded(path, pattern), kind).select("row.*", "ids")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> list[bytes]:
            tokens = Ranks.read(path).tokens
            out = [b""] * (max(tokens.values()) + 1)
            for token, rank in tokens.items():
                out[rank] = token
            return out

        tokens = once_per_worker(f"tokens {path}", read)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [b"".join([tokens[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(raw, pa.binary())], ["row", "decoded"])

    return run


def decode(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` with ``decoded``: the bytes that ``ids`` stand for; null ids stand for none."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded"))).alias("row"), "ids")
    kind = T.StructType([rows.schema["row"], T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(_decoded(path), kind).select("row.*", "decoded")
