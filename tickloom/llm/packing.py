"""Packing by Karmarkar-Karp multiway differencing.

A document longer than a window fills whole windows. What remains is cut into a
large item and one or two small ones, for small items even out what large ones
leave. Documents are dealt to groups of bounded size. In a group every item begins as
a partition of its own over all windows. The two partitions with the greatest
imbalance are merged, again and again, the fullest windows of one with the
emptiest of the other, so that opposing imbalances cancel. If a window then
holds more than its capacity, the group gets more windows and starts again.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.bpe import Merges, replay, text_blocks
from tickloom.llm.common import buffers, carried, lists, once_per_worker, ranges, stored

WINDOW = 2048
#: Documents of a group, about.
GROUP = 2048
#: Small items hold at most so many ids.
GRAIN = 192
#: Characters of text whose words are merged together: a worker takes some 8 bytes for each, and keeps much of that for later tasks.
TEXT = 4 << 20
#: Characters of text split into words at once.
SPLIT = 1 << 18
#: Words kept with their ids between blocks of a task.
KEPT_WORDS = 1_000_000
#: The id that ends every document.
END = 1

#: Kinds of characters. An added token has a kind of its own.
_OTHER, _SPACE, _LETTER, _NUMBER, _ADDED = range(5)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next free one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def kinds() -> np.ndarray:
    """The kind of each character."""
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    every = "".join(map(chr, range(len(out))))
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for hit in regex.finditer(pattern, every):
            out[hit.start() : hit.end()] = kind
    # letters of the first plane that the standard library does not know yet are signs
    out[[c for c in range(0x10000) if unicodedata.category(every[c]) == "Cn"]] = _OTHER
    return out


def _starts(points: np.ndarray, kind: np.ndarray, added: list[int]) -> np.ndarray:
    """Whether a word begins at each character, as by 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+, or an added token."""
    out = np.ones(len(kind), bool)
    out[1:] = kind[1:] != kind[:-1]
    out |= kind == _NUMBER
    out &= kind != _SPACE
    out[added] = True
    # signs that begin with a quote and go on with a letter are that quote alone
    quote = np.flatnonzero((points[:-1] == ord("'")) & out[:-1] & (kind[1:] == _LETTER))
    first = points[quote + 1]
    two = np.minimum(quote + 2, len(points) - 1)
    second = np.where((two == quote + 2) & (kind[two] == _LETTER), points[two], 0)
    pairs = [(first == ord(a)) & (second == ord(b)) for a, b in ("re", "ve", "ll")]
    length = np.where(np.logical_or.reduce(pairs), 3, np.where(np.isin(first, [*map(ord, "stmd")]), 2, 0))
    quote, length = quote[length > 0], length[length > 0]
    out[quote + 1] = False
    rest = (quote + length)[quote + length < len(kind)]
    out[rest[kind[rest] == _LETTER]] = True
    return out


class WordIds:
    """Ids of texts by a BPE vocabulary with word ends: the distinct words of many texts are found by Arrow and merged once.

    inner, last: the symbol of each byte within and at the end of a word. special: the ids of added tokens.
    """

    def __init__(self, inner: np.ndarray, last: np.ndarray, special: dict[str, int], merges: Merges):
        self.inner, self.last, self.special, self.merges, self.kinds = inner, last, special, merges, kinds()
        self.between = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def folded(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The text in lower case, and where added tokens stand in it."""
        # a last sigma is no exception for this vocabulary
        lower = lambda t: t.lower() if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()
        if not any(t in text for t in self.special):
            return lower(text), []
        out, spans, n, at = [], [], 0, 0
        for hit in self.between.finditer(text):
            out += [lower(text[at : hit.start()]), hit.group()]
            n += len(out[-2]) + len(out[-1])
            spans.append((n - len(out[-1]), n))
            at = hit.end()
        return "".join([*out, lower(text[at:])]), spans

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts one after the other, and the bounds of each text's."""
        folded = [self.folded(t) for t in texts]
        # no word goes over white space
        joined = "\n".join(t for t, _ in folded) + "\n"
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t, _ in folded])])
        plain = joined.isascii()
        points = np.frombuffer(joined.encode(), np.uint8) if plain else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.kinds[points]
        spans = [(a + int(b), e + int(b)) for (_, some), b in zip(folded, begin[:-1], strict=True) if some for a, e in some]
        for a, e in spans:
            kind[a:e] = _ADDED
        starts = _starts(points, kind, [a for a, _ in spans])
        bounds = np.searchsorted(np.flatnonzero(starts), begin)
        full = kind != _SPACE
        points, at = points[full], np.flatnonzero(starts[full])
        at = np.append(at, len(points))
        data, more = points.tobytes(), 0
        if not plain:
            data = data.decode("utf-32-le").encode()
            # characters of two, three and four bytes
            for least in (0x80, 0x800, 0x10000):
                wide = np.zeros(len(points) + 1, np.int32)
                np.cumsum(points >= least, out=wide[1:])
                if not wide[-1]:
                    break
                more = more + wide[at]
            at = at + more
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)]), bounds

    def spell(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words, and their bounds."""
        own = [(i, id) for t, id in self.special.items() if (i := found.index(t.encode()).as_py()) >= 0]
        if own:
            # an added token is one symbol: no other word has letters and signs
            found = pa.compute.replace_with_mask(found, pa.array(np.isin(np.arange(len(found)), [i for i, _ in own])), pa.scalar(b" ", pa.binary()))
        bounds, data = buffers(found)
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        symbols = self.inner[data]
        symbols[bounds[1:] - 1] = self.last[data[bounds[1:] - 1]]
        for i, id in own:
            symbols[bounds[i]] = id
        return symbols, bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their bounds."""
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        cuts = np.flatnonzero(np.diff(ends // SPLIT, prepend=0, append=-1)).tolist()
        parts = [self.words(texts[a:b]) for a, b in zip([0, *cuts], cuts, strict=False) if a < b]
        # the words met before keep their numbers
        coded = pa.chunked_array([self.known, *(found for found, _ in parts)], pa.binary()).dictionary_encode()
        every = coded.chunk(0).dictionary if len(coded) else self.known
        if len(every) > len(self.known):
            symbols, bounds = replay(*self.spell(every.slice(len(self.known))), self.merges)
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
            self.ids = np.concatenate([self.ids, symbols])
        sizes = np.diff(self.bounds)
        out, counts, at = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], len(self.known)
        for found, bounds in parts:
            mine = np.concatenate([np.empty(0, np.int32), *(c.indices.to_numpy() for c in coded.slice(at, len(found)).chunks)])
            out.append(self.ids[ranges(self.bounds[mine], sizes[mine])])
            counts.append(np.diff(np.concatenate([[0], np.cumsum(sizes[mine])])[bounds]))
            at += len(found)
        self.known = every
        if len(self.known) > KEPT_WORDS:
            self.clear()
        return np.concatenate(out), np.cumsum(np.concatenate(counts))


def word_bpe(path: str, added: bool = False) -> WordIds:
    """Ids of a BPE vocabulary with word ends (a tokenizers JSON file): lower case, white space dropped.

    added: the file's added tokens are found in the text as they stand, and are ids of their own.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model = whole["model"]
    special = {t["content"]: t["id"] for t in whole["added_tokens"]} if added else {}
    if any(t[k] for t in whole["added_tokens"] if added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens are matched as they stand only")
    vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
    joined = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left, right, merged = (np.array([vocabulary[f(m)] for m in joined]) for f in (lambda m: m[0], lambda m: m[1], "".join))
    letters = byte_letters()
    inner, last = (np.array([vocabulary[c + s] for c in letters], np.int32) for s in ("", suffix))
    return WordIds(inner, last, special, Merges.of(max([*vocabulary.values(), *special.values()]) + 1, left, right, np.arange(len(joined)), merged))


def stretches(tokens: int, window: int = WINDOW) -> list[int]:
    """The lengths a document is cut into: whole windows, a large item, small ones."""
    rest = tokens % window
    tail = rest % GRAIN
    large = max(rest // GRAIN - 1, 0) * GRAIN
    return [window] * (tokens // window) + [x for x in (large, rest - large - tail, tail) if x]


def _cut(path: str, window: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once_per_worker(f"words {path} {added}", lambda: word_bpe(path, added))
        words.clear()
        at = 0
        for batch, texts in text_blocks(batches, TEXT):
            ids, bounds = words.encode(texts)
            ids = ids.astype("<u4")
            end = np.array([END], "<u4").tobytes()
            sums, counts = [], []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                raw = ids[low:high].tobytes() + end
                at_byte = 0
                for length in stretches(len(raw) // 4, window):
                    sums.append(zlib.crc32(raw[at_byte : at_byte + 4 * length]))
                    at_byte += 4 * length
                counts.append(len(sums))
            n = np.diff(bounds) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.arange(at, at + len(n))), pa.array(n), lists(np.array(sums, np.int64), np.array([0, *counts]), pa.int64())],
                ["row", "place", "doc_tokens", "crcs"],
            )
            at += len(n)
        # the worker goes on to other stages
        words.clear()

    return run


def cut(docs: DataFrame, path: str, window: int = WINDOW, added: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, with doc_tokens and the CRC-32 of each of their stretches.

    A null text is an empty one; each text ends with an id of its own. place: the
    row's number within its partition. added: as for word_bpe.
    """
    rows = carried(docs.drop("place", "doc_tokens", "crcs"))
    kind = T.StructType(
        [rows.schema["row"], T.StructField("place", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))]
    )
    return rows.mapInArrow(_cut(path, window, added), kind).select("row.*", "place", "doc_tokens", "crcs")


def differenced(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item, and the windows' sums."""
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    # nodes: items first, then pairs of nodes that share a window
    children: list[tuple[int, int]] = []
    # windows that hold nothing are left implicit: sums and nodes of the others, emptiest first
    parts = {i: ([size], [i]) for i, size in enumerate(sizes.tolist())}
    heap = [(-sums[0], i) for i, (sums, _) in parts.items()]
    heapq.heapify(heap)
    for made in range(n, 2 * n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (total, node), (sum_b, node_b) = parts.pop(a), parts.pop(b)
        if len(total) < len(sum_b):
            total, node, sum_b, node_b = sum_b, node_b, total, node
        over = max(len(total) + len(sum_b) - windows, 0)
        first = n + len(children)
        # the fullest of one meet the emptiest of the other; windows that are empty there stay as they are
        children += zip(node[:over], reversed(node_b[:over]), strict=True)
        if len(sum_b) == 1:
            # one item: into the emptiest window, which moves up to its place
            value, new = sum_b[0], node_b[0]
            if over:
                value, new = value + total[0], first
                del total[0], node[0]
            at = bisect.bisect_left(total, value)
            total.insert(at, value)
            node.insert(at, new)
        else:
            met = [(x + y, first + i) for i, (x, y) in enumerate(zip(total[:over], reversed(sum_b[:over]), strict=True))]
            both = sorted([*met, *zip(total[over:], node[over:], strict=True), *zip(sum_b[over:], node_b[over:], strict=True)])
            total, node = [x for x, _ in both], [x for _, x in both]
        parts[made] = (total, node)
        heapq.heappush(heap, ((total[0] if len(total) == windows else 0) - total[-1], made))
    ((total, node),) = parts.values()
    at = np.zeros(n, np.int64)
    for w, root in enumerate(node):
        open_nodes = [root]
        while open_nodes:
            x = open_nodes.pop()
            if x < n:
                at[x] = w
            else:
                open_nodes += children[x - n]
    return at, np.array(total + [0] * (windows - len(total)), np.int64)


def packed(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none over capacity: more windows until all fit."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return np.empty(0, np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at, sums = differenced(sizes, windows)
        if sums.max() <= capacity:
            return at
        # as many windows as bring their mean down by what the fullest has too much
        mean, excess = sums.sum() / windows, int(sums.max()) - capacity
        windows = max(windows + 1, math.ceil(sums.sum() / (mean - excess)) if excess < mean else 0)


def _pieces(keys: list[str], window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*keys, "place", "doc_tokens"], kind="stable", ignore_index=True)
        tokens = rows["doc_tokens"].to_numpy(np.int64)
        cuts = [stretches(int(n), window) for n in tokens]
        counts = np.array([len(c) for c in cuts])
        row = np.repeat(np.arange(len(rows)), counts)
        length = np.array([x for c in cuts for x in c], np.int64)
        before = np.cumsum(length) - length
        start = before - before[np.cumsum(counts) - counts][row]
        items = np.flatnonzero(length < window)
        at = packed(length[items], window)
        windows = int(at.max()) + 1 if len(at) else 0
        sequence = np.empty(len(length), np.int64)
        sequence[items] = at
        whole = np.flatnonzero(length == window)
        sequence[whole] = windows + np.arange(len(whole))
        order = np.argsort(sequence, kind="stable")
        row, start, length, sequence = row[order], start[order], length[order], sequence[order]
        ends = np.cumsum(length)
        new = np.ones(len(sequence), bool)
        new[1:] = sequence[1:] != sequence[:-1]
        out = rows.loc[row, keys].reset_index(drop=True)
        out["start"] = start
        out["length"] = length
        out["ids_crc32"] = np.concatenate([np.asarray(c, np.int64) for c in rows["crcs"]])[order]
        out["doc_tokens"] = tokens[row]
        # groups number their own windows
        out["sequence_id"] = (np.int64(key[0]) << np.int64(32)) + sequence
        out["offset"] = ends - length - (ends - length)[new][np.cumsum(new) - 1]
        return out

    return run


def pack(cuts: DataFrame, key: str = "doc_id", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """A row for each piece of the documents of ``cut``: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    No table, no rows. Keys may repeat or be null: each row is a document of its own.
    """
    cuts = stored(cuts.select(key, "place", "doc_tokens", "crcs"), "cuts")
    groups = max(1, round(cuts.count() / group))
    dealt = cuts.withColumn("_group", F.pmod(F.xxhash64(key, "place", "doc_tokens"), F.lit(groups)))
    kind = f"{key} {cuts.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(_pieces([key], window), kind)
