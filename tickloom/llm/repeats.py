"""Suffix-array dedup: which bytes lie in a long string that occurs elsewhere too.

Prefix doubling names all strings of one length, then those of twice the length
by the pairs of names at a growing offset. Ranking every byte position of a
corpus in every round would shuffle 16 bytes a position, so rounds are thinned:
in the round of length l every start s of a 400-byte string stands by the least
l-byte name within [s, s + 400). Equal strings have equal least names, so a name
that stands at one place only drops its starts for good; Spark groups the
names and counts their places. In the last round l is the whole length and each
surviving start stands by its own name. There the strings of a run of starts travel
together; equal runs of a slab of texts, as a passage has them that a third of all texts hold, travel once
and are told apart again by where they stand, on rows without strings. Those of a frequent name are dealt to up to ``SALTS`` keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import binaries, buffers, lists, mix, pair, ranges, slabs, stored, whole_keys

LENGTH = 400
#: Length of the names in the thinned round.
SHORT = 50
#: Runs of one name dealt to a task; a more frequent name is split by the names of its strings.
RUNS = 2048
#: Keys that the places of a run are dealt to at most, one for each ``RUNS`` runs of its name.
SALTS = 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def names(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of the string of ``length`` bytes at each start, by doubling."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    if length < 8:
        got = mix(data[: len(data) - length + 1].astype(np.uint64) + np.uint64(1))
        for i in range(1, length):
            got = pair(got, data[i : len(data) - length + 1 + i].astype(np.uint64))
        return got
    data = np.ascontiguousarray(data)
    got = mix(np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)))
    at = 8
    while at < length:
        step = min(at, length - at)
        got = pair(got[:-step], got[step:])
        at += step
    return got


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    at = 1
    while at < width:
        step = min(at, width - at)
        values = np.minimum(values[:-step], values[step:])
        at += step
    return values


def _places(name: np.ndarray, low: np.ndarray, high: np.ndarray, short: np.ndarray, found: np.ndarray, width: int) -> np.ndarray:
    """At how many places the least name of each run of starts stands within its strings."""
    if not len(name):
        return np.empty(0, np.int64)
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(short == ~least(~np.concatenate([pad, found, pad]), width))
    first = np.searchsorted(chosen, low, "left")
    counts = np.searchsorted(chosen, high + width - 1, "right") - first
    hit = short[chosen[ranges(first, counts)]] == np.repeat(name, counts)
    return np.bincount(np.repeat(np.arange(len(name)), counts), hit, len(name)).astype(np.int64)


def _words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words, parted by white space, each text has."""
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    first[inner] = ~space[inner]
    before = np.concatenate([[0], np.cumsum(first)])
    return before[offsets[1:]] - before[offsets[:-1]]


def _runs(length: int, short: int):
    """Of each text: the runs of starts with one least name."""
    width = length - short + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slabs(batch.column("text")):
                shorts = names(data, short)
                every = least(shorts, width) if len(data) >= length else np.empty(0, np.uint64)
                counts = np.maximum(np.diff(offsets) - length + 1, 0)
                # starts whose string would reach into the next text are left out
                starts = ranges(offsets[:-1], counts)
                found = every[starts]
                row = np.repeat(np.arange(len(counts)), counts)
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(found))[: len(at)] - 1
                places = _places(found[at], starts[at], starts[last], shorts, every, width)
                bounds = np.searchsorted(row[at], np.arange(len(counts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        batch.column("digest").slice(first, end - first),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(_words(data, offsets), pa.int64()),
                        lists(found[at].view(np.int64), bounds, pa.int64()),
                        lists((starts[at] - offsets[row[at]]).astype(np.int32), bounds, pa.int32()),
                        lists(places.astype(np.int32), bounds, pa.int32()),
                    ],
                    ["doc_id", "digest", "n_bytes", "n_words", "names", "starts", "places"],
                )

    return run


def _contents(strings: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of strings[bounds[i]:bounds[i + 1]], each list as a whole and in order."""
    at = ranges(np.zeros(len(bounds) - 1, np.int64), np.diff(bounds)).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(pair(strings, at + np.uint64(1)), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]])


def _starts(length: int, as_places: bool):
    """Of each surviving run: the names of its strings, dealt out by name where there are many runs.

    Equal ones of a slab are one row that tells whether there are several, and of several texts. Or, ``as_places``,
    where each stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slabs(batch.column("text")):
                part = batch.slice(first, end - first)
                found = names(data, length)
                at = part.column("runs")
                of = np.repeat(np.arange(len(part)), np.diff(at.offsets.to_numpy()))
                flat = at.flatten()
                name, low, high, parts = (flat.field(k).to_numpy() for k in ("name", "low", "high", "parts"))
                starts = ranges(low, high - low)
                run_of = np.repeat(np.arange(len(low)), high - low)
                mine = found[starts + offsets[of[run_of]]]
                sub = (mine >> np.uint64(7)) % parts[run_of].astype(np.uint64)
                order = np.lexsort((starts, sub, run_of)) if (parts > 1).any() else np.arange(len(mine))
                mine, starts, sub, run_of = mine[order], starts[order], sub[order], run_of[order]
                new = np.ones(len(mine), bool)
                new[1:] = (run_of[1:] != run_of[:-1]) | (sub[1:] != sub[:-1])
                cut = np.append(np.flatnonzero(new), len(mine))
                head, sub = run_of[cut[:-1]], sub[cut[:-1]].astype(np.int64)
                content = _contents(mine, cut)
                texts, keys = part.column("text_id"), name[head]
                if as_places:
                    # where a run is whole its places follow from the first
                    split = np.concatenate([[0], np.cumsum(np.where(parts[head] > 1, np.diff(cut), 0))])
                    yield pa.RecordBatch.from_arrays(
                        [
                            texts.take(pa.array(of[head])), pa.array(keys, pa.int64()), pa.array(sub), pa.array(content.view(np.int64)),
                            pa.array(starts[cut[:-1]].astype(np.int32)), binaries(starts.astype(np.int32)[parts[run_of] > 1], split), pa.array(parts[head]),
                        ],
                        ["text_id", "name", "sub", "content", "low", "places", "parts"],
                    )
                    continue
                order = np.lexsort((of[head], content, sub, keys))
                same = (keys[order][1:] == keys[order][:-1]) & (sub[order][1:] == sub[order][:-1]) & (content[order][1:] == content[order][:-1])
                group = np.append(np.flatnonzero(~np.concatenate([[False], same])), len(order)) if len(order) else np.zeros(1, np.int64)
                one = order[group[:-1]]
                last = order[group[1:] - 1] if len(one) else one
                sizes = (cut[1:] - cut[:-1])[one]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        texts.take(pa.array(of[head][one])), pa.array(keys[one], pa.int64()), pa.array(sub[one]), pa.array(content[one].view(np.int64)),
                        binaries(mine[ranges(cut[:-1][one], sizes)], bounds), pa.array(np.diff(group) > 1), pa.array(of[head][one] != of[head][last]), pa.array(parts[head][one]),
                    ],
                    ["text_id", "name", "sub", "content", "strings", "several", "texts", "parts"],
                )

    return run


def _repeated(across: bool):
    """Of runs sorted by name: which strings of each stand elsewhere too, or, ``across``, in another text.

    ``hits`` are stretches of these, each the number of its first string and of that behind its last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_keys(batches, ["name", "sub"], 256):
            group = group.combine_chunks()
            held = group["strings"].combine_chunks()
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            offsets, data = buffers(held)
            strings = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint64)
            if not len(strings):
                continue
            sizes = np.diff(offsets) // 8
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(strings, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], strings[order[1:]] != strings[order[:-1]]]))
            if across:
                text = group["text_id"].to_numpy()[row[order]]
                hit = np.maximum.reduceat(text, heads) != np.minimum.reduceat(text, heads)
                hit |= np.logical_or.reduceat(group["texts"].to_numpy()[row[order]], heads)
            else:
                times = np.diff(np.append(heads, len(order)))
                hit = (times > 1) | np.logical_or.reduceat(group["several"].to_numpy()[row[order]], heads)
            twice = np.zeros(len(strings), bool)
            twice[order] = np.repeat(hit, np.diff(np.append(heads, len(order))))
            at, row = ranges(np.zeros(len(sizes), np.int64), sizes)[twice], row[twice]
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(at))[: len(head)] - 1
            stretches = np.stack([at[head], at[last] + 1], axis=1).astype(np.int32).ravel()
            bounds = np.concatenate([[0], 2 * np.cumsum(np.bincount(row[head], minlength=len(sizes)))])
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                # one row for each content, though slabs may have sent it several times
                key = [group[k].to_numpy()[some] for k in ("name", "sub", "content", "parts")]
                order = np.lexsort(key[::-1])
                new = np.ones(len(order), bool)
                new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
                kept = np.sort(order[new])
                lengths = np.diff(bounds)[some[kept]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k[kept]) for k in key), binaries(stretches[ranges(bounds[some[kept]], lengths)], np.concatenate([[0], np.cumsum(lengths)]))],
                    ["name", "sub", "content", "parts", "hits"],
                )

    return run


def _ranges(length: int):
    """Of runs with their repeated strings: the bytes of each text that these cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (at, hits), (split, places) = (buffers(batch.column(k)) for k in ("hits", "places"))
            at, split = at // 4, split // 4
            first, end = np.frombuffer(hits.tobytes(), np.int32)[at[0] : at[-1]].astype(np.int64).reshape(-1, 2).T
            found = ranges(first, end - first)
            row = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(at) // 2), end - first)
            there = np.frombuffer(places.tobytes(), np.int32)
            start = batch.column("low").to_numpy().astype(np.int64)[row] + found
            apart = (np.diff(split) > 0)[row]
            start[apart] = there[split[:-1][row[apart]] + found[apart]]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id").take(pa.array(row[head])), pa.array(start[head].astype(np.int32)), pa.array((start[last] + length).astype(np.int32))],
                ["text_id", "low", "high"],
            )

    return run


def merged(low: list[int], high: list[int]) -> list[tuple[int, int]]:
    """The union of ranges, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low, high, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(words: int):
    """Of texts with ranges to remove: what is left, and the runs removed; runs of up to ``words`` words stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, digest, text, cut in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "digest", "text", "cut")), strict=True):
                raw = text.encode()
                spans = merged([c["low"] for c in cut], [c["high"] for c in cut])
                spans = [(a, b) for a, b in spans if not words or len(raw[a:b].split()) > words]
                left, at = [], 0
                for a, b in [*spans, (len(raw), len(raw))]:
                    left.append(raw[at:a])
                    at = b
                # halves of characters at a cut have no place in a text
                text = "".join(piece.decode(errors="ignore") for piece in left)
                out.append((doc_id, digest, sum(b - a for a, b in spans), [{"low": a, "high": b} for a, b in spans], hashlib.sha256(b"".join(left)).hexdigest(), text))
            span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            kinds = (pa.int64(), pa.binary(), pa.int64(), span, pa.string(), pa.string())
            heads = ("doc_id", "digest", "n_removed", "spans", "kept_sha256", "kept_text")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], list(heads))

    return run


@dataclass
class Repeats:
    """documents: doc_id, digest, n_bytes, n_words, copies (rows with that text).
    texts: doc_id, digest, text (null: empty) of the same rows.
    cut: doc_id, digest, text, cut (ranges to remove) of texts that have no copy.
    Runs of up to ``words`` words are left alone."""

    documents: DataFrame
    texts: DataFrame
    cut: DataFrame
    length: int
    words: int

    def kept(self) -> DataFrame:
        kind = "doc_id long, digest binary, n_removed long, spans array<struct<low: long, high: long>>, kept_sha256 string, kept_text string"
        return self.cut.mapInArrow(_kept(self.words), kind)

    def whole(self) -> Column:
        """Texts that go as a whole, as they have copies."""
        return (F.col("copies") > 1) & (F.col("n_bytes") >= self.length) & (F.col("n_words") > self.words if self.words else F.lit(True))


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))


def _among(rows: DataFrame, ids: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """Rows with one of the ``ids``, or with none.

    These are written by themselves, so that their size is known: Spark broadcasts them up to its own limit,
    and then texts stay where they are; beyond it both sides are shuffled.
    """
    return rows.join(stored(ids.distinct(), name), ids.columns, how)


def repeats(docs: DataFrame, length: int = LENGTH, short: int = SHORT, words: int = 0, across: bool = False) -> Repeats:
    """Strings of ``length`` bytes of ``docs`` (doc_id, text) that start at two places or more.

    With ``across`` these must be places in two texts. Of what such strings cover without a gap,
    stretches of up to ``words`` words are left alone.

    Null texts are empty; texts shorter than ``length`` have no such string.
    Rows with one text are copies of each other: all of it is repeated if it is
    long enough, and one of them stands for it in the rounds. Rows may share a
    doc_id or lack one. Other columns are not looked at.
    """
    docs = _digested(docs)
    kind = "doc_id long, digest binary, n_bytes long, n_words long, names array<long>, starts array<int>, places array<int>"
    first = stored(docs.mapInArrow(_runs(length, short), kind), "runs")
    copies = first.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))
    rows = first.join(copies, "digest")
    # one row stands for each text; the others are copies of it. In the rounds a text goes by 64 bits of its digest
    own = F.col("doc_id").eqNullSafe(F.col("rep"))
    text_id = F.xxhash64("digest").alias("text_id")
    runs = rows.filter((F.col("n_bytes") >= length) & own).select(
        text_id, "rep", "n_bytes", F.explode(F.arrays_zip("names", "starts", "places", F.slice("starts", 2, F.size("starts")).alias("ends"))).alias("r")
    )
    runs = runs.select(
        "text_id", "rep", F.col("r.names").alias("name"), F.col("r.starts").alias("low"), F.col("r.places").alias("places"),
        F.coalesce(F.col("r.ends"), (F.col("n_bytes") - (length - 1)).cast("int")).alias("high"),
    )
    frequent = runs.groupBy("name").agg(F.sum("places").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / RUNS).cast("long").alias("parts")
    active = runs.drop("places").join(frequent, "name").groupBy("text_id", "rep").agg(F.collect_list(F.struct("name", "low", "high", parts)).alias("runs"))
    active = stored(active, "active-runs")
    # the key holds the doc_id, so that copies of one text go to many tasks; the plan is the same at every size
    active, all_texts = active.withColumnRenamed("text_id", "id").hint("merge"), docs.select("doc_id", text_id, "digest", "text")
    texts = all_texts.join(active, (F.col("text_id") == F.col("id")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = stored(texts.drop("id", "rep"), "active-texts")
    dealt = texts.mapInArrow(_starts(length, False), "text_id long, name long, sub long, content long, strings binary, several boolean, texts boolean, parts long")
    dealt = dealt.repartition("name", "sub").sortWithinPartitions("name", "sub")
    hits = dealt.mapInArrow(_repeated(across), "name long, sub long, content long, parts long, hits binary")
    salts = F.least(F.col("parts"), F.lit(SALTS))
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("parts")
    places = texts.mapInArrow(_starts(length, True), "text_id long, name long, sub long, content long, low int, places binary, parts long")
    places = places.withColumn("salt", F.pmod(F.xxhash64("text_id"), salts)).drop("parts")
    found = places.join(hits, ["name", "sub", "content", "salt"]).select("text_id", "low", "places", "hits")
    found = found.mapInArrow(_ranges(length), "text_id long, low int, high int")
    found = found.groupBy("text_id").agg(F.collect_list(F.struct("low", "high")).alias("cut"))
    single = rows.filter("copies = 1").select(text_id)
    found = stored(found.join(single, "text_id", "left_semi"), "cuts")
    cut = texts.drop("runs").join(found.hint("merge"), "text_id").drop("text_id")
    return Repeats(rows.select("doc_id", "digest", "n_bytes", "n_words", "copies"), docs, stored(cut, "cut-texts"), length, words)


def removed(found: Repeats) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and text of every row.

    ``spans`` are the bytes removed as [low, high), ``text`` is what is left; halves of characters
    at a cut go from it too, the hash is that of the bytes.
    """
    none = F.lit(0).cast("long")
    whole = found.documents.filter(found.whole()).select("doc_id", "digest", F.col("n_bytes").alias("n_removed")).distinct()
    whole = whole.withColumns(
        {
            "spans": F.array(F.struct(none.alias("low"), F.col("n_removed").alias("high"))),
            "kept_sha256": F.sha2(F.lit("").cast("binary"), 256),
            "kept_text": F.lit(""),
        }
    )
    changed = found.kept().unionByName(whole).withColumnsRenamed({"doc_id": "id", "digest": "of"})
    # as above, the key holds the doc_id, so that copies of one text go to many tasks
    rows = found.texts.join(changed, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<low: long, high: long>>"))
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", none).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"),
        spans.alias("spans"),
        F.coalesce("kept_text", "text").alias("text"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0, across: bool = False) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; halves of characters at a cut go too.

    A null text stays null. ``n_chars``, if there, is counted anew. ``words`` and ``across`` as in :func:`repeats`.
    """
    found = repeats(docs, length, words=words, across=across)
    left = found.kept().select("digest", "kept_text")
    whole = found.documents.filter(found.whole()).select("digest").distinct()
    changed = left.unionByName(whole.withColumn("kept_text", F.lit("")))
    changed = changed.select(F.col("digest").alias("_text_digest"), F.col("kept_text").alias("_text_kept"))
    keyed = docs.withColumn("_text_digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    same = _among(keyed, changed.select("_text_digest"), "changed-ids", "left_anti").drop("_text_digest")
    count = lambda text: {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    same = same.withColumns(count("text"))
    columns = {"text": F.col("_text_kept")} | count("_text_kept")
    new = keyed.drop("text", "n_chars").join(changed, "_text_digest")
    return same.unionByName(new.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns)))
