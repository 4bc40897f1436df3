"""Multilingual mixture inference.

Each language is a table of log-likelihoods of hashed letter trigrams, counted
from labelled documents. A word's likelihood under a language is the product over
its letters; a document is a mixture of languages with unknown proportions, which
expectation-maximisation estimates over all its words. Of the nested sets of
languages in order of proportion that with the best likelihood, less half a
logarithm of the word count for each language beyond the first, is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import carried, slabs

#: Hashed trigrams a language is described by.
BUCKETS = 1 << 17
#: Labelled documents to learn from, about; taken by a hash of their id.
MAX_TRAIN = 80_000
FULL_ROUNDS, SET_ROUNDS = 12, 5
UNKNOWN = "und"

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the trigram around each letter; the first letter of each word; the words' bounds by text."""
    kind = np.zeros(len(data) + 2, np.int64)
    kind[1:-1] = _CLASS[data]
    letter = kind[1:-1] > 0
    left, right = kind[:-2].copy(), kind[2:].copy()
    edge = offsets[1:-1]
    left[edge[edge < len(data)]] = 0
    right[edge[edge > 0] - 1] = 0
    code = (left * 155 + kind[1:-1]) * 155 + right
    bucket = (code[letter] * 0x9E3779B1 >> 7) & (BUCKETS - 1)
    first = (left == 0)[letter]
    letters = np.concatenate([[0], np.cumsum(letter)])[offsets]
    starts = np.flatnonzero(first)
    return bucket, starts, np.searchsorted(starts, letters)


@dataclass
class Languages:
    """Learned languages and their log-likelihoods by bucket (languages x buckets)."""

    names: list[str]
    table: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for first, end, data, offsets in slabs(batch.column("text")):
            bucket, starts, bounds = trigrams(data, offsets)
            langs = np.array(batch.column("lang").slice(first, end - first).to_pylist(), object)
            letters = np.append(starts, len(bucket))[bounds]
            row = np.repeat(np.arange(end - first), np.diff(letters))
            for lang in set(langs):
                mine = np.bincount(bucket[(langs == lang)[row]], minlength=BUCKETS)
                counts[lang] = counts[lang] + mine if lang in counts else mine
    for lang, got in counts.items():
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at])], ["lang", "bucket", "n"])


def learn(docs: DataFrame, allowed: Column, max_train: int = MAX_TRAIN) -> Languages:
    """Languages from ``text`` and non-null ``lang`` of the ``allowed`` rows; about ``max_train`` of them where there are more."""
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    n = rows.count()
    if n > max_train:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_train / n))
    counted = rows.select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(got["lang"]))
    table = np.zeros((len(names), BUCKETS), np.float64)
    for i, name in enumerate(names):
        mine = got[got["lang"] == name]
        table[i, mine["bucket"].to_numpy()] = mine["n"].to_numpy()
    table = np.log((table + 0.1) / (table.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
    return Languages(names, table.astype(np.float32))


def _estimated(likely: np.ndarray, row: np.ndarray, heads: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions by expectation-maximisation; languages with proportion 0 stay out."""
    for _ in range(rounds):
        part = likely * share[row]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, heads, axis=0) / sizes
    return share


def mixtures(loglik: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """loglik: words x languages; bounds: of the words by text, none empty. Chosen proportions, texts x languages."""
    heads, sizes = bounds[:-1], np.diff(bounds)[:, None].astype(np.float32)
    k = loglik.shape[1]
    if k == 1:
        return np.ones((len(heads), 1), np.float32)
    row = np.repeat(np.arange(len(heads)), np.diff(bounds))
    top = loglik.max(axis=1, keepdims=True)
    likely = np.maximum(np.exp(loglik - top), np.float32(1e-30))
    alone = np.add.reduceat((loglik - top).astype(np.float64), heads, axis=0)
    share = _estimated(likely, row, heads, sizes, np.full((len(heads), k), 1 / k, np.float32), FULL_ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    cost = 0.5 * np.log(np.maximum(sizes[:, 0], 2))
    # the best single language, whatever the proportions say
    best = np.zeros_like(share)
    best[np.arange(len(heads)), np.argmax(alone, axis=1)] = 1
    value = alone.max(axis=1)
    for many in range(2, k + 1):
        mine = share.copy()
        if many < k:
            np.put_along_axis(mine, order[:, many:], 0, axis=1)
        mine = np.maximum(mine, np.where(mine > 0, 1e-6, 0)).astype(np.float32)
        mine /= mine.sum(axis=1, keepdims=True)
        mine = _estimated(likely, row, heads, sizes, mine, SET_ROUNDS) if many < k else mine
        fit = np.add.reduceat(np.log(np.maximum((likely * mine[row]).sum(axis=1), 1e-30)).astype(np.float64), heads)
        better = fit - cost * (many - 1) > value
        value[better] = (fit - cost * (many - 1))[better]
        best[better] = mine[better]
    return best


def _predicted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value["names"], sent.value["table"]
        for batch in batches:
            for first, end, data, offsets in slabs(batch.column("text")):
                bucket, starts, bounds = trigrams(data, offsets)
                full = np.flatnonzero(np.diff(bounds))
                shares = np.zeros((end - first, len(names)), np.float32)
                if len(full) and names:
                    loglik = np.stack([np.add.reduceat(one[bucket], starts) for one in table], axis=1)
                    shares[full] = mixtures(loglik, np.append(bounds[full], bounds[-1]))
                known = batch.column("letters").slice(first, end - first).to_numpy(zero_copy_only=False) & (shares.sum(axis=1) > 0)
                top = shares.argmax(axis=1) if names else np.zeros(end - first, int)
                score = shares.max(axis=1) if names else np.zeros(end - first)
                pred = [names[i] if ok else UNKNOWN for i, ok in zip(top, known, strict=True)]
                used = [{names[i]: float(s[i]) for i in np.flatnonzero(s)} if ok else {} for s, ok in zip(shares, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(first, end - first),
                        pa.array(pred, pa.string()),
                        pa.array(np.clip(np.where(known, score, 0), 0, 1).astype(np.float64)),
                        pa.array([list(u.items()) for u in used], pa.map_(pa.string(), pa.float64())),
                    ],
                    ["row", "lang_pred", "score", "shares"],
                )

    return run


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """The columns of ``docs`` but text, with lang_pred, score (the language's proportion) and shares (all proportions).

    ``und`` with score 0 where text is null or has no letter, or nothing was learned.
    Ties go to the language that sorts first. Only ``text`` is looked at.
    """
    rows = carried(docs.drop("lang_pred", "score", "shares"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shares = T.MapType(T.StringType(), T.DoubleType())
    kind = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", shares)])
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    return rows.mapInArrow(_predicted(sent), kind).select("row.*", "lang_pred", "score", "shares")
