"""Ordinal cumulative-link regression on graded ratings.

P(grade <= g) is a logistic curve of threshold g minus a weighted sum of features.
The weights are shared by all grades, the thresholds are kept in order. Features
are hashed: byte trigrams of the lower-cased text, and words that repeat the one
before, by the square root of their share. Expected grade and the probability of
a grade or better select documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import carried, slabs, stored
from tickloom.llm.minhash import _LOWER, words

#: Hashed trigrams; after them come the features of repeated words and of length.
BUCKETS = 1 << 11
#: Rated documents to learn from, at most; taken by a hash of their id.
MAX_TRAIN = 12_000
HOLD = 1e-3


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of a slab of texts: a row of features for each."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS + 3), np.float32)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    if len(data) > 2:
        low = _LOWER[data].astype(np.int64)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        inside = row[:-2] == row[2:]
        code, at = code[inside], row[:-2][inside]
        bucket = (code * 0x9E3779B1 >> 9) & (BUCKETS - 1)
        counts = np.bincount(at * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, :BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    found, bounds = words(data, offsets)
    many = np.diff(bounds)
    of = np.repeat(np.arange(n), many)
    again = np.zeros(len(found), bool)
    again[1:] = (found[1:] == found[:-1]) & (of[1:] == of[:-1])
    out[:, BUCKETS] = np.sqrt(np.bincount(of, again, n) / np.maximum(many, 1))
    out[:, BUCKETS + 1] = np.log1p(many) / 10
    order = np.lexsort((found, of))
    new = np.ones(len(found), bool)
    new[1:] = (found[order][1:] != found[order][:-1]) | (of[order][1:] != of[order][:-1])
    out[:, BUCKETS + 2] = np.bincount(of[order], new, n) / np.maximum(many, 1)
    return out


@dataclass
class Grades:
    """grades in order; weights shared by all; a threshold between each grade and the next."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, x: np.ndarray) -> np.ndarray:
        """P(grade <= g) for each grade but the last."""
        return _logistic(self.thresholds[None, :] - (x @ self.weights)[:, None])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(p: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood and its gradient; p: weights, first threshold, logarithms of the steps."""
    w, first, steps = p[:-k], p[-k], np.exp(np.clip(p[len(p) - k + 1 :], -10, 10))
    theta = first + np.concatenate([[0], np.cumsum(steps)])
    z = x @ w
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    high, low = _logistic(edge[y + 1] - z), _logistic(edge[y] - z)
    chance = np.maximum(high - low, 1e-12)
    dh, dl = high * (1 - high), low * (1 - low)
    n = len(y)
    loss = -np.log(chance).mean() + 0.5 * HOLD * float(w @ w)
    grad_w = x.T @ ((dh - dl) / chance) / n + HOLD * w
    grad_t = -(np.bincount(y, dh / chance, k + 1)[:k] - np.bincount(y, dl / chance, k + 1)[1:]) / n
    tail = np.cumsum(grad_t[::-1])[::-1]
    return loss, np.concatenate([grad_w, [tail[0]], tail[1:] * steps])


def fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and k thresholds for grades 0..k by a limited-memory quasi-Newton descent."""
    share = np.cumsum(np.bincount(y, minlength=k + 1) + 0.5)[:k] / (len(y) + 0.5 * (k + 1))
    theta = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(x.shape[1]), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    loss, grad = _loss(p, x, y, k)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = -grad, []
        for s, d in reversed(past):
            a = (s @ way) / (s @ d)
            kept.append(a)
            way = way - a * d
        if past:
            s, d = past[-1]
            way = way * ((s @ d) / (d @ d))
        for (s, d), a in zip(past, reversed(kept), strict=True):
            way = way + s * (a - (d @ way) / (s @ d))
        step, slope = 1.0, float(grad @ way)
        if slope >= 0:
            way, slope, past = -grad, -float(grad @ grad), []
        while step > 1e-10:
            after, fresh = _loss(p + step * way, x, y, k)
            if after <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = step * way, fresh - grad
        gain = loss - after
        p, loss, grad = p + s, after, fresh
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d)]
        if gain < 1e-7:
            break
    steps = np.exp(np.clip(p[len(p) - k + 1 :], -10, 10))
    return p[:-k], p[-k] + np.concatenate([[0], np.cumsum(steps)])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slabs(batch.column("text")):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade").slice(first, end - first), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["grade", "x"]
            )


def learn(docs: DataFrame, ratings: DataFrame, allowed: Column, max_train: int = MAX_TRAIN) -> Grades:
    """Grades from the documents of ``ratings`` (doc_id, grade) that are ``allowed`` (a condition on doc_id).

    Any number of integer grades; null ones don't count, of several for a document the
    greatest does. At most ``max_train`` documents are learned from, taken by a hash of their
    id. With fewer than two grades everything gets the one there is, or 0.
    """
    rated = ratings.filter(allowed & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("grade", "text")
    got = stored(sample.mapInArrow(_described, "grade int, x binary"), "rated").toArrow()
    grades = sorted(set(got["grade"].to_pylist()))
    size = BUCKETS + 3
    if len(grades) < 2:
        return Grades(grades or [0], np.zeros(size), np.empty(0))
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, size).astype(np.float32)
    y = np.searchsorted(grades, got["grade"].to_numpy())
    weights, thresholds = fit(x, y, len(grades) - 1)
    return Grades(grades, weights, thresholds)


def _graded(sent, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Grades(**sent.value)
        grades = np.array(model.grades, float)
        for batch in batches:
            for first, end, data, offsets in slabs(batch.column("text")):
                at_most = model.at_most(features(data, offsets).astype(np.float64)) if len(model.thresholds) else np.empty((end - first, 0))
                edges = np.concatenate([np.zeros((end - first, 1)), at_most, np.ones((end - first, 1))], axis=1)
                below = int((grades < least).sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, end - first), pa.array(np.diff(edges, axis=1) @ grades), pa.array(1 - edges[:, below])],
                    ["row", "expected_grade", "tail"],
                )

    return run


def grade(docs: DataFrame, model: Grades, least: int = 1) -> DataFrame:
    """The columns of ``docs`` but text, with expected_grade, tail (probability of grade ``least`` or better) and kept (tail >= 0.5).

    Only ``text`` is looked at; a null one is graded as an empty one.
    """
    rows = carried(docs.drop("expected_grade", "tail", "kept"))
    kind = T.StructType([rows.schema["row"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    out = rows.mapInArrow(_graded(sent, least), kind)
    return out.select("row.*", "expected_grade", "tail", (F.col("tail") >= 0.5).alias("kept"))
