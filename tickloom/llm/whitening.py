"""Whitening of vectors by an incremental eigendecomposition.

A task keeps the spectrum of what it has seen: number, exact sums, eigenvalues and eigenvectors of the
centred scatter. Each vector changes it by a rank-one update: its distance from the mean so far, in the
basis of the eigenvectors, gives a secular equation whose roots are the new eigenvalues; what the vector does
not touch, and all but one of equal eigenvalues, is deflated before. (A block of vectors is first folded by QR to as
many rows as there are dimensions, with the same scatter; each of these is an update.) Spectra of tasks are merged, a
few at a time, by as many rank-one updates as one of them has eigenvectors and one for the distance of their means. The
merged basis is refined over all rows: the covariance projected on it is summed by tasks, and its eigenvectors (Rayleigh
and Ritz) turn the basis to the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored

#: Vectors folded into one block; spectra merged by one task.
BLOCK, FAN_IN = 1024, 16
_EPS = np.finfo(float).eps


def _deflated(values: np.ndarray, basis: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Basis turned so that of equal eigenvalues only the last meets z; and which eigenpairs an update changes."""
    tiny = 8 * _EPS * max(values[-1] - min(values[0], 0.0), float(z @ z))
    z, basis = z.copy(), basis.copy()
    kept = -1
    for i in range(len(values)):
        if abs(z[i]) * np.sqrt(z @ z) <= tiny:
            z[i] = 0.0
            continue
        if kept >= 0 and values[i] - values[kept] <= tiny:
            length = np.hypot(z[kept], z[i])
            c, s = z[i] / length, z[kept] / length
            basis[:, [kept, i]] = basis[:, [kept, i]] @ np.array([[c, s], [-s, c]])
            z[kept], z[i] = 0.0, length
        kept = i
    return z, basis, np.flatnonzero(z)


def secular_roots(d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """d[i] - root[j] for all i and j: the roots of 1 + sum z² / (d - x) = 0, d rising, z nowhere 0.

    Root j lies between d[j] and d[j + 1], the last below d[-1] + z·z. Each is sought as a distance from the nearer
    end, by the rational step that fits both neighbouring poles, within a bracket that halves where a step leaves it.
    """
    n = len(d)
    z2 = z * z
    right = np.append(d[1:], d[-1] + z2.sum())
    width = right - d
    at_middle = 1 + (z2[:, None] / (d[:, None] - (d + width / 2)[None, :])).sum(axis=0)
    near_left = at_middle >= 0
    near_left[-1] = True
    origin = np.where(near_left, d, right)
    gaps = d[:, None] - origin[None, :]
    low = np.where(near_left, 0.0, -width / 2)
    high = np.where(near_left, np.where(np.arange(n) == n - 1, width, width / 2), 0.0)
    x = (low + high) / 2
    below = np.tri(n, dtype=bool).T
    pole_left, pole_right = d - origin, right - origin
    for _ in range(100):
        near = gaps - x
        terms = z2[:, None] / near
        slopes = terms / near
        psi, phi = np.where(below, terms, 0.0).sum(axis=0), np.where(below, 0.0, terms).sum(axis=0)
        f = 1 + psi + phi
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        d_psi, d_phi = np.where(below, slopes, 0.0).sum(axis=0), np.where(below, 0.0, slopes).sum(axis=0)
        # psi as r + s / (left - x), phi as r + s / (right - x), with the values and slopes at x
        to_left, to_right = pole_left - x, pole_right - x
        s1, s2 = d_psi * to_left**2, d_phi * to_right**2
        c = 1 + (psi - d_psi * to_left) + (phi - d_phi * to_right)
        a = c * (to_left + to_right) + s1 + s2
        b = c * to_left * to_right + s1 * to_right + s2 * to_left
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        ok = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(ok, new, (low + high) / 2)
        still = (np.abs(f) > 4 * _EPS * n * (1 + np.abs(psi) + np.abs(phi))) & (high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if not still.any():
            break
        x = np.where(still, new, x)
    return gaps - x


def updated(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of basis · values · basisᵀ + v vᵀ."""
    z, turned, active = _deflated(values, basis, basis.T @ v)
    if not len(active):
        return values, basis
    d = values[active]
    gaps = secular_roots(d, z[active])
    # the vector for which these roots are exact, so that the new eigenvectors are orthogonal
    n = len(d)
    between = d[None, :] - d[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = np.empty((n, n))
    ratio[:] = -gaps
    off = ratio.copy()
    np.fill_diagonal(off, 1.0)
    exact = np.sqrt(np.abs(np.diag(ratio) * np.prod(off / between, axis=1)))
    vectors = np.copysign(exact, z[active])[:, None] / gaps
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    # each root from the pole it was found by loses least
    roots = d - np.diag(gaps)
    values, turned = values.copy(), turned.copy()
    values[active], turned[:, active] = roots, turned[:, active] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], turned[:, order]


class Spectrum:
    """Number, exact sums, and eigenpairs of the centred scatter of some vectors of whole numbers."""

    def __init__(self, dimensions: int):
        self.n, self.sums = 0, [0] * dimensions
        self.values, self.basis = np.zeros(dimensions), np.eye(dimensions)

    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    def _moved(self, n: int, sums: list[int]) -> None:
        """Take in the distance between the mean so far and that of ``n`` vectors with ``sums``."""
        if self.n and n:
            # exact before the division: means are large, distances small
            apart = np.array([(b * self.n - a * n) / (self.n * n) for a, b in zip(self.sums, sums, strict=True)])
            self.values, self.basis = updated(self.values, self.basis, apart * np.sqrt(self.n * n / (self.n + n)))
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def add(self, block: np.ndarray) -> None:
        """Take in rows of whole numbers."""
        sums = [int(s) for s in block.sum(axis=0)]
        if len(block) > 1:
            rows = block - np.array([s / len(block) for s in sums])
            for row in np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows:
                self.values, self.basis = updated(self.values, self.basis, row)
        self._moved(len(block), sums)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = updated(self.values, self.basis, np.sqrt(value) * vector)
        self._moved(other.n, other.sums)
        # rounding leaves the basis a little askew after many updates
        self.basis = np.linalg.qr(self.basis)[0]


_SPECTRUM = "part long, n long, sums array<decimal(38,0)>, scatter binary, basis binary"


def _rows_of(column: pa.Array) -> np.ndarray:
    """Lists without nulls, all of one length, as a matrix."""
    if not len(column):
        return np.empty((0, 0), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]))


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = None
    for batch in batches:
        rows = _rows_of(batch.column("x"))
        if not len(rows):
            continue
        found = found or Spectrum(rows.shape[1])
        if rows.shape[1] != len(found.sums):
            raise ValueError("vectors differ in length")
        for first in range(0, len(rows), BLOCK):
            found.add(rows[first : first + BLOCK])
    if found is not None:
        yield pa.RecordBatch.from_pandas(_as_frame(TaskContext.get().partitionId(), found), pa.schema(_ARROW))


_ARROW = [
    ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("scatter", pa.binary()), ("basis", pa.binary()),
]


def _as_frame(part: int, s: Spectrum) -> pd.DataFrame:
    from decimal import Decimal

    row = (part, s.n, [Decimal(x) for x in s.sums], s.values.tobytes(), s.basis.tobytes())
    return pd.DataFrame([row], columns=[name for name, _ in _ARROW])


def _as_spectrum(row) -> Spectrum:
    s = Spectrum(len(row["sums"]))
    s.n, s.sums = int(row["n"]), [int(x) for x in row["sums"]]
    s.values = np.frombuffer(row["scatter"]).copy()
    s.basis = np.frombuffer(row["basis"]).reshape(len(s.sums), -1).copy()
    return s


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    first, *others = (_as_spectrum(row) for _, row in rows.iterrows())
    for other in others:
        if len(other.sums) != len(first.sums):
            raise ValueError("vectors differ in length")
        first.merge(other)
    return _as_frame(int(key[0]), first)


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(m) for m in rows.sort_values("part")["m"])
    return pd.DataFrame({"part": [int(key[0])], "m": [total.tobytes()]})


def _gathered(rows: DataFrame, merge: Callable, kind: str, name: str) -> DataFrame:
    """One row out of one for each task, ``FAN_IN`` at a time; every round is a written table."""
    rows = stored(rows, name)
    while rows.count() > 1:
        # tasks without rows leave holes in the numbers; every round they are FAN_IN times fewer
        by = F.floor(F.col("part") / FAN_IN).cast("long").alias("to")
        rows = stored(rows.groupBy(by).applyInPandas(merge, kind), name)
    return rows


@dataclass
class Whitening:
    """What a fit found; ``vectors`` has a column for each component, by falling ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    def white(self, rows: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        return (rows - self.mean()) @ self.vectors[:, :k] / np.sqrt(self.values[:k])

    def deviations(self, rows: np.ndarray) -> list[int]:
        """sum of (n x - S)² of each row, exactly."""
        far = max(float(np.abs(rows - self.mean()).max(initial=0.0)) * self.n + 1, 1.0)
        if far * far * max(len(self.sums), 1) < 2.0**62 and float(np.abs(rows).max(initial=0)) * self.n < 2.0**62:
            away = rows * np.int64(self.n) - np.array(self.sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        return [sum((int(x) * self.n - s) ** 2 for x, s in zip(row, self.sums, strict=True)) for row in rows]


def _squares(model: Whitening, of: Callable[[np.ndarray], np.ndarray]):
    """Sums of outer products, and of the rows themselves, of what ``of`` makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = of(_rows_of(batch.column("x")))
                mine = np.vstack([y.T @ y, y.sum(axis=0)])
                total = mine if total is None else total + mine
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    return run


def _covariance(vectors: DataFrame, model: Whitening, of: Callable[[np.ndarray], np.ndarray], size: int, name: str) -> np.ndarray:
    """Covariance over all rows of what ``of`` makes of them, centred before it is multiplied."""
    kind = "part long, m binary"
    row = _gathered(vectors.select("x").mapInArrow(_squares(model, of), kind), _added, kind, name).first()
    total = np.frombuffer(row["m"]).reshape(size + 1, size)
    rest = total[size] / model.n
    return total[:size] / model.n - np.outer(rest, rest)


def fit(vectors: DataFrame) -> Whitening:
    """Components of ``vectors`` (x, a list of whole numbers, none null and all of one length).

    What comes to the driver is one spectrum: the square of the number of dimensions. Directions in
    which nothing varies are no components.
    """
    rows = _gathered(vectors.select("x").mapInArrow(_spectra, _SPECTRUM), _merged, _SPECTRUM, "spectra")
    row = rows.first()
    if row is None:
        return Whitening(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    found = _as_spectrum(row)
    basis = np.linalg.qr(found.basis)[0]
    model = Whitening(found.n, found.sums, np.empty(0), np.empty((0, 0)), 0.0)
    if not len(found.sums):
        return model
    mean = model.mean()
    projected = _covariance(vectors, model, lambda x: (x - mean) @ basis, len(mean), "projected")
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    kept = values > max(values[0], 0.0) * len(values) * 16 * _EPS
    return Whitening(found.n, found.sums, values[kept], (basis @ turn)[:, kept], float(np.trace(projected)))


def identity_error(vectors: DataFrame, model: Whitening, components: int) -> float:
    """The largest distance of an entry of the whitened rows' covariance from the identity."""
    k = min(components, len(model.values))
    if not k:
        return 0.0
    return float(np.abs(_covariance(vectors, model, lambda x: model.white(x, k), k, "whitened") - np.eye(k)).max())


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(model: Whitening, k: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                rows = _rows_of(part.column("x"))
                white, m = model.white(rows, k), len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array([d for d in model.deviations(rows) for _ in range(k)], pa.int64()),
                        pa.array(white.ravel()),
                        pa.array(np.tile(model.values[:k] / model.trace, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    [c.split()[0] for c in _WHITE.split(", ")],
                )

    return run


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null where the vector is null, empty, or holds null or what is not finite."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    numbers = F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + F.lit(1_000_000).cast("long"))
    return F.when((F.size(vector) > 0) & F.forall(vector, sound), numbers)


def whiten(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of ``embeddings`` (vec_id, embedding).

    Vectors that are null, empty, or hold null or non-finite entries are dropped; the others count once for each
    row, and must have one length. Components in which nothing varies, as of a single vector, don't exist. Rows may
    share a vec_id or lack one; other columns are not looked at.
    """
    numbers = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("x"))
    rows = stored(numbers.filter("x IS NOT NULL"), "whole-numbers")
    model = fit(rows)
    k = min(components, len(model.values))
    if not k:
        return rows.sparkSession.createDataFrame([], _WHITE)
    return rows.mapInArrow(_whitened(model, k, identity_error(rows, model, components)), _WHITE)
