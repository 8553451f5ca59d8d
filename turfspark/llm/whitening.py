"""Whitening of embeddings by incremental eigendecomposition.

A spectrum is (n, mean, values, vectors): the eigendecomposition of the scatter of n vectors about their mean.

* A partition folds its vectors in by centred rank-one updates. The rows of a block are turned into at most d rows
  of equal scatter (a QR factor) first, so a block takes d + 1 updates, the last one for the shift of the mean.
* An update of D + r z z' deflates components that z doesn't touch and, by rotations, values that are nearly equal;
  it finds the others as roots of the secular equation, each measured from its nearest pole, and forms vectors from
  the z that these roots belong to exactly, which keeps them orthogonal.
* Spectra are combined 32 at a time: each value and vector of one is a rank-one update of the other, then the shift
  of the mean. The driver gets the last one only: d values and d vectors, whatever the number of rows.
* A pass over all rows projects them, centred, on these vectors; the eigenvectors of the projections' covariance
  rotate them (Rayleigh-Ritz). A last pass measures the covariance of the whitened values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
BLOCK = 16_384  # rows turned into d rows at once
FAN = 32  # spectra combined by one task
EPS = np.finfo(float).eps

Spectrum = tuple[int, np.ndarray, np.ndarray, np.ndarray]

_SUMMARY = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"
_MOMENT = "part long, n long, moment array<double>"
_OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def _roots(d: np.ndarray, z: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + r sum z_i^2 / (d_i - m) = 0, as (index of the nearest pole, distance from it)."""
    k, w = d.size, r * z * z
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    middle = 1 + (w / ((d[None, :] - d[:, None]) - gap[:, None] / 2)).sum(axis=1)
    left = middle >= 0
    left[-1] = True  # the last root has one pole
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    away = d[None, :] - d[pole][:, None]
    for _ in range(200):
        guess = (low + high) / 2
        with np.errstate(divide="ignore", over="ignore"):
            rising = 1 + (w / (away - guess[:, None])).sum(axis=1) < 0
        low, high = np.where(rising, guess, low), np.where(rising, high, guess)
        if (high - low <= 2 * EPS * np.minimum(np.abs(low), np.abs(high))).all():
            break
    guess = (low + high) / 2
    return pole, np.where(guess == 0, np.where(left, high, low), guess)


def update(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of U diag(values) U' + row row', values rising; both orthonormal to rounding."""
    z = vectors.T @ row
    r = float(z @ z)
    if r == 0 or not np.isfinite(r):
        return values, vectors
    z, vectors, values = z / np.sqrt(r), vectors.copy(), values.copy()
    scale = max(abs(values[-1]), r)
    touched = r * np.abs(z) > 8 * EPS * scale
    z[~touched] = 0
    last = -1
    for i in np.flatnonzero(touched):
        # nearly equal values: turn the two vectors so that one is not touched
        if last >= 0 and (values[i] - values[last]) * abs(z[i] * z[last]) <= 8 * EPS * scale * (z[i] ** 2 + z[last] ** 2):
            size = np.hypot(z[i], z[last])
            c, s = z[i] / size, z[last] / size
            vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[c, s], [-s, c]])
            values[last], values[i] = (
                c * c * values[last] + s * s * values[i],
                s * s * values[last] + c * c * values[i],
            )
            z[last], z[i] = 0.0, size
            touched[last] = False
        last = i
    at = np.flatnonzero(touched)
    if at.size:
        at = at[np.argsort(values[at], kind="stable")]
        d = values[at]
        pole, distance = _roots(d, z[at], r)
        # d_i - root_j without cancellation
        apart = (d[:, None] - d[pole][None, :]) - distance[None, :]
        between = d[:, None] - d[None, :]
        np.fill_diagonal(between, 1.0)
        ratio = apart / between
        np.fill_diagonal(ratio, np.diag(apart))
        exact = np.sqrt(np.abs(ratio.prod(axis=1))) * np.where(z[at] < 0, -1.0, 1.0)
        turned = exact[:, None] / apart
        vectors[:, at] = vectors[:, at] @ (turned / np.linalg.norm(turned, axis=0))
        values[at] = d[pole] + distance
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def combined(one: Spectrum | None, other: Spectrum) -> Spectrum:
    """The spectrum of both, by a rank-one update per component of `other` and one for the means."""
    if one is None:
        return other
    n, mean, values, vectors = one
    m, there, more, directions = other
    for value, direction in zip(more, directions.T, strict=True):
        if value > 0:
            values, vectors = update(values, vectors, np.sqrt(value) * direction)
    shift = there - mean
    values, vectors = update(values, vectors, np.sqrt(n * (m / (n + m))) * shift)
    return n + m, mean + shift * (m / (n + m)), values, vectors


def _block(x: np.ndarray) -> Spectrum:
    """Spectrum of a block of rows: its d rows of equal scatter, folded in one by one."""
    mean = x.mean(axis=0)
    rows = np.linalg.qr(x - mean, mode="r")
    values, vectors = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for row in rows:
        values, vectors = update(values, vectors, row)
    return len(x), mean, values, vectors


def _entries(column: pa.Array) -> np.ndarray:
    """Rows of a list column as whole numbers: floor(64 c) + 1000000."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if sizes.size > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()[:5]}")
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    whole = np.floor(c * SCALE) + SHIFT
    if np.abs(whole).max(initial=0) >= 2**52:
        raise OverflowError("an entry is too large to be a whole number exactly")
    return whole.astype(np.int64)


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False)))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    whole, sums = None, None
    for batch in batches:
        x = _entries(batch.column(1))
        for k in range(0, len(x), BLOCK):
            part = x[k : k + BLOCK]
            if sums is not None and sums.size != part.shape[1]:
                raise ValueError(f"vectors of different lengths: {sums.size}, {part.shape[1]}")
            sums = part.sum(axis=0) + (0 if sums is None else sums)
            # the whole-number shift keeps digits; it is added to the mean again below
            whole = combined(whole, _block((part - SHIFT).astype(np.float64)))
    if whole is not None:
        yield _row(TaskContext.get().partitionId(), whole, sums)


def _row(part: int, spectrum: Spectrum, sums: np.ndarray) -> pd.DataFrame:
    n, mean, values, vectors = spectrum
    return pd.DataFrame(
        {"part": [part], "n": [n], "sums": [sums], "mean": [mean], "values": [values], "vectors": [vectors.ravel()]}
    )


def _spectra(group: pd.DataFrame) -> pd.DataFrame:
    whole, sums = None, 0
    group = group.sort_values("part")
    if group["values"].map(len).nunique() > 1:
        raise ValueError("vectors of different lengths")
    for row in group.itertuples():
        d = len(row.values)
        vectors = np.asarray(row.vectors, float).reshape(d, d)
        whole = combined(whole, (int(row.n), np.asarray(row.mean, float), np.asarray(row.values, float), vectors))
        sums = sums + np.asarray(row.sums, np.int64)
    return _row(int(group["part"].iloc[0]) // FAN, whole, sums)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    moment = np.sum([np.asarray(m, float) for m in group.sort_values("part")["moment"]], axis=0)
    return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "n": [int(group["n"].sum())], "moment": [moment]})


def _in_rounds(parts: DataFrame, count: int, schema: str, together: Callable[[pd.DataFrame], pd.DataFrame]) -> list:
    """One row of all parts, FAN at a time."""
    while True:
        parts = parts.groupBy((F.col("part") / FAN).cast("long").alias("next")).applyInPandas(together, schema)
        count = -(-count // FAN)
        if count <= 1:
            return parts.collect()  # one row of d * d numbers


def _moment(rows: DataFrame, basis: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Covariance of (x - S/n) on the columns of `basis`: the mean of the products, mean values removed."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, count = 0.0, 0.0, 0
        for batch in batches:
            y = _centred(_entries(batch.column(1)), sums, n) @ basis
            total, first, count = total + y.T @ y, first + y.sum(axis=0), count + len(y)
        if count:
            flat = np.concatenate([total.ravel(), first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int64()),
                    pa.array([count], pa.int64()),
                    pa.array([flat], pa.list_(pa.float64())),
                ],
                names=["part", "n", "moment"],
            )

    parts = rows.mapInArrow(products, _MOMENT)
    (found,) = _in_rounds(parts, rows.rdd.getNumPartitions(), _MOMENT, _added)
    k = basis.shape[1]
    flat = np.asarray(found.moment)
    first = flat[k * k :] / n
    return flat[: k * k].reshape(k, k) / n - np.outer(first, first)


def _centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken away in whole numbers."""
    return (x - sums // n).astype(np.float64) - (sums % n) / n


def _deviation(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact; an error where a long can't hold it."""
    whole, rest = x - sums // n, sums % n
    if x.shape[1] * (n * (int(np.abs(whole).max(initial=0)) + 1)) ** 2 >= 2**63:
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in whole.tolist()]
        if max(exact) >= 2**63:
            raise OverflowError("the deviation of a vector doesn't fit a long")
        return np.array(exact, np.int64)
    return ((n * whole - rest) ** 2).sum(axis=1)


def fitted(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """(n, sums, eigenvalues falling, eigenvectors as columns) of the covariance of all rows; None if there are none."""
    count = rows.rdd.getNumPartitions()
    as_pandas = rows.mapInArrow(_as_batches(_summaries), _SUMMARY)
    found = _in_rounds(as_pandas, max(count, 1), _SUMMARY, _spectra)
    if not found:
        return None
    n, sums = int(found[0].n), np.asarray(found[0].sums, np.int64)
    d = sums.size
    basis = np.linalg.qr(np.asarray(found[0].vectors).reshape(d, d))[0]
    values, turn = np.linalg.eigh(_moment(rows, basis, sums, n))
    order = np.argsort(-values, kind="stable")
    return n, sums, np.maximum(values[order], 0.0), basis @ turn[:, order]


def _as_batches(function):
    """A function from Arrow batches to pandas frames as one from batches to batches."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in function(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return batches_of


def whitened(df: DataFrame, vec_id: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened vectors: (vec_id, component, n, deviation, whitened, explained, identity_error), a row per component.

    Vectors that are null, empty or hold a null or non-finite entry are left out. Entries are the whole numbers
    floor(64 c) + 1000000. `deviation` is the sum of (n x - S)^2 and exact; where a long can't hold it, the job
    fails. A component without variance (below rounding of the first) has a null `whitened` and doesn't count
    in `identity_error`. Fewer dimensions than `components` give fewer rows. Equal eigenvalues (ties) have any
    orthonormal vectors, the same for all rows. Null or repeated ids and repeated rows are kept, each with its
    own rows. Vectors of different lengths are an error. An empty table gives no rows; very long vectors cost
    d^2 memory and d^3 time per block. Only the two named columns are read.
    """
    rows = usable(df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("x")), "x")
    model = fitted(rows)
    if model is None:
        return df.sparkSession.createDataFrame([], _OUT)
    n, sums, values, vectors = model
    k = min(components, values.size)
    flat = values[:k] <= 64 * EPS * values[0] if values[0] > 0 else np.ones(k, bool)
    basis = vectors[:, :k] / np.sqrt(np.where(flat, 1.0, values[:k]))
    explained = values[:k] / values.sum() if values.sum() > 0 else np.zeros(k)
    error = 0.0
    if not flat.all():
        covariance = _moment(rows, basis[:, ~flat], sums, n)
        error = float(np.abs(covariance - np.eye(len(covariance))).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = _entries(part.column(1))
                y = _centred(x, sums, n) @ basis
                m = len(x)
                out = [
                    pa.array(np.repeat(np.arange(m), k)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(_deviation(x, sums, n), k)),
                    pa.array(y.ravel(), mask=np.tile(flat, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                out[0] = part.column(0).take(out[0])
                yield pa.RecordBatch.from_arrays(
                    out, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                )

    return rows.mapInArrow(projected, _OUT)
