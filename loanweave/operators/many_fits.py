"""Many logistic fits at once: every Newton step of all of them is one aggregate over the rows.

Replicates differ in row weights (bootstrap, folds), in labels (shuffles) or in regularisation.
Weights and labels of a row are computed in its task from a hash of its id, so no row is copied.
A task adds up gradient and curvature of all replicates as matrix products; one row for each
replicate leaves it, Spark sums them, and only replicates x (features + 1)^2 numbers reach the
driver. The number of passes is that of the slowest replicate's steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.session import settle, ship

ROWS = 2048
BINS = 1024
POISSON_ONE = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, k + 1)) for k in range(19)])


def hashes(row_hash: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """(rows, replicates) 64-bit hashes."""
    x = row_hash.view(np.uint64)[:, None] ^ _mix(replicates.astype(np.uint64) + np.uint64(seed * 1_000_003 + 1))[None, :]
    return _mix(x)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(row_hash: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Times each row occurs in each resample: Poisson with mean one."""
    u = (hashes(row_hash, replicates, seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(POISSON_ONE, u.ravel(), "right").reshape(u.shape).astype(np.float64)


@dataclass(frozen=True)
class Fits:
    """coefficients: (fits, features), in units of the fit's own standard deviations, as a fit on
    standardised columns gives them; weights: (fits, features + 1), on the columns as given,
    intercept first."""

    coefficients: np.ndarray
    weights: np.ndarray
    steps: int


def _passes(rows: DataFrame, columns: list[str], work: Callable, width: int) -> np.ndarray:
    """Sums over all rows of what `work` returns for a slice: a (fits, width) matrix."""
    schema = "fit int, " + ", ".join(f"v{i} double" for i in range(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                rest = [part.column(c).to_numpy(zero_copy_only=False) for c in columns]
                out = work(x, *rest)
                total = out if total is None else total + out
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(v) for v in total.T]],
                names=["fit", *[f"v{i}" for i in range(width)]])

    ship(rows.sparkSession)
    sums = rows.select("x", *columns).mapInArrow(run, schema).groupBy("fit").agg(
        *[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)])
    return np.array([r[1:] for r in sorted(sums.collect())], np.float64)


def fit_many(
    rows: DataFrame, columns: list[str], draw: Callable, strengths: np.ndarray, most_steps: int = 30,
    tolerance: float = 1e-9,
) -> Fits:
    """Penalised logistic fits, one for each entry of `strengths` (inverse regularisation).

    rows: x (array of doubles without NULLs) and `columns`; draw(*columns as arrays) gives weights
    and labels, (rows, fits) each. The penalty is that of a fit on columns standardised with the
    fit's own weights; the intercept has none.
    """
    fits = len(strengths)

    def moments(x, *rest):
        w, _ = draw(*rest)
        return np.concatenate([w.sum(axis=0)[:, None], w.T @ x, w.T @ (x * x), (w > 0).sum(axis=0)[:, None]], axis=1)

    first = rows.select(F.size("x")).first()
    if first is None:
        return Fits(np.zeros((fits, 0)), np.zeros((fits, 0)), 0)
    d = first[0]
    m = _passes(rows, columns, moments, 2 * d + 2)
    total = m[:, :1]
    mean = m[:, 1:d + 1] / total
    var = np.maximum(m[:, d + 1:2 * d + 1] - total * mean**2, 0) / np.maximum(total - 1, 1)
    sd = np.sqrt(var)
    beta = np.zeros((fits, d + 1))
    penalty = np.concatenate([np.zeros((fits, 1)), sd**2], axis=1) / strengths[:, None]
    upper = np.triu_indices(d + 1)
    for step in range(1, most_steps + 1):
        current = beta.copy()

        def slopes(x, *rest):
            w, y = draw(*rest)
            lifted = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            p = 1 / (1 + np.exp(-np.clip(lifted @ current.T, -500, 500)))
            curve = w * p * (1 - p)
            products = lifted[:, upper[0]] * lifted[:, upper[1]]
            return np.concatenate([(w * (p - y)).T @ lifted, curve.T @ products], axis=1)

        s = _passes(rows, columns, slopes, d + 1 + len(upper[0]))
        gradient = s[:, :d + 1] + penalty * beta
        hessian = np.zeros((fits, d + 1, d + 1))
        hessian[:, upper[0], upper[1]] = s[:, d + 1:]
        hessian[:, upper[1], upper[0]] = s[:, d + 1:]
        hessian[:, np.arange(d + 1), np.arange(d + 1)] += penalty + 1e-12
        move = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        # A long step would leave the region where the curvature holds.
        move *= np.minimum(1, 8 / np.maximum(np.abs(move).max(axis=1, keepdims=True), 1e-300))
        beta -= move
        if np.abs(move).max() < tolerance:
            break
    return Fits(beta[:, 1:] * sd, beta, step)


def label_cuts(rows: DataFrame, positives: int, fits: int, seed: int) -> np.ndarray:
    """For each shuffle the hash that exactly `positives` rows do not exceed.

    Found by refining histograms of the hashes, all shuffles at once; nothing is sorted and only
    the histograms reach the driver. Rows with equal hashes (repeated ids) cannot be told apart.
    """
    low = np.zeros(fits, object)
    low[:] = 0
    rest = np.full(fits, positives, np.int64)
    bits, numbers = 64, np.arange(fits)
    while bits > 0:
        shift = max(bits - 10, 0)
        start = low.astype(object)

        def count(x, h):
            out = np.zeros((fits, BINS + 1))
            values = hashes(h, numbers, seed)
            for r in range(fits):
                v = values[:, r]
                near = v[(v >= np.uint64(start[r])) & (v <= np.uint64(start[r] + (1 << bits) - 1))]
                out[r, :BINS] = np.bincount(((near - np.uint64(start[r])) >> np.uint64(shift)).astype(np.int64),
                                            minlength=BINS)
            return out

        n = _passes(rows, ["h"], count, BINS + 1)[:, :BINS].astype(np.int64)
        upto = n.cumsum(axis=1)
        at = np.array([int(np.searchsorted(upto[r], rest[r], "left")) for r in range(fits)])
        rest = rest - np.array([upto[r, a - 1] if a else 0 for r, a in enumerate(at)])
        low = np.array([int(start[r]) + (int(a) << shift) for r, a in enumerate(at)], object)
        inside = n[numbers, at]
        bits = shift
        if (inside == rest).all():  # all rows of the bin belong to the positives
            break
    return np.array([min(int(x) + (1 << bits) - 1, 2**64 - 1) for x in low], np.uint64)


def prepared(df: DataFrame, ident: str, label: str) -> DataFrame:
    """x, h (hash of the id), y and the id of rows with an assembled vector `features`, stored."""
    from pyspark.ml.functions import vector_to_array

    return settle(df.select(
        vector_to_array("features").alias("x"), F.xxhash64(ident).alias("h"),
        F.col(label).cast("double").alias("y"), F.col(ident).alias("id")))
