"""Centroid clustering of integer vectors on bit planes.

A vector of 64 integers is kept as its bit planes in two's complement: plane i holds bit i of all
64 components in one uint64. With plane weights w (2^i, the top one negative) the dot product of
two vectors is the sum over plane pairs of w_i w_j popcount(x_i AND c_j), and the squared
distance is |x|^2 + |c|^2 - 2 x.c: integers throughout, so nothing is rounded and the result does
not depend on how rows are dealt out.

The planes are stored once (8 bytes a plane for each vector, about a third of the floats). Each
round is one pass that has no shuffle of vectors: a task assigns its vectors, counts the set
bits of each plane and cluster, and hands over k rows of 64 sums. Only k centroids reach the
driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.store import ship, stored

DIMS = 64
MOST_PLANES = 28  # beyond it a squared distance may not fit a 64-bit integer
ROWS = 4096
OUT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
       "centroid_sha256 string")


def weights(planes: int) -> np.ndarray:
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(planes, n) words of the (n, 64) integers."""
    out = np.empty((planes, len(values)), np.uint64)
    for i in range(planes):
        bits = ((values >> i) & 1).astype(np.uint8)
        out[i] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def plane_bits(words: np.ndarray) -> np.ndarray:
    """(n, 64) bits of the n words of one plane."""
    raw = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, k) exact dot products of vectors and centroids, both given as planes."""
    planes = len(x)
    top = planes - 1
    out = np.zeros((x.shape[1], c.shape[1]), np.int64)
    for s in range(2 * planes - 1):
        part = np.zeros(out.shape, np.int16)  # at most 64 x planes of one weight 2^s
        for i in range(max(0, s - top), min(planes, s + 1)):
            common = np.bitwise_count(x[i][:, None] & c[s - i][None, :])
            if (i == top) != (s - i == top):
                part -= common
            else:
                part += common
        out += part.astype(np.int64) << s
    return out


def nearest(x: np.ndarray, norms: np.ndarray, c: np.ndarray, c_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller one) and the squared distance."""
    far = norms[:, None] + c_norms[None, :] - 2 * dots(x, c)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


class Centroids:
    """Integer centroids with their planes; small, and sent to every task."""

    def __init__(self, rows: list[list[int]], planes: int):
        self.rows = rows
        values = np.array(rows, np.int64).reshape(-1, DIMS)
        self.planes = to_planes(values, planes)
        self.norms = (values * values).sum(axis=1)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]


def _planes_of(batch: pa.RecordBatch, planes: int) -> np.ndarray:
    """The stored planes of a batch, plane by plane."""
    column = batch.column("planes")
    offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    words = np.frombuffer(column.buffers()[2], np.uint64, len(column) * planes, offset)
    return np.ascontiguousarray(words.reshape(-1, planes).T)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, x (64 doubles) of the vectors of 64 components that are all there and finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col(f"`{vector}`").cast("array<double>").alias("x"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return rows.where((F.size("x") == DIMS) & ~F.exists("x", bad))


def quantised(rows: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """vec_id, norm, planes of floor(scale * x), and the number of planes that all need."""
    low, high = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    ends = [int(np.floor(np.float64(scale) * v)) for v in (low, high) if v is not None] or [0]
    planes = 1 + max((v if v >= 0 else -v - 1).bit_length() for v in ends)
    planes = max(planes, 2)
    if planes > MOST_PLANES:
        raise ValueError(f"components up to {max(map(abs, ends))}: squared distances may pass 64 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            values = np.floor(np.float64(scale) * x).astype(np.int64)
            words = to_planes(values, planes).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array((values * values).sum(axis=1)),
                 pa.array([w.tobytes() for w in np.ascontiguousarray(words)], pa.binary())],
                names=["vec_id", "norm", "planes"])

    return rows.mapInArrow(run, "vec_id long, norm long, planes binary"), planes


def starts(table: DataFrame, k: int, seed: int, planes: int) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and vec_id; null ids last, then by planes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = table.select("planes", key.alias("h")).orderBy(F.asc_nulls_last("h"), "planes").limit(k).collect()
    w = weights(planes)
    bits = [plane_bits(np.frombuffer(r.planes, np.uint64)).astype(np.int64) for r in rows]
    return [(w[:, None] * b).sum(axis=0).tolist() for b in bits]


def moved(table: DataFrame, centroids: Centroids, planes: int) -> list[list[int]]:
    """Centroids after one round: floor of the mean of their vectors; empty ones stay."""
    k = len(centroids.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights(planes)
        n, sums = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for batch in _slices(batches):
            x = _planes_of(batch, planes)
            own, _ = nearest(x, batch.column("norm").to_numpy(), centroids.planes, centroids.norms)
            member = (own[None, :] == np.arange(k)[:, None]).astype(np.float32)
            n += np.bincount(own, minlength=k)
            for i in range(planes):
                # Set bits of this plane by cluster and component: at most ROWS, exact in float32.
                sums += w[i] * (member @ plane_bits(x[i]).astype(np.float32)).astype(np.int64)
        full = np.flatnonzero(n)
        if len(full):
            at = np.repeat(full, DIMS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(np.tile(np.arange(DIMS, dtype=np.int32), len(full))),
                 pa.array(n[at]), pa.array(sums[full].ravel())], names=["cluster", "j", "n", "s"])

    parts = table.mapInArrow(run, "cluster int, j int, n long, s long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = [list(r) for r in centroids.rows]
    for r in parts.groupBy("cluster", "j").agg(exact("n"), exact("s")).collect():  # k x 64 rows
        rows[r.cluster][r.j] = int(r.s) // int(r.n)
    return rows


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2,
    vector: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector.

    Components become floor(scale * x). Vectors that are null, not of 64 components, or hold a
    null or non-finite one take no part and have no row. Centroids start as the k vectors whose
    sha256 of "seed:vec_id" is smallest (fewer, if there are fewer vectors); null ids come last
    there. Repeated rows are vectors of their own and have a row each. An empty table gives no
    rows; other columns are not read. A table with components of 2^27 or more after scaling is
    refused, as distances may not fit a long; a sum of distances that does not is null.
    """
    spark = vectors.sparkSession
    ship(spark)
    table, planes = quantised(kept(vectors, vector), scale)
    table = stored(table, "planes")
    first = starts(table, k, seed, planes)
    if not first:
        return spark.createDataFrame([], OUT)
    centroids = Centroids(first, planes)
    for _ in range(rounds):
        centroids = Centroids(moved(table, centroids, planes), planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own, far = nearest(_planes_of(batch, planes), batch.column("norm").to_numpy(),
                               centroids.planes, centroids.norms)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(far)],
                names=["vec_id", "cluster", "distance"])

    assigned = stored(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    by_cluster = {r.cluster: int(r.s) for r in sums}
    fits = lambda v: v if v < 2**63 else None
    total = fits(sum(by_cluster.values()))
    about = [(i, fits(by_cluster.get(i, 0)), total, d) for i, d in enumerate(centroids.digests())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
