"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are made unit length, projected to a few dimensions by a random orthogonal map, shifted
by a random offset and put on a grid; the Hilbert index of the cell is the key of a curve. Each
curve has its own map and offset. The grid is fine (12 bits a dimension, a key of two longs), so
that rows of a dense group fall into different cells and each curve orders them in its own way. Rows are range-partitioned by (curve, key), numbered, and cut
into blocks of a bounded number of rows. A query looks at the rows whose number on the curve is
within a window of its own; what the curves find is merged and ranked by the exact cosine.

Equal vectors are searched once: a group keeps its k + 1 smallest ids, which is all that any
answer can hold, and the ids are found in salted steps, so a vector that a third of the rows
share is neither one task nor a window full of copies.

The window is a share of the rows (at least `least_window`): with vectors that have no
structure at all, neighbours are hardly nearer than others, and only a share keeps the recall
at every size. Structured vectors do with a fixed number of rows; give `window` then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.store import ship, stored

CURVES, DIMENSIONS, BITS = 12, 10, 12
SHARE, LEAST_WINDOW, BLOCK = 0.08, 2048, 2048
SALTS = 64


def hilbert_bits(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Index on the Hilbert curve of each row of grid coordinates (Skilling's transposition);
    bit b of array i is bit b * d + d - 1 - i of the index."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[d - 1] & (1 << b)) != 0, flip ^ ((1 << b) - 1), flip)
    return [at ^ flip for at in x]


def packed(x: list[np.ndarray], top: int, low: int) -> np.ndarray:
    """The bits of an index from level top - 1 down to level low as one long."""
    key = np.zeros(len(x[0]), np.int64)
    for b in range(top - 1, low - 1, -1):
        for at in x:
            key = (key << 1) | ((at >> b) & 1)
    return key


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of grid coordinates, of at most 63 bits."""
    return packed(hilbert_bits(cells, bits), bits, 0)


def curve_keys(unit: np.ndarray, curve: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unit vectors on one curve, upper and lower half; the map depends on seed,
    dimension and curve."""
    dim = unit.shape[1]
    rng = np.random.Generator(np.random.PCG64([seed, dim, curve]))
    low = min(DIMENSIONS, dim)
    axes = np.linalg.qr(rng.standard_normal((dim, low)))[0]
    at = (unit @ axes * np.sqrt(dim) + rng.uniform(0, 1, low) + 4) / 9
    cells = np.clip((at * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    x = hilbert_bits(cells, BITS)
    return packed(x, BITS, BITS // 2), packed(x, BITS // 2, 0)


def groups(rows: DataFrame, query_every: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct usable vectors (gid, first id, is it asked for, vector), the k + 1 smallest ids
    of each (gid, vec_id), and the digests of each (d1, d2, gid)."""
    v = F.col("embedding")
    usable = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ids = rows.where(usable).select(
        F.col("vec_id").cast("long"), v, F.xxhash64(v).alias("d1"), F.xxhash64(F.lit(1), v).alias("d2"),
        F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    each = ids.groupBy("d1", "d2").agg(
        F.min("vec_id").alias("first"), F.max(F.col("vec_id") % query_every == 0).alias("asked"))
    each = stored(each.withColumn("gid", F.monotonically_increasing_id()), "vector-groups")
    narrow = ids.select("d1", "d2", "vec_id", "salt").distinct()
    for keys in (("d1", "d2", "salt"), ("d1", "d2")):
        w = Window.partitionBy(*keys).orderBy("vec_id")
        narrow = narrow.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    members = stored(narrow.join(each, ["d1", "d2"]).select("gid", "vec_id"), "vector-members")
    # Only the first row of a group brings its vector, so copies make no hot key.
    vectors = ids.join(each, (F.col("vec_id") == F.col("first")) & (ids["d1"] == each["d1"]) & (ids["d2"] == each["d2"]))
    vectors = vectors.select("gid", "first", "asked", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return vectors.dropDuplicates(["gid"]), members, each.select("d1", "d2", "gid")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def on_curves(vectors: DataFrame, curves: int, partitions: int) -> DataFrame:
    """Rows of all curves, numbered: curve (its dimension and number), r, gid, first, asked, v."""

    def keys(batches):
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column("v")], np.int64)
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = _matrix(part.column("v"))
                # Scaled first, so that squares neither vanish nor overflow.
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for c in range(curves):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim * 1000 + c)), *map(pa.array, curve_keys(unit, c)), *part.columns],
                        names=["curve", "key", "fine", *part.schema.names])

    def number(batches):
        curve, r = None, 0
        for batch in batches:
            c = batch.column("curve").to_numpy()
            local = np.empty(len(c), np.int64)
            for lo, hi in zip(*_stretches(c)):
                if c[lo] != curve:
                    curve, r = c[lo], 0
                local[lo:hi] = r + np.arange(hi - lo)
                r += hi - lo
            yield batch.append_column("local", pa.array(local))

    schema = "curve long, key long, fine long, gid long, first long, asked boolean, v array<double>"
    keyed = vectors.mapInArrow(keys, schema).repartitionByRange(partitions, "curve", "key", "fine", "gid")
    cells = keyed.sortWithinPartitions("curve", "key", "fine", "gid").mapInArrow(number, schema + ", local long")
    cells = stored(cells.withColumn("cell", F.spark_partition_id()), "curves")
    # One row a curve and partition.
    sums = cells.groupBy("curve", "cell").agg(F.count("*").alias("n"))
    w = Window.partitionBy("curve").orderBy("cell")
    sums = sums.select("curve", "cell", (F.sum("n").over(w) - F.col("n")).alias("before"),
                       F.sum("n").over(Window.partitionBy("curve")).alias("rows"))
    return cells.join(F.broadcast(sums), ["curve", "cell"]).select(
        "curve", (F.col("before") + F.col("local")).alias("r"), "rows", "gid", "first", "asked", "v")


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return starts, np.concatenate([starts[1:], [len(values)]]) if len(values) else starts


def _ranked(batches, best: int):
    """Blocks in order, the rows of a block before its queries: the best rows for each query."""
    block, held, data = None, [], None
    for batch in batches:
        names = np.stack([batch.column("curve").to_numpy(), batch.column("block").to_numpy(),
                          batch.column("query").to_numpy(zero_copy_only=False).astype(np.int64)])
        change = np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0)])
        starts = np.flatnonzero(change)
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            here = (int(names[0, lo]), int(names[1, lo]))
            if here != block:
                block, held, data = here, [], None
            gid = batch.column("gid").slice(lo, hi - lo).to_numpy()
            first = batch.column("first").slice(lo, hi - lo).to_numpy()
            x = _matrix(batch.column("v").slice(lo, hi - lo))
            if not names[2, lo]:
                held.append((gid, first, x))
                continue
            if data is None:
                data = tuple(map(np.concatenate, zip(*held)))
                held = []
            for a in range(0, len(gid), 512):
                q = x[a : a + 512]
                scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(data[2], axis=1)[None, :]
                score = q @ data[2].T / scale
                n = min(best, score.shape[1])
                # All rows that reach the n-th best score, then ties by the smaller first id.
                nth = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
                i, j = np.nonzero(score >= nth[:, None])
                order = np.lexsort((data[1][j], -score[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < n], j[place < n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gid[a : a + 512][i]), pa.array(data[0][j]), pa.array(data[1][j]), pa.array(score[i, j])],
                    names=["q", "gid", "first", "score"])


def search(
    rows: DataFrame, k: int = 5, query_every: int = 50, curves: int = CURVES, share: float = SHARE,
    window: int | None = None, least_window: int = LEAST_WINDOW,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query.

    Queries are the rows whose vec_id is divisible by `query_every`; candidates all other rows.
    Rows with a null id, a null, empty or zero vector, or a vector with null or non-finite parts
    take no part. Vectors of different lengths are not compared. Rows that repeat an id and
    vector are one row; an id with several vectors is a candidate with each, but never for a
    query of its own id. Equal scores go by the smaller vec_id. Where there are fewer than k
    candidates all are returned. An empty table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select("vec_id", "embedding")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors, members, digests = groups(rows, query_every, k)
    placed = on_curves(vectors, curves, partitions)
    reach = F.lit(window).cast("long") if window else F.greatest(
        F.lit(least_window).cast("long"), F.ceil(F.col("rows") * share).cast("long"))
    data = placed.select("curve", F.floor(F.col("r") / BLOCK).alias("block"), F.lit(False).alias("query"), "gid", "first", "v")
    around = F.sequence(F.floor(F.greatest(F.lit(0).cast("long"), F.col("r") - reach) / BLOCK),
                        F.floor(F.least(F.col("rows") - 1, F.col("r") + reach) / BLOCK))
    asked = placed.where("asked").select("curve", F.explode(around).alias("block"), F.lit(True).alias("query"), "gid", "first", "v")
    both = data.unionByName(asked).repartition(partitions, "curve", "block").sortWithinPartitions("curve", "block", "query")

    def rerank(batches):
        yield from _ranked(batches, k + 2)

    found = both.mapInArrow(rerank, "q long, gid long, first long, score double")
    found = found.groupBy("q", "gid").agg(F.max("score").alias("score"), F.min("first").alias("first"))
    near = found.withColumn("r", F.row_number().over(
        Window.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k + 2)
    ids = near.join(members, "gid").withColumn("r", F.row_number().over(
        Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    ids = stored(ids.select("q", "vec_id", "score"), "neighbours")
    queries = rows.where(F.col("vec_id") % query_every == 0).select(
        F.col("vec_id").cast("long").alias("query_id"), F.xxhash64("embedding").alias("d1"),
        F.xxhash64(F.lit(1), "embedding").alias("d2")).distinct()
    named = queries.join(digests, ["d1", "d2"]).select("query_id", F.col("gid").alias("q"))
    answers = named.join(ids, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
