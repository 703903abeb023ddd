"""Exact random draws in count space: a fixed total handed down a tree of cells.

A population is given as cells with counts (scores, bins, groups), never as rows. Cells are
numbered by an ordered scan and grouped FAN at a time, groups again, up to one root. Each
replicate's draws start at the root and are split among the children of every node that got any:
multinomially (with replacement) or hypergeometrically (without). So totals are exact, the law is
that of drawing rows, and the work is cells x replicates at most, at any number of rows. Random
numbers depend on seed, population, node and replicate alone, not on how tasks are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.operators.scan import Scan, scan
from loanweave.session import settle, ship

FAN = 256
LIBRARY_LIMIT = 10**9  # beyond it the library's hypergeometric draws refuse
OUT_ROWS = 1 << 20


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, k: int) -> int:
    """Inversion from the mode with ratios of neighbouring chances; tails beyond twelve standard
    deviations are below the resolution of a double."""
    low, high = max(0, k - bad), min(good, k)
    if low == high:
        return low
    n = good + bad
    mode = min(max((k + 1) * (good + 1) // (n + 2), low), high)
    width = int(12 * np.sqrt(k * (good / n) * (bad / n) * ((n - k) / max(n - 1, 1)))) + 20
    up = np.arange(mode + 1, min(high, mode + width) + 1, dtype=np.float64)
    down = np.arange(mode - 1, max(low, mode - width) - 1, -1, dtype=np.float64)
    above = np.cumprod((good - up + 1) * (k - up + 1) / (up * (bad - k + up)))
    below = np.cumprod((down + 1) * (bad - k + down + 1) / ((good - down) * (k - down)))
    chance = np.concatenate([below[::-1], [1.0], above]).cumsum()
    return mode - len(down) + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def without_replacement(rng: np.random.Generator, sizes: np.ndarray, k: int) -> np.ndarray:
    """How many of k rows drawn without replacement fall on each cell."""
    left = int(sizes.sum())
    if left < LIBRARY_LIMIT:
        return rng.multivariate_hypergeometric(sizes, k, method="marginals")
    out = np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        left -= size
        out[i] = _hypergeometric(rng, size, left, k)
        k -= int(out[i])
    return out


def _split(level: int, seed: int, replace: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[tuple]) -> pa.RecordBatch:
            gids, replicates, nodes, counts = zip(*held)
            each = [len(x) for x in nodes]
            return pa.RecordBatch.from_arrays(
                [pa.array(gids, pa.string()).take(pa.array(np.repeat(np.arange(len(each)), each))),
                 pa.array(np.repeat(np.array(replicates, np.int32), each)),
                 pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts))],
                names=["gid", "replicate", "node", "k"])

        held, rows = [], 0
        for b in batches:
            children = b.column("children")
            before = children.offsets.to_numpy()
            before = before - before[0]
            flat = children.flatten()
            node, size = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            columns = [b.column(c).to_pylist() for c in ("gid", "node", "replicate", "k")]
            for x, y, gid, parent, replicate, k in zip(before[:-1], before[1:], *columns):
                key = hashlib.blake2b(f"{seed}|{gid}|{level}|{parent}|{replicate}".encode(), digest_size=16)
                rng = np.random.Generator(np.random.PCG64(int.from_bytes(key.digest(), "big")))
                sizes = size[x:y]
                got = rng.multinomial(k, sizes / sizes.sum()) if replace else without_replacement(rng, sizes, k)
                hit = np.flatnonzero(got)
                if len(hit):
                    held.append((gid, replicate, node[x:y][hit], got[hit]))
                    rows += len(hit)
                if rows >= OUT_ROWS:
                    yield batch(held)
                    held, rows = [], 0
        if held:
            yield batch(held)

    return run


def draw_counts(
    cells: DataFrame, by: Sequence[str], cell: str, size: str, draws: Column, replicates: int,
    seed: int, replace: bool, name: str = "k", fan: int = FAN,
) -> DataFrame:
    """by, replicate (1..), cell and `name`: how often each cell was drawn; cells without a draw
    have no row.

    `draws` is the number of draws of a population, a column that may use `all`, its rows.
    Without replacement it must not exceed `all`. Empty cells are never drawn; populations
    without rows have none. NULL in `by` is a value like any other.
    """
    by = list(by)
    ship(cells.sparkSession)
    gid = F.md5(F.to_json(F.struct(*[F.col(b).cast("string").alias(f"g{i}") for i, b in enumerate(by)],
                                   F.lit(0).alias("g"))))
    sized = cells.where(F.col(size) > 0).select(
        *by, F.col(cell).alias("item"), F.col(size).cast("bigint").alias("n"),
        F.lit(1).cast("bigint").alias("one"), gid.alias("gid"))
    placed = settle(scan(sized, by, "item", Scan(sums={"upto": "one"}, totals={"all": "n"})).withColumn(
        "node", F.col("upto") - 1).drop("one", "upto"))
    most = placed.agg(F.max("node")).first()[0]
    levels = 1
    while most is not None and fan**levels <= most:
        levels += 1
    drawn = placed.groupBy("gid").agg(F.first("all").alias("all"), *[F.first(b).alias(b) for b in by]).select(
        "gid", F.lit(0).cast("bigint").alias("node"), draws.cast("bigint").alias("k"),
        F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).where("k > 0")
    for level in reversed(range(levels)):
        under = lambda n: F.expr(f"node div {n}")
        child = placed.groupBy("gid", under(fan**level).alias("node")).agg(F.sum("n").alias("size"))
        # At most `fan` children a node.
        family = child.groupBy("gid", under(fan).alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("node", "size"))).alias("children"))
        todo = drawn.withColumnRenamed("node", "parent").join(family, ["gid", "parent"]).select(
            "gid", F.col("parent").alias("node"), "replicate", "k", "children")
        drawn = todo.mapInArrow(_split(level, seed, replace), "gid string, replicate int, node bigint, k bigint")
    found = drawn.join(placed.select("gid", "node", *by, "item"), ["gid", "node"])
    return found.select(*by, "replicate", F.col("item").alias(cell), F.col("k").alias(name))
