"""Components of documents that share keys, linked by a test on their token sets.

Keys say which documents may be linked. The documents of a key are compared with one of them, in
a few rounds, which is linear in the size of a key however many copies share it; links that hold
put documents into one component. Only documents that still share a key with one of another
component are then compared in blocks, so no link that could join two components is lost. A pair
of blocks gives a spanning forest of the links it found, not the links: at most as many rows as
it has documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.components import components
from loanweave.llm.store import drop, stored

BLOCK_DOCS, BLOCK_BYTES = 512, 16 << 20
ROUNDS = 3
# Takes numbers of common, left and right tokens (arrays or integers).
Enough = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def verified(pairs: DataFrame, sets: DataFrame, enough: Enough) -> DataFrame:
    """The pairs (a, b) whose sets pass the test. `sets` has id and s: sorted 8-byte tokens."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(enough(both, len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a long, b long")


def common_tokens(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Matrix of the number of tokens that each left and each right set share."""
    flat = lambda sets: np.concatenate([np.frombuffer(x, np.uint64) for x in sets])
    owner = lambda sets: np.repeat(np.arange(len(sets)), [len(x) // 8 for x in sets])
    u, d, v, e = flat(left), owner(left), flat(right), owner(right)
    order = np.argsort(v, kind="stable")
    v, e = v[order], e[order]
    lo, hi = np.searchsorted(v, u, "left"), np.searchsorted(v, u, "right")
    n = hi - lo
    out = np.zeros(len(left) * len(right), np.int64)
    done = np.cumsum(n)
    a = 0
    while a < len(u):  # a bounded number of matches at a time
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + (4 << 20), "right")))
        k = n[a:b]
        at = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        out += np.bincount(np.repeat(d[a:b], k) * len(right) + e[at], minlength=len(out))
        a = b
    return out.reshape(len(left), len(right))


def forest(a: np.ndarray, b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray) -> list[int]:
    """Places of links (a, b) that join all components which the links join, without a circle."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(label_a.tolist(), label_b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            kept.append(i)
    return kept


def linked_in_blocks(open_: DataFrame, sets: DataFrame, enough: Enough) -> DataFrame:
    """Links (a, b) that join documents of different labels that share a key, block by block.

    `open_` has key, id, label. Documents connected by keys form a cluster; it is cut into
    blocks of bounded size, and each pair of blocks is one unit of work that counts common
    tokens. So a cluster of any size is spread.
    """
    lead = open_.groupBy("key").agg(F.min("id").alias("b"))
    near = components(open_.join(lead, "key").select(F.col("id").alias("a"), "b"))
    members = open_.select("id", "label").distinct().join(
        near.select(F.col("node").alias("id"), F.col("label").alias("cluster")), "id")
    members = stored(members, "members")
    drop(near)
    sized = members.join(sets.select("id", "s"), "id")
    blocks = stored(sized.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum(F.octet_length("s")) / BLOCK_BYTES)).alias("blocks")), "blocks")
    rows = sized.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                       "block", "id", "label", "s")
    rows = rows.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")

    def links(x: int, y: int, found: list) -> pa.RecordBatch | None:
        left = [r for r in found if r[0] == x]
        right = [r for r in found if r[0] == y]
        if not left or not right:
            return None
        size = lambda part: np.array([len(r[3]) // 8 for r in part])
        label = lambda part: np.array([r[2] for r in part])
        both = common_tokens([r[3] for r in left], [r[3] for r in right])
        ok = enough(both, size(left)[:, None], size(right)[None, :])
        i, j = np.nonzero(ok & (label(left)[:, None] != label(right)[None, :]))
        a, b = np.array([r[1] for r in left])[i], np.array([r[1] for r in right])[j]
        kept = forest(a, b, label(left)[i], label(right)[j])
        return pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "x", "y", "block", "id", "label", "s")]
            for cluster, x, y, *row in zip(*columns):
                if (cluster, x, y) != now:
                    if found and (part := links(now[1], now[2], found)) is not None:
                        yield part
                    now, found = (cluster, x, y), []
                found.append(row)
        if found and (part := links(now[1], now[2], found)) is not None:
            yield part

    out = stored(rows.mapInArrow(run, "a long, b long"), "links")
    drop(members, blocks)
    return out


def joined(keys: DataFrame, sets: DataFrame, enough: Enough, rounds: int = ROUNDS) -> DataFrame:
    """node, label: components of the links between documents that share a key (id, key).

    A document is first compared with the leader it shares most keys with, then, in more rounds,
    with the most linked document of each key that is of another component.
    """
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("b")).where("n > 1").select("key", "b")
    open_ = stored(keys.join(shared, "key"), "open")
    pairs = open_.where("id <> b").groupBy("id", "b").agg(F.count("*").alias("n")).groupBy("id").agg(
        F.max_by("b", F.struct("n", -F.col("b"))).alias("b")).select(F.col("id").alias("a"), "b")
    tested = links = labels = None
    for _ in range(rounds):
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = stored(verified(pairs, sets, enough), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        drop(labels)
        labels = components(links)
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
        degree = ends.groupBy("id").agg(F.count("*").alias("degree")).join(
            labels.select(F.col("node").alias("id"), "label"), "id")
        named = stored(open_.select("key", "id").join(degree, "id", "left").select(
            "key", "id", F.coalesce("label", "id").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")), "named")
        best = named.groupBy("key").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.max_by("id", F.struct("degree", "id")).alias("b"),
            F.max_by("label", F.struct("degree", "id")).alias("other")).where("lo <> hi").select("key", "b", "other")
        before, open_ = open_, stored(named.join(best, "key"), "open")
        drop(before, named)
        if not open_.limit(1).count():
            drop(open_)
            return labels
        pairs = open_.where("label <> other").select(F.col("id").alias("a"), "b")
    found = linked_in_blocks(open_.select("key", "id", "label"), sets, enough)
    drop(labels, open_)
    return components(links.unionByName(found))
