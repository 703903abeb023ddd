"""Jaccard self-join of word n-gram sets by token-combination prefixes.

Tokens are shingle hashes. All sets follow one order of tokens, rare ones first. A set of n
tokens can miss at most e = n - ceil(share n) of them in any set it links with. Tokens are in
classes by document frequency: a class is indexed by combinations of k of its tokens, k = 1 for
rare tokens, 2 and 3 for more frequent ones, which are first dealt into groups by hash so that
combinations stay few. Sharing no combination of a group costs a partner all but k - 1 of the
tokens there, so a prefix is extended until these costs pass e; then the prefixes of two linked
sets share a combination, whichever is longer. The number of groups depends on the size of the
set, so it signs for its own range of sizes and the next; linked sets have one in common.

Before that, documents that cannot have a partner are put aside: a token that occurs in one
document only is shared with nobody, and a document needs ceil(share n) tokens that occur in
others. A bit table of fixed size says so while texts are read (a wrong bit lets a document
through, none is lost). Equal sets are one node. Links are verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.bits import COUNTS, at_least, bit_table, counted, holds
from loanweave.llm.linking import joined
from loanweave.llm.store import drop, ship, stored
from loanweave.llm.text import ascii_lower, by_bytes, mixed, run_hashes, text_buffers, word_hashes

WORDS = 4
SHARE = 85  # percent
BITS = 27
# Tokens up to the first document frequency are indexed alone, up to the second in pairs, all
# others in triples.
CLASSES = (16, 512)
GROUP = 3  # tokens a group adds to the cost that a prefix has to reach, about


def needed(n, share: int = SHARE):
    """The least number of tokens that a set of n shares with any set it links with."""
    return -(-share * n // 100)


def least_size(share: int) -> int:
    """Smaller sets link with equal ones only."""
    return next(n for n in range(1, 102 if share < 100 else 2) if needed(n + 1, share) <= n or share >= 100)


def token_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside it, and the number before each."""
    raw, off = text_buffers(texts)
    hashes, first = word_hashes(ascii_lower(raw), off)
    runs, before = run_hashes(hashes, first, words)
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    order = np.lexsort((runs, doc))
    runs = runs[order]  # the documents are in order already
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    return runs[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])


def _each(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of the values of each document, modulo 2^64."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[before[1:]] - sums[before[:-1]]


def sets_of(docs: DataFrame, words: int, share: int, bits: int) -> DataFrame:
    """doc_id, n, h1, h2 (a digest of the set) of each row; s, its sorted tokens, where it may
    have a partner."""
    least = least_size(share)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in by_bytes(batches, "text"):
                runs, before = token_sets(batch.column("text"), words)
                n = np.diff(before)
                yield runs[np.repeat(n >= least, n)]

        yield from counted(parts())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    twice = at_least(rows.select("text").mapInArrow(tokens, COUNTS), 2)
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(twice, bits))  # 2^bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in by_bytes(batches, "text"):
            runs, before = token_sets(batch.column("text"), words)
            n = np.diff(before)
            hits = np.concatenate([[0], np.cumsum(holds(known, runs, bits))])
            open_ = (n >= least) & (hits[before[1:]] - hits[before[:-1]] >= needed(n, share))
            s = [runs[x:y].tobytes() if o else None for o, x, y in zip(open_, before[:-1], before[1:])]
            h1 = _each(mixed(runs), before)
            h2 = _each(mixed(runs ^ np.uint64(0xC2B2AE3D27D4EB4F)), before)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)),
                 pa.array(h2.view(np.int64)), pa.array(s, pa.binary())], names=["doc_id", "n", "h1", "h2", "s"])

    out = rows.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, s binary")
    return stored(out.withColumn("uid", F.monotonically_increasing_id()), "sets")


def size_bounds(most: int, share: int) -> list[int]:
    """Sizes at which ranges begin: sets that link lie in the same range or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // share + 1)
    return out


def prefix_keys(df: np.ndarray, tokens: np.ndarray, n: int, share: int) -> list[int]:
    """Signatures of a set of n tokens, given those that occur in other sets, with their df."""
    left = n - needed(n, share) + 1 - (n - len(tokens))  # the others come first and cost one each
    if left <= 0:
        return []
    order = np.lexsort((tokens, df))
    tokens, kind = tokens[order], np.searchsorted(CLASSES, df[order], "left")
    rare = tokens[kind == 0][:left]
    keys = mixed(rare + np.uint64(1)).tolist()
    left -= len(rare)
    if left <= 0:
        return keys
    bounds = size_bounds(n, share)
    level = len(bounds) - 2
    for at in (level, level + 1):
        smallest = bounds[max(at - 1, 0)]
        groups = max(1, smallest * (100 - share) // 100 // GROUP)
        cost = left
        for k in (2, 3):
            mine = tokens[kind == k - 1]
            if not len(mine) or cost <= 0:
                continue
            group = (mixed(mine ^ np.uint64(at)) % np.uint64(groups)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            start = np.searchsorted(group[by], np.arange(groups))
            place = np.empty(len(mine), np.int64)
            place[by] = np.arange(len(mine)) - start[group[by]]
            costs = np.cumsum(place >= k - 1)
            end = int(np.searchsorted(costs, cost, "left")) + 1
            cost -= int(costs[min(end, len(mine)) - 1])
            mine, group = mine[:end], group[:end]
            for g in np.unique(group):
                chosen = np.sort(mine[group == g])
                if len(chosen) >= k:
                    each = np.array(list(combinations(chosen.tolist(), k)), np.uint64)
                    key = np.full(len(each), (at << 8) + k, np.uint64)
                    for i in range(k):
                        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + each[:, i])
                    keys += key.tolist()
    return keys


def keys_of(sets: DataFrame, share: int) -> DataFrame:
    """id, key: signatures of the sets (id, n, s)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s")
            size = np.array([len(x) // 8 for x in s.to_pylist()], np.int64)
            tokens = np.frombuffer(b"".join(s.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("id").to_numpy(), size)), pa.array(np.repeat(size, size)),
                 pa.array(tokens)], names=["id", "n", "token"])

    rows = sets.mapInArrow(spread, "id long, n long, token long")
    df = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = rows.join(df, "token").groupBy("id", "n").agg(F.collect_list(F.struct("df", "token")).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t")
            flat = column.flatten()
            df, tokens = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            before = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
            ids, out, each = batch.column("id").to_numpy(), [], []
            for x, y, n in zip(before[:-1], before[1:], batch.column("n").to_pylist()):
                keys = prefix_keys(df[x:y], tokens[x:y].view(np.uint64), n, share)
                out += keys
                each.append(len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, each)), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "key"])

    return own.mapInArrow(sign, "id long, key long").distinct()


def components_of(
    docs: DataFrame, share: int = SHARE, words: int = WORDS, bits: int = BITS,
) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest doc_id reachable by links.

    Two documents link when 100 times the size of the intersection of their shingle sets is at
    least `share` times that of the union. Words are runs without ASCII white space with A-Z in
    lower case; with fewer than `words` words the whole sequence is the one shingle. Null texts
    and texts without a word have no shingle and are components of their own. Repeated rows get
    the same component, two texts under one doc_id each their own. A null doc_id takes part; it
    names a component only if all its ids are null. An empty table gives no rows; other columns
    are not read. `bits` sets the size of a filter, not the result.
    """
    ship(docs.sparkSession)
    rows = sets_of(docs, words, share, bits)
    ids = rows.select("doc_id", "n", "h1", "h2", "uid")
    firsts = stored(ids.where("n > 0").groupBy("n", "h1", "h2").agg(
        F.min("uid").alias("id"), F.min("doc_id").alias("k")), "firsts")
    sets = rows.where("s is not null").select(F.col("uid").alias("id"), "s").join(firsts.select("id"), "id", "left_semi")
    sets = stored(sets, "reps")
    keys = stored(keys_of(sets, share), "keys")
    labels = joined(keys, sets, lambda both, x, y: 100 * both >= share * (x + y - both))
    drop(keys, sets)
    named = firsts.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select(
        "n", "h1", "h2", "k", F.coalesce("label", "id").alias("label"))
    smallest = named.groupBy("label").agg(F.min("k").alias("component_id"))
    named = stored(named.join(smallest, "label").select("n", "h1", "h2", "component_id"), "named")
    drop(labels, firsts)
    known = ids.where("n > 0").join(named, ["n", "h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return known.unionByName(ids.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
