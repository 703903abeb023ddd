"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles; likeness is weighted Jaccard, the weight
of a shingle being how often it occurs (words are runs without ASCII white space, in lower case).

Signatures. Each unit of weight of a shingle is a region on which darts fall as a Poisson
process along a rank axis; a dart's rank and its coordinate are hashes of shingle, unit and
dart number. A document looks at darts up to the rank at which about k ln k + 2k fall on its
regions, and keeps the earliest one of each of the k coordinates; if a coordinate stays empty,
the rank is doubled. Two documents share a coordinate's dart with probability equal to their
weighted Jaccard. The cost is one hash for each unit and dart, not one for each unit and
coordinate.

Joining. Equal texts are one class to begin with (their smallest row speaks for them). Bands of
a signature are keys; documents that share one are linked as `linking` does it: with leaders
first, then in blocks that hand over spanning forests, so no candidate pair that could join two
classes is lost. A link is verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.linking import joined
from loanweave.llm.store import drop, ship, stored
from loanweave.llm.text import by_bytes, mixed, run_hashes, text_buffers, word_hashes

WORDS = 5
BANDS, ROWS = 26, 4
NO_ID = 2**63 - 1  # stands for a null doc_id, after all others


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, sorted inside each, and the number before each text."""
    raw, off = text_buffers(pc.utf8_lower(texts))
    hashes, first = word_hashes(raw, off)
    runs, before = run_hashes(hashes, first, words)
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    return runs[np.lexsort((runs, doc))], before


def units(sorted_hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the j-th occurrence of a shingle in its text."""
    n = len(sorted_hashes)
    if not n:
        return sorted_hashes
    new = np.ones(n, bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    new[before[:-1][before[:-1] < n]] = True
    at = np.flatnonzero(new)
    j = np.arange(n) - np.repeat(at, np.diff(np.concatenate([at, [n]])))
    return mixed(sorted_hashes + j.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(unit: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
    """One row of k dart hashes for each text; zeros for a text without shingles."""
    docs = len(before) - 1
    out = np.zeros((docs, k), np.uint64)
    counts = np.diff(before)
    todo = np.flatnonzero(counts)
    limit = np.zeros(docs)
    limit[todo] = (k * np.log(k) + 2 * k) / counts[todo]
    while len(todo):
        n = counts[todo]
        at = np.repeat(before[todo] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        state, doc = unit[at], np.repeat(todo, n)
        rank = np.zeros(len(state))
        ranks, owners, darts = [], [], []
        while len(state):
            state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(_uniform(state))
            near = rank <= limit[doc]
            state, doc, rank = state[near], doc[near], rank[near]
            ranks.append(rank)
            owners.append(doc)
            darts.append(state)
        r, d, h = map(np.concatenate, (ranks, owners, darts))
        label = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
        slot = d * k + (label % np.uint64(k)).astype(np.int64)
        order = np.lexsort((label, r, slot))
        first = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])] if len(order) else order
        out.ravel()[slot[first]] = label[first] | np.uint64(1)
        filled = np.bincount(d[first], minlength=docs)
        todo = todo[filled[todo] < k]
        out[todo] = 0
        limit[todo] *= 2
    return out


def band_keys(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """id, key for each band of each text that has a word. `docs` has id, text."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            runs, before = shingles(batch.column("text"), words)
            sig = signatures(units(runs, before), before, k)
            keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
            for i in range(rows):
                keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + sig[:, i::rows])
            has = np.diff(before) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(np.flatnonzero(has), bands))),
                 pa.array(keys[has].ravel().view(np.int64))], names=["id", "key"])

    return docs.select("id", "text").mapInArrow(run, "id long, key long")


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays with repeats: each repeat is a unit of its own."""
    x, y = units(a, np.array([0, len(a)])), units(b, np.array([0, len(b)]))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def unit_sets(texts: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """id, s (the units of its shingles, sorted, 8 bytes each) of the texts named in `ids`."""

    def hashed(batches):
        for batch in by_bytes(batches, "text"):
            runs, before = shingles(batch.column("text"), words)
            unit = units(runs, before)
            parts = [np.sort(unit[x:y]).tobytes() for x, y in zip(before[:-1], before[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(parts, pa.binary())], names=["id", "s"])

    wanted = texts.join(ids.select("id").distinct(), "id", "left_semi").select("id", "text")
    return stored(wanted.mapInArrow(hashed, "id long, s binary"), "shingles")


def classes(
    docs: DataFrame, likeness: float = 0.8, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """doc_id, class_id for each row: the smallest doc_id of the documents it is linked to,
    directly or through others.

    Documents with equal texts are in one class. Null texts and texts without a word are like
    nothing, not even each other, and are classes of their own. A text of fewer than five words
    is one shingle. Repeated rows get the same class. A null doc_id takes part; it names a class
    only if all ids of the class are null. An empty table gives no rows. Only doc_id and text
    are read.
    """
    ids, named = _classes_of_texts(docs, likeness, bands, rows)
    smallest = named.groupBy("label").agg(F.min("k").alias("class_id"))
    by_text = named.join(smallest, "label").select("h1", "h2", "class_id")
    known = ids.where("words").join(by_text, ["h1", "h2"]).select("k", "class_id")
    found = known.unionByName(ids.where("not words").select("k", F.col("k").alias("class_id")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias("doc_id" if c == "k" else c)
    return found.select(real("k"), real("class_id"))


def _row_keys() -> tuple[list[F.Column], F.Column]:
    """k, h1, h2 (id and digests of the text of a row), and whether the text has a word."""
    words = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")) > 0
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return [key.alias("k"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")], words


def _classes_of_texts(docs: DataFrame, likeness: float, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """k, h1, h2, words of each row; and h1, h2, k (the smallest of its rows), label of each
    distinct text that has a word."""
    ship(docs.sparkSession)
    digests, words = _row_keys()
    # Ids and digests of all rows, and which row speaks for a text: narrow tables.
    ids = stored(docs.select(*digests, words.alias("words")), "digests")
    firsts = stored(ids.where("words").groupBy("h1", "h2").agg(F.min("k").alias("k")).select(
        "*", F.monotonically_increasing_id().alias("id")), "texts")
    # Only the row that speaks for its text finds a partner here, so copies make no hot key.
    texts = docs.select(*digests, "text").join(firsts, ["k", "h1", "h2"]).select("id", "text")
    keys = stored(band_keys(texts, bands, rows), "bands")
    # Only documents that share a key with another are hashed again.
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    sets = unit_sets(texts, keys.join(shared, "key", "left_semi"))
    labels = joined(keys, sets, lambda both, x, y: both >= likeness * (x + y - both))
    named = firsts.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select(
        "h1", "h2", "k", F.coalesce("label", "id").alias("label"))
    named = stored(named, "named")
    drop(keys, sets, labels, firsts)
    return ids, named


def keep_first(docs: DataFrame, likeness: float = 0.8) -> DataFrame:
    """One row of each class, that with the smallest doc_id, then text digest; columns unchanged.

    It is decided for each row by doc_id and text: repeated rows (same doc_id and text) are one
    row, null ids come last and go like others, and of two texts under one doc_id each is judged
    by its own class. Rows without a word all stay.
    """
    columns = docs.columns
    _, named = _classes_of_texts(docs, likeness)
    stay = named.groupBy("label").agg(F.min(F.struct("k", "h1", "h2")).alias("first")).select(
        F.col("first.k").alias("_k"), F.col("first.h1").alias("_h1"), F.col("first.h2").alias("_h2"))
    (k, h1, h2), words = _row_keys()
    names = [F.col(f"`{c}`") for c in columns]
    # The row is carried as one value, so its columns clash with nothing.
    rows = docs.where(words).select(F.struct(*names).alias("_row"), k.alias("_k"), h1.alias("_h1"), h2.alias("_h2"))
    # Repeated rows become one in each task before they are dealt out, so they make no hot key.
    kept = rows.dropDuplicates(["_k", "_h1", "_h2"]).join(stay, ["_k", "_h1", "_h2"], "left_semi")
    return kept.select("_row.*").unionByName(docs.where(~words).select(*names))
