"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often they occur. For each of K samples a term has r and c
drawn from Gamma(2, 1) and b from (0, 1), all from one hash of term and sample number. With
weight w the term stands at t = floor(ln w / r + b) with ln a = ln c - r (t - b + 1); the sample
of a text is its term of least ln a. Two texts take the same term and t with probability equal
to the generalised Jaccard likeness of their weights.

ln a depends on the term, the sample and t alone, so its value names the pair (term, t): the
fingerprint keeps 16 bits of a hash of it for each sample. Gamma draws are read from a table of
the inverse distribution, so that every machine gets the same numbers. A batch of texts works
out each (term, weight) once, whatever number of texts has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.store import ship
from loanweave.llm.text import by_bytes, mixed, text_buffers, word_hashes

SAMPLES = 64
_table: dict[str, np.ndarray] = {}


def gamma_table() -> np.ndarray:
    """Values of Gamma(2, 1) at the middles of 65536 equal shares: 1 - (1 + x) exp(-x) = p."""
    if "r" not in _table:
        p = (np.arange(65536) + 0.5) / 65536
        lo, hi = np.zeros(65536), np.full(65536, 40.0)
        for _ in range(60):
            x = (lo + hi) / 2
            low = 1 - (1 + x) * np.exp(-x) < p
            lo, hi = np.where(low, x, lo), np.where(low, hi, x)
        _table["r"] = np.round((lo + hi) / 2, 6)
        _table["ln"] = np.round(np.log(_table["r"]), 6).astype(np.float32)
        _table["r"] = _table["r"].astype(np.float32)
    return _table["r"]


def _ln_a(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """ln a of each term and sample."""
    r_table = gamma_table()
    out = np.empty((len(terms), samples), np.float32)
    ln_w = np.round(np.log(weights), 6).astype(np.float32)
    step = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(terms), 4096):
        h = mixed(terms[lo : lo + 4096, None] ^ step[None, :])
        r = r_table[h & np.uint64(0xFFFF)]
        ln_c = _table["ln"][(h >> np.uint64(16)) & np.uint64(0xFFFF)]
        b = ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
        t = np.floor(ln_w[lo : lo + 4096, None] / r + b)
        out[lo : lo + 4096] = ln_c - r * (t - b + 1)
    return out


def weighted_terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, weight) rows of each text: term hash, weight, number before each text."""
    hashes, first = word_hashes(raw, off)
    n = len(off) - 1
    names, at = np.unique(hashes, return_inverse=True)
    doc = np.repeat(np.arange(n), np.diff(first))
    keys, counts = np.unique(doc * max(len(names), 1) + at, return_counts=True)
    owner = keys // max(len(names), 1)
    return names[keys - owner * max(len(names), 1)], counts, np.searchsorted(owner, np.arange(n + 1))


def fingerprints(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit values for each text; a text without a word has a row of its own kind."""
    terms, weights, before = weighted_terms(*text_buffers(texts))
    n = len(texts)
    out = np.zeros((n, samples), np.uint16)
    if not len(terms):
        return out
    pairs, at = np.unique(mixed(terms + weights.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    where = np.searchsorted(pairs, mixed(terms + weights.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    ln_a = _ln_a(terms[at], weights[at], samples)
    some = np.flatnonzero(np.diff(before))
    least = np.empty((len(some), samples), np.float32)
    lo = 0
    while lo < len(some):  # gather a bounded number of rows at a time
        hi = int(np.searchsorted(before[some], before[some[lo]] + 40_000, "left"))
        hi = max(hi, lo + 1)
        a, b = before[some[lo]], before[some[hi - 1] + 1]
        least[lo:hi] = np.minimum.reduceat(ln_a[where[a:b]], before[some[lo:hi]] - a, axis=0)
        lo = hi
    value = mixed(least.view(np.uint32).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    out[some] = (value >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out


def as_text(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of samples that agree."""
    return (a == b).mean(axis=1)


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and the fingerprint of each row's text; a map over the rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows = as_text(fingerprints(batch.column("text"), samples))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.string())],
                                             names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows in ranges of doc_id, each range followed by the first row of the next one.

    cell, head (the row belongs to the next range), doc_id, text; sorted inside a partition by
    cell, head, doc_id, digest of the text. The last range is followed by the very first row.
    Only the smallest id of each range, at most `ranges` numbers, reaches the driver.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    ids = docs.select(key.alias("k"))
    bounds = [r.low for r in ids.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("p"))
              .agg(F.min("k").alias("low")).orderBy("low").collect()]
    rows = docs.select(key.alias("k"), F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    if not bounds:
        return rows.select(F.lit(0).alias("cell"), F.lit(False).alias("head"), "doc_id", "text")

    def cells(batches):
        low = np.array(bounds, np.int64)
        for batch in batches:
            k = batch.column("k").to_numpy()
            cell = np.searchsorted(low, k, "right") - 1
            head = low[cell] == k
            twice = np.concatenate([np.arange(len(k)), np.flatnonzero(head)])
            place = np.concatenate([cell, (cell[head] - 1) % len(low)])
            flag = np.concatenate([np.zeros(len(k), bool), np.ones(int(head.sum()), bool)])
            out = batch.take(pa.array(twice))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.astype(np.int32)), pa.array(flag), *[out.column(c) for c in ("k", "doc_id", "text", "tie")]],
                names=["cell", "head", "k", "doc_id", "text", "tie"])

    placed = rows.mapInArrow(cells, "cell int, head boolean, k long, doc_id long, text string, tie long")
    return placed.repartitionById(len(bounds), F.col("cell")).sortWithinPartitions(
        "cell", "head", "k", "tie").select("cell", "head", "doc_id", "text")


def edited(text: str, other: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def edit_report(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how like they are.

    The next document is that of the next larger doc_id (rows of one doc_id follow each other by
    a digest of the text), after the last the first. Null and empty texts have the fingerprint of
    zeros, are like each other (1) and like nothing else (0). A single document is its own next.
    A null doc_id comes last. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def report(rows, follower):
        """Rows of one range, in order, and the text that follows the last of them."""
        texts = [t for _, t in rows]
        after = [*texts[1:], follower]
        edits = [edited(t, o) for t, o in zip(texts, after)]
        found = fingerprints(pa.array([*texts, follower], pa.string()), samples)
        changed = fingerprints(pa.array(edits, pa.string()), samples)
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
             pa.array(as_text(found[:-1])), pa.array(as_text(changed)),
             pa.array(likeness(found[:-1], changed)), pa.array(likeness(found[:-1], found[1:]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held, size, cell, closed = [], 0, None, False
        for batch in by_bytes(batches, "text"):
            for c, head, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("cell", "head", "doc_id", "text"))):
                text = text or ""
                if c != cell:
                    held, size, cell, closed = [], 0, c, False
                if closed:
                    continue
                if held and (head or size > 3 << 20):
                    yield report(held, text)
                    held, size = [], 0
                closed = head
                if not head:
                    held.append((doc_id, text))
                    size += len(text)

    return with_next(docs, ranges).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")
