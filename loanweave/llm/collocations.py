"""Phrases of two to four words that belong together, mined with rolling fingerprints.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words.
Prefix sums of a polynomial over word hashes give the fingerprint of every run of words in one
subtraction (Rabin-Karp); language and length are part of it.

1. Level by level (words and pairs, triples, fours) tasks count fingerprints and hand over each
   distinct one with its count; Spark adds them up. A run can reach the least count only if both
   runs that are one word shorter do, so a level counts only those. What a level found goes to
   the next as a bit table of fixed size: a wrong bit costs a row, a missing one cannot be.
2. The bit table also picks the occurrences that are materialised. In a task the occurrences of a
   fingerprint point at their first one; the words of each are compared with the words there, so
   texts that share a fingerprint come apart, and phrases leave the task as text with their count.
   Sums by text are exact, whatever collides.
3. Scores, containment and the best of each language are joins and groupings of the frequent
   phrases, with counts as decimals where products may pass 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.bits import COUNTS, at_least, bit_table, counted, holds
from loanweave.llm.store import ship, stored
from loanweave.llm.text import (
    ascii_lower, by_bytes, mixed, powers, span_hashes, text_buffers, word_bounds,
)
from loanweave.session import shuffle_partitions

LONGEST = 4
BREAKS = np.zeros(256, bool)
BREAKS[[10, 11, 12, 13, *map(ord, ".,;:!?")]] = True
APART = BREAKS.copy()
APART[[9, 32]] = True

FLUSH = 2 << 20  # fingerprints that a task gathers before it counts them
BITS = 26  # the bit table has 2^26 bits, 8 MB
PARTS = 16  # parts of the input that one task of the last pass reads, if there are many
PHRASES = 1 << 20  # distinct phrases that a task gathers before it hands them over


class Words:
    """Words of a batch of texts, the words left in the piece of each, and prefix polynomials."""

    def __init__(self, batch: pa.RecordBatch):
        raw, off = text_buffers(batch.column("text"))
        self.raw = ascii_lower(raw)
        self.starts, self.ends = word_bounds(self.raw, off, APART)
        n = len(self.starts)
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        piece = np.cumsum(BREAKS[self.raw])[self.starts] if n else self.starts
        new = np.ones(n, bool)
        new[1:] = (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        end = np.append(first[1:], n)
        self.left = np.repeat(end, end - first) - np.arange(n)
        step, self._back = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(span_hashes(self.raw, self.starts, self.ends) * step[:n], out=self._sums[1:])
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[self.doc] if n else self.doc
        seeds = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in self.langs]
        self._seed = np.frombuffer(b"".join(seeds), np.uint64)

    def runs(self, n: int) -> np.ndarray:
        """First words of the runs of n words that lie inside a piece."""
        return np.flatnonzero(self.left >= n)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the runs of n words from each place; places must have n words left."""
        value = (self._sums[at + n] - self._sums[at]) * self._back[at]
        return mixed(mixed(value + np.uint64(n)) ^ self._seed[self.lang[at]])

    def texts(self) -> pa.DictionaryArray:
        """The words as text, coded."""
        solid = ~APART[self.raw]
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        column = pa.LargeStringArray.from_buffers(
            len(self.starts), pa.py_buffer(ends), pa.py_buffer(self.raw[solid]))
        return column.dictionary_encode()


def _candidates(words: Words, n: int, table: np.ndarray | None, bits: int) -> np.ndarray:
    """Runs of n words both of whose parts of n - 1 words may be frequent."""
    at = words.runs(n)
    if table is None or not len(at):
        return at
    return at[holds(table, words.prints(at, n - 1), bits) & holds(table, words.prints(at + 1, n - 1), bits)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def frequent(docs: DataFrame, lengths: list[int], least: int, table, bits: int) -> DataFrame:
    """print: fingerprints of runs of these lengths that occur at least so often."""


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value if table is not None else None

        def prints() -> Iterator[np.ndarray]:
            for batch in by_bytes(batches, "text"):
                words = Words(batch)
                for n in lengths:
                    yield words.prints(_candidates(words, n, known, bits), n)

        yield from counted(prints(), FLUSH)

    return at_least(_rows(docs).mapInArrow(run, COUNTS), least)


def phrases(docs: DataFrame, table, bits: int, least: int) -> DataFrame:
    """lang, words, phrase, f: exact counts of the runs that occur so often; and for each lang a
    row with words 0 and an empty phrase that counts all its words."""

    def of_batch(words: Words, known: np.ndarray) -> list[pa.Table]:
        coded, out = words.texts(), []
        codes = coded.indices.to_numpy()

        def table_of(lang: np.ndarray, n: int, text: pa.Array, f: np.ndarray) -> pa.Table:
            return pa.table({"lang": pa.array(words.langs, pa.string()).take(pa.array(lang)),
                             "words": pa.array(np.full(len(f), n, np.int32)),
                             "phrase": text.cast(pa.string()), "f": pa.array(f.astype(np.int64))})

        total = np.bincount(words.lang, minlength=len(words.langs))
        out.append(table_of(np.arange(len(total)), 0, pa.array([""] * len(total)), total))
        for n in range(1, LONGEST + 1):
            at = words.runs(n)
            prints = words.prints(at, n)
            near = holds(known, prints, bits)
            at, prints = at[near], prints[near]
            _, first, inverse, f = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
            pointer = at[first]  # the occurrence that stands for all others with its fingerprint
            same = words.lang[at] == words.lang[pointer][inverse]
            for j in range(n):
                same &= codes[at + j] == codes[pointer + j][inverse]
            other = at[~same]
            f = f - np.bincount(inverse[~same], minlength=len(f))
            for place, count in ((pointer, f), (other, np.ones(len(other), np.int64))):
                if len(place):
                    parts = [coded.dictionary.take(pa.array(codes[place + j])) for j in range(n)]
                    text = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
                    out.append(table_of(words.lang[place], n, text, count))
        return out

    def summed(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).group_by(["lang", "words", "phrase"]).aggregate([("f", "sum")])
        return whole.rename_columns(["lang", "words", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        whole, parts, held = None, [], 0
        for batch in by_bytes(batches, "text"):
            words = Words(batch)
            if not len(words.starts):
                continue
            parts += of_batch(words, known)
            held = sum(map(len, parts))
            if held >= PHRASES // 4:
                whole, parts = summed(parts + [whole] if whole is not None else parts), []
                if len(whole) >= PHRASES:
                    yield from whole.to_batches(1 << 16)
                    whole = None
        if parts or whole is not None:
            yield from summed(parts + [whole] if whole is not None else parts).to_batches(1 << 16)
        del whole, parts
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    # A task sums up several parts of the input, so a phrase leaves it once and not once a part.
    rows = _rows(docs)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // PARTS)
    found = rows.coalesce(parts).mapInArrow(run, "lang string, words int, phrase string, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


def _part(first: int, last) -> F.Column:
    return F.array_join(F.slice("w", first, last), " ")


def best_cut(found: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of the lowest-scoring cut of each phrase."""
    cuts = found.where("words > 1").withColumn("w", F.split("phrase", " ")).select(
        "lang", "words", "phrase", F.col("f").alias("a"), "w",
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", _part(1, F.col("k")).alias("first"),
                       F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("rest"))
    left = found.where("words > 0").select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = left.select("lang", F.col("first").alias("rest"), F.col("l").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(
        "(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    low = scored.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return low.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def inside_longer(found: DataFrame) -> DataFrame:
    """lang, phrase, longer: the largest count of a longer phrase that holds the phrase."""
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), n -> "
        "transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    parts = found.where("words > 2").withColumn("w", F.split("phrase", " ")).select(
        "lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def first_rows(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group and their rank, found in three rounds of smaller shares,
    so no task holds a whole group."""
    shares = shuffle_partitions(rows.sparkSession)
    for n in (shares, math.isqrt(shares - 1) + 1):
        share = Window.partitionBy(group, F.pmod(F.xxhash64("phrase"), F.lit(n))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k)
    last = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= k)


def collocations(
    docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, bits: int = BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the
    language, score is floor(2000000 a / (l + r)). Phrases inside a longer one that occurs at
    least `share` percent as often are left out. A null lang is `und` (and one with it), a null
    text is empty, repeated rows count as often as they are there, ties go by phrase in byte
    order. Texts without words, languages without phrases and an empty table give no rows. Only
    lang and text are read. `bits` sets the size of the bit tables, not the result.
    """
    spark = docs.sparkSession
    ship(spark)
    table, known = None, np.zeros(1 << (bits - 6), np.uint64)
    for lengths in ([1, 2], [3], [4]):
        found = bit_table(frequent(docs, lengths, least, table, bits), bits)
        known |= found
        if table is not None:
            table.unpersist()
        table = spark.sparkContext.broadcast(found)  # 2^bits bits
    table.unpersist()
    found = stored(phrases(docs, spark.sparkContext.broadcast(known), bits, least), "phrases")
    scored = best_cut(found).join(inside_longer(found), ["lang", "phrase"], "left").where(
        f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(share)}")
    ranked = first_rows(scored.drop("longer", "words"), "lang", [F.desc("score"), F.desc("a"), "phrase"], top)
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
