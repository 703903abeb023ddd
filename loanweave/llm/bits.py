"""Counts of 64-bit fingerprints over all tasks, and bit tables of fixed size made from them.

A bit table is a filter: it may let a fingerprint through that is not in the set, so whoever uses
it must get the same result then; it never holds one back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.store import drop, stored

FLUSH = 4 << 20  # fingerprints that a task gathers before it counts them
COUNTS = "print long, n long"


def counted(parts: Iterable[np.ndarray], flush: int | None = None) -> Iterator[pa.RecordBatch]:
    """print, n: the distinct fingerprints of a task's arrays, some millions at a time."""

    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n)], names=["print", "n"])

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= (flush or FLUSH):
            yield batch(held)
            held, size = [], 0
    if size:
        yield batch(held)


def at_least(counts: DataFrame, least: int) -> DataFrame:
    """print, n of the fingerprints with at least this total. Tasks have counted already; dealing
    the rows out first saves a second, useless count there."""
    return counts.repartition("print").groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def bit_table(prints: DataFrame, bits: int) -> np.ndarray:
    """Bits at the leading bits of the fingerprints; 2^bits of them at most, in words of 64."""
    prints = stored(prints.select("print"), "prints")  # the shuffle behind it ends with this job
    words = prints.groupBy(F.shiftrightunsigned("print", 64 - bits + 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - bits}) & 63 as int))")).alias("bits"))
    rows = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    drop(prints)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def holds(table: np.ndarray, prints: np.ndarray, bits: int) -> np.ndarray:
    place = prints >> np.uint64(64 - bits)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
