"""Token ids of a corpus in Huffman-coded files, and reading them back.

A file holds documents of one range of doc_id in ascending order. Layout, little-endian:

    8 bytes  magic "LWHUFF01"
    u32, u32 number of symbols, size of the packed table; then the table: code lengths, deflated
    blocks   u32 documents, u64 ids, u32 bytes of keys, u64 bytes of bits, u32 checkpoints;
             then keys (doc_id as i64 and a flag for null), ids of each document (u64), bit
             offset of every 256th id (u64), the bits
A block has about BLOCK ids and is decoded without any other; a document longer than that is a
block of its own.

Steps, each a Spark job over all rows: ids are made once and stored, each task with its counts of
ids beside them; the histogram is a sum of one row per id and task, at most the size of the
vocabulary; the code goes to the tasks
(it is bounded by the vocabulary, which is checked); rows are range-partitioned by doc_id and
each partition writes one file. Files are named by the rows Spark commits, so a repeated or
lost attempt leaves nothing that is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm import huffman
from loanweave.llm.store import new_folder, open_file, ship, stored, write_file
from loanweave.llm.text import by_bytes
from loanweave.llm.tokens import SPACED, encoder

MAGIC = b"LWHUFF01"
BLOCK = 1 << 20
HEAD = "<IQIQI"
MAX_VOCABULARY = 1 << 22


def tokenized(docs: DataFrame, tokenizer: str, style: str, end_id: int | None) -> DataFrame:
    """doc_id, number of ids, ids as little-endian unsigned 32-bit integers, deflated; and
    `counts`, on the last row of each task, the ids that the task met and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, style).encode
        total = np.zeros(0, np.int64)
        held = None

        def record(columns: list, counts: bytes | None) -> pa.RecordBatch:
            marks = [None] * (len(columns[0]) - 1) + [counts]
            return pa.RecordBatch.from_arrays([*columns, pa.array(marks, pa.binary())],
                                              names=["doc_id", "n", "ids", "counts"])

        for batch in by_bytes(batches, "text"):
            ids, first = encode([t or "" for t in batch.column("text").to_pylist()], end_id)
            c = np.bincount(ids, minlength=len(total))
            c[: len(total)] += total
            total = c
            raw = memoryview(_narrow(ids))
            size = 2 if len(raw) == 2 * len(ids) else 4
            parts = [bytes([size]) + bytes(raw[a * size : b * size]) for a, b in zip(first[:-1], first[1:])]
            if held:
                yield record(held, None)
            held = [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(parts, pa.binary())]
        if held:
            used = np.flatnonzero(total)
            yield record(held, np.stack([used, total[used]]).astype("<i8").tobytes())

    keys = docs.select(F.col("doc_id").cast("long"), "text")
    return keys.mapInArrow(run, "doc_id long, n long, ids binary, counts binary")


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 65536 else "<u4").tobytes()


def _wide(part: bytes) -> np.ndarray:
    return np.frombuffer(part, "<u2" if part[0] == 2 else "<u4", offset=1).astype(np.uint32)


def histogram(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over all rows, from the counts of the tasks that made them."""

    def run(batches):
        for batch in batches:
            for part in batch.column("counts").to_pylist():
                used, n = np.frombuffer(part, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], names=["id", "n"])

    made = tokens.select("counts").where("counts is not null")
    sums = made.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sums.limit(MAX_VOCABULARY + 1).toPandas()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError("more distinct ids than a vocabulary has")
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write(tokens: DataFrame, folder: str, lengths: np.ndarray, files: int) -> DataFrame:
    """Write the files; a row for each: number in doc_id order, path, bytes, documents, ids."""
    packed = zlib.compress(lengths.tobytes(), 9)

    def run(batches):
        codes = huffman.canonical(lengths)
        found = {"cell": 0, "docs": 0, "ids": 0}

        def block(keys, parts, n):
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            bits, marks = huffman.encode(ids, codes, lengths)
            plain = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([k is None for k in keys], np.uint8).tobytes()
            return b"".join([struct.pack(HEAD, len(keys), len(ids), len(plain), len(bits), len(marks)), plain,
                             np.array(n, "<u8").tobytes(), marks.tobytes(), bits])

        def chunks():
            yield MAGIC + struct.pack("<II", len(lengths), len(packed)) + packed
            keys, parts, n, held = [], [], [], 0
            for batch in batches:
                for cell, key, part in zip(batch.column("cell").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                    ids = _wide(part)
                    if held and held + len(ids) > BLOCK:
                        yield block(keys, parts, n)
                        keys, parts, n, held = [], [], [], 0
                    keys.append(key)
                    parts.append(ids)
                    n.append(len(ids))
                    held += len(ids)
                    found["cell"] = cell
                    found["docs"] += 1
                    found["ids"] += len(ids)
            if keys:
                yield block(keys, parts, n)

        first = next(batches, None)
        if first is None:
            return
        batches = _again(first, batches)
        path, size = write_file(folder, "ids", chunks())
        if found["docs"]:
            yield pa.RecordBatch.from_pylist([{
                "cell": found["cell"], "path": path, "bytes": size, "docs": found["docs"], "ids": found["ids"]}])

    ranged = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(
        files, F.col("doc_id").asc_nulls_last(), F.col("tie"))
    ranged = ranged.withColumn("cell", F.spark_partition_id()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_last(), "tie")
    return ranged.select("cell", "doc_id", "ids").mapInArrow(
        run, "cell long, path string, bytes long, docs long, ids long")


def _again(first, rest):
    yield first
    yield from rest


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, ids of all documents before it, number of ids and their crc32, from the files.

    `manifest` has a row for each file: path and `before`, the ids of all earlier files.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(folder, row["path"], row["before"])

    return manifest.select("path", "before").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def blocks(folder: str, path: str):
    """Keys, their ids' counts and the ids, block by block."""
    with open_file(folder, path) as f:
        if f.read(8) != MAGIC:
            raise ValueError("not a file of this format")
        symbols, size = struct.unpack("<II", f.read(8))
        lengths = np.frombuffer(zlib.decompress(f.read(size)), np.uint8)
        if len(lengths) != symbols:
            raise ValueError("the table of code lengths is damaged")
        table = huffman.decode_table(lengths)
        while head := f.read(struct.calcsize(HEAD)):
            docs, ids, keys, bits, marks = struct.unpack(HEAD, head)
            plain = f.read(keys)
            n = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
            at = np.frombuffer(f.read(8 * marks), "<u8")
            null = np.frombuffer(plain, np.uint8, docs, 8 * docs).astype(bool)
            yield np.frombuffer(plain, "<i8", docs), null, n, huffman.decode(f.read(bits), at, ids, table)


def _read_file(folder, path, before):
    for key, null, n, ids in blocks(folder, path):
        ends = np.cumsum(n)
        ids = ids.astype("<u4")
        crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends, n)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, mask=null), pa.array(before + ends - n), pa.array(n), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])
        before += int(ends[-1]) if len(ends) else 0


def round_trip(
    docs: DataFrame, tokenizer: str, style: str = SPACED, end_id: int | None = 0,
    files: int | None = None,
) -> DataFrame:
    """Encode all documents, write the files to the shared folder and read them back.

    Null and empty texts have the end id alone. Repeated rows are written once each; rows of one
    doc_id follow each other in the order of a hash of their ids. A null doc_id comes last. An
    empty table writes no file and gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    tokens = stored(tokenized(docs, tokenizer, style, end_id), "ids")
    counts = histogram(tokens)
    lengths = huffman.code_lengths(counts)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "huffman")
    manifest = stored(write(tokens, folder, lengths, files), "manifest")
    # A row for each file; at most as many as partitions were asked for.
    rows = sorted(manifest.select("cell", "path", "ids").collect())
    before, at = [], 0
    for r in rows:
        before.append((r.path, at))
        at += r.ids
    schema = "path string, before long"
    listed = spark.createDataFrame(before, schema) if before else spark.createDataFrame([], schema)
    return read(listed.repartition(max(1, len(before))), folder)
