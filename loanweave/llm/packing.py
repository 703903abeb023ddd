"""Packing by power-of-two decomposition.

Each document's ids are cut into the longest power-of-two pieces not above the sequence length
(whole sequences first, then the binary digits of what is left). Pieces of one length form a
bucket; each is a sequence of its own, so no sequence crosses documents and none is padded.

The work is a map over the rows: nothing is shuffled, whatever key a third of the rows share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from loanweave.llm.store import ship
from loanweave.llm.text import by_bytes
from loanweave.llm.tokens import DROPPED, encoder


def pieces_of(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces of texts of n ids, in order, and the number of pieces of each."""
    digits = np.array([1 << b for b in range(longest.bit_length() - 2, -1, -1)], np.int64)
    full = n // longest
    rest = (n % longest)[:, None] & digits[None, :]
    table = np.concatenate([np.full((len(n), 1), longest), rest], axis=1)
    times = np.concatenate([full[:, None], (rest > 0).astype(np.int64)], axis=1)
    return np.repeat(table.ravel(), times.ravel()), times.sum(axis=1)


def pack(
    docs: DataFrame, tokenizer: str, style: str = DROPPED, end_id: int = 2,
    longest: int = 4096, with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, bucket (the power
    of two), sequence_id, offset, and the ids themselves if asked for.

    A null or empty text has the end id alone and gives one piece of length 1. Repeated rows
    are packed once each. An empty table gives no rows. Columns other than doc_id and text are
    not read, so their names cannot clash. `longest` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    ship(docs.sparkSession)
    fields = [docs.select("doc_id").schema[0]]
    fields += [StructField(c, LongType(), False) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [StructField("bucket", IntegerType(), False)]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType(), False), False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, style).encode
        for batch in by_bytes(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, first = encode(texts, end_id)
            ids = ids.astype("<u4")
            n = np.diff(first)
            length, times = pieces_of(n, longest)
            ends = np.cumsum(length)
            crc = np.fromiter((zlib.crc32(ids[e - k : e]) for e, k in zip(ends, length)), np.int64, len(ends))
            row = np.repeat(np.arange(len(n)), times)
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(ends - length - first[row]), pa.array(length), pa.array(crc),
                pa.array(n[row]), pa.array(np.log2(length).astype(np.int32)),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    pieces = docs.select("doc_id", "text").mapInArrow(cut, StructType(fields))
    return pieces.withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder for each length: a training job reads batches of one
    length. Buckets are spread over tasks as the pieces are; none is gathered."""
    pieces.write.partitionBy("bucket").parquet(path)
