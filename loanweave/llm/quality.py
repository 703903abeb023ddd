"""Quality classifier: ridge regression on random Fourier features of document statistics.

1. Statistics of each whole text (`STATISTICS`), one row of numbers a document, stored once.
2. Labelled rows: means and scales in one aggregate, then features cos(w.x + b) with w drawn
   from a normal law, so that inner products approximate a Gaussian kernel. Each task sums
   X'X and X'y over its rows; Spark adds the sums up row of the matrix by row of the matrix,
   so what reaches the driver is a matrix of fixed size.
3. Isotonic calibration on labelled rows that the fit has not seen: counts of labels on a
   fixed grid of raw scores, pooled where they violate the order, joined by straight lines.

Everything that grows with the corpus stays in tasks; the model is a few hundred kilobytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.store import ship, stored
from loanweave.llm.text import SPACE, by_bytes, run_hashes, text_buffers, word_bounds, word_hashes

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "digits", "marks", "spaces",
    "lines", "wide", "exclamations", "stops", "commas", "brackets", "distinct_words",
    "repeated_word", "top_word", "distinct_pairs", "line_bytes", "repeated_byte", "long_words",
    "byte_entropy",
)
FOLDS = 5
GRID = 1024


def _share(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    done = np.concatenate([[0], np.cumsum(flag)])
    return done[off[1:]] - done[off[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows of STATISTICS; an empty text is a row of zeros but for the distinct shares of 1."""
    raw, off = text_buffers(texts)
    n = np.diff(off)
    size = np.maximum(n, 1)
    starts, ends = word_bounds(raw, off)
    hashes, first = word_hashes(raw, off)
    words = np.diff(first)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    in_doc = np.repeat(np.arange(len(n)), words)

    def total(x):
        return np.bincount(in_doc, x, len(n))

    mean = total(length) / some
    spread = np.sqrt(np.maximum(total(length**2) / some - mean**2, 0))

    def repeats(values, doc, count):
        """Share of distinct values, and of the most frequent one, in each text."""
        order = np.lexsort((values, doc))
        v, d = values[order], doc[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.concatenate([at, [len(v)]]))
        most = np.zeros(len(n))
        np.maximum.at(most, d[at], runs)
        count = np.maximum(count, 1)
        return np.where(count > 0, np.bincount(d[at], minlength=len(n)) / count, 1), most / count

    distinct, top = repeats(hashes, in_doc, words)
    pairs, before = run_hashes(hashes, first, 2)
    pair_doc = np.repeat(np.arange(len(n)), np.diff(before))
    distinct_pairs, _ = repeats(pairs, pair_doc, np.diff(before))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (in_doc[1:] == in_doc[:-1])
    same_byte = np.zeros(len(raw), bool)
    same_byte[1:] = (raw[1:] == raw[:-1]) & ~SPACE[raw[1:]]
    upper = (raw >= 65) & (raw <= 90)
    letters = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    digits = (raw >= 48) & (raw <= 57)
    space = SPACE[raw]
    lines = _share(raw == 10, off) + (n > 0)
    kinds = np.minimum(raw >> 3, 31)
    doc_of = np.repeat(np.arange(len(n)), n)
    table = np.bincount(doc_of * 32 + kinds, minlength=32 * len(n)).reshape(-1, 32) / size[:, None]
    entropy = -(table * np.log(np.maximum(table, 1e-12))).sum(axis=1)
    one = lambda flag: _share(flag, off) / size
    brackets = np.isin(raw, np.frombuffer(b"()[]{}<>=#*&%$@\\|~^_/", np.uint8))
    return np.column_stack([
        np.log1p(n), np.log1p(words), mean, spread, one(upper), one(digits),
        one(~(letters | digits | space)), one(space), lines / size, one(raw >= 128),
        one(raw == 33), one(raw == 46), one(raw == 44), one(brackets), distinct,
        total(same) / some, top, distinct_pairs, np.log1p(n / np.maximum(lines, 1)),
        one(same_byte), total(length > 20) / some, entropy,
    ])


@dataclass(frozen=True)
class Model:
    """What a fit leaves: scales, random directions, ridge weights and the calibration line."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features(x, self) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(np.clip(self.raw(x), 0, 1), self.knots, self.values)


def features(x: np.ndarray, m: Model) -> np.ndarray:
    z = np.clip((x - m.mean) / m.scale, -6, 6)
    out = np.cos(z @ m.directions + m.shifts)
    return np.column_stack([np.ones(len(x)), out, z])


def pooled(ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Nondecreasing shares closest to ones / rows (pool adjacent violators)."""
    stack: list[list[float]] = []
    for a, b in zip(ones, rows):
        stack.append([a, b, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            a2, b2, k2 = stack.pop()
            stack[-1][0] += a2
            stack[-1][1] += b2
            stack[-1][2] += k2
    return np.concatenate([np.full(k, a / b) for a, b, k in stack]) if stack else np.zeros(0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's text, stored."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            x = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    keys = docs.select(F.col("doc_id").cast("long"), "text")
    return stored(keys.mapInArrow(run, "doc_id long, x array<double>"), "statistics")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def fold() -> F.Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def label_table(labels: DataFrame) -> DataFrame:
    """One label a document: 1 if at least half of its non-null labels are 1."""
    q = F.col("quality")
    known = labels.where(q.isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.when(F.avg(q) >= 0.5, 1.0).otherwise(0.0).alias("y"))


def fit(x: DataFrame, labels: DataFrame, width: int = 256, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """Learn from every labelled row outside fold 0; fold 1 calibrates, the others fit.

    None if no such row has a label.
    """
    known = stored(
        x.join(label_table(labels), "doc_id").withColumn("fold", fold().cast("int"))
        .where("fold <> 0").select("x", "y", "fold"), "labelled")
    d = len(STATISTICS)
    moments = known.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    if not moments.n:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    scale = np.array([moments[f"s{i}"] for i in range(d)])
    model = Model(
        np.array([moments[f"m{i}"] for i in range(d)]), np.where(scale > 1e-9, scale, 1.0),
        rng.standard_normal((d, width)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, width),
        np.zeros(0), np.zeros(0), np.zeros(0))
    k = width + d + 1

    def sums(batches):
        xx, xy = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            f = features(_matrix(batch), model)
            xx += f.T @ f
            xy += f.T @ batch.column("y").to_numpy()
        rows = np.column_stack([xx, xy])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * (k + 1)), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int64)), lists], names=["i", "v"])

    train = known.where("fold > 1") if known.where("fold > 1").limit(1).count() else known
    parts = train.select("x", "y").coalesce(64).mapInArrow(sums, "i long, v array<double>")
    total = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(k + 1)]).orderBy("i").toPandas()
    system = total.drop(columns="i").to_numpy()
    xx, xy = system[:, :k], system[:, k]
    penalty = np.full(k, ridge * max(xx[0, 0], 1.0))
    penalty[0] = 1e-9
    weights = np.linalg.solve(xx + np.diag(penalty), xy)
    model = Model(model.mean, model.scale, model.directions, model.shifts, weights, np.zeros(0), np.zeros(0))

    def raw(batches):
        for batch in batches:
            cell = np.floor(np.clip(model.raw(_matrix(batch)), 0, 1) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")], names=["cell", "y"])

    calibration = known.where("fold = 1") if known.where("fold = 1").limit(1).count() else known
    grid = (calibration.select("x", "y").mapInArrow(raw, "cell long, y double").groupBy("cell")
            .agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("cell").toPandas())
    values = pooled(grid["ones"].to_numpy(), grid["n"].to_numpy(float))
    return Model(model.mean, model.scale, model.directions, model.shifts, weights,
                 (grid["cell"].to_numpy() + 0.5) / GRID, values)


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, width: int = 256,
    x: DataFrame | None = None,
) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`.

    Null texts count as empty and are scored. Repeated rows are scored once each. Labels that
    are null or neither 0 nor 1 are ignored; several labels of one document are put together
    by majority. A null doc_id is never labelled and is held out. With no label at all every
    score is 0.5. An empty table gives no rows. Other columns are not read.
    """
    x = measured(docs) if x is None else x
    model = fit(x, labels, width)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            s = model.score(_matrix(batch)) if model is not None and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    scored = x.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, columns unchanged.

    The score depends on the text alone, so it is computed where the text is: no join.
    """
    ship(docs.sparkSession)
    model = fit(measured(docs), labels)
    if model is None:
        return docs
    schema = docs.schema

    def run(batches):
        for batch in by_bytes(batches, "text"):
            good = model.score(statistics(batch.column("text"))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, schema)


def crc_fold(doc_id: int | None) -> int:
    """`fold` for one id, for tests and single look-ups."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS
