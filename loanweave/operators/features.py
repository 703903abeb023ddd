"""Behavioural features, splits, batch numbers, leakage guards and stress edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.functions.numeric import (
    longest_run,
    row_count,
    row_mean,
    row_std,
    row_sum,
    safe_ratio,
)
from loanweave.operators.replicates import normal, uniform
from loanweave.operators.scan import positions

# Input columns of the public credit-default layout, most recent month first.
LIMIT = "X1"
DELINQUENCY = ("X6", "X7", "X8", "X9", "X10", "X11")
BILLS = ("X12", "X13", "X14", "X15", "X16", "X17")
PAID = ("X18", "X19", "X20", "X21", "X22", "X23")
RATIO_CAP = 5.0
TINY = 1e-9

FEATURES = (
    "max_delinquency_status", "months_delinquent_count", "most_recent_delinquency_status",
    "delinquency_trend", "consecutive_months_delinquent", "total_bill_amount",
    "avg_bill_amount", "bill_trend", "bill_variability", "utilization_ratio",
    "total_payment_amount", "avg_payment_amount", "payment_to_bill_ratio",
    "months_without_payment", "payment_coverage_rate", "payment_variation",
    "worst_payment_to_bill_ratio", "limit_exposure_distance",
)


def behavioural_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The eighteen features of each row, all doubles; no shuffle."""
    def cols(names: Sequence[str]) -> list[Column]:
        return [F.col(n).cast("double") for n in names]

    late, bill, paid = cols(DELINQUENCY), cols(BILLS), cols(PAID)
    limit = F.col(LIMIT).cast("double")
    bills, pays = row_sum(bill), row_sum(paid)
    avg_bill, avg_paid = row_mean(bill), row_mean(paid)
    # A payment covers the bill of the month before; a bill at or below zero counts as covered.
    pairs = list(zip(paid[:5], bill[1:]))
    ratios = [
        F.when(b > TINY, F.greatest(safe_ratio(p, b, RATIO_CAP), F.lit(0.0)))
        .otherwise(RATIO_CAP) for p, b in pairs
    ]
    values = {
        "max_delinquency_status": F.greatest(*late),
        "months_delinquent_count": row_count([x > 0 for x in late]),
        "most_recent_delinquency_status": late[0],
        "delinquency_trend": (late[0] - late[-1]) / 5.0,
        "consecutive_months_delinquent": longest_run([x > 0 for x in late]),
        "total_bill_amount": bills,
        "avg_bill_amount": avg_bill,
        "bill_trend": (bill[0] - bill[-1]) / 5.0,
        "bill_variability": row_std(bill),
        "utilization_ratio": safe_ratio(avg_bill, limit, RATIO_CAP),
        "total_payment_amount": pays,
        "avg_payment_amount": avg_paid,
        "payment_to_bill_ratio": F.when(
            bills > TINY, F.greatest(safe_ratio(pays, bills, RATIO_CAP), F.lit(0.0))
        ).otherwise(RATIO_CAP),
        "months_without_payment": row_count([x == 0 for x in paid]),
        "payment_coverage_rate": row_count([(p >= b) | (b <= TINY) for p, b in pairs]) / 5.0,
        "payment_variation": row_std(paid) / (F.abs(avg_paid) + TINY),
        "worst_payment_to_bill_ratio": F.least(*ratios),
        "limit_exposure_distance": safe_ratio(limit - avg_bill, limit, RATIO_CAP),
    }
    return df.select(*keep, *[values[f].cast("double").alias(f) for f in FEATURES])


# --- guards ----------------------------------------------------------------------------

# Attributes that are never features.
RESTRICTED = ("X2", "X3", "X4", "X5", "sex", "education", "marriage", "age", "gender", "region",
              "age_bracket", "synthetic_gender")


class LeakageError(ValueError):
    """A training frame holds something a model may not see."""


def check_training_columns(columns: Sequence[str], target: str, ids: Sequence[str],
                           allowed: Sequence[str] = FEATURES) -> None:
    bad = {
        "target": [c for c in columns if c == target],
        "identifier": [c for c in columns if c in ids],
        "restricted": [c for c in columns if c in RESTRICTED],
        "unregistered": [c for c in columns if c not in allowed],
    }
    found = {k: v for k, v in bad.items() if v}
    if found:
        raise LeakageError(f"not allowed in a training frame: {found}")


# --- order by hash ---------------------------------------------------------------------


def hash_order(ident: Column | str, seed: int) -> Column:
    """52-bit number that orders ids at random, the same everywhere."""
    c = F.col(ident) if isinstance(ident, str) else ident
    text = F.md5(F.concat_ws(":", F.lit(seed), c))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, ident: str, target: str,
                     shares: Mapping[str, float], seed: int = 1) -> DataFrame:
    """Adds `split`: rows of each class are put in hash order and cut at cumulative shares."""
    if abs(sum(shares.values()) - 1.0) > 1e-9:
        raise ValueError("split shares must sum to 1")
    placed = positions(df.withColumn("_h", hash_order(ident, seed)), [target], "_h", ident,
                       "_pos", "_size")
    at = (F.col("_pos") - 1) / F.col("_size")
    label, upto = None, 0.0
    for name, share in list(shares.items())[:-1]:
        upto += share
        label = F.when(at < upto, name) if label is None else label.when(at < upto, name)
    last = list(shares)[-1]
    label = F.lit(last) if label is None else label.otherwise(last)
    return placed.withColumn("split", label).drop("_h", "_pos", "_size")


def split_manifest(split: DataFrame, ident: str, target: str) -> DataFrame:
    """Rows, prevalence and an order-free id fingerprint per part."""
    value = F.conv(F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 15), 16, 10)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(target).cast("double")).alias("prevalence"),
        F.sum(value.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias("id_hash"),
    )


def apply_split(df: DataFrame, assignment: DataFrame, ident: str) -> DataFrame:
    """Joins a stored assignment; a row without one is an error, raised when it is read."""
    joined = df.join(assignment.select(ident, "split"), ident, "left")
    missing = F.raise_error(F.concat(F.lit("no split for id "), F.col(ident).cast("string")))
    return joined.withColumn(
        "split", F.when(F.col("split").isNull(), missing.cast("string")).otherwise(F.col("split"))
    )


def folds(df: DataFrame, ident: str, target: str, k: int, seed: int = 2) -> DataFrame:
    """Adds `fold` 0..k-1, balanced inside each class."""
    placed = positions(df.withColumn("_h", hash_order(ident, seed)), [target], "_h", ident,
                       "_pos", "_size")
    return placed.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop(
        "_h", "_pos", "_size")


def number_batches(df: DataFrame, ident: str, size: int) -> DataFrame:
    """Adds batch_sequence: rows in id order, cut into equal slices."""
    placed = positions(df, [], ident, ident, "_pos", "_size")
    return placed.withColumn(
        "batch_sequence", (F.floor((F.col("_pos") - 1) / size) + 1).cast("int")
    ).drop("_pos", "_size")


def shuffle_column(df: DataFrame, ident: str, column: str, seed: int) -> DataFrame:
    """Gives every row the value of another row: rows in id order meet rows in hash order."""
    here = positions(df, [], ident, ident, "_pos", "_size").drop("_size")
    hashed = df.select(F.col(ident).alias("_id"), F.col(column).alias("_new"),
                       hash_order(ident, seed).alias("_h"))
    there = positions(hashed, [], "_h", "_id", "_pos", "_size").select("_pos", "_new")
    return here.join(there, "_pos").withColumn(column, F.col("_new")).drop("_pos", "_new")


def negative_controls(df: DataFrame, ident: str, target: str, seed: int = 4) -> DataFrame:
    """Features that must score about 0.5, about 1 and about 0.5: a shuffled target, the
    target with a little noise, and the id alone."""
    shuffled = shuffle_column(df.withColumn("control_shuffled", F.col(target).cast("double")),
                              ident, "control_shuffled", seed)
    return shuffled.withColumn(
        "control_leak", F.col(target).cast("double") + 0.01 * normal(F.col(ident), seed)
    ).withColumn("control_id", F.col(ident).cast("double"))


# --- stress edits ----------------------------------------------------------------------


def _scale(df: DataFrame, names: Sequence[str], factor: float) -> DataFrame:
    return df.withColumns({n: F.col(n) * factor for n in names})


def _some(ident: str, share: float, seed: int, *tag: str) -> Column:
    return uniform(F.col(ident), seed, *tag) < share


def perturb(df: DataFrame, kind: str, ident: str, strength: float, target: str | None = None,
            seed: int = 6) -> DataFrame:
    """One stress edit of raw input rows; `strength` is its share, factor or step.

    Which rows change is decided by a hash of their id, so the edit is repeatable.
    """
    if kind == "missingness":
        names = (*DELINQUENCY, *BILLS, *PAID)
        return df.withColumns(
            {n: F.when(~_some(ident, strength, seed, n), F.col(n)) for n in names})
    if kind == "outliers":
        hit = _some(ident, strength, seed, "outlier")
        return df.withColumns(
            {n: F.when(hit, F.col(n) * 10).otherwise(F.col(n)) for n in BILLS})
    if kind == "utilisation":
        return _scale(df, BILLS, 1 + strength)
    if kind == "delinquency":
        return df.withColumns(
            {n: F.least(F.col(n) + int(strength), F.lit(9)) for n in DELINQUENCY})
    if kind == "payment":
        return _scale(df, PAID, 1 - strength)
    if kind == "noise":
        return df.withColumns({
            n: F.col(n) + strength * F.abs(F.col(n)) * normal(F.col(ident), seed, n)
            for n in (*BILLS, *PAID)})
    if kind == "out_of_domain":
        hit = _some(ident, strength, seed, "domain")
        return df.withColumn(DELINQUENCY[0],
                             F.when(hit, 99).otherwise(F.col(DELINQUENCY[0])))
    if kind in ("prevalence_up", "prevalence_down") and target is not None:
        # Thins one class by a hash, the other stays whole: the edit is the drift itself.
        thinned = 0 if kind == "prevalence_up" else 1
        return df.filter((F.col(target) != thinned) | _some(ident, 1 - strength, seed, "class"))
    raise ValueError(f"unknown edit {kind!r}")


EDITS = ("missingness", "outliers", "utilisation", "delinquency", "payment", "prevalence_up",
         "prevalence_down", "noise", "out_of_domain")
