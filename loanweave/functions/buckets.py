"""Closed vocabularies: delinquency buckets, sample tiers, bands and label maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.functions.money import col

# Bucket labels with their inclusive day bounds.
# (label, first day, last day, sort order, delinquent, terminal)
DPD_BUCKETS = (
    ("current", 0, 0, 1, False, False),
    ("1-29", 1, 29, 2, True, False),
    ("30-59", 30, 59, 3, True, False),
    ("60-89", 60, 89, 4, True, False),
    ("90+", 90, None, 5, True, False),
    ("write_off", None, None, 6, False, True),
)
BUCKET_ORDER = tuple(b[0] for b in DPD_BUCKETS)
AT_LEAST_30 = ("30-59", "60-89", "90+")
AT_LEAST_60 = ("60-89", "90+")
AT_LEAST_90 = ("90+",)

# Sample-size tiers, from the weakest up.
MIN_SEGMENT = 30
ADEQUATE_SEGMENT = 100
TIERS = ("insufficient", "limited", "adequate")

# Collection strategies by the first day count they no longer cover.
STRATEGIES = ((30, "early_stage_soft"), (90, "mid_stage_firm"))
LAST_STRATEGY = "late_stage_hard"

TERMINAL_STATUSES = ("settled", "closed", "charged_off")


def cut(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label by upper edges: value < edges[i] gives labels[i], the rest the last label."""
    v = col(c)
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(v < edge, label) if out is None else out.when(v < edge, label)
    return F.when(v.isNotNull(), out.otherwise(labels[-1]))


def dpd_bucket(dpd: Column | str) -> Column:
    """Whole days past due to bucket label."""
    return cut(dpd, (1, 30, 60, 90), BUCKET_ORDER[:5])


def bucket_dimension(spark: SparkSession) -> DataFrame:
    """The six-row bucket lookup; its size is fixed, so callers may broadcast it."""
    rows = [(i + 1, *b) for i, b in enumerate(DPD_BUCKETS)]
    return spark.createDataFrame(
        rows,
        "dpd_bucket_key int, dpd_bucket string, dpd_min int, dpd_max int, "
        "sort_order int, is_delinquent boolean, is_terminal boolean",
    )


def sample_tier(n: Column | str) -> Column:
    v = F.coalesce(col(n), F.lit(0))
    return (
        F.when(v < MIN_SEGMENT, TIERS[0]).when(v < ADEQUATE_SEGMENT, TIERS[1]).otherwise(TIERS[2])
    )


def worst_tier(*sizes: Column | str) -> Column:
    """Tier of the smallest of several samples."""
    return sample_tier(F.least(*[F.coalesce(col(s), F.lit(0)) for s in sizes]))


def range_label(c: Column | str, bounds: Sequence[tuple[int, int]]) -> Column:
    """Half-open ranges [lo, hi) as 'lo-hi'; anything else is 'out_of_range'."""
    v = col(c)
    out = F.when(F.lit(False), F.lit(""))
    for lo, hi in bounds:
        out = out.when((v >= lo) & (v < hi), f"{lo}-{hi}")
    return out.otherwise("out_of_range")


def code_label(c: Column | str, labels: Mapping[object, str], unknown: str) -> Column:
    """Dictionary lookup with a default label."""
    pairs = [F.lit(x) for kv in labels.items() for x in (str(kv[0]), kv[1])]
    return F.coalesce(F.create_map(*pairs)[col(c).cast("string")], F.lit(unknown))


def risk_band(p: Column | str, cuts: Sequence[float] = (0.1, 0.25, 0.5)) -> Column:
    """Probability to band; each cut belongs to the lower band."""
    v = col(p)
    names = ("low", "medium", "high", "very_high")
    out = F.when(v <= cuts[0], names[0])
    for edge, name in zip(cuts[1:], names[1:]):
        out = out.when(v <= edge, name)
    return F.when(v.isNotNull(), out.otherwise(names[-1]))


def collection_strategy(dpd: Column | str) -> Column:
    return cut(dpd, [s[0] for s in STRATEGIES], [s[1] for s in STRATEGIES] + [LAST_STRATEGY])
