"""Random replicates from hashes: reproducible, independent of partitioning and order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL, LARGE = 2.5, 30.0


def uniform(*parts: Column | int | str) -> Column:
    """Number in (0, 1) that depends only on the given values."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    # 52 bits of the hash, shifted off zero.
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def normal(*parts: Column | int | str) -> Column:
    """Standard normal number (Box-Muller)."""
    radius = F.sqrt(-2.0 * F.log(uniform(*parts, "a")))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(*parts, "b"))


def poisson(mean: Column, *parts: Column | int | str) -> Column:
    """Poisson draw; large means use the rounded normal law of the same mean and variance."""
    u = uniform(*parts)
    start = F.struct(
        F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("cdf")
    )

    def step(s: Column, i: Column) -> Column:
        more = u > s["cdf"]
        term = F.when(more, s["term"] * mean / i).otherwise(s["term"])
        return F.struct(
            F.when(more, s["k"] + 1).otherwise(s["k"]).alias("k"),
            term.alias("term"),
            F.when(more, s["cdf"] + term).otherwise(s["cdf"]).alias("cdf"),
        )

    def inverse(limit: int) -> Column:
        # The chance of a value beyond the limit is below 1e-9 for the means it is used for.
        return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step, lambda s: s["k"])

    big = F.greatest(F.round(mean + F.sqrt(mean) * normal(*parts)), F.lit(0.0)).cast("bigint")
    drawn = (
        F.when(mean <= 0, F.lit(0))
        .when(mean < SMALL, inverse(18))
        .when(mean < LARGE, inverse(80))
        .otherwise(big)
    )
    return drawn.cast("bigint")


def with_replicates(df: DataFrame, n: int, name: str = "replicate") -> DataFrame:
    """One copy of each (already compressed) row per replicate number 1..n."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))
