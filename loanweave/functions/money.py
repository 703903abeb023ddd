"""Fixed-point money and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 2)

# Tolerances of the ledger rules (currency units) and of ratio comparisons.
LEDGER_TOLERANCE = "0.01"
RATIO_TOLERANCE = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Exact two-decimal amount, so that sums do not depend on their order."""
    return col(c).cast(MONEY)


def cents(c: Column | str) -> Column:
    """Whole cents, rounded half up."""
    return (money(c) * 100).cast("bigint")


def from_cents(c: Column | str) -> Column:
    """Money of whole cents; sums of cents are 64-bit additions, those of decimals are not."""
    return (col(c).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den in double precision; NULL where the denominator is not positive."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d > 0, n / d)


def ratio_or_zero(num: Column | str, den: Column | str) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def mean(c: Column | str) -> Column:
    """Average of exact values (decimals, integers) as one double division of exact sums."""
    v = col(c)
    return F.when(F.count(v) > 0, F.sum(v).cast("double") / F.count(v))


def sum_if(condition: Column, value: Column | str) -> Column:
    """Conditional sum that is 0, not NULL, when nothing matches."""
    v = col(value)
    return F.sum(F.when(condition, v).otherwise(F.lit(0).cast("decimal(18,2)")))
