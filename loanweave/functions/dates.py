"""Calendar arithmetic on months and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.functions.money import col


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c).cast("date"), "MM")


def month_end(c: Column | str) -> Column:
    return F.last_day(col(c).cast("date"))


def months_apart(start: Column | str, end: Column | str) -> Column:
    """Number of month boundaries between two dates."""
    s, e = col(start), col(end)
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("int")


def days_apart(start: Column | str, end: Column | str) -> Column:
    return F.datediff(col(end), col(start))


def month_key(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyyMM").cast("int")


def month_sequence(first: Column | str, last: Column | str) -> Column:
    """Array of month starts from the month of `first` to the month of `last`."""
    lo, hi = month_start(first), month_start(last)
    # An inverted range gives an empty array instead of counting backwards.
    return F.when(lo <= hi, F.sequence(lo, hi, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )


def calendar_months(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Month spine between the smallest `first` and the largest `last`."""
    span = bounds.agg(F.min(first).alias("lo"), F.max(last).alias("hi"))
    m = F.col("month_start")
    return span.select(F.explode(month_sequence("lo", "hi")).alias("month_start")).select(
        m,
        F.last_day(m).alias("month_end"),
        F.year(m).alias("calendar_year"),
        F.month(m).alias("calendar_month"),
    )
