"""Scalar numeric helpers that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanweave.functions.money import col

PROBABILITY_FLOOR = 1e-6
SHARE_FLOOR = 1e-6
DENOMINATOR_FLOOR = 1e-9


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounded value; NULL stays NULL (greatest/least alone would replace it)."""
    v = col(c)
    out = v
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(v.isNotNull(), out)


def clipped_probability(p: Column | str) -> Column:
    return clip(p, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)


def logit(p: Column | str) -> Column:
    q = clipped_probability(p)
    return F.log(q / (1 - q))


def safe_ratio(num: Column | str, den: Column | str, cap: float | None = None) -> Column:
    """num/den, 0 where the denominator vanishes or an input is missing, bounded by +-cap."""
    n, d = col(num).cast("double"), col(den).cast("double")
    value = F.coalesce(F.when(F.abs(d) > DENOMINATOR_FLOOR, n / d), F.lit(0.0))
    return clip(value, -cap, cap) if cap is not None else value


def row_sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_mean(cols: Sequence[Column]) -> Column:
    return row_sum(cols) / len(cols)


def row_std(cols: Sequence[Column]) -> Column:
    """Population standard deviation across columns."""
    m = row_mean(cols)
    return F.sqrt(row_sum([(c - m) * (c - m) for c in cols]) / len(cols))


def row_count(conditions: Sequence[Column]) -> Column:
    return row_sum([F.when(c, 1).otherwise(0) for c in conditions])


def longest_run(conditions: Sequence[Column]) -> Column:
    """Longest streak of true values, left to right."""
    flags = F.array(*[F.coalesce(c, F.lit(False)) for c in conditions])
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, hit: Column) -> Column:
        run = F.when(hit, state["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(flags, start, step, lambda s: s["best"])


def nearest_rank(values: Column | str, p: float) -> Column:
    """Observed value at position round(p*(n-1)) (half to even) of an array of bounded length."""
    a = F.array_sort(col(values))
    return F.element_at(a, F.bround(F.lit(p) * (F.size(a) - 1), 0).cast("int") + 1)


def entropy_term(p: Column, m: Column) -> Column:
    """p * log2(p / m) with 0 log 0 = 0."""
    return F.when((p > 0) & (m > 0), p * F.log2(p / m)).otherwise(0.0)


def equal_width_bin(v: Column | str, lo: Column, hi: Column, n: int) -> Column:
    """1-based bin on [lo, hi]; the last bin is closed, values outside give NULL."""
    x = col(v)
    width = (hi - lo) / n
    idx = F.least(F.floor((x - lo) / width) + 1, F.lit(n)).cast("int")
    return F.when((x >= lo) & (x <= hi), F.when(hi > lo, idx).otherwise(F.lit(1)))
