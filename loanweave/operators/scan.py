"""Ordered scans (running totals, last value, next value) that split hot groups.

A plain window puts a whole group on one task. Here rows are range-partitioned along
(group, order), every part is scanned on its own, and what must be carried from
earlier parts is computed on one summary row per group and part. Only the first and the
last group of a part can go on in another one, so that summary has at most two rows a
part: it is sent to the rows, which are shuffled once. A group that holds
most of the rows is thereby spread over many tasks, and so is a single order value:
rows that tie are spread by the tie-break column and a hash of the row. Spark chooses
the ranges from the data and merges small ones, so there is one algorithm for all
sizes. NULL order values come last in both directions, NaN just before them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, MapType

from loanweave.session import kept


@dataclass
class Scan:
    """What to compute along the order.

    sums:   output name -> column name, inclusive running total
    lasts:  output name -> column name, last non-null value up to and including the row
    leads:  output name -> column name, value of the next row (its last row gives NULL)
    totals: output name -> column name, total of the whole group
    """

    sums: Mapping[str, str] = field(default_factory=dict)
    lasts: Mapping[str, str] = field(default_factory=dict)
    leads: Mapping[str, str] = field(default_factory=dict)
    totals: Mapping[str, str] = field(default_factory=dict)


def _order(df: DataFrame, value: str, tie: str | None, descending: bool) -> list[Column]:
    v = F.col(value)
    order = [v.desc_nulls_last() if descending else v.asc_nulls_last()]
    if isinstance(df.schema[value].dataType, (DoubleType, FloatType)):
        order.insert(0, F.when(v.isNull(), 2).when(F.isnan(v), 1).otherwise(0).asc())
    if tie:
        order.append(F.col(tie).asc_nulls_last())
    return [*order, F.col("_spread").asc()]


def place(
    df: DataFrame, group: Sequence[str], order: list[Column], cells: int | None = None
) -> DataFrame:
    """Adds `_cell`: the parts of each group, numbered along the order."""
    by = [*[F.col(g).asc_nulls_last() for g in group], *order]
    ranged = df.repartitionByRange(*by) if cells is None else df.repartitionByRange(cells, *by)
    return ranged.withColumn("_cell", F.spark_partition_id())


def scan(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    spec: Scan,
    tie: str | None = None,
    descending: bool = False,
    cells: int | None = None,
) -> DataFrame:
    """Scan rows in the order (value, tie) inside each group; ties in `value` ascend by `tie`.

    `cells` sets the number of ranges; by default Spark decides.
    """
    group = list(group)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    spread = df.withColumn("_spread", F.xxhash64(*plain))
    order = _order(df, value, tie, descending)
    placed = place(spread, group, order, cells)
    keys = [*group, "_cell"]
    step = Window.partitionBy(*keys).orderBy(*order)
    run = step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn("_rn", F.row_number().over(step))
    for name, c in spec.sums.items():
        out = out.withColumn(name, F.sum(c).over(run))
    for name, c in spec.lasts.items():
        out = out.withColumn(name, F.last(c, ignorenulls=True).over(run))
    for name, c in spec.leads.items():
        out = out.withColumn(name, F.lead(c).over(step))
    if spec.leads:
        out = out.withColumn("_end", F.lead(F.lit(1)).over(step).isNull())
    for name, c in spec.totals.items():
        out = out.withColumn(f"_p_{name}", F.sum(c).over(Window.partitionBy(*keys)))
    # Stored once: the summary and the rows are read from there.
    return _carry(kept(out.drop("_spread")), group, spec).drop("_cell", "_rn", "_end")


def _shared(scanned: DataFrame, group: list[str]) -> DataFrame:
    """The rows of the first and the last group of each part, in the order of the ranges."""
    if not group:
        return scanned
    place = F.struct(*[x for g in group for x in (F.col(g).isNull(), F.col(g))])
    ends = scanned.groupBy(F.col("_cell").alias("_ends_cell")).agg(
        F.min(place).alias("_ends_first"), F.max(place).alias("_ends_last"))
    at_end = (F.col("_cell") == F.col("_ends_cell")) & (
        place.eqNullSafe(F.col("_ends_first")) | place.eqNullSafe(F.col("_ends_last")))
    return scanned.join(F.broadcast(ends), at_end, "left_semi")


def _carry(scanned: DataFrame, group: list[str], spec: Scan) -> DataFrame:
    keys = [*group, "_cell"]
    aggregates = [F.sum(c).alias(f"_s_{n}") for n, c in spec.sums.items()]
    aggregates += [F.max_by(n, "_rn").alias(f"_l_{n}") for n in spec.lasts]
    aggregates += [F.min_by(c, "_rn").alias(f"_n_{n}") for n, c in spec.leads.items()]
    aggregates += [F.sum(c).alias(f"_t_{n}") for n, c in spec.totals.items()]
    # `_carry` adds to what a part has; groups that lie in one part alone have nothing to add.
    summary = _shared(scanned, group).groupBy(*keys).agg(*aggregates)
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    before = w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in spec.sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in spec.lasts],
        *[F.lead(f"_n_{n}").over(w.orderBy("_cell")).alias(f"_c_{n}") for n in spec.leads],
        *[F.sum(f"_t_{n}").over(w).alias(f"_c_{n}") for n in spec.totals],
    )
    condition = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
    )
    joined = scanned.join(F.broadcast(carried), condition, "left")
    for n in spec.sums:
        own, earlier = F.col(n), F.col(f"_c_{n}")
        joined = joined.withColumn(n, F.coalesce(own + earlier, own, earlier))
    for n in spec.lasts:
        joined = joined.withColumn(n, F.coalesce(F.col(n), F.col(f"_c_{n}")))
    for n in spec.leads:
        joined = joined.withColumn(n, F.when(F.col("_end"), F.col(f"_c_{n}")).otherwise(F.col(n)))
    for n in spec.totals:
        joined = joined.withColumn(n, F.coalesce(F.col(f"_c_{n}"), F.col(f"_p_{n}")))
    drop = [f"_k{i}" for i in range(len(keys))] + [f"_p_{n}" for n in spec.totals] + [
        f"_c_{n}" for n in (*spec.sums, *spec.lasts, *spec.leads, *spec.totals)
    ]
    return joined.drop(*drop)


def positions(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    tie: str,
    name: str = "position",
    total: str = "group_size",
    descending: bool = False,
    cells: int | None = None,
) -> DataFrame:
    """1-based row position and group size in the order (value, tie)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return scan(
        one, group, value, Scan(sums={name: "_one"}, totals={total: "_one"}), tie, descending,
        cells,
    ).drop("_one")


def ntile(position: Column, size: Column, n: int) -> Column:
    """Standard NTILE from a row position: the first (size mod n) tiles get one row more."""
    small = F.floor(size / n)
    extra = size % n
    border = extra * (small + 1)
    inside = F.floor((position - 1) / (small + 1)) + 1
    beyond = extra + F.floor((position - 1 - border) / F.greatest(small, F.lit(1))) + 1
    return F.when(position <= border, inside).otherwise(beyond).cast("int")


def decile(position: Column, size: Column, n: int = 10) -> Column:
    """Equal-share bands floor((position-1)*n/size)+1."""
    return (F.floor((position - 1) * n / size) + 1).cast("int")


def value_counts(
    df: DataFrame, group: Sequence[str], value: str, weights: Mapping[str, Column]
) -> DataFrame:
    """One row per distinct value with summed weights: the input of rank statistics."""
    return df.groupBy(*group, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])


def average_ranks(
    df: DataFrame, group: Sequence[str], value: str, rank: str, cells: int | None = None
) -> DataFrame:
    """Adds the tie-averaged rank of `value` inside each group."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = scan(counts, group, value, Scan(sums={"_upto": "_n"}), None, False, cells)
    ranked = cum.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col(value).alias("_v"),
        (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(rank),
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
        + [F.col(value).eqNullSafe(F.col("_v"))],
    )
    return df.join(ranked, on, "left").drop("_v", *[f"_g{i}" for i in range(len(group))])


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
    cells: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles, one column per name in `probs`.

    `weight` names a column with the number of rows a row stands for. Works on value counts and running totals, so neither a group nor its distinct values
    have to fit into one task.
    """
    group = list(group)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    )
    placed = scan(
        counts, group, value, Scan(sums={"_upto": "_n"}, totals={"_all": "_n"}),
        cells=cells,
    )
    aggregates = []
    for name, p in probs.items():
        spot = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        # The value whose 0-based index range [upto-n, upto) holds the wanted index.
        covers = lambda i: (i >= F.col("_upto") - F.col("_n")) & (i < F.col("_upto"))
        v = F.col(value).cast("double")
        aggregates += [
            F.max(F.when(covers(low), v)).alias(f"_lo_{name}"),
            F.max(F.when(covers(high), v)).alias(f"_hi_{name}"),
            F.max(spot - low).alias(f"_f_{name}"),
        ]
    found = placed.groupBy(*group).agg(*aggregates)
    return found.select(
        *group,
        *[
            (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")))
            .alias(n)
            for n in probs
        ],
    )
