"""Input contract of scoring batches: schema, row violations, quarantine, quality rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.operators.scan import Scan, scan


@dataclass(frozen=True)
class BatchContract:
    """Declared input: an id, numeric columns, closed domains and absolute bounds."""

    id_column: str
    numeric: tuple[str, ...]
    domains: Mapping[str, tuple[float, ...]] = field(default_factory=dict)
    bounds: Mapping[str, float] = field(default_factory=dict)
    tolerated: tuple[str, ...] = ()
    # The first of several rows with one id is the smallest by this column.
    order_column: str | None = None


class SchemaViolation(ValueError):
    """The batch cannot be read under its contract."""


def schema_violations(df: DataFrame, contract: BatchContract, batch: Sequence[str] = ()
                      ) -> list[tuple[str, str]]:
    """(violation, column) pairs that block a whole batch."""
    wanted = (contract.id_column, *contract.numeric)
    known = {*wanted, *contract.tolerated, *batch}
    return [("missing_required_column", c) for c in wanted if c not in df.columns] + [
        ("unexpected_extra_column", c) for c in df.columns if c not in known
    ]


def unreadable_numbers(df: DataFrame, contract: BatchContract, batch: Sequence[str] = ()
                       ) -> DataFrame:
    """wrong_dtype per batch and column: a value is not a number although none is missing."""
    cols = [c for c in (contract.id_column, *contract.numeric) if c in df.columns]
    aggs = []
    for c in cols:
        failed = F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()
        aggs += [F.count_if(failed).alias(f"bad_{c}"),
                 F.count_if(F.col(c).isNull()).alias(f"gap_{c}")]
    wide = df.groupBy(*batch).agg(*aggs)
    flags = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 ((F.col(f"bad_{c}") > 0) & (F.col(f"gap_{c}") == 0)).alias("wrong"))
        for c in cols
    ])).alias("f")
    return wide.select(*batch, flags).filter("f.wrong").select(
        *batch, F.lit("wrong_dtype").alias("violation"), F.col("f.column").alias("column")
    )


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def mark_rows(df: DataFrame, contract: BatchContract, batch: Sequence[str] = ()) -> DataFrame:
    """Adds `violations`: an array of (violation, column), one entry per bad cell.

    Repeats of an id are all but the first by the order column; the numbering is a running
    count that also splits an id held by very many rows.
    """
    ident = contract.id_column
    order = contract.order_column
    if order is None:
        raise SchemaViolation("an order column is needed to tell the first of repeated ids")
    numbered = scan(
        df.withColumn("_one", F.lit(1)), [*batch, ident], order, Scan(sums={"_nth": "_one"})
    ).drop("_one")
    marks = [F.when(F.col("_nth") > 1, _mark("duplicate_id", ident))]
    for c in contract.numeric:
        number = F.col(c).try_cast("double")
        marks.append(F.when(~_finite(number), _mark("non_finite_value", c)))
        if c in contract.domains:
            allowed = [float(v) for v in contract.domains[c]]
            marks.append(F.when(number.isNotNull() & ~number.isin(*allowed),
                                _mark("domain_violation", c)))
        if c in contract.bounds:
            marks.append(F.when(F.abs(number) > contract.bounds[c], _mark("range_violation", c)))
    return numbered.withColumn("violations", F.array_compact(F.array(*marks))).drop("_nth")


def _mark(kind: str, column: str) -> Column:
    return F.struct(F.lit(kind).alias("violation"), F.lit(column).alias("column"))


def quarantined_ids(marked: DataFrame, contract: BatchContract, batch: Sequence[str] = ()
                    ) -> DataFrame:
    """Ids with any bad row, with their sorted distinct reasons."""
    return (
        marked.filter(F.size("violations") > 0)
        .select(*batch, contract.id_column, F.explode("violations").alias("v"))
        .select(*batch, contract.id_column, F.col("v.violation").alias("reason"))
        .distinct()
        .groupBy(*batch, contract.id_column)
        .agg(F.array_join(F.sort_array(F.collect_list("reason")), ";")
             .alias("quarantine_reasons"))
    )


def split_batch(df: DataFrame, contract: BatchContract, batch: Sequence[str] = ()
                ) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows with reasons); all copies of a quarantined id leave."""
    bad = quarantined_ids(mark_rows(df, contract, batch), contract, batch)
    key = [*batch, contract.id_column]
    return df.join(bad, key, "left_anti"), df.join(bad, key)


def quality_rates(marked: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Violations per row of the batch; three bad cells of one row count three times."""
    def of(kind: str) -> Column:
        return F.sum(F.size(F.filter("violations", lambda v: v["violation"] == kind)))

    n = F.count(F.lit(1))
    return marked.groupBy(*batch).agg(
        n.alias("row_count"),
        (of("non_finite_value") / n).alias("missingness_rate"),
        (of("duplicate_id") / n).alias("duplicate_rate"),
        (of("domain_violation") / n).alias("domain_violation_rate"),
        (of("range_violation") / n).alias("range_violation_rate"),
        F.count_if(F.size("violations") == 0).alias("clean_rows"),
    )
