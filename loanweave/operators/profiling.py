"""Column profiles, audit findings and duplicate removal for unknown tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from loanweave.operators.fingerprint import row_digest

CATEGORY_LIMIT = 30
TOP_VALUES = 10


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _identity(name: str) -> Column:
    """Text that tells values apart; long texts travel as their digest."""
    text = F.col(f"`{name}`").cast("string")
    return F.when(F.length(text) > 32, F.md5(text)).otherwise(text)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: missing, cardinality, constant, possible id, range, infinities.

    Cardinalities are exact. Each value is reduced to (column, value) counts first, so the
    distinct counting combines on the map side and a hot value is one row after it.
    """
    names = df.columns
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("column"),
                    F.when(~_missing(df, n), _identity(n)).alias("value"),
                    (F.when(~_missing(df, n), F.col(f"`{n}`").cast("double"))
                     if _numeric(df, n) else F.lit(None).cast("double")).alias("number"),
                )
                for n in names
            ]
        )
    ).alias("p")
    counts = df.select(pairs).groupBy("p.column", "p.value", "p.number").agg(
        F.count(F.lit(1)).alias("n")
    )
    known = F.col("value").isNotNull()
    infinite = F.abs(F.col("number")) == F.lit(float("inf"))
    per = counts.groupBy("column").agg(
        F.sum("n").alias("num_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count_if(known).alias("cardinality"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
        F.coalesce(F.sum(F.when(infinite, F.col("n"))), F.lit(0)).alias("infinite_count"),
    )
    return per.select(
        "column", "num_rows", "missing_count",
        (F.col("missing_count") * 100.0 / F.col("num_rows")).alias("missing_pct"),
        "cardinality",
        (F.col("cardinality") <= 1).alias("is_constant"),
        ((F.col("missing_count") == 0) & (F.col("cardinality") == F.col("num_rows")))
        .alias("is_possible_identifier"),
        "min_value", "max_value", "infinite_count",
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The ten most frequent values of every column with at most 30 distinct ones."""
    names = list(columns or df.columns)
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("column"),
                         F.col(f"`{n}`").cast("string").alias("value"))
                for n in names
            ]
        )
    ).alias("p")
    counts = (
        df.select(pairs)
        .filter(F.col("p.value").isNotNull())
        .groupBy("p.column", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    small = counts.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality")).filter(
        F.col("cardinality") <= CATEGORY_LIMIT
    )
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        # One row a column at most: broadcast, or all values of a column would meet in one task.
        counts.join(F.broadcast(small.select("column")), "column", "left_semi")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= TOP_VALUES)
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each exactly repeated row."""
    per = df.groupBy(row_digest(df.columns).alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("num_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("exact_duplicate_rows"),
    )


def drop_repeats(df: DataFrame) -> DataFrame:
    """Removes exact repeats; rows that agree on the key but not on the values stay."""
    return df.dropDuplicates()


def schema_differences(columns: Sequence[str], documented: Sequence[str]) -> dict[str, list[str]]:
    return {
        "missing": sorted(set(documented) - set(columns)),
        "unexpected": sorted(set(columns) - set(documented)),
    }


def audit(
    df: DataFrame,
    source_id: str,
    documented: Sequence[str] | None = None,
    no_missing_documented: bool = False,
    id_columns: Sequence[str] = (),
) -> DataFrame:
    """(source_id, column, issue, category, detail_count) rows from the profile."""
    c = F.col
    missing_kind = "confirmed_problem" if no_missing_documented else "candidate_anomaly"
    id_kind = F.when(c("column").isin(*id_columns), "documented_characteristic").otherwise(
        "hypothesis_requiring_investigation"
    ) if id_columns else F.lit("hypothesis_requiring_investigation")

    def issue(when: Column, name: str, kind: Column, n: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("issue"), kind.alias("category"),
                                     n.cast("bigint").alias("detail_count")))

    found = F.explode(
        F.array_compact(
            F.array(
                issue(c("missing_count") > 0, "missing_values", F.lit(missing_kind),
                      c("missing_count")),
                issue(c("is_constant"), "constant", F.lit("candidate_anomaly"),
                      c("cardinality")),
                issue(c("infinite_count") > 0, "infinite", F.lit("confirmed_problem"),
                      c("infinite_count")),
                issue(c("is_possible_identifier"), "unique_per_row", id_kind, c("num_rows")),
            )
        )
    )
    out = column_profile(df).select("column", found.alias("f")).select("column", "f.*")
    repeated = duplicate_rows(df).filter(c("exact_duplicate_rows") > 0).select(
        F.lit(None).cast("string").alias("column"), F.lit("duplicate_rows").alias("issue"),
        F.lit("candidate_anomaly").alias("category"),
        c("exact_duplicate_rows").cast("bigint").alias("detail_count"),
    )
    out = out.unionByName(repeated)
    if documented is not None:
        diff = schema_differences(df.columns, documented)
        rows = [(n, "undocumented_column", "candidate_anomaly", 0) for n in diff["unexpected"]]
        rows += [(n, "missing_column", "confirmed_problem", 0) for n in diff["missing"]]
        out = out.unionByName(
            df.sparkSession.createDataFrame(
                rows, "column string, issue string, category string, detail_count bigint"
            )
        )
    return out.select(F.lit(source_id).alias("source_id"), "*")


def source_profiles(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and findings per source and category."""
    parts = []
    for name, df in sources.items():
        issues = audit(df, name).groupBy("source_id").agg(
            F.count_if(F.col("issue") == "missing_values").alias("missing_value_findings"),
            F.count_if(F.col("category") == "confirmed_problem").alias("confirmed_problems"),
            F.count(F.lit(1)).alias("findings"),
        )
        size = df.agg(F.lit(name).alias("source_id"), F.count(F.lit(1)).alias("num_rows"))
        parts.append(
            size.join(issues, "source_id", "left")
            .na.fill(0)
            .withColumn("num_columns", F.lit(len(df.columns)))
        )
    return reduce(lambda a, b: a.unionByName(b), parts)
