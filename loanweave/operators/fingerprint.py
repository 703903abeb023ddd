"""Order-free content fingerprints and table equality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanweave.functions.keys import NULL_TEXT
from loanweave.session import settle

SEPARATOR = "\x1f"


MICRO = 1_000_000  # fractions are compared as whole millionths


def canonical(df: DataFrame) -> DataFrame:
    """All columns as text that does not depend on how an engine prints fractions and times."""

    def text(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.floor(c.cast("double") * MICRO).cast("bigint").cast("string")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.transform(c, lambda x: text(x, kind.elementType)), ",", NULL_TEXT)
        return c.cast("string")

    return df.select(*[text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def row_digest(columns: Sequence[str]) -> Column:
    """sha256 of the row's texts, columns in name order."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_TEXT)) for c in sorted(columns)]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def table_fingerprint(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Row count and a multiset hash: the sum of 60-bit row digests, exact as decimal.

    Row and column order do not matter; a repeated row counts as often as it occurs. Only
    partial sums are shuffled.
    """
    names = list(columns if columns is not None else [c for c in df.columns if c not in by])
    value = F.conv(F.substring(row_digest(names), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,0)").cast("string")
        .alias("fingerprint"),
    )


def build_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """One line per table and one digest over all lines; only these few rows are combined."""
    lines = reduce(
        lambda a, b: a.unionByName(b),
        [
            table_fingerprint(df).select(F.lit(name).alias("table_name"), "n_rows", "fingerprint")
            for name, df in sorted(tables.items())
        ],
    )
    line = F.concat_ws("|", "table_name", "n_rows", "fingerprint")
    return lines.agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("n_rows").alias("n_rows"),
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("fingerprint"),
    )


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of both tables and whether they hold the same multiset of rows."""
    columns = sorted(set(a.columns))
    if columns != sorted(set(b.columns)):
        raise ValueError("tables have different columns")
    sides = a.select(F.lit(True).alias("_left"), *columns).unionByName(
        b.select(F.lit(False).alias("_left"), *columns)
    )
    left = F.col("_left")
    prints = table_fingerprint(sides, columns, by=["_left"])
    return prints.agg(
        F.coalesce(F.sum(F.when(left, F.col("n_rows"))), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum(F.when(~left, F.col("n_rows"))), F.lit(0)).alias("rows_b"),
        F.max(F.when(left, F.col("fingerprint"))).alias("print_a"),
        F.max(F.when(~left, F.col("fingerprint"))).alias("print_b"),
    ).select(
        "rows_a", "rows_b",
        ((F.col("rows_a") == F.col("rows_b"))
         & F.col("print_a").eqNullSafe(F.col("print_b"))).alias("identical"),
    )


def population_fingerprint(df: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Fingerprint without the columns that may differ between runs of a shared population."""
    own = {"run_id", "scenario", "generation_run_id", "status", "suite_id", "parent_run_id"}
    return table_fingerprint(df, [c for c in df.columns if c not in own], by)


def check_recorded(tables: dict[str, DataFrame], recorded: DataFrame) -> DataFrame:
    """Recorded (table_name, n_rows, fingerprint) against the tables as they are now."""
    now = reduce(
        lambda a, b: a.unionByName(b),
        [
            table_fingerprint(df).select(
                F.lit(name).alias("table_name"), F.col("n_rows").alias("rows_now"),
                F.col("fingerprint").alias("print_now"),
            )
            for name, df in tables.items()
        ],
    )
    return recorded.join(now, "table_name", "full_outer").select(
        "table_name", "n_rows", "rows_now",
        (F.col("n_rows").eqNullSafe(F.col("rows_now"))).alias("rows_match"),
        (F.col("fingerprint").eqNullSafe(F.col("print_now"))).alias("content_matches"),
    )


# --- what changed, and where ------------------------------------------------------------------


def range_prints(df: DataFrame, key: str, width: int) -> DataFrame:
    """node, n_rows, fingerprint of the rows whose integer key lies in [node * width, (node + 1) *
    width); rows without a key are node NULL."""
    leaf = df.withColumn("node", F.floor(F.col(key) / width).cast("bigint"))
    return table_fingerprint(leaf, df.columns, ["node"])


def print_tree(leaves: DataFrame, fan: int, levels: int) -> DataFrame:
    """level, node, n_rows, fingerprint: every level adds up the digests of `fan` nodes below, so
    a recorded tree answers for any range without its rows."""
    out = [leaves.select(F.lit(0).alias("level"), "node", "n_rows", "fingerprint")]
    for level in range(1, levels + 1):
        below = out[-1]
        out.append(below.groupBy(F.floor(F.col("node") / fan).cast("bigint").alias("node")).agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum(F.col("fingerprint").cast("decimal(38,0)")).cast("decimal(38,0)").cast("string").alias("fingerprint"),
        ).select(F.lit(level).alias("level"), "node", "n_rows", "fingerprint"))
    return reduce(lambda a, b: a.unionByName(b), out)


def changed_ranges(recorded: DataFrame, now: DataFrame, fan: int) -> DataFrame:
    """node, rows_then, rows_now of the leaves that differ, found from the top of the trees down:
    only children of nodes that differ are looked at."""
    levels = recorded.agg(F.max("level")).first()[0] or 0
    suspects = None
    for level in range(levels, -1, -1):
        old, new = (t.filter(F.col("level") == level).select("node", "n_rows", "fingerprint") for t in (recorded, now))
        if suspects is not None:
            old, new = (t.withColumn("up", F.floor(F.col("node") / fan).cast("bigint")).join(
                suspects, F.col("up").eqNullSafe(F.col("above")), "left_semi").drop("up") for t in (old, new))
        old = old.select(F.col("node").alias("a"), F.col("n_rows").alias("rows_then"), F.col("fingerprint").alias("f"))
        both = old.join(new, F.col("a").eqNullSafe(F.col("node")), "full_outer").filter(
            ~F.col("f").eqNullSafe(F.col("fingerprint")) | ~F.col("rows_then").eqNullSafe(F.col("n_rows")))
        found = settle(both.select(F.coalesce("a", "node").alias("node"), F.coalesce("rows_then", F.lit(0)).alias("rows_then"),
                                   F.coalesce("n_rows", F.lit(0)).alias("rows_now")))
        suspects = found.select(F.col("node").alias("above"))
    return found


def changed_keys(before: DataFrame, after: DataFrame, key: str, width: int, ranges: DataFrame) -> DataFrame:
    """Keys of the changed ranges whose rows differ; rows of other ranges leave before any digest
    is made."""
    def side(df: DataFrame, name: str) -> DataFrame:
        near = df.withColumn("_leaf", F.floor(F.col(key) / width).cast("bigint")).join(
            ranges.select(F.col("node").alias("_leaf")), "_leaf", "left_semi").select(*df.columns)
        return table_fingerprint(near.withColumn("_key", F.col(key)), df.columns, ["_key"]).select(
            F.col("_key").alias(key), F.col("fingerprint").alias(name))

    return side(before, "then").join(side(after, "now"), key, "full_outer").filter(
        ~F.col("then").eqNullSafe(F.col("now"))).select(
        key, F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed")
        .otherwise("changed").alias("change"))
