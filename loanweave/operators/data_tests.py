"""Warehouse data tests. Each returns the rows that violate it and should be empty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.functions.buckets import TERMINAL_STATUSES
from loanweave.functions.money import LEDGER_TOLERANCE, MONEY
from loanweave.operators.asof import asof_join
from loanweave.session import settle


def balance_components(accounts: DataFrame) -> DataFrame:
    parts = F.col("outstanding_principal") + F.col("outstanding_interest") + F.col(
        "outstanding_fees")
    gap = F.abs(F.col("total_balance") - parts)
    return accounts.filter(gap > F.lit(LEDGER_TOLERANCE).cast(MONEY)).select(
        "run_id", "contract_id", "snapshot_date", "total_balance", parts.alias("computed_total")
    )


def balance_non_negative(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("total_balance") < 0).select(
        "run_id", "contract_id", "snapshot_date", "total_balance"
    )


def contract_not_before_decision(journey: DataFrame) -> DataFrame:
    return journey.filter(F.col("contract_date") < F.col("decision_timestamp")).select(
        "run_id", "application_id", "decision_timestamp", "contract_date"
    )


def decision_not_before_submission(journey: DataFrame) -> DataFrame:
    return journey.filter(F.col("decision_timestamp") < F.col("submitted_at")).select(
        "run_id", "application_id", "submitted_at", "decision_timestamp"
    )


def late_counts_nested(delinquency: DataFrame) -> DataFrame:
    nested = (
        (F.col("contracts_90plus") <= F.col("contracts_60plus"))
        & (F.col("contracts_60plus") <= F.col("contracts_30plus"))
        & (F.col("contracts_30plus") <= F.col("total_contracts"))
    )
    return delinquency.filter(~nested)


def keys_do_not_collide(customers: DataFrame) -> DataFrame:
    """A natural id used in several runs must have as many surrogate keys as runs."""
    per = customers.groupBy("customer_id").agg(
        F.countDistinct("run_id").alias("run_count"),
        F.countDistinct("customer_key").alias("distinct_key_count"),
    )
    return per.filter(
        (F.col("run_count") > 1) & (F.col("run_count") != F.col("distinct_key_count"))
    )


def terminal_stays_terminal(accounts: DataFrame) -> DataFrame:
    """Open rows after a terminal one, by the first terminal date instead of a self join."""
    key = ["run_id", "contract_id"]
    ends = accounts.filter(F.col("contract_status").isin(*TERMINAL_STATUSES)).groupBy(*key).agg(
        F.min("snapshot_date").alias("terminal_date"))
    return (
        accounts.filter(F.col("contract_status").isin("active", "delinquent"))
        .join(ends, key)
        .filter(F.col("snapshot_date") > F.col("terminal_date"))
        .select("run_id", "contract_id", "terminal_date", "snapshot_date", "contract_status")
    )


def only_completed_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") != "completed").select("run_id", "status")


def pre_shock_identical(stress: DataFrame) -> DataFrame:
    moved = (
        (F.abs("par90_delta_abs") > 1e-9)
        | (F.abs("dpd90_rate_delta_abs") > 1e-9)
        | (F.col("write_off_count_delta_abs") != 0)
    )
    return stress.filter((F.col("period") == "pre_shock") & moved)


def prior_status_from_past(history: DataFrame) -> DataFrame:
    """The stored prior status against the latest strictly earlier row, by an as-of join: a row
    is known from the day after its date."""
    key = ["run_id", "contract_id"]
    known = history.groupBy(*key, F.date_add("snapshot_date", 1).alias("known_from")).agg(
        F.max("contract_status").alias("true_prior_status"))
    probes = history.select(*key, "snapshot_date", "prior_month_status")
    return asof_join(probes, known, key, "snapshot_date", "known_from", ["true_prior_status"]).filter(
        ~F.col("prior_month_status").eqNullSafe(F.col("true_prior_status")))


def row_counts_reconcile(raw: Mapping[str, DataFrame], staged: Mapping[str, DataFrame],
                         names: Sequence[str]) -> DataFrame:
    """Row counts of all tables on both sides in one union, then one small pivot."""
    tagged = [
        df.select(F.lit(n).alias("table_name"), F.lit(side).alias("side"))
        for side, tables in (("raw", raw), ("staged", staged))
        for n in names
        for df in [tables[n]]
    ]
    counts = reduce(lambda a, b: a.unionByName(b), tagged).groupBy("table_name").agg(
        F.count_if(F.col("side") == "raw").alias("raw_row_count"),
        F.count_if(F.col("side") == "staged").alias("staging_row_count"),
    )
    return counts.filter(F.col("raw_row_count") != F.col("staging_row_count"))


def recovery_within_write_off(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("recovery_amount") > F.col("write_off_amount")).select(
        "run_id", "write_off_id", "write_off_amount", "recovery_amount"
    )


def no_recovery_fanout(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("run_id", "write_off_id").agg(
        F.count(F.lit(1)).alias("row_count")
    ).filter(F.col("row_count") > 1)


def summary(tests: Mapping[str, DataFrame]) -> DataFrame:
    """(test, violations) for every test. Each is counted on its own: in one plan the driver would
    hold all of them at once."""
    parts = [
        settle(df.agg(F.lit(name).alias("test"), F.count(F.lit(1)).alias("violations")))
        for name, df in tests.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
