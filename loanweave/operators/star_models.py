"""Dimensions, facts and the enriched intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.functions.dates import calendar_months, days_apart, month_key, month_start
from loanweave.functions.dates import months_apart
from loanweave.functions.money import ratio
from loanweave.operators.staging import TAGS

# What each known scenario stands for.
SCENARIOS = {
    "baseline": "Baseline synthetic portfolio - no intervention.",
    "policy_expansion": "Synthetic policy expansion - lower approval cutoff.",
    "policy_tightening": "Synthetic policy tightening - higher approval cutoff.",
    "macroeconomic_stress": "Synthetic macroeconomic stress from a documented date onward.",
    "collections_change": "Synthetic collections intensification.",
    "contract_coverage": "Small deterministic test fixture - not a plausible population.",
}


# --- intermediate ----------------------------------------------------------------------


def application_journey(
    applications: DataFrame, decisions: DataFrame, contracts: DataFrame
) -> DataFrame:
    """Application with its decision and contract, if any; three-valued outcome flags."""
    d = decisions.select(
        "run_id", "application_id", "decision_key", "decision_id", "decision_timestamp",
        F.col("outcome").alias("decision_outcome"), "reason_code", "approved_amount",
        "approved_term_months", "offered_rate",
    )
    c = contracts.select(
        "run_id", "application_id", "contract_key", "contract_id", "contract_date",
        "disbursement_date", "financed_amount", F.col("status").alias("contract_status"),
    )
    key = ["run_id", "application_id"]
    return (
        applications.withColumnRenamed("status", "application_status")
        .join(d, key, "left")
        .join(c, key, "left")
        .withColumn("was_decided", F.col("application_status") != "cancelled")
        .withColumn("is_approved", F.col("decision_outcome") == "approved")
        .withColumn("is_booked", F.col("contract_id").isNotNull())
    )


def monthly_history(snapshots: DataFrame, contracts: DataFrame) -> DataFrame:
    """Snapshots with vintage, months on book, prior row, cure and relapse flags.

    A contract has one row per month, so the per-contract windows stay small.
    """
    key = ["run_id", "contract_id"]
    c = contracts.select(
        *key, "customer_key", "financed_amount",
        month_start("disbursement_date").alias("vintage_month"),
    )
    w = Window.partitionBy(*key).orderBy("snapshot_date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    status, prior = F.col("contract_status"), F.col("prior_month_status")
    return (
        snapshots.join(c, key)
        .withColumn("months_on_book", months_apart("vintage_month", "snapshot_date"))
        .withColumn("prior_month_status", F.lag("contract_status").over(w))
        .withColumn("prior_month_dpd_bucket", F.lag("dpd_bucket").over(w))
        .withColumn("is_cure_month", (status == "active") & (prior == "delinquent"))
        .withColumn(
            "is_relapse_month",
            (status == "delinquent")
            & (F.coalesce(prior, F.lit("")) != "delinquent")
            & (F.sum(F.when(F.col("is_cure_month"), 1).otherwise(0)).over(before) > 0),
        )
    )


def write_off_outcomes(write_offs: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Write-offs with their recovery, days until it and the recovered share."""
    r = recoveries.select(
        "run_id", "write_off_id", "recovery_key", "recovery_id", "recovery_date",
        F.col("amount").alias("recovery_amount"), F.col("channel").alias("recovery_channel"),
    )
    joined = write_offs.join(r, ["run_id", "write_off_id"], "left")
    for part in ("amount", "principal", "interest", "fees"):
        joined = joined.withColumnRenamed(part, f"write_off_{part}")
    return (
        joined.withColumn("days_to_recovery", days_apart("write_off_date", "recovery_date"))
        .withColumn("has_recovery", F.col("recovery_key").isNotNull())
        .withColumn("recovery_rate", ratio("recovery_amount", "write_off_amount"))
    )


def calendar(runs: DataFrame) -> DataFrame:
    return calendar_months(runs, "period_start", "period_end")


# --- facts -----------------------------------------------------------------------------

ACCOUNT_MONTHLY = (
    "contract_key", "customer_key", *TAGS, "contract_id", "snapshot_date", "vintage_month",
    "months_on_book", "dpd", "dpd_bucket", "prior_month_dpd_bucket", "contract_status",
    "prior_month_status", "outstanding_principal", "outstanding_interest", "outstanding_fees",
    "total_balance", "past_due_amount", "exposure", "cumulative_paid", "cumulative_write_off",
    "financed_amount", "is_cure_month", "is_relapse_month",
)


def account_monthly(history: DataFrame) -> DataFrame:
    return history.select(*ACCOUNT_MONTHLY)


def _with_month(df: DataFrame, source: str, month: str) -> DataFrame:
    return df.withColumn(month, month_start(source))


def fact_applications(staged: DataFrame) -> DataFrame:
    return _with_month(staged, "submitted_at", "submitted_month").withColumnRenamed(
        "status", "application_status"
    )


def fact_decisions(staged: DataFrame) -> DataFrame:
    return _with_month(staged, "decision_timestamp", "decision_month").drop("logic_version")


def fact_contracts(staged: DataFrame) -> DataFrame:
    return _with_month(staged, "disbursement_date", "vintage_month").withColumnRenamed(
        "status", "contract_status"
    )


def fact_installments(staged: DataFrame) -> DataFrame:
    return _with_month(staged, "due_date", "due_month").withColumnRenamed(
        "status", "installment_status"
    )


def signed(amount: Column, reverses: Column) -> Column:
    return F.when(reverses, -amount).otherwise(amount)


def fact_payments(staged: DataFrame) -> DataFrame:
    return (
        _with_month(staged, "payment_timestamp", "payment_month")
        .withColumn("net_amount", signed(F.col("amount"), F.col("is_reversal")))
        .withColumnRenamed("status", "payment_status")
        .drop("reversal_of_payment_id")
    )


def fact_collections(staged: DataFrame) -> DataFrame:
    return _with_month(staged, "event_timestamp", "event_month").withColumnRenamed(
        "status", "collection_status"
    )


def fact_recoveries(staged: DataFrame) -> DataFrame:
    return _with_month(staged, "recovery_date", "recovery_month").select(
        "recovery_key", "contract_key", "write_off_key", "run_id", "recovery_id",
        "recovery_date", "recovery_month", F.col("amount").alias("recovery_amount"),
        F.col("channel").alias("recovery_channel"), F.col("source").alias("recovery_source"),
    )


def fact_write_offs(outcomes: DataFrame) -> DataFrame:
    return _with_month(outcomes, "write_off_date", "write_off_month").drop(
        "recovery_key", "recovery_id", "recovery_date", "recovery_amount", "recovery_channel"
    )


def fact_macro(staged: DataFrame) -> DataFrame:
    return staged.drop("retrieved_at")


# --- dimensions ------------------------------------------------------------------------


def distinct_dimension(df: DataFrame, column: str) -> DataFrame:
    """Channel and region dimensions: the value is its own key."""
    return (
        df.filter(F.col(column).isNotNull())
        .select(F.col(column).alias(f"{column}_key"), column)
        .distinct()
    )


def dim_scenario(runs: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for kv in SCENARIOS.items() for x in kv])
    s = F.col("scenario")
    return runs.select(
        s.alias("scenario_key"),
        s,
        F.coalesce(labels[s], s).alias("scenario_description"),
        (s != "contract_coverage").alias("is_comparable_to_baseline"),
    ).distinct()


def dim_date(months: DataFrame) -> DataFrame:
    return months.select(
        month_key("month_start").alias("date_key"),
        F.col("month_start").alias("month_date"),
        "month_end", "calendar_year", "calendar_month",
    )


def dim_run(runs: DataFrame) -> DataFrame:
    return runs.drop("config_version", "status", "is_synthetic")


def dim_customer(customers: DataFrame) -> DataFrame:
    return customers.select("customer_key", "run_id", "customer_id", "created_at")


def dim_policy(policies: DataFrame) -> DataFrame:
    return policies.drop("scenario")
