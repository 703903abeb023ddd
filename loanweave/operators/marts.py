"""Portfolio marts. Balances are stocks: they are summed inside one date, never over dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.functions.buckets import (
    AT_LEAST_30,
    AT_LEAST_60,
    AT_LEAST_90,
    BUCKET_ORDER,
    bucket_dimension,
)
from loanweave.functions.dates import month_start
from loanweave.functions.money import mean, ratio, ratio_or_zero, sum_if
from loanweave.operators.staging import TAGS

LATE = {"30plus": AT_LEAST_30, "60plus": AT_LEAST_60, "90plus": AT_LEAST_90}


def _late(level: str) -> Column:
    return F.col("dpd_bucket").isin(*LATE[level])


def credit_funnel(journey: DataFrame) -> DataFrame:
    """Submitted, decided, approved, rejected and booked per run, month and channel."""
    decided, approved, booked = F.col("was_decided"), F.col("is_approved"), F.col("is_booked")
    counts = journey.groupBy(
        *TAGS, month_start("submitted_at").alias("submitted_month"), "channel"
    ).agg(
        F.count(F.lit(1)).alias("applications_submitted"),
        F.count_if(decided).alias("decisioned_applications"),
        F.count_if(approved).alias("approved_count"),
        F.count_if(decided & ~approved).alias("rejected_count"),
        F.count_if(booked).alias("booked_count"),
        sum_if(booked, "financed_amount").alias("total_booked_amount"),
    )
    return counts.select(
        "*",
        ratio("approved_count", "decisioned_applications").alias("approval_rate"),
        ratio("rejected_count", "decisioned_applications").alias("rejection_rate"),
        ratio("booked_count", "approved_count").alias("booking_rate_of_approved"),
        ratio("booked_count", "applications_submitted").alias("booking_rate_of_submitted"),
        ratio("total_booked_amount", "booked_count").alias("avg_booked_amount"),
    )


def portfolio_monthly(
    accounts: DataFrame, payments: DataFrame, installments: DataFrame
) -> DataFrame:
    """Month-end stock with the payments and the schedule of that month.

    All three sides are aggregated to (run, month) before they meet.
    """
    stock = accounts.groupBy(*TAGS, "snapshot_date").agg(
        F.count(F.lit(1)).alias("total_contracts"),
        F.count_if(F.col("contract_status").isin("active", "delinquent")).alias(
            "active_contracts"
        ),
        F.sum("total_balance").alias("outstanding_balance"),
        F.sum("cumulative_paid").alias("cumulative_paid_total"),
        F.sum("past_due_amount").alias("overdue_scheduled_amount"),
        mean("financed_amount").alias("avg_ticket"),
    )
    forward = ~F.col("is_reversal")
    flow = payments.groupBy("run_id", F.col("payment_month").alias("month")).agg(
        F.count_if((F.col("payment_type") == "partial") & forward).alias("partial_payment_count"),
        F.count_if((F.col("payment_type") == "prepayment") & forward).alias("prepayment_count"),
        F.sum("net_amount").alias("paid_amount_this_month"),
    )
    planned = installments.groupBy("run_id", F.col("due_month").alias("month")).agg(
        F.sum("scheduled_total").alias("scheduled_amount_due_this_month"),
        *[
            F.sum(f"scheduled_{p}").alias(f"scheduled_{p}_due_this_month")
            for p in ("principal", "interest", "fees")
        ],
    )
    filled = [c for c in (*flow.columns, *planned.columns) if c not in ("run_id", "month")]
    joined = (
        stock.withColumn("month", month_start("snapshot_date"))
        .join(flow, ["run_id", "month"], "left")
        .join(planned, ["run_id", "month"], "left")
        .drop("month")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in filled})
    )
    return joined.withColumn(
        "paid_to_scheduled_ratio",
        ratio("paid_amount_this_month", "scheduled_amount_due_this_month"),
    )


def delinquency_monthly(accounts: DataFrame) -> DataFrame:
    """Portfolio at risk (by balance), late rates (by count), cures and relapses; one pass."""
    was_late = F.col("prior_month_status") == "delinquent"
    entered = (F.col("contract_status") == "delinquent") & (
        F.coalesce("prior_month_status", F.lit("")) != "delinquent"
    )
    totals = accounts.groupBy(*TAGS, "snapshot_date").agg(
        F.count(F.lit(1)).alias("total_contracts"),
        F.sum("total_balance").alias("total_balance"),
        *[F.count_if(_late(k)).alias(f"contracts_{k}") for k in LATE],
        *[sum_if(_late(k), "total_balance").alias(f"balance_{k}") for k in LATE],
        F.count_if(entered).alias("new_delinquencies"),
        F.count_if("is_cure_month").alias("cures"),
        F.count_if("is_relapse_month").alias("relapses"),
        F.count_if(was_late).alias("prior_month_delinquent_count"),
    )
    return totals.select(
        "*",
        *[ratio(f"balance_{k}", "total_balance").alias(f"par{k[:2]}") for k in LATE],
        *[ratio(f"contracts_{k}", "total_contracts").alias(f"rate_{k}") for k in LATE],
        ratio("cures", "prior_month_delinquent_count").alias("cure_rate"),
    )


def vintage_cohorts(accounts: DataFrame) -> DataFrame:
    """Incidence by origination month and months on book, with the cohort's last month.

    (run, contract, date) is unique and one cohort row holds one date, so a plain count is the
    number of distinct contracts.
    """
    cohort = accounts.groupBy(*TAGS, "vintage_month", "months_on_book").agg(
        F.count(F.lit(1)).alias("contracts_observed"),
        F.sum("total_balance").alias("total_balance"),
        F.sum("financed_amount").alias("total_financed_amount"),
        *[F.count_if(_late(k)).alias(f"contracts_{k}") for k in LATE],
        F.sum("cumulative_write_off").alias("cumulative_write_off"),
    )
    whole = Window.partitionBy("run_id", "vintage_month")
    return cohort.withColumn("max_mob_observed_for_cohort", F.max("months_on_book").over(whole))


def roll_rates(accounts: DataFrame) -> DataFrame:
    """Bucket transitions from the prior to the current row of the same contract."""
    return (
        accounts.filter(F.col("prior_month_dpd_bucket").isNotNull())
        .groupBy(
            *TAGS,
            "snapshot_date",
            F.col("prior_month_dpd_bucket").alias("from_bucket"),
            F.col("dpd_bucket").alias("to_bucket"),
        )
        .agg(F.count(F.lit(1)).alias("contract_count"), F.sum("total_balance").alias("balance"))
    )


def roll_direction(rolls: DataFrame) -> DataFrame:
    """Forward, back and stable moves per run and month; unknown buckets drop out."""
    dim = bucket_dimension(rolls.sparkSession).select("dpd_bucket", "sort_order")

    def side(name: str) -> DataFrame:
        return F.broadcast(
            dim.select(F.col("dpd_bucket").alias(f"{name}_bucket"),
                       F.col("sort_order").alias(f"{name}_order"))
        )

    n = F.col("contract_count")
    move = F.col("to_order") - F.col("from_order")
    summed = (
        rolls.join(side("from"), "from_bucket")
        .join(side("to"), "to_bucket")
        .groupBy(*TAGS, "snapshot_date")
        .agg(
            F.sum(F.when(move > 0, n).otherwise(0)).alias("roll_forward_count"),
            F.sum(F.when(move < 0, n).otherwise(0)).alias("roll_back_count"),
            F.sum(F.when(move == 0, n).otherwise(0)).alias("stable_count"),
            F.sum(n).alias("total_transitions"),
        )
    )
    return summed.withColumn("bucket_stability_rate", ratio("stable_count", "total_transitions"))


def roll_matrix(rolls: DataFrame) -> DataFrame:
    """From x to counts per run over all months, zero-filled, buckets in fixed order."""
    live = [b for b in BUCKET_ORDER if b != "write_off"]
    return (
        rolls.groupBy("run_id", "from_bucket")
        .pivot("to_bucket", live)
        .agg(F.sum("contract_count"))
        .na.fill(0)
        .select(
            "run_id",
            "from_bucket",
            *[F.col(f"`{b}`").alias("to_" + b.replace("-", "_").replace("+", "plus"))
              for b in live],
        )
    )


def roll_forward_from_current(rolls: DataFrame) -> DataFrame:
    """Share of transitions that leave the current bucket."""
    stayed = F.sum(F.when(F.col("to_bucket") == "current", F.col("contract_count")).otherwise(0))
    return (
        rolls.filter(F.col("from_bucket") == "current")
        .groupBy("run_id", "scenario")
        .agg(F.sum("contract_count").alias("transitions"), stayed.alias("stayed_current"))
        .withColumn(
            "roll_forward_rate",
            ratio(F.col("transitions") - F.col("stayed_current"), "transitions"),
        )
    )


def cure_and_redefault(accounts: DataFrame) -> DataFrame:
    """Cure and relapse history of each contract."""
    cured = F.coalesce("is_cure_month", F.lit(False))
    relapsed = F.coalesce("is_relapse_month", F.lit(False))
    return (
        accounts.groupBy(*TAGS, "contract_key", "contract_id")
        .agg(
            F.bool_or(cured).alias("was_ever_cured"),
            F.count_if(cured).alias("cure_count"),
            F.bool_or(relapsed).alias("ever_relapsed"),
            F.count_if(relapsed).alias("relapse_count"),
        )
        .withColumn("redefaulted", F.col("was_ever_cured") & F.col("ever_relapsed"))
    )


def redefault_rate(histories: DataFrame) -> DataFrame:
    return (
        histories.filter("was_ever_cured")
        .groupBy(*TAGS)
        .agg(
            F.count(F.lit(1)).alias("contracts_ever_cured"),
            F.count_if("redefaulted").alias("contracts_redefaulted"),
        )
        .withColumn("redefault_rate", ratio("contracts_redefaulted", "contracts_ever_cured"))
    )


def collections_performance(collections: DataFrame, accounts: DataFrame) -> DataFrame:
    """Contact activity against the delinquent contracts of the month.

    Contracts are first reduced to one row per (run, month, contract), then counted, so the
    distinct counts combine on the map side.
    """
    per_contract = collections.groupBy(*TAGS, "event_month", "contract_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("promise_to_pay").alias("promises")
    )
    activity = per_contract.groupBy(*TAGS, "event_month").agg(
        F.sum("events").alias("contact_events"),
        F.count(F.lit(1)).alias("contracts_contacted"),
        F.sum("promises").alias("promises_to_pay"),
    )
    eligible = (
        accounts.filter(F.col("contract_status") == "delinquent")
        .groupBy("run_id", month_start("snapshot_date").alias("event_month"), "contract_id")
        .agg(F.lit(1).alias("seen"))
        .groupBy("run_id", "event_month")
        .agg(F.count(F.lit(1)).alias("contracts_eligible"))
    )
    joined = activity.join(eligible, ["run_id", "event_month"], "left").withColumn(
        "contracts_eligible", F.coalesce("contracts_eligible", F.lit(0))
    )
    return joined.select(
        "*",
        ratio("contracts_contacted", "contracts_eligible").alias("contact_rate"),
        ratio("promises_to_pay", "contracts_contacted").alias("promise_rate"),
        ratio("contact_events", "contracts_contacted").alias("events_per_contract"),
    )


def writeoff_recovery(outcomes: DataFrame) -> DataFrame:
    recovered = F.coalesce("recovery_amount", F.lit(0).cast("decimal(18,2)"))
    return (
        outcomes.groupBy(*TAGS, month_start("write_off_date").alias("write_off_month"))
        .agg(
            F.count(F.lit(1)).alias("write_off_count"),
            F.sum("write_off_amount").alias("total_write_off_amount"),
            F.count_if("has_recovery").alias("recovery_count"),
            F.sum(recovered).alias("total_recovery_amount"),
            mean("days_to_recovery").alias("avg_days_to_recovery"),
        )
        .withColumn("recovery_rate", ratio("total_recovery_amount", "total_write_off_amount"))
    )


def final_rows(accounts: DataFrame) -> DataFrame:
    """Rows of each run's last snapshot date.

    The last date is one value per run, so it comes from a partial aggregate, and the join
    back is against a table with one row per run.
    """
    last = accounts.groupBy("run_id").agg(F.max("snapshot_date").alias("snapshot_date"))
    return accounts.join(last, ["run_id", "snapshot_date"])


def scenario_comparison(
    runs: DataFrame, decisions: DataFrame, accounts: DataFrame, write_offs: DataFrame
) -> DataFrame:
    """Each scenario against the baseline of its suite. Rates are over all decision rows."""
    approval = decisions.groupBy("run_id").agg(
        (F.count_if(F.col("outcome") == "approved") / F.count(F.lit(1))).alias("approval_rate")
    )
    late = final_rows(accounts).groupBy("run_id").agg(
        (F.count_if(_late("90plus")) / F.count(F.lit(1))).alias("dpd90_rate_final_month")
    )
    lost = write_offs.groupBy("run_id").agg(F.count(F.lit(1)).alias("write_off_count"))
    level = (
        runs.filter(F.col("suite_id").isNotNull())
        .select("run_id", "suite_id", "scenario")
        .join(approval, "run_id", "left")
        .join(late, "run_id", "left")
        .join(lost, "run_id", "left")
        .na.fill(0, ["approval_rate", "dpd90_rate_final_month", "write_off_count"])
    )
    base = level.filter(F.col("scenario") == "baseline").select(
        "suite_id",
        F.col("approval_rate").alias("baseline_approval_rate"),
        F.col("dpd90_rate_final_month").alias("baseline_dpd90_rate"),
        F.col("write_off_count").alias("baseline_write_off_count"),
    )
    gap = F.col("approval_rate") - F.col("baseline_approval_rate")
    return (
        level.filter(F.col("scenario") != "baseline")
        .join(base, "suite_id")
        .select(
            "*",
            gap.alias("approval_rate_delta_abs"),
            ratio(gap, "baseline_approval_rate").alias("approval_rate_delta_rel"),
            (F.col("dpd90_rate_final_month") - F.col("baseline_dpd90_rate"))
            .alias("dpd90_rate_delta_abs"),
            (F.col("write_off_count") - F.col("baseline_write_off_count"))
            .alias("write_off_count_delta_abs"),
        )
    )


def stress_pre_post(
    runs: DataFrame, macro: DataFrame, delinquency: DataFrame, writeoffs: DataFrame
) -> DataFrame:
    """Baseline and stress run before and after the first synthetic macro observation."""
    shocks = (
        macro.filter("is_synthetic")
        .groupBy("run_id")
        .agg(F.min("reference_date").alias("shock_date"))
        .join(runs.filter(F.col("suite_id").isNotNull()).select("run_id", "suite_id"), "run_id")
        .select("suite_id", "shock_date")
    )
    kept = F.col("scenario").isin("baseline", "macroeconomic_stress")

    def period(day: str) -> Column:
        return F.when(F.col(day) < F.col("shock_date"), "pre_shock").otherwise("post_shock")

    key = ["suite_id", "scenario", "period"]
    late = (
        delinquency.filter(kept)
        .join(shocks, "suite_id")
        .groupBy("suite_id", "scenario", period("snapshot_date").alias("period"))
        .agg(
            F.countDistinct("snapshot_date").alias("n_months"),
            F.avg("par90").alias("par90"),
            F.avg("rate_90plus").alias("dpd90_rate"),
            mean("total_balance").alias("outstanding_balance"),
        )
    )
    lost = (
        writeoffs.filter(kept)
        .join(shocks, "suite_id")
        .groupBy("suite_id", "scenario", period("write_off_month").alias("period"))
        .agg(
            F.sum("write_off_count").alias("write_off_count"),
            F.sum("total_write_off_amount").alias("write_off_amount"),
        )
    )
    both = late.join(lost, key, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("write_off_count", "write_off_amount")}
    )
    values = [c for c in both.columns if c not in key]

    def one(scenario: str, prefix: str) -> DataFrame:
        return both.filter(F.col("scenario") == scenario).select(
            "suite_id", "period", *[F.col(v).alias(f"{prefix}_{v}") for v in values]
        )

    paired = one("baseline", "baseline").join(
        one("macroeconomic_stress", "stress"), ["suite_id", "period"]
    )
    deltas = {
        f"{v}_delta_abs": F.col(f"stress_{v}") - F.col(f"baseline_{v}")
        for v in ("par90", "dpd90_rate", "write_off_count")
    }
    return paired.join(shocks, "suite_id").withColumns(deltas)


def totals_by_scenario(accounts: DataFrame) -> DataFrame:
    """Final-month balance and contracts of every run."""
    return final_rows(accounts).groupBy("run_id", "scenario", "snapshot_date").agg(
        F.sum("total_balance").alias("outstanding_balance"),
        F.count(F.lit(1)).alias("contracts"),
    )


def rates_by_scenario(funnel: DataFrame) -> DataFrame:
    """Approval and booking rates over all months and channels of a run."""
    return (
        funnel.groupBy("run_id", "scenario")
        .agg(
            *[
                F.sum(c).alias(c)
                for c in ("applications_submitted", "decisioned_applications",
                          "approved_count", "booked_count")
            ]
        )
        .select(
            "*",
            ratio("approved_count", "decisioned_applications").alias("approval_rate"),
            ratio("booked_count", "approved_count").alias("booking_rate_of_approved"),
            ratio_or_zero("booked_count", "applications_submitted").alias("booking_rate"),
        )
    )


def comparable_cohorts(cohorts: DataFrame) -> DataFrame:
    """Cohorts read at the largest months-on-book that every cohort of the run has reached."""
    reach = cohorts.groupBy("run_id").agg(
        F.min("max_mob_observed_for_cohort").alias("months_on_book")
    )
    at = cohorts.join(reach, ["run_id", "months_on_book"])
    return at.select(
        "run_id",
        "scenario",
        "vintage_month",
        "months_on_book",
        "contracts_observed",
        *[ratio(f"contracts_{k}", "contracts_observed").alias(f"incidence_{k}") for k in LATE],
    )


def latest_per_scenario(delinquency: DataFrame) -> DataFrame:
    """The most recent monthly row of each scenario."""
    newest = Window.partitionBy("suite_id", "scenario").orderBy(F.desc("snapshot_date"))
    return (
        delinquency.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )
