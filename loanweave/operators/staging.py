"""Typed staging of operational tables: casts, fixed-point money, surrogate keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.functions.keys import optional_key, surrogate_key
from loanweave.functions.money import money

TAGS = ("run_id", "suite_id", "scenario", "seed", "scale")


@dataclass(frozen=True)
class Staging:
    """`keys`: key name -> natural id columns (run_id is always put first).
    `types`: cast per source column; "money" is decimal(18,2), "" keeps the type.
    `names`: source column -> staged name where it changes."""

    keys: dict[str, tuple[str, ...]]
    types: dict[str, str]
    names: dict[str, str] = field(default_factory=dict)
    tags: tuple[str, ...] = TAGS


def _plain(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "")


def _typed(kind: str, *names: str) -> dict[str, str]:
    return dict.fromkeys(names, kind)


CONTRACT_KEY = {"contract_key": ("contract_id",)}
APPLICATION_KEY = {"application_key": ("application_id",)}
CUSTOMER_KEY = {"customer_key": ("customer_id",)}

STAGING: dict[str, Staging] = {
    "customers": Staging(
        CUSTOMER_KEY, _plain("customer_id") | _typed("timestamp", "created_at")
    ),
    "applications": Staging(
        APPLICATION_KEY | CUSTOMER_KEY,
        _plain("application_id", "customer_id", "product", "channel", "status")
        | _typed("timestamp", "submitted_at")
        | _typed("money", "requested_amount")
        | _typed("int", "requested_term_months"),
    ),
    "application_features": Staging(
        APPLICATION_KEY,
        _plain("application_id", "bureau_score_bucket")
        | _typed("money", "declared_income", "requested_amount")
        | _typed("double", "debt_to_income", "employment_months", "relationship_months")
        | _typed("int", "requested_term_months")
        | _typed("timestamp", "feature_snapshot_at"),
        tags=("run_id",),
    ),
    "fairness_attributes": Staging(
        APPLICATION_KEY,
        _plain("application_id", "age_bracket", "synthetic_gender", "region"),
        tags=("run_id",),
    ),
    "policy_versions": Staging(
        {"policy_version_key": ("policy_version_id",)},
        _plain("policy_version_id", "name", "status", "rules_reference", "change_reason")
        | _typed("int", "version")
        | _typed("timestamp", "effective_from", "effective_to"),
        names={"name": "policy_name", "version": "policy_version_number"},
        tags=("run_id", "scenario"),
    ),
    "credit_decisions": Staging(
        {"decision_key": ("decision_id",)} | APPLICATION_KEY
        | {"policy_version_key": ("policy_version_id",)},
        _plain("decision_id", "application_id", "policy_version_id", "outcome", "reason_code",
               "logic_version")
        | _typed("timestamp", "decision_timestamp")
        | _typed("money", "approved_amount")
        | _typed("int", "approved_term_months")
        | _typed("double", "offered_rate")
        | _typed("boolean", "is_final"),
        tags=("run_id",),
    ),
    "contracts": Staging(
        CONTRACT_KEY | APPLICATION_KEY | CUSTOMER_KEY,
        _plain("contract_id", "application_id", "customer_id", "status", "currency_unit")
        | _typed("timestamp", "contract_date", "disbursement_date")
        | _typed("money", "financed_amount")
        | _typed("int", "term_months", "num_installments")
        | _typed("double", "contract_rate")
        | _typed("date", "first_due_date", "closed_date"),
    ),
    "installments": Staging(
        {"installment_key": ("installment_id",)} | CONTRACT_KEY,
        _plain("installment_id", "contract_id", "status")
        | _typed("int", "installment_number")
        | _typed("date", "due_date")
        | _typed("money", "scheduled_principal", "scheduled_interest", "scheduled_fees",
                 "scheduled_total", "outstanding_balance"),
        tags=("run_id",),
    ),
    "payments": Staging(
        {"payment_key": ("payment_id",)} | CONTRACT_KEY | CUSTOMER_KEY,
        _plain("payment_id", "contract_id", "customer_id", "channel", "status",
               "reversal_of_payment_id", "payment_type")
        | _typed("timestamp", "payment_timestamp")
        | _typed("money", "amount")
        | _typed("date", "settlement_date"),
        tags=("run_id",),
    ),
    "payment_allocations": Staging(
        {"allocation_key": ("allocation_id",), "payment_key": ("payment_id",),
         "installment_key": ("installment_id",)} | CONTRACT_KEY,
        _plain("allocation_id", "payment_id", "installment_id", "contract_id")
        | _typed("money", "allocated_principal", "allocated_interest", "allocated_fees",
                 "allocated_total"),
        tags=("run_id",),
    ),
    "account_monthly_snapshots": Staging(
        {"snapshot_key": ("contract_id", "snapshot_date")} | CONTRACT_KEY,
        _plain("contract_id", "delinquency_bucket", "status")
        | _typed("date", "snapshot_date", "next_due_date")
        | _typed("int", "dpd")
        | _typed("money", "outstanding_principal", "outstanding_interest", "outstanding_fees",
                 "total_balance", "past_due_amount", "exposure", "cumulative_paid",
                 "cumulative_write_off"),
        names={"delinquency_bucket": "dpd_bucket", "status": "contract_status"},
    ),
    "collection_events": Staging(
        {"collection_event_key": ("collection_event_id",)} | CONTRACT_KEY,
        _plain("collection_event_id", "contract_id", "channel", "strategy", "outcome", "status")
        | _typed("timestamp", "event_timestamp")
        | _typed("boolean", "promise_to_pay")
        | _typed("money", "promised_amount")
        | _typed("date", "promised_date"),
    ),
    "write_off_events": Staging(
        {"write_off_key": ("write_off_id",)} | CONTRACT_KEY,
        _plain("write_off_id", "contract_id", "reason", "policy_reference")
        | _typed("date", "write_off_date")
        | _typed("money", "amount", "principal", "interest", "fees"),
    ),
    "recovery_events": Staging(
        {"recovery_key": ("recovery_id",), "write_off_key": ("write_off_id",)} | CONTRACT_KEY,
        _plain("recovery_id", "contract_id", "write_off_id", "channel", "source")
        | _typed("date", "recovery_date")
        | _typed("money", "amount"),
    ),
    "macro_context_monthly": Staging(
        {"macro_key": ("source_type", "source_id", "reference_date")},
        _plain("source_type", "source_id", "unit")
        | _typed("int", "series_code")
        | _typed("date", "reference_date")
        | _typed("double", "value")
        | _typed("boolean", "is_synthetic")
        | _typed("timestamp", "retrieved_at"),
        tags=("run_id", "scenario"),
    ),
    "generation_runs": Staging(
        {},
        _plain("generation_run_id", "generator_version", "config_hash", "contract_version_set",
               "status", "parent_run_id")
        | _typed("int", "config_version", "planned_customers", "planned_applications")
        | _typed("date", "period_start", "period_end")
        | _typed("timestamp", "generated_at")
        | _typed("boolean", "is_synthetic"),
    ),
}


def stage(table: str, df: DataFrame) -> DataFrame:
    """Staged form of one operational table, tagged with its run."""
    spec = STAGING[table]
    columns = [surrogate_key("run_id", *ids).alias(k) for k, ids in spec.keys.items()]
    columns += [F.col(t) for t in spec.tags]
    for source, kind in spec.types.items():
        c = F.col(source)
        if kind == "money":
            c = money(c)
        elif kind:
            c = c.cast(kind)
        columns.append(c.alias(spec.names.get(source, source)))
    if table == "payments":
        ref = "reversal_of_payment_id"
        columns.append(optional_key(ref, "run_id", ref).alias("reversal_of_payment_key"))
        columns.append(F.col(ref).isNotNull().alias("is_reversal"))
    return df.select(*columns)
