"""Contract checks, data tests, profiles, reconciliation and ledger operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.functions.buckets import collection_strategy
from loanweave.operators import (
    batch_input,
    data_tests,
    fingerprint,
    ledger,
    profiling,
    reconciliation,
    rules,
    validation,
)
from loanweave.operators.asof import asof_join
from loanweave.operators.findings import report, union
from loanweave.operators.evaluation import with_one_row
from loanweave.operators.fingerprint import (
    build_fingerprint,
    canonical,
    check_recorded,
    print_tree,
    range_prints,
    table_fingerprint,
)
from loanweave.operators.scan import Scan, scan
from loanweave.plans.catalog import Source, query
from loanweave.plans.oracle_tables import key, ratio
from loanweave.plans.planted import every, planted, spoil
from loanweave.plans.queries_marts import day
from loanweave.plans.star import RUNS, STRESS
from loanweave.session import settle
from loanweave.sources.contracts import OPERATIONAL
from loanweave.sources.writers import demo_extract

SCOPE = ("run_id",)


def flat(report: DataFrame) -> DataFrame:
    """Examples as one text, so that the rows compare as plain values."""
    return report.select(
        "code", "severity", "contract", "column", "count", "total",
        F.array_join("examples", ",").alias("examples"),
    )


def finding(code: str, contract: str, column: str, source: str, bad: str, example: str,
            severity: str = "error", weight: str = "1") -> str:
    """SQL of one finding; `source` is a table or a parenthesised query."""
    return f"""SELECT '{code}' AS code, '{severity}' AS severity, '{contract}' AS contract,
        '{column}' AS "column", cast(sum({weight}) FILTER (WHERE {bad}) AS bigint) AS count,
        cast(sum({weight}) AS bigint) AS total,
        coalesce((SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT cast({example}
            AS varchar) AS e FROM {source} WHERE {bad} ORDER BY 1 LIMIT 5)), '') AS examples
        FROM {source} HAVING count(*) FILTER (WHERE {bad}) > 0"""


_PAID_FELL = finding(
    "CUMULATIVE_PAID_DECREASED", "account_monthly_snapshots", "cumulative_paid",
    "(SELECT run_id, contract_id, snapshot_date, cumulative_paid, lag(cumulative_paid) "
    "OVER (PARTITION BY run_id, contract_id ORDER BY snapshot_date) AS b FROM snap)",
    "cumulative_paid < b", "contract_id || '@' || strftime(snapshot_date, '%Y-%m-%d')", "warning")


@query(
    "contract_findings",
    "V3 Q1 R4 O2",
    finding("DOMAIN_VIOLATION", "applications", "channel", "app", "true", "channel")
    + " UNION ALL "
    + finding("DOMAIN_VIOLATION", "fairness_attributes", "region",
              "(SELECT r_name FROM app JOIN place ON customer_id = c_custkey)", "true", "r_name")
    + " UNION ALL " + _PAID_FELL,
)
def contract_findings(s: Source) -> DataFrame:
    """All contracts with all their rules; foreign names and reopened balances are what is found."""
    return flat(validation.validate_all(OPERATIONAL, s.tables, "strict", SCOPE))


def _schema_finding(code: str, contract: str, column: str) -> str:
    return (f"SELECT '{code}', 'error', '{contract}', '{column}', cast(0 AS bigint), "
            "cast(0 AS bigint), ''")


_AT = "contract_id || '@' || strftime(snapshot_date, '%Y-%m-%d')"
_DECISIONS = """(SELECT run_id, application_id, 'D' || application_id AS d, submitted_at AS since,
    submitted_at - to_days(CASE WHEN application_id % 60 = 11 THEN 400 ELSE 0 END) AS happened
    FROM app WHERE outcome IS NOT NULL UNION ALL SELECT run_id, application_id, 'DD' || application_id,
    submitted_at, submitted_at FROM app WHERE outcome IS NOT NULL AND application_id % 80 = 9)"""
_EVENT_ID = "CASE WHEN contract_id % 33 <> 5 THEN 'CE-' || contract_id || '-' || strftime(event_date, '%Y-%m-%d') END"
PLANTED = (
    ("DOMAIN_VIOLATION", "generation_runs", "config_hash", "runs", "run_id = 'RUN_stress'", "'not hex'"),
    ("NULL_VIOLATION", "customers", "created_at", "(SELECT c_custkey FROM customer CROSS JOIN runs)",
     "c_custkey % 50 = 1", "NULL"),
    ("DOMAIN_VIOLATION", "applications", "channel", "app", "true", "channel"),
    ("DOMAIN_VIOLATION", "application_features", "debt_to_income", "app", "application_id % 70 = 3", "9.0::double"),
    ("DOMAIN_VIOLATION", "fairness_attributes", "region",
     "(SELECT r_name FROM app JOIN place ON customer_id = c_custkey UNION ALL SELECT r_name FROM app "
     "JOIN place ON customer_id = c_custkey WHERE application_id % 90 = 7)", "true", "r_name"),
    ("PK_DUPLICATE", "fairness_attributes", "application_id",
     "(SELECT application_id, CASE WHEN application_id % 90 = 7 THEN 2 ELSE 1 END AS n FROM app)", "n > 1",
     "application_id", "error", "n"),
    ("POLICY_WINDOW_INVERTED", "policy_versions", "effective_to", "runs", "run_id = 'RUN_stress'",
     "policy_version_id"),
    ("DECISION_POLICY_NOT_VALID_AT_DECISION_TIME", "credit_decisions", "policy_version_id", _DECISIONS,
     "run_id = 'RUN_stress' OR happened < TIMESTAMP '1995-01-01'", "d"),
    ("DECISION_BEFORE_SUBMISSION", "applications", "decision_timestamp", _DECISIONS, "happened < since", "d"),
    ("DECISION_BEFORE_SUBMISSION", "credit_decisions", "decision_timestamp", _DECISIONS, "happened < since", "d"),
    ("MULTIPLE_FINAL_DECISIONS", "credit_decisions", "application_id",
     "(SELECT application_id FROM app WHERE outcome IS NOT NULL)", "application_id % 80 = 9", "application_id"),
    ("CONTRACT_BEFORE_DECISION", "contracts", "contract_date",
     "(SELECT contract_id FROM con UNION ALL SELECT contract_id FROM con WHERE contract_id % 80 = 9)",
     "contract_id % 70 = 13 AND contract_id % 60 <> 11", "contract_id"),
    ("DISBURSEMENT_BEFORE_CONTRACT", "contracts", "disbursement_date", "con", "contract_id % 55 = 17", "contract_id"),
    ("DOMAIN_VIOLATION", "contracts", "currency_unit", "con", "contract_id % 75 = 4", "'brl'"),
    ("INSTALLMENT_TOTAL_NOT_RECONCILED", "installments", "scheduled_total", "inst", "contract_id % 45 = 2",
     "installment_id"),
    ("UNIQUENESS_VIOLATION", "installments", "contract_id,installment_number",
     "(SELECT contract_id, k, count(*) AS n FROM (SELECT run_id, contract_id, CASE WHEN contract_id % 40 = 6 THEN 1 "
     "ELSE installment_number END AS k FROM inst) GROUP BY run_id, contract_id, k)", "n > 1",
     "contract_id || '-' || k", "error", "n"),
    ("CPF_LIKE_IDENTIFIER", "payments", "customer_id", "pay", "contract_id % 95 = 8", "'123.456.789-01'"),
    ("FK_ORPHAN", "payments", "customer_id", "pay", "contract_id % 95 = 8", "'123.456.789-01'"),
    ("REVERSAL_NOT_AFTER_ORIGINAL", "payments", "reversal_of_payment_id", "(SELECT * FROM pay WHERE is_reversal)",
     "contract_id % 30 = 7", "payment_id"),
    ("NEGATIVE_ALLOCATION_AMOUNT", "payment_allocations", "allocated_total", "pay", "contract_id % 65 = 9",
     "'A-' || payment_id"),
    ("DOMAIN_VIOLATION", "payment_allocations", "allocated_fees", "pay", "contract_id % 65 = 9", "'-1.00'"),
    ("ALLOCATION_TOTAL_NOT_RECONCILED", "payment_allocations", "allocated_total", "pay", "contract_id % 65 = 9",
     "'A-' || payment_id"),
    ("DPD_BUCKET_MISMATCH", "account_monthly_snapshots", "delinquency_bucket", "snap",
     "contract_id % 85 = 3 AND dpd_bucket <> '90+'", _AT),
    ("TOTAL_BALANCE_NOT_RECONCILED", "account_monthly_snapshots", "total_balance", "snap", "contract_id % 105 = 1",
     _AT),
    ("PROMISE_FIELDS_INCONSISTENT", "collection_events", "promise_to_pay", "coll",
     "contract_id % 35 = 1 AND promise_to_pay", _EVENT_ID),
    ("NULL_VIOLATION", "collection_events", "collection_event_id", "coll", "contract_id % 33 = 5", "NULL"),
    ("PK_NULL", "collection_events", "collection_event_id", "coll", "contract_id % 33 = 5", "NULL"),
    ("WRITE_OFF_AMOUNT_NOT_RECONCILED", "write_off_events", "amount", "wo", "contract_id % 25 = 4", "write_off_id"),
    ("RECOVERY_BEFORE_WRITE_OFF", "recovery_events", "recovery_date", "rec", "contract_id % 20 = 8", "recovery_id"),
)


@query(
    "planted_findings",
    "V1 V2 V3 V4 V5 V6 V7 V8 V9 V10 V11 Q1 R4 F12 F13 J19",
    " UNION ALL ".join([*[finding(*p) for p in PLANTED], _PAID_FELL,
                        _schema_finding("MISSING_COLUMN", "applications", "product"),
                        _schema_finding("UNEXPECTED_COLUMN", "applications", "extra")]),
)
def planted_findings(s: Source) -> DataFrame:
    """All contracts and rules over the portfolio with a defect of every kind."""
    spoilt = planted(s.tables, tuple(OPERATIONAL))
    return flat(validation.validate_all(OPERATIONAL, spoilt, "strict", SCOPE))


@query(
    "key_findings",
    "V4 V6 U2 A9",
    finding("PK_DUPLICATE", "lineitem", "l_orderkey,l_linenumber",
            "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)",
            "n > 1", "l_orderkey || '-' || l_linenumber", weight="n")
    + " UNION ALL "
    + finding("FK_ORPHAN", "orders", "o_custkey",
              "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)",
              "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
              "o_custkey", weight="n"),
)
def key_findings(s: Source) -> DataFrame:
    lines = validation.repeated(s.raw("lineitem"), ["l_orderkey", "l_linenumber"], (),
                                "PK_DUPLICATE", "lineitem")
    known = s.raw("customer").filter(F.col("c_mktsegment") == "BUILDING")
    lost = validation.orphans(s.raw("orders"), known, "o_custkey", "c_custkey", (), "orders")
    return flat(report([lines, lost]))


def _of(s: Source, table: str, run: str) -> DataFrame:
    return s.tables[table].filter(F.col("run_id") == run).drop("run_id")


@query(
    "relational_rule_findings",
    "V8 J18 J20 R2",
    finding("CONTRACT_WITHOUT_APPROVED_DECISION", "contracts", "application_id",
            "(SELECT c.contract_id, b.outcome FROM con c JOIN app b ON b.application_id = "
            "c.contract_id AND b.scenario = 'baseline' WHERE c.scenario = 'policy_expansion')",
            "outcome IS DISTINCT FROM 'approved'", "contract_id")
    + " UNION ALL "
    + finding("DECISION_POLICY_NOT_VALID_AT_DECISION_TIME", "credit_decisions",
              "policy_version_id",
              "(SELECT 'D' || application_id AS decision_id, submitted_at FROM app "
              "WHERE scenario = 'baseline' AND outcome IS NOT NULL)",
              "submitted_at >= TIMESTAMP '2000-06-01'", "decision_id")
    + " UNION ALL "
    + finding("MULTIPLE_FINAL_DECISIONS", "credit_decisions", "application_id",
              "(SELECT customer_id, count(*) AS n FROM app WHERE scenario = 'baseline' "
              "AND outcome IS NOT NULL GROUP BY 1)", "n > 1", "customer_id")
    + " UNION ALL "
    + finding("ALLOCATION_EXCEEDS_PAYMENT", "payment_allocations", "payment_id",
              "(SELECT payment_id, cast(amount * 0.9 AS decimal(18,2)) AS p, amount FROM pay "
              "WHERE scenario = 'baseline')", "amount - p > 0.01", "payment_id")
    + " UNION ALL "
    + finding("ALLOCATION_CROSSES_CONTRACTS", "payment_allocations", "contract_id",
              "(SELECT 'A-' || payment_id AS a, installment_id, scenario FROM pay "
              "WHERE scenario = 'policy_expansion')",
              "installment_id NOT IN (SELECT installment_id FROM inst "
              "WHERE scenario = 'baseline')", "a"),
)
def relational_rule_findings(s: Source) -> DataFrame:
    """Tables of different runs put together, which the rules must notice."""
    base, wide = RUNS[0][0], RUNS[1][0]
    decisions = _of(s, "credit_decisions", base)
    owner = _of(s, "applications", base).select("application_id", "customer_id")
    payments = _of(s, "payments", wide)
    closed = _of(s, "policy_versions", base).withColumn(
        "effective_to", F.lit("2000-06-01 00:00:00").cast("timestamp")
    )
    less = _of(s, "payments", base).withColumn(
        "amount", (F.col("amount") * F.lit("0.9").cast("decimal(3,1)")).cast("decimal(18,2)")
    )
    per_customer = decisions.join(owner, "application_id").drop("application_id").withColumnRenamed(
        "customer_id", "application_id"
    )
    ev = rules.evaluate
    return flat(union([
        ev("contract_requires_approved_final_decision",
           {"credit_decisions": decisions, "contracts": _of(s, "contracts", wide)}, "contracts"),
        ev("approval_requires_valid_policy",
           {"credit_decisions": decisions, "policy_versions": closed}, "credit_decisions"),
        ev("single_final_decision", {"credit_decisions": per_customer}, "credit_decisions"),
        ev("payment_allocation_not_exceed_payment",
           {"payment_allocations": _of(s, "payment_allocations", base), "payments": less},
           "payment_allocations"),
        ev("allocation_same_contract",
           {"payment_allocations": _of(s, "payment_allocations", wide), "payments": payments,
            "installments": _of(s, "installments", base)}, "payment_allocations"),
        ev("macro_context_provenance_consistent", s.tables, "macro_context_monthly", SCOPE),
    ]))


@query(
    "temporal_rule_findings",
    "V9 J8 J21 W6 W7",
    finding("WRITE_OFF_BEFORE_CONTRACT", "write_off_events", "write_off_date",
            "(SELECT l_orderkey, l_partkey, l_shipdate, o_orderdate FROM lineitem "
            "LEFT JOIN orders ON l_orderkey = o_orderkey)", "l_shipdate < o_orderdate",
            "l_orderkey || '/' || l_partkey")
    + " UNION ALL "
    + finding("RECOVERY_BEFORE_WRITE_OFF", "recovery_events", "recovery_date",
              "(SELECT recovery_id, recovery_date, d FROM rec LEFT JOIN (SELECT write_off_id AS i, "
              "write_off_date + 61 AS d FROM wo WHERE scenario = 'baseline') ON write_off_id = i "
              "WHERE run_id = 'RUN_baseline')", "d IS NULL OR recovery_date < d", "recovery_id")
    + " UNION ALL "
    + finding("SNAPSHOT_AFTER_TERMINAL_STATUS", "account_monthly_snapshots", "snapshot_date",
              "(SELECT run_id, contract_id, snapshot_date, min(CASE WHEN dpd >= 90 THEN "
              "snapshot_date END) OVER (PARTITION BY run_id, contract_id) AS e FROM snap)",
              "snapshot_date > e", "contract_id || '@' || strftime(snapshot_date, '%Y-%m-%d')")
    + " UNION ALL "
    + finding("BCB_DATES_NOT_STRICTLY_INCREASING", "series", "data",
              "(SELECT cast(o_orderdate AS date) AS d, row_number() OVER (PARTITION BY "
              "cast(o_orderdate AS date)) AS k FROM orders)", "k > 1",
              "strftime(d, '%d/%m/%Y')"),
)
def temporal_rule_findings(s: Source) -> DataFrame:
    lines = s.raw("lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_partkey").alias("write_off_id"),
        F.col("l_orderkey").alias("contract_id"), F.col("l_shipdate").alias("write_off_date"),
    )
    orders = s.raw("orders").select(
        F.col("o_orderkey").alias("contract_id"), F.col("o_orderdate").alias("contract_date")
    )
    base = RUNS[0][0]
    later = _of(s, "write_off_events", base).withColumn(
        "write_off_date", F.date_add("write_off_date", 61)
    )
    early_end = s.tables["account_monthly_snapshots"].withColumn(
        "status", F.when(F.col("dpd") >= 90, "charged_off").otherwise("active")
    )
    series = s.raw("orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("data"))
    ev = rules.evaluate
    t = s.tables
    return flat(union([
        ev("write_off_not_before_contract",
           {"write_off_events": lines, "contracts": orders}, "write_off_events"),
        ev("recovery_after_write_off",
           {"recovery_events": _of(s, "recovery_events", base), "write_off_events": later},
           "recovery_events"),
        ev("no_snapshot_after_terminal_status", {"account_monthly_snapshots": early_end},
           "account_monthly_snapshots", SCOPE),
        ev("bcb_dates_strictly_increasing", {"series": series}, "series"),
        # These hold on the derived portfolio and add no rows.
        ev("decision_not_before_submission", t, "credit_decisions", SCOPE),
        ev("contract_after_decision", t, "contracts", SCOPE),
        ev("disbursement_not_before_contract", t, "contracts", SCOPE),
        ev("reversal_references_earlier_payment", t, "payments", SCOPE),
        ev("policy_validity_window_not_inverted", t, "policy_versions", SCOPE),
    ]))


@query(
    "financial_rule_findings",
    "V10 V11 W5",
    finding("CUMULATIVE_PAID_DECREASED", "account_monthly_snapshots", "cumulative_paid",
            "(SELECT run_id, contract_id, snapshot_date, cumulative_paid, lag(cumulative_paid) "
            "OVER (PARTITION BY run_id, contract_id ORDER BY snapshot_date) AS b FROM snap)",
            "cumulative_paid < b", "contract_id || '@' || strftime(snapshot_date, '%Y-%m-%d')",
            "warning")
    + " UNION ALL "
    + finding("DPD_BUCKET_MISMATCH", "account_monthly_snapshots", "delinquency_bucket",
              "(SELECT contract_id, snapshot_date, dpd_bucket, CASE WHEN dpd + 1 <= 29 THEN '1-29' "
              "WHEN dpd + 1 <= 59 THEN '30-59' WHEN dpd + 1 <= 89 THEN '60-89' ELSE '90+' END "
              "AS b FROM snap)", "b <> dpd_bucket",
              "contract_id || '@' || strftime(snapshot_date, '%Y-%m-%d')"),
)
def financial_rule_findings(s: Source) -> DataFrame:
    t = s.tables
    snaps = "account_monthly_snapshots"
    shifted = {snaps: t[snaps].withColumn("dpd", F.col("dpd") + 1)}
    ev = rules.evaluate
    parts = [
        ev("cumulative_paid_non_decreasing", t, snaps, SCOPE),
        ev("cumulative_write_off_non_decreasing", t, snaps, SCOPE),
        ev("dpd_matches_bucket", shifted, snaps, SCOPE),
        ev("total_balance_reconciled", t, snaps, SCOPE),
        ev("installment_total_reconciled", t, "installments", SCOPE),
        ev("allocation_total_reconciled", t, "payment_allocations", SCOPE),
        ev("allocation_amount_not_negative", t, "payment_allocations", SCOPE),
        ev("write_off_amount_reconciled", t, "write_off_events", SCOPE),
        ev("promise_fields_require_promise_flag", t, "collection_events", SCOPE),
    ]
    return flat(union(parts))


@query(
    "ledger_rule_findings",
    "V12 L9 J16",
    " UNION ALL ".join(
        finding(code, "account_monthly_snapshots", column,
                "(SELECT b.contract_id, b.snapshot_date, " + bad + " AS bad FROM snap b LEFT JOIN "
                "state x ON x.run_id = 'RUN_stress' AND x.contract_id = b.contract_id AND "
                "x.snapshot_date = b.snapshot_date LEFT JOIN (SELECT contract_id AS c, "
                "write_off_date AS d, amount AS a FROM wo WHERE run_id = 'RUN_stress') w "
                "ON w.c = b.contract_id AND w.d <= b.snapshot_date "
                "WHERE b.run_id = 'RUN_baseline')",
                "bad", "contract_id || '@' || strftime(snapshot_date, '%Y-%m-%d')")
        for code, column, bad in (
            ("SNAPSHOT_CUMULATIVE_PAID_MISMATCH", "cumulative_paid",
             "abs(b.cumulative_paid - x.cumulative_paid) > 0.01"),
            ("SNAPSHOT_BALANCE_RECONCILIATION_FAILED", "total_balance",
             "abs(b.total_balance - greatest(x.open_total - coalesce(w.a, 0), 0)) > 0.01"),
            ("SNAPSHOT_WRITE_OFF_MISMATCH", "cumulative_write_off",
             "abs(b.cumulative_write_off - coalesce(w.a, 0)) > 0.01"),
            ("SNAPSHOT_DPD_MISMATCH", "dpd", "b.dpd <> x.dpd"),
        )
    ),
)
def ledger_rule_findings(s: Source) -> DataFrame:
    """Snapshots of the baseline held against the payments of the stress run."""
    base, stress = RUNS[0][0], RUNS[2][0]
    names = ("installments", "payments", "payment_allocations", "write_off_events")
    t = {n: _of(s, n, stress) for n in names}
    t["account_monthly_snapshots"] = _of(s, "account_monthly_snapshots", base)
    return flat(rules.evaluate("snapshot_reconciled_with_ledger", t,
                               "account_monthly_snapshots"))


@query(
    "ledger_expectation",
    "L9 J15 J16 J17 L8 F14",
    f"""SELECT p.run_id, p.contract_id, {day('p.snapshot_date').replace('AS p.snapshot_date',
        'AS snapshot_date')}, cast(x.dpd AS integer) AS expected_dpd,
        cast(x.cumulative_paid AS double) AS expected_cumulative_paid,
        cast(coalesce(w.amount, 0) AS double) AS expected_write_off,
        cast(greatest(x.open_total - coalesce(w.amount, 0), 0) AS double)
            AS expected_total_balance
        FROM snap p JOIN state x ON p.run_id = x.run_id AND p.contract_id = x.contract_id
            AND p.snapshot_date = x.snapshot_date
        LEFT JOIN wo w ON w.run_id = p.run_id AND w.contract_id = p.contract_id
            AND w.write_off_date <= p.snapshot_date""",
)
def ledger_expectation(s: Source) -> DataFrame:
    return rules.ledger_expectation(s.tables, SCOPE)


_TESTS = {
    "balance_components": "SELECT count(*) FROM acct WHERE abs(total_balance - "
    "(outstanding_principal + outstanding_interest + outstanding_fees)) > 0.01",
    "balance_non_negative": "SELECT count(*) FROM acct WHERE total_balance < 0",
    # The tests below run over tables with planted violations; see the query.
    "contract_not_before_decision": "SELECT count(*) FROM con WHERE contract_id % 70 = 13",
    "decision_not_before_submission": "SELECT count(*) FROM app WHERE outcome IS NOT NULL "
    "AND application_id % 60 = 11",
    "late_counts_nested": "SELECT count(*) FROM delinq WHERE contracts_90plus > contracts_60plus "
    "OR contracts_60plus > contracts_30plus OR contracts_30plus > total_contracts",
    "keys_do_not_collide": f"SELECT count(*) FROM (SELECT c_custkey FROM customer CROSS JOIN runs "
    f"GROUP BY 1 HAVING count(DISTINCT {key('run_id', 'c_custkey')}) <> count(DISTINCT run_id))",
    "terminal_stays_terminal": "SELECT count(*) FROM acct a JOIN acct b ON a.run_id = b.run_id "
    "AND a.contract_id = b.contract_id AND b.snapshot_date > a.snapshot_date "
    "WHERE a.contract_status IN ('settled', 'charged_off') "
    "AND b.contract_status IN ('active', 'delinquent')",
    "only_completed_runs": "SELECT count(*) FROM runs WHERE run_id = 'RUN_stress'",
    "pre_shock_identical": "SELECT count(*) FROM (SELECT snapshot_date FROM delinq "
    "WHERE snapshot_date < DATE '1999-01-01' AND scenario IN ('baseline', "
    "'macroeconomic_stress') GROUP BY 1 HAVING count(DISTINCT balance_90plus) > 1 "
    "OR count(DISTINCT contracts_90plus) > 1)",
    "prior_status_from_past": "SELECT count(*) FROM acct a WHERE a.prior_status IS DISTINCT FROM "
    "(SELECT arg_max(b.contract_status, b.snapshot_date) FROM acct b WHERE b.run_id = a.run_id "
    "AND b.contract_id = a.contract_id AND b.snapshot_date < a.snapshot_date)",
    "row_counts_reconcile": "SELECT (SELECT count(*) > 0 FROM customer WHERE c_custkey % 50 = 1)::bigint "
    "+ (SELECT count(*) > 0 FROM pay WHERE contract_id % 95 = 8)::bigint",
    "recovery_within_write_off": "SELECT count(*) FROM woo WHERE recovery_amount > amount",
    "no_recovery_fanout": "SELECT count(*) FROM (SELECT run_id, write_off_id FROM woo "
    "GROUP BY 1, 2 HAVING count(*) > 1)",
}


@query(
    "data_test_summary",
    "V13 J8 J9 O4 U1 A9",
    " UNION ALL ".join(
        f"SELECT '{n}' AS test, cast(({q}) AS bigint) AS violations" for n, q in _TESTS.items()
    ),
)
def data_test_summary(s: Source) -> DataFrame:
    w = s.wh
    w.settle("delinquency", "writeoffs")
    names = ("customers", "applications", "contracts", "installments", "payments",
             "account_monthly_snapshots", "write_off_events", "recovery_events")
    staged = {n: w.stg(n) for n in names}
    # Violations that the derived portfolio has none of: early contracts and decisions, a run that
    # failed, rows lost on the way.
    staged["customers"] = staged["customers"].filter(F.col("customer_id") % 50 != 1)
    staged["payments"] = staged["payments"].filter(F.col("contract_id") % 95 != 8)
    early = spoil(w.journey, "contract_date", every("application_id", 70, 13),
                  F.col("contract_date") - F.expr("INTERVAL 10 DAYS"))
    hasty = spoil(w.journey, "decision_timestamp", every("application_id", 60, 11),
                  F.col("decision_timestamp") - F.expr("INTERVAL 400 DAYS"))
    runs = spoil(w.stg("generation_runs"), "status", F.col("run_id") == STRESS, F.lit("failed"))
    return data_tests.summary({
        "balance_components": data_tests.balance_components(w.account_monthly),
        "balance_non_negative": data_tests.balance_non_negative(w.account_monthly),
        "contract_not_before_decision": data_tests.contract_not_before_decision(early),
        "decision_not_before_submission": data_tests.decision_not_before_submission(hasty),
        "late_counts_nested": data_tests.late_counts_nested(w.delinquency),
        "keys_do_not_collide": data_tests.keys_do_not_collide(w.stg("customers")),
        "terminal_stays_terminal": data_tests.terminal_stays_terminal(w.account_monthly),
        "only_completed_runs": data_tests.only_completed_runs(runs),
        "pre_shock_identical": data_tests.pre_shock_identical(w.stress),
        "prior_status_from_past": data_tests.prior_status_from_past(w.history),
        "row_counts_reconcile": data_tests.row_counts_reconcile(s.tables, staged, names),
        "recovery_within_write_off": data_tests.recovery_within_write_off(w.write_off_outcomes),
        "no_recovery_fanout": data_tests.no_recovery_fanout(w.write_off_outcomes),
    })


@query(
    "column_tests",
    "R3",
    f"""SELECT 'not_null' AS test, 'contracts' AS "table", c AS "column", 0::bigint AS failures
            FROM (VALUES ('contract_key'), ('customer_key'), ('run_id')) AS v(c)
        UNION ALL SELECT 'unique', 'contracts', 'contract_key', (SELECT count(*) FROM (SELECT 1
            FROM con GROUP BY {key('run_id', 'contract_id')} HAVING count(*) > 1))
        UNION ALL SELECT 'unique', 'contracts', 'customer_id', (SELECT count(*) FROM (SELECT 1
            FROM con GROUP BY customer_id HAVING count(*) > 1))
        UNION ALL SELECT 'accepted_values', 'contracts', 'scenario', (SELECT count(*) FROM con
            WHERE scenario NOT IN ('baseline', 'policy_expansion'))
        UNION ALL SELECT 'relationships', 'contracts', 'customer_key', 0""",
)
def column_tests(s: Source) -> DataFrame:
    return validation.column_tests(
        s.wh.stg("contracts"), "contracts",
        not_null=("contract_key", "customer_key", "run_id"),
        unique=("contract_key", "customer_id"),
        accepted={"scenario": ("baseline", "policy_expansion")},
        relationships={"customer_key": (s.wh.stg("customers"), "customer_key")},
    )


# --- profiles --------------------------------------------------------------------------


def _profile_sql(table: str, columns: dict[str, bool]) -> str:
    parts = []
    for c, numeric in columns.items():
        lo = f"cast(min({c}) AS double)" if numeric else "NULL::double"
        hi = f"cast(max({c}) AS double)" if numeric else "NULL::double"
        parts.append(
            f"""SELECT '{c}' AS "column", count(*) AS num_rows,
            count(*) - count({c}) AS missing_count,
            round((count(*) - count({c})) * 100.0::double / count(*), 6) AS missing_pct,
            count(DISTINCT {c}) AS cardinality, count(DISTINCT {c}) <= 1 AS is_constant,
            count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_possible_identifier,
            round({lo}, 6) AS min_value, round({hi}, 6) AS max_value, 0::bigint AS infinite_count
            FROM {table}"""
        )
    return " UNION ALL ".join(parts)


_DOC = {"doc_id": True, "text": False, "lang": False, "source": False, "n_chars": True}


@query("column_profile", "Q5", _profile_sql("documents", _DOC))
def column_profile(s: Source) -> DataFrame:
    return profiling.column_profile(s.raw("documents").select(*_DOC))


@query(
    "top_values",
    "A11 Q5",
    """WITH c AS (SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY 2
            UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
            UNION ALL SELECT 'text', text, count(*) FROM documents GROUP BY 2),
        s AS (SELECT "column" AS k FROM c GROUP BY 1 HAVING count(*) <= 30)
        SELECT "column", value, n, cast(row_number() OVER (PARTITION BY "column"
            ORDER BY n DESC, value) AS integer) AS rank
        FROM c JOIN s ON "column" = k QUALIFY rank <= 10""",
)
def top_values(s: Source) -> DataFrame:
    return profiling.top_values(s.raw("documents").select("lang", "source", "text"))


@query(
    "duplicate_rows",
    "U5 Q5",
    """SELECT 'documents' AS source, (SELECT count(*) FROM documents) AS num_rows, (SELECT count(*)
            FROM documents) - count(*) AS exact_duplicate_rows, count(*) AS kept
            FROM (SELECT DISTINCT * FROM documents)
        UNION ALL SELECT 'documents without id', (SELECT count(*) FROM documents), (SELECT count(*)
            FROM documents) - count(*), count(*) FROM (SELECT DISTINCT * EXCLUDE (doc_id) FROM documents)
        UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*)
            FROM lineitem) - count(*), count(*) FROM (SELECT DISTINCT * FROM lineitem)""",
)
def duplicate_rows(s: Source) -> DataFrame:
    """Whole rows."""
    out = []
    for name, df in (("documents", s.raw("documents")), ("lineitem", s.raw("lineitem")),
                     ("documents without id", s.raw("documents").drop("doc_id"))):
        size = profiling.duplicate_rows(df).withColumn("source", F.lit(name))
        kept = profiling.drop_repeats(df).agg(
            F.lit(name).alias("source"), F.count(F.lit(1)).alias("kept")
        )
        out.append(size.join(kept, "source"))
    return union(out)


@query(
    "audit_findings",
    "Q6 U2",
    """SELECT 'supplier' AS source_id, c AS "column", 'unique_per_row' AS issue,
            CASE WHEN c = 's_suppkey' THEN 'documented_characteristic'
                ELSE 'hypothesis_requiring_investigation' END AS category,
            (SELECT count(*) FROM supplier) AS detail_count
            FROM (VALUES ('s_suppkey'), ('s_name')) AS v(c)
        UNION ALL SELECT 'supplier', 's_acctbal', 'unique_per_row',
            'hypothesis_requiring_investigation', count(*) FROM supplier
            HAVING count(DISTINCT s_acctbal) = count(*)
        UNION ALL SELECT 'supplier', 's_nationkey', 'unique_per_row',
            'hypothesis_requiring_investigation', count(*) FROM supplier
            HAVING count(DISTINCT s_nationkey) = count(*)
        UNION ALL SELECT 'supplier', 's_nationkey', 'undocumented_column', 'candidate_anomaly', 0
        UNION ALL SELECT 'supplier', 's_phone', 'missing_column', 'confirmed_problem', 0""",
)
def audit_findings(s: Source) -> DataFrame:
    return profiling.audit(
        s.raw("supplier"), "supplier", ["s_suppkey", "s_name", "s_acctbal", "s_phone"],
        id_columns=["s_suppkey"],
    )


@query(
    "source_profiles",
    "Q7",
    """SELECT 'part' AS source_id, (SELECT count(*) FROM part) AS num_rows, 6 AS num_columns,
            0::bigint AS missing_value_findings, 0::bigint AS confirmed_problems,
            (SELECT (count(DISTINCT p_partkey) = count(*))::bigint
              + (count(DISTINCT p_name) = count(*))::bigint
              + (count(DISTINCT p_retailprice) = count(*))::bigint FROM part) AS findings
        UNION ALL SELECT 'region', count(*), 2, 0, 0, 2 FROM region""",
)
def source_profiles(s: Source) -> DataFrame:
    return profiling.source_profiles({"part": s.raw("part"), "region": s.raw("region")})


# --- batch input -----------------------------------------------------------------------

EVENT_INPUT = batch_input.BatchContract(
    "user_id", ("value", "k"), domains={"k": tuple(range(80))}, bounds={"value": 100.0},
    tolerated=("event_id",), order_column="event_id",
)


def event_batches(s: Source) -> DataFrame:
    return s.raw("events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("batch"), "event_id", "user_id", "value",
        F.get_json_object("props", "$.k").alias("k"),
    )


_EV = """(SELECT strftime(ts, '%Y-%m-%d') AS batch, event_id, user_id, value,
    cast(json_extract_string(props, '$.k') AS double) AS k, row_number() OVER (PARTITION BY
    strftime(ts, '%Y-%m-%d'), user_id ORDER BY event_id) AS nth FROM events)"""


@query(
    "batch_quality",
    "Q2 Q4 P13",
    f"""SELECT batch, count(*) AS row_count,
        round(cast(count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE k IS NULL)
            AS double) / count(*), 6) AS missingness_rate,
        round(cast(count(*) FILTER (WHERE nth > 1) AS double) / count(*), 6) AS duplicate_rate,
        round(cast(count(*) FILTER (WHERE k NOT BETWEEN 0 AND 79) AS double) / count(*), 6)
            AS domain_violation_rate,
        round(cast(count(*) FILTER (WHERE abs(value) > 100) AS double) / count(*), 6)
            AS range_violation_rate,
        count(*) FILTER (WHERE nth = 1 AND k BETWEEN 0 AND 79 AND abs(value) <= 100)
            AS clean_rows FROM {_EV} GROUP BY 1""",
)
def batch_quality(s: Source) -> DataFrame:
    df = event_batches(s)
    if batch_input.schema_violations(df, EVENT_INPUT, ["batch"]):
        raise batch_input.SchemaViolation("events do not match their contract")
    return batch_input.quality_rates(
        batch_input.mark_rows(df, EVENT_INPUT, ["batch"]), ["batch"]
    )


@query(
    "quarantine",
    "S10 Q2 Q3",
    f"""WITH v AS (SELECT batch, user_id, 'duplicate_id' AS r FROM {_EV} WHERE nth > 1
            UNION SELECT batch, user_id, 'domain_violation' FROM {_EV}
                WHERE k NOT BETWEEN 0 AND 79
            UNION SELECT batch, user_id, 'range_violation' FROM {_EV} WHERE abs(value) > 100),
        q AS (SELECT batch, user_id, string_agg(r, ';' ORDER BY r) AS reasons FROM v GROUP BY 1, 2)
        SELECT e.event_id, e.batch, e.user_id, coalesce(q.reasons, 'clean') AS outcome
        FROM {_EV} e LEFT JOIN q ON e.batch = q.batch AND e.user_id = q.user_id""",
)
def quarantine(s: Source) -> DataFrame:
    clean, bad = batch_input.split_batch(event_batches(s), EVENT_INPUT, ["batch"])
    shown = ["event_id", "batch", "user_id"]
    return clean.select(*shown, F.lit("clean").alias("outcome")).unionByName(
        bad.select(*shown, F.col("quarantine_reasons").alias("outcome"))
    )


# --- reconciliation and fingerprints ---------------------------------------------------


@query(
    "reconciliation",
    "Q8 F15",
    f"""WITH f AS (SELECT run_id, cast(sum(total_balance) AS double) AS b,
            cast(sum(cumulative_paid) AS double) AS p, cast(coalesce(sum(total_balance)
            FILTER (WHERE dpd >= 90), 0) AS double) AS l FROM finalrow GROUP BY 1),
        v AS (
        SELECT run_id, 'approval_rate' AS "check", cast(count(*) FILTER
            (WHERE outcome = 'approved') AS double) / count(*) AS x FROM app
            WHERE outcome IS NOT NULL GROUP BY 1
        UNION ALL SELECT run_id, 'outstanding_balance', b FROM f
        UNION ALL SELECT run_id, 'par90', CASE WHEN b > 0 THEN l / b ELSE 0 END FROM f
        UNION ALL SELECT run_id, 'cure_rate', cast(count(*) FILTER (WHERE is_cure) AS double)
            / count(*) FILTER (WHERE prior_status = 'delinquent') FROM acct GROUP BY 1
        UNION ALL SELECT run_id, 'write_off_amount', cast(sum(amount) AS double) FROM wo GROUP BY 1
        UNION ALL SELECT run_id, 'recovery_amount', cast(sum(amount) AS double) FROM rec GROUP BY 1
        UNION ALL SELECT run_id, 'paid_amount', p FROM f
        UNION ALL SELECT run_id, 'scheduled_amount', cast(sum(scheduled_total) AS double)
            FROM inst GROUP BY 1)
        SELECT run_id, "check", round(x, 6) AS raw_value, round(x, 6) AS mart_value,
            CASE WHEN "check" LIKE '%amount' OR "check" LIKE '%balance' THEN 'cents'
                ELSE 'ratio' END AS unit, true AS passed FROM v""",
)
def reconcile(s: Source) -> DataFrame:
    w = s.wh
    return reconciliation.reconcile(
        s.tables, w.decisions, w.portfolio, w.delinquency, w.writeoffs, w.installments
    )


# All tables and all their columns: "f" fractions, "t" times, "a" arrays of fractions, "" others.
_PRINTED = {
    "benchmark": {"item_id": "", "text": ""},
    "conversations": {"conv_id": "", "turn": "", "role": "", "text": ""},
    "customer": {"c_custkey": "", "c_name": "", "c_nationkey": "", "c_acctbal": "f", "c_mktsegment": ""},
    "documents": {"doc_id": "", "text": "", "lang": "", "source": "", "n_chars": ""},
    "embeddings": {"vec_id": "", "embedding": "a", "label": ""},
    "events": {"event_id": "", "ts": "t", "user_id": "", "event_type": "", "value": "f", "props": ""},
    "labels": {"doc_id": "", "quality": "", "toxic": ""},
    "lineitem": {"l_orderkey": "", "l_partkey": "", "l_suppkey": "", "l_linenumber": "", "l_quantity": "f",
                 "l_extendedprice": "f", "l_discount": "f", "l_tax": "f", "l_returnflag": "", "l_linestatus": "",
                 "l_shipdate": "t"},
    "nation": {"n_nationkey": "", "n_name": "", "n_regionkey": ""},
    "orders": {"o_orderkey": "", "o_custkey": "", "o_orderstatus": "", "o_totalprice": "f", "o_orderdate": "t",
               "o_orderpriority": ""},
    "pages": {"page_id": "", "url": "", "html": ""},
    "part": {"p_partkey": "", "p_name": "", "p_brand": "", "p_type": "", "p_size": "", "p_retailprice": "f"},
    "region": {"r_regionkey": "", "r_name": ""},
    "supplier": {"s_suppkey": "", "s_name": "", "s_nationkey": "", "s_acctbal": "f"},
}
_TEXT = {
    "": "cast({c} AS varchar)",
    "f": "cast(cast(floor({c} * 1000000) AS bigint) AS varchar)",
    "t": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
    "a": r"array_to_string(list_transform({c}, lambda x: coalesce(cast(cast(floor(cast(x AS double) * 1000000) "
         r"AS bigint) AS varchar), '\x00NULL\x00')), ',')",
}


def _digest_sql(table: str) -> str:
    parts = ", ".join(rf"coalesce({_TEXT[k].format(c=c)}, '\x00NULL\x00')" for c, k in sorted(_PRINTED[table].items()))
    return f"cast(cast('0x' || substr(sha256(concat_ws(chr(31), {parts})), 1, 15) AS bigint) AS decimal(38,0))"


def _print_sql(table: str) -> str:
    return (f"SELECT '{table}' AS table_name, count(*) AS n_rows, "
            f"cast(sum({_digest_sql(table)}) AS varchar) AS fingerprint FROM {table}")


@query("table_fingerprints", "Q10 A10", " UNION ALL ".join(_print_sql(t) for t in _PRINTED))
def table_fingerprints(s: Source) -> DataFrame:
    """All columns of all tables."""
    return union([
        table_fingerprint(canonical(s.raw(t))).select(F.lit(t).alias("table_name"), "n_rows", "fingerprint")
        for t in _PRINTED
    ])


def _repriced(s: Source) -> dict[str, DataFrame]:
    """All tables, some orders at another price."""
    out = {t: s.raw(t) for t in _PRINTED}
    moved = F.when(F.col("o_orderkey") % 5000 == 123, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    out["orders"] = out["orders"].withColumn("o_totalprice", moved)
    return out


@query(
    "build_fingerprint",
    "Q11 Q9",
    "WITH t AS (" + " UNION ALL ".join(_print_sql(t) for t in _PRINTED) + """),
        b AS (SELECT count(*) AS tables, cast(sum(n_rows) AS bigint) AS n_rows,
            sha256(string_agg(table_name || '|' || n_rows || '|' || fingerprint, chr(10)
                ORDER BY table_name)) AS fingerprint FROM t)
        SELECT tables, n_rows, fingerprint, tables AS rows_match,
            tables - (SELECT count(*) > 0 FROM orders WHERE o_orderkey % 5000 = 123)::bigint AS content_matches
        FROM b""",
)
def build_print(s: Source) -> DataFrame:
    """The tables, and a later check of them with some prices changed."""
    recorded = settle(table_fingerprints(s))
    again = check_recorded({t: canonical(df) for t, df in _repriced(s).items()}, recorded).agg(
        F.count_if("rows_match").alias("rows_match"),
        F.count_if("content_matches").alias("content_matches"),
    )
    return with_one_row(build_fingerprint({t: canonical(s.raw(t)) for t in _PRINTED}), again)


LEAF, TREE_FAN, TREE_LEVELS = 256, 16, 3


@query(
    "changed_ranges",
    "Q9",
    f"""SELECT 'range' AS kind, o_orderkey // {LEAF} * {LEAF} AS first_key, count(*) AS rows_then, count(*) AS rows_now
        FROM orders GROUP BY 2 HAVING count(*) FILTER (WHERE o_orderkey % 5000 = 123) > 0
        UNION ALL SELECT 'changed', o_orderkey, 1, 1 FROM orders WHERE o_orderkey % 5000 = 123""",
)
def located(s: Source) -> DataFrame:
    """Ranges whose digests differ from the recorded ones, then the keys inside them."""
    before, after = s.raw("orders"), _repriced(s)["orders"]
    trees = [settle(print_tree(range_prints(df, "o_orderkey", LEAF), TREE_FAN, TREE_LEVELS)) for df in (before, after)]
    ranges = fingerprint.changed_ranges(*trees, TREE_FAN)
    keys = fingerprint.changed_keys(before, after, "o_orderkey", LEAF, ranges)
    one = F.lit(1).cast("bigint")
    return ranges.select(F.lit("range").alias("kind"), (F.col("node") * LEAF).alias("first_key"), "rows_then", "rows_now"
                         ).unionByName(keys.select(F.col("change").alias("kind"), F.col("o_orderkey").alias("first_key"),
                                                   one.alias("rows_then"), one.alias("rows_now")))


# --- ledger operators ------------------------------------------------------------------


@query(
    "amortization_schedule",
    "L1 F6",
    """WITH RECURSIVE c AS (SELECT run_id, contract_id, financed_amount, term_months AS n,
            first_due_date, cast(cast(interest_total AS double) / cast(financed_amount AS double)
            AS decimal(18,8)) AS r, cast(interest_total AS double)
            / cast(financed_amount AS double) AS d FROM con),
        l AS (SELECT *, CASE WHEN d = 0 THEN cast(cast(financed_amount AS double) / n
            AS decimal(18,2)) ELSE cast(cast(financed_amount AS double) * d
            / (1 - pow(1 + d, -n)) AS decimal(18,2)) END AS level FROM c),
        s AS (SELECT run_id, contract_id, n, r, level, first_due_date, 1 AS k,
            financed_amount AS balance FROM l
          UNION ALL SELECT run_id, contract_id, n, r, level, first_due_date, k + 1,
            cast(balance - (level - cast(balance * r AS decimal(18,2))) AS decimal(18,2))
            FROM s WHERE k < n)
        SELECT run_id, contract_id, contract_id || '-' || k AS installment_id,
            k AS installment_number, strftime(first_due_date + to_months(k - 1), '%Y-%m-%d')
            AS due_date, cast(CASE WHEN k < n THEN level - cast(balance * r AS decimal(18,2))
            ELSE balance END AS double) AS scheduled_principal,
            cast(cast(balance * r AS decimal(18,2)) AS double) AS scheduled_interest,
            0.0::double AS scheduled_fees, cast(CASE WHEN k < n THEN level ELSE balance
            + cast(balance * r AS decimal(18,2)) END AS double) AS scheduled_total FROM s""",
)
def amortization(s: Source) -> DataFrame:
    return ledger.amortization_schedule(s.tables["contracts"])


@query(
    "payment_waterfall",
    "L2",
    """WITH p AS (SELECT run_id, contract_id, payment_id, sum(amount) OVER w AS e,
            sum(amount) OVER w - amount AS b FROM pay y WHERE tag <> 'R1' AND NOT (tag = 'P1'
            AND EXISTS (SELECT 1 FROM pay z WHERE z.run_id = y.run_id
            AND z.payment_id = y.installment_id || '-R1'))
            WINDOW w AS (PARTITION BY run_id, contract_id ORDER BY paid_on, payment_id
            ROWS UNBOUNDED PRECEDING)),
        d AS (SELECT run_id, contract_id, installment_id, scheduled_interest AS i,
            scheduled_principal AS q, sum(scheduled_total) OVER (PARTITION BY run_id, contract_id
            ORDER BY due_date, installment_id ROWS UNBOUNDED PRECEDING) - scheduled_total AS s
            FROM inst),
        o AS (SELECT d.run_id, d.contract_id, payment_id, installment_id,
            greatest(least(e, s + i) - greatest(b, s), 0) AS ai,
            greatest(least(e, s + i + q) - greatest(b, s + i), 0) AS ap
            FROM d JOIN p ON d.run_id = p.run_id AND d.contract_id = p.contract_id)
        SELECT run_id, contract_id, payment_id, installment_id, 0.0::double AS allocated_fees,
            cast(ai AS double) AS allocated_interest, cast(ap AS double) AS allocated_principal,
            cast(ai + ap AS double) AS allocated_total FROM o WHERE ai + ap > 0""",
)
def waterfall(s: Source) -> DataFrame:
    kept = ledger.without_reversed(s.tables["payments"])
    return ledger.allocate_payments(kept, s.tables["installments"])


@query(
    "installment_status",
    "L6",
    """WITH f AS (SELECT i.run_id, i.contract_id, i.installment_id, i.due_date,
            i.scheduled_total AS t, i.scheduled_total - least(greatest(coalesce(sum(
            CASE WHEN y.is_reversal THEN -y.amount ELSE y.amount END), 0), 0), i.scheduled_total)
            AS o FROM inst i LEFT JOIN pay y ON i.run_id = y.run_id
            AND i.installment_id = y.installment_id GROUP BY 1, 2, 3, 4, 5)
        SELECT f.run_id, f.installment_id, cast(o AS double) AS outstanding_balance,
            CASE WHEN o <= 0 THEN 'paid' WHEN w.contract_id IS NOT NULL THEN 'written_off'
                WHEN o < t THEN 'partially_paid' WHEN due_date < DATE '2001-12-31' THEN 'overdue'
                WHEN due_date <= DATE '2001-12-31' THEN 'due' ELSE 'scheduled' END AS status
        FROM f LEFT JOIN wo w ON f.run_id = w.run_id AND f.contract_id = w.contract_id""",
)
def installment_status(s: Source) -> DataFrame:
    return s.tables["installments"].select(
        "run_id", "installment_id", "outstanding_balance", "status"
    )


@query(
    "collection_candidates",
    "L7 F11",
    f"""SELECT s.run_id, s.contract_id, strftime(s.snapshot_date, '%Y-%m-%d') AS snapshot_date,
        s.dpd, CASE WHEN s.dpd < 30 THEN 'early_stage_soft' WHEN s.dpd < 90 THEN 'mid_stage_firm'
        ELSE 'late_stage_hard' END AS strategy, cast(sum(p.scheduled_total - p.paid) AS double)
        AS amount_due FROM snap s JOIN position p ON s.run_id = p.run_id
        AND s.contract_id = p.contract_id AND s.snapshot_date = p.snapshot_date
        AND p.due_date <= s.snapshot_date
        WHERE s.contract_status IN ('active', 'delinquent') AND s.dpd >= 15
        GROUP BY 1, 2, 3, 4, 5""",
)
def collection_candidates(s: Source) -> DataFrame:
    t = s.tables
    steps = ledger.installment_steps(
        t["installments"],
        ledger.settled_movements(
            t["payment_allocations"], t["payments"], [*ledger.BY_CONTRACT, "payment_id"]
        ),
    )
    late = ledger.collection_candidates(t["account_monthly_snapshots"], t["installments"], steps)
    return late.select("run_id", "contract_id", "snapshot_date", "dpd",
                       collection_strategy("dpd").alias("strategy"), "amount_due")


@query(
    "asof_last_view",
    "J15",
    """WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view'
            GROUP BY 1, 2)
        SELECT p.event_id, p.user_id, v.value AS viewed FROM (SELECT * FROM events
            WHERE event_type = 'purchase') p ASOF LEFT JOIN v
            ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_last_view(s: Source) -> DataFrame:
    e = s.raw("events")
    views = e.filter(F.col("event_type") == "view").groupBy("user_id", "ts").agg(
        F.max("value").alias("viewed")
    )
    buys = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    return asof_join(buys, views, ["user_id"], "ts", "ts", ["viewed"]).drop("ts")


@query(
    "running_totals",
    "W4",
    """SELECT event_id, user_id, cast(sum(cast(value AS decimal(18,2))) OVER (PARTITION BY user_id
        ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS double) AS spent_so_far FROM events
        WHERE event_type = 'purchase'""",
)
def running_totals(s: Source) -> DataFrame:
    e = s.raw("events").filter(F.col("event_type") == "purchase").select(
        "event_id", "user_id", "ts", F.col("value").cast("decimal(18,2)").alias("v")
    )
    return scan(e, ["user_id"], "ts", Scan(sums={"spent_so_far": "v"}), tie="event_id").select(
        "event_id", "user_id", "spent_so_far"
    )


@query(
    "demo_extract",
    "S11",
    f"""WITH g AS (SELECT run_id, suite_id, scenario, count(*) AS contracts,
            count(*) FILTER (WHERE cure_count > 0) AS contracts_ever_cured,
            count(*) FILTER (WHERE relapse_count > 0) AS contracts_ever_relapsed,
            count(*) FILTER (WHERE cure_count > 0 AND relapse_count > 0) AS contracts_redefaulted
            FROM cured GROUP BY 1, 2, 3)
        SELECT *, {ratio('contracts_redefaulted', 'contracts_ever_cured')} AS redefault_rate
        FROM g""",
)
def demo(s: Source) -> DataFrame:
    return demo_extract(s.wh.cures)
