"""Staging, facts, dimensions and marts as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.functions.buckets import bucket_dimension
from loanweave.operators import marts
from loanweave.operators import star_models as models
from loanweave.plans.catalog import Source, query
from loanweave.plans.oracle_tables import TAG_COLUMNS, key, ratio, rnd


def money(*names: str) -> str:
    return ", ".join(f"cast({n} AS double) AS {n}" for n in names)


def day(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%d') AS {n}" for n in names)


@query(
    "snapshot_ledger",
    "L3 L4 L5 L8 J15 J17 W4 W6 F4 F7 S7 P6",
    f"""SELECT run_id, contract_id, {day('snapshot_date', 'next_due_date')}, dpd, dpd_bucket,
        contract_status, {money('outstanding_principal', 'outstanding_interest',
        'outstanding_fees', 'total_balance', 'past_due_amount', 'exposure', 'cumulative_paid',
        'cumulative_write_off')} FROM snap""",
)
def snapshot_ledger(s: Source) -> DataFrame:
    return s.wh.stg("account_monthly_snapshots").select(
        "run_id", "contract_id", "snapshot_date", "next_due_date", "dpd", "dpd_bucket",
        "contract_status", "outstanding_principal", "outstanding_interest", "outstanding_fees",
        "total_balance", "past_due_amount", "exposure", "cumulative_paid",
        "cumulative_write_off",
    )


@query(
    "staged_contracts",
    "S1 S2 P1 P2 P3 R1 F20",
    f"""SELECT {key('run_id', 'contract_id')} AS contract_key,
        {key('run_id', 'contract_id')} AS application_key,
        {key('run_id', 'customer_id')} AS customer_key, {TAG_COLUMNS}, contract_id,
        contract_id AS application_id, customer_id, {money('financed_amount')}, term_months,
        round(cast(interest_total AS double) / cast(financed_amount AS double), 6)
            AS contract_rate, {day('first_due_date')} FROM con""",
)
def staged_contracts(s: Source) -> DataFrame:
    return s.wh.stg("contracts").select(
        "contract_key", "application_key", "customer_key", "run_id", "suite_id", "scenario",
        "seed", "scale", "contract_id", "application_id", "customer_id", "financed_amount",
        "term_months", "contract_rate", "first_due_date",
    )


@query(
    "fact_payments",
    "P4 P5 P6 P8 F1",
    f"""SELECT {key('run_id', 'payment_id')} AS payment_key,
        {key('run_id', 'contract_id')} AS contract_key,
        CASE WHEN is_reversal THEN {key('run_id', "installment_id || '-P1'")} END
            AS reversal_of_payment_key,
        run_id, payment_id, strftime(date_trunc('month', paid_on), '%Y-%m-%d') AS payment_month,
        {money('amount')}, cast(CASE WHEN is_reversal THEN -amount ELSE amount END AS double)
            AS net_amount, channel, payment_type, is_reversal FROM pay""",
)
def fact_payments(s: Source) -> DataFrame:
    return s.wh.payments.select(
        "payment_key", "contract_key", "reversal_of_payment_key", "run_id", "payment_id",
        "payment_month", "amount", "net_amount", "channel", "payment_type", "is_reversal",
    )


@query(
    "application_journey",
    "J1 P5",
    f"""SELECT a.run_id, a.application_id, a.outcome AS decision_outcome,
        a.outcome IS NOT NULL AS was_decided, a.outcome = 'approved' AS is_approved,
        c.contract_id IS NOT NULL AS is_booked, cast(c.financed_amount AS double)
            AS financed_amount
        FROM app a LEFT JOIN con c ON a.run_id = c.run_id AND a.application_id = c.contract_id""",
)
def application_journey(s: Source) -> DataFrame:
    return s.wh.journey.select(
        "run_id", "application_id", "decision_outcome", "was_decided", "is_approved",
        "is_booked", "financed_amount",
    )


@query(
    "fact_account_monthly",
    "J2 W1 W2 M11 F2 P8",
    f"""SELECT {key('run_id', 'contract_id')} AS contract_key, run_id, contract_id,
        {day('snapshot_date', 'vintage_month')}, months_on_book, dpd_bucket, contract_status,
        prior_bucket AS prior_month_dpd_bucket, prior_status AS prior_month_status,
        {money('total_balance')}, is_cure AS is_cure_month, is_relapse AS is_relapse_month
        FROM acct""",
)
def fact_account_monthly(s: Source) -> DataFrame:
    return s.wh.account_monthly.select(
        "contract_key", "run_id", "contract_id", "snapshot_date", "vintage_month",
        "months_on_book", "dpd_bucket", "contract_status", "prior_month_dpd_bucket",
        "prior_month_status", "total_balance", "is_cure_month", "is_relapse_month",
    )


@query(
    "write_off_outcomes",
    "J3 M14 F3 P5",
    f"""SELECT run_id, contract_id, write_off_id, {day('write_off_date', 'recovery_date')},
        cast(amount AS double) AS write_off_amount, cast(principal AS double)
            AS write_off_principal, cast(interest AS double) AS write_off_interest,
        {money('recovery_amount')}, days_to_recovery, recovery_id IS NOT NULL AS has_recovery,
        {ratio('recovery_amount', 'amount')} AS recovery_rate FROM woo""",
)
def write_off_outcomes(s: Source) -> DataFrame:
    return s.wh.write_off_outcomes.select(
        "run_id", "contract_id", "write_off_id", "write_off_date", "recovery_date",
        "write_off_amount", "write_off_principal", "write_off_interest", "recovery_amount",
        "days_to_recovery", "has_recovery", "recovery_rate",
    )


@query(
    "other_facts",
    "P8",
    f"""SELECT run_id, 'applications' AS fact, strftime(date_trunc('month', submitted_at),
            '%Y-%m-%d') AS month, count(*) AS n_rows, cast(sum(requested_amount) AS double)
            AS amount FROM app GROUP BY 1, 2, 3
        UNION ALL SELECT run_id, 'decisions', strftime(date_trunc('month', submitted_at),
            '%Y-%m-%d'), count(*), cast(coalesce(sum(requested_amount)
            FILTER (WHERE outcome = 'approved'), 0) AS double) FROM app
            WHERE outcome IS NOT NULL GROUP BY 1, 2, 3
        UNION ALL SELECT run_id, 'contracts', strftime(date_trunc('month', submitted_at),
            '%Y-%m-%d'), count(*), cast(sum(financed_amount) AS double) FROM con GROUP BY 1, 2, 3
        UNION ALL SELECT run_id, 'installments', strftime(date_trunc('month', due_date),
            '%Y-%m-%d'), count(*), cast(sum(scheduled_total) AS double) FROM inst GROUP BY 1, 2, 3
        UNION ALL SELECT run_id, 'collections', strftime(date_trunc('month', event_date),
            '%Y-%m-%d'), count(*), cast(coalesce(sum(past_due_amount)
            FILTER (WHERE promise_to_pay), 0) AS double) FROM coll GROUP BY 1, 2, 3
        UNION ALL SELECT run_id, 'recoveries', strftime(date_trunc('month', recovery_date),
            '%Y-%m-%d'), count(*), cast(sum(amount) AS double) FROM rec GROUP BY 1, 2, 3
        UNION ALL SELECT run_id, 'writeoffs', strftime(date_trunc('month', write_off_date),
            '%Y-%m-%d'), count(*), cast(sum(amount) AS double) FROM wo GROUP BY 1, 2, 3""",
)
def other_facts(s: Source) -> DataFrame:
    parts = [
        ("applications", s.wh.applications, "submitted_month", "requested_amount"),
        ("decisions", s.wh.decisions, "decision_month", "approved_amount"),
        ("contracts", s.wh.contracts, "vintage_month", "financed_amount"),
        ("installments", s.wh.installments, "due_month", "scheduled_total"),
        ("collections", s.wh.collections, "event_month", "promised_amount"),
        ("recoveries", models.fact_recoveries(s.wh.stg("recovery_events")), "recovery_month",
         "recovery_amount"),
        ("writeoffs", models.fact_write_offs(s.wh.write_off_outcomes), "write_off_month",
         "write_off_amount"),
    ]
    out = None
    for name, df, month, amount in parts:
        one = df.groupBy("run_id", F.lit(name).alias("fact"), F.col(month).alias("month")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(28,2)").alias("amount"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "fact_macro_monthly",
    "P8",
    f"""WITH m AS (SELECT cast(date_trunc('month', o_orderdate) AS date) AS reference_date,
            cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / count(*) AS v
            FROM orders GROUP BY 1)
        SELECT run_id, 'public_bcb_observation' AS source_type, 'series_a' AS source_id,
            {day('reference_date')}, {rnd('v')} AS value, false AS is_synthetic
        FROM m CROSS JOIN runs
        UNION ALL SELECT 'RUN_stress', 'synthetic_shock', 'shock_a',
            strftime(reference_date, '%Y-%m-%d'), {rnd('v')}, true FROM m
        WHERE reference_date >= DATE '1999-01-01'""",
)
def fact_macro(s: Source) -> DataFrame:
    return s.wh.macro.select(
        "run_id", "source_type", "source_id", "reference_date", "value", "is_synthetic"
    )


@query(
    "dim_date",
    "F4 F5 P9 A6",
    f"""SELECT cast(strftime(m, '%Y%m') AS integer) AS date_key, {day('m').replace('AS m',
        'AS month_date')}, strftime(last_day(cast(m AS date)), '%Y-%m-%d') AS month_end,
        cast(year(m) AS integer) AS calendar_year, cast(month(m) AS integer) AS calendar_month
        FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)),
              date_trunc('month', max(o_orderdate)), interval 1 month)) AS m FROM orders)""",
)
def dim_date(s: Source) -> DataFrame:
    return models.dim_date(models.calendar(s.wh.runs))


@query(
    "dim_members",
    "A8 P7 P9 S6",
    f"""SELECT 'channel' AS dimension, o_orderpriority AS member, true AS flag FROM orders
            GROUP BY 2
        UNION ALL SELECT 'region', r_name, true FROM customer
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
            JOIN orders ON o_custkey = c_custkey GROUP BY 2
        UNION ALL SELECT 'scenario', scenario, true FROM runs
        UNION ALL SELECT 'bucket', dpd_bucket, dpd_bucket NOT IN ('current', 'write_off')
            FROM buckets
        UNION ALL SELECT DISTINCT 'policy', policy_version_id, true FROM runs""",
)
def dim_members(s: Source) -> DataFrame:
    yes = F.lit(True).alias("flag")
    parts = [
        models.distinct_dimension(s.wh.applications, "channel").select(
            F.lit("channel").alias("dimension"), F.col("channel").alias("member"), yes),
        models.distinct_dimension(s.wh.stg("fairness_attributes"), "region").select(
            F.lit("region").alias("dimension"), F.col("region").alias("member"), yes),
        models.dim_scenario(s.wh.runs).select(
            F.lit("scenario").alias("dimension"), F.col("scenario").alias("member"),
            F.col("is_comparable_to_baseline").alias("flag")),
        bucket_dimension(s.spark).select(
            F.lit("bucket").alias("dimension"), F.col("dpd_bucket").alias("member"),
            F.col("is_delinquent").alias("flag")),
        models.dim_policy(s.wh.stg("policy_versions")).select(
            F.lit("policy").alias("dimension"), F.col("policy_version_id").alias("member"), yes
        ).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "dim_customer",
    "P9",
    f"""SELECT {key('run_id', 'c_custkey')} AS customer_key, run_id, c_custkey AS customer_id,
        '1995-01-01 00:00:00' AS created_at FROM customer CROSS JOIN runs""",
)
def dim_customer(s: Source) -> DataFrame:
    return models.dim_customer(s.wh.stg("customers"))


@query(
    "dim_run",
    "P9",
    f"""SELECT run_id, 'SUITE_star' AS suite_id, scenario, strftime(lo, '%Y-%m-%d')
        AS period_start, strftime(hi, '%Y-%m-%d') AS period_end, customers AS planned_customers,
        n AS planned_applications,
        CASE WHEN run_id <> 'RUN_baseline' THEN 'RUN_baseline' END AS parent_run_id
        FROM runs CROSS JOIN (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi,
        cast(count(DISTINCT o_custkey) AS integer) AS customers, cast(count(*) AS integer) AS n
        FROM orders)""",
)
def dim_run(s: Source) -> DataFrame:
    return s.wh.runs.select(
        "run_id", "suite_id", "scenario", "period_start", "period_end", "planned_customers",
        "planned_applications", "parent_run_id",
    )


FUNNEL = f"""SELECT {TAG_COLUMNS}, {day('submitted_month')}, channel, applications_submitted,
    decisioned_applications, approved_count, rejected_count, booked_count,
    {money('total_booked_amount')},
    {ratio('approved_count', 'decisioned_applications')} AS approval_rate,
    {ratio('rejected_count', 'decisioned_applications')} AS rejection_rate,
    {ratio('booked_count', 'approved_count')} AS booking_rate_of_approved,
    {ratio('booked_count', 'applications_submitted')} AS booking_rate_of_submitted,
    {ratio('total_booked_amount', 'booked_count')} AS avg_booked_amount FROM funnel"""


@query("mart_credit_funnel_monthly", "M1 A1 A2 A4", FUNNEL)
def credit_funnel(s: Source) -> DataFrame:
    return s.wh.funnel


@query(
    "mart_portfolio_monthly",
    "M2 J4 J5",
    f"""WITH stock AS (SELECT {TAG_COLUMNS}, snapshot_date, count(*) AS total_contracts,
            count(*) FILTER (WHERE contract_status IN ('active', 'delinquent'))
                AS active_contracts, sum(total_balance) AS outstanding_balance,
            sum(cumulative_paid) AS cumulative_paid_total,
            sum(past_due_amount) AS overdue_scheduled_amount,
            cast(sum(financed_amount) AS double) / count(*) AS avg_ticket
            FROM acct GROUP BY 1, 2, 3, 4, 5, 6),
        flow AS (SELECT run_id, date_trunc('month', paid_on) AS m,
            count(*) FILTER (WHERE payment_type = 'partial' AND NOT is_reversal) AS partials,
            count(*) FILTER (WHERE payment_type = 'prepayment' AND NOT is_reversal) AS prepaid,
            sum(CASE WHEN is_reversal THEN -amount ELSE amount END) AS net
            FROM pay GROUP BY 1, 2),
        plan AS (SELECT run_id, date_trunc('month', due_date) AS m, sum(scheduled_total) AS t,
            sum(scheduled_principal) AS p, sum(scheduled_interest) AS i, sum(scheduled_fees) AS f
            FROM inst GROUP BY 1, 2)
        SELECT {', '.join('s.' + c for c in TAG_COLUMNS.split(', '))},
            strftime(s.snapshot_date, '%Y-%m-%d') AS snapshot_date, total_contracts,
            active_contracts, {money('outstanding_balance', 'cumulative_paid_total',
            'overdue_scheduled_amount')}, {rnd('avg_ticket')} AS avg_ticket,
            coalesce(partials, 0) AS partial_payment_count,
            coalesce(prepaid, 0) AS prepayment_count,
            cast(coalesce(net, 0) AS double) AS paid_amount_this_month,
            cast(coalesce(t, 0) AS double) AS scheduled_amount_due_this_month,
            cast(coalesce(p, 0) AS double) AS scheduled_principal_due_this_month,
            cast(coalesce(i, 0) AS double) AS scheduled_interest_due_this_month,
            cast(coalesce(f, 0) AS double) AS scheduled_fees_due_this_month,
            {ratio('coalesce(net, 0)', 't')} AS paid_to_scheduled_ratio
        FROM stock s
        LEFT JOIN flow USING (run_id) """.replace("USING (run_id)", """ON s.run_id = flow.run_id
            AND date_trunc('month', s.snapshot_date) = flow.m""")
    + """LEFT JOIN plan ON s.run_id = plan.run_id
            AND date_trunc('month', s.snapshot_date) = plan.m""",
)
def portfolio_monthly(s: Source) -> DataFrame:
    return s.wh.portfolio


DELINQUENCY = f"""SELECT {TAG_COLUMNS}, {day('snapshot_date')}, total_contracts,
    {money('total_balance', 'balance_30plus', 'balance_60plus', 'balance_90plus')},
    contracts_30plus, contracts_60plus, contracts_90plus, new_delinquencies, cures, relapses,
    prior_month_delinquent_count,
    {ratio('balance_30plus', 'total_balance')} AS par30,
    {ratio('balance_60plus', 'total_balance')} AS par60,
    {ratio('balance_90plus', 'total_balance')} AS par90,
    {ratio('contracts_30plus', 'total_contracts')} AS rate_30plus,
    {ratio('contracts_60plus', 'total_contracts')} AS rate_60plus,
    {ratio('contracts_90plus', 'total_contracts')} AS rate_90plus,
    {ratio('cures', 'prior_month_delinquent_count')} AS cure_rate FROM delinq"""


@query("mart_delinquency_monthly", "M3 A1 A2 A4", DELINQUENCY)
def delinquency_monthly(s: Source) -> DataFrame:
    return s.wh.delinquency


@query(
    "mart_vintage_cohorts",
    "M4 A3 A6",
    f"""SELECT {TAG_COLUMNS}, {day('vintage_month')}, months_on_book,
        max_mob_observed_for_cohort, contracts_observed, {money('total_balance',
        'total_financed_amount', 'cumulative_write_off')}, contracts_30plus, contracts_60plus,
        contracts_90plus FROM vintages""",
)
def vintage_cohorts(s: Source) -> DataFrame:
    return s.wh.vintages


@query(
    "mart_roll_rates",
    "M5",
    f"""SELECT {TAG_COLUMNS}, {day('snapshot_date')}, from_bucket, to_bucket, contract_count,
        {money('balance')} FROM rolls""",
)
def roll_rates(s: Source) -> DataFrame:
    return s.wh.rolls


@query(
    "roll_direction_summary",
    "M6 J7",
    f"""WITH d AS (SELECT r.*, t.sort_order - f.sort_order AS move FROM rolls r
            JOIN buckets f ON r.from_bucket = f.dpd_bucket
            JOIN buckets t ON r.to_bucket = t.dpd_bucket),
        g AS (SELECT {TAG_COLUMNS}, snapshot_date,
            cast(coalesce(sum(contract_count) FILTER (WHERE move > 0), 0) AS bigint)
                AS roll_forward_count,
            cast(coalesce(sum(contract_count) FILTER (WHERE move < 0), 0) AS bigint)
                AS roll_back_count,
            cast(coalesce(sum(contract_count) FILTER (WHERE move = 0), 0) AS bigint)
                AS stable_count,
            cast(sum(contract_count) AS bigint) AS total_transitions
            FROM d GROUP BY 1, 2, 3, 4, 5, 6)
        SELECT * REPLACE (strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date),
            {ratio('stable_count', 'total_transitions')} AS bucket_stability_rate FROM g""",
)
def roll_direction(s: Source) -> DataFrame:
    return marts.roll_direction(s.wh.rolls)


_MATRIX = ", ".join(
    f"cast(coalesce(sum(contract_count) FILTER (WHERE to_bucket = '{b}'), 0) AS bigint) AS {n}"
    for b, n in (("current", "to_current"), ("1-29", "to_1_29"), ("30-59", "to_30_59"),
                 ("60-89", "to_60_89"), ("90+", "to_90plus"))
)


@query(
    "roll_matrix",
    "M7",
    f"SELECT run_id, from_bucket, {_MATRIX} FROM rolls GROUP BY 1, 2",
)
def roll_matrix(s: Source) -> DataFrame:
    return marts.roll_matrix(s.wh.rolls)


@query(
    "roll_forward_from_current",
    "M8",
    f"""WITH g AS (SELECT run_id, scenario, cast(sum(contract_count) AS bigint) AS transitions,
            cast(coalesce(sum(contract_count) FILTER (WHERE to_bucket = 'current'), 0) AS bigint)
                AS stayed_current
            FROM rolls WHERE from_bucket = 'current' GROUP BY 1, 2)
        SELECT *, {ratio('(transitions - stayed_current)', 'transitions')} AS roll_forward_rate
        FROM g""",
)
def roll_forward_from_current(s: Source) -> DataFrame:
    return marts.roll_forward_from_current(s.wh.rolls)


@query(
    "mart_cure_and_redefault",
    "M9 A5",
    f"""SELECT {TAG_COLUMNS}, {key('run_id', 'contract_id')} AS contract_key, contract_id,
        cure_count > 0 AS was_ever_cured, cure_count, relapse_count > 0 AS ever_relapsed,
        relapse_count, cure_count > 0 AND relapse_count > 0 AS redefaulted FROM cured""",
)
def cure_and_redefault(s: Source) -> DataFrame:
    return s.wh.cures


@query(
    "redefault_rate",
    "M10",
    f"""WITH g AS (SELECT {TAG_COLUMNS}, count(*) AS contracts_ever_cured,
            count(*) FILTER (WHERE relapse_count > 0) AS contracts_redefaulted
            FROM cured WHERE cure_count > 0 GROUP BY 1, 2, 3, 4, 5)
        SELECT *, {ratio('contracts_redefaulted', 'contracts_ever_cured')} AS redefault_rate
        FROM g""",
)
def redefault_rate(s: Source) -> DataFrame:
    return marts.redefault_rate(s.wh.cures)


@query(
    "mart_collections_performance",
    "M12 J6 A3",
    f"""WITH c AS (SELECT {TAG_COLUMNS}, date_trunc('month', event_date) AS m,
            count(*) AS contact_events, count(DISTINCT contract_id) AS contracts_contacted,
            count(*) FILTER (WHERE promise_to_pay) AS promises_to_pay
            FROM coll GROUP BY 1, 2, 3, 4, 5, 6),
        e AS (SELECT run_id AS r, date_trunc('month', snapshot_date) AS m2,
            count(DISTINCT contract_id) AS n
            FROM acct WHERE contract_status = 'delinquent' GROUP BY 1, 2)
        SELECT {TAG_COLUMNS}, strftime(m, '%Y-%m-%d') AS event_month, contact_events,
            contracts_contacted, promises_to_pay, coalesce(n, 0) AS contracts_eligible,
            {ratio('contracts_contacted', 'n')} AS contact_rate,
            {ratio('promises_to_pay', 'contracts_contacted')} AS promise_rate,
            {ratio('contact_events', 'contracts_contacted')} AS events_per_contract
        FROM c LEFT JOIN e ON c.run_id = e.r AND c.m = e.m2""",
)
def collections_performance(s: Source) -> DataFrame:
    return s.wh.collections_performance


@query(
    "mart_writeoff_recovery",
    "M13",
    f"""SELECT {TAG_COLUMNS}, {day('write_off_month')}, write_off_count,
        {money('total_write_off_amount', 'total_recovery_amount')}, recovery_count,
        {rnd('avg_days_to_recovery')} AS avg_days_to_recovery,
        {ratio('total_recovery_amount', 'total_write_off_amount')} AS recovery_rate
        FROM womonth""",
)
def writeoff_recovery(s: Source) -> DataFrame:
    return s.wh.writeoffs


@query(
    "mart_scenario_comparison",
    "M15 J10 J14",
    f"""WITH ap AS (SELECT run_id, cast(count(*) FILTER (WHERE outcome = 'approved') AS double)
            / count(*) AS a FROM app WHERE outcome IS NOT NULL GROUP BY 1),
        dl AS (SELECT run_id, cast(count(*) FILTER (WHERE dpd >= 90) AS double) / count(*) AS d
            FROM finalrow GROUP BY 1),
        w AS (SELECT run_id, count(*) AS n FROM wo GROUP BY 1),
        lv AS (SELECT runs.run_id, scenario, coalesce(a, 0) AS a, coalesce(d, 0) AS d,
            coalesce(n, 0) AS n FROM runs LEFT JOIN ap USING (run_id)
            LEFT JOIN dl USING (run_id) LEFT JOIN w USING (run_id)),
        b AS (SELECT a AS ba, d AS bd, n AS bn FROM lv WHERE scenario = 'baseline')
        SELECT 'SUITE_star' AS suite_id, scenario, run_id, {rnd('a')} AS approval_rate,
            {rnd('ba')} AS baseline_approval_rate, {rnd('a - ba')} + 0.0
                AS approval_rate_delta_abs,
            {ratio('(a - ba)', 'ba')} AS approval_rate_delta_rel,
            {rnd('d')} AS dpd90_rate_final_month, {rnd('bd')} AS baseline_dpd90_rate,
            {rnd('d - bd')} AS dpd90_rate_delta_abs, n AS write_off_count,
            bn AS baseline_write_off_count, n - bn AS write_off_count_delta_abs
        FROM lv CROSS JOIN b WHERE scenario <> 'baseline'""",
)
def scenario_comparison(s: Source) -> DataFrame:
    return s.wh.scenarios


STRESS = f"""WITH k AS (SELECT scenario, CASE WHEN snapshot_date < DATE '1999-01-01'
            THEN 'pre_shock' ELSE 'post_shock' END AS period,
        count(DISTINCT snapshot_date) AS n,
        avg(CASE WHEN total_balance > 0 THEN cast(balance_90plus AS double)
            / cast(total_balance AS double) END) AS p,
        avg(cast(contracts_90plus AS double) / total_contracts) AS r,
        cast(sum(total_balance) AS double) / count(*) AS b
        FROM delinq WHERE scenario IN ('baseline', 'macroeconomic_stress') GROUP BY 1, 2),
    w AS (SELECT scenario, CASE WHEN write_off_month < DATE '1999-01-01' THEN 'pre_shock'
            ELSE 'post_shock' END AS period, cast(sum(write_off_count) AS bigint) AS c,
        sum(total_write_off_amount) AS a FROM womonth GROUP BY 1, 2),
    j AS (SELECT k.*, coalesce(c, 0) AS c, cast(coalesce(a, 0) AS double) AS a
        FROM k LEFT JOIN w ON k.scenario = w.scenario AND k.period = w.period),
    x AS (SELECT 'SUITE_star' AS suite_id, b.period, '1999-01-01' AS shock_date,
        b.n AS baseline_n_months, s.n AS stress_n_months, b.p AS baseline_par90,
        s.p AS stress_par90, b.r AS baseline_dpd90_rate, s.r AS stress_dpd90_rate,
        b.b AS baseline_outstanding_balance, s.b AS stress_outstanding_balance,
        b.c AS baseline_write_off_count, s.c AS stress_write_off_count,
        b.a AS baseline_write_off_amount, s.a AS stress_write_off_amount
        FROM j b JOIN j s ON b.period = s.period
        WHERE b.scenario = 'baseline' AND s.scenario = 'macroeconomic_stress')
    SELECT suite_id, period, shock_date, baseline_n_months, stress_n_months,
        {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('baseline_par90', 'stress_par90',
        'baseline_dpd90_rate', 'stress_dpd90_rate', 'baseline_outstanding_balance',
        'stress_outstanding_balance'))},
        baseline_write_off_count, stress_write_off_count, baseline_write_off_amount,
        stress_write_off_amount, round(stress_par90 - baseline_par90, 6) + 0.0 AS par90_delta_abs,
        round(stress_dpd90_rate - baseline_dpd90_rate, 6) + 0.0 AS dpd90_rate_delta_abs,
        stress_write_off_count - baseline_write_off_count AS write_off_count_delta_abs FROM x"""


@query("mart_macro_stress_pre_post", "M16 A7 J14", STRESS)
def stress_pre_post(s: Source) -> DataFrame:
    return s.wh.stress


@query(
    "totals_by_scenario",
    "M27 O1 P14",
    f"""SELECT run_id, scenario, {day('snapshot_date')},
        cast(sum(total_balance) AS double) AS outstanding_balance, count(*) AS contracts
        FROM finalrow WHERE suite_id = 'SUITE_star' GROUP BY 1, 2, 3 ORDER BY ALL""",
)
def totals_by_scenario(s: Source) -> DataFrame:
    chosen = s.wh.account_monthly.filter(F.col("suite_id") == "SUITE_star")
    out = marts.totals_by_scenario(chosen)
    return out.orderBy(*out.columns)


@query(
    "rates_by_scenario",
    "M27 A4",
    f"""WITH g AS (SELECT run_id, scenario,
            cast(sum(applications_submitted) AS bigint) AS applications_submitted,
            cast(sum(decisioned_applications) AS bigint) AS decisioned_applications,
            cast(sum(approved_count) AS bigint) AS approved_count,
            cast(sum(booked_count) AS bigint) AS booked_count FROM funnel GROUP BY 1, 2)
        SELECT *, {ratio('approved_count', 'decisioned_applications')} AS approval_rate,
            {ratio('booked_count', 'approved_count')} AS booking_rate_of_approved,
            coalesce({ratio('booked_count', 'applications_submitted')}, 0.0) AS booking_rate
        FROM g""",
)
def rates_by_scenario(s: Source) -> DataFrame:
    return marts.rates_by_scenario(s.wh.funnel)


@query(
    "comparable_cohorts",
    "M28",
    f"""WITH m AS (SELECT run_id AS r, min(max_mob_observed_for_cohort) AS mob FROM vintages
            GROUP BY 1)
        SELECT run_id, scenario, {day('vintage_month')}, months_on_book, contracts_observed,
            {ratio('contracts_30plus', 'contracts_observed')} AS incidence_30plus,
            {ratio('contracts_60plus', 'contracts_observed')} AS incidence_60plus,
            {ratio('contracts_90plus', 'contracts_observed')} AS incidence_90plus
        FROM vintages JOIN m ON run_id = r AND months_on_book = mob""",
)
def comparable_cohorts(s: Source) -> DataFrame:
    return marts.comparable_cohorts(s.wh.vintages)


@query(
    "latest_per_scenario",
    "W12",
    DELINQUENCY + " QUALIFY row_number() OVER (PARTITION BY suite_id, scenario "
    "ORDER BY delinq.snapshot_date DESC) = 1",
)
def latest_per_scenario(s: Source) -> DataFrame:
    return marts.latest_per_scenario(s.wh.delinquency)
