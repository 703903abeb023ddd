"""SQL definitions of the star-schema portfolio, written for a plain SQL engine.

They follow the same rules as `star`, but the ledger is computed the long way: every
installment of a contract is looked at on every month end.
"""

from __future__ import annotations

from loanweave.plans.catalog import cte
from loanweave.plans.star import (
    BASELINE,
    CHARGE_OFF_DPD,
    EXPANSION,
    RUNS,
    SHOCK,
    SHOCK_DELAY_DAYS,
    STRESS,
    SUITE,
    TAIL_DAYS,
)


def key(*columns: str) -> str:
    parts = ", ".join(rf"coalesce(cast({c} as varchar), '\x00NULL\x00')" for c in columns)
    return f"md5(concat_ws('||', {parts}))"


def rnd(expr: str) -> str:
    return f"round({expr}, 6)"


def ratio(num: str, den: str) -> str:
    return f"round(CASE WHEN {den} > 0 THEN cast({num} as double) / cast({den} as double) END, 6)"


TAGS = (
    f"'{SUITE}' AS suite_id, scenario, cast(42 as bigint) AS seed, 'sample' AS scale"
)
TAG_COLUMNS = "run_id, suite_id, scenario, seed, scale"

cte(
    "runs",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{r}', '{s}', '{p}')" for r, s, p in RUNS)
    + ") AS v(run_id, scenario, policy_version_id)",
)
cte(
    "app",
    f"""
SELECT r.run_id, {TAGS}, r.policy_version_id,
       o.o_orderkey AS application_id, o.o_custkey AS customer_id,
       o.o_orderdate AS submitted_at, o.o_orderpriority AS channel,
       cast(o.o_totalprice AS decimal(18,2)) AS requested_amount,
       CASE WHEN o.o_orderkey % 10 = 0 THEN NULL
            WHEN o.o_orderstatus IN ('F', 'O') THEN 'approved'
            WHEN r.run_id = '{EXPANSION}' AND o.o_orderkey % 3 = 0 THEN 'approved'
            ELSE 'rejected' END AS outcome
FROM orders o CROSS JOIN runs r""",
)
cte(
    "line",
    """
SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey,
           l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) AS k,
       cast(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(12,2)))
            AS decimal(18,2)) AS principal,
       cast(cast(l_extendedprice AS decimal(12,2)) * cast(l_tax AS decimal(12,2))
            AS decimal(18,2)) AS interest
FROM lineitem""",
)
cte(
    "inst",
    """
SELECT a.run_id, a.suite_id, a.scenario, a.seed, a.scale, a.application_id AS contract_id,
       a.customer_id, a.submitted_at, l.l_partkey, l.l_suppkey, l.l_returnflag,
       a.application_id || '-' || l.k AS installment_id, l.k AS installment_number,
       cast(cast(a.submitted_at AS date) + to_months(cast(l.k AS integer)) AS date) AS due_date,
       l.principal AS scheduled_principal, l.interest AS scheduled_interest,
       cast(0 AS decimal(18,2)) AS scheduled_fees,
       cast(l.principal + l.interest AS decimal(18,2)) AS scheduled_total
FROM app a JOIN line l ON a.application_id = l.l_orderkey
WHERE a.outcome = 'approved'""",
)
cte(
    "con",
    f"""
SELECT run_id, suite_id, scenario, seed, scale, contract_id, customer_id, submitted_at,
       cast(sum(scheduled_principal) AS decimal(18,2)) AS financed_amount,
       sum(scheduled_interest) AS interest_total,
       cast(count(*) AS integer) AS term_months, min(due_date) AS first_due_date,
       max(due_date) AS last_due
FROM inst GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"),
)
cte(
    "pay",
    f"""
SELECT run_id, suite_id, scenario, contract_id, customer_id, installment_id,
       installment_id || '-' || tag AS payment_id, tag,
       cast(first_day + shift AS date) AS paid_on, scheduled_total AS amount,
       CASE l_returnflag WHEN 'R' THEN 'app' WHEN 'A' THEN 'web' ELSE 'bank_slip' END AS channel,
       CASE WHEN late >= 30 THEN 'cure' WHEN late > 0 THEN 'partial'
            WHEN l_partkey % 5 = 0 THEN 'prepayment' ELSE 'scheduled' END AS payment_type,
       tag = 'R1' AS is_reversal, scheduled_principal, scheduled_interest, scheduled_fees
FROM (
  SELECT *, cast(CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 75 ELSE 0 END AS integer) AS late,
         due_date + cast(CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 75 ELSE 0 END AS integer)
         + CASE WHEN run_id = '{STRESS}' AND due_date >= DATE '{SHOCK}'
                THEN {SHOCK_DELAY_DAYS} ELSE 0 END AS first_day
  FROM inst WHERE l_partkey % 17 <> 0) i
JOIN (VALUES ('P1', 0), ('R1', 5), ('P2', 40)) AS t(tag, shift)
  ON t.tag = 'P1' OR i.l_partkey % 13 = 0""",
)
cte(
    "probe",
    f"""
SELECT c.run_id, c.contract_id, last_day(cast(m AS date)) AS snapshot_date
FROM con c, unnest(generate_series(date_trunc('month', c.submitted_at),
     date_trunc('month', c.last_due + {TAIL_DAYS}), interval 1 month)) AS g(m)
WHERE last_day(cast(m AS date)) <= c.last_due + {TAIL_DAYS}""",
)
cte(
    "position",
    """
SELECT p.run_id, p.contract_id, p.snapshot_date, i.installment_id, i.due_date,
       i.scheduled_total, i.scheduled_principal, i.scheduled_interest,
       least(greatest(coalesce(sum(CASE WHEN y.is_reversal THEN -y.amount ELSE y.amount END), 0),
             0), i.scheduled_total) AS paid
FROM probe p
JOIN inst i ON p.run_id = i.run_id AND p.contract_id = i.contract_id
LEFT JOIN pay y ON i.run_id = y.run_id AND i.installment_id = y.installment_id
               AND y.paid_on <= p.snapshot_date
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
)
cte(
    "state",
    """
SELECT run_id, contract_id, snapshot_date,
       sum(paid) AS cumulative_paid, sum(scheduled_total - paid) AS open_total,
       sum(CASE WHEN paid = 0 THEN scheduled_principal ELSE 0 END) AS open_principal,
       sum(CASE WHEN paid = 0 THEN scheduled_interest ELSE 0 END) AS open_interest,
       sum(CASE WHEN due_date < snapshot_date THEN scheduled_total - paid ELSE 0 END) AS past_due,
       coalesce(max(CASE WHEN due_date < snapshot_date AND scheduled_total - paid > 0.01
                         THEN snapshot_date - due_date END), 0) AS dpd,
       min(CASE WHEN due_date >= snapshot_date THEN due_date END) AS next_due_date
FROM position GROUP BY 1, 2, 3""",
)
cte(
    "labelled",
    f"""
SELECT *, CASE WHEN dpd >= {CHARGE_OFF_DPD} THEN 'charged_off' WHEN open_total <= 0.01 THEN 'settled'
               WHEN dpd > 0 THEN 'delinquent' ELSE 'active' END AS contract_status,
       CASE WHEN dpd <= 0 THEN 'current' WHEN dpd <= 29 THEN '1-29' WHEN dpd <= 59 THEN '30-59'
            WHEN dpd <= 89 THEN '60-89' ELSE '90+' END AS dpd_bucket
FROM state""",
)
cte(
    "snap",
    f"""
SELECT l.run_id, {TAGS}, l.contract_id, l.snapshot_date, cast(l.dpd AS integer) AS dpd,
       l.dpd_bucket, l.contract_status, l.cumulative_paid,
       CASE WHEN contract_status = 'charged_off' THEN 0 ELSE open_principal END
           AS outstanding_principal,
       CASE WHEN contract_status = 'charged_off' THEN 0 ELSE open_interest END
           AS outstanding_interest,
       cast(0 AS decimal(18,2)) AS outstanding_fees,
       CASE WHEN contract_status = 'charged_off' THEN 0 ELSE open_total END AS total_balance,
       CASE WHEN contract_status = 'charged_off' THEN 0 ELSE past_due END AS past_due_amount,
       CASE WHEN contract_status IN ('active', 'delinquent') THEN open_total ELSE 0 END AS exposure,
       CASE WHEN contract_status IN ('active', 'delinquent') THEN next_due_date END
           AS next_due_date,
       CASE WHEN contract_status = 'charged_off' THEN open_total ELSE 0 END
           AS cumulative_write_off,
       CASE WHEN contract_status = 'charged_off' THEN open_principal ELSE 0 END AS lost_principal,
       CASE WHEN contract_status = 'charged_off' THEN open_interest ELSE 0 END AS lost_interest
FROM labelled l
JOIN runs r ON l.run_id = r.run_id
LEFT JOIN (SELECT run_id, contract_id, min(snapshot_date) AS ended FROM labelled
           WHERE contract_status IN ('settled', 'charged_off') GROUP BY 1, 2) e
  ON l.run_id = e.run_id AND l.contract_id = e.contract_id
WHERE e.ended IS NULL OR l.snapshot_date <= e.ended""",
)
cte(
    "wo",
    """
SELECT run_id, suite_id, scenario, seed, scale, contract_id, 'WO-' || contract_id AS write_off_id,
       snapshot_date AS write_off_date, cumulative_write_off AS amount,
       lost_principal AS principal, lost_interest AS interest
FROM snap WHERE contract_status = 'charged_off'""",
)
cte(
    "rec",
    """
SELECT run_id, contract_id, write_off_id, 'RC-' || contract_id AS recovery_id,
       write_off_date + 60 AS recovery_date,
       cast(amount * cast(0.40 AS decimal(3,2)) AS decimal(18,2)) AS amount
FROM wo WHERE contract_id % 2 = 0""",
)
cte(
    "woo",
    """
SELECT w.*, r.recovery_id, r.recovery_date, r.amount AS recovery_amount,
       r.recovery_date - w.write_off_date AS days_to_recovery
FROM wo w LEFT JOIN rec r ON w.run_id = r.run_id AND w.write_off_id = r.write_off_id""",
)
cte(
    "coll",
    """
SELECT run_id, suite_id, scenario, seed, scale, contract_id, snapshot_date AS event_date,
       contract_id % 2 = 0 AS promise_to_pay, past_due_amount
FROM snap WHERE contract_status = 'delinquent' AND contract_id % 3 <> 0""",
)
cte(
    "hist",
    """
SELECT s.*, c.financed_amount, c.customer_id,
       cast(date_trunc('month', c.submitted_at) AS date) AS vintage_month,
       cast(datediff('month', cast(c.submitted_at AS date), s.snapshot_date) AS integer)
           AS months_on_book,
       lag(s.contract_status) OVER w AS prior_status, lag(s.dpd_bucket) OVER w AS prior_bucket,
       s.contract_status = 'active' AND lag(s.contract_status) OVER w = 'delinquent' AS is_cure
FROM snap s JOIN con c ON s.run_id = c.run_id AND s.contract_id = c.contract_id
WINDOW w AS (PARTITION BY s.run_id, s.contract_id ORDER BY s.snapshot_date)""",
)
cte(
    "acct",
    """
SELECT *, contract_status = 'delinquent' AND coalesce(prior_status, '') <> 'delinquent'
          AND count(*) FILTER (WHERE is_cure) OVER (PARTITION BY run_id, contract_id
              ORDER BY snapshot_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0
          AS is_relapse
FROM hist""",
)
cte(
    "finalrow",
    """
SELECT a.* FROM acct a
JOIN (SELECT run_id, max(snapshot_date) AS d FROM acct GROUP BY 1) f
  ON a.run_id = f.run_id AND a.snapshot_date = f.d""",
)
cte(
    "funnel",
    """
SELECT a.run_id, a.suite_id, a.scenario, a.seed, a.scale,
       cast(date_trunc('month', a.submitted_at) AS date) AS submitted_month, a.channel,
       count(*) AS applications_submitted,
       count(*) FILTER (WHERE a.outcome IS NOT NULL) AS decisioned_applications,
       count(*) FILTER (WHERE a.outcome = 'approved') AS approved_count,
       count(*) FILTER (WHERE a.outcome = 'rejected') AS rejected_count,
       count(c.contract_id) AS booked_count,
       coalesce(sum(c.financed_amount), 0) AS total_booked_amount
FROM app a LEFT JOIN con c ON a.run_id = c.run_id AND a.application_id = c.contract_id
GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
cte(
    "delinq",
    """
SELECT run_id, suite_id, scenario, seed, scale, snapshot_date,
       count(*) AS total_contracts, sum(total_balance) AS total_balance,
       count(*) FILTER (WHERE dpd >= 30) AS contracts_30plus,
       count(*) FILTER (WHERE dpd >= 60) AS contracts_60plus,
       count(*) FILTER (WHERE dpd >= 90) AS contracts_90plus,
       coalesce(sum(total_balance) FILTER (WHERE dpd >= 30), 0) AS balance_30plus,
       coalesce(sum(total_balance) FILTER (WHERE dpd >= 60), 0) AS balance_60plus,
       coalesce(sum(total_balance) FILTER (WHERE dpd >= 90), 0) AS balance_90plus,
       count(*) FILTER (WHERE contract_status = 'delinquent'
                        AND prior_status IS DISTINCT FROM 'delinquent') AS new_delinquencies,
       count(*) FILTER (WHERE is_cure) AS cures,
       count(*) FILTER (WHERE is_relapse) AS relapses,
       count(*) FILTER (WHERE prior_status = 'delinquent') AS prior_month_delinquent_count
FROM acct GROUP BY 1, 2, 3, 4, 5, 6""",
)
cte(
    "rolls",
    """
SELECT run_id, suite_id, scenario, seed, scale, snapshot_date, prior_bucket AS from_bucket,
       dpd_bucket AS to_bucket, count(*) AS contract_count, sum(total_balance) AS balance
FROM acct WHERE prior_bucket IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
)
cte(
    "buckets",
    """
SELECT * FROM (VALUES ('current', 1), ('1-29', 2), ('30-59', 3), ('60-89', 4), ('90+', 5),
  ('write_off', 6)) AS b(dpd_bucket, sort_order)""",
)
cte(
    "cured",
    """
SELECT run_id, suite_id, scenario, seed, scale, contract_id,
       count(*) FILTER (WHERE is_cure) AS cure_count,
       count(*) FILTER (WHERE is_relapse) AS relapse_count
FROM acct GROUP BY 1, 2, 3, 4, 5, 6""",
)
cte(
    "vintages",
    """
SELECT run_id, suite_id, scenario, seed, scale, vintage_month, months_on_book,
       max(max(months_on_book)) OVER (PARTITION BY run_id, vintage_month)
           AS max_mob_observed_for_cohort,
       count(DISTINCT contract_id) AS contracts_observed, sum(total_balance) AS total_balance,
       sum(financed_amount) AS total_financed_amount,
       count(*) FILTER (WHERE dpd >= 30) AS contracts_30plus,
       count(*) FILTER (WHERE dpd >= 60) AS contracts_60plus,
       count(*) FILTER (WHERE dpd >= 90) AS contracts_90plus,
       sum(cumulative_write_off) AS cumulative_write_off
FROM acct GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
cte(
    "womonth",
    """
SELECT run_id, suite_id, scenario, seed, scale,
       cast(date_trunc('month', write_off_date) AS date) AS write_off_month,
       count(*) AS write_off_count, sum(amount) AS total_write_off_amount,
       count(recovery_id) AS recovery_count,
       coalesce(sum(recovery_amount), 0) AS total_recovery_amount,
       cast(sum(days_to_recovery) AS double) / count(days_to_recovery) AS avg_days_to_recovery
FROM woo GROUP BY 1, 2, 3, 4, 5, 6""",
)
BASE, EXP = BASELINE, EXPANSION
