"""Segments, scenario comparisons and insights as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.functions.buckets import code_label, range_label
from loanweave.operators import ledger, scenarios, segments
from loanweave.operators.insights import insight_table
from loanweave.operators.fingerprint import population_fingerprint, same_content
from loanweave.plans.catalog import Source, cte, query
from loanweave.plans.oracle_tables import ratio, rnd
from loanweave.plans.queries_marts import DELINQUENCY

TIER = ("CASE WHEN {n} < 30 THEN 'insufficient' WHEN {n} < 100 THEN 'limited' "
        "ELSE 'adequate' END")


def flags(n: str) -> str:
    return f"{n} < 30 AS low_sample, {TIER.format(n=n)} AS sample_classification"


@query(
    "funnel_by_channel_and_scenario",
    "M17 M30",
    f"""WITH g AS (SELECT run_id, scenario, channel,
            cast(sum(applications_submitted) AS bigint) AS applications_submitted,
            cast(sum(decisioned_applications) AS bigint) AS decisioned_applications,
            cast(sum(approved_count) AS bigint) AS approved_count,
            cast(sum(booked_count) AS bigint) AS booked_count FROM funnel GROUP BY 1, 2, 3)
        SELECT *, {ratio('approved_count', 'decisioned_applications')} AS approval_rate,
            {ratio('booked_count', 'approved_count')} AS booking_rate_of_approved,
            {flags('decisioned_applications')} FROM g""",
)
def funnel_by_channel(s: Source) -> DataFrame:
    return segments.funnel_by_channel(s.wh.funnel)


cte(
    "place",
    """SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment, c.c_nationkey, r.r_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""",
)


@query(
    "portfolio_by_region_and_channel",
    "M18 J10 J12",
    f"""WITH g AS (SELECT f.run_id, p.r_name AS region, a.channel, count(*) AS contracts,
            cast(sum(f.total_balance) AS double) AS outstanding_balance
            FROM finalrow f JOIN app a ON f.run_id = a.run_id AND f.contract_id = a.application_id
            JOIN place p ON a.customer_id = p.c_custkey GROUP BY 1, 2, 3)
        SELECT *, {flags('contracts')} FROM g""",
)
def concentration(s: Source) -> DataFrame:
    return segments.concentration(
        s.wh.account_monthly, s.wh.contracts, s.wh.applications, s.wh.stg("fairness_attributes")
    )


@query(
    "policy_version_comparison",
    "M19",
    f"""WITH g AS (SELECT run_id, scenario, policy_version_id, count(*) AS decisions,
            count(*) FILTER (WHERE outcome = 'approved') AS approved
            FROM app WHERE outcome IS NOT NULL GROUP BY 1, 2, 3)
        SELECT *, {ratio('approved', 'decisions')} AS approval_rate, {flags('decisions')}
        FROM g""",
)
def policy_versions(s: Source) -> DataFrame:
    return segments.policy_versions(s.wh.decisions, s.wh.stg("policy_versions"), s.wh.runs)


cte(
    "feat",
    """SELECT a.run_id, a.application_id, a.outcome, a.requested_amount,
    cast(greatest(p.c_acctbal, 0.0) AS decimal(18,2)) AS declared_income,
    CASE WHEN p.c_nationkey % 7 <> 0 THEN cast(a.requested_amount AS double) / 200000 END
        AS debt_to_income,
    CASE p.c_mktsegment WHEN 'AUTOMOBILE' THEN 'thin_file' WHEN 'BUILDING' THEN 'low'
        WHEN 'FURNITURE' THEN 'medium' WHEN 'HOUSEHOLD' THEN 'high'
        WHEN 'MACHINERY' THEN 'medium' END AS bureau_score_bucket
FROM app a JOIN place p ON a.customer_id = p.c_custkey""",
)


@query(
    "credit_risk_segment_summary",
    "M20 W3 J13 F20",
    f"""WITH b AS (SELECT *, 'Q' || ntile(4) OVER (PARTITION BY run_id
                ORDER BY declared_income, application_id) AS income_band,
            'Q' || ntile(4) OVER (PARTITION BY run_id
                ORDER BY requested_amount, application_id) AS contract_value_band
            FROM feat WHERE outcome IS NOT NULL),
        g AS (SELECT run_id, 'personal_loan' AS product, bureau_score_bucket, income_band,
            contract_value_band, count(*) AS decisions,
            count(*) FILTER (WHERE outcome = 'approved') AS approved FROM b
            GROUP BY 1, 2, 3, 4, 5)
        SELECT *, {ratio('approved', 'decisions')} AS approval_rate, {flags('decisions')}
        FROM g""",
)
def risk_segments(s: Source) -> DataFrame:
    return segments.risk_segments(
        s.wh.decisions, s.wh.stg("application_features"), s.wh.applications
    )


@query(
    "filtered_delinquency",
    "P10",
    DELINQUENCY + """ WHERE scenario IN ('baseline', 'policy_expansion')
        AND delinq.snapshot_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
)
def filtered_delinquency(s: Source) -> DataFrame:
    # "channel" is not a column of this mart, so its selection changes nothing.
    return segments.apply_filters(
        s.wh.delinquency,
        {"scenario": ["baseline", "policy_expansion"], "channel": ["app"]},
        ("1996-01-01", "1999-12-31"),
    )


@query(
    "filter_options",
    "P11",
    """SELECT 'scenario' AS dimension, scenario AS option FROM app GROUP BY 2
        UNION ALL SELECT 'channel', channel FROM app GROUP BY 2
        UNION ALL SELECT 'product', 'personal_loan'""",
)
def filter_options(s: Source) -> DataFrame:
    return segments.filter_options(
        s.wh.stg("applications"), ["scenario", "channel", "product", "region"]
    )


@query(
    "scorecard_decisions",
    "L10 L11 P12",
    f"""WITH v AS (SELECT run_id, application_id, 0.45 * CASE bureau_score_bucket
                WHEN 'thin_file' THEN 0.40 WHEN 'low' THEN 0.30 WHEN 'medium' THEN 0.60
                WHEN 'high' THEN 0.85 END::double
            + 0.30::double * least(greatest(cast(declared_income AS double) / 10000, 0.0), 1.0)
            + 0.25::double * (1 - least(greatest(coalesce(debt_to_income, 0.5::double) / 1.5::double,
                0.0), 1.0)) AS score,
            requested_amount FROM feat)
        SELECT run_id, application_id, {rnd('score')} AS score,
            CASE WHEN score >= 0.45 THEN 'approved' ELSE 'rejected' END AS outcome,
            CASE WHEN score >= 0.45 THEN NULL ELSE 'score_below_cutoff' END AS reason_code,
            cast(CASE WHEN score >= 0.45 THEN requested_amount END AS double) AS approved_amount,
            CASE WHEN score >= 0.45 THEN 10 END AS approved_term_months,
            CASE WHEN score >= 0.45 THEN 0.03::double END AS offered_rate FROM v""",
)
def scorecard_decisions(s: Source) -> DataFrame:
    f = s.wh.stg("application_features")
    asked = f.select("run_id", "application_id", "requested_amount", "requested_term_months")
    seen = segments.decision_features(f, keys=("run_id", "application_id"))
    scored = ledger.scorecard(seen, 0.0, 10000.0).join(asked, ["run_id", "application_id"])
    return ledger.decide(scored, 0.45, 10, 0.03).select(
        "run_id", "application_id", "score", "outcome", "reason_code", "approved_amount",
        "approved_term_months", "offered_rate",
    )


cte(
    "runmetric",
    """SELECT r.run_id, r.scenario,
    (SELECT count(*) FROM app a WHERE a.run_id = r.run_id) AS n_applications,
    (SELECT count(*) FROM app a WHERE a.run_id = r.run_id AND outcome IS NOT NULL) AS n_decided,
    (SELECT count(*) FROM app a WHERE a.run_id = r.run_id AND outcome = 'approved') AS n_approved,
    (SELECT count(*) FROM con a WHERE a.run_id = r.run_id) AS n_contracts,
    (SELECT count(*) FROM snap a WHERE a.run_id = r.run_id) AS n_snapshots,
    (SELECT count(*) FROM snap a WHERE a.run_id = r.run_id AND dpd >= 30) AS d30,
    (SELECT count(*) FROM snap a WHERE a.run_id = r.run_id AND dpd >= 60) AS d60,
    (SELECT count(*) FROM snap a WHERE a.run_id = r.run_id AND dpd >= 90) AS d90,
    (SELECT count(DISTINCT contract_id) FROM snap a WHERE a.run_id = r.run_id
        AND contract_status = 'delinquent') AS n_late,
    (SELECT count(DISTINCT contract_id) FROM snap a WHERE a.run_id = r.run_id
        AND contract_status = 'settled' AND contract_id IN (SELECT contract_id FROM snap b
        WHERE b.run_id = a.run_id AND b.contract_status = 'delinquent')) AS n_late_settled,
    (SELECT count(*) FROM wo a WHERE a.run_id = r.run_id) AS n_write_offs,
    (SELECT count(*) FROM rec a WHERE a.run_id = r.run_id) AS n_recoveries,
    (SELECT count(*) FROM coll a WHERE a.run_id = r.run_id) AS n_collection_events,
    (SELECT coalesce(sum(amount), 0) FROM wo a WHERE a.run_id = r.run_id)
        AS total_write_off_amount,
    (SELECT coalesce(sum(amount), 0) FROM rec a WHERE a.run_id = r.run_id)
        AS total_recovery_amount
FROM runs r""",
)
_RATES = {
    "approval_rate": ("n_approved", "n_decided"),
    "booking_rate": ("n_contracts", "n_approved"),
    "dpd30_plus_rate": ("d30", "n_snapshots"),
    "dpd60_plus_rate": ("d60", "n_snapshots"),
    "dpd90_plus_rate": ("d90", "n_snapshots"),
    "settled_after_delinquency_rate": ("n_late_settled", "n_late"),
    "write_off_rate": ("n_write_offs", "n_contracts"),
}


def _raw_rate(name: str) -> str:
    n, d = _RATES[name]
    return f"coalesce(cast({n} AS double) / nullif({d}, 0), 0)"


def _metric(name: str) -> str:
    return _raw_rate(name) if name in _RATES else f"cast({name} AS double)"


@query(
    "run_metrics",
    "M22 U4",
    f"""SELECT run_id, 'SUITE_star' AS suite_id, scenario, cast(42 AS bigint) AS seed,
        n_applications, n_decided, n_approved, n_contracts, n_snapshots, n_write_offs,
        n_recoveries, n_collection_events,
        cast(total_write_off_amount AS double) AS total_write_off_amount,
        cast(total_recovery_amount AS double) AS total_recovery_amount,
        {', '.join(f'{rnd(_raw_rate(r))} AS {r}' for r in _RATES)} FROM runmetric""",
)
def run_metrics(s: Source) -> DataFrame:
    return scenarios.run_metrics(s.tables)


_TIDY = " UNION ALL ".join(
    f"SELECT scenario, '{m}' AS metric, {_metric(m)} AS value FROM runmetric"
    for m in scenarios.COMPARED
)


@query(
    "metric_comparison",
    "M23",
    f"""WITH t AS ({_TIDY})
        SELECT 'SUITE_star' AS suite_id, c.scenario, c.metric, {rnd('b.value')} AS baseline_value,
            {rnd('c.value')} AS candidate_value, {rnd('c.value - b.value')} + 0.0 AS delta
        FROM t c JOIN t b ON c.metric = b.metric
        WHERE b.scenario = 'baseline' AND c.scenario <> 'baseline'""",
)
def metric_comparison(s: Source) -> DataFrame:
    tidy = scenarios.tidy_metrics(
        scenarios.run_metrics(s.tables), ["suite_id", "scenario"], scenarios.COMPARED
    )
    return scenarios.against_baseline(tidy, ["suite_id"])


@query(
    "robustness_over_channels",
    "M24 A13",
    f"""WITH g AS (SELECT scenario, channel, cast(sum(approved_count) AS double) AS n_approved,
            cast(sum(booked_count) AS double) AS n_contracts,
            cast(sum(approved_count) AS double) / sum(decisioned_applications) AS approval_rate
            FROM funnel GROUP BY 1, 2),
        t AS (UNPIVOT g ON n_approved, n_contracts, approval_rate INTO NAME metric VALUE value),
        d AS (SELECT c.scenario, c.metric, c.value - b.value AS delta,
            CASE WHEN c.scenario = 'policy_expansion' THEN 1 END AS expected
            FROM t c JOIN t b ON c.channel = b.channel AND c.metric = b.metric
            WHERE b.scenario = 'baseline' AND c.scenario <> 'baseline'),
        a AS (SELECT scenario, metric, expected, count(*) AS n, avg(delta) AS mean,
            median(delta) AS median, stddev_pop(delta) AS stdev, list_sort(list(delta)) AS l,
            min(delta) AS lo, max(delta) AS hi, avg(CASE WHEN expected IS NOT NULL
            THEN cast(delta * expected > 0 AS integer) END) AS f,
            count(*) FILTER (WHERE delta * expected < -1e-9) AS inv FROM d GROUP BY 1, 2, 3)
        SELECT scenario, metric, CASE WHEN expected > 0 THEN 'increase' END AS expected_direction,
            n AS n_replicates, {rnd('mean')} + 0.0 AS mean, {rnd('median')} + 0.0 AS median,
            {rnd('stdev')} + 0.0 AS stdev,
            round(l[cast(round_even(0.1 * (n - 1), 0) AS integer) + 1], 6) + 0.0 AS p10,
            round(l[cast(round_even(0.5 * (n - 1), 0) AS integer) + 1], 6) + 0.0 AS p50,
            round(l[cast(round_even(0.9 * (n - 1), 0) AS integer) + 1], 6) + 0.0 AS p90,
            {rnd('lo')} + 0.0 AS minimum, {rnd('hi')} + 0.0 AS maximum,
            {rnd('f')} AS fraction_in_expected_direction, inv AS inversions FROM a""",
)
def robustness_over_channels(s: Source) -> DataFrame:
    by_channel = segments.funnel_by_channel(s.wh.funnel).select(
        "scenario", "channel", F.col("approved_count").alias("n_approved"),
        F.col("booked_count").alias("n_contracts"), "approval_rate",
    )
    tidy = scenarios.tidy_metrics(
        by_channel, ["scenario", "channel"], ("n_approved", "n_contracts", "approval_rate")
    )
    return scenarios.robustness(scenarios.against_baseline(tidy, ["channel"]))


@query(
    "composition_vs_performance",
    "M21 J11",
    f"""WITH b AS (SELECT * FROM con WHERE scenario = 'baseline'),
        e AS (SELECT * FROM con WHERE scenario = 'policy_expansion'),
        m AS (SELECT e.contract_id AS sid, CASE WHEN b.contract_id IS NOT NULL
            AND e.contract_id IS NOT NULL THEN 'shared' WHEN b.contract_id IS NOT NULL
            THEN 'baseline_only' ELSE 'scenario_only' END AS k
            FROM b FULL JOIN e ON b.contract_id = e.contract_id),
        l AS (SELECT contract_id, dpd_bucket, total_balance FROM acct
            WHERE run_id = 'RUN_expansion' QUALIFY row_number() OVER (PARTITION BY contract_id
            ORDER BY snapshot_date DESC) = 1),
        g AS (SELECT count(*) FILTER (WHERE k = 'shared') AS shared_count,
            count(*) FILTER (WHERE k = 'baseline_only') AS baseline_only_count,
            count(*) FILTER (WHERE k = 'scenario_only') AS scenario_only_count,
            coalesce(sum(total_balance) FILTER (WHERE k = 'shared'), 0) AS sb,
            coalesce(sum(total_balance) FILTER (WHERE k = 'scenario_only'), 0) AS mb,
            coalesce(sum(total_balance) FILTER (WHERE k = 'shared' AND dpd_bucket = '90+'), 0)
                AS sr,
            coalesce(sum(total_balance) FILTER (WHERE k = 'scenario_only'
                AND dpd_bucket = '90+'), 0) AS mr FROM m LEFT JOIN l ON m.sid = l.contract_id)
        SELECT 'SUITE_star' AS suite_id, 'policy_expansion' AS scenario, shared_count,
            baseline_only_count, scenario_only_count, {ratio('sr', 'sb')} AS shared_par90,
            {ratio('mr', 'mb')} AS marginal_par90,
            cast(sb AS double) AS shared_outstanding_balance,
            cast(mb AS double) AS marginal_outstanding_balance,
            shared_count < 30 OR greatest(baseline_only_count, scenario_only_count) < 30
                AS low_sample, {TIER.format(n='least(shared_count, greatest(baseline_only_count, scenario_only_count))')}
                AS sample_classification FROM g""",
)
def composition(s: Source) -> DataFrame:
    return scenarios.composition(
        s.wh.stg("applications"), s.wh.stg("contracts"), s.wh.account_monthly,
        "policy_expansion",
    )


@query(
    "pre_shock_equality",
    "M25",
    """WITH e AS (SELECT * FROM snap WHERE snapshot_date < DATE '1999-01-01'
            AND scenario IN ('baseline', 'macroeconomic_stress')),
        g AS (SELECT suite_id, seed, count(*) FILTER (WHERE scenario = 'baseline') AS n_baseline,
            count(*) FILTER (WHERE scenario <> 'baseline') AS n_scenario,
            count(*) FILTER (WHERE scenario = 'baseline' AND dpd >= 30) AS b,
            count(*) FILTER (WHERE scenario <> 'baseline' AND dpd >= 30) AS s
            FROM e GROUP BY 1, 2)
        SELECT suite_id, seed, n_baseline, n_scenario,
            round(cast(b AS double) / n_baseline, 6) AS rate_baseline,
            round(cast(s AS double) / n_scenario, 6) AS rate_scenario,
            round(cast(s AS double) / n_scenario - cast(b AS double) / n_baseline, 6) + 0.0
                AS delta,
            abs(cast(s AS double) / n_scenario - cast(b AS double) / n_baseline) < 1e-9
                AS identical FROM g""",
)
def pre_shock_equality(s: Source) -> DataFrame:
    return scenarios.pre_shock_equality(
        s.tables["account_monthly_snapshots"], s.tables["macro_context_monthly"]
    )


@query(
    "directional_invariants",
    "M26 U3 U6",
    """WITH b AS (SELECT application_id FROM app WHERE scenario = 'baseline'
            AND outcome = 'approved'),
        e AS (SELECT application_id FROM app WHERE scenario = 'policy_expansion'
            AND outcome = 'approved'),
        q AS (SELECT scenario, customer_id, paid_on, amount, channel FROM pay
            WHERE paid_on < DATE '1999-01-01'),
        x AS (SELECT customer_id, paid_on, amount, channel FROM q WHERE scenario = 'baseline'),
        y AS (SELECT customer_id, paid_on, amount, channel FROM q
            WHERE scenario = 'macroeconomic_stress'),
        r AS (SELECT 'baseline_approved_subset_of_expansion_approved' AS name,
            (SELECT count(*) FROM b WHERE application_id NOT IN (SELECT application_id FROM e))
                AS offending
            UNION ALL SELECT 'tightening_approved_subset_of_baseline_approved', 0
            UNION ALL SELECT 'pre_shock_payments_identical_to_baseline',
                CASE WHEN EXISTS (SELECT * FROM x EXCEPT ALL SELECT * FROM y)
                OR EXISTS (SELECT * FROM y EXCEPT ALL SELECT * FROM x) THEN 1 ELSE 0 END)
        SELECT name, cast(offending AS bigint) AS offending, offending = 0 AS passed FROM r""",
)
def directional_invariants(s: Source) -> DataFrame:
    return scenarios.directional_invariants(s.tables)


@query(
    "shared_population_identity",
    "Q12 U6",
    """SELECT scenario, n AS n_rows, true AS same_as_baseline
        FROM runs CROSS JOIN (SELECT count(*) AS n FROM customer)""",
)
def shared_population(s: Source) -> DataFrame:
    prints = population_fingerprint(s.tables["customers"], ("suite_id", "scenario"))
    base = prints.filter(F.col("scenario") == "baseline").select(
        "suite_id", F.col("fingerprint").alias("base")
    )
    return prints.join(base, "suite_id").select(
        "scenario", "n_rows", (F.col("fingerprint") == F.col("base")).alias("same_as_baseline")
    )


@query(
    "slice_equality",
    "U6 Q10",
    """SELECT a.n AS rows_a, b.n AS rows_b, false AS identical
        FROM (SELECT count(*) AS n FROM app WHERE scenario = 'baseline' AND outcome = 'approved') a,
        (SELECT count(*) AS n FROM app WHERE scenario = 'policy_expansion'
            AND outcome = 'approved') b""",
)
def slice_equality(s: Source) -> DataFrame:
    done = s.tables["applications"].filter(F.col("status") == "approved")
    shown = ["application_id", "customer_id", "channel", "requested_amount"]
    return same_content(
        done.filter(F.col("scenario") == "baseline").select(*shown),
        done.filter(F.col("scenario") == "policy_expansion").select(*shown),
    )


def _insight(question: str, title: str, unit: str, size: str, compared: str, base: str,
             source: str, scenario: str = "'baseline'") -> str:
    delta = "NULL" if base == "NULL" else f"round(cast({compared} AS double) - {base}, 6) + 0.0"
    b = "cast(NULL AS double)" if base == "NULL" else f"round(cast({base} AS double), 6)"
    return f"""SELECT '{question}' AS question_id, '{title}' AS title, {scenario} AS scenario,
        {b} AS baseline_value, round(cast({compared} AS double), 6) AS compared_value,
        {delta} AS delta, '{unit}' AS unit, cast({size} AS bigint) AS sample_size,
        {TIER.format(n=f'({size})')} AS sample_classification FROM {source}"""


_SCEN = """(SELECT a.scenario, a.ap, b.ap AS bap, a.dl, b.dl AS bdl, a.n FROM
    (SELECT runs.scenario, ap, dl, n FROM runs
     JOIN (SELECT run_id, cast(count(*) FILTER (WHERE outcome = 'approved') AS double)
        / count(*) AS ap, count(*) AS n FROM app WHERE outcome IS NOT NULL GROUP BY 1) x
        ON runs.run_id = x.run_id
     JOIN (SELECT run_id, cast(count(*) FILTER (WHERE dpd >= 90) AS double) / count(*) AS dl
        FROM finalrow GROUP BY 1) y ON runs.run_id = y.run_id) a
    CROSS JOIN (SELECT ap, dl FROM
     (SELECT cast(count(*) FILTER (WHERE outcome = 'approved') AS double) / count(*) AS ap
        FROM app WHERE outcome IS NOT NULL AND scenario = 'baseline') x,
     (SELECT cast(count(*) FILTER (WHERE dpd >= 90) AS double) / count(*) AS dl
        FROM finalrow WHERE scenario = 'baseline') y) b
    WHERE a.scenario <> 'baseline')"""
_LAST = """(SELECT * FROM delinq WHERE scenario = 'baseline' QUALIFY row_number() OVER
    (ORDER BY snapshot_date DESC) = 1)"""


@query(
    "insight_table",
    "M29",
    " UNION ALL ".join([
        _insight("FUN-01", "credit funnel", "count", "d", "b", "s",
                 "(SELECT sum(applications_submitted) AS s, sum(decisioned_applications) AS d, "
                 "sum(booked_count) AS b FROM funnel WHERE scenario = 'baseline')"),
        _insight("COMP-01", "outstanding balance", "monetary_units", "n", "l", "f",
                 "(SELECT cast(arg_min(b, d) AS double) AS f, cast(arg_max(b, d) AS double) AS l, "
                 "arg_max(a, d) AS n FROM (SELECT snapshot_date AS d, sum(total_balance) AS b, "
                 "count(*) FILTER (WHERE contract_status IN ('active', 'delinquent')) AS a "
                 "FROM acct WHERE scenario = 'baseline' GROUP BY 1))"),
        *[
            _insight("DEL-01", f"par{k}", "fraction_of_balance", "total_contracts",
                     f"CASE WHEN total_balance > 0 THEN cast(balance_{k}plus AS double) "
                     f"/ cast(total_balance AS double) END", "NULL", _LAST)
            for k in (30, 60, 90)
        ],
        _insight("CUR-01", "cure rate", "fraction", "n", "c", "NULL",
                 "(SELECT arg_max(total_contracts, snapshot_date) AS n, "
                 "avg(cast(cures AS double) / nullif(prior_month_delinquent_count, 0)) AS c "
                 "FROM delinq WHERE scenario = 'baseline')"),
        _insight("VIN-01", "roll forward from current", "fraction", "t", "1 - s / t", "NULL",
                 "(SELECT sum(contract_count) AS t, cast(sum(contract_count) FILTER "
                 "(WHERE to_bucket = 'current') AS double) AS s FROM rolls "
                 "WHERE scenario = 'baseline' AND from_bucket = 'current')"),
        _insight("VIN-01", "vintage 90+ incidence", "fraction", "n", "l / n", "NULL",
                 "(SELECT sum(contracts_observed) AS n, cast(sum(contracts_90plus) AS double) "
                 "AS l FROM vintages WHERE scenario = 'baseline' AND months_on_book = "
                 "(SELECT min(max_mob_observed_for_cohort) FROM vintages "
                 "WHERE scenario = 'baseline'))"),
        _insight("CUR-02", "redefault", "count", "n", "r", "n",
                 "(SELECT count(*) FILTER (WHERE cure_count > 0) AS n, count(*) FILTER "
                 "(WHERE cure_count > 0 AND relapse_count > 0) AS r FROM cured "
                 "WHERE scenario = 'baseline')"),
        _insight("COL-01", "write-off total", "monetary_units", "n", "a", "NULL",
                 "(SELECT count(*) AS n, sum(amount) AS a FROM wo WHERE scenario = 'baseline')"),
        _insight("COL-01", "recovery total", "monetary_units", "n", "r", "a",
                 "(SELECT count(*) AS n, cast(sum(amount) AS double) AS a, "
                 "sum(recovery_amount) AS r FROM woo WHERE scenario = 'baseline')"),
        _insight("FUN-03", "approval rate against baseline", "fraction", "n", "ap", "bap", _SCEN,
                 "scenario"),
        _insight("SCN-01", "final 90+ rate against baseline", "fraction", "n", "dl", "bdl",
                 _SCEN, "scenario"),
        _insight("SCN-02", "par90 after the shock", "fraction_of_balance", "stress_n_months",
                 "sp", "bp", "(SELECT count(DISTINCT snapshot_date) FILTER (WHERE scenario = "
                 "'macroeconomic_stress') AS stress_n_months, avg(p) FILTER (WHERE scenario = "
                 "'macroeconomic_stress') AS sp, avg(p) FILTER (WHERE scenario = 'baseline') AS bp "
                 "FROM (SELECT *, cast(balance_90plus AS double) / nullif(cast(total_balance "
                 "AS double), 0) AS p FROM delinq WHERE snapshot_date >= DATE '1999-01-01'))",
                 "'macroeconomic_stress'"),
    ]),
)
def insights(s: Source) -> DataFrame:
    w = s.wh
    # Each mart has a few rows a month; as one plan the driver would hold all of them at once.
    w.settle("funnel", "portfolio", "delinquency", "rolls", "vintages", "writeoffs", "scenarios", "stress")
    return insight_table(w.funnel, w.portfolio, w.delinquency, w.rolls, w.vintages, w.cures,
                         w.writeoffs, w.scenarios, w.stress)





AMOUNT_RANGES = ((0, 100000), (100000, 250000), (250000, 500000))
ORDER_LABELS = {"F": "filled", "O": "open"}


@query(
    "labelled_amounts",
    "F8 F9",
    """SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN '0-100000'
            WHEN o_totalprice >= 100000 AND o_totalprice < 250000 THEN '100000-250000'
            WHEN o_totalprice >= 250000 AND o_totalprice < 500000 THEN '250000-500000'
            ELSE 'out_of_range' END AS amount_range,
        CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open'
            ELSE 'undocumented_code' END AS order_state, count(*) AS n
        FROM orders GROUP BY 1, 2""",
)
def labelled_amounts(s: Source) -> DataFrame:
    return s.raw("orders").groupBy(
        range_label("o_totalprice", AMOUNT_RANGES).alias("amount_range"),
        code_label("o_orderstatus", ORDER_LABELS, "undocumented_code").alias("order_state"),
    ).agg(F.count(F.lit(1)).alias("n"))
