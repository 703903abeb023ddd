"""Features, splits, models, signals and incidents as registered queries.

Model rows: embedding vectors read as monthly account histories, y = label is 0.
Signals: event values per day and type against their overall mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.operators import alerts, batch_input, drift
from loanweave.operators import features as ft
from loanweave.operators import models as m
from loanweave.plans.catalog import Source, cte, query
from loanweave.plans.monitoring import Monitor, calibrate
from loanweave.plans.queries_scores import batches, scores
from loanweave.session import settle

SHARES = {"train": 0.6, "validation": 0.2, "test": 0.2}


def _element(i: int) -> Column:
    return F.col("embedding")[i].cast("double")


def accounts(s: Source) -> DataFrame:
    """id, y and the raw columns X1, X6..X23."""
    cols = {"X1": F.round(F.abs(_element(0)) * 100000)}
    for i, n in enumerate(ft.DELINQUENCY):
        cols[n] = F.least(F.greatest(F.round(_element(1 + i) * 20), F.lit(-2.0)), F.lit(9.0))
    for i, n in enumerate(ft.BILLS):
        cols[n] = F.round(_element(7 + i) * 10000)
    for i, n in enumerate(ft.PAID):
        cols[n] = F.greatest(F.round(_element(13 + i) * 10000), F.lit(0.0))
    return s.raw("embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"),
        (F.col("label") % 3).cast("string").alias("segment"),
        *[c.alias(n) for n, c in cols.items()])


def _x(i: int) -> str:
    return f"cast(embedding[{i + 1}] AS double)"


cte(
    "ux",
    "SELECT vec_id AS id, (label = 0)::int AS y, cast(label % 3 AS varchar) AS segment, "
    f"round(abs({_x(0)}) * 100000) AS x1, "
    + ", ".join([
        *[f"least(greatest(round({_x(1 + i)} * 20), -2.0::double), 9.0::double) AS d{i}"
          for i in range(6)],
        *[f"round({_x(7 + i)} * 10000) AS b{i}" for i in range(6)],
        *[f"greatest(round({_x(13 + i)} * 10000), 0.0::double) AS p{i}" for i in range(6)],
    ]) + " FROM embeddings",
)

_B = [f"b{i}" for i in range(6)]
_P = [f"p{i}" for i in range(6)]
_D = [f"d{i}" for i in range(6)]


def _capped(n: str, d: str) -> str:
    return (f"least(greatest(CASE WHEN abs({d}) > 1e-9 THEN {n} / {d} ELSE 0 END, -5.0::double), "
            f"5.0::double)")


def _covered(p: str, b: str) -> str:
    return f"CASE WHEN {b} > 1e-9 THEN greatest({_capped(p, b)}, 0) ELSE 5.0 END"


def _std(names: list[str]) -> str:
    mean = f"(({' + '.join(names)}) / 6)"
    return f"sqrt(({' + '.join(f'pow({n} - {mean}, 2)' for n in names)}) / 6)"


# Longest streak: the largest k for which some k neighbours are all late.
_RUN = "CASE " + " ".join(
    f"WHEN {' OR '.join('(' + ' AND '.join(f'd{j} > 0' for j in range(i, i + k)) + ')' for i in range(7 - k))} THEN {k}"
    for k in range(6, 0, -1)) + " ELSE 0 END"
_SB, _SP = f"({' + '.join(_B)})", f"({' + '.join(_P)})"
_PAIRS = list(zip(_P[:5], _B[1:]))
_FEATURE_SQL = {
    "max_delinquency_status": f"greatest({', '.join(_D)})",
    "months_delinquent_count": " + ".join(f"(d{i} > 0)::int" for i in range(6)),
    "most_recent_delinquency_status": "d0",
    "delinquency_trend": "(d0 - d5) / 5",
    "consecutive_months_delinquent": _RUN,
    "total_bill_amount": _SB,
    "avg_bill_amount": f"{_SB} / 6",
    "bill_trend": "(b0 - b5) / 5",
    "bill_variability": _std(_B),
    "utilization_ratio": _capped(f"({_SB} / 6)", "x1"),
    "total_payment_amount": _SP,
    "avg_payment_amount": f"{_SP} / 6",
    "payment_to_bill_ratio": _covered(_SP, _SB),
    "months_without_payment": " + ".join(f"({p} = 0)::int" for p in _P),
    "payment_coverage_rate": "(" + " + ".join(
        f"({p} >= {b} OR {b} <= 1e-9)::int" for p, b in _PAIRS) + ") / 5.0::double",
    "payment_variation": f"{_std(_P)} / (abs({_SP} / 6) + 1e-9)",
    "worst_payment_to_bill_ratio": f"least({', '.join(_covered(p, b) for p, b in _PAIRS)})",
    "limit_exposure_distance": _capped(f"(x1 - {_SB} / 6)", "x1"),
}


@query(
    "behavioural_features",
    "B1 F16 F17 W13",
    "SELECT id, " + ", ".join(f"round(cast({e} AS double), 6) + 0.0 AS {n}"
                              for n, e in _FEATURE_SQL.items()) + " FROM ux",
)
def behavioural_features(s: Source) -> DataFrame:
    return ft.behavioural_features(accounts(s), ["id"])


def frame(s: Source) -> DataFrame:
    return ft.behavioural_features(accounts(s), ["id", "y", "segment"])


_HASH = "cast('0x' || substr(md5('{seed}:' || id), 1, 13) AS bigint)"
_SPLIT = f"""SELECT id, y, CASE WHEN (k - 1)::double / n < 0.6 THEN 'train'
    WHEN (k - 1)::double / n < {0.6 + 0.2!r} THEN 'validation' ELSE 'test' END AS split FROM (
    SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {_HASH.format(seed=1)}, id) AS k,
    count(*) OVER (PARTITION BY y) AS n FROM ux)"""


@query("stratified_split", "B2 J22 W9", _SPLIT)
def stratified_split(s: Source) -> DataFrame:
    base = accounts(s).select("id", "y")
    assigned = ft.stratified_split(base, "id", "y", SHARES)
    return ft.apply_split(base, assigned, "id")


@query(
    "split_manifest",
    "B3",
    f"""SELECT split, count(*) AS n, round(avg(y::double), 6) AS prevalence, cast(sum(cast(cast('0x'
        || substr(sha256(cast(id AS varchar)), 1, 15) AS bigint) AS decimal(38,0))) AS varchar)
        AS id_hash FROM ({_SPLIT}) GROUP BY 1""",
)
def split_manifest(s: Source) -> DataFrame:
    split = ft.stratified_split(accounts(s).select("id", "y"), "id", "y", SHARES)
    return ft.split_manifest(split, "id", "y")


@query(
    "batch_numbers",
    "B17",
    """SELECT event_id, cast((row_number() OVER (ORDER BY event_id) - 1) // 500 + 1 AS integer)
        AS batch_sequence FROM events""",
)
def batch_numbers(s: Source) -> DataFrame:
    return ft.number_batches(s.raw("events").select("event_id"), "event_id", 500)


@query(
    "negative_controls",
    "B18",
    f"""WITH a AS (SELECT id, y, row_number() OVER (ORDER BY id) AS k FROM ux),
        b AS (SELECT y AS v, row_number() OVER (ORDER BY {_HASH.format(seed=4)}, id) AS k FROM ux)
        SELECT id, y, v::double AS control_shuffled, id::double AS control_id,
            y::double AS control_leak_rounded
        FROM a JOIN b ON a.k = b.k""",
)
def negative_controls(s: Source) -> DataFrame:
    # The leak is the target with a little noise, so it rounds to the target.
    return ft.negative_controls(accounts(s).select("id", "y"), "id", "y").select(
        "id", "y", "control_shuffled", "control_id",
        (F.round("control_leak") + F.lit(0.0)).alias("control_leak_rounded"))


_PAIR_NAMES = ft.FEATURES


@query(
    "correlated_pairs",
    "A16 E20",
    "WITH f AS (SELECT " + ", ".join(f"{_FEATURE_SQL[n]} AS {n}" for n in _PAIR_NAMES)
    + " FROM ux) SELECT first, second, round(r, 6) + 0.0 AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, corr({a}, {b}) AS r FROM f"
        for i, a in enumerate(_PAIR_NAMES) for b in _PAIR_NAMES[i + 1:])
    + ") WHERE abs(r) >= 0.05",
)
def correlated_pairs(s: Source) -> DataFrame:
    return m.correlated_pairs(frame(s), _PAIR_NAMES, 0.05)


@query("vif_reduction", "E19 E20 E21")
def vif_reduction(s: Source) -> DataFrame:
    return m.reduce_by_vif(frame(s), ft.FEATURES)


# --- models ----------------------------------------------------------------------------

MODEL_FEATURES = ("max_delinquency_status", "delinquency_trend", "avg_bill_amount",
                  "utilization_ratio", "avg_payment_amount", "payment_coverage_rate")


def parts(s: Source) -> tuple[DataFrame, DataFrame, DataFrame]:
    split = settle(ft.stratified_split(frame(s), "id", "y", SHARES))
    return tuple(split.filter(F.col("split") == n) for n in SHARES)


@query("model_scores", "B4 B7 B11 F19")
def model_scores(s: Source) -> DataFrame:
    train, _, _ = parts(s)
    return m.score_batch(m.fit(train, MODEL_FEATURES), frame(s), "id", "v1")


@query("model_comparison", "B5 B6 B8 E25")
def model_comparison(s: Source) -> DataFrame:
    train, _, test = parts(s)
    return m.compare_models({
        "prior": m.prior_scores(train, test),
        "rule": m.rule_scores(train, test, "max_delinquency_status"),
        "logistic": m.score(m.fit(train, MODEL_FEATURES), test),
        "boosted": m.score(m.fit(train, MODEL_FEATURES, "boosted"), test),
    })


@query("grid_search", "B9")
def grid_search(s: Source) -> DataFrame:
    return m.grid_search(parts(s)[0], MODEL_FEATURES, (0.1, 1.0, 10.0))[1]


@query("calibrator_choice", "B10")
def calibrator_choice(s: Source) -> DataFrame:
    train, validation, _ = parts(s)
    model = m.fit(train, MODEL_FEATURES)
    return m.choose_calibrator(m.score(model, train), m.score(model, validation))


@query("model_coefficients", "B12")
def model_coefficients(s: Source) -> DataFrame:
    return m.coefficients(m.fit(parts(s)[0], MODEL_FEATURES), MODEL_FEATURES, s.spark)


TIERS = {"max_delinquency_status": "allowed", "delinquency_trend": "allowed",
         "utilization_ratio": "allowed", "payment_coverage_rate": "allowed",
         "avg_payment_amount": "conditional", "avg_bill_amount": "prohibited"}


@query("reason_codes", "B13 O3")
def reason_codes(s: Source) -> DataFrame:
    return m.reason_codes(m.fit(parts(s)[0], MODEL_FEATURES), frame(s), MODEL_FEATURES, TIERS)


@query("permutation_importance", "B14")
def permutation_importance(s: Source) -> DataFrame:
    train, validation, _ = parts(s)
    return m.permutation_importance(m.fit(train, MODEL_FEATURES), validation,
                                    MODEL_FEATURES, 5)


@query("partial_dependence", "B15")
def partial_dependence(s: Source) -> DataFrame:
    train, validation, _ = parts(s)
    return m.partial_dependence(m.fit(train, MODEL_FEATURES), validation, "utilization_ratio")


@query("representative_cases", "O5")
def representative_cases(s: Source) -> DataFrame:
    train, _, test = parts(s)
    return m.representative_cases(m.score(m.fit(train, MODEL_FEATURES), test), 0.1)


STRENGTH = {"missingness": 0.15, "outliers": 0.02, "utilisation": 0.3, "delinquency": 1,
            "payment": 0.5, "prevalence_up": 0.5, "prevalence_down": 0.5, "noise": 0.1,
            "out_of_domain": 0.05}


@query("stress_suite", "B16")
def stress_suite(s: Source) -> DataFrame:
    model = m.fit(parts(s)[0], MODEL_FEATURES)
    return m.stress_suite(model, accounts(s), MODEL_FEATURES, STRENGTH,
                          lambda df: ft.behavioural_features(df, ["id", "y"]))


@query("split_stability", "E15")
def split_stability(s: Source) -> DataFrame:
    return m.split_stability(frame(s), MODEL_FEATURES, (1, 2, 3, 4, 5))


@query("coefficient_stability", "E22")
def coefficient_stability(s: Source) -> DataFrame:
    return m.coefficient_stability(parts(s)[0], MODEL_FEATURES)


@query("retrain_null", "E24")
def retrain_null(s: Source) -> DataFrame:
    return m.retrain_null(frame(s), MODEL_FEATURES)


@query(
    "gate_decision",
    "E26",
    """WITH g AS (SELECT event_type AS model, avg(value) >= 50 AS ok1, max(value) <= 400 AS ok2
            FROM events GROUP BY 1)
        SELECT model, 2::bigint AS gates, (NOT ok2)::bigint AS blocking_failures,
            (NOT ok1)::bigint AS limitations, CASE WHEN NOT ok2 THEN 'validation_failed'
            WHEN NOT ok1 THEN 'validation_passed_with_limitations' ELSE 'validation_passed' END
            AS decision FROM g""",
)
def gate_decision(s: Source) -> DataFrame:
    stats = s.raw("events").groupBy(F.col("event_type").alias("model")).agg(
        F.avg("value").alias("mean"), F.max("value").alias("top"))
    gates = stats.select("model", F.explode(F.array(
        F.struct(F.lit("mean").alias("name"), F.col("mean").alias("value"),
                 F.lit(50.0).alias("limit"), F.lit("min").alias("direction"),
                 F.lit(False).alias("blocking")),
        F.struct(F.lit("top").alias("name"), F.col("top").alias("value"),
                 F.lit(400.0).alias("limit"), F.lit("max").alias("direction"),
                 F.lit(True).alias("blocking")),
    )).alias("g")).select("model", "g.*")
    return m.decision(m.gate_results(gates), ["model"])


# --- signals ---------------------------------------------------------------------------

# Metric, category and cutoffs per event type.
CHANNELS = {
    "view": ("psi_family_wise__view", "feature_drift"),
    "click": ("score_mean_shift", "score_drift"),
    "purchase": ("roc_auc_delta", "performance_drift"),
    "signup": ("event_rate_delta", "target_distribution_drift"),
    "error": ("missingness_rate", "data_quality"),
}
CUT, HARD, FEW, REFUSED_ABOVE = 4.0, 8.0, 50, 350.0

_METRIC = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN '{n}'" for t, (n, _) in CHANNELS.items()) + " END"
_CATEGORY = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN '{c}'" for t, (_, c) in CHANNELS.items()) + " END"
cte(
    "obs",
    f"""SELECT d.batch_sequence, {_CATEGORY} AS category, {_METRIC} AS metric,
    r.ref AS reference_value, d.v AS observed_value, d.n AS sample_size FROM (
    SELECT cast(ts AS date) - DATE '2024-01-01' + 1 AS batch_sequence, event_type,
        cast(sum(cast(value AS decimal(18,2))) AS double) / count(*) AS v, count(*) AS n
        FROM events GROUP BY 1, 2) d JOIN (SELECT event_type,
        cast(sum(cast(value AS decimal(18,2))) AS double) / count(*) AS ref FROM events
        GROUP BY 1) r USING (event_type)""",
)
cte(
    "sig",
    f"""SELECT batch_sequence, category, metric, reference_value, observed_value, sample_size,
    CASE WHEN abs(observed_value - reference_value) >= {HARD} THEN 'material_deviation'
        ELSE 'review' END AS status FROM obs
WHERE sample_size >= {FEW} AND abs(observed_value - reference_value) >= {CUT}
UNION ALL SELECT batch_sequence, 'data_quality', 'schema_validity', 1.0, 0.0, 0, 'blocked_input'
FROM (SELECT DISTINCT cast(ts AS date) - DATE '2024-01-01' + 1 AS batch_sequence FROM events
    WHERE value > {REFUSED_ABOVE})""",
)
cte(
    "grp",
    """SELECT category, batch_sequence, n_signals, nx, blocked, CASE WHEN blocked THEN 'high'
    WHEN strong AND nx THEN 'high' WHEN any_hit THEN 'medium' ELSE 'low' END AS severity FROM (
    SELECT *, coalesce(lead(batch_sequence) OVER (PARTITION BY category ORDER BY batch_sequence)
        = batch_sequence + 1, false) AS nx FROM (
    SELECT category, batch_sequence, count(*) AS n_signals,
        bool_or(status = 'blocked_input') AS blocked,
        bool_or(status = 'material_deviation') AS strong,
        bool_or(status IN ('material_deviation', 'review')) AS any_hit FROM sig GROUP BY 1, 2))""",
)
cte(
    "inc",
    """SELECT category, batch_sequence AS first_batch, batch_sequence AS last_batch,
    1::bigint AS n_groups, n_signals, 'high' AS severity, 'blocked_input' AS status FROM grp
    WHERE blocked
UNION ALL SELECT category, min(batch_sequence), max(batch_sequence), count(*),
    cast(sum(n_signals) AS bigint), CASE WHEN bool_or(severity = 'high') THEN 'high'
    ELSE 'medium' END, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END
    FROM (SELECT *, batch_sequence - row_number() OVER (PARTITION BY category
        ORDER BY batch_sequence) AS island FROM grp WHERE NOT blocked AND severity <> 'low')
    GROUP BY category, island HAVING count(*) >= 2""",
)


def _day() -> Column:
    return (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1)


def observed(s: Source) -> DataFrame:
    e = s.raw("events").select("event_type", _day().alias("batch_sequence"),
                               F.col("value").cast("decimal(18,2)").alias("v"))
    mean = F.sum("v").cast("double") / F.count(F.lit(1))
    ref = e.groupBy("event_type").agg(mean.alias("reference_value"))
    now = e.groupBy("event_type", "batch_sequence").agg(
        mean.alias("observed_value"), F.count(F.lit(1)).alias("sample_size"))

    def pick(i: int) -> Column:
        out = None
        for t, names in CHANNELS.items():
            hit = F.col("event_type") == t
            out = F.when(hit, names[i]) if out is None else out.when(hit, names[i])
        return out

    return now.join(ref, "event_type").select(
        F.lit("run").alias("monitoring_run"), "batch_sequence", F.lit("m").alias("model_id"),
        pick(1).alias("category"), pick(0).alias("metric"), "reference_value", "observed_value",
        "sample_size")


def cutoffs(s: Source) -> DataFrame:
    names = {n.split("__")[0] for n, _ in CHANNELS.values()}
    return s.spark.createDataFrame(
        [(n, CUT, HARD, 0, 0, FEW) for n in sorted(names)],
        "metric string, review_cutoff double, material_cutoff double, n_resamples bigint, "
        "batch_size int, min_sample int")


def refused(s: Source) -> DataFrame:
    return s.raw("events").filter(F.col("value") > REFUSED_ABOVE).select(
        F.lit("run").alias("monitoring_run"), _day().alias("batch_sequence"),
        F.lit("m").alias("model_id")).distinct()


def found(s: Source) -> DataFrame:
    return alerts.signals(alerts.classify(observed(s), cutoffs(s))).unionByName(
        alerts.blocked_signals(refused(s)))


@query(
    "metric_states",
    "N4 N5",
    f"""SELECT batch_sequence, category, metric, sample_size, CASE WHEN sample_size < {FEW}
        THEN 'insufficient_sample' WHEN abs(observed_value - reference_value) >= {HARD}
        THEN 'material_deviation' WHEN abs(observed_value - reference_value) >= {CUT}
        THEN 'review' ELSE 'within_reference_variability' END AS status FROM obs""",
)
def metric_states(s: Source) -> DataFrame:
    return alerts.classify(observed(s), cutoffs(s)).select(
        "batch_sequence", "category", "metric", "sample_size", "status")


@query(
    "signals",
    "N6",
    f"""SELECT 'SIG-' || substr(md5(concat_ws('|', 'run', batch_sequence, category, metric)), 1, 12)
        AS alert_id, batch_sequence, category, metric, round(reference_value, 6)
        AS reference_value, round(observed_value, 6) AS observed_value, sample_size, status,
        CASE WHEN status = 'review' THEN 'medium' ELSE 'high' END AS severity,
        CASE status WHEN 'review' THEN {CUT}::double WHEN 'blocked_input' THEN 1.0::double
            ELSE {HARD}::double END AS threshold FROM sig""",
)
def signals(s: Source) -> DataFrame:
    return found(s).drop("monitoring_run", "model_id")


@query(
    "alert_groups",
    "N7 W11",
    """SELECT batch_sequence, category, n_signals, nx AS confirmed_next_batch, severity,
        CASE WHEN blocked THEN 'blocked_input' ELSE severity END AS status FROM grp""",
)
def alert_groups(s: Source) -> DataFrame:
    return alerts.alert_groups(found(s)).drop("monitoring_run")


@query("incidents", "N8 W10", "SELECT * FROM inc")
def incidents(s: Source) -> DataFrame:
    return alerts.incidents(alerts.alert_groups(found(s))).drop("monitoring_run")


@query(
    "compression_ratios",
    "N9",
    """SELECT a AS n_signals, b AS n_alert_groups, c AS n_incidents, round(a::double / b, 6)
        AS alert_compression_ratio, round(a::double / nullif(c, 0), 6)
        AS incident_compression_ratio FROM (SELECT (SELECT count(*) FROM sig) AS a,
        (SELECT count(*) FROM grp) AS b, (SELECT count(*) FROM inc) AS c) WHERE a > 0""",
)
def compression_ratios(s: Source) -> DataFrame:
    sig = found(s)
    groups = alerts.alert_groups(sig)
    return alerts.compression(sig, groups, alerts.incidents(groups)).drop("monitoring_run")


@query(
    "benjamini_hochberg",
    "N10",
    """WITH p AS (SELECT cast(ts AS date) - DATE '2024-01-01' + 1 AS batch_sequence, event_type,
            min(value) / 10 AS p FROM events GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY batch_sequence ORDER BY p, event_type)
            AS rank, count(*) OVER (PARTITION BY batch_sequence) AS family FROM p),
        k AS (SELECT batch_sequence AS b, max(rank) FILTER (WHERE p <= rank / family::double
            * 0.1::double) AS k FROM r GROUP BY 1)
        SELECT batch_sequence, event_type, round(p, 6) AS p, rank, family,
            coalesce(rank <= k, false) AS significant FROM r JOIN k ON batch_sequence = b""",
)
def benjamini_hochberg(s: Source) -> DataFrame:
    codes = {t: i for i, t in enumerate(sorted(CHANNELS))}
    order = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    p = s.raw("events").groupBy(_day().alias("batch_sequence"), "event_type").agg(
        (F.min("value") / 10).alias("p")).withColumn("code", order[F.col("event_type")])
    return alerts.benjamini_hochberg(p, ["batch_sequence"], "code", "p", 0.1).drop("code")


_EXPECTED = f"""exp AS (SELECT batch_sequence, 'day' || batch_sequence AS scenario,
        arg_max(category, (abs(observed_value - reference_value), category))
            AS top_category, max(abs(observed_value - reference_value)) >= 10 AS should_detect,
        batch_sequence IN (SELECT batch_sequence FROM sig WHERE status = 'blocked_input')
            AS blocked FROM obs WHERE sample_size >= {FEW} GROUP BY 1),
    w AS (SELECT *, CASE WHEN blocked THEN 'blocked_input' ELSE top_category END
        AS expected_category, CASE WHEN blocked THEN 'data_quality' ELSE top_category END AS cat
        FROM exp),
    h AS (SELECT w.*, g.severity AS detected_severity, g.category IS NOT NULL
        AND (g.blocked OR NOT w.blocked) AS detected,
        EXISTS (SELECT 1 FROM inc i WHERE i.category = w.cat AND w.batch_sequence
            BETWEEN i.first_batch AND i.last_batch) AS in_incident
        FROM w LEFT JOIN grp g ON g.batch_sequence = w.batch_sequence AND g.category = w.cat)"""


def expected(s: Source) -> DataFrame:
    gap = F.abs(F.col("observed_value") - F.col("reference_value"))
    per = observed(s).filter(F.col("sample_size") >= FEW).groupBy(
        "monitoring_run", "batch_sequence").agg(
        F.max_by("category", F.struct(gap, F.col("category"))).alias("top"),
        (F.max(gap) >= 10).alias("should_detect"))
    out = per.join(refused(s).select("batch_sequence", F.lit(True).alias("b")), "batch_sequence",
                   "left")
    blocked = F.coalesce("b", F.lit(False))
    return out.select(
        "monitoring_run", "batch_sequence",
        F.concat(F.lit("day"), F.col("batch_sequence")).alias("scenario"),
        F.when(blocked, "blocked_input").otherwise(F.col("top")).alias("expected_category"),
        "should_detect", blocked.alias("should_block"), blocked.alias("blocked"))


def _detected(s: Source) -> DataFrame:
    groups = alerts.alert_groups(found(s))
    return alerts.detection_rows(expected(s), groups, alerts.incidents(groups))


@query(
    "detection_rows",
    "N13",
    f"""WITH {_EXPECTED} SELECT batch_sequence, scenario, expected_category, should_detect,
        blocked AS should_block, detected, detected_severity, in_incident,
        true AS correctly_blocked, should_detect AND detected AS true_positive,
        NOT should_detect AND detected AS false_positive FROM h""",
)
def detection_rows(s: Source) -> DataFrame:
    return _detected(s).drop("monitoring_run")


@query(
    "detection_rates",
    "N13",
    f"""WITH {_EXPECTED} SELECT
        round(avg((detected)::int::double) FILTER (WHERE should_detect), 6)
            AS scenario_detection_rate,
        round(avg((detected)::int::double) FILTER (WHERE NOT should_detect), 6)
            AS false_alert_rate,
        round(avg(1.0::double) FILTER (WHERE blocked), 6) AS blocked_input_recall,
        round(avg((blocked OR should_detect)::int::double) FILTER
            (WHERE detected AND detected_severity = 'high'), 6) AS severity_precision FROM h
        HAVING count(*) > 0""",
)
def detection_rates(s: Source) -> DataFrame:
    return alerts.detection_rates(_detected(s)).drop("monitoring_run")


# --- studies and the whole run ---------------------------------------------------------


def _counts(s: Source) -> DataFrame:
    ref = batches(s)[0]
    return drift.histogram(ref, drift.edges_of(ref), [])


@query("chance_cutoffs", "N1 N2 N3")
def chance_cutoffs(s: Source) -> DataFrame:
    return calibrate(scores(s), ["p"], ["lang", "source"], 200, 500)


def _psi_cutoffs(s: Source) -> DataFrame:
    counts = _counts(s)
    return alerts.calibrate_psi(counts, 500, 500).unionByName(
        alerts.calibrate_family_wise(counts, 500, 500))


@query("false_alert_study", "N11")
def false_alert_study(s: Source) -> DataFrame:
    return alerts.false_alert_study(_counts(s), _psi_cutoffs(s), 500, 100)


@query("batch_size_study", "N12")
def batch_size_study(s: Source) -> DataFrame:
    return alerts.batch_size_study(_counts(s), _psi_cutoffs(s))


def _monitor(s: Source) -> tuple[Monitor, DataFrame]:
    """A fitted model, its training rows as reference, all rows as numbered batches."""
    train = parts(s)[0]
    model = m.fit(train, MODEL_FEATURES)
    keep = ["id", "y", "segment", *MODEL_FEATURES]
    reference = settle(m.score(model, train, keep))
    raw_columns = ("X1", *ft.DELINQUENCY, *ft.BILLS, *ft.PAID)
    contract = batch_input.BatchContract(
        "id", raw_columns, domains={n: tuple(range(-2, 10)) for n in ft.DELINQUENCY},
        bounds={n: 1e7 for n in (*ft.BILLS, *ft.PAID)}, tolerated=("y", "segment"),
        order_column="id")

    def engineer(clean: DataFrame) -> DataFrame:
        made = ft.behavioural_features(clean, ["batch_sequence", "id", "y", "segment"])
        return m.score(model, made, ["batch_sequence", *keep])

    limits = settle(calibrate(reference, MODEL_FEATURES, ["segment"], 100, 500))
    monitor = Monitor(reference, limits, contract, MODEL_FEATURES, ("segment",), engineer,
                      model="v1")
    raw = ft.number_batches(accounts(s), "id", 100)
    return monitor, raw


@query("monitoring_run", "N14")
def monitoring_run(s: Source) -> DataFrame:
    monitor, raw = _monitor(s)
    return monitor.signals(raw, "run")


@query("sensitivity_study", "N12")
def sensitivity_study(s: Source) -> DataFrame:
    raw = accounts(s)
    ref = drift.long_features(ft.behavioural_features(raw, ["id"]), MODEL_FEATURES)
    edges = drift.edges_of(ref)
    counts = drift.histogram(ref, edges, [])
    limits = alerts.calibrate_psi(counts, 500, 500).unionByName(
        alerts.calibrate_family_wise(counts, 500, 500))
    edited = None
    for kind, values in (("utilisation", (0.1, 0.3, 0.5)), ("payment", (0.2, 0.4, 0.6)),
                         ("delinquency", (1, 2, 3)), ("missingness", (0.05, 0.15, 0.3)),
                         ("outliers", (0.01, 0.02, 0.05)), ("noise", (0.05, 0.1, 0.2))):
        for v in values:
            one = ft.behavioural_features(ft.perturb(raw, kind, "id", v), ["id"]).withColumn(
                "edit", F.lit(kind)).withColumn("magnitude", F.lit(float(v)))
            edited = one if edited is None else edited.unionByName(one)
    keys = ["edit", "magnitude"]
    new = drift.long_features(edited, MODEL_FEATURES, keys)
    psi = drift.divergences(counts, drift.histogram(new, edges, keys, clipped=True), keys)
    size = edited.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return alerts.sensitivity_study(psi.join(size, keys), limits)
