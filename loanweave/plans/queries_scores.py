"""Evaluation of scores and drift measures as registered queries.

Scores: labelled documents, y = toxic, p = n_chars / (n_chars + 500), group = language.
Batches: line items by ship year against those of 1996.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.functions.buckets import risk_band
from loanweave.operators import drift
from loanweave.operators import evaluation as ev
from loanweave.operators.scan import average_ranks, exact_quantiles
from loanweave.plans.catalog import Source, cte, query
from loanweave.plans.oracle_tables import rnd
from loanweave.plans.queries_segments import TIER

cte(
    "sc",
    """SELECT l.doc_id AS id, l.toxic AS y, l.quality, d.n_chars / (d.n_chars + 500.0::double) AS p,
    d.lang, d.source, CASE WHEN l.quality = 1 THEN 'test' ELSE 'validation' END AS part
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
)


def scores(s: Source) -> DataFrame:
    d = s.raw("documents").select("doc_id", "n_chars", "lang", "source")
    return s.raw("labels").join(d, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("toxic").alias("y"),
        "quality",
        (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("p"),
        "lang", "source",
        F.when(F.col("quality") == 1, "test").otherwise("validation").alias("part"),
    )


def _rank_sql(by: str = "'all'") -> str:
    """AUC by tied ranks, tie-grouped average precision and KS, per group."""
    return f"""r AS (SELECT {by} AS grp, p, y, rank() OVER (PARTITION BY {by} ORDER BY p)
            + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0::double AS rk FROM sc),
        t AS (SELECT grp, p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b
            FROM r GROUP BY 1, 2),
        u AS (SELECT *, sum(a) OVER (PARTITION BY grp ORDER BY p DESC) AS tp,
            sum(b) OVER (PARTITION BY grp ORDER BY p DESC) AS fp,
            sum(a) OVER (PARTITION BY grp) AS np, sum(b) OVER (PARTITION BY grp) AS nn FROM t),
        m AS (SELECT grp, sum(a * tp::double / (tp + fp)) / nullif(any_value(np), 0) AS ap,
            max(abs(tp::double / nullif(np, 0) - fp::double / nullif(nn, 0))) AS ks,
            any_value(np) AS np, any_value(nn) AS nn FROM u GROUP BY 1),
        q AS (SELECT grp, sum(rk) FILTER (WHERE y = 1) AS rs FROM r GROUP BY 1),
        disc AS (SELECT m.grp, cast(np + nn AS bigint) AS n, cast(np AS bigint) AS n_positive,
            CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2.0::double)
                / (np::double * nn) END AS roc_auc,
            CASE WHEN np > 0 AND nn > 0 THEN ap END AS pr_auc,
            CASE WHEN np > 0 AND nn > 0 THEN ks END AS ks_statistic
            FROM m JOIN q ON m.grp = q.grp)"""


_DISC = ", ".join(f"{rnd(c)} AS {c}" for c in ("roc_auc", "pr_auc", "ks_statistic"))


@query(
    "discrimination_by_language",
    "E1 E2 E3 W8",
    f"WITH {_rank_sql('lang')} SELECT grp AS lang, n, n_positive, {_DISC} FROM disc",
)
def discrimination(s: Source) -> DataFrame:
    return ev.discrimination(scores(s), ["lang"])


@query(
    "calibration_errors",
    "E4 F18",
    """SELECT lang, round(avg(y::double), 6) AS prevalence,
        round(avg((p - y) * (p - y)), 6) AS brier_score,
        round(-avg(y * ln(c) + (1 - y) * ln(1 - c)), 6) AS log_loss
        FROM (SELECT *, least(greatest(p, 0.000001), 0.999999) AS c FROM sc) GROUP BY 1""",
)
def calibration_errors(s: Source) -> DataFrame:
    return ev.calibration_errors(scores(s), ["lang"])


def _newton_sql(steps: int) -> str:
    base = """x0 AS (SELECT y, ln(c / (1 - c)) AS x FROM (SELECT y,
        least(greatest(p, 0.000001), 0.999999) AS c FROM sc)),
        n0 AS (SELECT ln(avg(y::double) / (1 - avg(y::double))) AS a, 0.0::double AS b
            FROM sc)"""
    for i in range(steps):
        base += f""",
        h{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - mu) AS g0,
            sum((y - mu) * x) AS g1, sum(mu * (1 - mu)) AS h0, sum(mu * (1 - mu) * x) AS h1,
            sum(mu * (1 - mu) * x * x) AS h2 FROM (SELECT y, x, a, b,
            1 / (1 + exp(-(a + b * x))) AS mu FROM x0, n{i})),
        n{i + 1} AS (SELECT a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a,
            b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM h{i})"""
    return base


@query(
    "calibration_line",
    "E5",
    f"WITH {_newton_sql(12)} SELECT round(a, 6) AS calibration_intercept, "
    "round(b, 6) AS calibration_slope FROM n12",
)
def calibration_line(s: Source) -> DataFrame:
    return ev.calibration_line(scores(s))


def _ece_width(bins: int) -> str:
    cuts = " + ".join(f"(p >= {i * (1.0 / bins)!r}::double)::int" for i in range(1, bins))
    return f"""SELECT 'equal_width' AS strategy, {bins} AS n_bins,
        round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM (SELECT {cuts} AS b, count(*) AS n,
        sum(p) AS sp, sum(y::double) AS sy FROM sc GROUP BY 1)"""


def _ece_mass(bins: int) -> str:
    qs = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"""SELECT 'equal_mass', {bins}, round(sum(abs(sp - sy)) / sum(n), 6) FROM (
        SELECT len(list_filter(e[2:len(e) - 1], lambda z: z <= p)) AS b, count(*) AS n,
        sum(p) AS sp, sum(y::double) AS sy FROM sc, (SELECT list_sort(list_distinct(
        quantile_cont(p, [{qs}]))) AS e FROM sc) GROUP BY 1)"""


@query(
    "ece_bin_sensitivity",
    "E6",
    " UNION ALL ".join([_ece_width(b) for b in (5, 10, 20)] + [_ece_mass(b) for b in (5, 10, 20)]),
)
def ece_bin_sensitivity(s: Source) -> DataFrame:
    return ev.ece_bin_sensitivity(scores(s))


def _confusion_sql(source: str, t: str, keys: str = "") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}count(*) AS n_total, count(*) FILTER (WHERE p >= {t}) AS n_flagged,
        count(*) FILTER (WHERE p >= {t} AND y = 1) AS true_positive,
        count(*) FILTER (WHERE p >= {t} AND y = 0) AS false_positive,
        count(*) FILTER (WHERE p < {t} AND y = 0) AS true_negative,
        count(*) FILTER (WHERE p < {t} AND y = 1) AS false_negative FROM {source} {group}"""


_RATES = """round(coalesce(true_positive::double / nullif(n_flagged, 0), 0), 6) AS precision,
    round(coalesce(true_positive::double / nullif(true_positive + false_negative, 0), 0), 6)
        AS recall,
    round(coalesce(true_negative::double / nullif(true_negative + false_positive, 0), 0), 6)
        AS specificity,
    round(n_flagged::double / n_total, 6) AS selection_rate,
    round(coalesce(2.0::double * true_positive / nullif(2 * true_positive + false_positive
        + false_negative, 0), 0), 6) AS f1,
    round((coalesce(true_positive::double / nullif(true_positive + false_negative, 0), 0)
        + coalesce(true_negative::double / nullif(true_negative + false_positive, 0), 0)) / 2, 6)
        AS balanced_accuracy"""


@query(
    "confusion_by_language",
    "E7",
    f"WITH c AS ({_confusion_sql('sc', '0.5', 'lang')}) SELECT *, {_RATES} FROM c",
)
def confusion(s: Source) -> DataFrame:
    return ev.confusion(scores(s), 0.5, ["lang"])


@query(
    "decile_table",
    "E8 W9",
    """WITH r AS (SELECT y, (row_number() OVER (ORDER BY p DESC, id) - 1) * 10
            // count(*) OVER () + 1 AS decile FROM sc),
        g AS (SELECT cast(decile AS integer) AS decile, count(*) AS n,
            cast(sum(y) AS bigint) AS n_positive FROM r GROUP BY 1),
        t AS (SELECT sum(n)::double AS tn, sum(n_positive)::double AS tp FROM g)
        SELECT decile, n, n_positive, round(n_positive::double / n, 6) AS event_rate,
            round((n_positive::double / n) / (tp / tn), 6) AS lift,
            round(n_positive / tp, 6) AS capture_rate,
            round(sum(n_positive) OVER (ORDER BY decile) / tp, 6) AS cumulative_capture_rate,
            round(sum(n) OVER (ORDER BY decile) / tn, 6) AS cumulative_population_share
        FROM g, t""",
)
def decile_table(s: Source) -> DataFrame:
    return ev.decile_table(scores(s), "id")


@query(
    "all_metrics",
    "E9",
    f"""WITH {_rank_sql()}, {_newton_sql(12)}, c AS ({_confusion_sql('sc', '0.5')}),
        k AS (SELECT avg(y::double) AS prevalence, avg((p - y) * (p - y)) AS brier_score,
            -avg(y * ln(least(greatest(p, 0.000001), 0.999999)) + (1 - y)
            * ln(1 - least(greatest(p, 0.000001), 0.999999))) AS log_loss FROM sc),
        e AS ({_ece_width(10)}), v AS (SELECT *, {_RATES} FROM c),
        w AS (SELECT {', '.join(f'{c}::double AS {c}' for c in ('prevalence', 'roc_auc', 'pr_auc',
        'ks_statistic', 'brier_score', 'log_loss'))}, n12.a AS calibration_intercept,
            n12.b AS calibration_slope, e.ece, v.precision, v.recall, v.specificity, v.f1,
            v.balanced_accuracy FROM disc, k, n12, e, v)
        SELECT metric, round(value, 6) AS value FROM (UNPIVOT w ON COLUMNS(*)
            INTO NAME metric VALUE value)""",
)
def all_metrics(s: Source) -> DataFrame:
    return ev.all_metrics(scores(s), 0.5)


@query(
    "share_threshold",
    "E10 A12",
    """SELECT lang, round(quantile_cont(p, 0.8::double), 6) AS threshold, round(list_sort(list(p),
        'DESC')[greatest(1, least(count(*), cast(round_even(0.2::double * count(*), 0) AS bigint)))],
        6) AS index_threshold FROM sc GROUP BY 1""",
)
def share_threshold(s: Source) -> DataFrame:
    return ev.share_threshold(scores(s), 0.2, ["lang"])


_RECALL = """SELECT p AS threshold, recall FROM (SELECT DISTINCT p, count(*) FILTER (WHERE y = 1)
    OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)::double
    / count(*) FILTER (WHERE y = 1) OVER () AS recall FROM {src})
    ORDER BY round(abs(recall - {t}), 12), p DESC LIMIT 1"""


@query(
    "recall_threshold",
    "E11",
    f"SELECT round(threshold, 6) AS threshold, round(recall, 6) AS recall FROM "
    f"({_RECALL.format(src='sc', t='0.7::double')})",
)
def recall_threshold(s: Source) -> DataFrame:
    return ev.recall_threshold(scores(s), 0.7)


@query(
    "operating_points",
    "E12",
    f"""WITH va AS (SELECT * FROM sc WHERE part = 'validation'),
        te AS (SELECT * FROM sc WHERE part = 'test'),
        o AS (SELECT 'top10' AS name, 'population_share' AS type, 0.1::double AS target,
            quantile_cont(p, 0.9::double) AS t FROM va
            UNION ALL SELECT 'recall60', 'recall', 0.6::double, threshold FROM
            ({_RECALL.format(src='va', t='0.6::double')})),
        c AS (SELECT name, type, target, t AS threshold, count(*) AS n_total,
            count(*) FILTER (WHERE p >= t) AS n_flagged,
            count(*) FILTER (WHERE p >= t AND y = 1) AS true_positive,
            count(*) FILTER (WHERE p >= t AND y = 0) AS false_positive,
            count(*) FILTER (WHERE p < t AND y = 0) AS true_negative,
            count(*) FILTER (WHERE p < t AND y = 1) AS false_negative FROM o, te
            GROUP BY 1, 2, 3, 4)
        SELECT * REPLACE (round(threshold, 6) AS threshold), {_RATES} FROM c""",
)
def operating_points(s: Source) -> DataFrame:
    df = scores(s)
    return ev.operating_points(
        df.filter(F.col("part") == "validation"), df.filter(F.col("part") == "test"),
        [("top10", "population_share", 0.1), ("recall60", "recall", 0.6)],
    )


@query("threshold_stability", "E13")
def threshold_stability(s: Source) -> DataFrame:
    return ev.threshold_stability(scores(s), 0.2, "id")


@query("bootstrap_bands", "E14")
def bootstrap_bands(s: Source) -> DataFrame:
    return ev.bootstrap(scores(s))


@query(
    "bootstrap_points",
    "E14",
    f"""WITH {_rank_sql()}, top AS (SELECT quantile_cont(p, 0.9::double) AS cut FROM sc),
        k AS (SELECT avg((p - y) * (p - y)) AS brier_score,
            count(*) FILTER (WHERE y = 1 AND p >= cut)::double / nullif(count(*) FILTER (WHERE y = 1), 0)
                AS recall_at_top,
            count(*) FILTER (WHERE y = 1 AND p >= cut)::double / nullif(count(*) FILTER (WHERE p >= cut), 0)
                AS precision_at_top FROM sc, top),
        w AS (SELECT roc_auc::double AS roc_auc, pr_auc::double AS pr_auc, ks_statistic::double AS ks_statistic,
            brier_score::double AS brier_score, coalesce(recall_at_top, 0) AS recall_at_top,
            coalesce(precision_at_top, 0) AS precision_at_top FROM disc, k)
        SELECT metric, round(value, 6) AS point_estimate FROM (UNPIVOT w ON COLUMNS(*)
            INTO NAME metric VALUE value)""",
)
def bootstrap_points(s: Source) -> DataFrame:
    return ev.point_estimates(scores(s))


@query("permutation_null", "E23")
def permutation_null(s: Source) -> DataFrame:
    return ev.permutation_null(scores(s))


def _group_sql(name: str) -> str:
    return f"""SELECT '{name}' AS attribute, grp AS "group", n, roc_auc, pr_auc FROM
        (WITH {_rank_sql(f'{name}::varchar')} SELECT * FROM disc)"""


_SUBGROUP = f"""d AS ({_group_sql('lang')} UNION ALL {_group_sql('quality')}),
    l AS (SELECT 'lang' AS attribute, lang AS "group", y, p FROM sc
        UNION ALL SELECT 'quality', quality::varchar, y, p FROM sc),
    c AS ({_confusion_sql('l', '0.6', 'attribute, "group"')}),
    b AS (SELECT attribute, "group", avg(y::double) AS prevalence,
        avg((p - y) * (p - y)) AS brier_score FROM l GROUP BY 1, 2),
    f AS (SELECT d.*, prevalence, brier_score,
        coalesce(true_positive::double / nullif(true_positive + false_negative, 0), 0)
            AS true_positive_rate,
        1 - coalesce(true_negative::double / nullif(true_negative + false_positive, 0), 0)
            AS false_positive_rate,
        coalesce(true_positive::double / nullif(n_flagged, 0), 0) AS precision,
        n_flagged::double / n_total AS selection_rate
        FROM d JOIN c USING (attribute, "group") JOIN b USING (attribute, "group"))"""


@query(
    "subgroup_metrics",
    "E16",
    f"""WITH {_SUBGROUP} SELECT attribute, "group", n, {TIER.format(n='n')}
        AS sample_classification, {', '.join(f'round({c}, 6) AS {c}' for c in ('prevalence',
        'roc_auc', 'pr_auc', 'brier_score', 'true_positive_rate', 'false_positive_rate',
        'precision', 'selection_rate'))} FROM f""",
)
def subgroup_metrics(s: Source) -> DataFrame:
    return ev.subgroup_metrics(scores(s), ["lang", "quality"], 0.6)


cte(
    "osc",
    """SELECT o_orderkey AS id, (o_orderstatus = 'F')::int AS y, year(o_orderdate) AS quality,
    o_totalprice / (o_totalprice + 150000.0::double) AS p, o_orderpriority AS lang FROM orders""",
)


def order_scores(s: Source) -> DataFrame:
    """A larger population with groups of adequate size: orders by priority and year."""
    return s.raw("orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") / (F.col("o_totalprice") + 150000.0)).alias("p"),
        F.col("o_orderpriority").alias("lang"), F.year("o_orderdate").alias("quality"))


@query(
    "group_gaps",
    "E17 O6",
    f"""WITH {_SUBGROUP.replace("FROM sc", "FROM osc")},
        t AS (SELECT attribute, "group", n, metric, value FROM (UNPIVOT (SELECT attribute, "group",
            n, true_positive_rate, false_positive_rate, precision, selection_rate, roc_auc FROM f)
            ON true_positive_rate, false_positive_rate, precision, selection_rate, roc_auc
            INTO NAME metric VALUE value) WHERE n >= 30),
        g AS (SELECT attribute, metric, max(value) FILTER (WHERE n >= 100) - min(value)
            FILTER (WHERE n >= 100) AS gap, CASE WHEN count(*) >= 2 THEN max(value) - min(value)
            END AS wide, arg_max("group", (n, "group")) FILTER (WHERE n >= 100) AS ref,
            arg_max(value, (n, "group")) FILTER (WHERE n >= 100) AS rv FROM t GROUP BY 1, 2
            HAVING count(*) FILTER (WHERE n >= 100) >= 2)
        SELECT t.attribute, t.metric, t."group", ref AS reference_group,
            round(gap, 6) AS absolute_gap, round(value - rv, 6) + 0.0 AS reference_gap,
            round(wide, 6) AS gap_including_limited
        FROM t JOIN g ON t.attribute = g.attribute AND t.metric = g.metric WHERE n >= 100""",
)
def group_gaps(s: Source) -> DataFrame:
    return ev.group_gaps(ev.subgroup_metrics(order_scores(s), ["lang", "quality"], 0.6))


@query(
    "metric_agreement",
    "E18",
    f"""WITH {_rank_sql()} SELECT metric, round(a, 6) AS original, round(b, 6) AS recomputed,
        round(abs(a - b), 6) AS difference, abs(a - b) <= 0.001 AS within_tolerance FROM (
        SELECT 'roc_auc' AS metric, (SELECT roc_auc FROM disc) AS a, (SELECT (count(*) FILTER
            (WHERE x.p > z.p) + 0.5::double * count(*) FILTER (WHERE x.p = z.p)) / count(*)
            FROM sc x, sc z WHERE x.y = 1 AND z.y = 0) AS b
        UNION ALL SELECT 'brier_score', avg((p - y) * (p - y)), avg(y::double) FROM sc)""",
)
def metric_agreement(s: Source) -> DataFrame:
    df = scores(s)
    original = ev.discrimination(df).select(F.lit("roc_auc").alias("metric"),
                                            F.col("roc_auc").alias("value")).unionByName(
        ev.calibration_errors(df).select(F.lit("brier_score").alias("metric"),
                                         F.col("brier_score").alias("value")))
    # AUC again, from average ranks of the rows; and a figure that must not agree.
    ranked = average_ranks(df, [], "p", "rk").agg(
        F.sum(F.when(F.col("y") == 1, F.col("rk"))).alias("rs"),
        F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    auc = (F.col("rs") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))
    again = ranked.select(F.lit("roc_auc").alias("metric"), auc.alias("value")).unionByName(
        ev.calibration_errors(df).select(F.lit("brier_score").alias("metric"),
                                         F.col("prevalence").alias("value")))
    return ev.compare_metrics(original, again, 0.001)


# --- drift -----------------------------------------------------------------------------

FEATURES = ("quantity", "price", "discount")
cte(
    "lf",
    """SELECT year(l_shipdate) AS yr, feature, value FROM (
    SELECT l_shipdate, 'quantity' AS feature, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_shipdate, 'price', l_extendedprice / 1000 FROM lineitem
    UNION ALL SELECT l_shipdate, 'discount', l_discount FROM lineitem)""",
)
cte("rf", "SELECT feature, value FROM lf WHERE yr = 1996")
cte("bf", "SELECT cast(yr AS varchar) AS batch, feature, value FROM lf WHERE yr <> 1996")
cte("ed", "SELECT feature, min(value) AS lo, max(value) AS hi FROM rf GROUP BY 1")
cte(
    "hr",
    """SELECT feature, bin, count(*) AS n FROM (SELECT r.feature,
    least(floor((value - lo) / ((hi - lo) / 20)) + 1, 20) AS bin
    FROM rf r JOIN ed ON r.feature = ed.feature) GROUP BY 1, 2""",
)
cte(
    "hb",
    """SELECT batch, feature, bin, count(*) AS n FROM (SELECT batch, r.feature,
    least(floor((least(greatest(value, lo), hi) - lo) / ((hi - lo) / 20)) + 1, 20) AS bin
    FROM bf r JOIN ed ON r.feature = ed.feature) GROUP BY 1, 2, 3""",
)
cte(
    "dv",
    """SELECT batch, feature, sum((greatest(b, 1e-6) - greatest(r, 1e-6))
        * ln(greatest(b, 1e-6) / greatest(r, 1e-6))) AS psi,
    sum((CASE WHEN b > 0 THEN b * log2(b / ((b + r) / 2)) ELSE 0 END
        + CASE WHEN r > 0 THEN r * log2(r / ((b + r) / 2)) ELSE 0 END) / 2) AS js
FROM (SELECT g.batch, g.feature, k.bin, coalesce(hb.n, 0) / tb::double AS b,
        coalesce(hr.n, 0) / tr::double AS r
    FROM (SELECT batch, feature, sum(n) AS tb FROM hb GROUP BY 1, 2) g
    JOIN (SELECT feature, sum(n) AS tr FROM hr GROUP BY 1) t ON t.feature = g.feature
    CROSS JOIN generate_series(1, 20) AS k(bin)
    LEFT JOIN hb ON hb.batch = g.batch AND hb.feature = g.feature AND hb.bin = k.bin
    LEFT JOIN hr ON hr.feature = g.feature AND hr.bin = k.bin) GROUP BY 1, 2""",
)
cte(
    "ds",
    """SELECT batch, feature, max(abs(f - g)) AS ks, sum(abs(f - g) * coalesce(nx - value, 0)) AS w
FROM (SELECT batch, feature, value, sum(rc) OVER o / sum(rc) OVER a AS f,
        sum(bc) OVER o / sum(bc) OVER a AS g, lead(value) OVER o AS nx
    FROM (SELECT batch, feature, value, sum(rc)::double AS rc, sum(bc)::double AS bc FROM (
        SELECT batch, feature, value, 0 AS rc, count(*) AS bc FROM bf GROUP BY 1, 2, 3
        UNION ALL SELECT b.batch, r.feature, r.value, r.n, 0 FROM
            (SELECT feature, value, count(*) AS n FROM rf GROUP BY 1, 2) r
            JOIN (SELECT DISTINCT batch, feature FROM bf) b ON b.feature = r.feature)
        GROUP BY 1, 2, 3)
    WINDOW o AS (PARTITION BY batch, feature ORDER BY value),
        a AS (PARTITION BY batch, feature)) GROUP BY 1, 2""",
)


def batches(s: Source) -> tuple[DataFrame, DataFrame]:
    li = s.raw("lineitem").select(
        F.year("l_shipdate").alias("yr"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_discount").alias("discount"),
    )
    long = drift.long_features(li, FEATURES, ["yr"])
    return (
        long.filter(F.col("yr") == 1996).drop("yr"),
        long.filter(F.col("yr") != 1996).select(
            F.col("yr").cast("string").alias("batch"), "feature", "value"),
    )


_Q = drift.FEATURE_QUANTILES


@query(
    "reference_statistics",
    "D1 A12 A14",
    f"""SELECT feature, count(*) AS n, round(avg(value), 6) AS mean,
        round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min,
        round(max(value), 6) AS max, 0.0::double AS missingness,
        {', '.join(f'round(quantile_cont(value, {p}::double), 6) AS {n}' for n, p in _Q.items())},
        round(median(value), 6) AS median FROM rf GROUP BY 1""",
)
def reference_statistics(s: Source) -> DataFrame:
    return drift.reference_statistics(batches(s)[0])


@query(
    "reference_histogram",
    "D1 A15",
    "SELECT feature, cast(bin AS integer) AS bin, n FROM hr",
)
def reference_histogram(s: Source) -> DataFrame:
    ref = batches(s)[0]
    return drift.histogram(ref, drift.edges_of(ref), [])


@query(
    "feature_drift",
    "D2 D3 D4 D5 D6",
    f"""WITH st AS (SELECT batch, feature, count(*) AS n, avg(value) AS m, median(value) AS md,
            var_pop(value) AS v, {', '.join(f'quantile_cont(value, {p}::double) AS {n}'
            for n, p in _Q.items())} FROM (SELECT * FROM bf
            UNION ALL SELECT 'ref', feature, value FROM rf) GROUP BY 1, 2)
        SELECT b.batch, b.feature, r.n AS n_reference, b.n AS n_batch,
            round(b.m - r.m, 6) + 0.0 AS mean_shift, round(b.md - r.md, 6) + 0.0 AS median_shift,
            round(b.v - r.v, 6) + 0.0 AS variance_shift, 0.0::double AS missingness_delta,
            {', '.join(f'round(b.{n} - r.{n}, 6) + 0.0 AS {n}_shift' for n in _Q)},
            round(psi, 6) + 0.0 AS psi, round(js, 6) + 0.0 AS jensen_shannon_divergence,
            round(ks, 6) AS ks_statistic, round(w, 6) AS wasserstein_distance
        FROM st b JOIN st r ON b.feature = r.feature AND r.batch = 'ref'
        JOIN dv ON dv.batch = b.batch AND dv.feature = b.feature
        JOIN ds ON ds.batch = b.batch AND ds.feature = b.feature WHERE b.batch <> 'ref'""",
)
def feature_drift(s: Source) -> DataFrame:
    ref, new = batches(s)
    return drift.feature_drift(ref, new)


def score_batches(s: Source) -> tuple[DataFrame, DataFrame]:
    """Reference: validation part; batches: the test part by language."""
    df = scores(s)
    return (df.filter(F.col("part") == "validation"),
            df.filter(F.col("part") == "test").withColumn("batch", F.col("lang")))


_BAND = ("CASE WHEN p <= 0.1 THEN 'low' WHEN p <= 0.25 THEN 'medium' WHEN p <= 0.5 THEN 'high' "
         "ELSE 'very_high' END")
_SQ = drift.SCORE_QUANTILES
_BANDS = ("low", "medium", "high", "very_high")


@query(
    "score_drift",
    "D7 F10",
    f"""WITH s AS (SELECT CASE WHEN part = 'test' THEN lang ELSE 'ref' END AS batch, p,
            {_BAND} AS band FROM sc),
        e AS (SELECT min(p) AS lo, max(p) AS hi FROM s WHERE batch = 'ref'),
        h AS (SELECT batch, least(floor((least(greatest(p, lo), hi) - lo) / ((hi - lo) / 20)) + 1,
            20) AS bin, count(*) AS n FROM s, e GROUP BY 1, 2),
        t AS (SELECT batch, sum(n)::double AS t FROM h GROUP BY 1),
        g AS (SELECT b.batch, k.bin, greatest(coalesce(x.n, 0) / b.t, 1e-6) AS b,
            greatest(coalesce(z.n, 0) / r.t, 1e-6) AS r FROM t b
            JOIN t r ON r.batch = 'ref' AND b.batch <> 'ref'
            CROSS JOIN generate_series(1, 20) AS k(bin)
            LEFT JOIN h x ON x.batch = b.batch AND x.bin = k.bin
            LEFT JOIN h z ON z.batch = 'ref' AND z.bin = k.bin),
        i AS (SELECT batch, sum((b - r) * ln(b / r)) AS psi FROM g GROUP BY 1),
        a AS (SELECT batch, count(*) AS n, avg(p) AS m, avg((p >= 0.8)::int::double) AS top,
            {', '.join(f"avg((band = '{b}')::int::double) AS {b}" for b in _BANDS)},
            {', '.join(f'quantile_cont(p, {p}::double) AS {n}' for n, p in _SQ.items())}
            FROM s GROUP BY 1)
        SELECT b.batch, r.n AS n_reference, b.n AS n_batch, round(b.m - r.m, 6) + 0.0
            AS mean_shift, round(b.top, 6) AS share_above_cut,
            round(r.top, 6) AS reference_above_cut,
            {', '.join(f'round(b.{x}, 6) AS share_{x}' for x in _BANDS)},
            {', '.join(f'round(b.{x} - r.{x}, 6) + 0.0 AS shift_{x}' for x in _BANDS)},
            round(psi, 6) AS score_psi,
            {', '.join(f'round(b.{n} - r.{n}, 6) + 0.0 AS {n}_shift' for n in _SQ)}
        FROM a b JOIN a r ON r.batch = 'ref' AND b.batch <> 'ref' JOIN i ON i.batch = b.batch""",
)
def score_drift(s: Source) -> DataFrame:
    ref, new = score_batches(s)
    return drift.score_drift(ref, new, risk_band("p"), 0.8)


@query(
    "rank_stability",
    "D8 W8",
    """WITH r AS (SELECT batch, rank() OVER (PARTITION BY batch ORDER BY value) + (count(*) OVER
            (PARTITION BY batch, value) - 1) / 2.0::double AS a, rank() OVER (PARTITION BY batch
            ORDER BY k) + (count(*) OVER (PARTITION BY batch, k) - 1) / 2.0::double AS b
            FROM (SELECT event_type AS batch, value,
            cast(json_extract_string(props, '$.k') AS double) AS k FROM events))
        SELECT batch, round(corr(a, b), 6) + 0.0 AS rank_stability FROM r GROUP BY 1""",
)
def rank_stability(s: Source) -> DataFrame:
    e = s.raw("events").select(
        F.col("event_type").alias("batch"), "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"))
    return drift.rank_stability(e, "value", "k", ["batch"])


@query(
    "performance_drift",
    "D9 D11",
    f"""WITH {_rank_sql("CASE WHEN part = 'test' THEN lang ELSE 'ref' END")},
        b AS (SELECT CASE WHEN part = 'test' THEN lang ELSE 'ref' END AS grp,
            avg((p - y) * (p - y)) AS brier, avg(y::double) AS rate FROM sc GROUP BY 1),
        x AS (SELECT disc.*, brier, rate FROM disc JOIN b ON disc.grp = b.grp)
        SELECT x.grp AS batch, {', '.join(f'round(x.{c} - r.{c}, 6) + 0.0 AS {c}_delta'
        for c in ('roc_auc', 'pr_auc', 'ks_statistic'))},
            round(x.brier - r.brier, 6) + 0.0 AS brier_delta,
            round(x.rate, 6) AS event_rate, round(abs(x.rate - r.rate), 6) AS event_rate_delta
        FROM x JOIN x r ON r.grp = 'ref' WHERE x.grp <> 'ref'""",
)
def performance_drift(s: Source) -> DataFrame:
    ref, new = score_batches(s)
    names = ("roc_auc", "pr_auc", "ks_statistic", "brier_score")
    now = ev.discrimination(new, ["batch"]).join(ev.calibration_errors(new, ["batch"]), "batch")
    then = ev._join(ev.discrimination(ref), ev.calibration_errors(ref), [])
    base = then.select(*[F.col(n).alias(f"r_{n}") for n in (*names, "prevalence")])
    rate = ev._join(now, base, [])
    return rate.select(
        "batch",
        *[(F.col(n) - F.col(f"r_{n}")).alias(f"{n.replace('_score', '')}_delta") for n in names],
        F.col("prevalence").alias("event_rate"),
        F.abs(F.col("prevalence") - F.col("r_prevalence")).alias("event_rate_delta"),
    )


_MONITOR = """c AS (SELECT batch, attribute, "group", count(*) AS n,
        avg((p >= 0.6)::int::double) AS sr, avg(p) AS m, count(*) FILTER (WHERE p >= 0.6 AND y = 1)
        ::double / nullif(count(*) FILTER (WHERE y = 1), 0) AS rec FROM (
        SELECT CASE WHEN part = 'test' THEN lang ELSE 'ref' END AS batch, 'source' AS attribute,
            source AS "group", y, p FROM sc
        UNION ALL SELECT CASE WHEN part = 'test' THEN lang ELSE 'ref' END, 'lang', lang, y, p
            FROM sc) GROUP BY 1, 2, 3),
    t AS (SELECT batch, attribute, sum(n)::double AS t FROM c GROUP BY 1, 2),
    sh AS (SELECT c.*, n / t AS share FROM c JOIN t ON c.batch = t.batch
        AND c.attribute = t.attribute),
    mo AS (SELECT a.*, coalesce(r.share, 0.0) AS rs FROM sh a LEFT JOIN sh r ON r.batch = 'ref'
        AND r.attribute = a.attribute AND r."group" = a."group" WHERE a.batch <> 'ref')"""


@query(
    "subgroup_monitoring",
    "D10",
    f"""WITH {_MONITOR} SELECT batch, attribute, "group", n, {TIER.format(n='n')}
        AS sample_classification, round(share, 6) AS composition_share,
        round(rs, 6) AS reference_share, round(share - rs, 6) + 0.0 AS composition_shift,
        round(sr, 6) AS selection_rate, round(m, 6) AS mean_score, round(rec, 6) AS recall
        FROM mo""",
)
def subgroup_monitoring(s: Source) -> DataFrame:
    ref, new = score_batches(s)
    return drift.subgroup_monitoring(ref, new, ["source", "lang"], 0.6)


@query(
    "max_composition_shift",
    "D12",
    f"WITH {_MONITOR} SELECT batch, round(max(abs(share - rs)), 6) AS max_composition_shift "
    "FROM mo GROUP BY 1",
)
def max_composition_shift(s: Source) -> DataFrame:
    ref, new = score_batches(s)
    return drift.max_composition_shift(
        drift.subgroup_monitoring(ref, new, ["source", "lang"], 0.6))


@query(
    "exact_quantiles",
    "A12 A13",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05::double), 6) AS q05,
        round(quantile_cont(l_extendedprice, 0.5::double), 6) AS q50,
        round(quantile_cont(l_extendedprice, 0.95::double), 6) AS q95
        FROM lineitem GROUP BY 1""",
)
def quantiles(s: Source) -> DataFrame:
    return exact_quantiles(s.raw("lineitem"), ["l_returnflag"], "l_extendedprice",
                           {"q05": 0.05, "q50": 0.5, "q95": 0.95})
