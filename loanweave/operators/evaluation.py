"""Evaluation of scores against outcomes, for one population or for many at once.

Input rows carry y (0/1) and p (score). `by` names the columns that separate populations
(model, batch, group, replicate). Rank statistics work on counts per distinct score and
running totals; a population of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.functions.buckets import TIERS, sample_tier
from loanweave.functions.numeric import clipped_probability, logit, row_sum
from loanweave.operators.count_draws import draw_counts
from loanweave.operators.replicates import uniform, with_replicates
from loanweave.operators.scan import Scan, decile, exact_quantiles, positions, scan
from loanweave.session import settle


def _div(n: Column, d: Column) -> Column:
    """Ratio that is 0 when the denominator is 0."""
    return F.when(d > 0, n.cast("double") / d).otherwise(0.0)


def _on(keys: Sequence[str]) -> list[str]:
    return list(keys)


def with_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of `a` with the columns of `b`, a table of one row that every task may have;
    NULLs if it has none."""
    row = F.broadcast(b.limit(1).select(F.lit(1).alias("_one"), F.struct("*").alias("_row")))
    keyed = a.withColumn("_one", F.lit(1)).join(row, "_one", "left")
    return keyed.select(*a.columns, *[F.col("_row")[c].alias(c) for c in b.columns])


def _join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join of per-population tables; without `by`, `b` has one row."""
    return a.join(b, _on(by)) if by else with_one_row(a, b)


def score_counts(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None
                 ) -> DataFrame:
    """Positives and negatives per distinct score."""
    w = weight if weight is not None else F.lit(1).cast("bigint")
    y = F.col("y") == 1
    zero = F.lit(0).cast("bigint")
    return df.groupBy(*by, "p").agg(
        F.sum(F.when(y, w).otherwise(zero)).alias("pos"),
        F.sum(F.when(~y, w).otherwise(zero)).alias("neg"),
    )


def _ranked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return scan(
        counts, by, "p",
        Scan(sums={"cpos": "pos", "cneg": "neg"}, totals={"tpos": "pos", "tneg": "neg"}),
    )


def discrimination(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return discrimination_of_counts(score_counts(df, by), by)


def discrimination_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with tied ranks, average precision with tied scores taken together, and KS.

    They are NULL for a population with one class only.
    """
    c = F.col
    at_or_above = c("tpos") - c("cpos") + c("pos")
    false_above = c("tneg") - c("cneg") + c("neg")
    both = (F.max("tpos") > 0) & (F.max("tneg") > 0)
    # Ratios per row keep the sums in a safe range for very large populations.
    auc = F.sum(
        (c("pos") / c("tpos")) * ((c("cneg") - c("neg") + c("neg") / 2.0) / c("tneg"))
    )
    ap = F.sum((c("pos") / c("tpos")) * (at_or_above / (at_or_above + false_above)))
    ks = F.max(F.abs(c("cpos") / c("tpos") - c("cneg") / c("tneg")))
    ranked = _ranked(counts.filter(c("pos") + c("neg") > 0), by)
    safe = ranked.withColumns(
        {t: F.when(c(t) > 0, c(t).cast("double")) for t in ("tpos", "tneg")}
    )
    return safe.groupBy(*by).agg(
        F.sum(c("pos") + c("neg")).alias("n"),
        F.sum("pos").alias("n_positive"),
        F.when(both, auc).alias("roc_auc"),
        F.when(both, ap).alias("pr_auc"),
        F.when(both, ks).alias("ks_statistic"),
    )


def calibration_errors(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    y = F.col("y").cast("double")
    q = clipped_probability("p")
    return df.groupBy(*by).agg(
        F.avg(y).alias("prevalence"),
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier_score"),
        (-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
    )


def calibration_line(df: DataFrame, by: Sequence[str] = (), steps: int = 12) -> DataFrame:
    """Intercept and slope of y on logit(p): unpenalised fit by Newton steps.

    Each step is an aggregate over score counts; parameters stay in a table with one row
    per population.
    """
    c = F.col
    counts = score_counts(df, by).withColumn("x", logit("p"))
    # Start at the model without a slope, from which the steps do not overshoot.
    rate = F.sum("pos") / F.sum(c("pos") + c("neg"))
    params = counts.groupBy(*by).agg(logit(rate).alias("a"), F.lit(0.0).alias("b"))
    for _ in range(steps):
        z = c("a") + c("b") * c("x")
        mu = 1 / (1 + F.exp(-z))
        n = c("pos") + c("neg")
        gap = c("pos") - n * mu
        h = n * mu * (1 - mu)
        sums = _join(counts, params, by).groupBy(*by).agg(
            F.max("a").alias("a"), F.max("b").alias("b"),
            F.sum(gap).alias("g0"), F.sum(gap * c("x")).alias("g1"),
            F.sum(h).alias("h0"), F.sum(h * c("x")).alias("h1"),
            F.sum(h * c("x") * c("x")).alias("h2"),
        )
        det = c("h0") * c("h2") - c("h1") * c("h1")
        good = F.abs(det) > 1e-12
        params = sums.select(
            *by,
            F.when(good, c("a") + (c("h2") * c("g0") - c("h1") * c("g1")) / det)
            .otherwise(c("a")).alias("a"),
            F.when(good, c("b") + (c("h0") * c("g1") - c("h1") * c("g0")) / det)
            .otherwise(c("b")).alias("b"),
        )
    return params.select(*by, c("a").alias("calibration_intercept"),
                         c("b").alias("calibration_slope"))


def _ece_of_bins(binned: DataFrame, by: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    per = binned.groupBy(*by, *extra, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"),
        F.sum(F.col("y").cast("double")).alias("sy"),
    )
    return per.groupBy(*by, *extra).agg(
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece")
    )


def width_bin(p: Column, bins: int) -> Column:
    """0-based equal-width bin on [0, 1]; each edge belongs to the upper bin."""
    inner = [F.when(p >= i * (1.0 / bins), 1).otherwise(0) for i in range(1, bins)]
    return row_sum(inner)


def ece_equal_width(df: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    return _ece_of_bins(df.withColumn("bin", width_bin(F.col("p"), bins)), by)


def ece_equal_mass(df: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Bins between exact quantiles; equal quantiles merge, the last bin is closed."""
    names = {f"_q{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, by, "p", names)
    joined = _join(df, edges, by)
    # Distinct inner edges at or below p; an edge equal to the first or last one cuts nothing.
    cuts = []
    for i in range(1, bins):
        e, before = F.col(f"_q{i}"), F.col(f"_q{i - 1}")
        cuts.append(F.when((e > before) & (e < F.col(f"_q{bins}")) & (F.col("p") >= e), 1)
                    .otherwise(0))
    return _ece_of_bins(joined.withColumn("bin", row_sum(cuts)).drop(*names), by)


def ece_bin_sensitivity(df: DataFrame, by: Sequence[str] = (),
                        bin_counts: Sequence[int] = (5, 10, 20)) -> DataFrame:
    parts = []
    for strategy, fn in (("equal_width", ece_equal_width), ("equal_mass", ece_equal_mass)):
        parts += [
            fn(df, by, b).select(*by, F.lit(strategy).alias("strategy"),
                                 F.lit(b).alias("n_bins"), "ece")
            for b in bin_counts
        ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- thresholds ------------------------------------------------------------------------


def confusion_columns(threshold: Column) -> dict[str, Column]:
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    return {
        "n_total": F.count(F.lit(1)),
        "n_flagged": F.count_if(hit),
        "true_positive": F.count_if(hit & y),
        "false_positive": F.count_if(hit & ~y),
        "true_negative": F.count_if(~hit & ~y),
        "false_negative": F.count_if(~hit & y),
    }


def confusion_rates(counts: DataFrame) -> DataFrame:
    c = F.col
    out = counts.select(
        "*",
        _div(c("true_positive"), c("n_flagged")).alias("precision"),
        _div(c("true_positive"), c("true_positive") + c("false_negative")).alias("recall"),
        _div(c("true_negative"), c("true_negative") + c("false_positive")).alias("specificity"),
        _div(c("n_flagged"), c("n_total")).alias("selection_rate"),
    )
    pr = c("precision") + c("recall")
    return out.select(
        "*",
        _div(2 * c("precision") * c("recall"), pr).alias("f1"),
        ((c("recall") + c("specificity")) / 2).alias("balanced_accuracy"),
    )


def confusion(df: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates with p >= threshold flagged; 0 where a rate is undefined."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    agg = [c.alias(n) for n, c in confusion_columns(t).items()]
    return confusion_rates(df.groupBy(*by).agg(*agg))


def share_threshold(df: DataFrame, share: float, by: Sequence[str] = ()) -> DataFrame:
    """Two cut scores for the top `share`: interpolated quantile and sorted-index lookup."""
    linear = exact_quantiles(df, by, "p", {"threshold": 1.0 - share})
    placed = scan(
        df.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("_n")), by, "p",
        Scan(sums={"_upto": "_n"}, totals={"_all": "_n"}),
    )
    wanted = F.bround(F.lit(share) * F.col("_all"), 0) - 1
    from_top = F.greatest(F.lit(0.0), F.least(F.col("_all") - 1.0, wanted))
    index = F.col("_all") - 1 - from_top
    here = (index >= F.col("_upto") - F.col("_n")) & (index < F.col("_upto"))
    lookup = placed.groupBy(*by).agg(F.max(F.when(here, F.col("p"))).alias("index_threshold"))
    return _join(linear, lookup, by)


def recall_threshold(df: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Score whose recall is nearest the target; of equally near ones the highest."""
    ranked = _ranked(score_counts(df, by), by)
    recall = (F.col("tpos") - F.col("cpos") + F.col("pos")) / F.col("tpos").cast("double")
    near = ranked.filter(F.col("tpos") > 0).select(
        *by, "p", F.round(F.abs(recall - target), 12).alias("gap"), recall.alias("recall")
    )
    best = near.groupBy(*by).agg(
        F.min_by(F.struct("p", "recall"), F.struct("gap", -F.col("p"))).alias("b")
    )
    return best.select(*by, F.col("b.p").alias("threshold"), F.col("b.recall").alias("recall"))


def operating_points(validation: DataFrame, test: DataFrame,
                     points: Sequence[tuple[str, str, float]]) -> DataFrame:
    """(name, kind, target): cut on the validation scores, measured on the test scores.

    The handful of configured cuts comes to the driver; the test scores are read once.
    """
    rows = []
    for name, kind, target in points:
        if kind == "population_share":
            found = share_threshold(validation, target)
        elif kind == "recall":
            found = recall_threshold(validation, target)
        else:
            raise ValueError(f"unknown operating point type {kind!r}")
        rows.append((name, kind, float(target), float(found.first()["threshold"])))
    wide = test.agg(
        *[
            F.struct(*[c.alias(n) for n, c in confusion_columns(F.lit(t)).items()]).alias(name)
            for name, _, _, t in rows
        ]
    )
    tidy = wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"),
                             F.lit(target).alias("target"), F.lit(t).alias("threshold"),
                             F.col(f"`{name}`").alias("m"))
                    for name, kind, target, t in rows
                ]
            )
        ).alias("r")
    ).select("r.name", "r.type", "r.target", "r.threshold", "r.m.*")
    return confusion_rates(tidy)


def threshold_stability(df: DataFrame, share: float, ident: str, trials: int = 5,
                        fraction: float = 0.9, seed: int = 7) -> DataFrame:
    """Share threshold on hash-selected subsamples."""
    copies = with_replicates(df, trials, "trial")
    kept = copies.filter(uniform(F.col("trial"), F.col(ident), seed) < fraction)
    return share_threshold(kept, share, ["trial"])


# --- tables ----------------------------------------------------------------------------


def decile_table(df: DataFrame, ident: str, by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Bands from the highest score down with lift and cumulative capture; ties by id."""
    placed = positions(df.select(*by, ident, "y", "p"), by, "p", ident, "_pos", "_size",
                       descending=True)
    bands = placed.groupBy(*by, decile(F.col("_pos"), F.col("_size"), n).alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("bigint")).alias("n_positive")
    )
    # Ten rows per population from here on.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    upto = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    all_n, all_pos = F.sum("n").over(whole), F.sum("n_positive").over(whole)
    rate = _div(F.col("n_positive"), F.col("n"))
    return bands.select(
        *by, "decile", "n", "n_positive",
        rate.alias("event_rate"),
        _div(rate, _div(all_pos, all_n)).alias("lift"),
        _div(F.col("n_positive"), all_pos).alias("capture_rate"),
        _div(F.sum("n_positive").over(upto), all_pos).alias("cumulative_capture_rate"),
        _div(F.sum("n").over(upto), all_n).alias("cumulative_population_share"),
    )


METRICS = ("prevalence", "roc_auc", "pr_auc", "ks_statistic", "brier_score", "log_loss",
           "calibration_intercept", "calibration_slope", "ece", "precision", "recall",
           "specificity", "f1", "balanced_accuracy")


def all_metrics(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Every metric as (by, metric, value) rows."""
    parts = [
        discrimination(df, by), calibration_errors(df, by), calibration_line(df, by),
        ece_equal_width(df, by), confusion(df, threshold, by),
    ]
    wide = reduce(lambda a, b: _join(a, b, by), parts)
    return wide.select(*by, *METRICS).unpivot(_on(by), list(METRICS), "metric", "value")


def compare_metrics(original: DataFrame, recomputed: DataFrame, tolerance: float,
                    keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Original against recomputed values with a verdict; a missing side fails."""
    a = original.select(*keys, F.col("value").alias("original"))
    b = recomputed.select(*keys, F.col("value").alias("recomputed"))
    gap = F.abs(F.col("original") - F.col("recomputed"))
    return a.join(b, _on(keys), "full_outer").select(
        "*", gap.alias("difference"),
        F.coalesce(gap <= tolerance, F.col("original").isNull() & F.col("recomputed").isNull()
                   & F.lit(False)).alias("within_tolerance"),
    )


# --- groups ----------------------------------------------------------------------------


def subgroup_metrics(df: DataFrame, attributes: Sequence[str], threshold: float) -> DataFrame:
    """Metrics per attribute and group; one threshold for all."""
    long = df.select(
        "y", "p",
        F.explode(F.array(*[
            F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group"))
            for a in attributes
        ])).alias("g"),
    ).select("g.attribute", "g.group", "y", "p").filter(F.col("group").isNotNull())
    by = ["attribute", "group"]
    out = _join(_join(discrimination(long, by), calibration_errors(long, by), by),
                confusion(long, threshold, by), by)
    return out.select(
        *by, "n", sample_tier("n").alias("sample_classification"), "prevalence", "roc_auc",
        "pr_auc", "brier_score", F.col("recall").alias("true_positive_rate"),
        (1 - F.col("specificity")).alias("false_positive_rate"), "precision", "selection_rate",
    )


GAP_METRICS = ("true_positive_rate", "false_positive_rate", "precision", "selection_rate",
               "roc_auc")


def group_gaps(metrics: DataFrame, names: Sequence[str] = GAP_METRICS) -> DataFrame:
    """Spread over adequate groups and each one's distance to the largest of them.

    Limited groups only enter the spread that says so; insufficient ones never do.
    """
    tidy = metrics.select(
        "attribute", "group", "n", "sample_classification",
        *[F.col(m).cast("double").alias(m) for m in names],
    ).unpivot(["attribute", "group", "n", "sample_classification"], list(names), "metric",
              "value")
    usable = tidy.filter(
        (F.col("sample_classification") != TIERS[0]) & F.col("value").isNotNull()
    )
    full = F.col("sample_classification") == TIERS[2]
    v = F.col("value")
    spread = usable.groupBy("attribute", "metric").agg(
        F.count_if(full).alias("groups"),
        F.max(F.when(full, v)).alias("hi"), F.min(F.when(full, v)).alias("lo"),
        F.count(F.lit(1)).alias("all_groups"),
        F.max(v).alias("all_hi"), F.min(v).alias("all_lo"),
        F.max_by(F.struct("group", "value"), F.when(full, F.struct("n", "group"))).alias("ref"),
    ).filter(F.col("groups") >= 2)
    return usable.filter(full).join(spread, ["attribute", "metric"]).select(
        "attribute", "metric", "group",
        F.col("ref.group").alias("reference_group"),
        (F.col("hi") - F.col("lo")).alias("absolute_gap"),
        (v - F.col("ref.value")).alias("reference_gap"),
        F.when(F.col("all_groups") >= 2, F.col("all_hi") - F.col("all_lo"))
        .alias("gap_including_limited"),
    )


# --- uncertainty -----------------------------------------------------------------------


def resampled(counts: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """by, replicate, p, pos, neg: as many draws with replacement from each class as it has rows."""
    c = F.col
    classes = counts.select(*by, "p", F.explode(F.array(*[
        F.struct(F.lit(n).alias("class"), c(n).alias("n")) for n in ("pos", "neg")])).alias("e"))
    drawn = draw_counts(classes.select(*by, "p", "e.class", "e.n"), [*by, "class"], "p", "n", c("all"),
                        replicates, seed, replace=True)
    zero = F.lit(0).cast("bigint")
    return drawn.groupBy(*by, "replicate", "p").agg(
        *[F.sum(F.when(c("class") == n, c("k")).otherwise(zero)).alias(n) for n in ("pos", "neg")])


BOOTSTRAP_METRICS = ("roc_auc", "pr_auc", "brier_score", "ks_statistic", "recall_at_top", "precision_at_top")


def metrics_of_counts(counts: DataFrame, cuts: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys and BOOTSTRAP_METRICS of score counts; `cuts` has by and the cut `threshold`."""
    c = F.col
    n = F.sum(c("pos") + c("neg"))
    high = c("p") >= c("threshold")
    hit = F.sum(F.when(high, c("pos")).otherwise(0))
    flagged = F.sum(F.when(high, c("pos") + c("neg")).otherwise(0))
    loss = _join(counts, cuts, by).groupBy(*keys).agg(
        (F.sum(c("pos") * (1 - c("p")) * (1 - c("p")) + c("neg") * c("p") * c("p")) / n).alias("brier_score"),
        _div(hit, F.sum("pos")).alias("recall_at_top"), _div(hit, flagged).alias("precision_at_top"),
    )
    return _join(discrimination_of_counts(counts, keys), loss, keys).select(*keys, *BOOTSTRAP_METRICS)


def top_cut(df: DataFrame, share: float, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold: the score above which the top `share` lies."""
    return share_threshold(df, share, by).select(*by, "threshold")


def point_estimates(df: DataFrame, by: Sequence[str] = (), top: float = 0.1, cuts: DataFrame | None = None
                    ) -> DataFrame:
    """by, metric, point_estimate: the metrics of `bootstrap` on the data as they are."""
    counts = settle(score_counts(df, by))
    wide = metrics_of_counts(counts, top_cut(df, top, by) if cuts is None else cuts, by, list(by))
    return wide.unpivot(list(by), list(BOOTSTRAP_METRICS), "metric", "point_estimate")


def bootstrap(df: DataFrame, replicates: int = 1000, by: Sequence[str] = (), seed: int = 11,
              percentiles: Mapping[str, float] | None = None, top: float = 0.1, cuts: DataFrame | None = None
              ) -> DataFrame:
    """Point estimates and percentile bands of AUC, AP, Brier, KS and of recall and precision in
    the top share, under resampling within each class.

    Every replicate has the class sizes of the data. The cut of the top share is fixed: taken
    from the data, or given as `cuts` (by, threshold). `failures` counts replicates without a
    value, as when a class is empty. Draws are made on score counts, so the work is distinct
    scores x replicates.
    """
    wanted = percentiles or {"p2_5": 0.025, "p50": 0.5, "p97_5": 0.975}
    by = list(by)
    cuts = settle(top_cut(df, top, by) if cuts is None else cuts)
    drawn = settle(resampled(settle(score_counts(df, by)), by, replicates, seed))
    keys = [*by, "replicate"]
    names = list(BOOTSTRAP_METRICS)
    tidy = settle(metrics_of_counts(drawn, cuts, by, keys).unpivot(keys, names, "metric", "value"))
    bands = exact_quantiles(tidy, [*by, "metric"], "value", wanted)
    spread = tidy.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.count("value").alias("replicates"),
        (F.lit(replicates) - F.count("value")).cast("bigint").alias("failures"),
    )
    real = point_estimates(df, by, top, cuts)
    return real.join(bands, [*by, "metric"], "left").join(spread, [*by, "metric"], "left")


def permutation_null(df: DataFrame, permutations: int = 999, seed: int = 13) -> DataFrame:
    """AUC of shuffled labels against the real one.

    A permutation hands the positives to rows drawn without replacement, counted per score, so
    each has exactly as many positives as the data and the work is distinct scores x permutations.
    Returns p value (k+1)/(n+1), null mean and spread, z, and distinct null values.
    """
    c = F.col
    counts = settle(score_counts(df))
    real = discrimination_of_counts(counts).select(c("roc_auc").alias("real_auc"))
    positives = counts.agg(F.sum("pos")).first()[0] or 0
    cells = counts.select("p", (c("pos") + c("neg")).alias("n"))
    chosen = draw_counts(cells, [], "p", "n", F.lit(positives), permutations, seed, replace=False, name="pos")
    drawn = with_replicates(cells, permutations).join(chosen, ["replicate", "p"], "left").select(
        "replicate", "p", F.coalesce("pos", F.lit(0)).alias("pos"),
        (c("n") - F.coalesce("pos", F.lit(0))).alias("neg"))
    null = discrimination_of_counts(drawn, ["replicate"]).select("replicate", "roc_auc")
    joined = _join(null, real, [])
    beaten = F.count_if(c("roc_auc") >= c("real_auc"))
    n = F.count("roc_auc")
    return joined.agg(
        F.max("real_auc").alias("real_auc"),
        n.alias("permutations"),
        ((beaten + 1) / (n + 1)).alias("p_value"),
        F.avg("roc_auc").alias("null_mean"),
        F.stddev_samp("roc_auc").alias("null_std"),
        ((F.avg("roc_auc") - 0.5) / (F.stddev_samp("roc_auc") / F.sqrt(n))).alias("centring_z"),
        ((F.max("roc_auc") - F.min("roc_auc")) / F.stddev_samp("roc_auc"))
        .alias("amplitude_ratio"),
        (n - F.count_distinct(F.round("roc_auc", 12))).alias("repeated_values"),
    )
