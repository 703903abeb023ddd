"""From drift measures to signals, alert groups and incidents.

Cutoffs come from what happens by chance: batches are drawn from reference histograms and
score counts (never from the rows), without replacement and of exactly the wanted size, so a
study costs bins x replicates at any data size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.functions.numeric import SHARE_FLOOR
from loanweave.operators.drift import BINS
from loanweave.operators.evaluation import discrimination_of_counts, score_counts, with_one_row
from loanweave.operators.count_draws import draw_counts
from loanweave.operators.replicates import uniform, with_replicates
from loanweave.operators.scan import Scan, exact_quantiles, scan
from loanweave.session import settle

REVIEW, MATERIAL = 0.95, 0.995
MIN_SAMPLE = 30
# States from harmless to certain.
STATES = ("insufficient_sample", "within_reference_variability", "review",
          "material_deviation", "blocked_input")
# Quality rates have no variance in a clean reference; their cutoffs are given.
QUALITY_METRICS = ("missingness_rate", "duplicate_rate", "domain_violation_rate",
                   "range_violation_rate")
QUALITY_REVIEW, QUALITY_MATERIAL = 0.01, 0.03
FAMILY_WISE = "psi_family_wise"


# --- chance distributions --------------------------------------------------------------


def _psi(b: Column, r: Column) -> Column:
    x, y = F.greatest(b, F.lit(SHARE_FLOOR)), F.greatest(r, F.lit(SHARE_FLOOR))
    return (x - y) * F.log(x / y)


def psi_null(reference_counts: DataFrame, batch_size: Column | int, replicates: int,
             seed: int = 3, bins: int = BINS, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, replicate, feature, psi) of unperturbed batches drawn from the histograms.

    A batch has exactly `batch_size` rows of a feature (all, if there are fewer), drawn without
    replacement. With `keep`, `batch_size` is an array of sizes, one kept in that column.
    """
    total = reference_counts.groupBy("feature").agg(F.sum("n").alias("total"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    shares = grid.join(reference_counts, ["feature", "bin"], "left").select(
        "feature", "bin", "total", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("r"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    size = F.lit(batch_size) if isinstance(batch_size, int) else batch_size
    if keep:
        shares = shares.withColumn(keep[0], F.explode(size))
        size = F.col(keep[0])
    shares = settle(shares)
    drawn = draw_counts(shares, [*keep, "feature"], "bin", "n", F.least(size, F.col("all")), replicates, seed,
                        replace=False)
    group = [*keep, "replicate", "feature"]
    joined = with_replicates(shares, replicates).join(drawn, [*group, "bin"], "left")
    share = F.coalesce("k", F.lit(0)) / F.least(size, F.col("total"))
    return joined.groupBy(*group).agg(F.sum(_psi(share, F.col("r"))).alias("psi"))


def _cutoffs(null: DataFrame, metric: str, value: str, batch_size: int,
             keys: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(null, keys, value, {"review_cutoff": REVIEW, "material_cutoff": MATERIAL})
    n = null.groupBy(*keys).agg(F.count(value).alias("n_resamples"))
    joined = q.join(n, list(keys)) if keys else with_one_row(q, n)
    return joined.select(
        *keys, F.lit(metric).alias("metric"), "review_cutoff", "material_cutoff", "n_resamples",
        F.lit(batch_size).alias("batch_size"), F.lit(MIN_SAMPLE).alias("min_sample"),
    )


def calibrate_psi(reference_counts: DataFrame, batch_size: int, replicates: int = 100,
                  seed: int = 3) -> DataFrame:
    """Cutoffs of a single feature's PSI: one feature picked at random per replicate."""
    null = psi_null(reference_counts, batch_size, replicates, seed)
    picked = null.groupBy("replicate").agg(
        F.min_by("psi", uniform(F.col("replicate"), F.col("feature"), seed, "pick")).alias("psi")
    )
    return _cutoffs(picked, "psi", "psi", batch_size)


def calibrate_family_wise(reference_counts: DataFrame, batch_size: int, replicates: int = 500,
                          seed: int = 5) -> DataFrame:
    """Cutoffs of the largest PSI over all features of a batch."""
    worst = psi_null(reference_counts, batch_size, replicates, seed).groupBy("replicate").agg(
        F.max("psi").alias("psi")
    )
    return _cutoffs(worst, FAMILY_WISE, "psi", batch_size)


def calibrate_scores(reference: DataFrame, batch_size: int, replicates: int = 100,
                     seed: int = 7) -> DataFrame:
    """Cutoffs of score shift, event-rate shift and AUC, AP and Brier deltas."""
    c = F.col
    counts = score_counts(reference)
    size = c("pos") + c("neg")

    def summary(df: DataFrame, keys: list[str]) -> DataFrame:
        n = F.sum(size)
        stats = df.groupBy(*keys).agg(
            (F.sum(c("p") * size) / n).alias("score"),
            (F.sum("pos") / n).alias("rate"),
            (F.sum(c("pos") * (1 - c("p")) * (1 - c("p")) + c("neg") * c("p") * c("p")) / n)
            .alias("brier"),
        )
        rank = discrimination_of_counts(df, keys).select(*keys, "roc_auc", "pr_auc")
        if keys:
            return stats.join(rank, keys)
        return with_one_row(stats, rank)

    cells = counts.select(F.explode(F.array(*[
        F.struct(F.struct(c("p").alias("p"), F.lit(i).alias("y")).alias("cell"), c(n).alias("n"))
        for i, n in enumerate(("neg", "pos"))])).alias("e")).select("e.*")
    drawn = draw_counts(cells, [], "cell", "n", F.least(F.lit(batch_size), c("all")), replicates, seed, replace=False)
    drawn = drawn.groupBy("replicate", c("cell.p").alias("p")).agg(
        *[F.sum(F.when(c("cell.y") == i, c("k")).otherwise(0)).alias(n) for i, n in enumerate(("neg", "pos"))])
    drawn = settle(drawn)
    names = {"score_mean_shift": "score", "event_rate_delta": "rate", "brier_delta": "brier",
             "roc_auc_delta": "roc_auc", "pr_auc_delta": "pr_auc"}
    real = summary(counts, []).select(*[c(v).alias(f"r_{v}") for v in names.values()])
    gaps = with_one_row(summary(drawn, ["replicate"]), real).select(
        "replicate", *[F.abs(c(v) - c(f"r_{v}")).alias(n) for n, v in names.items()]
    )
    tidy = gaps.unpivot(["replicate"], list(names), "metric", "value")
    q = exact_quantiles(tidy, ["metric"], "value",
                        {"review_cutoff": REVIEW, "material_cutoff": MATERIAL})
    n = tidy.groupBy("metric").agg(F.count("value").alias("n_resamples"))
    return q.join(n, "metric").select(
        "metric", "review_cutoff", "material_cutoff", "n_resamples",
        F.lit(batch_size).alias("batch_size"), F.lit(MIN_SAMPLE).alias("min_sample"),
    )


def calibrate_composition(group_counts: DataFrame, batch_size: int, replicates: int = 500,
                          seed: int = 9) -> DataFrame:
    """Cutoffs of the largest share shift over (attribute, group); counts have a column n."""
    total = group_counts.groupBy("attribute").agg(F.sum("n").alias("total"))
    shares = group_counts.join(total, "attribute").select(
        "attribute", "group", "n", "total", (F.col("n") / F.col("total")).alias("r")
    )
    size = F.least(F.lit(batch_size), F.col("total"))
    drawn = draw_counts(shares, ["attribute"], "group", "n", F.least(F.lit(batch_size), F.col("all")), replicates,
                        seed, replace=False)
    joined = with_replicates(shares, replicates).join(drawn, ["replicate", "attribute", "group"], "left")
    shift = F.abs(F.coalesce("k", F.lit(0)) / size - F.col("r"))
    worst = joined.groupBy("replicate").agg(F.max(shift).alias("shift"))
    return _cutoffs(worst, "max_composition_shift", "shift", batch_size)


def quality_cutoffs(df: DataFrame) -> DataFrame:
    """Given cutoffs of the quality rates, one row per metric."""
    rows = [(m, QUALITY_REVIEW, QUALITY_MATERIAL, 0, 0, MIN_SAMPLE) for m in QUALITY_METRICS]
    return df.sparkSession.createDataFrame(
        rows, "metric string, review_cutoff double, material_cutoff double, n_resamples bigint, "
        "batch_size int, min_sample int",
    )


# --- signals ---------------------------------------------------------------------------


def state(deviation: Column, review: Column, material: Column, n: Column,
          min_sample: Column) -> Column:
    return (
        F.when(n < min_sample, STATES[0])
        .when(deviation >= material, STATES[3])
        .when(deviation >= review, STATES[2])
        .otherwise(STATES[1])
    )


def classify(observed: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds `status` to (…, metric, reference_value, observed_value, sample_size).

    The cutoff of a metric is looked up by the part of its name before '__'.
    """
    c = F.col
    table = cutoffs.select(F.col("metric").alias("_m"), "review_cutoff", "material_cutoff",
                           "min_sample")
    gap = F.abs(c("observed_value") - c("reference_value"))
    return (
        observed.withColumn("_m", F.split("metric", "__")[0])
        .join(table, "_m")
        .drop("_m")
        .withColumn("status", state(gap, c("review_cutoff"), c("material_cutoff"),
                                    c("sample_size"), c("min_sample")))
    )


SIGNAL = ("alert_id", "monitoring_run", "batch_sequence", "model_id", "severity", "category",
          "metric", "reference_value", "observed_value", "threshold", "sample_size", "status")


def _signal_id() -> Column:
    return F.concat(F.lit("SIG-"), F.substring(
        F.md5(F.concat_ws("|", "monitoring_run", "batch_sequence", "category", "metric")), 1, 12))


def signals(classified: DataFrame) -> DataFrame:
    """One row per metric outside its reference variability; ids depend on the row alone."""
    material = F.col("status") == STATES[3]
    return (
        classified.filter(F.col("status").isin(STATES[2], STATES[3]))
        .withColumn("severity", F.when(material, "high").otherwise("medium"))
        .withColumn("threshold", F.when(material, F.col("material_cutoff"))
                    .otherwise(F.col("review_cutoff")))
        .withColumn("alert_id", _signal_id())
        .select(*SIGNAL)
    )


def blocked_signals(blocked: DataFrame) -> DataFrame:
    """High signals of batches that were refused: (monitoring_run, batch_sequence, model_id)."""
    return (
        blocked.select(
            "monitoring_run", "batch_sequence", "model_id",
            F.lit("high").alias("severity"), F.lit("data_quality").alias("category"),
            F.lit("schema_validity").alias("metric"), F.lit(1.0).alias("reference_value"),
            F.lit(0.0).alias("observed_value"), F.lit(1.0).alias("threshold"),
            F.lit(0).cast("bigint").alias("sample_size"), F.lit(STATES[4]).alias("status"),
        )
        .withColumn("alert_id", _signal_id())
        .select(*SIGNAL)
    )


def family_wise(observed: DataFrame) -> DataFrame:
    """The feature with the largest PSI of each batch as one more observed metric."""
    psi = observed.filter(F.col("metric").startswith("psi__"))
    keys = ["monitoring_run", "batch_sequence", "model_id", "category"]
    top = psi.groupBy(*keys).agg(
        F.max_by(F.struct("metric", "observed_value", "sample_size"),
                 F.struct(F.abs("observed_value"), "metric")).alias("t")
    )
    return top.select(
        *keys, F.regexp_replace("t.metric", "^psi__", FAMILY_WISE + "__").alias("metric"),
        F.lit(0.0).alias("reference_value"), F.col("t.observed_value").alias("observed_value"),
        F.col("t.sample_size").alias("sample_size"),
    )


# --- groups and incidents --------------------------------------------------------------


def alert_groups(found: DataFrame) -> DataFrame:
    """Signals of one batch and category with a severity.

    Feature drift rises only on its family-wise signal; high needs a material deviation
    that the next batch confirms, or a blocked batch.
    """
    c = F.col
    wide = c("metric").startswith(FAMILY_WISE + "__")
    material = c("status") == STATES[3]
    grouped = found.groupBy("monitoring_run", "category", "batch_sequence").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.bool_or(c("status") == STATES[4]).alias("blocked"),
        F.bool_or(wide).alias("any_wide"),
        F.bool_or(wide & material).alias("material_wide"),
        F.bool_or(material).alias("any_material"),
        F.bool_or(c("status") == STATES[2]).alias("any_review"),
    )
    # One row per batch from here on.
    w = Window.partitionBy("monitoring_run", "category").orderBy("batch_sequence")
    confirmed = F.coalesce(
        F.lead("batch_sequence").over(w) == c("batch_sequence") + 1, F.lit(False)
    )
    features = c("category") == "feature_drift"
    strong = F.when(features, c("material_wide")).otherwise(c("any_material"))
    some = F.when(features, c("any_wide")).otherwise(c("any_material") | c("any_review"))
    severity = (
        F.when(c("blocked"), "high")
        .when(strong & c("confirmed_next_batch"), "high")
        .when(some, "medium")
        .otherwise("low")
    )
    return (
        grouped.withColumn("confirmed_next_batch", confirmed)
        .withColumn("severity", severity)
        .select(
            "monitoring_run", "batch_sequence", "category", "n_signals",
            "confirmed_next_batch", "severity",
            F.when(c("blocked"), STATES[4]).otherwise(c("severity")).alias("status"),
        )
    )


def incidents(groups: DataFrame, window: int = 2) -> DataFrame:
    """Runs of at least `window` consecutive batches above low, and every blocked batch."""
    c = F.col
    blocked = groups.filter(c("status") == STATES[4]).select(
        "monitoring_run", "category", c("batch_sequence").alias("first_batch"),
        c("batch_sequence").alias("last_batch"), F.lit(1).cast("bigint").alias("n_groups"),
        "n_signals", F.lit("high").alias("severity"), F.lit(STATES[4]).alias("status"),
    )
    w = Window.partitionBy("monitoring_run", "category").orderBy("batch_sequence")
    runs = (
        groups.filter((c("status") != STATES[4]) & (c("severity") != "low"))
        .withColumn("island", c("batch_sequence") - F.row_number().over(w))
        .groupBy("monitoring_run", "category", "island")
        .agg(
            F.min("batch_sequence").alias("first_batch"),
            F.max("batch_sequence").alias("last_batch"),
            F.count(F.lit(1)).alias("n_groups"),
            F.sum("n_signals").alias("n_signals"),
            F.bool_or(c("severity") == "high").alias("any_high"),
        )
        .filter(c("n_groups") >= window)
        .withColumn("severity", F.when(c("any_high"), "high").otherwise("medium"))
        .withColumn("status", c("severity"))
        .drop("island", "any_high")
    )
    return blocked.unionByName(runs)


def compression(found: DataFrame, groups: DataFrame, events: DataFrame) -> DataFrame:
    """Signals per alert group and per incident, by run."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("monitoring_run").agg(F.count(F.lit(1)).alias(name))

    joined = count(found, "n_signals").join(count(groups, "n_alert_groups"), "monitoring_run",
                                            "left")
    joined = joined.join(count(events, "n_incidents"), "monitoring_run", "left").na.fill(0)
    c = F.col
    return joined.select(
        "*",
        F.when(c("n_alert_groups") > 0, c("n_signals") / c("n_alert_groups"))
        .alias("alert_compression_ratio"),
        F.when(c("n_incidents") > 0, c("n_signals") / c("n_incidents"))
        .alias("incident_compression_ratio"),
    )


def benjamini_hochberg(p_values: DataFrame, keys: Sequence[str], item: str, p: str, fdr: float
                       ) -> DataFrame:
    """Step-up selection inside each family: adds rank, family size and `significant`."""
    keys = list(keys)
    one = p_values.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = scan(one, keys, p, Scan(sums={"rank": "_one"}, totals={"family": "_one"}), tie=item
                  ).drop("_one")
    passing = F.col(p) <= F.col("rank") / F.col("family") * fdr
    last = ranked.groupBy(*keys).agg(F.max(F.when(passing, F.col("rank"))).alias("_k"))
    joined = ranked.join(last, keys) if keys else ranked.withColumn("_j", F.lit(1)).join(
        last.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return joined.withColumn(
        "significant", F.coalesce(F.col("rank") <= F.col("_k"), F.lit(False))
    ).drop("_k")


# --- studies ---------------------------------------------------------------------------


def false_alert_study(reference_counts: DataFrame, cutoffs: DataFrame, batch_size: int,
                      batches: int = 100, seed: int = 21) -> DataFrame:
    """Share of unperturbed batches that alert: per feature, for any feature, family-wise."""
    null = psi_null(reference_counts, batch_size, batches, seed)
    return _alert_rates(null, cutoffs, [])


def _alert_rates(null: DataFrame, cutoffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    c = F.col
    single = cutoffs.filter(c("metric") == "psi").select(
        c("review_cutoff").alias("r1"), c("material_cutoff").alias("m1"))
    wide = cutoffs.filter(c("metric") == FAMILY_WISE).select(
        c("review_cutoff").alias("r2"), c("material_cutoff").alias("m2"))
    marked = with_one_row(with_one_row(null, single), wide)
    per_feature = marked.groupBy(*keys, c("feature").alias("scope")).agg(
        F.avg((c("psi") >= c("r1")).cast("double")).alias("review_rate"),
        F.avg((c("psi") >= c("m1")).cast("double")).alias("material_rate"),
        F.count(F.lit(1)).alias("n_batches"),
    )
    per_batch = marked.groupBy(*keys, "replicate").agg(
        F.max((c("psi") >= c("r1")).cast("double")).alias("any1"),
        F.max((c("psi") >= c("m1")).cast("double")).alias("any2"),
        F.max((c("psi") >= c("r2")).cast("double")).alias("fw1"),
        F.max((c("psi") >= c("m2")).cast("double")).alias("fw2"),
    )

    def rate(name: str, a: str, b: str) -> DataFrame:
        return per_batch.groupBy(*keys, F.lit(name).alias("scope")).agg(
            F.avg(a).alias("review_rate"), F.avg(b).alias("material_rate"),
            F.count(F.lit(1)).alias("n_batches"))

    return per_feature.unionByName(rate("any_feature", "any1", "any2")).unionByName(
        rate("family_wise", "fw1", "fw2"))


def batch_size_study(reference_counts: DataFrame, cutoffs: DataFrame,
                     sizes: Sequence[int] = (250, 500, 1000, 2000), batches: int = 100,
                     seed: int = 23) -> DataFrame:
    """The same rates for several batch sizes under cutoffs calibrated for one size."""
    grid = F.array(*[F.lit(int(x)) for x in sizes])
    null = psi_null(reference_counts, grid, batches, seed, keep=["size"])
    return _alert_rates(null, cutoffs, ["size"])


def sensitivity_study(drifted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """States of edited batches: (edit, magnitude, feature, psi, n) against the cutoffs."""
    c = F.col
    wide = cutoffs.filter(c("metric") == FAMILY_WISE).select(
        "review_cutoff", "material_cutoff", "min_sample")
    worst = drifted.groupBy("edit", "magnitude").agg(
        F.max("psi").alias("max_psi"), F.max_by("feature", "psi").alias("feature"),
        F.min("n").alias("n"))
    return with_one_row(worst, wide).select(
        "edit", "magnitude", "feature", "max_psi",
        state(c("max_psi"), c("review_cutoff"), c("material_cutoff"), c("n"), c("min_sample"))
        .alias("status"))


def detection_rows(expected: DataFrame, groups: DataFrame, events: DataFrame) -> DataFrame:
    """Expected outcome per batch against what was found.

    expected: monitoring_run, batch_sequence, scenario, expected_category, should_detect,
    should_block, blocked.
    """
    c = F.col
    key = ["monitoring_run", "batch_sequence", "category"]
    wanted = expected.withColumn(
        "category", F.when(c("expected_category") == STATES[4], "data_quality")
        .otherwise(c("expected_category")))
    hits = groups.select(*key, c("severity").alias("detected_severity"),
                         (c("status") == STATES[4]).alias("_b"))
    joined = wanted.join(hits, key, "left").withColumn(
        "detected", c("detected_severity").isNotNull()
        & (c("_b") | (c("expected_category") != STATES[4])))
    spans = events.select("monitoring_run", "category", "first_batch", "last_batch")
    covered = joined.join(spans, ["monitoring_run", "category"], "left").withColumn(
        "_in", c("batch_sequence").between(c("first_batch"), c("last_batch")))
    flags = covered.groupBy(*[x for x in joined.columns if x != "_b"]).agg(
        F.coalesce(F.bool_or("_in"), F.lit(False)).alias("in_incident"))
    return flags.select(
        "monitoring_run", "batch_sequence", "scenario", "expected_category", "should_detect",
        "should_block", "detected", "detected_severity", "in_incident",
        (c("blocked") == c("should_block")).alias("correctly_blocked"),
        (c("should_detect") & c("detected")).alias("true_positive"),
        (~c("should_detect") & c("detected")).alias("false_positive"),
    )


def detection_rates(rows: DataFrame) -> DataFrame:
    """Detection rate, false-alert rate, blocked recall and severity precision by run."""
    c = F.col

    def share(hit: Column, of: Column) -> Column:
        return F.avg(F.when(of, hit.cast("double")))

    high = c("detected") & (c("detected_severity") == "high")
    return rows.groupBy("monitoring_run").agg(
        share(c("true_positive"), c("should_detect")).alias("scenario_detection_rate"),
        share(c("false_positive"), ~c("should_detect")).alias("false_alert_rate"),
        share(c("correctly_blocked"), c("should_block")).alias("blocked_input_recall"),
        share(c("should_block") | c("should_detect"), high).alias("severity_precision"),
    )


def metric_table(df: DataFrame, category: str, metrics: Mapping[str, str], run: str, model: str,
                 sample: str, sequence: str = "batch_sequence") -> DataFrame:
    """Observed deviations in long form: metric name -> deviation column, reference value 0."""
    wide = df.select(
        F.col(sequence).alias("batch_sequence"), F.col(sample).cast("bigint").alias("sample_size"),
        *[F.col(v).cast("double").alias(k) for k, v in metrics.items()],
    )
    return wide.unpivot(["batch_sequence", "sample_size"], list(metrics), "metric",
                        "observed_value").select(
        F.lit(run).alias("monitoring_run"), "batch_sequence", F.lit(model).alias("model_id"),
        F.lit(category).alias("category"), "metric", F.lit(0.0).alias("reference_value"),
        "observed_value", "sample_size")
