"""Drift of feature and score batches against a reference.

Values come in long form: (batch, feature, value) and (feature, value) for the reference.
The reference is never copied per batch: its distribution function is tabulated once at all
values that occur, and batches look their own values up in it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.functions.buckets import sample_tier
from loanweave.functions.numeric import SHARE_FLOOR, entropy_term, equal_width_bin
from loanweave.operators.asof import asof_join
from loanweave.operators.scan import Scan, average_ranks, exact_quantiles, scan
from loanweave.session import settle

BINS = 20
# Quantiles kept for features and for scores.
FEATURE_QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75,
                     "q95": 0.95, "q99": 0.99}
SCORE_QUANTILES = {"q01": 0.01, "q05": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75,
                   "q90": 0.9, "q95": 0.95, "q99": 0.99}


def long_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, value) rows of wide feature columns."""
    wide = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(list(keep), list(features), "feature", "value")


def _known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows k per (keys, feature, value): what distances, histograms and quantiles work on."""
    return _known(df).groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("k"))


def _moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    good = F.col("value").isNotNull() & ~F.isnan("value")
    v = F.when(good, F.col("value"))
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (1 - F.count(v) / F.count(F.lit(1))).alias("missingness"),
    )


def reference_statistics(reference: DataFrame, quantiles: Mapping[str, float] = FEATURE_QUANTILES
                         ) -> DataFrame:
    """Moments, missing share and exact quantiles per feature, over non-null values."""
    names = {**quantiles, "median": 0.5}
    return _moments(reference, ["feature"]).join(
        exact_quantiles(_known(reference), ["feature"], "value", names), "feature"
    )


def histogram(values: DataFrame, edges: DataFrame, keys: Sequence[str], bins: int = BINS,
              clipped: bool = False) -> DataFrame:
    """Counts per (keys, feature, bin) for the equal-width bins between edge_lo and edge_hi.

    `clipped` moves values outside into the end bins; otherwise they are dropped. A column k
    is taken as the number of rows a row stands for.
    """
    w = F.col("k") if "k" in values.columns else F.lit(1).cast("bigint")
    joined = _known(values).join(edges.select("feature", "edge_lo", "edge_hi"), "feature")
    v = F.col("value")
    if clipped:
        v = F.least(F.greatest(v, F.col("edge_lo")), F.col("edge_hi"))
    b = equal_width_bin(v, F.col("edge_lo"), F.col("edge_hi"), bins)
    return (
        joined.select(*keys, "feature", b.alias("bin"), w.alias("_w"))
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "feature", "bin")
        .agg(F.sum("_w").alias("n"))
    )


def edges_of(reference: DataFrame) -> DataFrame:
    return _known(reference).groupBy("feature").agg(
        F.min("value").alias("edge_lo"), F.max("value").alias("edge_hi")
    )


def _shares(counts: DataFrame, keys: Sequence[str], bins: int, name: str) -> DataFrame:
    """Share of every bin of the full grid, empty bins included."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.coalesce("n", F.lit(0)) / F.col("total")).alias(name)
    )


def divergences(reference_counts: DataFrame, batch_counts: DataFrame, keys: Sequence[str],
                bins: int = BINS) -> DataFrame:
    """PSI (shares floored at 1e-6) and Jensen-Shannon divergence (base 2) per (keys, feature)."""
    ref = _shares(reference_counts, ["feature"], bins, "r")
    new = _shares(batch_counts, [*keys, "feature"], bins, "b")
    b, r = F.greatest("b", F.lit(SHARE_FLOOR)), F.greatest("r", F.lit(SHARE_FLOOR))
    m = (F.col("b") + F.col("r")) / 2
    js = (entropy_term(F.col("b"), m) + entropy_term(F.col("r"), m)) / 2
    return new.join(ref, ["feature", "bin"]).groupBy(*keys, "feature").agg(
        F.sum((b - r) * F.log(b / r)).alias("psi"),
        F.sum(js).alias("jensen_shannon_divergence"),
    )


def distribution_table(reference: DataFrame, batches: DataFrame) -> DataFrame:
    """Reference distribution at every value of reference or batches, per feature.

    Both are value counts. below: share of the reference strictly below the value; upto: at
    or below it; area: integral of the distribution function up to the value.
    """
    ref = reference.select("feature", "value", F.col("k").alias("n"))
    seen = batches.select("feature", "value").distinct().withColumn(
        "n", F.lit(0).cast("bigint")
    )
    points = ref.unionByName(seen).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    ranked = scan(points, ["feature"], "value",
                  Scan(sums={"cum": "n"}, totals={"all": "n"}, leads={"next": "value"}))
    upto = F.col("cum") / F.col("all")
    strips = ranked.select(
        "feature", "value", "n",
        upto.alias("upto"),
        ((F.col("cum") - F.col("n")) / F.col("all")).alias("below"),
        F.coalesce((F.col("next") - F.col("value")) * upto, F.lit(0.0)).alias("strip"),
    )
    summed = scan(strips, ["feature"], "value", Scan(sums={"area_after": "strip"}))
    # The strip of a row lies to its right; the area up to a value leaves it out.
    return summed.select(
        "feature", "value", (F.col("n") > 0).alias("in_reference"), "upto", "below",
        (F.col("area_after") - F.col("strip")).alias("area"),
    )


def distances(reference: DataFrame, batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-sample KS and Wasserstein-1 distance of every (keys, feature) to the reference,
    from value counts of both.

    Between two neighbouring batch values the batch function is constant and the reference
    function only rises, so its largest distance lies at the ends, and the area between them
    is split at most once, where the reference reaches the level of the batch.
    """
    keys = list(keys)
    group = [*keys, "feature"]
    table = settle(distribution_table(reference, batches))
    ranked = scan(batches, group, "value",
                  Scan(sums={"cum": "k"}, totals={"all": "k"}, leads={"next": "value"}))
    level = ranked.withColumn("g", F.col("cum") / F.col("all")).withColumn(
        "g_below", (F.col("cum") - F.col("k")) / F.col("all")
    )
    here = table.select("feature", "value", "upto", "below", "area")
    there = table.select("feature", F.col("value").alias("next"),
                         F.col("below").alias("next_below"), F.col("area").alias("next_area"))
    at = level.join(here, ["feature", "value"]).join(there, ["feature", "next"], "left")
    # Smallest reference value whose function reaches g: an as-of lookup on the negated level.
    reached = table.filter("in_reference").select(
        "feature", (-F.col("upto")).alias("level"), F.col("value").alias("cross"),
        F.col("area").alias("cross_area"),
    )
    probe = at.withColumn("want", -F.col("g"))
    hit = asof_join(probe, reached, ["feature"], "want", "level", ["cross", "cross_area"])
    c = F.col
    inside = c("cross").isNotNull() & (c("cross") > c("value")) & (c("cross") < c("next"))
    late = c("cross").isNull() | (c("cross") >= c("next"))
    split = F.when(inside, c("cross")).when(late, c("next")).otherwise(c("value"))
    split_area = F.when(inside, c("cross_area")).when(late, c("next_area")).otherwise(c("area"))
    between = (
        c("g") * (split - c("value")) - (split_area - c("area"))
        + (c("next_area") - split_area) - c("g") * (c("next") - split)
    )
    ends = table.groupBy("feature").agg(
        F.max("value").alias("last"), F.max_by("area", "value").alias("last_area")
    )
    tail = (c("last") - c("value")) - (c("last_area") - c("area"))
    joined = hit.join(ends, "feature")
    first = c("cum") == c("k")
    piece = F.coalesce(between, tail) + F.when(first, c("area")).otherwise(0.0)
    return joined.groupBy(*group).agg(
        F.max(
            F.greatest(
                F.abs(c("upto") - c("g")),
                F.abs(c("below") - c("g_below")),
                F.coalesce(F.abs(c("next_below") - c("g")), F.lit(0.0)),
            )
        ).alias("ks_statistic"),
        F.sum(F.greatest(piece, F.lit(0.0))).alias("wasserstein_distance"),
    )


def feature_drift(reference: DataFrame, batches: DataFrame, keys: Sequence[str] = ("batch",),
                  quantiles: Mapping[str, float] = FEATURE_QUANTILES, bins: int = BINS
                  ) -> DataFrame:
    """All drift measures of every (keys, feature)."""
    keys = list(keys)
    group = [*keys, "feature"]
    # Everything but the moments works on value counts, which are computed once.
    ref_counts = settle(value_counts(reference))
    new_counts = settle(value_counts(batches, keys))
    edges = edges_of(ref_counts)
    div = divergences(
        histogram(ref_counts, edges, [], bins), histogram(new_counts, edges, keys, bins, True),
        keys, bins,
    )
    names = {**quantiles, "median": 0.5}
    ref = _moments(reference, ["feature"]).join(
        exact_quantiles(ref_counts, ["feature"], "value", names, "k"), "feature"
    )
    now = _moments(batches, group).join(
        exact_quantiles(new_counts, group, "value", names, "k"), group
    )
    stats = ref.select("feature", *[F.col(c).alias(f"r_{c}") for c in ref.columns
                                    if c != "feature"])
    c = F.col
    shifts = now.join(stats, "feature").select(
        *group,
        c("r_n").alias("n_reference"),
        c("n").alias("n_batch"),
        (c("mean") - c("r_mean")).alias("mean_shift"),
        (c("median") - c("r_median")).alias("median_shift"),
        (c("std") * c("std") - c("r_std") * c("r_std")).alias("variance_shift"),
        (c("missingness") - c("r_missingness")).alias("missingness_delta"),
        *[(c(q) - c(f"r_{q}")).alias(f"{q}_shift") for q in quantiles],
    )
    return shifts.join(div, group).join(
        distances(ref_counts, new_counts, keys), group)


def score_drift(reference: DataFrame, batches: DataFrame, band: Column, top_cut: float,
                keys: Sequence[str] = ("batch",)) -> DataFrame:
    """Score drift: mean and quantile shifts, PSI, band shares and share above a cut.

    Both tables have a score column p; `band` labels it.
    """
    keys = list(keys)
    bands = ("low", "medium", "high", "very_high")

    def summary(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.count(F.lit(1)).alias(f"{prefix}n"),
            F.avg("p").alias(f"{prefix}mean"),
            F.avg((F.col("p") >= top_cut).cast("double")).alias(f"{prefix}above_cut"),
            *[F.avg((band == b).cast("double")).alias(f"{prefix}{b}") for b in bands],
        )

    def long(df: DataFrame, by: list[str]) -> DataFrame:
        return df.select(*by, F.lit("score").alias("feature"), F.col("p").alias("value"))

    ref_long, new_long = long(reference, []), long(batches, keys)
    edges = edges_of(ref_long)
    psi = divergences(histogram(ref_long, edges, []), histogram(new_long, edges, keys, BINS, True),
                      keys).select(*keys, F.col("psi").alias("score_psi"))
    ref_q = exact_quantiles(ref_long, ["feature"], "value", SCORE_QUANTILES)
    new_q = exact_quantiles(new_long, [*keys, "feature"], "value", SCORE_QUANTILES)
    shift = new_q.alias("a").join(ref_q.alias("b"), "feature").select(
        *keys, *[(F.col(f"a.{q}") - F.col(f"b.{q}")).alias(f"{q}_shift") for q in SCORE_QUANTILES]
    )
    tag = F.lit("score").alias("feature")
    r = summary(reference, [], "r_").select("*", tag)
    both = summary(batches, keys, "").select("*", tag).join(r, "feature")
    c = F.col
    out = both.select(
        *keys, c("r_n").alias("n_reference"), c("n").alias("n_batch"),
        (c("mean") - c("r_mean")).alias("mean_shift"),
        c("above_cut").alias("share_above_cut"), c("r_above_cut").alias("reference_above_cut"),
        *[c(b).alias(f"share_{b}") for b in bands],
        *[(c(b) - c(f"r_{b}")).alias(f"shift_{b}") for b in bands],
    )
    return out.join(psi, keys).join(shift, keys)


def rank_stability(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of two scores of the same rows."""
    ranked = average_ranks(average_ranks(df, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rank_stability"))


def event_rate_drift(df: DataFrame, reference_rate: Column, keys: Sequence[str] = ("batch",)
                     ) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(F.col("y").cast("double")).alias("event_rate"), F.max(reference_rate).alias("_r")
    ).select(*keys, "event_rate", F.abs(F.col("event_rate") - F.col("_r")).alias(
        "event_rate_delta"))


def composition(df: DataFrame, attributes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Row counts and shares per (keys, attribute, group)."""
    long = df.select(
        *keys,
        *[c for c in ("y", "p") if c in df.columns],
        F.explode(F.array(*[
            F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group"))
            for a in attributes
        ])).alias("g"),
    ).select(*keys, "g.attribute", "g.group", *[c for c in ("y", "p") if c in df.columns])
    return long


def subgroup_monitoring(reference: DataFrame, batches: DataFrame, attributes: Sequence[str],
                        threshold: float, keys: Sequence[str] = ("batch",)) -> DataFrame:
    """Share, share shift, selection rate, mean score and recall per group and batch."""
    keys = list(keys)
    dims = ["attribute", "group"]
    ref = composition(reference, attributes, []).groupBy(*dims).agg(F.count(F.lit(1)).alias("rn"))
    ref_total = ref.groupBy("attribute").agg(F.sum("rn").alias("rt"))
    shares = ref.join(ref_total, "attribute").select(
        *dims, (F.col("rn") / F.col("rt")).alias("reference_share")
    )
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    now = composition(batches, attributes, keys).groupBy(*keys, *dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit.cast("double")).alias("selection_rate"),
        F.avg("p").alias("mean_score"),
        F.when(F.count_if(y) > 0, F.count_if(hit & y) / F.count_if(y)).alias("recall"),
    )
    total = now.groupBy(*keys, "attribute").agg(F.sum("n").alias("t"))
    share = F.col("n") / F.col("t")
    return (
        now.join(total, [*keys, "attribute"])
        .join(shares, dims, "left")
        .select(
            *keys, *dims, "n", sample_tier("n").alias("sample_classification"),
            share.alias("composition_share"),
            F.coalesce("reference_share", F.lit(0.0)).alias("reference_share"),
            (share - F.coalesce("reference_share", F.lit(0.0))).alias("composition_shift"),
            "selection_rate", "mean_score", "recall",
        )
    )


def max_composition_shift(monitored: DataFrame, keys: Sequence[str] = ("batch",)) -> DataFrame:
    return monitored.groupBy(*keys).agg(
        F.max(F.abs("composition_shift")).alias("max_composition_shift")
    )
