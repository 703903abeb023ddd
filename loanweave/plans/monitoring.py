"""Batch monitoring as one plan: all batches of a run are a column, not a loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.operators import alerts, batch_input, drift
from loanweave.operators import evaluation as ev
from loanweave.session import settle

BATCH = ["batch_sequence"]


@dataclass(frozen=True)
class Monitor:
    """A reference population with scores, and what to check batches against.

    reference: rows with y, p, the features and the attributes.
    engineer_and_score: raw clean rows -> the same columns, keeping batch_sequence and the id.
    """

    reference: DataFrame
    cutoffs: DataFrame
    contract: batch_input.BatchContract
    features: tuple[str, ...]
    attributes: tuple[str, ...]
    engineer_and_score: Callable[[DataFrame], DataFrame]
    threshold: float = 0.5
    model: str = "model"

    def observe(self, raw: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
        """(observed metrics in long form, refused batches)."""
        blocked = self._blocked(raw, run)
        readable = raw.join(blocked.select("batch_sequence"), BATCH, "left_anti")
        quality = batch_input.quality_rates(
            batch_input.mark_rows(readable, self.contract, BATCH), BATCH)
        clean, _ = batch_input.split_batch(readable, self.contract, BATCH)
        # Scored once; every measure below reads the stored result.
        scored = settle(self.engineer_and_score(clean))
        parts = [
            self._table(quality, "data_quality", {m: m for m in alerts.QUALITY_METRICS}, run,
                        "row_count"),
            self._features(scored, run),
            *self._scores(scored, run),
            self._groups(scored, run),
        ]
        observed = reduce(lambda a, b: a.unionByName(b), parts)
        return observed.unionByName(alerts.family_wise(observed)), blocked

    def signals(self, raw: DataFrame, run: str) -> DataFrame:
        observed, blocked = self.observe(raw, run)
        found = alerts.signals(alerts.classify(observed, self.cutoffs))
        return found.unionByName(alerts.blocked_signals(blocked))

    def _table(self, df: DataFrame, category: str, metrics: dict[str, str], run: str,
               sample: str) -> DataFrame:
        return alerts.metric_table(df, category, metrics, run, self.model, sample)

    def _blocked(self, raw: DataFrame, run: str) -> DataFrame:
        found = batch_input.schema_violations(raw, self.contract, (*BATCH, *self.attributes, "y"))
        if found:
            raise batch_input.SchemaViolation(f"batch columns do not fit: {found}")
        bad = batch_input.unreadable_numbers(raw, self.contract, BATCH)
        return bad.select(F.lit(run).alias("monitoring_run"), "batch_sequence",
                          F.lit(self.model).alias("model_id")).distinct()

    def _features(self, scored: DataFrame, run: str) -> DataFrame:
        ref = drift.long_features(self.reference, self.features)
        new = drift.long_features(scored, self.features, BATCH)
        edges = drift.edges_of(ref)
        psi = drift.divergences(drift.histogram(ref, edges, []),
                                drift.histogram(new, edges, BATCH, clipped=True), BATCH)
        size = scored.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("n"))
        return psi.join(size, BATCH).select(
            F.lit(run).alias("monitoring_run"), "batch_sequence",
            F.lit(self.model).alias("model_id"), F.lit("feature_drift").alias("category"),
            F.concat(F.lit("psi__"), F.col("feature")).alias("metric"),
            F.lit(0.0).alias("reference_value"), F.col("psi").alias("observed_value"),
            F.col("n").cast("bigint").alias("sample_size"))

    def _scores(self, scored: DataFrame, run: str) -> list[DataFrame]:
        names = ("roc_auc", "pr_auc", "brier_score", "prevalence", "mean_score")

        def summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
            mean = df.groupBy(*by).agg(F.avg("p").alias("mean_score"))
            return reduce(lambda a, b: ev._join(a, b, by),
                          [ev.discrimination(df, by), ev.calibration_errors(df, by), mean])

        base = summary(self.reference, []).select(*[F.col(n).alias(f"r_{n}") for n in names])
        both = ev._join(summary(scored, BATCH), base, []).withColumns(
            {f"d_{n}": F.abs(F.col(n) - F.col(f"r_{n}")) for n in names})
        tables = {
            "performance_drift": {"roc_auc_delta": "d_roc_auc", "pr_auc_delta": "d_pr_auc",
                                  "brier_delta": "d_brier_score"},
            "score_drift": {"score_mean_shift": "d_mean_score"},
            "target_distribution_drift": {"event_rate_delta": "d_prevalence"},
        }
        return [self._table(both, c, m, run, "n") for c, m in tables.items()]

    def _groups(self, scored: DataFrame, run: str) -> DataFrame:
        seen = drift.subgroup_monitoring(self.reference, scored, self.attributes, self.threshold,
                                         BATCH)
        worst = drift.max_composition_shift(seen, BATCH)
        size = scored.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("n"))
        return self._table(worst.join(size, BATCH), "subgroup_composition_drift",
                           {"max_composition_shift": "max_composition_shift"}, run, "n")


def calibrate(reference: DataFrame, features: Sequence[str], attributes: Sequence[str],
              batch_size: int, replicates: int = 100) -> DataFrame:
    """All cutoffs of a reference, from chance alone; quality cutoffs are given values."""
    ref = drift.long_features(reference, features)
    counts = drift.histogram(ref, drift.edges_of(ref), [])
    groups = drift.composition(reference, attributes, []).groupBy("attribute", "group").agg(
        F.count(F.lit(1)).alias("n"))
    parts = [
        alerts.calibrate_psi(counts, batch_size, replicates),
        alerts.calibrate_family_wise(counts, batch_size, replicates),
        alerts.calibrate_scores(reference, batch_size, replicates),
        alerts.calibrate_composition(groups, batch_size, replicates),
        alerts.quality_cutoffs(reference),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
