"""Metric functions against closed forms, brute force and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanweave.operators import alerts, drift
from loanweave.operators import evaluation as ev
from loanweave.operators import features as ft
from loanweave.operators import models as m
from loanweave.operators.replicates import poisson, uniform


@pytest.fixture
def small_cells(spark):
    """Forces every scan to be cut into many cells."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    ap, ks = 0.0, 0.0
    for t in np.unique(p):
        here = (p == t) & (y == 1)
        above = p >= t
        ap += here.sum() / len(pos) * (y[above].mean())
        ks = max(ks, abs((pos <= t).mean() - (neg <= t).mean()))
    return auc, ap, ks


def test_rank_metrics_with_ties_and_cells(spark, small_cells):
    rng = np.random.default_rng(2)
    p = rng.random(400).round(2)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    r = ev.discrimination(df).first()
    assert np.allclose((r.roc_auc, r.pr_auc, r.ks_statistic), brute(y, p))


def test_single_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.2, "a"), (1, 0.9, "a"), (0, 0.5, "b"), (1, 0.5, "b")],
                               "y int, p double, g string")
    got = {r.g: r.roc_auc for r in ev.discrimination(df, ["g"]).collect()}
    assert got == {"a": None, "b": 0.5}


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    r = ev.confusion(df, 0.5).first()
    assert (r.precision, r.recall, r.specificity, r.f1, r.balanced_accuracy) == (0, 0, 1, 0, 0.5)


def test_calibration_line_recovers_truth(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(0, 1.5, 20000)
    p = 1 / (1 + np.exp(-z))
    y = (rng.random(20000) < 1 / (1 + np.exp(-(0.3 + 0.7 * z)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p.round(4)}))
    r = ev.calibration_line(df).first()
    assert abs(r.calibration_intercept - 0.3) < 0.1 and abs(r.calibration_slope - 0.7) < 0.1


def test_bootstrap_band_covers_estimate(spark):
    rng = np.random.default_rng(4)
    p = rng.random(600).round(2)
    y = (rng.random(600) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    bands = {r.metric: r for r in ev.bootstrap(df, 60).collect()}
    auc = brute(y, p)[0]
    assert bands["roc_auc"].p2_5 < auc < bands["roc_auc"].p97_5
    assert 0.005 < bands["roc_auc"]["std"] < 0.05
    assert bands["roc_auc"].point_estimate == pytest.approx(auc) and bands["roc_auc"].failures == 0
    top = p >= np.quantile(p, 0.9)
    assert bands["recall_at_top"].point_estimate == pytest.approx(y[top].sum() / y.sum())
    assert bands["precision_at_top"].point_estimate == pytest.approx(y[top].mean())
    # Class sizes are kept.
    counts = ev.resampled(ev.score_counts(df), [], 7, 1).groupBy("replicate").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    assert {(r.pos, r.neg) for r in counts} == {(int(y.sum()), int((1 - y).sum()))} and len(counts) == 7


def test_permutation_null_is_centred(spark):
    rng = np.random.default_rng(6)
    p = rng.random(500).round(2)
    y = (rng.random(500) < p).astype(int)
    r = ev.permutation_null(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), 80).first()
    assert abs(r.null_mean - 0.5) < 0.01 and r.p_value == pytest.approx(1 / 81)
    # Spread of the rank-sum statistic under shuffled labels.
    pos, n = int(y.sum()), len(y)
    want = np.sqrt((n + 1) / (12 * pos * (n - pos)))
    assert 0.75 * want < r.null_std < 1.3 * want


def test_random_draws(spark):
    df = spark.range(20000).select(
        uniform(F.col("id"), 1).alias("u"), poisson(F.lit(1.0), F.col("id"), 2).alias("a"),
        poisson(F.lit(12.0), F.col("id"), 3).alias("b"),
        poisson(F.lit(500.0), F.col("id"), 4).alias("c"))
    r = df.agg(*[F.avg(c).alias(f"m{c}") for c in "uabc"],
               *[F.var_samp(c).alias(f"v{c}") for c in "uabc"]).first()
    assert abs(r.mu - 0.5) < 0.01 and abs(r.vu - 1 / 12) < 0.005
    for mean, var, want in ((r.ma, r.va, 1), (r.mb, r.vb, 12), (r.mc, r.vc, 500)):
        assert abs(mean / want - 1) < 0.03 and abs(var / want - 1) < 0.05


def _ecdf_distances(a, b):
    xs = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    g = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return np.abs(f - g).max(), (np.abs(f - g)[:-1] * np.diff(xs)).sum()


def test_distances_by_brute_force(spark, small_cells):
    rng = np.random.default_rng(8)
    ref = rng.normal(0, 1, 300).round(1)
    news = {"same": rng.normal(0, 1, 200).round(1), "moved": rng.normal(1, 2, 150).round(1),
            "outside": np.full(20, 9.0), "one": np.array([0.05])}
    r = spark.createDataFrame(pd.DataFrame({"feature": "x", "value": ref}))
    b = spark.createDataFrame(pd.concat(
        [pd.DataFrame({"batch": k, "feature": "x", "value": v}) for k, v in news.items()]))
    got = {x.batch: x for x in drift.distances(drift.value_counts(r),
                                               drift.value_counts(b, ["batch"]),
                                               ["batch"]).collect()}
    for k, v in news.items():
        ks, w = _ecdf_distances(ref, v)
        assert got[k].ks_statistic == pytest.approx(ks, abs=1e-9)
        assert got[k].wasserstein_distance == pytest.approx(w, abs=1e-9)


def test_psi_of_identical_batches_is_zero_and_last_edge_counts(spark):
    v = spark.createDataFrame([("x", float(i)) for i in range(101)], "feature string, value double")
    edges = drift.edges_of(v)
    h = drift.histogram(v, edges, [])
    assert h.agg(F.sum("n")).first()[0] == 101
    new = v.withColumn("batch", F.lit("b"))
    r = drift.divergences(h, drift.histogram(new, edges, ["batch"], clipped=True),
                          ["batch"]).first()
    assert r.psi == 0 and r.jensen_shannon_divergence == 0


def test_vif_of_copies_is_infinite(spark):
    df = spark.range(200).select(
        uniform(F.col("id"), 1).alias("a"), uniform(F.col("id"), 2).alias("b")).withColumn(
        "c", F.col("a") * 2)
    got = {r.feature: r.vif for r in m.vif_table(df, ["a", "b", "c"]).collect()}
    assert math.isinf(got["a"]) and math.isinf(got["c"]) and got["b"] < 1.2


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    shares = {"train": 0.6, "validation": 0.2, "test": 0.2}
    a = ft.stratified_split(df.repartition(9), "id", "y", shares)
    b = ft.stratified_split(df, "id", "y", shares)
    assert a.join(b.withColumnRenamed("split", "s2"), "id").filter("split != s2").count() == 0
    got = {r["split"]: (r.n, r.prevalence) for r in ft.split_manifest(a, "id", "y").collect()}
    assert got == {"train": (600, 0.2), "validation": (200, 0.2), "test": (200, 0.2)}


def test_negative_controls_score_as_they_must(spark):
    df = spark.range(3000).select("id", (uniform(F.col("id"), 5) < 0.3).cast("int").alias("y"))
    c = ft.negative_controls(df, "id", "y")
    for name, low, high in (("control_shuffled", 0.45, 0.55), ("control_leak", 0.999, 1.0)):
        auc = ev.discrimination(c.select("y", F.col(name).alias("p"))).first()["roc_auc"]
        assert low <= auc <= high


def test_leakage_guard():
    for bad in (["y"], ["id"], ["X2"], ["mystery"]):
        with pytest.raises(ft.LeakageError):
            ft.check_training_columns([ft.FEATURES[0], *bad], "y", ["id"])


def test_logistic_model_learns(spark):
    df = spark.range(1500).select(
        "id", uniform(F.col("id"), 1).alias("a"), uniform(F.col("id"), 2).alias("b"))
    df = df.withColumn("y", (uniform(F.col("id"), 3) < F.col("a")).cast("int"))
    model = m.fit(df, ["a", "b"])
    assert ev.discrimination(m.score(model, df)).first()["roc_auc"] > 0.75
    coef = {r.feature: r.coefficient for r in m.coefficients(model, ["a", "b"], spark).collect()}
    assert coef["a"] > 10 * abs(coef["b"])
    codes = m.reason_codes(model, df, ["a", "b"], {"a": "prohibited", "b": "allowed"}, 3)
    assert codes.select("feature").distinct().collect()[0].feature == "b"


def test_islands_and_confirmation(spark):
    schema = ("monitoring_run string, category string, batch_sequence int, metric string, "
              "status string")
    rows = [("r", "score_drift", b, "m", s) for b, s in
            [(1, "review"), (2, "material_deviation"), (3, "review"), (5, "review"),
             (8, "material_deviation")]]
    rows += [("r", "feature_drift", 1, "psi__x", "material_deviation"),
             ("r", "data_quality", 4, "schema_validity", "blocked_input")]
    groups = alerts.alert_groups(spark.createDataFrame(rows, schema))
    sev = {(g.category, g.batch_sequence): g.severity for g in groups.collect()}
    assert sev[("score_drift", 2)] == "high" and sev[("score_drift", 8)] == "medium"
    assert sev[("feature_drift", 1)] == "low" and sev[("data_quality", 4)] == "high"
    found = {(i.category, i.first_batch, i.last_batch, i.severity)
             for i in alerts.incidents(groups).collect()}
    assert found == {("score_drift", 1, 3, "high"), ("data_quality", 4, 4, "high")}


def test_benjamini_hochberg_steps_up(spark):
    p = [0.001, 0.012, 0.03, 0.031, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "item int, p double")
    got = {r.item: r.significant
           for r in alerts.benjamini_hochberg(df, [], "item", "p", 0.05).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}
