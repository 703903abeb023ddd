"""Fits that run together equal fits that run alone; shuffles hand out all positives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loanweave.operators import many_fits as mf
from loanweave.operators import models as m


def table(spark, n=300):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * (x[:, 1] - 3))))).astype(float)
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").withColumn("h", F.xxhash64("id")), x, y


def plain(x, y, w, strength):
    """Newton on columns standardised with the weights."""
    mean = (w[:, None] * x).sum(0) / w.sum()
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - 1))
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    b = np.zeros(z.shape[1])
    pen = np.r_[0, np.ones(x.shape[1])] / strength
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (w * (p - y)) + pen * b)
    return b[1:]


def test_together_equals_alone(spark):
    df, x, y = table(spark)
    h = np.array([r.h for r in df.orderBy("id").select("h").collect()])
    numbers = np.arange(4)

    def draw(h, y):
        w = mf.poisson_weights(h, numbers, 3)
        return w, np.broadcast_to(y[:, None], w.shape)

    got = mf.fit_many(df.repartition(3), ["h", "y"], draw, np.array([1.0, 1.0, 0.1, 10.0]))
    w = mf.poisson_weights(h, numbers, 3)
    for i, strength in enumerate((1.0, 1.0, 0.1, 10.0)):
        assert np.allclose(got.coefficients[i], plain(x, y, w[:, i], strength), atol=1e-8)


def test_equals_spark_ml(spark):
    df, x, _ = table(spark)
    sd = x.std(axis=0, ddof=1)
    scaled = df.withColumn("v", array_to_vector(F.zip_with("x", F.lit([float(s) for s in sd]), lambda a, b: a / b)))
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=1 / len(x), standardization=False,
                               tol=1e-12, maxIter=500).fit(scaled)
    got = mf.fit_many(df, ["y"], lambda y: (np.ones((len(y), 1)), y[:, None]), np.ones(1))
    assert np.allclose(got.coefficients[0], model.coefficients.toArray(), atol=1e-5)


def test_poisson_weights():
    w = mf.poisson_weights(np.arange(20000), np.arange(3), 1)
    assert np.abs(w.mean(axis=0) - 1).max() < 0.03 and np.abs(w.var(axis=0) - 1).max() < 0.05
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_cuts_hand_out_exactly_the_positives(spark):
    df, _, _ = table(spark, 2500)
    h = np.array([r.h for r in df.select("h").collect()])
    for positives in (0, 1, 700, 2500):
        cuts = mf.label_cuts(df.repartition(4), positives, 6, 9)
        n = (mf.hashes(h, np.arange(6), 9) <= cuts[None, :]).sum(axis=0)
        assert (n == positives).all() or positives == 0 and (n == 0).all()


def test_null_of_refits_is_centred(spark):
    df, x, y = table(spark, 600)
    wide = spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "y": y.astype(int), "a": x[:, 0], "b": x[:, 1]}))
    r = m.retrain_null(wide, ["a", "b"], fits=40).first()
    # Directions found in noise: the test AUC is wide around a half.
    assert r.fits == 40 and abs(r.null_mean - 0.5) < 0.15 and r.real_auc > 0.7 and r.p_value < 0.2


def test_empty_table(spark):
    df, _, _ = table(spark, 5)
    assert mf.fit_many(df.where("false"), ["y"], lambda y: (y[:, None], y[:, None]), np.ones(2)).steps == 0
