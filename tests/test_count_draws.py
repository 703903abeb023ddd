"""Draws in count space follow the law of drawing rows, whatever the shape of the tree."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanweave.operators import count_draws as cd

SIZES = [5, 1, 30, 0, 12, 2, 50, 7, 3, 40]


def cells(spark, sizes=SIZES):
    return spark.createDataFrame([("a", i, n) for i, n in enumerate(sizes)], "g string, bin int, n bigint")


@pytest.mark.parametrize("fan", [2, 3, 256])
@pytest.mark.parametrize("replace", [True, False])
def test_totals_means_and_variances(spark, fan, replace):
    k, runs = 60, 1500
    rows = cd.draw_counts(cells(spark), ["g"], "bin", "n", F.lit(k), runs, 3, replace, fan=fan).collect()
    got = np.zeros((runs, len(SIZES)))
    for r in rows:
        got[r.replicate - 1, r.bin] = r.k
    n, p = sum(SIZES), np.array(SIZES) / sum(SIZES)
    assert (got.sum(axis=1) == k).all()
    shrink = 1 if replace else (n - k) / (n - 1)
    var = k * p * (1 - p) * shrink
    assert (np.abs(got.mean(axis=0) - k * p) < 5 * np.sqrt(var / runs) + 1e-9).all()
    assert (np.abs(got.var(axis=0) - var) <= 0.25 * var + 0.02).all()
    assert (got <= np.array(SIZES)).all() or replace


def test_all_rows_without_replacement_are_the_cells(spark):
    rows = cd.draw_counts(cells(spark), ["g"], "bin", "n", F.col("all"), 2, 1, False, fan=3).collect()
    assert {(r.replicate, r.bin): r.k for r in rows} == {(x, i): n for x in (1, 2) for i, n in enumerate(SIZES) if n}


def test_draws_do_not_depend_on_partitioning(spark):
    draw = lambda df: sorted(map(tuple, cd.draw_counts(df, ["g"], "bin", "n", F.lit(20), 5, 9, True, fan=3).collect()))
    assert draw(cells(spark)) == draw(cells(spark).repartition(5))


def test_null_population_empty_table_and_names(spark):
    df = spark.createDataFrame([(None, 1, 4), ("x", 1, 6), ("x", 2, 0)], "g string, bin int, n bigint")
    rows = cd.draw_counts(df, ["g"], "bin", "n", F.col("all"), 1, 1, True, "times").collect()
    assert sorted((str(r.g), r.bin, r.times) for r in rows) == [("None", 1, 4), ("x", 1, 6)]
    assert cd.draw_counts(df.where("false"), ["g"], "bin", "n", F.col("all"), 3, 1, True).count() == 0


def test_large_counts_have_the_hypergeometric_law():
    rng = np.random.default_rng(1)
    sizes = np.array([4 * 10**9, 10**9, 5 * 10**9])
    got = np.array([cd.without_replacement(rng, sizes, 1000) for _ in range(2000)])
    assert (got.sum(axis=1) == 1000).all()
    assert np.abs(got.mean(axis=0) - [400, 100, 500]).max() < 2
    assert np.abs(got.var(axis=0) / [240, 90, 250] - 1).max() < 0.15
    small = [cd._hypergeometric(rng, 7, 5, 6) for _ in range(4000)]
    assert abs(np.mean(small) - 3.5) < 0.05 and {min(small), max(small)} == {1, 6}
