"""Ordered scans give the plain result however the groups are cut into cells."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanweave.operators.asof import asof_join
from loanweave.operators.scan import (
    Scan,
    average_ranks,
    decile,
    exact_quantiles,
    ntile,
    place,
    positions,
    scan,
)


@pytest.fixture(scope="module")
def rows():
    """One group holds most rows, one value holds a third of them."""
    rng = np.random.default_rng(5)
    n = 2000
    return pd.DataFrame({
        "g": np.where(rng.random(n) < 0.8, "hot", "cold"),
        "v": np.where(rng.random(n) < 0.35, 0.5, rng.random(n).round(3)),
        "id": np.arange(n), "w": rng.integers(0, 9, n),
    })


@pytest.mark.parametrize("cells", [40, 1, None])
@pytest.mark.parametrize("descending", [False, True])
def test_positions(spark, rows, cells, descending):
    df = spark.createDataFrame(rows).repartition(7)
    got = positions(df, ["g"], "v", "id", descending=descending, cells=cells)
    got = got.toPandas().sort_values("id")
    want = rows.sort_values(["v", "id"], ascending=[not descending, True])
    want = want.assign(position=want.groupby("g").cumcount() + 1).sort_values("id")
    assert (got.position.values == want.position.values).all()
    assert (got.group_size.values == rows.groupby("g").id.transform("size").values).all()


def test_no_cell_is_large(spark, rows):
    df = spark.createDataFrame(rows.assign(v=Decimal("0.00"))).withColumn("_spread", F.xxhash64("id"))
    placed = place(df, ["g"], [F.col("v").asc(), F.col("_spread").asc()], 20)
    assert placed.groupBy("_cell").count().agg(F.max("count")).first()[0] <= 250


@pytest.mark.parametrize("cells", [4, 1, None])
@pytest.mark.parametrize("descending", [False, True])
def test_null_and_nan_come_last(spark, cells, descending):
    data = [(i, float(i % 6)) for i in range(12)] + [(12, None), (13, float("nan")), (14, None), (15, float("nan"))]
    df = spark.createDataFrame(data, "id int, v double")
    got = {r.id: r.position for r in positions(df, [], "v", "id", descending=descending, cells=cells).collect()}
    assert sorted(range(12, 16), key=got.get) == [13, 15, 12, 14] and {got[i] for i in range(12, 16)} == {13, 14, 15, 16}
    first = sorted(range(12), key=lambda i: (-(i % 6) if descending else i % 6, i))
    assert [got[i] for i in first] == list(range(1, 13))


@pytest.mark.parametrize("cells", [5, 1])
def test_null_probe_time_finds_nothing(spark, cells):
    probes = spark.createDataFrame([("a", None, 1), ("a", 7, 2), ("a", 1, 3)], "k string, at int, n int")
    events = spark.createDataFrame([("a", 2, 10), ("a", 5, 20)], "k string, t int, x int")
    got = {r.n: r.x for r in asof_join(probes, events, ["k"], "at", "t", ["x"], cells=cells).collect()}
    assert got == {1: None, 2: 20, 3: None}


@pytest.mark.parametrize("cells", [6, 1])
def test_sums_and_leads_of_nulls(spark, cells):
    data = [(i, None if i < 5 or i % 3 == 0 else i) for i in range(20)]
    df = spark.createDataFrame(data, "t int, w int")
    rows = scan(df, [], "t", Scan(sums={"cum": "w"}, lasts={"last": "w"}, leads={"nxt": "w"}), cells=cells).orderBy("t").collect()
    seen = [w for _, w in data]
    assert [r.nxt for r in rows] == seen[1:] + [None]
    assert [r["cum"] for r in rows] == [sum(w for w in seen[: i + 1] if w) or None for i in range(20)]
    assert [r["last"] for r in rows] == [next((w for w in reversed(seen[: i + 1]) if w), None) for i in range(20)]


def test_running_sum_and_next_value(spark, rows):
    df = spark.createDataFrame(rows)
    got = scan(df, ["g"], "id", Scan(sums={"cum": "w"}, leads={"nxt": "w"}), cells=33)
    got = got.toPandas().sort_values("id")
    want = rows.sort_values("id")
    assert (got.cum.values == want.groupby("g").w.cumsum().values).all()
    assert np.allclose(got.nxt.astype(float), want.groupby("g").w.shift(-1).astype(float),
                       equal_nan=True)


def test_rows_are_shuffled_once(spark):
    """Groups over many parts, in one part, null groups and a NaN group: the carried rows are few
    and broadcast, whatever the number of groups."""
    groups = [float("nan"), None, -1.0, 2.0] + [10.0 + i for i in range(60)]
    data = [(x, j, "k" if j % 2 else None, j) for x in groups for j in range(40 if x == 2.0 or x is None else 3)]
    df = spark.createDataFrame(data, "g double, t int, h string, w int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scan(df, ["g", "h"], "t", Scan({"cum": "w"}, {"last": "w"}, {"nxt": "w"}, {"all": "w"}), cells=17)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert len(got) == len(data)
    name = lambda x: "nan" if x is not None and x != x else x
    for r in got:
        mine = sorted(w for g, _, h, w in data if name(g) == name(r.g) and h == r.h)
        later = [w for w in mine if w > r.w]
        assert (r.cum, r["last"], r.nxt, r["all"]) == (
            sum(w for w in mine if w <= r.w), r.w, later[0] if later else None, sum(mine))


def test_average_ranks(spark, rows):
    got = average_ranks(spark.createDataFrame(rows), ["g"], "v", "r", 40).toPandas()
    got = got.sort_values("id")
    assert np.allclose(got.r.values, rows.groupby("g").v.rank().values)


def test_exact_quantiles(spark, rows):
    got = exact_quantiles(spark.createDataFrame(rows), ["g"], "v", {"a": 0.1, "b": 0.73},
                          cells=40).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b"]].astype(float), part.v.quantile([0.1, 0.73]))


@pytest.mark.parametrize("cells", [25, 1, None])
def test_asof_is_inclusive_and_splits(spark, cells):
    rng = np.random.default_rng(1)
    events = pd.DataFrame({"k": rng.choice(list("ab"), 300, p=[0.9, 0.1]),
                           "t": rng.integers(0, 400, 300), "x": range(300)})
    events = events.drop_duplicates(["k", "t"])
    probes = pd.DataFrame({"k": rng.choice(list("abc"), 400), "at": rng.integers(0, 400, 400),
                           "n": range(400)})
    got = asof_join(spark.createDataFrame(probes), spark.createDataFrame(events), ["k"], "at",
                    "t", ["x"], cells=cells).toPandas().sort_values("n")
    want = pd.merge_asof(probes.sort_values("at"), events.sort_values("t"), left_on="at",
                         right_on="t", by="k").sort_values("n")
    assert len(got) == 400
    assert np.allclose(got.x.astype(float), want.x.astype(float), equal_nan=True)


@pytest.mark.parametrize("size", [1, 3, 4, 10, 11, 23])
def test_bands(spark, size):
    df = spark.range(1, size + 1).select(
        F.col("id").alias("p"), ntile(F.col("id"), F.lit(size), 4).alias("q"),
        decile(F.col("id"), F.lit(size)).alias("d"))
    from pyspark.sql import Window

    got = df.withColumn("want", F.ntile(4).over(Window.orderBy("p"))).toPandas()
    assert (got.q == got.want).all()
    assert (got.d.values == (np.arange(size) * 10 // size) + 1).all()
