"""The derived portfolio: what is stored, and that rows of a contract meet without a shuffle."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanweave.operators import ledger, profiling
from loanweave.plans import star

DAY = dt.datetime(1996, 3, 1)


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(star, "BUCKET_LINES", 20)
    monkeypatch.setattr(star, "_buckets", {})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    orders = [(k, k % 7, "FOP"[k % 3], 1000.0 + k, DAY + dt.timedelta(days=k), "1-URGENT") for k in range(40)]
    orders.append(orders[2])
    lines = [(k, 3 * k + n, k + n, n, 1.0 * n, 100.0 * n + k, 0.05, 0.02, "NAR"[n % 3],
              DAY + dt.timedelta(days=k + n)) for k in range(40) for n in range(1, 4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, "
                          "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledger_is_built_without_a_shuffle(spark, folder):
    t = star.StarPortfolio(spark, folder)
    assert t._parts() > 1
    for name in ("_steps", "_ledger", "installments"):
        built = getattr(t, "build_" + name.lstrip("_"))()
        assert "Exchange" not in _plan(built), name
    history = t["account_monthly_snapshots"].join(t["contracts"], ledger.CONTRACT)
    assert "Exchange" not in _plan(history)


def test_projections_are_not_stored(spark, folder):
    t = star.StarPortfolio(spark, folder)
    t["account_monthly_snapshots"].count()
    t["payment_allocations"].count()
    stored = {n for (_, n) in star._written if (t._session(), n) in star._written}
    assert stored == {"_orders", "_lines", "contracts", "_steps", "_ledger"}


def test_contract_in_the_payment_key_changes_no_movement(spark, folder):
    t = star.StarPortfolio(spark, folder)
    by_id = ledger.settled_movements(t["payment_allocations"], t["payments"])
    own = ledger.settled_movements(t["payment_allocations"], t["payments"], [*ledger.CONTRACT, "payment_id"])
    assert by_id.count() > 0
    assert by_id.exceptAll(own).count() == own.exceptAll(by_id).count() == 0


def test_repeated_orders_keep_their_rows(spark, folder):
    t = star.StarPortfolio(spark, folder)
    two = t["applications"].filter(F.col("application_id") == 2)
    assert two.count() == 2 * len(star.RUNS)
    runs = {r["run_id"]: r["n"] for r in t["_schedule"].filter("contract_id = 2").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert runs == {}  # status P is booked by no run, except multiples of three by the expansion
    assert t["_schedule"].filter("contract_id = 5").count() == 0
    assert t["_schedule"].filter("contract_id = 1").count() == 3 * len(star.RUNS)


def test_top_values_of_a_long_column_stay_apart(spark):
    rows = [("a", f"text {i}") for i in range(50)] + [("b", None), ("b", "text 1")]
    out = profiling.top_values(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted((r["column"], r["value"], r["n"], r["rank"]) for r in out.collect()) == [
        ("lang", "a", 50, 1), ("lang", "b", 2, 2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(profiling.top_values(out.select("column", "value")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_checks_and_marts_are_worked_out_one_at_a_time(spark, folder):
    """The driver never holds the plans of all contracts, tests or marts at once."""
    from loanweave.operators import data_tests, validation
    from loanweave.plans.warehouse import Warehouse
    from loanweave.sources.contracts import OPERATIONAL

    t = star.StarPortfolio(spark, folder)
    names = ("contracts", "payments")
    few = {n: OPERATIONAL[n] for n in names}
    report = validation.validate_all(few, {n: t[n] for n in names}, "strict", ("run_id",))
    assert "Exchange" not in _plan(report) and "MapInArrow" not in _plan(report)
    w = Warehouse(t)
    summary = data_tests.summary({"balance_non_negative": data_tests.balance_non_negative(w.account_monthly)})
    assert [(r.test, r.violations) for r in summary.collect()] == [("balance_non_negative", 0)]
    assert "Aggregate" not in _plan(summary)
    before = w.delinquency
    w.settle("delinquency")
    assert "Aggregate" not in _plan(w.delinquency)
    assert w.delinquency.exceptAll(before).count() == before.exceptAll(w.delinquency).count() == 0
