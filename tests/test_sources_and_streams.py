"""Readers, writers, the stream entry and invariances of the marts."""

from __future__ import annotations

import pytest
from paths import SF_DIR
from pyspark.sql import functions as F

from loanweave.operators import alerts, batch_input, marts
from loanweave.operators.fingerprint import same_content, table_fingerprint
from loanweave.operators.findings import static
from loanweave.plans.catalog import Source
from loanweave.plans.monitoring import Monitor
from loanweave.sources import readers, writers
from loanweave.sources.contracts import RAW
from loanweave.streaming import monitor as stream


def test_text_formats(spark, tmp_path):
    (tmp_path / "bcb_sgs_20570.json").write_text(
        '[{"data": "01/01/2024", "valor": "1.5"},\n {"data": "01/02/2024", "valor": "x"}]')
    german = RAW["south_german_credit"]
    (tmp_path / "south_german_credit.asc").write_text(
        " ".join(german.names) + "\n" + " ".join(["1"] * 21) + "\n\n")
    (tmp_path / "uci_default_credit.csv").write_text(
        ",".join(RAW["uci_default_credit"].names) + "\n" + ",".join(["1"] * 25) + "\n")
    t = readers.load_scenario(spark, str(tmp_path), RAW)
    assert sorted(t) == ["bcb_sgs_20570", "south_german_credit", "uci_default_credit"]
    assert [r.valor for r in t["bcb_sgs_20570"].orderBy("data").collect()] == ["1.5", "x"]
    assert t["south_german_credit"].count() == 1
    assert readers.typed(t["uci_default_credit"], RAW["uci_default_credit"]).first().X12 == 1
    macro = readers.read_macro_series(spark, str(tmp_path / "bcb_sgs_20570.json"), "s", 20570,
                                      "unit", "2024-01-01", "2024-01-31").collect()
    assert [(str(r.reference_date), r.value) for r in macro] == [("2024-01-01", 1.5)]


def test_multi_run_union(spark, tmp_path):
    runs = []
    for i in (1, 2):
        writers.write_tables({"customers": spark.range(i).withColumnRenamed("id", "customer_id")},
                             str(tmp_path / f"r{i}"))
        runs.append({"run_id": f"r{i}", "suite_id": "s", "scenario": "baseline", "seed": i,
                     "scale": "smoke", "generator_version": "1",
                     "source_path": str(tmp_path / f"r{i}")})
    df = readers.union_runs(spark, runs, "customers")
    assert {r.run_id: r["count"] for r in df.groupBy("run_id").count().collect()} == {
        "r1": 1, "r2": 2}
    with pytest.raises(readers.SourceError):
        readers.union_runs(spark, [], "customers")


def test_source_selection(spark):
    m = spark.createDataFrame(
        [("a", "s", "completed", True, "h", "1"), ("b", "s", "failed", True, "h", "1"),
         ("c", "t", "completed", True, "h", "1")],
        "run_id string, suite_id string, status string, validation_passed boolean, "
        "global_content_hash string, contract_version_set string")
    assert readers.select_sources(m, suite_id="t").count() == 1
    for bad in ({"run_ids": ["b"]}, {"suite_id": "s"}, {"run_ids": ["z"]}, {}):
        with pytest.raises(readers.SourceError):
            readers.select_sources(m, **bad)


def test_publish_only_what_passes(spark, tmp_path):
    t = {"x": spark.range(3)}
    writers.publish(t, str(tmp_path / "ok"), lambda w: static(spark, []))
    assert spark.read.parquet(str(tmp_path / "ok" / "x.parquet")).count() == 3
    with pytest.raises(writers.PublishRefused):
        writers.publish(t, str(tmp_path / "bad"),
                        lambda w: static(spark, [("E", "error", "x", None)]))
    assert not (tmp_path / "bad").exists()


def test_identifying_columns_do_not_leave(spark, tmp_path):
    with pytest.raises(writers.ExportRefused):
        writers.export_csv(spark.range(1).withColumnRenamed("id", "contract_id"),
                           str(tmp_path / "x"))
    writers.export_csv(spark.range(2), str(tmp_path / "y"))
    assert spark.read.option("header", True).csv(str(tmp_path / "y")).count() == 2


def test_fingerprint_ignores_order_but_not_copies(spark):
    a = spark.range(50).withColumn("v", F.col("id") % 7)
    b = a.repartition(5).orderBy(F.desc("id")).select("v", "id")
    assert same_content(a, b).first().identical
    assert not same_content(a, a.unionByName(a.limit(1))).first().identical
    assert table_fingerprint(a.filter("id < 0")).first().n_rows == 0


def test_marts_do_not_depend_on_partitioning(spark):
    accounts = Source(spark, SF_DIR).wh.account_monthly
    a = marts.delinquency_monthly(accounts)
    b = marts.delinquency_monthly(accounts.repartition(11))
    assert same_content(a, b).first().identical


def test_later_rows_change_no_earlier_mart_row(spark):
    from loanweave.operators.star_models import monthly_history

    wh = Source(spark, SF_DIR).wh
    snaps, contracts = wh.stg("account_monthly_snapshots"), wh.stg("contracts")
    cut = F.col("snapshot_date") <= F.lit("1998-06-30").cast("date")
    whole = monthly_history(snaps, contracts).filter(cut)
    early = monthly_history(snaps.filter(cut), contracts)
    assert same_content(whole, early).first().identical


def test_stream_writes_each_batch_once(spark, tmp_path):
    contract = batch_input.BatchContract("id", ("x",), tolerated=("y", "g"), order_column="id")
    reference = spark.range(300).select(
        "id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 10 / 10.0).alias("x"),
        F.lit("a").alias("g"), (F.col("id") % 10 / 10.0).alias("p"))
    limits = alerts.quality_cutoffs(reference).unionByName(spark.createDataFrame(
        [("psi", 0.1, 0.3, 0, 0, 30), ("psi_family_wise", 0.1, 0.3, 0, 0, 30)],
        alerts.quality_cutoffs(reference).schema))
    mon = Monitor(reference, limits, contract, ("x",), ("g",),
                  lambda df: df.withColumn("p", F.least("x", F.lit(1.0))))
    source = str(tmp_path / "in")
    reference.select("id", "x", "y", "g").coalesce(1).write.parquet(source)
    reference.select("id", (F.col("x") * 5).alias("x"), "y", "g").coalesce(1).write.mode(
        "append").parquet(source)
    raw = spark.readStream.schema("id bigint, x double, y int, g string").option(
        "maxFilesPerTrigger", 1).parquet(source)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream.start(raw, mon, "run", out, check).awaitTermination(300)
    got = stream.read_signals(spark, out).filter(F.col("category") == "feature_drift").collect()
    assert len({r.batch_sequence for r in got}) == 1
    assert {r.metric for r in got} == {"psi__x", "psi_family_wise__x"}
    assert stream.incidents(spark, out).count() == 0
