"""Readers and writers as queries: given tables go out in a format, come back, and are compared.

Everything is written below the shared checkpoint folder, under a name of its own for each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.operators.evaluation import with_one_row
from loanweave.operators.findings import union
from loanweave.operators.validation import validate
from loanweave.plans.catalog import Source, query
from loanweave.session import checkpoint_dir
from loanweave.sources import readers, writers
from loanweave.sources.contracts import Column, Contract, ForeignKey

SUPPLIER = Contract(
    "supplier",
    (Column("s_suppkey", "long", low=0), Column("s_name", "string"), Column("s_nationkey", "integer", low=0, high=24),
     Column("s_acctbal", "decimal")),
    ("s_suppkey",),
    (ForeignKey("s_nationkey", "nation", "n_nationkey"),),
)
CUSTOMER = Contract(
    "customer",
    (Column("c_custkey", "long"), Column("c_name", "string"), Column("c_nationkey", "integer"),
     Column("c_acctbal", "decimal"), Column("c_mktsegment", "string")),
    ("c_custkey",),
    source_format="csv",
)
NATION = Contract(
    "nation",
    (Column("n_nationkey", "integer"), Column("n_name", "string"), Column("n_regionkey", "integer")),
    ("n_nationkey",),
    source_format="asc",
)
REGION = Contract(
    "region", (Column("r_regionkey", "integer"), Column("r_name", "string")), ("r_regionkey",), source_format="json")
FORMATS = {c.name: c for c in (SUPPLIER, CUSTOMER, NATION, REGION)}


def folder(s: Source, name: str) -> str:
    return f"{checkpoint_dir(s.spark)}/io-{name}-{uuid.uuid4().hex}"


def _as_array(df: DataFrame) -> DataFrame:
    """One JSON array of all rows: for tables of a few rows, as public series are."""
    return df.agg(F.to_json(F.sort_array(F.collect_list(F.struct("*")))).alias("value"))


@query(
    "scenario_folder",
    "S3 S4",
    """SELECT 'supplier' AS name, count(*) AS n, sum(s_suppkey)::bigint AS keys, sum(cast(s_acctbal AS decimal(18,2)))::double
            AS amount, count(DISTINCT s_name) AS names FROM supplier
        UNION ALL SELECT 'customer', count(*), sum(c_custkey)::bigint, sum(cast(c_acctbal AS decimal(18,2)))::double,
            count(DISTINCT c_name) FROM customer
        UNION ALL SELECT 'nation', count(*), sum(n_nationkey)::bigint, NULL, count(DISTINCT n_name) FROM nation
        UNION ALL SELECT 'region', count(*), sum(r_regionkey)::bigint, NULL, count(DISTINCT r_name) FROM region""",
)
def scenario_folder(s: Source) -> DataFrame:
    """Four tables in four formats in one folder; two more contracts have no file there."""
    at = folder(s, "scenario")
    s.raw("supplier").write.parquet(f"{at}/supplier.parquet")
    s.raw("customer").write.option("header", True).csv(f"{at}/customer.csv")
    words = s.raw("nation").select(F.concat_ws(" ", *[F.regexp_replace(F.col(c).cast("string"), r"\s", "_")
                                                      for c in NATION.names]).alias("value"))
    words.write.text(f"{at}/nation.asc")
    _as_array(s.raw("region").select(F.col("r_regionkey").cast("string"), "r_name")).write.text(f"{at}/region.json")
    absent = {"part": CUSTOMER, "orders": CUSTOMER}
    found = readers.load_scenario(s.spark, at, {**FORMATS, **absent})
    out = []
    for name, df in found.items():
        rows = readers.typed(df, FORMATS[name])
        key, label = [c for c in rows.columns if c.endswith("key")][0], [c for c in rows.columns if c.endswith("name")][0]
        money = [c for c in rows.columns if c.endswith("acctbal")]
        out.append(rows.agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(key).cast("bigint").alias("keys"),
            (F.sum(money[0]) if money else F.lit(None)).cast("double").alias("amount"),
            F.count_distinct(label).alias("names")))
    return union(out)


@query(
    "tagged_runs",
    "S2 S7",
    """SELECT 'run-' || o_orderstatus AS run_id, 'suite' AS suite_id, 7::bigint AS seed, count(*) AS n,
        sum(cast(o_totalprice AS decimal(18,2)))::double AS amount, min(o_orderkey) AS first_key
        FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""",
)
def tagged_runs(s: Source) -> DataFrame:
    """Two runs written as table sets, read back as one table with the tags of their runs."""
    at = folder(s, "runs")
    runs = []
    for status in ("F", "O"):
        where = f"{at}/{status}"
        writers.write_tables({"orders": s.raw("orders").filter(F.col("o_orderstatus") == status)}, where)
        runs.append({"source_path": where, "run_id": f"run-{status}", "suite_id": "suite", "seed": 7})
    return readers.union_runs(s.spark, runs, "orders").groupBy("run_id", "suite_id", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"),
        F.min("o_orderkey").alias("first_key"))


@query(
    "macro_series",
    "S5",
    """SELECT 'public_bcb_observation' AS source_type, 'orders' AS source_id, 1 AS series_code,
        strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS reference_date,
        cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS value, 'unit' AS unit, false AS is_synthetic
        FROM orders WHERE date_trunc('month', o_orderdate) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 4""",
)
def macro_series(s: Source) -> DataFrame:
    """Monthly totals written as the public series come, with a day and a number that do not parse."""
    at = folder(s, "series") + "/orders.json"
    monthly = s.raw("orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v")).select(
        F.date_format("m", "dd/MM/yyyy").alias("data"), F.col("v").cast("string").alias("valor"))
    odd = s.spark.sql("SELECT '31/02/1997' AS data, '1.0' AS valor")
    _as_array(monthly.unionByName(odd)).write.text(at)
    return readers.read_macro_series(s.spark, at, "orders", 1, "unit", "1996-01-01", "1999-12-31").drop("retrieved_at")


@query(
    "published_tables",
    "S8",
    """SELECT 'good' AS version, true AS published, (SELECT count(*) FROM supplier) AS n
        UNION ALL SELECT 'orphans', false, (SELECT count(*) FROM supplier)
        UNION ALL SELECT 'good again', false, (SELECT count(*) FROM supplier)""",
)
def published_tables(s: Source) -> DataFrame:
    """A version that passes its audit is published; one with orphans and a second one under the
    same name are refused, and the first stays readable."""
    at = folder(s, "published") + "/tables"

    def audit(tables):
        return validate(SUPPLIER, tables)

    nations = s.raw("nation")
    versions = {
        "good": {"supplier": s.raw("supplier"), "nation": nations},
        "orphans": {"supplier": s.raw("supplier"), "nation": nations.filter("n_nationkey > 3")},
        "good again": {"supplier": s.raw("supplier"), "nation": nations},
    }
    rows = []
    for name, tables in versions.items():
        try:
            writers.publish(tables, at, audit)
            rows.append((name, True))
        except writers.PublishRefused:
            rows.append((name, False))
    done = s.spark.createDataFrame(rows, "version string, published boolean")
    size = s.spark.read.parquet(f"{at}/supplier.parquet").agg(F.count(F.lit(1)).alias("n"))
    return with_one_row(done, size)


@query(
    "exported_table",
    "S9",
    """SELECT o_orderpriority, count(*) AS n, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS amount,
        true AS refused FROM orders GROUP BY 1""",
)
def exported_table(s: Source) -> DataFrame:
    """An aggregate goes out as CSV and is read back; a table with customer ids is refused."""
    at = folder(s, "export")
    total = s.raw("orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    writers.export_csv(total, f"{at}/total.csv")
    try:
        writers.export_csv(s.raw("orders").withColumnRenamed("o_custkey", "customer_id"), f"{at}/rows.csv")
        refused = False
    except writers.ExportRefused:
        refused = True
    back = s.spark.read.option("header", True).csv(f"{at}/total.csv")
    return back.select("o_orderpriority", F.col("n").cast("bigint").alias("n"),
                       F.col("amount").cast("double").alias("amount"), F.lit(refused).alias("refused"))


@query(
    "quarantined_events",
    "S10 Q2",
    """SELECT event_type, count(*) AS n, min(event_id) AS first_event FROM (SELECT * FROM events
        UNION ALL SELECT * FROM events WHERE event_type = 'purchase') WHERE event_type = 'error' OR value > 90
        GROUP BY 1""",
)
def quarantined_events(s: Source) -> DataFrame:
    """Two batches append what they set aside; both are read back."""
    at = folder(s, "quarantine")
    for batch in (s.raw("events"), s.raw("events").filter(F.col("event_type") == "purchase")):
        reasons = F.array_compact(F.array(F.when(F.col("event_type") == "error", "error_event"),
                                          F.when(F.col("value") > 90, "value_out_of_range")))
        marked = batch.withColumn("quarantine_reasons", reasons).filter(F.size("quarantine_reasons") > 0)
        writers.write_quarantine(marked, at)
    return s.spark.read.parquet(at).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(
    "selected_runs",
    "S12",
    """SELECT 'suite' AS asked, 'ok' AS outcome, 3 * count(*) AS applications FROM orders
        UNION ALL SELECT 'one run', 'ok', count(*) FROM orders UNION ALL SELECT 'unknown run', 'refused', 0
        UNION ALL SELECT 'failed run', 'refused', 0 UNION ALL SELECT 'nothing', 'refused', 0""",
)
def selected_runs(s: Source) -> DataFrame:
    """The gate over the manifests of the portfolio's runs, and of one that failed."""
    runs = s.tables["generation_runs"].select(
        "run_id", "suite_id", "status", F.lit(True).alias("validation_passed"),
        F.col("config_hash").alias("global_content_hash"), "contract_version_set", "planned_applications")
    failed = runs.filter(F.col("run_id") == "RUN_stress").withColumns(
        {"run_id": F.lit("RUN_failed"), "suite_id": F.lit("other"), "status": F.lit("failed")})
    runs = runs.unionByName(failed)
    rows = []
    for name, asked in (("suite", {"suite_id": "SUITE_star"}), ("one run", {"run_ids": ["RUN_stress"]}),
                        ("unknown run", {"run_ids": ["RUN_x"]}), ("failed run", {"run_ids": ["RUN_failed"]}), ("nothing", {})):
        try:
            found = readers.select_sources(runs, **asked).agg(F.sum("planned_applications")).first()[0]
            rows.append((name, "ok", found))
        except readers.SourceError:
            rows.append((name, "refused", 0))
    return s.spark.createDataFrame(rows, "asked string, outcome string, applications bigint")
