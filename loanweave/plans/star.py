"""A loan portfolio derived from a star schema of orders and line items.

Orders are applications, their line items are installments. Three runs share the orders:
a baseline, a policy expansion that approves more of them, and a macroeconomic stress run
in which later payments come late. Which order is cancelled, which installment stays unpaid
and so on are attributes derived from the row's own keys; no order and no line is left out.

The derived tables stand where a lender's operational tables would. What takes a shuffle or a
ledger run to derive (orders, applicants, lines, contracts, steps, ledger, installments) is written
once per session to the shared checkpoint folder, in buckets of the order key, and read back from
there, so joins, groups and windows by contract find their rows together. The schedule and the
orders are stored once for all runs; everything else is a projection of these tables.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanweave.functions.buckets import collection_strategy
from loanweave.functions.dates import month_start
from loanweave.functions.money import MONEY, money
from loanweave.operators import ledger
from loanweave.session import checkpoint_dir

SUITE = "SUITE_star"
BASELINE, EXPANSION, STRESS = "RUN_baseline", "RUN_expansion", "RUN_stress"
# (run, scenario, policy)
RUNS = (
    (BASELINE, "baseline", "POL_base"),
    (EXPANSION, "policy_expansion", "POL_wide"),
    (STRESS, "macroeconomic_stress", "POL_base"),
)
SEED, SCALE, VERSION = 42, "sample", "star-1"
SHOCK = "1999-01-01"
SHOCK_DELAY_DAYS = 45
CHARGE_OFF_DPD = 180
TAIL_DAYS = 240

TABLES = (
    "generation_runs", "policy_versions", "customers", "applications", "application_features",
    "fairness_attributes", "credit_decisions", "contracts", "installments", "payments",
    "payment_allocations", "account_monthly_snapshots", "write_off_events", "recovery_events",
    "collection_events", "macro_context_monthly",
)

# Stored in buckets of the given column; SMALL ones are stored as they are.
BUCKETED = {
    "_orders": "o_orderkey", "_applicants": "o_orderkey", "_lines": "contract_id",
    "_steps": "contract_id", "_ledger": "contract_id", "contracts": "contract_id",
    "installments": "contract_id",
}
SMALL = ("generation_runs", "macro_context_monthly")
BUCKET_LINES = 100_000  # line items of a bucket, on average

_written: dict[tuple[str, str], str] = {}
_buckets: dict[str, int] = {}
_lock = threading.Lock()


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scenario(run: Column) -> Column:
    out = F.when(run == RUNS[0][0], RUNS[0][1])
    for r, s, _ in RUNS[1:]:
        out = out.when(run == r, s)
    return out


def tagged(df: DataFrame) -> DataFrame:
    """Run attributes next to run_id, as every portfolio table carries them."""
    run = F.col("run_id")
    rest = [c for c in df.columns if c != "run_id"]
    return df.select(
        "run_id",
        F.lit(SUITE).alias("suite_id"),
        _scenario(run).alias("scenario"),
        F.lit(SEED).cast("bigint").alias("seed"),
        F.lit(SCALE).alias("scale"),
        F.lit(VERSION).alias("generator_version"),
        *rest,
    )


def _per_run(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array(*[F.lit(r[0]) for r in RUNS])).alias("run_id"), *df.columns)


def _decided(orders: DataFrame) -> DataFrame:
    """One row per run and order, with the decision of that run (NULL when cancelled)."""
    cancelled = F.col("o_orderkey") % 10 == 0
    approved = F.col("o_orderstatus").isin("F", "O") | (
        (F.col("run_id") == EXPANSION) & (F.col("o_orderkey") % 3 == 0)
    )
    return _per_run(orders).withColumn(
        "outcome", F.when(~cancelled, F.when(approved, "approved").otherwise("rejected"))
    )


def _lines(lineitem: DataFrame, orders: DataFrame, parts: int) -> DataFrame:
    """Line items of booked orders as numbered installments, with the runs that book them."""
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    ).repartition(parts, "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag",
    )
    price, disc, tax = (F.col(c).cast("decimal(12,2)") for c in
                        ("l_extendedprice", "l_discount", "l_tax"))
    numbered = li.select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_partkey", "l_suppkey", "l_returnflag",
        F.row_number().over(order).alias("installment_number"),
        money(price * (1 - disc)).alias("scheduled_principal"),
        money(price * tax).alias("scheduled_interest"),
    )
    usual = F.col("o_orderstatus").isin("F", "O")
    wide = usual | (F.col("o_orderkey") % 3 == 0)
    runs = F.array_compact(
        F.array(F.when(usual, BASELINE), F.when(wide, EXPANSION), F.when(usual, STRESS))
    )
    booked = orders.filter(F.col("o_orderkey") % 10 != 0).select(
        "o_orderkey", "o_custkey", "o_orderdate", runs.alias("runs")
    ).filter(F.size("runs") > 0)
    return numbered.join(booked, "o_orderkey").select(
        "runs",
        F.col("o_orderkey").alias("contract_id"),
        F.col("o_custkey").alias("customer_id"),
        "o_orderdate", "l_partkey", "l_suppkey", "l_returnflag", "installment_number",
        "scheduled_principal", "scheduled_interest",
    )


def _schedule(lines: DataFrame) -> DataFrame:
    """The installments of every run; what the runs have in common is worked out before they part."""
    shared = lines.select(
        "runs", "contract_id", "customer_id", "o_orderdate", "l_partkey", "l_suppkey", "l_returnflag",
        F.concat_ws("-", "contract_id", "installment_number").alias("installment_id"),
        "installment_number",
        F.expr("add_months(cast(o_orderdate as date), installment_number)").alias("due_date"),
        "scheduled_principal",
        "scheduled_interest",
        F.lit(0).cast(MONEY).alias("scheduled_fees"),
        (F.col("scheduled_principal") + F.col("scheduled_interest")).cast(MONEY)
        .alias("scheduled_total"),
    )
    return shared.select(F.explode("runs").alias("run_id"), *shared.columns[1:])


def _paid(schedule: DataFrame) -> DataFrame:
    """Payments of the paid installments: one, or one, its reversal and a second one."""
    delay = F.when(F.col("l_partkey") % 4 == 0, F.col("l_suppkey") % 75).otherwise(0)
    shock = F.when(
        (F.col("run_id") == STRESS) & (F.col("due_date") >= F.lit(SHOCK).cast("date")),
        SHOCK_DELAY_DAYS,
    ).otherwise(0)
    first = F.date_add("due_date", (delay + shock).cast("int"))
    bounced = F.col("l_partkey") % 13 == 0

    def entry(tag: str, shift: int) -> Column:
        return F.struct(
            F.lit(tag).alias("tag"), F.date_add("paid_on", shift).alias("day")
        )

    entries = F.when(
        F.col("bounced"), F.array(entry("P1", 0), entry("R1", 5), entry("P2", 40))
    ).otherwise(F.array(entry("P1", 0)))
    rows = (
        schedule.filter(F.col("l_partkey") % 17 != 0)
        .withColumn("late", delay)
        .withColumn("paid_on", first)
        .withColumn("bounced", bounced)
        .withColumn("e", F.explode(entries))
    )
    pid = F.concat_ws("-", "installment_id", F.col("e.tag"))
    kind = (
        F.when(F.col("late") >= 30, "cure")
        .when(F.col("late") > 0, "partial")
        .when(F.col("l_partkey") % 5 == 0, "prepayment")
        .otherwise("scheduled")
    )
    channel = (
        F.when(F.col("l_returnflag") == "R", "app")
        .when(F.col("l_returnflag") == "A", "web")
        .otherwise("bank_slip")
    )
    return rows.select(
        "run_id",
        pid.alias("payment_id"),
        "contract_id",
        "customer_id",
        "installment_id",
        F.col("e.day").cast("timestamp").alias("payment_timestamp"),
        F.col("scheduled_total").alias("amount"),
        channel.alias("channel"),
        F.lit("settled").alias("status"),
        F.col("e.day").alias("settlement_date"),
        F.when(F.col("e.tag") == "R1", F.concat_ws("-", "installment_id", F.lit("P1")))
        .alias("reversal_of_payment_id"),
        kind.alias("payment_type"),
        "scheduled_principal", "scheduled_interest", "scheduled_fees", "scheduled_total",
    )


class StarPortfolio(Mapping[str, DataFrame]):
    """Portfolio tables of one star-schema folder, built on first use."""

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def __contains__(self, name: object) -> bool:
        return name in TABLES

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # Rows in buckets of contract_id also lie together by (run_id, contract_id, ...).
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def __getitem__(self, name: str) -> DataFrame:
        """The table: the copy written in this session, or a projection of such copies."""
        working = ("_orders", "_applicants", "_lines", "_schedule", "_paid", "_steps", "_ledger")
        if name not in TABLES and name not in working:
            raise KeyError(name)
        build = getattr(self, "build_" + name.lstrip("_"))
        if name not in BUCKETED and name not in SMALL:
            return build()
        key = (self._session(), name)
        with _lock:
            table = _written.get(key)
        if table is None:
            table = self._store(name, build())
            with _lock:
                table = _written.setdefault(key, table)
        kept = self.spark.table(table)
        if name not in BUCKETED:
            return kept
        return kept.select(*[
            F.col("_key").alias(BUCKETED[name]) if c == "_key" else F.col(c) for c in kept.columns
        ])

    def _session(self) -> str:
        return f"{self.spark.sparkContext.applicationId}:{self.sf_dir}"

    def _store(self, name: str, built: DataFrame) -> str:
        table = f"star_{name.lstrip('_')}_{uuid.uuid4().hex}"
        if name in BUCKETED:
            # A name of its own: Spark sees that parts of a union lie alike only if their key
            # carries no table name, which a renamed column does not.
            built = built.withColumnRenamed(BUCKETED[name], "_key")
        out = built.write.option("path", f"{checkpoint_dir(self.spark)}/{table}").option("compression", "zstd")
        if name in BUCKETED:
            out = out.bucketBy(self._parts(), "_key")
        out.format("parquet").saveAsTable(table)
        return table

    def _parts(self) -> int:
        """Buckets of the stored tables: by the line items, no fewer than cores."""
        key = self._session()
        if key not in _buckets:
            lines = raw(self.spark, self.sf_dir, "lineitem").count()
            _buckets[key] = max(self.spark.sparkContext.defaultParallelism, -(-lines // BUCKET_LINES))
        return _buckets[key]

    # Working tables shared by several portfolio tables.

    def build_orders(self) -> DataFrame:
        return raw(self.spark, self.sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
            "o_orderpriority",
        ).repartition(self._parts(), "o_orderkey")

    def build_applicants(self) -> DataFrame:
        """Orders with their customer."""
        o = self["_orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        c = raw(self.spark, self.sf_dir, "customer").select(
            "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
        )
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).repartition(
            self._parts(), "o_orderkey"
        )

    def build_lines(self) -> DataFrame:
        return _lines(raw(self.spark, self.sf_dir, "lineitem"), self["_orders"], self._parts())

    def build_schedule(self) -> DataFrame:
        return _schedule(self["_lines"])

    def build_paid(self) -> DataFrame:
        return _paid(self["_schedule"])

    def build_ledger(self) -> DataFrame:
        contracts = self["contracts"].select("run_id", "contract_id", "disbursement_date")
        return ledger.monthly_ledger(
            contracts, self["_schedule"], self["_steps"], CHARGE_OFF_DPD, TAIL_DAYS
        )

    def build_steps(self) -> DataFrame:
        return ledger.installment_steps(
            self["_schedule"],
            # A payment's id begins with its contract's.
            ledger.settled_movements(
                self["payment_allocations"], self["payments"], [*ledger.BY_CONTRACT, "payment_id"]
            ),
        )

    # Portfolio tables.

    def build_generation_runs(self) -> DataFrame:
        span = raw(self.spark, self.sf_dir, "orders").agg(
            F.min("o_orderdate").cast("date").alias("period_start"),
            F.max("o_orderdate").cast("date").alias("period_end"),
            F.countDistinct("o_custkey").cast("int").alias("planned_customers"),
            F.count(F.lit(1)).cast("int").alias("planned_applications"),
        )
        per_run = span.withColumn("run_id", F.explode(F.array(*[F.lit(r[0]) for r in RUNS])))
        return tagged(per_run).select(
            "*",
            F.col("run_id").alias("generation_run_id"),
            F.lit("1").alias("config_version"),
            F.lit("2001-12-31 00:00:00").cast("timestamp").alias("generated_at"),
            F.substring(F.md5("run_id"), 1, 16).alias("config_hash"),
            F.lit("1").alias("contract_version_set"),
            F.lit("completed").alias("status"),
            F.lit(True).alias("is_synthetic"),
            F.when(F.col("run_id") != BASELINE, BASELINE).alias("parent_run_id"),
        )

    def build_policy_versions(self) -> DataFrame:
        used = self["generation_runs"].select("run_id", "scenario", "period_start")
        wide = F.col("run_id") == EXPANSION
        return tagged(
            used.select(
                "run_id",
                F.when(wide, "POL_wide").otherwise("POL_base").alias("policy_version_id"),
                F.when(wide, "wide policy").otherwise("base policy").alias("name"),
                F.lit(1).alias("version"),
                F.col("period_start").cast("timestamp").alias("effective_from"),
                F.lit(None).cast("timestamp").alias("effective_to"),
                F.lit("active").alias("status"),
                F.when(wide, "rules/wide").otherwise("rules/base").alias("rules_reference"),
                F.when(wide, "wider approval").alias("change_reason"),
            )
        )

    def build_customers(self) -> DataFrame:
        c = raw(self.spark, self.sf_dir, "customer")
        run = F.explode(F.array(*[F.lit(r[0]) for r in RUNS])).alias("run_id")
        return tagged(
            c.select(
                run,
                F.col("c_custkey").alias("customer_id"),
                F.col("run_id").alias("generation_run_id"),
                F.lit("1995-01-01 00:00:00").cast("timestamp").alias("created_at"),
            )
        )

    def build_applications(self) -> DataFrame:
        return tagged(
            _decided(self["_orders"]).select(
                "run_id",
                F.col("o_orderkey").alias("application_id"),
                F.col("o_custkey").alias("customer_id"),
                F.col("run_id").alias("generation_run_id"),
                F.col("o_orderdate").cast("timestamp").alias("submitted_at"),
                F.lit("personal_loan").alias("product"),
                F.col("o_orderpriority").alias("channel"),
                money("o_totalprice").alias("requested_amount"),
                F.lit(12).alias("requested_term_months"),
                F.coalesce("outcome", F.lit("cancelled")).alias("status"),
            )
        )

    def build_application_features(self) -> DataFrame:
        bureau = F.create_map(*[F.lit(x) for x in (
            "AUTOMOBILE", "thin_file", "BUILDING", "low", "FURNITURE", "medium",
            "HOUSEHOLD", "high", "MACHINERY", "medium")])
        income = F.greatest(F.col("c_acctbal"), F.lit(0.0))
        amount = money("o_totalprice")
        return tagged(
            _per_run(self["_applicants"]).select(
                "run_id",
                F.col("o_orderkey").alias("application_id"),
                money(income).alias("declared_income"),
                F.when(F.col("c_nationkey") % 7 != 0, amount.cast("double") / 200000)
                .alias("debt_to_income"),
                (F.col("o_custkey") % 240).cast("int").alias("employment_months"),
                (F.col("o_custkey") % 60).cast("int").alias("relationship_months"),
                bureau[F.col("c_mktsegment")].alias("bureau_score_bucket"),
                amount.alias("requested_amount"),
                F.lit(12).alias("requested_term_months"),
                F.col("o_orderdate").cast("timestamp").alias("feature_snapshot_at"),
            )
        )

    def build_fairness_attributes(self) -> DataFrame:
        n = raw(self.spark, self.sf_dir, "nation")
        r = raw(self.spark, self.sf_dir, "region")
        places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", "r_name"
        )
        joined = self["_applicants"].join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        ages = F.array(*[F.lit(a) for a in ("18-25", "26-35", "36-50", "51-65", "65+")])
        genders = F.array(*[F.lit(g) for g in ("a", "b", "unspecified")])
        return tagged(
            _per_run(joined).select(
                "run_id",
                F.col("o_orderkey").alias("application_id"),
                ages[(F.col("o_custkey") % 5).cast("int")].alias("age_bracket"),
                genders[(F.col("o_custkey") % 3).cast("int")].alias("synthetic_gender"),
                F.col("r_name").alias("region"),
            )
        )

    def build_credit_decisions(self) -> DataFrame:
        ok = F.col("outcome") == "approved"
        amount = money("o_totalprice")
        return tagged(
            _decided(self["_orders"]).filter(F.col("outcome").isNotNull()).select(
                "run_id",
                F.concat(F.lit("D"), F.col("o_orderkey")).alias("decision_id"),
                F.col("o_orderkey").alias("application_id"),
                F.when(F.col("run_id") == EXPANSION, "POL_wide").otherwise("POL_base")
                .alias("policy_version_id"),
                F.col("o_orderdate").cast("timestamp").alias("decision_timestamp"),
                "outcome",
                F.when(~ok, "score_below_cutoff").alias("reason_code"),
                F.when(ok, amount).alias("approved_amount"),
                F.when(ok, 12).alias("approved_term_months"),
                F.when(ok, F.lit(0.02)).alias("offered_rate"),
                F.lit(True).alias("is_final"),
                F.lit("star-1").alias("logic_version"),
            )
        )

    def build_contracts(self) -> DataFrame:
        per = self["_schedule"].groupBy("run_id", "contract_id", "customer_id", "o_orderdate").agg(
            F.sum("scheduled_principal").cast(MONEY).alias("financed_amount"),
            F.sum("scheduled_interest").alias("interest"),
            F.count(F.lit(1)).cast("int").alias("term_months"),
            F.min("due_date").alias("first_due_date"),
        )
        day = F.col("o_orderdate").cast("timestamp")
        return tagged(
            per.select(
                "run_id",
                "contract_id",
                F.col("contract_id").alias("application_id"),
                "customer_id",
                day.alias("contract_date"),
                day.alias("disbursement_date"),
                "financed_amount",
                "term_months",
                (F.col("interest").cast("double") / F.col("financed_amount").cast("double"))
                .alias("contract_rate"),
                F.col("term_months").alias("num_installments"),
                "first_due_date",
                F.lit("active").alias("status"),
                F.lit("synthetic_unit").alias("currency_unit"),
                F.lit(None).cast("timestamp").alias("closed_date"),
            )
        )

    def build_installments(self) -> DataFrame:
        lost = self["write_off_events"].select("run_id", "contract_id")
        done = ledger.installment_status(
            self["_schedule"], self["_steps"], lost, F.lit("2001-12-31").cast("date")
        )
        return tagged(
            done.select(
                "run_id", "contract_id", "installment_id", "installment_number", "due_date",
                "scheduled_principal", "scheduled_interest", "scheduled_fees", "scheduled_total",
                "status", "outstanding_balance",
            )
        )

    def build_payments(self) -> DataFrame:
        return tagged(
            self["_paid"].select(
                "run_id", "payment_id", "contract_id", "customer_id", "payment_timestamp",
                "amount", "channel", "status", "settlement_date", "reversal_of_payment_id",
                "payment_type",
            )
        )

    def build_payment_allocations(self) -> DataFrame:
        return tagged(
            self["_paid"].select(
                "run_id",
                F.concat(F.lit("A-"), F.col("payment_id")).alias("allocation_id"),
                "payment_id",
                "installment_id",
                "contract_id",
                F.col("scheduled_principal").alias("allocated_principal"),
                F.col("scheduled_interest").alias("allocated_interest"),
                F.col("scheduled_fees").alias("allocated_fees"),
                F.col("scheduled_total").alias("allocated_total"),
            )
        )

    def build_account_monthly_snapshots(self) -> DataFrame:
        return tagged(
            self["_ledger"].drop("written_principal", "written_interest", "written_fees")
        )

    def build_write_off_events(self) -> DataFrame:
        return tagged(
            ledger.write_off_events(self["_ledger"]).withColumn(
                "policy_reference", F.lit(f"dpd>={CHARGE_OFF_DPD}")
            )
        )

    def build_recovery_events(self) -> DataFrame:
        return tagged(
            self["write_off_events"].filter(F.col("contract_id") % 2 == 0).select(
                "run_id",
                F.concat(F.lit("RC-"), F.col("contract_id")).alias("recovery_id"),
                "contract_id",
                "write_off_id",
                F.date_add("write_off_date", 60).alias("recovery_date"),
                money(F.col("amount") * F.lit("0.40").cast("decimal(3,2)")).alias("amount"),
                F.lit("collections_agent").alias("channel"),
                F.lit("star").alias("source"),
            )
        )

    def build_collection_events(self) -> DataFrame:
        late = self["_ledger"].filter(
            (F.col("status") == "delinquent") & (F.col("contract_id") % 3 != 0)
        )
        promised = F.col("contract_id") % 2 == 0
        channels = F.array(*[F.lit(c) for c in ("call", "sms", "email", "letter", "in_person")])
        return tagged(
            late.select(
                "run_id",
                F.concat_ws("-", F.lit("CE"), "contract_id", "snapshot_date")
                .alias("collection_event_id"),
                "contract_id",
                F.col("snapshot_date").cast("timestamp").alias("event_timestamp"),
                channels[(F.col("contract_id") % 5).cast("int")].alias("channel"),
                collection_strategy("dpd").alias("strategy"),
                F.when(promised, "promise_to_pay").otherwise("contacted_no_commitment")
                .alias("outcome"),
                promised.alias("promise_to_pay"),
                F.when(promised, F.col("past_due_amount")).alias("promised_amount"),
                F.when(promised, F.date_add("snapshot_date", 7)).alias("promised_date"),
                F.lit("open").alias("status"),
            )
        )

    def build_macro_context_monthly(self) -> DataFrame:
        o = raw(self.spark, self.sf_dir, "orders")
        monthly = o.groupBy(month_start("o_orderdate").alias("reference_date")).agg(
            (F.sum(money("o_totalprice")).cast("double") / F.count(F.lit(1))).alias("value")
        )
        runs = F.explode(F.array(*[F.lit(r[0]) for r in RUNS])).alias("run_id")
        shared = [F.col("reference_date"), F.col("value"), F.lit("unit").alias("unit")]
        observed = monthly.select(
            runs,
            F.lit("public_bcb_observation").alias("source_type"),
            F.lit("series_a").alias("source_id"),
            F.lit(20570).alias("series_code"),
            *shared,
            F.lit(False).alias("is_synthetic"),
        )
        shocked = monthly.filter(F.col("reference_date") >= F.lit(SHOCK).cast("date")).select(
            F.lit(STRESS).alias("run_id"),
            F.lit("synthetic_shock").alias("source_type"),
            F.lit("shock_a").alias("source_id"),
            F.lit(None).cast("int").alias("series_code"),
            *shared,
            F.lit(True).alias("is_synthetic"),
        )
        return tagged(
            observed.unionByName(shocked).withColumn(
                "retrieved_at", F.lit("2001-12-31 00:00:00").cast("timestamp")
            )
        )
