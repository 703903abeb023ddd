"""The loan ledger: amortization, payment waterfall, balances and days past due over time.

Nothing here needs the rows of a contract in one task. Payments meet due components on ordered
scans, which spread a contract that holds most of the rows. Balances are running totals over
days: whatever happens on a day of a contract or an installment is summed first, without order,
so a window holds at most one row for each day of the calendar, however many rows there are.
Keys are (run_id, contract_id). Windows and joins name the contract first: rows of a bucket differ in
it, which Spark's sort sees in the first eight bytes of the key. Running totals are 64-bit cents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.functions.buckets import TERMINAL_STATUSES, dpd_bucket
from loanweave.functions.dates import month_sequence, month_start
from loanweave.functions.money import LEDGER_TOLERANCE, MONEY, cents, from_cents, money
from loanweave.operators.scan import Scan, scan

CONTRACT = ["run_id", "contract_id"]
INSTALLMENT = [*CONTRACT, "installment_id"]
# The same keys in the order in which rows are sorted.
BY_CONTRACT = ["contract_id", "run_id"]
BY_INSTALLMENT = [*BY_CONTRACT, "installment_id"]
PARTS = ("principal", "interest", "fees", "total")
ORIGIN = "DATE'0001-01-01'"


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _tolerance() -> Column:
    return F.lit(LEDGER_TOLERANCE).cast(MONEY)


# --- schedule --------------------------------------------------------------------------


def amortization_schedule(contracts: DataFrame) -> DataFrame:
    """Level-payment schedule in cents; the last installment takes the rounding residue.

    Reads run_id, contract_id, financed_amount, contract_rate (per period), num_installments
    and first_due_date. Each contract is expanded in its own row, without a shuffle.
    """
    amount = money("financed_amount")
    rate = F.col("contract_rate").cast("decimal(18,8)")
    n = F.col("num_installments")
    r = F.col("contract_rate").cast("double")
    level = F.when(
        r == 0, money(amount.cast("decimal(28,12)") / n)
    ).otherwise(money((amount.cast("double") * r) / (1 - F.pow(1 + r, -n))))

    row = "struct<period:int,principal:decimal(18,2),interest:decimal(18,2)>"
    start = F.struct(
        amount.alias("balance"), F.array().cast(f"array<{row}>").alias("rows")
    )

    def step(state: Column, period: Column) -> Column:
        interest = money(state["balance"] * rate)
        principal = F.when(period < n, money(F.col("_level") - interest)).otherwise(
            state["balance"]
        )
        line = F.struct(
            period.cast("int").alias("period"),
            principal.cast(MONEY).alias("principal"),
            interest.cast(MONEY).alias("interest"),
        ).cast(row)
        return F.struct(
            (state["balance"] - principal).cast(MONEY).alias("balance"),
            F.concat(state["rows"], F.array(line)).alias("rows"),
        )

    periods = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return (
        contracts.withColumn("_level", level)
        .withColumn("_rows", F.aggregate(periods, start, step, lambda s: s["rows"]))
        .select(*CONTRACT, "first_due_date", F.explode("_rows").alias("_row"))
        .select(
            *CONTRACT,
            F.concat_ws("-", "contract_id", F.col("_row.period")).alias("installment_id"),
            F.col("_row.period").alias("installment_number"),
            F.expr("add_months(first_due_date, _row.period - 1)").alias("due_date"),
            F.col("_row.principal").alias("scheduled_principal"),
            F.col("_row.interest").alias("scheduled_interest"),
            _zero().alias("scheduled_fees"),
            (F.col("_row.principal") + F.col("_row.interest")).cast(MONEY).alias("scheduled_total"),
        )
    )


# --- waterfall -------------------------------------------------------------------------


def money_axis(payments: DataFrame, installments: DataFrame) -> DataFrame:
    """Payments (side 0) and due components (side 1) of each contract as stretches of money
    (`pos`, `end`, in cents): both are laid end to end, oldest first, components by fees, interest and
    principal inside an installment."""
    paid = payments.select(
        *CONTRACT, F.lit(0).alias("side"), F.col("settlement_date").alias("day"),
        F.struct(F.col("payment_id").alias("id"), F.lit(0).alias("rank")).alias("tie"),
        F.lit(None).cast("string").alias("part"), cents("amount").alias("size"),
    )
    parts = F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(p).alias("part"),
                 cents(f"scheduled_{p}").alias("size"))
        for i, p in enumerate(("fees", "interest", "principal"))
    ]))
    due = installments.select(*CONTRACT, "installment_id", "due_date", parts.alias("c")).select(
        *CONTRACT, F.lit(1).alias("side"), F.col("due_date").alias("day"),
        F.struct(F.col("installment_id").alias("id"), F.col("c.rank").alias("rank")).alias("tie"),
        F.col("c.part").alias("part"), F.col("c.size").alias("size"),
    )
    laid = scan(paid.unionByName(due), [*CONTRACT, "side"], "day", Scan(sums={"end": "size"}), tie="tie")
    return laid.select(*CONTRACT, "side", F.col("tie.id").alias("id"), "part",
                       (F.col("end") - F.col("size")).alias("pos"), "end")


def allocate_payments(payments: DataFrame, installments: DataFrame) -> DataFrame:
    """Oldest installment first; inside it fees, then interest, then principal.

    Due components and payments are laid end to end on one money axis per contract. Between
    two neighbouring break points of that axis exactly one payment meets one component, so a
    single ordered scan finds every allocation: no pairs are formed, and both the running sums
    and the pass over the axis are cut into ranges that carry on where the one before ended.
    Payments that are reversed, and the reversals, must be left out by the caller
    (`without_reversed`). Money beyond the schedule stays unallocated.
    """
    axis = money_axis(payments, installments)
    of = lambda side, *c: F.when(F.col("side") == side, F.struct(*c, "end"))
    marks = axis.select(*CONTRACT, "pos", "end", of(0, "id").alias("pay"), of(1, "id", "part").alias("owed"))
    # Empty components share their position with the next one; ordering by `end` puts them first.
    segments = scan(marks, CONTRACT, "pos", Scan(lasts={"pay": "pay", "owed": "owed"}, leads={"next_pos": "pos"}),
                    tie="end")
    reach = F.least("next_pos", F.col("pay.end"), F.col("owed.end"))
    met = segments.filter(F.col("pay").isNotNull() & F.col("owed").isNotNull()).withColumn(
        "size", reach - F.col("pos")
    )
    part = F.col("owed.part")
    sums = (
        met.filter(F.col("size") > 0)
        .groupBy(
            *CONTRACT,
            F.col("pay.id").alias("payment_id"),
            F.col("owed.id").alias("installment_id"),
        )
        .agg(
            *[
                F.sum(F.when(part == p, F.col("size")).otherwise(0)).alias(f"allocated_{p}")
                for p in ("fees", "interest", "principal")
            ],
            F.sum("size").alias("allocated_total"),
        )
    )
    return sums.select(
        *CONTRACT, "payment_id", "installment_id",
        *[from_cents(f"allocated_{p}").alias(f"allocated_{p}") for p in ("fees", "interest", "principal", "total")],
    )


def without_reversed(payments: DataFrame) -> DataFrame:
    """Settled payments that are neither a reversal nor reversed later."""
    settled = payments.filter(F.col("status") == "settled")
    reversed_ids = settled.filter(F.col("reversal_of_payment_id").isNotNull()).select(
        "run_id", "contract_id", F.col("reversal_of_payment_id").alias("payment_id")
    )
    return settled.filter(F.col("reversal_of_payment_id").isNull()).join(
        reversed_ids, ["run_id", "contract_id", "payment_id"], "left_anti"
    )


# --- balances over time ----------------------------------------------------------------


def settled_movements(
    allocations: DataFrame, payments: DataFrame, payment: Sequence[str] = ("run_id", "payment_id"),
) -> DataFrame:
    """Net allocated money per installment and settlement day; reversals count negative.

    `payment` names the columns that identify a payment in both tables. With the contract among
    them, tables that lie together by contract are joined where they are.
    """
    settled = payments.filter(
        (F.col("status") == "settled") & F.col("settlement_date").isNotNull()
    ).select(
        *payment,
        F.col("settlement_date").alias("at"),
        F.when(F.col("reversal_of_payment_id").isNull(), 1).otherwise(-1).alias("sign"),
    )
    moved = allocations.join(settled, [*payment])
    summed = moved.groupBy(*INSTALLMENT, "at").agg(
        *[F.sum(cents(f"allocated_{p}") * F.col("sign")).alias(p) for p in PARTS]
    )
    return summed.select(*INSTALLMENT, "at", *[from_cents(p).alias(f"moved_{p}") for p in PARTS])


def installment_steps(installments: DataFrame, movements: DataFrame) -> DataFrame:
    """Step function of what is open on every installment, from its schedule on.

    One row per installment and change day `at` (the first one far in the past), valid
    until `until` (exclusive, NULL for the last). Paid money never falls below zero and
    never exceeds what is scheduled. `fell_*` is how much the open amount fell at `at`.
    Movements have one row per installment and day, so the window is as long as the calendar.
    """
    opening = installments.select(
        *INSTALLMENT,
        F.expr(ORIGIN).alias("at"),
        "due_date",
        *[F.col(f"scheduled_{p}") for p in PARTS],
    )
    timeline = opening.unionByName(movements, allowMissingColumns=True)
    w = Window.partitionBy(*BY_INSTALLMENT).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    planned = {p: F.first(f"scheduled_{p}", ignorenulls=True).over(run) for p in PARTS}
    known = timeline.select(
        *INSTALLMENT,
        "at",
        F.first("due_date", ignorenulls=True).over(run).alias("due_date"),
        planned["total"].alias("planned_total"),
        *[cents(planned[p]).alias(f"_planned_{p}") for p in PARTS],
        *[F.coalesce(F.sum(cents(f"moved_{p}")).over(run), F.lit(0)).alias(f"_moved_{p}") for p in PARTS],
    ).filter(F.col("due_date").isNotNull())
    opened = known.select(
        *INSTALLMENT,
        "at",
        "due_date",
        "planned_total",
        *[
            (F.col(f"_planned_{p}") - F.least(F.greatest(F.col(f"_moved_{p}"), F.lit(0)), F.col(f"_planned_{p}")))
            .alias(f"open_{p}")
            for p in PARTS
        ],
    )
    return opened.select(
        *INSTALLMENT,
        "at",
        "due_date",
        "planned_total",
        *[from_cents(f"open_{p}").alias(f"open_{p}") for p in PARTS],
        F.lead("at").over(w).alias("until"),
        *[
            from_cents(F.lag(f"open_{p}").over(w) - F.col(f"open_{p}")).alias(f"fell_{p}")
            for p in PARTS
        ],
    )


def ledger_state(
    probes: DataFrame, installments: DataFrame, steps: DataFrame,
    give_up_days: int | None = None, write_offs: DataFrame | None = None,
) -> DataFrame:
    """What the ledger says at every probe (run_id, contract_id, snapshot_date).

    Adds open_principal/interest/fees/total, cumulative_paid, past_due_amount, oldest_due,
    next_due_date and dpd; with `write_offs` (contract, lost_on, lost) also cumulative_lost.
    Changes of a day are summed first, on one time line per contract with the probes, so
    every as-of value is a running total over days, the overdue money too: an overdue stretch
    adds its money on its first day and takes it away after its last. An event of the probe's own
    day counts. `give_up_days` may be set for month-end probes without a gap, when the caller
    stops a contract at the first month in which it is that late; other probes are refused then.
    """
    first_step = F.col("at") == F.expr(ORIGIN)
    changes = steps.select(
        *CONTRACT, "at",
        *[cents(F.when(first_step, F.col(f"open_{p}")).otherwise(-F.col(f"fell_{p}"))).alias(f"d_{p}") for p in PARTS],
    ).withColumn("d_paid", F.when(~first_step, -F.col("d_total")))
    dues = installments.select(*CONTRACT, F.col("due_date").alias("at"), F.col("due_date").alias("due"))
    late = overdue_steps(steps)
    turns = late.select(*CONTRACT, "late_from", "until", cents("open_total").alias("late")).select(
        *CONTRACT, F.explode(F.array(
            F.struct(F.col("late_from").alias("at"), F.col("late").alias("d_late")),
            F.struct(F.col("until").alias("at"), (-F.col("late")).alias("d_late")),
        )).alias("e")).select(*CONTRACT, "e.at", "e.d_late").filter(F.col("at").isNotNull())
    marks = probes.select(*CONTRACT, F.col("snapshot_date").alias("at"), F.lit(True).alias("probe"))
    parts = [changes, dues, turns, marks]
    kept = []
    if give_up_days is not None:
        parts.append(oldest_due_at_month_ends(late, give_up_days).withColumnRenamed("snapshot_date", "at"))
        kept = ["oldest_due"]
    sums = [*[f"d_{p}" for p in PARTS], "d_paid", "d_late"]
    extra = []
    if write_offs is not None:
        parts.append(write_offs.select(*CONTRACT, F.col("lost_on").alias("at"), cents("lost").alias("d_lost")))
        extra = ["lost"]
        sums.append("d_lost")
    line = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # One row for each day of a contract, whatever happened on it.
    daily = line.groupBy(*CONTRACT, "at").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("probe").alias("probe"),
        *[F.min(c).alias(c) for c in ("due", *kept)])
    w = Window.partitionBy(*BY_CONTRACT).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    # A day's due date is the day, so the next one is that of the first later day that has any.
    later = F.expr(f"lead(due) IGNORE NULLS OVER (PARTITION BY {', '.join(BY_CONTRACT)} ORDER BY at)")
    outputs = [*[(f"d_{p}", f"open_{p}") for p in PARTS],
               *[(f"d_{x}", f"cumulative_{x}") for x in ("paid", *extra)], ("d_late", "past_due_amount")]
    state = daily.select(
        *CONTRACT, "at", "probe", *kept, *[total(d).alias(name) for d, name in outputs],
        F.coalesce("due", later).alias("next_due_date"),
    ).filter("probe")
    if give_up_days is not None:
        before = F.lag("at").over(w)
        gap = (F.col("at") != F.last_day("at")) | (
            month_start("at") != F.add_months(month_start(before), 1))
        state = state.withColumn("oldest_due", F.when(gap, F.raise_error(F.lit(
            "give_up_days needs a probe at every month end")).cast("date")).otherwise(F.col("oldest_due")))
    state = state.select(
        *CONTRACT, F.col("at").alias("snapshot_date"), *[from_cents(name).alias(name) for _, name in outputs],
        "next_due_date", *kept,
    )
    if give_up_days is None:
        state = state.join(oldest_due_at(probes, late), [*BY_CONTRACT, "snapshot_date"], "left")
    return state.withColumn("dpd", F.coalesce(F.datediff("snapshot_date", "oldest_due"), F.lit(0)).cast("int"))


def overdue_steps(steps: DataFrame) -> DataFrame:
    """Stretches of days [late_from, until) in which an installment has overdue money."""
    late_from = F.greatest(F.col("at"), F.date_add("due_date", 1))
    return steps.filter(F.col("open_total") > _tolerance()).select(
        *CONTRACT, "due_date", "open_total", late_from.alias("late_from"), "until",
    ).filter(F.col("until").isNull() | (F.col("late_from") < F.col("until")))


def oldest_due_at(probes: DataFrame, late: DataFrame) -> DataFrame:
    """Due date of the oldest overdue installment at each probe that has any.

    Equal stretches of a contract become one row, then only the months of a stretch are spread;
    the join is on contract and month, and what meets there is bounded by the days of a month.
    """
    last = probes.groupBy(*CONTRACT).agg(F.max("snapshot_date").alias("last_probe"))
    late_to = F.least(F.coalesce(F.date_sub("until", 1), F.col("last_probe")), F.col("last_probe"))
    stretches = (
        late.select(*CONTRACT, "due_date", "late_from", "until").distinct()
        .join(last, BY_CONTRACT)
        .select(*CONTRACT, "due_date", "late_from", late_to.alias("late_to"))
        .filter(F.col("late_from") <= F.col("late_to"))
        .withColumn("month", F.explode(month_sequence("late_from", "late_to")))
    )
    dated = probes.select(*CONTRACT, "snapshot_date", month_start("snapshot_date").alias("month")).distinct()
    return (
        stretches.join(dated, [*BY_CONTRACT, "month"])
        .filter(F.col("snapshot_date").between(F.col("late_from"), F.col("late_to")))
        .groupBy(*CONTRACT, "snapshot_date")
        .agg(F.min("due_date").alias("oldest_due"))
    )


def oldest_due_at_month_ends(late: DataFrame, give_up_days: int) -> DataFrame:
    """Due dates of the installments that are overdue at each month end, up to the first one at
    which they are `give_up_days` late: with a probe at every month end, that lies within 31 more days."""
    given_up = F.date_add("due_date", give_up_days + 31)
    late_to = F.least(F.date_sub("until", 1), given_up)
    ends = late.filter(F.col("run_id").isNotNull() & F.col("contract_id").isNotNull()).select(
        *CONTRACT, F.col("due_date").alias("oldest_due"), "late_from", late_to.alias("late_to"),
        F.explode(month_sequence("late_from", late_to)).alias("month"),
    )
    end = F.last_day("month")
    return ends.filter(end.between(F.col("late_from"), F.col("late_to"))).select(
        *CONTRACT, end.alias("snapshot_date"), "oldest_due")


# --- monthly snapshots -----------------------------------------------------------------


def contract_status(dpd: Column, balance: Column, charge_off_dpd: int) -> Column:
    return (
        F.when(dpd >= charge_off_dpd, "charged_off")
        .when(balance <= _tolerance(), "settled")
        .when(dpd > 0, "delinquent")
        .otherwise("active")
    )


def month_end_probes(contracts: DataFrame, installments: DataFrame, tail_days: int) -> DataFrame:
    """Month ends of every contract from disbursement to `tail_days` after its last due date."""
    last_due = installments.groupBy(*CONTRACT).agg(F.max("due_date").alias("last_due"))
    spine = month_sequence("disbursement_date", F.date_add("last_due", tail_days))
    return (
        contracts.select(*CONTRACT, "disbursement_date")
        .join(last_due, BY_CONTRACT)
        .select(*CONTRACT, "last_due", F.explode(spine).alias("m"))
        .select(*CONTRACT, "last_due", F.last_day("m").alias("snapshot_date"))
        .filter(F.col("snapshot_date") <= F.date_add("last_due", tail_days))
        .drop("last_due")
    )


def monthly_ledger(
    contracts: DataFrame,
    installments: DataFrame,
    steps: DataFrame,
    charge_off_dpd: int = 180,
    tail_days: int = 240,
) -> DataFrame:
    """Month-end account rows up to and including the first terminal month.

    In the charge-off month the open balance moves to cumulative_write_off; its parts are
    kept in written_principal/interest/fees for the write-off event.
    """
    probes = month_end_probes(contracts, installments, tail_days)
    state = ledger_state(probes, installments, steps, give_up_days=charge_off_dpd)
    dated = state.withColumn(
        "status", contract_status(F.col("dpd"), F.col("open_total"), charge_off_dpd)
    )
    # Probes are one row a month, so the window is as long as the calendar has months.
    ended = F.min(
        F.when(F.col("status").isin(*TERMINAL_STATUSES), F.col("snapshot_date"))
    ).over(Window.partitionBy(*BY_CONTRACT))
    kept = dated.withColumn("ended", ended).filter(
        F.col("ended").isNull() | (F.col("snapshot_date") <= F.col("ended"))
    )
    gone = F.col("status") == "charged_off"
    terminal = F.col("status").isin(*TERMINAL_STATUSES)

    def on_book(c: str) -> Column:
        return F.when(gone, _zero()).otherwise(F.col(c)).cast(MONEY)

    def written(c: str) -> Column:
        return F.when(gone, F.col(c)).otherwise(_zero()).cast(MONEY)

    return kept.select(
        *CONTRACT,
        "snapshot_date",
        on_book("open_principal").alias("outstanding_principal"),
        on_book("open_interest").alias("outstanding_interest"),
        on_book("open_fees").alias("outstanding_fees"),
        on_book("open_total").alias("total_balance"),
        on_book("past_due_amount").alias("past_due_amount"),
        F.when(~terminal, F.col("next_due_date")).alias("next_due_date"),
        "dpd",
        dpd_bucket("dpd").alias("delinquency_bucket"),
        "status",
        F.when(terminal, _zero()).otherwise(F.col("open_total")).cast(MONEY).alias("exposure"),
        "cumulative_paid",
        written("open_total").alias("cumulative_write_off"),
        written("open_principal").alias("written_principal"),
        written("open_interest").alias("written_interest"),
        written("open_fees").alias("written_fees"),
    )


def write_off_events(ledger: DataFrame) -> DataFrame:
    """One event per charged-off contract, at its charge-off month."""
    return ledger.filter(F.col("status") == "charged_off").select(
        "run_id",
        F.concat(F.lit("WO-"), F.col("contract_id")).alias("write_off_id"),
        "contract_id",
        F.col("snapshot_date").alias("write_off_date"),
        F.col("cumulative_write_off").alias("amount"),
        F.col("written_principal").alias("principal"),
        F.col("written_interest").alias("interest"),
        F.col("written_fees").alias("fees"),
        F.lit("policy_threshold").alias("reason"),
    )


def installment_status(
    installments: DataFrame, steps: DataFrame, charged_off: DataFrame, as_of: Column
) -> DataFrame:
    """Final state of each installment: first match of paid, written_off, partially_paid,
    overdue, due, scheduled."""
    final = steps.filter(F.col("until").isNull()).select(*INSTALLMENT, "open_total")
    lost = charged_off.select(*CONTRACT, F.lit(True).alias("lost")).distinct()
    joined = installments.join(final, BY_INSTALLMENT, "left").join(lost, BY_CONTRACT, "left")
    left = F.coalesce(F.col("open_total"), F.col("scheduled_total"))
    status = (
        F.when(left <= 0, "paid")
        .when(F.col("lost"), "written_off")
        .when(left < F.col("scheduled_total"), "partially_paid")
        .when(F.col("due_date") < as_of, "overdue")
        .when(F.col("due_date") <= as_of, "due")
        .otherwise("scheduled")
    )
    kept = [c for c in installments.columns if c not in ("status", "outstanding_balance")]
    return joined.select(
        *kept, status.alias("status"), left.cast(MONEY).alias("outstanding_balance")
    )


def collection_candidates(snapshots: DataFrame, installments: DataFrame, steps: DataFrame,
                          thresholds: tuple[int, ...] = (15, 45, 75)) -> DataFrame:
    """Open contracts late enough for contact, with the money due up to the month end."""
    eligible = snapshots.filter(
        F.col("status").isin("active", "delinquent") & (F.col("dpd") >= min(thresholds))
    )
    # Due up to and including the month end: the overdue part plus what falls due that day.
    on_the_day = (
        steps.withColumnRenamed("due_date", "snapshot_date")
        .filter((F.col("at") <= F.col("snapshot_date"))
                & (F.col("until").isNull() | (F.col("until") > F.col("snapshot_date"))))
        .groupBy(*CONTRACT, "snapshot_date")
        .agg(F.sum("open_total").alias("due_today"))
    )
    return eligible.join(on_the_day, [*BY_CONTRACT, "snapshot_date"], "left").withColumn(
        "amount_due",
        (F.col("past_due_amount") + F.coalesce("due_today", _zero())).cast(MONEY),
    ).drop("due_today")


# --- decisions -------------------------------------------------------------------------

# Points per bureau bucket and the weights of the scorecard.
BUREAU_POINTS = {"thin_file": 0.40, "low": 0.30, "medium": 0.60, "high": 0.85}
WEIGHTS = {"bureau": 0.45, "income": 0.30, "debt": 0.25}
NEUTRAL_DEBT = 0.5
DEBT_SCALE = 1.5


def scorecard(features: DataFrame, income_min: float, income_max: float) -> DataFrame:
    """Adds `score` in 0..1 from bureau bucket, income and debt ratio."""
    points = F.create_map(*[F.lit(x) for kv in BUREAU_POINTS.items() for x in kv])
    bureau = points[F.col("bureau_score_bucket")]
    span = max(income_max - income_min, 1e-9)
    income = (F.col("declared_income").cast("double") - income_min) / span
    income = F.least(F.greatest(income, F.lit(0.0)), F.lit(1.0))
    debt = F.coalesce(F.col("debt_to_income"), F.lit(NEUTRAL_DEBT)) / DEBT_SCALE
    debt = 1 - F.least(F.greatest(debt, F.lit(0.0)), F.lit(1.0))
    raw = WEIGHTS["bureau"] * bureau + WEIGHTS["income"] * income + WEIGHTS["debt"] * debt
    return features.withColumn(
        "score", F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    )


def decide(scored: DataFrame, cutoff: float, max_term: int, rate: float) -> DataFrame:
    """Approve at or above the cutoff; amounts, capped term and rate only when approved."""
    ok = F.col("score") >= cutoff
    return scored.select(
        "*",
        F.when(ok, "approved").otherwise("rejected").alias("outcome"),
        F.when(~F.coalesce(ok, F.lit(False)), "score_below_cutoff").alias("reason_code"),
        F.when(ok, F.col("requested_amount")).alias("approved_amount"),
        F.when(ok, F.least(F.col("requested_term_months"), F.lit(max_term))).alias(
            "approved_term_months"
        ),
        F.when(ok, F.lit(rate)).alias("offered_rate"),
    )
