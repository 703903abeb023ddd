"""Ledger operators on small hand-made contracts."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from loanweave.operators import ledger
from loanweave.operators.rules import ledger_expectation

INST = ("run_id string, contract_id string, installment_id string, due_date date, "
        "scheduled_principal decimal(18,2), scheduled_interest decimal(18,2), "
        "scheduled_fees decimal(18,2), scheduled_total decimal(18,2)")
PAY = ("run_id string, contract_id string, payment_id string, amount decimal(18,2), "
       "status string, settlement_date date, reversal_of_payment_id string")
ALLOC = ("run_id string, contract_id string, installment_id string, payment_id string, "
         "allocated_principal decimal(18,2), allocated_interest decimal(18,2), "
         "allocated_fees decimal(18,2), allocated_total decimal(18,2)")


def inst(i, due, principal, interest=0, fees=0):
    return ("r", "c", i, due, D(principal), D(interest), D(fees), D(principal + interest + fees))


def pay(i, amount, day, reverses=None):
    return ("r", "c", i, D(amount), "settled", day, reverses)


def alloc(p, i, amount):
    return ("r", "c", i, p, D(amount), D(0), D(0), D(amount))


def state(spark, insts, pays, allocs, days):
    i = spark.createDataFrame(insts, INST)
    steps = ledger.installment_steps(
        i, ledger.settled_movements(spark.createDataFrame(allocs, ALLOC),
                                    spark.createDataFrame(pays, PAY)))
    probes = spark.createDataFrame([("r", "c", d) for d in days],
                                   "run_id string, contract_id string, snapshot_date date")
    rows = ledger.ledger_state(probes, i, steps).orderBy("snapshot_date").collect()
    return [(r.cumulative_paid, r.open_total, r.past_due_amount, r.dpd) for r in rows]


def test_reversal_reopens_and_payment_day_counts(spark):
    insts = [inst("i1", date(2024, 1, 10), 100), inst("i2", date(2024, 2, 10), 100)]
    pays = [pay("p1", 100, date(2024, 1, 31)), pay("r1", 100, date(2024, 2, 5), "p1")]
    allocs = [alloc("p1", "i1", 100), alloc("r1", "i1", 100)]
    got = state(spark, insts, pays, allocs, [date(2024, 1, 31), date(2024, 2, 29)])
    assert got == [(D(100), D(100), D(0), 0), (D(0), D(200), D(200), 50)]


def test_no_payments_at_all(spark):
    insts = [inst("i1", date(2024, 1, 10), 50), inst("i2", date(2024, 2, 29), 50)]
    got = state(spark, insts, [], [], [date(2024, 1, 31), date(2024, 2, 29)])
    # An installment due on the snapshot day itself is not overdue yet.
    assert got == [(D(0), D(100), D(50), 21), (D(0), D(100), D(50), 50)]


def test_overpayment_is_clipped(spark):
    insts = [inst("i1", date(2024, 1, 10), 50)]
    got = state(spark, insts, [pay("p", 80, date(2024, 1, 5))], [alloc("p", "i1", 80)],
                [date(2024, 1, 31)])
    assert got == [(D(50), D(0), D(0), 0)]


def test_partial_payment_keeps_oldest_due(spark):
    insts = [inst("i1", date(2024, 1, 10), 100), inst("i2", date(2024, 2, 10), 100)]
    pays = [pay("p1", 60, date(2024, 2, 20)), pay("p2", 40, date(2024, 3, 20))]
    allocs = [alloc("p1", "i1", 60), alloc("p2", "i1", 40)]
    got = state(spark, insts, pays, allocs, [date(2024, 2, 29), date(2024, 3, 31)])
    assert got == [(D(60), D(140), D(140), 50), (D(100), D(100), D(100), 50)]


def test_future_rows_change_nothing_earlier(spark):
    insts = [inst("i1", date(2024, 1, 10), 100)]
    days = [date(2024, 1, 31), date(2024, 2, 29)]
    before = state(spark, insts, [], [], days)
    later = state(spark, [*insts, inst("i9", date(2025, 1, 10), 0)],
                  [pay("p", 100, date(2024, 3, 5))], [alloc("p", "i1", 100)], days)
    assert before == later


def test_waterfall_order_and_limits(spark):
    insts = spark.createDataFrame(
        [inst("i1", date(2024, 1, 10), 80, 15, 5), inst("i2", date(2024, 2, 10), 80, 20)], INST)
    pays = spark.createDataFrame(
        [pay("p1", 12, date(2024, 1, 5)), pay("p2", 100, date(2024, 1, 9)),
         pay("p3", 500, date(2024, 2, 1))], PAY)
    got = {
        (r.payment_id, r.installment_id):
            (r.allocated_fees, r.allocated_interest, r.allocated_principal)
        for r in ledger.allocate_payments(pays, insts).collect()
    }
    assert got == {
        ("p1", "i1"): (D(5), D(7), D(0)),
        ("p2", "i1"): (D(0), D(8), D(80)),
        ("p2", "i2"): (D(0), D(12), D(0)),
        ("p3", "i2"): (D(0), D(8), D(80)),
    }


def test_reversed_payments_are_left_out(spark):
    pays = spark.createDataFrame(
        [pay("p1", 10, date(2024, 1, 5)), pay("x", 10, date(2024, 1, 9), "p1"),
         pay("p2", 10, date(2024, 2, 1))], PAY)
    assert [r.payment_id for r in ledger.without_reversed(pays).collect()] == ["p2"]


def test_amortization_matches_decimal_loop(spark):
    from decimal import ROUND_HALF_UP

    def cents(x):
        return x.quantize(D("0.01"), rounding=ROUND_HALF_UP)

    cases = [(D("1000.00"), 0.03, 12), (D("777.77"), 0.0, 7), (D("50000.00"), 0.0175, 60),
             (D("10.00"), 0.5, 1)]
    rows = [("r", f"c{i}", a, r, n, date(2024, 1, 31)) for i, (a, r, n) in enumerate(cases)]
    df = spark.createDataFrame(
        rows, "run_id string, contract_id string, financed_amount decimal(18,2), "
        "contract_rate double, num_installments int, first_due_date date")
    got = ledger.amortization_schedule(df).orderBy("contract_id", "installment_number").collect()
    for i, (amount, rate, n) in enumerate(cases):
        mine = [r for r in got if r.contract_id == f"c{i}"]
        r = D(str(rate))
        level = cents(amount / n) if rate == 0 else cents(amount * r / (1 - (1 + r) ** -n))
        balance = amount
        for k, row in enumerate(mine, 1):
            interest = cents(balance * r)
            principal = balance if k == n else level - interest
            assert (row.scheduled_principal, row.scheduled_interest) == (principal, interest)
            balance -= principal
        assert sum(row.scheduled_principal for row in mine) == amount
    assert [r.due_date for r in got if r.contract_id == "c0"][:3] == [
        date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)]


def test_installment_status_order(spark):
    insts = spark.createDataFrame(
        [inst("paid", date(2024, 1, 1), 10), inst("part", date(2024, 1, 2), 10),
         inst("late", date(2024, 1, 3), 10), inst("due", date(2024, 6, 1), 10),
         inst("later", date(2024, 7, 1), 10)], INST)
    allocs = spark.createDataFrame([alloc("p", "paid", 10), alloc("p", "part", 4)], ALLOC)
    pays = spark.createDataFrame([pay("p", 14, date(2024, 1, 1))], PAY)
    steps = ledger.installment_steps(insts, ledger.settled_movements(allocs, pays))
    nobody = spark.createDataFrame([], "run_id string, contract_id string")
    got = {r.installment_id: r.status for r in ledger.installment_status(
        insts, steps, nobody, F.lit("2024-06-01").cast("date")).collect()}
    assert got == {"paid": "paid", "part": "partially_paid", "late": "overdue", "due": "due",
                   "later": "scheduled"}


def test_expectation_counts_write_offs_up_to_the_day(spark):
    t = {
        "installments": spark.createDataFrame([inst("i", date(2024, 1, 10), 100)], INST),
        "payments": spark.createDataFrame([], PAY),
        "payment_allocations": spark.createDataFrame([], ALLOC),
        "account_monthly_snapshots": spark.createDataFrame(
            [("r", "c", date(2024, 1, 31)), ("r", "c", date(2024, 2, 29))],
            "run_id string, contract_id string, snapshot_date date"),
        "write_off_events": spark.createDataFrame(
            [("r", "c", date(2024, 2, 29), D(100))],
            "run_id string, contract_id string, write_off_date date, amount decimal(18,2)"),
    }
    got = [(r.expected_write_off, r.expected_total_balance, r.expected_dpd)
           for r in ledger_expectation(t, ("run_id",)).orderBy("snapshot_date").collect()]
    assert got == [(D(0), D(100), 21), (D(100), D(0), 50)]


# --- one contract that holds half of the rows ---------------------------------------------


def hot_case(n=400):
    """Contract "hot" has as many rows as all others together; numbers from a fixed rule."""
    insts, pays = [], []
    for k in range(2 * n):
        c = "hot" if k < n else f"c{k % 37}"
        due = date(2024, 1, 1) + timedelta(days=(k * 7) % 300)
        insts.append(("r", c, f"{c}-i{k}", due, D(10 + k % 5), D(k % 3), D(k % 2), D(10 + k % 5 + k % 3 + k % 2)))
        if k % 4:
            day = date(2024, 1, 1) + timedelta(days=(k * 11) % 330)
            pays.append(("r", c, f"{c}-p{k}", D(7 + (k * 5) % 13), "settled", day, None))
    return insts, pays


def plain_waterfall(insts, pays):
    open_, out = {}, {}
    for r in sorted(insts, key=lambda r: (r[1], r[3], r[2])):
        open_.setdefault(r[1], []).append([r[2], r[6], r[5], r[4]])
    for p in sorted(pays, key=lambda p: (p[1], p[5], p[2])):
        left = p[3]
        for line in open_.get(p[1], []):
            got = []
            for i in (1, 2, 3):
                take = min(line[i], left)
                line[i] -= take
                left -= take
                got.append(take)
            if sum(got):
                out[p[2], line[0]] = tuple(got)
    return out


def test_hot_contract_waterfall_is_spread(spark, monkeypatch):
    insts, pays = hot_case()
    i, p = spark.createDataFrame(insts, INST), spark.createDataFrame(pays, PAY)
    real = ledger.scan
    monkeypatch.setattr(ledger, "scan", lambda *a, **k: real(*a, **k, cells=7))
    got = ledger.allocate_payments(p, i)
    assert {(r.payment_id, r.installment_id): (r.allocated_fees, r.allocated_interest, r.allocated_principal)
            for r in got.collect()} == plain_waterfall(insts, pays)


def test_hot_contract_balances(spark):
    insts, pays = hot_case()
    allocs = [(p[0], p[1], i, p[2], a[2], a[1], a[0], sum(a))
              for p in pays for (q, i), a in plain_waterfall(insts, pays).items() if q == p[2]]
    i = spark.createDataFrame(insts, INST)
    steps = ledger.installment_steps(i, ledger.settled_movements(
        spark.createDataFrame(allocs, ALLOC), spark.createDataFrame(pays, PAY)))
    days = [date(2024, m, 28) for m in range(1, 13)]
    probes = spark.createDataFrame([("r", c, d) for c in ("hot", "c3") for d in days],
                                   "run_id string, contract_id string, snapshot_date date")
    paid_on = {p[2]: p[5] for p in pays}
    for r in ledger.ledger_state(probes, i, steps).collect():
        mine = {x[2]: x for x in insts if x[1] == r.contract_id}
        paid = dict.fromkeys(mine, D(0))
        for a in allocs:
            if a[2] in mine and paid_on[a[3]] <= r.snapshot_date:
                paid[a[2]] += a[7]
        late = [k for k, x in mine.items() if x[3] < r.snapshot_date and x[7] - paid[k] > D("0.01")]
        assert r.cumulative_paid == sum(paid.values())
        assert r.open_total == sum(x[7] for x in mine.values()) - sum(paid.values())
        assert r.past_due_amount == sum(mine[k][7] - paid[k] for k in late)
        assert r.dpd == max(((r.snapshot_date - mine[k][3]).days for k in late), default=0)


def test_give_up_days_needs_every_month_end(spark):
    insts = [inst("i1", date(2024, 1, 10), 50)]
    i = spark.createDataFrame(insts, INST)
    steps = ledger.installment_steps(i, ledger.settled_movements(
        spark.createDataFrame([], ALLOC), spark.createDataFrame([], PAY)))
    schema = "run_id string, contract_id string, snapshot_date date"
    ends = [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)]
    good = spark.createDataFrame([("r", "c", d) for d in ends], schema)
    assert [r.dpd for r in ledger.ledger_state(good, i, steps, 60).orderBy("snapshot_date").collect()] == [21, 50, 81]
    for days in ([ends[0], ends[2]], [date(2024, 1, 30), date(2024, 2, 29)]):
        gap = spark.createDataFrame([("r", "c", d) for d in days], schema)
        with pytest.raises(Exception, match="every month end"):
            ledger.ledger_state(gap, i, steps, 60).collect()


def test_time_line_is_read_by_linear_windows(spark):
    """No frame runs to the end of a contract, which goes through its rows once more for each row,
    and money is added up in 64 bits."""
    i = spark.createDataFrame([inst("i1", date(2024, 1, 10), 50)], INST)
    steps = ledger.installment_steps(i, ledger.settled_movements(
        spark.createDataFrame([], ALLOC), spark.createDataFrame([], PAY)))
    probes = spark.createDataFrame([("r", "c", date(2024, 1, 31))],
                                   "run_id string, contract_id string, snapshot_date date")
    plan = ledger.ledger_state(probes, i, steps)._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    assert "decimal(28,2)" not in plan


def test_next_due_date_may_be_the_day_itself(spark):
    insts = [inst("i1", date(2024, 1, 31), 50), inst("i2", date(2024, 3, 10), 50)]
    i = spark.createDataFrame(insts, INST)
    steps = ledger.installment_steps(i, ledger.settled_movements(
        spark.createDataFrame([], ALLOC), spark.createDataFrame([], PAY)))
    days = [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)]
    probes = spark.createDataFrame([("r", "c", d) for d in days],
                                   "run_id string, contract_id string, snapshot_date date")
    for give_up in (None, 60):
        got = ledger.ledger_state(probes, i, steps, give_up).orderBy("snapshot_date").collect()
        assert [(r.next_due_date, r.oldest_due) for r in got] == [
            (date(2024, 1, 31), None), (date(2024, 3, 10), date(2024, 1, 31)), (None, date(2024, 1, 31))]
