"""One tidy table of headline findings, ready to be put into words elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.functions.buckets import sample_tier
from loanweave.functions.money import ratio
from loanweave.operators.marts import comparable_cohorts, roll_forward_from_current
from loanweave.session import settle


def _finding(df: DataFrame, question: str, title: str, unit: str, size: Column,
             compared: Column, baseline: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    base = none if baseline is None else baseline.cast("double")
    value = compared.cast("double")
    return df.select(
        F.lit(question).alias("question_id"),
        F.lit(title).alias("title"),
        "scenario",
        base.alias("baseline_value"),
        value.alias("compared_value"),
        (value - base).alias("delta"),
        F.lit(unit).alias("unit"),
        size.cast("bigint").alias("sample_size"),
        sample_tier(size).alias("sample_classification"),
    )


def insight_table(
    funnel: DataFrame, portfolio: DataFrame, delinquency: DataFrame, rolls: DataFrame,
    cohorts: DataFrame, cures: DataFrame, writeoffs: DataFrame, scenarios: DataFrame,
    stress: DataFrame,
) -> DataFrame:
    """Funnel, balance path, PAR, cure, roll, vintage, redefault, recovery and scenario deltas."""
    c = F.col

    def base(df: DataFrame) -> DataFrame:
        return df.filter(c("scenario") == "baseline")

    out = []
    f = base(funnel).groupBy("scenario").agg(
        *[F.sum(n).alias(n) for n in ("applications_submitted", "decisioned_applications",
                                      "approved_count", "booked_count")]
    )
    out.append(_finding(f, "FUN-01", "credit funnel", "count", c("decisioned_applications"),
                        c("booked_count"), c("applications_submitted")))
    p = base(portfolio).groupBy("scenario").agg(
        F.min_by("outstanding_balance", "snapshot_date").alias("first"),
        F.max_by("outstanding_balance", "snapshot_date").alias("last"),
        F.max_by("active_contracts", "snapshot_date").alias("active"),
    )
    out.append(_finding(p, "COMP-01", "outstanding balance", "monetary_units", c("active"),
                        c("last"), c("first")))
    d = base(delinquency).groupBy("scenario").agg(
        F.max_by(F.struct("par30", "par60", "par90", "total_contracts"), "snapshot_date")
        .alias("end"),
        F.avg("cure_rate").alias("cure"),
    )
    n = c("end.total_contracts")
    for level in ("par30", "par60", "par90"):
        out.append(_finding(d, "DEL-01", level, "fraction_of_balance", n, c(f"end.{level}")))
    out.append(_finding(d, "CUR-01", "cure rate", "fraction", n, c("cure")))
    r = base(roll_forward_from_current(rolls))
    out.append(_finding(r, "VIN-01", "roll forward from current", "fraction", c("transitions"),
                        c("roll_forward_rate")))
    v = base(comparable_cohorts(cohorts)).groupBy("scenario").agg(
        F.sum("contracts_observed").alias("seen"),
        F.sum(F.round(c("incidence_90plus") * c("contracts_observed"))).alias("late"),
    )
    out.append(_finding(v, "VIN-01", "vintage 90+ incidence", "fraction", c("seen"),
                        ratio("late", "seen")))
    q = base(cures).groupBy("scenario").agg(
        F.count_if("was_ever_cured").alias("cured"), F.count_if("redefaulted").alias("again")
    )
    q = settle(q)  # of all contracts
    out.append(_finding(q, "CUR-02", "redefault", "count", c("cured"), c("again"), c("cured")))
    w = base(writeoffs).groupBy("scenario").agg(
        F.sum("write_off_count").alias("n"), F.sum("total_write_off_amount").alias("lost"),
        F.sum("total_recovery_amount").alias("back"),
    )
    out.append(_finding(w, "COL-01", "write-off total", "monetary_units", c("n"), c("lost")))
    out.append(_finding(w, "COL-01", "recovery total", "monetary_units", c("n"), c("back"),
                        c("lost")))
    decided = funnel.groupBy("scenario").agg(F.sum("decisioned_applications").alias("n"))
    s = scenarios.join(decided, "scenario")
    out.append(_finding(s, "FUN-03", "approval rate against baseline", "fraction", c("n"),
                        c("approval_rate"), c("baseline_approval_rate")))
    out.append(_finding(s, "SCN-01", "final 90+ rate against baseline", "fraction", c("n"),
                        c("dpd90_rate_final_month"), c("baseline_dpd90_rate")))
    t = stress.filter(c("period") == "post_shock").withColumn(
        "scenario", F.lit("macroeconomic_stress")
    )
    out.append(_finding(t, "SCN-02", "par90 after the shock", "fraction_of_balance",
                        c("stress_n_months"), c("stress_par90"), c("baseline_par90")))
    return reduce(lambda a, b: a.unionByName(b), out)
