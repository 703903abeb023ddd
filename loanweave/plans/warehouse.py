"""The layered warehouse over a dictionary of operational tables. Everything is lazy."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from loanweave.operators import marts, staging
from loanweave.operators import star_models as models
from loanweave.session import settle


class Warehouse:
    """Staging, intermediate, dimension, fact and mart tables of one set of runs."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = tables

    def stg(self, table: str) -> DataFrame:
        return staging.stage(table, self.tables[table])

    def settle(self, *names: str) -> None:
        """Works out the named tables now, one after the other, and keeps their rows; what is built
        on them reads these. For marts of few rows, whose plans would else stand in one another."""
        for name in names:
            self.__dict__[name] = settle(getattr(self, name))

    # Intermediate.

    @cached_property
    def journey(self) -> DataFrame:
        return models.application_journey(
            self.stg("applications"), self.stg("credit_decisions"), self.stg("contracts")
        )

    @cached_property
    def history(self) -> DataFrame:
        return models.monthly_history(self.stg("account_monthly_snapshots"), self.stg("contracts"))

    @cached_property
    def write_off_outcomes(self) -> DataFrame:
        return models.write_off_outcomes(
            self.stg("write_off_events"), self.stg("recovery_events")
        )

    # Facts.

    @cached_property
    def account_monthly(self) -> DataFrame:
        return models.account_monthly(self.history)

    @cached_property
    def payments(self) -> DataFrame:
        return models.fact_payments(self.stg("payments"))

    @cached_property
    def installments(self) -> DataFrame:
        return models.fact_installments(self.stg("installments"))

    @cached_property
    def collections(self) -> DataFrame:
        return models.fact_collections(self.stg("collection_events"))

    @cached_property
    def decisions(self) -> DataFrame:
        return models.fact_decisions(self.stg("credit_decisions"))

    @cached_property
    def contracts(self) -> DataFrame:
        return models.fact_contracts(self.stg("contracts"))

    @cached_property
    def applications(self) -> DataFrame:
        return models.fact_applications(self.stg("applications"))

    @cached_property
    def macro(self) -> DataFrame:
        return models.fact_macro(self.stg("macro_context_monthly"))

    @cached_property
    def runs(self) -> DataFrame:
        return models.dim_run(self.stg("generation_runs"))

    # Marts.

    @cached_property
    def funnel(self) -> DataFrame:
        return marts.credit_funnel(self.journey)

    @cached_property
    def portfolio(self) -> DataFrame:
        return marts.portfolio_monthly(self.account_monthly, self.payments, self.installments)

    @cached_property
    def delinquency(self) -> DataFrame:
        return marts.delinquency_monthly(self.account_monthly)

    @cached_property
    def vintages(self) -> DataFrame:
        return marts.vintage_cohorts(self.account_monthly)

    @cached_property
    def rolls(self) -> DataFrame:
        return marts.roll_rates(self.account_monthly)

    @cached_property
    def cures(self) -> DataFrame:
        return marts.cure_and_redefault(self.account_monthly)

    @cached_property
    def collections_performance(self) -> DataFrame:
        return marts.collections_performance(self.collections, self.account_monthly)

    @cached_property
    def writeoffs(self) -> DataFrame:
        return marts.writeoff_recovery(self.write_off_outcomes)

    @cached_property
    def scenarios(self) -> DataFrame:
        return marts.scenario_comparison(
            self.runs, self.decisions, self.account_monthly, self.stg("write_off_events")
        )

    @cached_property
    def stress(self) -> DataFrame:
        return marts.stress_pre_post(self.runs, self.macro, self.delinquency, self.writeoffs)
