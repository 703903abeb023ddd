"""Registry of named queries: the Spark plan, the SQL that must give the same rows, coverage."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loanweave.plans.present import present
from loanweave.plans.star import StarPortfolio, raw
from loanweave.plans.warehouse import Warehouse


class Source:
    """What a query may read: the raw tables and the portfolio derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.sf_dir, name)

    @cached_property
    def tables(self) -> StarPortfolio:
        return StarPortfolio(self.spark, self.sf_dir)

    @cached_property
    def wh(self) -> Warehouse:
        return Warehouse(self.tables)


@dataclass(frozen=True)
class Entry:
    run: Callable[[Source], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


CATALOG: dict[str, Entry] = {}
CTES: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; `covers` lists the operators of the survey it exercises."""

    def wrap(fn: Callable[[Source], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name!r} is registered twice")
        CATALOG[name] = Entry(fn, sql, tuple(covers.split()))
        return fn

    return wrap


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needed(text: str, found: set[str]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", text):
            found.add(name)
            _needed(CTES[name], found)


def full_sql(body: str) -> str:
    """The statement with the common table expressions it refers to, in definition order."""
    found: set[str] = set()
    _needed(body, found)
    if not found:
        return body.strip()
    parts = [f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in CTES if n in found]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = CATALOG[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(entry.run(Source(spark, sf_dir)))

    run.__name__ = name
    return run


def load() -> None:
    """Import every module that registers queries."""
    for module in ("marts", "segments", "checks", "scores", "models", "io"):
        importlib.import_module(f"loanweave.plans.queries_{module}")
