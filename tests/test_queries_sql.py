"""Every registered query with SQL gives the same rows as that SQL."""

from __future__ import annotations

import pytest
from duck import compare, connect
from paths import SF_DIR

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()
# Model fits and random studies have no SQL; a few cheap ones are run here.
ROWS_ONLY = ("threshold_stability", "vif_reduction", "model_coefficients", "reason_codes",
             "false_alert_study")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, SQL[name]) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
