"""Surrogate and pseudonymous keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanweave.functions.money import col

# The text that stands for NULL inside a key, and the separator.
NULL_TEXT = r"\x00NULL\x00"
KEY_SEPARATOR = "||"


def surrogate_key(*columns: Column | str) -> Column:
    """md5 over the text of the columns; callers pass run_id first."""
    parts = [F.coalesce(col(c).cast("string"), F.lit(NULL_TEXT)) for c in columns]
    return F.md5(F.concat_ws(KEY_SEPARATOR, *parts))


def optional_key(presence: Column | str, *columns: Column | str) -> Column:
    """Key that stays NULL when the referencing column is NULL."""
    return F.when(col(presence).isNotNull(), surrogate_key(*columns))


def case_id(c: Column | str) -> Column:
    """Pseudonym shown instead of a record id."""
    return F.concat(F.lit("CASE-"), F.substring(F.sha2(col(c).cast("string"), 256), 1, 10))
