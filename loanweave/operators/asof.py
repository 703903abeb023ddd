"""Backward as-of join by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.operators.scan import Scan, scan


def asof_join(
    probes: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    probe_time: str,
    event_time: str,
    values: Sequence[str],
    cells: int | None = None,
) -> DataFrame:
    """Each probe with the values of the latest event of its key at or before its time.

    Probes without such an event, or without a time, get NULLs. Events must be unique per
    (key, time); aggregate them first if they are not.
    """
    by = list(by)
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    # Events sort before probes of the same time.
    left = probes.select(
        *by,
        F.col(probe_time).alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*probes.columns).alias("_probe"),
    )
    right = events.filter(F.col(event_time).isNotNull()).select(
        *by, F.col(event_time).alias("_at"), F.lit(0).alias("_side"), payload.alias("_event")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    joined = scan(
        both, by, "_at", Scan(lasts={"_hit": "_event"}), tie="_side", cells=cells
    )
    return joined.filter(F.col("_probe").isNotNull()).select(
        "_probe.*", *[F.when(F.col("_at").isNotNull(), F.col("_hit")[v]).alias(v) for v in values]
    )
