"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the budget by weight, but at most `most` times its size; what
is cut off goes to the other sources by weight until none is above. Complete epochs come first:
each document is taken floor(target / size of source) times. What is missing to the target is
a weighted sample without replacement: documents ordered by the exponential key -ln(u) / w, w
their quality weight, and taken while the sizes summed up reach no further than the target.
A document too long for what is left is skipped for the next ones, wherever it stands, until the
target is met to a small tolerance.

No source is sorted in one task. Rows are range-partitioned along (source, key); the sizes of
the parts are summed up, and only the part where the next document does not fit, or the target
is met, is gone through row by row. What is left then goes on to the later parts, with the
documents that still fit. The outcome is a short list of limits along the keys: a document is
taken if its size is within the limit at its place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.store import drop, ship, stored

SIZE_PATTERN = "[^\\x20\\x09-\\x0D]+"
BROADCAST_ROWS = 20_000
TOLERANCE = 0.0005


def text_size(text) -> F.Column:
    """Number of maximal runs of characters other than ASCII white space; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def quality_weight(text) -> F.Column:
    """Between 0.25 and 1: more for texts of letters and spaces than for digits and marks."""
    n = F.length(text)
    plain = F.length(F.regexp_replace(text, "[^\\p{L} ]", ""))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.25).otherwise(0.25 + 0.75 * plain / n)


def uniform(seed: int) -> F.Column:
    """A number in (0, 1) that depends on seed, id and text alone, so reruns agree."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                               F.coalesce(F.col("text"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def keyed(docs: DataFrame, seed: int, weight: F.Column | None = None) -> DataFrame:
    """The rows with `_size`, the exponential key `_key` and its value `_v` in [0, 1)."""
    ship(docs.sparkSession)
    weight = quality_weight(F.col("text")) if weight is None else weight
    key = -F.log(uniform(seed)) / weight
    return docs.select("*", text_size(F.col("text")).alias("_size"), key.alias("_key"))


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """Sources with weights 1, 2, 3, 1, ... by code point, null last.

    One row a source; the order is a single window over these rows, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def targets(sizes: DataFrame, most: float = 3.0, budget_share: float = 1.0) -> DataFrame:
    """source, source_size, weight, target.

    With level L a target is min(most * size, L * weight); L follows from the sources not yet
    at their limit, until no further source reaches it. Each turn is one aggregate.
    """
    ranked = stored(_ranked_sources(sizes), "sources")
    total = ranked.agg(F.sum("source_size").cast("double").alias("t")).first().t or 0.0
    total *= budget_share
    limit = most * F.col("source_size")
    level, full = 0.0, -1
    while True:
        open_ = (limit > level * F.col("weight")) & (F.col("source_size") > 0)
        r = ranked.agg(
            F.sum(F.when(~open_, limit)).alias("cut"), F.sum(F.when(open_, F.col("weight"))).alias("w"),
            F.count(F.when(~open_, 1)).alias("full")).first()
        if not r.w or r.full == full:
            break
        full = r.full
        level = (total - (r.cut or 0.0)) / r.w
    return ranked.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def _with_source(rows: DataFrame, sources: DataFrame, weight: F.Column | None = None) -> DataFrame:
    """Join on source, null equal to null; the sources are sent to all tasks only when counted
    to be few. `weight` is what a source counts for if its row is not of a fixed size. Otherwise
    it is an ordinary join, whose hot partitions Spark splits."""
    count = sources.agg(F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0)).alias("n"))
    few = count.first().n <= BROADCAST_ROWS
    side = sources.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if few else side
    return rows.join(side, rows["source"].eqNullSafe(side["_source"]) if few else
                     (F.coalesce(F.concat(F.lit("s"), rows["source"]), F.lit(""))
                      == F.coalesce(F.concat(F.lit("s"), side["_source"]), F.lit("")))).drop("_source")


def _limit() -> F.Column:
    """The limit that holds at the place of a row."""
    here = F.struct(F.col("_key").alias("key"), F.col("_tie").alias("tie"), F.lit(0).alias("side"))
    passed = F.filter("limits", lambda x: F.struct(x["key"], x["tie"], x["side"]) <= here)
    return F.element_at(passed, -1)["limit"]


def _ordered(keys: DataFrame) -> DataFrame:
    """source, _key, _tie, size, s (all rows of the key), cell: along the keys of each source."""
    units = keys.groupBy("source", "_key", "_tie").agg(F.max("_size").alias("size"), F.sum("_size").alias("s"))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = units.repartitionByRange(parts, "source", "_key", "_tie").sortWithinPartitions("source", "_key", "_tie")
    return stored(along.withColumn("cell", F.spark_partition_id()), "order")


def plan(keys: DataFrame, most: float = 3.0, budget_share: float = 1.0) -> DataFrame:
    """One row a source: source_size, target, complete epochs, and what the sample holds.

    `keys` has source, _size, _key, _tie. The sample holds the rows whose size is within the
    limit at their place, and the row of (extra._key, extra._tie).
    """
    order = _ordered(keys)
    goal = targets(order.groupBy("source").agg(F.sum("s").alias("source_size")), most, budget_share)
    goal = goal.withColumn("epochs", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    first = F.struct(F.lit(-1.0).alias("key"), F.lit(0).cast("long").alias("tie"), F.lit(0).alias("side"),
                     F.floor("rest").alias("limit"))
    state = stored(goal.withColumn("done", F.lit(0).cast("long")).withColumn("at_cell", F.lit(-1)).withColumn(
        "limits", F.array(first)).withColumn("open", F.lit(True)), "targets")
    while True:
        moved = _next_cell(order, state)
        drop(state)
        state = moved
        if not state.where("open").limit(1).count():
            break
    skipped = _with_source(order, state.select("source", "rest", "done", "limits"), F.size("limits")).where(
        (F.col("size") > _limit()) & (F.col("rest") > F.col("done")))
    ended = F.element_at("limits", -1)
    # Skipped rows are those before the end; the row where the walk ends counts as one.
    here = F.struct(F.col("_key").alias("key"), F.col("_tie").alias("tie"))
    end = F.struct(ended["key"].alias("key"), ended["tie"].alias("tie"))
    skipped = skipped.where((ended["limit"] >= 0) | (here <= end))
    off = F.abs(F.col("done") + F.col("s") - F.col("rest"))
    extra = skipped.where(off < F.col("rest") - F.col("done")).groupBy(F.col("source").alias("_s")).agg(
        F.min(F.struct(off.alias("off"), "_key", "_tie")).alias("extra"))
    out = stored(state.join(extra, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", "target", "epochs", "limits",
        F.col("extra._key").alias("extra_key"), F.col("extra._tie").alias("extra_tie")), "plan")
    drop(order, state)
    return out


def _next_cell(order: DataFrame, state: DataFrame) -> DataFrame:
    """`state` after the next cell of each open source that is gone through row by row; a source
    that has no such cell any more is closed."""
    numbers = state.where("open").select("source", "rest", "done", "at_cell", "target")
    ahead = _with_source(order, numbers).where(F.col("cell") > F.col("at_cell"))
    fits = F.col("size") <= F.floor("rest") - F.col("done")
    cells = ahead.groupBy("source", "cell", "rest", "done", "target").agg(
        F.sum(F.when(fits, F.col("s")).otherwise(0)).alias("fit"))
    # At most one row a source and part of the order.
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.col("done") + F.coalesce(F.sum("fit").over(run), F.lit(0)))
    meets = F.col("start") + F.col("fit") >= F.col("rest") - TOLERANCE * F.col("target")
    # Without a cut everything that fits is taken, and the walk of the source is over.
    cut = stored(cells.groupBy("source").agg(
        F.min(F.when(meets, F.struct("cell", "start", "rest", "target"))).alias("c"),
        F.max(F.col("start") + F.col("fit")).alias("all")).select(
        "source", F.col("c.cell").alias("cut_cell"), "c.start", "c.rest", "c.target", "all"), "cut")
    inside = _with_source(order, cut.drop("all").where("cut_cell IS NOT NULL")).where(F.col("cell") == F.col("cut_cell"))
    walked = inside.select("source", "cell", "_key", "_tie", "size", "s", "start", "rest", "target").groupBy("source").applyInPandas(
        _walk, "_s string, new_cell int, new_done long, stopped boolean, "
               "more array<struct<key: double, tie: long, side: int, limit: long>>")
    over = cut.where("cut_cell IS NULL").select(F.col("source").alias("_o"), "all")
    joined = state.join(walked, F.col("source").eqNullSafe(F.col("_s")), "left")
    joined = joined.join(over, F.col("source").eqNullSafe(F.col("_o")), "left")
    moved = joined.select(
        "source", "source_size", "target", "epochs", "rest",
        F.coalesce("new_done", "all", "done").alias("done"), F.coalesce("new_cell", "at_cell").alias("at_cell"),
        F.when(F.col("more").isNull(), F.col("limits")).otherwise(F.concat("limits", "more")).alias("limits"),
        F.coalesce(F.col("open") & ~F.col("stopped"), F.lit(False)).alias("open"))
    out = stored(moved, "targets")
    drop(cut)
    return out


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Go through one part of one source by key: rows that fit are taken, longer ones skipped,
    until the target is met to TOLERANCE. A limit is noted wherever it changes, also where the part
    begins and where the walk leaves it: rows taken without a change leave less for what follows.
    The rows are those of one range partition."""
    rows = rows.sort_values(["_key", "_tie"])
    size, s = rows["size"].to_numpy(np.int64), rows["s"].to_numpy(np.int64)
    key, tie = rows["_key"].to_numpy(), rows["_tie"].to_numpy()
    rest, done = float(rows["rest"].iloc[0]), int(rows["start"].iloc[0])
    whole, enough = int(np.floor(rest)), TOLERANCE * float(rows["target"].iloc[0])
    limits, at, stopped = [{"key": key[0], "tie": int(tie[0]), "side": 0, "limit": whole - done}], 0, False
    while at < len(size):
        fits = size[at:] <= whole - done
        after = np.cumsum(np.where(fits, s[at:], 0))
        before = after - np.where(fits, s[at:], 0)
        met = rest - (done + before) <= enough
        over = fits & (after > whole - done)
        first = int(np.argmax(met | over))
        if not (met | over)[first]:
            done += int(after[-1])
            break
        done += int(before[first])
        at += first
        place = {"key": key[at], "tie": int(tie[at])}
        if met[first]:
            limits.append(place | {"side": 0, "limit": -1})
            stopped = True
            break
        if size[at] > whole - done:
            limits.append(place | {"side": 0, "limit": whole - done})
        else:  # one of the repeated rows would fit, all of them do not
            limits.append(place | {"side": 0, "limit": -1})
            limits.append(place | {"side": 1, "limit": whole - done})
        at += 1
    if not stopped:
        limits.append({"key": key[-1], "tie": int(tie[-1]), "side": 1, "limit": whole - done})
    return pd.DataFrame({
        "_s": [rows["source"].iloc[0]], "new_cell": [int(rows["cell"].iloc[0])], "new_done": [done],
        "stopped": [stopped], "more": [limits]})


def times(docs_with_plan: DataFrame) -> DataFrame:
    """Adds `times`: how often the mix holds the row."""
    chosen = (F.col("_key") == F.col("extra_key")) & (F.col("_tie") == F.col("extra_tie"))
    extra = (F.col("_size") <= _limit()) | F.coalesce(chosen, F.lit(False))
    return docs_with_plan.withColumn("times", F.col("epochs") + extra.cast("long"))


def _tie() -> F.Column:
    return F.xxhash64("doc_id", F.col("text")).alias("_tie")


def mix_counts(docs: DataFrame, seed: int = 11, most: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, times, taken (size times `times`) of each row.

    Null text has size 0; rows of size 0 come in with the sample up to its end. Rows that repeat
    doc_id and text share a key and are in or out of the sample together. Sources of size 0 have
    target 0. An empty table gives no rows.
    """
    keys = keyed(docs.select("doc_id", "text", "source"), seed).select(
        "doc_id", "source", "_size", "_key", _tie())
    keys = stored(keys, "keys")
    rows = times(_with_source(keys, plan(keys, most), F.size("limits")))
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "times",
                       (F.col("_size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, seed: int = 11, most: float = 3.0) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as it is taken, columns unchanged, whatever
    their names.

    Null text has size 0, a null source is a source like any other (the last one), repeated rows
    are in or out together, an empty table gives no rows. Texts stay where they are: keys are stored without them, and the few numbers of a source
    come back to the rows.
    """
    columns = docs.columns
    # The row is carried as one value, so its columns clash with nothing.
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    full = keyed(docs.select("doc_id", "text", "source", whole), seed).withColumn("_tie", _tie())
    full = full.select("source", "_row", "_size", "_key", "_tie")
    keys = stored(full.select(F.col("source"), "_size", "_key", "_tie"), "keys")
    ends = plan(keys, most).drop("source_size", "target")
    drop(keys)
    rows = times(_with_source(full, ends, F.size("limits")))
    rows = rows.where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select(*[F.col("_row")[c].alias(c) for c in columns])
