"""Readers: contract-driven files, scenario folders, multi-run unions, macro series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave.sources.contracts import Contract

SUFFIXES = ("parquet", "csv", "json", "asc")
SUPPORTED_CONTRACT_VERSIONS = ("1",)


class SourceError(ValueError):
    """A requested source is absent or not fit to be loaded."""


def _exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system the path belongs to, so that object stores work as well."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """One table by file suffix. Text formats are read as text: the contract checks must be
    able to see values that do not parse. Use `typed` to cast afterwards."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1]
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    if suffix == "json":
        # A single JSON array per file; one record per line needs no multiLine.
        return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if suffix == "asc":
        words = F.split(F.trim("value"), r"\s+")
        lines = spark.read.text(path).filter(F.trim("value") != "").select(words.alias("w"))
        header = F.col("w")[0] == contract.names[0]
        return lines.filter(~header).select(
            *[F.get("w", F.lit(i)).alias(n) for i, n in enumerate(contract.names)]
        )
    raise SourceError(f"no reader for {path!r}")


def typed(df: DataFrame, contract: Contract) -> DataFrame:
    """Contract columns in their types; values that do not parse become NULL."""
    fields = {f.name: f.dataType for f in contract.schema().fields}
    have = [n for n in contract.names if n in df.columns]
    return df.select(*[F.col(n).try_cast(fields[n]).alias(n) for n in have])


def load_scenario(
    spark: SparkSession, folder: str, contracts: Mapping[str, Contract]
) -> dict[str, DataFrame]:
    """Every table of a folder that is there; absent tables are absent from the result."""
    found = {}
    for name, contract in contracts.items():
        for suffix in SUFFIXES:
            path = f"{folder.rstrip('/')}/{name}.{suffix}"
            if _exists(spark, path):
                found[name] = read_table(spark, path, contract)
                break
    return found


RUN_TAGS = ("run_id", "suite_id", "scenario", "seed", "scale", "generator_version")


def union_runs(spark: SparkSession, runs: Sequence[Mapping[str, object]], table: str
               ) -> DataFrame:
    """One table of several runs, every row tagged with its run.

    Each run names `source_path` and the run tags. An empty selection is an error: nothing
    is loaded by default.
    """
    if not runs:
        raise SourceError("no runs selected")
    kinds = {"seed": "bigint"}

    def one(run: Mapping[str, object]) -> DataFrame:
        df = spark.read.parquet(f"{run['source_path']}/{table}.parquet")
        tags = [F.lit(run.get(t)).cast(kinds.get(t, "string")).alias(t) for t in RUN_TAGS]
        return df.select(*tags, *[c for c in df.columns if c not in RUN_TAGS])

    return reduce(lambda a, b: a.unionByName(b), [one(r) for r in runs])


def partitioned_runs(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """A table stored by run_id, restricted to the given runs by partition pruning."""
    stored = spark.read.parquet(path)
    tags = runs.select("run_id", *[t for t in RUN_TAGS[1:] if t in runs.columns
                                   and t not in stored.columns])
    return stored.join(tags, "run_id")


def select_sources(manifests: DataFrame, run_ids: Sequence[str] = (), suite_id: str | None = None
                   ) -> DataFrame:
    """Completed and validated runs of a selection; anything else requested is an error.

    Reads run_id, suite_id, status, validation_passed, global_content_hash and
    contract_version_set. Only offending ids come to the driver.
    """
    if bool(run_ids) == (suite_id is not None):
        raise SourceError("select either runs or a suite")
    wanted = (F.col("run_id").isin(*run_ids) if run_ids else F.col("suite_id") == suite_id)
    asked = manifests.filter(wanted)
    fit = (
        (F.col("status") == "completed")
        & F.col("validation_passed")
        & (F.coalesce(F.length("global_content_hash"), F.lit(0)) > 0)
        & F.col("contract_version_set").isin(*SUPPORTED_CONTRACT_VERSIONS)
    )
    state = asked.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(~F.coalesce(fit, F.lit(False)), F.col("run_id"))).alias("unfit"),
    ).first()
    if state["n"] == 0 or (run_ids and state["n"] < len(set(run_ids))):
        raise SourceError("a requested run or suite has no manifest")
    if state["unfit"] is not None:
        raise SourceError(f"run {state['unfit']!r} is not completed and validated")
    return asked


def read_macro_series(
    spark: SparkSession, path: str, source_id: str, series_code: int, unit: str,
    first: str, last: str,
) -> DataFrame:
    """Monthly observations [{data: dd/MM/yyyy, valor: text}] of a period, tagged as public."""
    raw = spark.read.option("multiLine", True).schema("data string, valor string").json(path)
    day = F.expr("try_to_date(data, 'dd/MM/yyyy')")
    return (
        raw.select(day.alias("reference_date"), F.col("valor").try_cast("double").alias("value"))
        .filter(F.col("reference_date").between(F.lit(first).cast("date"),
                                                F.lit(last).cast("date")))
        .select(
            F.lit("public_bcb_observation").alias("source_type"),
            F.lit(source_id).alias("source_id"),
            F.lit(series_code).alias("series_code"),
            "reference_date", "value",
            F.lit(unit).alias("unit"),
            F.lit(False).alias("is_synthetic"),
            F.lit(None).cast("timestamp").alias("retrieved_at"),
        )
    )
