"""Session settings the package relies on.

Everything here is a default: a value the cluster has already set is kept.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g",
    extra: Mapping[str, str] | None = None,
) -> SparkSession:
    """Session for tests and for the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loanweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    A folder of this machine is made only if none is named and the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return named or current
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="loanweave-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
    return named


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="loanweave-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "loanweave.zip")  # the driver hands it out
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in os.walk(root):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(where, name)
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result is stored in the shared folder and its lineage is cut.

    For small intermediate results that several later steps read, and between model fits.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once, stored in the shared folder in compressed columns and read from there.

    For large intermediate results. Column names may be anything, also equal but for case.
    """
    if any(t in df.schema.simpleString() for t in (":void", ":interval", "<void", "<interval")):
        return settle(df)  # has no columnar form
    path = f"{checkpoint_dir(df.sparkSession)}/kept_{uuid.uuid4().hex}"
    columns = df.columns
    named = df.toDF(*[f"c{i}" for i in range(len(columns))])
    named.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(named.schema).parquet(path)
    return back.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
