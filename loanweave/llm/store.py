"""Working tables and files in the folder that all executors share.

The folder is the one the cluster names in `spark.checkpoint.dir`. A folder of this machine is
made only if the setting is missing and the master is local.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="loanweave-llm-")
    return _LOCAL[app]


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="loanweave-zip-"), "loanweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end_with_their_job(spark: SparkSession):
    """Shuffle files of a job whose result is stored as a table are of no further use."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back: lineage is cut, and a
    lost executor costs nothing that was already stored."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _shuffles_end_with_their_job(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete working tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = table.__dict__.pop("_stored_at", None) if table is not None else None
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it; used by tasks to write and read files of their own format."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, chunks) -> tuple[str, int]:
    """Write under a name no other attempt uses, and give back path and size.

    Only the rows that Spark commits name files, so what a lost or repeated attempt has left
    behind is never read.
    """
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    size = 0
    with fs.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return path, size


def open_file(folder: str, path: str):
    fs, _ = file_system(folder)
    return fs.open_input_file(path)
