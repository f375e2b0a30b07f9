"""Intermediate tables as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a staged table's file, where the number of rows is known to be small.
ROWS_A_FILE = 100_000

#: Bytes that a writer of a staged table holds before it writes them.
ROW_GROUP = 32 << 20

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a temporary folder is made, which goes when
    the program ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark.sparkContext, "_rasterlake_shared", None)
        if not found:
            folder = tempfile.mkdtemp(prefix="rasterlake-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            found = spark.sparkContext._rasterlake_shared = f"file://{folder}"
    return found.rstrip("/")


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    The written table cuts the lineage: a lost executor costs the tasks that it
    ran, never the stages before.  ``rows``, a bound of its rows, keeps tables of few
    rows out of many small files: one for each core, or for each ``ROWS_A_FILE`` rows.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // ROWS_A_FILE))
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """The name of a folder of its own below the shared one, for files."""
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged within go at its end, when nothing may read them any more."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table and ledger of the shared folder (call it between jobs)."""
    for folder in ("staged", "ledgers", "files"):
        delete(spark, f"{shared_dir(spark)}/{folder}")
