"""Shared helpers: table access, staged tables, text preparation."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import staging
from ..sources.staging import shared_dir  # noqa: F401

#: White space that ends a word: space and the ASCII controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bounds of an Arrow batch: a Python worker holds a batch several times over.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to those above, where they are higher.

    Plans are lazy and take the bounds when they run, so they stay lowered.
    """
    for key, most in ARROW_BATCH.items():
        now = re.match(r"(\d+)b?$", spark.conf.get(key, None) or "")
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; only Spark reads it, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` staged, with small Arrow batches."""
    small_batches(df.sparkSession)
    return staging.staged(df, name, rows)


def text_of(col: str = "text") -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 modulo 3 (a null id counts as not held out)."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string")) % 3) == 1, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with long keys under an equal expression, so that Spark forgets how it is dealt.

    Spark splits a hot key of a join only where both sides come straight from an
    exchange; an aggregate by the key is not one, and one more exchange of its few rows
    makes it so.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


_tables: dict[Hashable, Any] = {}


def worker_table(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one table at a time, so that operators that follow each other don't add up."""
    if key not in _tables:
        _tables.clear()
        trim()
        _tables[key] = make()
    return _tables[key]


def trim() -> None:
    """Hand freed memory, Arrow's too, back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)
