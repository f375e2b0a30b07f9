"""Run manifests: keyed upserts, sharding, skip logic and progress."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .matching import keep_last

T = TypeVar("T")


def upsert(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last entry of each key by ``seq``; entries with a null key are all kept."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    return keep_last(log.filter(~any_null), keys, seq).select(*log.columns).unionByName(log.filter(any_null))


def ranks(rows: DataFrame, *order: str, buckets: int | None = None) -> DataFrame:
    """``position``: 0-based place of each row in the whole order, without one task that sees all rows.

    Rows are sorted into ranges; a range's first place is the number of rows before it.
    The sorted ranges are staged: a lost task reads them again rather than deal anew.
    """
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    dealt = staged(dealt, "ranges")
    offsets = dealt.groupBy("__part").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("__part", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    out = dealt.join(F.broadcast(offsets), "__part")  # one row for each partition
    return out.withColumn("position", F.col("__before") + F.col("__id") - F.col("__first")).select(*rows.columns, "position")


def shard(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """``position`` in the sorted rows, ``part`` (position modulo parts) and the part's artefact suffix."""
    if parts < 1:
        raise ValueError("parts must be at least 1")
    part = F.col("position") % parts
    suffix = F.format_string(f".part%d" + f"of{parts}", (part + 1).cast("int")) if parts > 1 else F.lit("")
    return ranks(rows, *order).withColumns({"part": part, "suffix": suffix})


def pending(inputs: DataFrame, done: DataFrame, keys: list[str], complete: Column | None = None, overwrite: bool = False) -> DataFrame:
    """Inputs without a complete output; all of them when outputs are to be overwritten."""
    if overwrite:
        return inputs
    return inputs.join((done if complete is None else done.filter(complete)).select(*keys), keys, "left_anti")


def previously_skipped(rows: DataFrame, log: DataFrame, keys: list[str], again: bool = False) -> DataFrame:
    """Rows with an entry in the skip log, or (``again``) those without one."""
    return rows.join(log.select(*keys), keys, "left_anti" if again else "left_semi")


def skip_state(inputs: DataFrame, previous: DataFrame, keys: list[str], signature: str, fingerprint: str | None = None) -> DataFrame:
    """``state``: new (no earlier run), changed (another signature, or fingerprint) or current (to be skipped)."""
    old = previous.select(*keys, F.col(signature).alias("__sig"), *([F.col(fingerprint).alias("__fp")] if fingerprint else []), F.lit(True).alias("__old"))
    out = inputs.join(old, keys, "left")
    same = F.col(signature).eqNullSafe(F.col("__sig"))
    if fingerprint:
        same = same & F.col(fingerprint).eqNullSafe(F.col("__fp"))
    return out.select(*inputs.columns, F.when(F.col("__old").isNull(), "new").when(same, "current").otherwise("changed").alias("state"))


def retry_schedule(failures: DataFrame, retries: int, kind: str = "exponential", base: float = 5.0, cap: float = 60.0) -> DataFrame:
    """Each failure's attempts with the seconds waited before each: doubling up to a cap (exponential), in proportion to the attempt (linear) or always the same (fixed)."""
    attempt = F.col("attempt")
    waits = {"exponential": F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt)), "linear": base * (attempt + 1), "fixed": F.lit(float(base))}
    if kind not in waits:
        raise ValueError(f"kind must be one of {', '.join(waits)}")
    return failures.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries - 1)))).withColumn("wait_seconds", waits[kind].cast("double"))


def with_retries(call: Callable[[], T], retries: int, wait: Callable[[int], float], retryable: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep) -> T:
    """A driver-side call, tried again after errors that allow it; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == retries or not retryable(e):
                raise
            sleep(wait(attempt))
    raise AssertionError("unreachable")


def progress(inputs: DataFrame, done: DataFrame, group: str, keys: list[str], skipped: DataFrame | None = None) -> DataFrame:
    """Inputs, done (and skipped), remaining and percent for each group, and in total (group TOTAL)."""
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(1))
    flags = inputs.join(mark(done, "__done"), keys, "left")
    extra = [] if skipped is None else [F.count(F.when(F.col("__done").isNull(), F.col("__skipped"))).alias("n_skipped")]
    if skipped is not None:
        flags = flags.join(mark(skipped, "__skipped"), keys, "left")
    out = flags.rollup(group).agg(F.count("*").alias("n_input"), F.count("__done").alias("n_done"), *extra, F.grouping(group).alias("__all"))
    gone = F.col("n_done") + (F.col("n_skipped") if extra else F.lit(0))
    percent = F.when(F.col("n_input") > 0, F.col("n_done") * 100.0 / F.col("n_input")).otherwise(0.0)
    return out.select(
        F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col(group)).alias(group), "n_input", "n_done", *(["n_skipped"] if extra else []),
        F.greatest(F.lit(0), F.col("n_input") - gone).cast("long").alias("n_remaining"), F.round(percent, 2).alias("percent")
    )
