"""A manifest kept from a stream of run entries, on a store of a bucketed base and deltas.

Each micro-batch is committed under its number, so one that is tried again changes nothing;
every ``compact_every`` batches the deltas are folded into the buckets that they touch, so a
read goes over the base and at most that many deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.manifest_store import ManifestStore


def start(entries: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str, buckets: int = 64, compact_every: int = 20, **trigger) -> StreamingQuery:
    """Begin to keep the manifest below ``path``."""

    def commit(batch: DataFrame, number: int) -> None:
        store = ManifestStore(batch.sparkSession, path, keys, seq, buckets)
        store.commit(number, batch)
        if len(store.version()[1]["deltas"]) >= compact_every:
            store.compact()

    writer = entries.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def manifest(spark: SparkSession, path: str, keys: list[str], seq: str) -> DataFrame:
    """The manifest as it stands."""
    return ManifestStore(spark, path, keys, seq).read()


def windowed_progress(entries: DataFrame, time: str, group: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Entries by group and event-time window, with late ones up to a watermark."""
    return entries.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), group).agg(F.count("*").alias("n"))
