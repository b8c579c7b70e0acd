"""Our own extras: the batch operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SOURCE_COLUMNS
from ..sources.store import NoManifest, Store


def slot_counts(events: DataFrame, time: str, keys: list[str], late: str = "1 hour", width: str = "4 hours") -> DataFrame:
    """Counts per tumbling slot; rows later than the watermark are dropped by a
    stream and kept by a batch."""
    timed = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    return timed.groupBy(F.window("__time", width).alias("slot"), *keys).agg(F.count("*").alias("rows")).select(F.col("slot.start").alias("slot_start"), *keys, "rows")


def first_copies(stream: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Exact duplicates removed within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(SOURCE_COLUMNS)


def refresh_each(stream: DataFrame, path: str, checkpoint: str, rebuild: Callable[[DataFrame], None]):
    """A query that appends each batch of raw rows to path and rebuilds the
    layers from all of it.  A batch that is run again overwrites its own part,
    so a restart neither loses nor repeats rows."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        rebuild(batch.sparkSession.read.parquet(path).drop("batch"))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def summary_each(stream: DataFrame, store: Store, checkpoint: str, summarise: Callable[[DataFrame], DataFrame], keys: list[str], count: str):
    """A query that upkeeps the store's `summary` (keys, count): each batch is
    summarised on its own and added by key, so a batch costs by its rows and
    by the summary, not by what came before.  Counts may be negative, for rows
    taken back.  The summary and the number of its last batch are published
    together, so a batch that is run again after a restart changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        own = Store(batch.sparkSession, store.path)
        delta = summarise(batch).select(*keys, count)
        try:
            manifest = own.current()
        except NoManifest:
            own.refresh({"summary": delta}, str(number))
            return
        if int(manifest["label"]) < number:
            merged = own.layer("summary", manifest).select(*keys, count).unionByName(delta).groupBy(*keys).agg(F.sum(count).alias(count)).filter(F.col(count) != 0)
            own.refresh({"summary": merged}, str(number))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
