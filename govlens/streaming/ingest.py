"""From landed files to the event store and the rollup, as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from govlens.plans import rollup
from govlens.plans.normalize import as_stored
from govlens.sources import store

# Fixed value: reports are final after three days; audit events come sooner.
REPORT_DELAY, ACTIVITY_DELAY = "3 days", "1 hour"


def deduplicate(events: DataFrame, delay: str = ACTIVITY_DELAY) -> DataFrame:
    """Each named event once; state for a key is dropped when the watermark has passed it.

    Rows without an id are no copies of each other, whatever they share, and pass.
    """
    rows = as_stored(events).withWatermark("_time", delay)
    named = rows.where("ai.event_id IS NOT NULL").withColumn("_key", store.event_key())
    once = named.dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return once.unionByName(rows.where("ai.event_id IS NULL"))


def bucket_sums(
    events: DataFrame, aggs: dict[str, str], span: str = "1 day", delay: str = REPORT_DELAY
) -> DataFrame:
    """Aggregates per tumbling bucket, given out once the bucket is final."""
    grouped = events.withWatermark("_time", delay).groupBy(F.window("_time", span))
    return grouped.agg(*[F.expr(sql).alias(name) for name, sql in aggs.items()]).select(
        F.col("window.start").alias("bucket"), *aggs
    )


def write_stream(
    df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()
) -> StreamingQuery:
    """Append to a Parquet table, each input once, until the input is used up."""
    writer = df.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (
        writer.option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def load_store(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Load the store; a batch that is run again after a failure changes nothing."""
    return _each_batch(events, checkpoint, lambda batch: store.upsert_events(batch, path))


def load_rollup(events: DataFrame, store_path: str, path: str, checkpoint: str) -> StreamingQuery:
    """Load the store, then rebuild the rollup of the days the batch touched."""

    def update(batch: DataFrame) -> None:
        store.upsert_events(batch, store_path)
        rollup.update(store.read_store(batch.sparkSession, store_path), path, batch)

    return _each_batch(events, checkpoint, update)


def _each_batch(
    df: DataFrame, checkpoint: str, action: Callable[[DataFrame], None]
) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(lambda batch, _: action(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
