"""Hourly rollup of the event table: counts, sums and times that merge further."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.operators.stats import bucket
from govlens.sources.store import of_days
from govlens.sources.versions import VersionedTable

KEYS = (
    "hour",
    "sourcetype",
    "vendor",
    "record",
    "event_category",
    "event_type",
    "action",
    "outcome",
)


def hourly(events: DataFrame) -> DataFrame:
    """One row per hour and combination of closed fields."""
    return (
        events.select(
            bucket(span="1 hour").alias("hour"),
            "sourcetype",
            "ai.vendor",
            "ai.record",
            "ai.event_category",
            "ai.event_type",
            "ai.action",
            "ai.outcome",
            "ai.usage.total_tokens",
            "ai.cost.amount_usd",
            "_time",
        )
        .groupBy(*KEYS)
        .agg(
            F.count("*").alias("count"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("amount_usd").alias("amount_usd"),
            F.min("_time").alias("first_time"),
            F.max("_time").alias("last_time"),
        )
    )


SCHEMA = T.StructType(
    [T.StructField("hour", T.TimestampType())]
    + [T.StructField(key, T.StringType()) for key in KEYS[1:]]
    + [
        T.StructField("count", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("amount_usd", T.DoubleType()),
        T.StructField("first_time", T.TimestampType()),
        T.StructField("last_time", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)


def _table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["event_date"], SCHEMA)


def update(events: DataFrame, path: str, days: DataFrame | None = None) -> None:
    """Rebuild the touched days from the events, replacing those days only.

    ``days(event_date)`` names them, by default all days of the events. Rebuilding
    a day again gives the same day, so a repeated batch does no harm. Readers see the old
    days until all new ones are written (``versions``).
    """
    if days is not None:
        events = of_days(events, days)
    rows = hourly(events).withColumn("event_date", F.to_date("hour"))
    rows = rows.hint("rebalance", F.col("event_date"))
    _table(events.sparkSession, path).write(rows, True, days)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path).read()


def counts(rollup: DataFrame, span: str = "1 hour", by: str = "sourcetype") -> DataFrame:
    """Counts per bucket and key, summed up from partial counts."""
    rows = rollup.withColumn("_time", F.col("hour"))
    return (
        rows.groupBy(bucket(span=span).alias("bucket"), by)
        .agg(F.sum("count").alias("count"))
    )


def newest(rollup: DataFrame, by: str = "sourcetype") -> DataFrame:
    return rollup.groupBy(by).agg(F.max("last_time").alias("last"))
