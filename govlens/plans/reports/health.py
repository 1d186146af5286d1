"""State of the collection pipeline, from the events and from our own run log."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from govlens.operators.filters import at
from govlens.operators.stats import stats, timechart
from govlens.operators.tables import stamp, table, top
from govlens.plans.reports.registry import report as _report

report = partial(_report, earliest="-24h")
# Terms, as whole words, that mark a throttled or failed request in the run log.
RETRY = r"(?i)\b(?:Rate limited|429|APIError)\b"


@report("th_00", "Ingestion lag by sourcetype")
def lag(ev, as_of):
    """Two pruned columns per record; the rollup answers the same in fewer rows."""
    newest = stats(ev, {"_last": "max(_time)"}, ["sourcetype"])
    minutes = (
        F.unix_micros(at(as_of)) - F.unix_micros("_last")
    ) / 60_000_000
    return newest.select(
        "sourcetype", stamp("_last").alias("last"), F.round(minutes, 1).alias("lag_minutes")
    ).orderBy(F.desc("lag_minutes"), "sourcetype")


@report("th_01", "Event volume by sourcetype", chart=True)
def volume(ev, as_of, over):
    return timechart(ev, {"count": "count(*)"}, by="sourcetype", span="1 hour", **over)


@report("th_02", "Top event types", "activity")
def event_types(ev, as_of):
    rows = ev.withColumn("event_type", F.col("ai.event_type"))
    return top(
        stats(rows, {"count": "count(*)"}, ["event_type"]),
        15,
        [F.desc("count"), F.col("event_type")],
    )


@report("th_03", "Input errors", source="run_log")
def errors(log, as_of):
    rows = log.where(F.col("level") == "ERROR")
    return stats(rows, {"count": "count(*)"}, ["source"]).orderBy(F.desc("count"), "source")


@report("th_04", "Latest input errors", source="run_log")
def latest_errors(log, as_of):
    return table(
        log.where(F.col("level") == "ERROR"),
        {"_time": "ts", "source": "source", "_raw": "message"},
        [F.desc("ts"), F.col("source"), F.col("message")],
        limit=20,
    )


@report("th_05", "Retry and rate-limit trend", source="run_log", chart=True)
def retries(log, as_of, over):
    rows = log.where(F.col("message").rlike(RETRY)).withColumn("_time", F.col("ts"))
    return timechart(rows, {"count": "count(*)"}, span="1 hour", zero=["count"], **over)
