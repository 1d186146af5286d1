"""Detections on a stream: sliding look-back windows and throttled alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from govlens.operators.filters import base
from govlens.plans.detections import DETECTIONS, MATCH, _delta
from govlens.streaming.ingest import ACTIVITY_DELAY

# Detections whose look-back is a plain sliding window.
WINDOWED = ("d_multi_ip", "d_sso", "d_export", "d_apikey", "d_role", "d_chat")


def _seconds(delta) -> str:
    return f"{int(delta.total_seconds())} seconds"


def _matching(events: DataFrame, key: str, delay: str) -> DataFrame:
    """Rows a detection looks for, with a watermark that all events move.

    The comparison with the time keeps the condition above the watermark. Below it,
    where Spark would push it, time would stand still between two rare matches and
    the window of the last one would not close.
    """
    rows = base(events, DETECTIONS[key].record).withWatermark("_time", delay)
    return rows.where(f"({MATCH[key]}) = (_time >= TIMESTAMP '0001-01-01 00:00:00')")


def windowed(key: str, events: DataFrame, delay: str = ACTIVITY_DELAY) -> DataFrame:
    """Hits per window, given out when the watermark passes its end.

    The window's end is the run time of the batch schedule, so both agree:
    (run_time, keys…, measure).
    """
    d = DETECTIONS[key]
    rows = _matching(events, key, delay)
    look_back = _seconds(_delta(d.earliest.removeprefix("-")))
    window = F.window(
        "_time", look_back, _seconds(d.period), _seconds(d.offset % d.period)
    ).alias("window")
    if key == "d_multi_ip":
        # Distinct addresses first, so that a busy user's state is spread by address.
        pairs = (
            rows.groupBy(
                window, F.col("ai.actor.email").alias("user"), F.col("ai.actor.ip").alias("ip")
            )
            .agg(F.count("*").alias("n"))
        )
        # Null users and addresses go last, for the same reason.
        hits = pairs.groupBy("window", "user").agg(F.count("ip").alias("ip_count"))
        return hits.where("CASE WHEN ip_count >= 3 THEN user END IS NOT NULL").select(
            F.col("window.end").alias("run_time"), "user", "ip_count"
        )
    if key == "d_chat":
        hits = rows.groupBy(window, F.col("ai.actor.email").alias("user")).agg(
            F.count("*").alias("count")
        )
        return hits.where("CASE WHEN count >= 5 THEN user END IS NOT NULL").select(
            F.col("window.end").alias("run_time"), "user", "count"
        )
    # The others report matching rows; what alerts is their number per window.
    return (
        rows.groupBy(window)
        .agg(F.count("*").alias("hits"))
        .select(F.col("window.end").alias("run_time"), "hits")
    )


def first_seen_consumers(events: DataFrame, baseline: str = "30 days") -> DataFrame:
    """First audit read of a (user agent, address) pair within the baseline."""
    reads = _matching(events, "d_newapi", baseline).select(
        F.col("ai.actor.user_agent").alias("user_agent"),
        F.col("ai.actor.ip").alias("src_ip"),
        F.col("_time").alias("first_seen"),
    )
    return reads.dropDuplicatesWithinWatermark(["user_agent", "src_ip"]).where(
        "user_agent IS NOT NULL AND src_ip IS NOT NULL"
    )


class Silence(StatefulProcessor):
    """Lets a firing pass and holds back the next ones for the suppress period."""

    def __init__(self, seconds: dict[str, int]):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        silence = pd.Timedelta(seconds=self.seconds[key[0]])
        until = self.until.get()[0] if self.until.exists() else None
        until = None if until is None else pd.Timestamp(until)
        kept = []
        fired = pd.concat(list(rows)).sort_values("run_time")
        for run_time, hits in zip(fired["run_time"], fired["hits"]):
            if until is None or run_time >= until:
                until = run_time + silence
                kept.append((key[0], run_time, hits))
        if kept:
            self.until.update((until.to_pydatetime(),))
        yield pd.DataFrame(kept, columns=["detection", "run_time", "hits"])

    def close(self) -> None:
        pass


def throttle(fired: DataFrame) -> DataFrame:
    """Firings ``(detection, run_time, hits)`` left after suppression.

    State is one time per detection. A batch brings one row per run and
    detection, as many as runs have become due.
    """
    seconds = {k: int(d.suppress.total_seconds()) for k, d in DETECTIONS.items()}
    return fired.groupBy("detection").transformWithStateInPandas(
        statefulProcessor=Silence(seconds),
        outputStructType="detection string, run_time timestamp, hits bigint",
        outputMode="Append",
        timeMode="None",
    )
