"""Detections: one piece of logic each, run once, over a schedule, or on a stream.

``logic(rows, run, now)`` sees the rows of its look-back window. ``run`` names
extra grouping columns: none for a single run, the run time when many runs are
evaluated in one pass, the window when streaming. ``now`` is the moment of the
run, as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govlens.operators.filters import base, time_range
from govlens.operators.stats import baseline_spike, latest, stats, with_values
from govlens.operators.tables import ctime, top
from govlens.plans.reports.security import AUDIT_READ, EXPORT, IDENTITY, SIGN_IN
from govlens.session import shared_dir

EPOCH = datetime(1970, 1, 1)

# What an event detection looks for, the same in batch and on a stream.
MATCH = {
    "d_multi_ip": SIGN_IN,
    "d_sso": IDENTITY,
    "d_export": EXPORT,
    "d_apikey": "ai.event_category = 'admin_change' AND ai.resource.type = 'api_key'"
    " AND ai.action = 'create'",
    "d_role": "ai.event_category = 'admin_change' AND ai.resource.type = 'user'"
    " AND contains(lower(ai.event_type), 'role')",
    "d_chat": "ai.event_category = 'content_access' AND ai.resource.type = 'chat'"
    " AND ai.outcome = 'failure'",
    "d_newapi": AUDIT_READ,
}


@dataclass(frozen=True)
class Detection:
    key: str
    title: str
    record: str
    earliest: str
    latest: str
    period: timedelta  # time between runs
    offset: timedelta  # of the runs, from midnight UTC
    suppress: timedelta  # silence after a firing
    severity: int  # 0: a report, never an alert
    logic: Callable[..., DataFrame]
    # Rows combined before a schedule repeats them in overlapping windows.
    shrink: Callable[[DataFrame], DataFrame] | None = None
    every_run: bool = False  # runs without any row are evaluated, too
    time: str = "_time"


DETECTIONS: dict[str, Detection] = {}


def detection(key, title, record, earliest, period, suppress, severity, *, offset="0m", **more):
    def add(logic):
        DETECTIONS[key] = Detection(
            key,
            title,
            record,
            earliest,
            more.pop("latest", "now"),
            _delta(period),
            _delta(offset),
            _delta(suppress),
            severity,
            logic,
            **more,
        )
        return logic

    return add


def _delta(text: str) -> timedelta:
    unit = {"m": "minutes", "h": "hours", "d": "days"}[text[-1]]
    return timedelta(**{unit: int(text[:-1])})


def _rows(rows: DataFrame, run, **more) -> DataFrame:
    """Matching events themselves."""
    return rows.select(
        *run,
        "_time",
        F.col("ai.event_type").alias("event_type"),
        F.col("ai.actor.email").alias("user"),
        *[F.col(path).alias(name) for name, path in more.items()],
    )


LISTED = ("d_multi_ip", "d_chat")  # detections that list values next to each hit


@detection("d_multi_ip", "Several sign-in IPs for one user", "activity", "-24h", "6h", "12h", 4)
def multi_ip(rows, run, now):
    signed_in = rows.where(MATCH["d_multi_ip"]).select(
        *run, F.col("ai.actor.email").alias("user"), F.col("ai.actor.ip").alias("src_ip"), "_time"
    )
    return with_values(
        signed_in,
        [*run, "user"],
        "src_ip",
        "ips",
        distinct="ip_count",
        having=F.expr("ip_count >= 3"),
    )


@detection("d_sso", "SSO configuration change", "activity", "-1h", "1h", "30m", 5)
def sso(rows, run, now):
    return _rows(rows.where(MATCH["d_sso"]), run, organization_id="ai.org.id")


@detection("d_export", "Data export started", "activity", "-1h", "1h", "30m", 5, offset="5m")
def export(rows, run, now):
    return _rows(rows.where(MATCH["d_export"]), run, organization_id="ai.org.id")


@detection("d_topcost", "Top cost users", "user_cost", "-7d", "1d", "0m", 0, offset="480m")
def top_cost(rows, run, now):
    users = stats(
        rows.select(
            *run, F.col("ai.actor.email").alias("user"), F.col("ai.cost.amount_usd").alias("usd")
        ),
        {"total_cost_usd": F.sum("usd")},
        [*run, "user"],
    )
    order = [F.desc("total_cost_usd"), F.col("user")]
    if not run:
        return top(users, 20, order)
    rank = F.row_number().over(Window.partitionBy(*run).orderBy(*order))
    return users.withColumn("_rank", rank).where("_rank <= 20").drop("_rank")


@detection("d_apikey", "API key created", "activity", "-1h", "1h", "30m", 4, offset="10m")
def api_key(rows, run, now):
    return _rows(rows.where(MATCH["d_apikey"]), run, organization_id="ai.org.id")


@detection("d_role", "Role or permission escalation", "activity", "-1h", "1h", "30m", 5, offset="15m")
def role(rows, run, now):
    return _rows(rows.where(MATCH["d_role"]), run, organization_id="ai.org.id")


@detection("d_chat", "Chat access failure spike", "activity", "-1h", "1h", "2h", 4, offset="20m")
def chat_failures(rows, run, now):
    failed = rows.where(MATCH["d_chat"]).select(
        *run, F.col("ai.actor.email").alias("user"), F.col("ai.resource.id").alias("chat_id"), "_time"
    )
    return with_values(
        failed, [*run, "user"], "chat_id", "chats", count="count", having=F.expr("count >= 5")
    )


def _consumer_reads(rows: DataFrame) -> DataFrame:
    """Audit reads per consumer and half hour; runs start and end on half hours."""
    return (
        rows.where(MATCH["d_newapi"])
        .groupBy(
            F.col("ai.actor.user_agent").alias("user_agent"),
            F.col("ai.actor.ip").alias("src_ip"),
            F.window("_time", "30 minutes").alias("_slot"),
        )
        .agg(F.min("_time").alias("_time"), F.count("*").alias("n"))
        .drop("_slot")
    )


@detection(
    "d_newapi",
    "New audit API consumer",
    "activity",
    "-30d@d",
    "1d",
    "12h",
    4,
    offset="390m",
    shrink=_consumer_reads,
)
def new_consumer(rows, run, now):
    reads = rows if "n" in rows.columns else _consumer_reads(rows)
    return (
        stats(
            reads,
            {"first_seen": "min(_time)", "count": "sum(n)"},
            [*run, "user_agent", "src_ip"],
            F.expr(f"first_seen >= {now} - INTERVAL 1 DAY"),
        )
        .withColumn("first_seen", ctime("first_seen"))
    )


@detection(
    "d_limit",
    "Spend limit reached",
    "spend_limit",
    "-24h",
    "4h",
    "12h",
    4,
    offset="45m",
    time="collected_at",
)
def limit_reached(rows, run, now):
    """Snapshots keep the limit's own creation time, so the look-back goes by the
    time they were collected; the newest value per user decides."""
    limits = rows.select(
        *run,
        F.col("ai.actor.email").alias("user"),
        F.col("ai.cost.utilization_pct").alias("u"),
        F.col("ai.cost.spend_usd").alias("s"),
        F.col("ai.cost.limit_usd").alias("l"),
        "_time",
        "collected_at",
    )
    return stats(
        limits,
        {
            "utilization_pct": latest("u", "collected_at", "_time"),
            "period_spend_usd": latest("s", "collected_at", "_time"),
            "spend_limit_usd": latest("l", "collected_at", "_time"),
        },
        [*run, "user"],
        F.expr("utilization_pct >= 100"),
    )


def _daily_cost(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(F.date_trunc("day", "_time").alias("_time"))
        .agg(F.sum("ai.cost.amount_usd").alias("usd"))
    )


@detection(
    "d_spike",
    "Daily spend spike",
    "cost",
    "-9d@d",
    "1d",
    "20h",
    3,
    offset="540m",
    latest="@d",
    shrink=_daily_cost,
)
def spend_spike(rows, run, now):
    daily = rows if "usd" in rows.columns else _daily_cost(rows)
    return baseline_spike(daily, "usd", by=run)


def _newest_per_hour(rows: DataFrame) -> DataFrame:
    """One row per interval between runs; windows start and end on those."""
    return (
        rows.groupBy(F.window("_time", "1 hour", startTime="25 minutes").alias("_slot"))
        .agg(F.max("_time").alias("_time"))
        .drop("_slot")
    )


@detection(
    "d_stopped",
    "Ingestion stopped",
    "activity",
    "-7d",
    "1h",
    "4h",
    4,
    offset="25m",
    shrink=_newest_per_hour,
    every_run=True,
)
def ingestion_stopped(rows, run, now):
    """Newest event older than two hours, or no event at all."""
    newest = rows.select(*run, "_time")
    newest = newest.groupBy(*run) if run else newest
    lag = f"(unix_micros({now}) - coalesce(unix_micros(last), 0)) / 1000000"
    return newest.agg(F.max("_time").alias("last")).withColumn("lag_sec", F.expr(lag)).where(
        "lag_sec > 7200"
    )


def run(
    key: str,
    events: DataFrame,
    as_of: datetime,
    earliest: str | datetime | None = "default",
    latest: str | datetime | None = "default",
    provider: str | None = None,
) -> DataFrame:
    """One run at ``as_of``; ``None`` for a bound lifts it."""
    d = DETECTIONS[key]
    rows = time_range(
        base(events, d.record, provider),
        as_of,
        d.earliest if earliest == "default" else earliest,
        d.latest if latest == "default" else latest,
        d.time,
    )
    return d.logic(rows, [], f"TIMESTAMP '{as_of}'")


def _moment_sql(modifier: str, run_time: str) -> str:
    found = re.match(r"^(?:-(\d+)([hd]))?(@d)?$", "" if modifier == "now" else modifier)
    back, unit, snap = found.groups()
    at = f"{run_time} - INTERVAL {back} {'HOURS' if unit == 'h' else 'DAYS'}" if back else run_time
    return f"date_trunc('DAY', {at})" if snap else at


def runs(spark: SparkSession, d: Detection, start: datetime, end: datetime) -> DataFrame:
    """The scheduled run times in ``(start, end]``; their number is set by the schedule."""
    step = int(d.period.total_seconds())
    return spark.sql(
        f"SELECT explode(sequence(TIMESTAMP '{_first_run(d, start)}', TIMESTAMP '{end}',"
        f" INTERVAL {step} SECONDS)) AS run_time"
    )


def _first_run(d: Detection, start: datetime) -> datetime:
    origin = EPOCH + d.offset
    return origin + ((start - origin) // d.period + 1) * d.period


def on_schedule(d: Detection, rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Each row once per scheduled run whose window holds it.

    The runs are computed from the row's own time, so nothing is joined; the
    number of copies is the window length over the period, whatever the data.
    """
    step = int(d.period.total_seconds() * 1_000_000)
    origin = int(d.offset.total_seconds() * 1_000_000)
    first_run = int((_first_run(d, start) - EPOCH).total_seconds() * 1_000_000)
    last_run = int((end - EPOCH).total_seconds() * 1_000_000)
    back = re.match(r"^-(\d+)([hd])", d.earliest)
    reach = timedelta(**{"hours" if back[2] == "h" else "days": int(back[1])})
    # a window that starts on a whole day may begin up to a day earlier
    snap = timedelta(days=1) if d.earliest.endswith("@d") else timedelta(0)
    reach_us = int((reach + snap).total_seconds() * 1_000_000)
    t = f"unix_micros({d.time})"
    after = f"({origin}L + (floor(({t} - {origin}L) / {step}L) + 1) * {step}L)"
    from_us, to_us = f"greatest({after}, {first_run}L)", f"least({t} + {reach_us}L, {last_run}L)"
    grid = (
        f"explode(CASE WHEN {from_us} <= {to_us}"
        f" THEN sequence({from_us}, {to_us}, {step}L) ELSE array() END)"
    )
    return (
        rows.selectExpr("*", f"{grid} AS _run")
        .withColumn("run_time", F.timestamp_micros("_run"))
        .drop("_run")
        .where(f"{d.time} >= {_moment_sql(d.earliest, 'run_time')}")
        .where(f"{d.time} < {_moment_sql(d.latest, 'run_time')}")
    )


def backtest(
    key: str, events: DataFrame, start: datetime, end: datetime, provider: str | None = None
) -> DataFrame:
    """Hits of every scheduled run in ``(start, end]``, in one pass over the events.

    ``start`` and ``end`` bound the runs, not the events.
    """
    d = DETECTIONS[key]
    rows = base(events, d.record, provider)
    if d.shrink is not None:
        rows = d.shrink(rows)
    rows = on_schedule(d, rows, start, end)
    if d.every_run:
        rows = runs(events.sparkSession, d, start, end).join(rows, "run_time", "left")
    return d.logic(rows, ["run_time"], "run_time")


def firings(key: str, hits: DataFrame) -> DataFrame:
    """Runs with at least one hit: the alert condition."""
    d = DETECTIONS[key]
    # where a hit has a row per value, it is its subject that counts
    number = F.count_distinct("user") if key in LISTED else F.count("*")
    return (
        hits.groupBy("run_time")
        .agg(number.alias("hits"))
        .select(F.lit(key).alias("detection"), F.lit(d.severity).alias("severity"), "run_time", "hits")
    )


def throttle(fired: DataFrame, period: timedelta | None = None) -> DataFrame:
    """Firings left after each one silences its detection for the period.

    Input is one row per scheduled run, so a detection's list is as long as its
    schedule, never as its data. It is walked once, in time order.
    """
    silences = {d.key: d.suppress if period is None else period for d in DETECTIONS.values()}

    def walk(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values(["run_time", "hits"])
        kept, until = [], None
        for place, (key, run_time) in enumerate(zip(runs["detection"], runs["run_time"])):
            if until is None or run_time >= until:
                until = run_time + silences[key]
                kept.append(place)
        return runs.iloc[kept]

    columns = ["detection", "severity", "run_time", "hits"]
    rows = fired.select(*columns)
    return rows.groupBy("detection").applyInPandas(walk, rows.schema)


# What detections read of an event.
_READ = (
    "ai.vendor", "ai.record", "ai.event_category", "ai.event_type", "ai.action", "ai.outcome",
    "ai.actor.email", "ai.actor.ip", "ai.actor.user_agent", "ai.org.id", "ai.resource.type",
    "ai.resource.id", "ai.cost.amount_usd", "ai.cost.limit_usd", "ai.cost.spend_usd",
    "ai.cost.utilization_pct",
)


def _narrow(events: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """Events as ``keys`` read them; written once if there are several."""
    if len(keys) < 2:
        return events
    struct: dict[str, list[str]] = {}
    for path in _READ:
        _, *inner = path.split(".")
        struct.setdefault(inner[0] if len(inner) > 1 else "", []).append(path)
    members = []
    for group, paths in struct.items():
        pairs = ", ".join(f"'{p.rsplit('.', 1)[1]}', {p}" for p in paths)
        members.append(f"'{group}', named_struct({pairs})" if group else pairs)
    rows = base(events, record).selectExpr(
        f"named_struct({', '.join(members)}) AS ai", "_time", "collected_at"
    )
    path = shared_dir(events.sparkSession, "alerts")
    rows.write.parquet(path)
    return events.sparkSession.read.schema(rows.schema).parquet(path)


def alerts(
    events: Callable[[str], DataFrame], start: datetime, end: datetime, *keys: str
) -> DataFrame:
    """The alert table of a period: schedule, hits, condition, throttle.

    ``events`` gives the events of one record kind. What several detections read is
    computed once, as a narrow table in the shared scratch folder.
    """
    chosen = keys or [k for k, d in DETECTIONS.items() if d.severity]
    records = {DETECTIONS[k].record for k in chosen}
    feeds = {r: _narrow(events(r), r, [k for k in chosen if DETECTIONS[k].record == r]) for r in records}
    parts = [firings(k, backtest(k, feeds[DETECTIONS[k].record], start, end)) for k in chosen]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return throttle(out)
