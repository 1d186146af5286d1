"""Collection cycles: what to read since last time, and where the last one ended."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import providers
from govlens.functions import values as V
from govlens.operators.filters import at, raw
from govlens.plans.normalize import as_stored, normalize, redact_chats
from govlens.providers import Provider
from govlens.sources import runlog, store
from govlens.sources.feeds import FEEDS, Fields
from govlens.sources.versions import Ledger

# Defaults of a collection cycle.
BACKFILL_DAYS = 7
FINAL_AFTER_DAYS, FIRST_WINDOW_DAYS = 3, 7
# Switch name and the feeds it turns on.
TOGGLES = {
    "collect_summaries": ("summary",),
    "collect_usage": ("usage",),
    "collect_cost": ("cost",),
    "collect_user_usage": ("user_usage",),
    "collect_user_cost": ("user_cost",),
    "collect_user_activity": ("user_activity",),
    "collect_spend_limits": ("spend_limit", "spend_limit_request"),
}
_DAY = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])")
BUCKETS = {"1d": "1 day", "1h": "1 hour", "1m": "1 minute"}


@dataclass(frozen=True)
class State:
    """Where a feed's last cycle ended."""

    last_id: str | None = None
    last_created_at: datetime | None = None
    last_finalized: str | None = None
    last_sync: datetime | None = None


def incremental(
    feed: DataFrame,
    state: State,
    as_of: datetime,
    backfill_days: int = BACKFILL_DAYS,
    max_rows: int | None = None,
) -> tuple[DataFrame, Callable[[], State]]:
    """The next cycle of the activity feed, oldest first, and its end state.

    The first cycle goes back ``backfill_days``, later ones go on after the last event.
    A cycle takes all there is; with ``max_rows`` it takes the oldest so many and the
    next cycle goes on there. The state is computed when it is asked for, which is after
    the cycle was written, and an empty cycle leaves it alone.
    """
    created, own = _cursor(feed)
    if state.last_id is None:
        since = as_of - timedelta(days=backfill_days)
        rows = feed.where(created >= at(since))
    else:
        last = at(state.last_created_at)
        rows = feed.where((created > last) | ((created == last) & (own > F.lit(state.last_id))))
    if max_rows is not None:
        rows = rows.orderBy(created, own).limit(max_rows)
    return rows, lambda: advance(state, rows)


def _cursor(feed: DataFrame) -> tuple[Column, Column]:
    """Time and id of an activity record, typed or landed as JSON."""
    f = Fields(feed, "activity")
    return F.expr(V.event_time(f["created_at"], f.dtype("created_at"))), F.expr(f["id"])


def watermark(rows: DataFrame) -> DataFrame:
    """The last event of a cycle as one row: (last_id, last_created_at, count)."""
    created, own = _cursor(rows)
    return rows.agg(
        F.max_by(own, F.struct(created, own)).alias("last_id"),
        F.max(created).alias("last_created_at"),
        F.count("*").alias("count"),
    )


def advance(state: State, rows: DataFrame) -> State:
    last = watermark(rows).selectExpr("last_id", "CAST(last_created_at AS STRING) AS at", "count").first()
    if last["count"] == 0:
        return state
    return replace(state, last_id=last["last_id"], last_created_at=datetime.fromisoformat(last["at"]))


def report_window(
    as_of: datetime, last_finalized: date | str | None = None, lag_days: int = FINAL_AFTER_DAYS
) -> tuple[date, date]:
    """Days ``[start, end)`` to read: reports are final some days after the fact.

    A window starts on the last one's final day, but holds a day at least; the first one
    has its own length, and so has one after a state that names no day.
    """
    end = as_of.date() - timedelta(days=lag_days)
    known = finalized_day(last_finalized)
    if known is None:
        return end - timedelta(days=FIRST_WINDOW_DAYS), end
    return (known if known < end else end - timedelta(days=1)), end


def finalized_day(value: date | str | None) -> date | None:
    """The day that a state row names, if it names one."""
    if value is None or isinstance(value, date):
        return value
    return date(*map(int, value.split("-"))) if _DAY.fullmatch(value) else None


def in_window(events: DataFrame, start: date, end: date) -> DataFrame:
    return events.where(
        (F.col("_time") >= F.expr(f"TIMESTAMP '{start} 00:00:00'"))
        & (F.col("_time") < F.expr(f"TIMESTAMP '{end} 00:00:00'"))
    )


def enabled(toggles: dict[str, bool] | None = None) -> list[str]:
    """Report feeds that are switched on; a switch that is not named is on."""
    toggles = toggles or {}
    return [kind for name, kinds in TOGGLES.items() if toggles.get(name, True) for kind in kinds]


def bucketed(events: DataFrame, width: str = "1d") -> DataFrame:
    """Usage and cost summed per bucket, product and model."""
    return (
        events.groupBy(
            F.window("_time", BUCKETS[width])["start"].alias("bucket"),
            "ai.record",
            raw(events, "product").alias("product"),
            F.col("ai.model").alias("model"),
        )
        .agg(
            F.sum("ai.usage.total_tokens").alias("total_tokens"),
            F.sum("ai.cost.amount_usd").alias("amount_usd"),
        )
    )


def bucket_feed(feed: DataFrame, kind: str, width: str = "1d") -> DataFrame:
    """A usage or cost feed as the provider reports it when asked for buckets of a width.

    One record per bucket, product and model (and currency), with sums of what it counts; a
    record whose time cannot be read is in the bucket without a time.
    """
    f = Fields(feed, kind, own=("product", "model", "currency"))
    time = V.event_time(f["starting_at"], f.dtype("starting_at"))
    start = F.window(F.expr(time), BUCKETS[width])["start"] if width != "1d" else F.date_trunc("day", F.expr(time))
    keys = ["product", "model"] + (["currency"] if kind == "cost" else [])
    rows = feed.select(start.alias("starting_at"), *[F.expr(f[k]).alias(k) for k in keys], *_counted(f, kind))
    counted = [c for c in rows.columns if c not in ("starting_at", *keys)]
    sums = rows.groupBy("starting_at", *keys).agg(*[F.sum(c).alias(c) for c in counted])
    if kind == "cost":  # decimal text again, as the wire has it
        sums = sums.withColumn("amount", F.expr("CAST(CAST(amount AS DECIMAL(38, 6)) AS STRING)"))
    return sums.withColumn("bucket_width", F.lit(width))


def _counted(f: Fields, kind: str) -> list[Column]:
    if kind == "cost":
        whole = f"{V.number(f['total_cost_usd'])}"
        return [F.expr(f"coalesce(100 * ({whole}), {V.number(f['amount'])})").alias("amount")]
    tokens = [c for c in FEEDS[kind].columns if c.endswith("_tokens")]
    return [F.expr(f[c]).alias(c) for c in tokens]


BUCKETED = ("usage", "cost")
DIRECTORY = ("organization", "user", "group")


def wanted(toggles: dict[str, bool] | None = None, full_access: bool = True) -> list[str]:
    """The feeds of a cycle. An account without full access has neither directory nor content."""
    more = [*DIRECTORY, "chat", "file"] if full_access else []
    return ["activity", *enabled(toggles), *more]


def collected(
    landed: DataFrame,
    kind: str,
    account: str,
    as_of: datetime,
    state: State = State(),
    provider: Provider = providers.DEFAULT,
    include_messages: bool = False,
    bucket_width: str | None = None,
    backfill_days: int = BACKFILL_DAYS,
) -> tuple[DataFrame, Callable[[], State]]:
    """The events of one feed's next cycle, and the state after it, to be asked for then.

    Activity goes on after the last event; reports are cut to their final days, by bucket
    if a width is given; spend limits and the directory are current state and come whole.
    """
    after = lambda: state
    if kind == "activity":
        landed, after = incremental(landed, state, as_of, backfill_days)
    if kind == "chat":
        landed = redact_chats(landed, include_messages)
    if kind in DIRECTORY:
        after = lambda: replace(state, last_sync=as_of)
    if bucket_width is not None and kind in BUCKETED:
        landed = bucket_feed(landed, kind, bucket_width)
    events = normalize(landed, kind, provider, as_of, account)
    if FEEDS[kind].area == "analytics" and not kind.startswith("spend_limit"):
        start, end = report_window(as_of, state.last_finalized)
        events = in_window(events, start, end)
        after = lambda: replace(state, last_finalized=end.isoformat())
    return events, after


def collect(
    feeds: Callable[[str], DataFrame | None],
    account: str,
    as_of: datetime,
    toggles: dict[str, bool] | None = None,
    provider: Provider = providers.DEFAULT,
    include_messages: bool = False,
    full_access: bool = True,
    state: State = State(),
    bucket_width: str | None = None,
    backfill_days: int = BACKFILL_DAYS,
) -> DataFrame:
    """One cycle over all feeds of an account, as events.

    ``feeds`` gives a landed feed or None where the account may not read it. ``state``
    stands for all feeds; ``run_cycle`` keeps one for each and loads the store.
    """
    parts = []
    for kind in wanted(toggles, full_access):
        landed = feeds(kind)
        if landed is not None:
            events, _ = collected(
                landed, kind, account, as_of, state, provider, include_messages, bucket_width, backfill_days
            )
            parts.append(events)
    return union(parts)


class StateTable:
    """Where each input's last cycle ended, in versions.

    A version is added behind the one that its cycle started from, or not at all: of two
    cycles that start alike only the first to end moves the state.
    """

    SCHEMA = "input STRING, last_id STRING, last_created_at TIMESTAMP, last_finalized STRING, last_sync TIMESTAMP"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.ledger = spark, Ledger(spark, path, self.SCHEMA)

    def rows(self) -> DataFrame:
        """The state of each input, a row each, with the version that it is from."""
        columns = [c.split()[0] for c in self.SCHEMA.split(", ")]
        newest = F.max_by(F.struct(*columns[1:]), "entry").alias("s")
        rows = self.ledger.rows().groupBy("input").agg(newest, F.max("entry").alias("version"))
        return rows.select("input", "s.*", "version")

    def read(self) -> tuple[int, dict[str, State]]:
        """The version, and states by input: as many as there are feeds."""
        version = self.ledger.version()
        texts = ("last_created_at", "last_sync")
        rows = self.rows().withColumns({c: F.col(c).cast("string") for c in texts}).collect()
        moment = lambda text: None if text is None else datetime.fromisoformat(text)
        return version, {
            r["input"]: State(r.last_id, moment(r.last_created_at), r.last_finalized, moment(r.last_sync))
            for r in rows
        }

    def commit(self, version: int, states: dict[str, State]) -> int:
        text = lambda when: None if when is None else str(when)
        rows = [
            (kind, s.last_id, text(s.last_created_at), s.last_finalized, text(s.last_sync))
            for kind, s in states.items()
        ]
        frame = self.spark.createDataFrame(rows, self.SCHEMA.replace("TIMESTAMP", "STRING"))
        frame = frame.withColumns({c: F.to_timestamp(c) for c in ("last_created_at", "last_sync")})
        return self.ledger.commit(frame.coalesce(1), version)


def run_cycle(
    spark: SparkSession,
    feeds: Callable[[str], DataFrame | None],
    account: str,
    as_of: datetime,
    store_path: str,
    state_path: str,
    log_path: str | None = None,
    toggles: dict[str, bool] | None = None,
    full_access: bool = True,
    **options,
) -> dict[str, int]:
    """Collect what is new into the store and move the state; gives loaded events by feed.

    Feeds are loaded one after the other, each as a whole. One that fails leaves a line in
    the run log and its state where it was; the others go on. States are committed once,
    after all loads: a cycle that is lost before is run again from the same place, and the
    store takes what it has already without a change. A feed without events leaves its
    cursor alone, and a cycle that moves nothing commits nothing.
    """
    table = StateTable(spark, state_path)
    version, states = table.read()
    moved: dict[str, State] = {}
    log, counts = [], {}
    for kind in wanted(toggles, full_access):
        source = FEEDS[kind].lineage(options.get("provider", providers.DEFAULT).vendor, account)
        state = states.get(kind, State())
        try:
            landed = feeds(kind)
            if landed is None:
                continue
            events, after = collected(landed, kind, account, as_of, state, **options)
            counts[kind] = store.upsert_events(events, store_path)
            ended = after()
        except Exception as error:
            log.append(runlog.failed(as_of, source, error))
            continue
        log.append(runlog.done(as_of, source, counts[kind]))
        if ended != state:
            moved[kind] = ended
    if moved:
        table.commit(version, moved)
    if log_path is not None:
        runlog.append(spark, log_path, log)
    return counts


def union(parts: list[DataFrame]) -> DataFrame:
    """Feeds or vendors below one another; the event row is the same for all."""
    if len(parts) == 1:
        return parts[0]
    stored = [as_stored(part) for part in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stored)


def ingest_counts(events: DataFrame) -> DataFrame:
    """Events per sourcetype; kinds without any do not show."""
    return events.groupBy("sourcetype").agg(F.count("*").alias("count"))
