"""Every report, detection and operator as a query over the driver's tables.

Reports and detections run over all time, so each one reads its whole table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens import providers
from govlens.functions import sql as sql_functions
from govlens.functions.rules import RuleBook, matched_rule_sql, rule_hits
from govlens.operators import joins
from govlens.operators.filters import base, raw, time_range
from govlens.operators.stats import first_seen, stats, timechart, trailing_baseline
from govlens.operators.tables import dedup_latest
from govlens.plans import detections as D
from govlens.plans import quality, rollup
from govlens.plans.normalize import normalize, redact_chats
from govlens.plans.reports import REPORTS
from govlens.plans.reports.security import SIGN_IN
from govlens.plans.reports.tokenomics import near_limit
from govlens.providers import Provider
from govlens.session import configure, shared_dir
from govlens.sources import bridge, collect, feeds, runlog, store
from govlens.streaming import detections as stream_detections
from govlens.streaming import ingest, stateful

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = datetime(2024, 1, 31)
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}
JANUARY = (datetime(2023, 12, 31), AS_OF)
ORDER_YEARS = (datetime(1994, 12, 31), datetime(2001, 12, 31))


def portable(df: DataFrame) -> DataFrame:
    """Types another engine prints alike: naive times, joined lists, rounded doubles."""
    columns = []
    for field in df.schema.fields:
        column, dtype = F.col(f"`{field.name}`"), field.dataType
        if isinstance(dtype, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(dtype, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        elif isinstance(dtype, T.DoubleType):
            column = F.round(column, 4)
        columns.append(column.alias(field.name))
    return df.select(*columns)


QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, d: portable(build(configure(spark), d))
        return build

    return add


# --- reports ------------------------------------------------------------------


def _report(key: str) -> Query:
    def build(spark, d):
        r = REPORTS[key]
        if r.source == "run_log":
            source = bridge.run_log(spark, d)
        else:
            source = bridge.events(spark, d, *r.records)
        # an hourly axis over decades of order dates would be mostly zeros
        earliest, latest = ("-31d@d", "now") if key == "th_01" else (None, None)
        return r(source, AS_OF, earliest=earliest, latest=latest)

    return build


for _key in REPORTS:
    query(_key)(_report(_key))


# Panels as they are shown: over their own range, seen from a moment with and one without data.
IN_RANGE = {
    "ov_05_range": ("ov_05", datetime(2024, 1, 20, 7, 30)),
    "se_08_range": ("se_08", datetime(2024, 1, 20, 7, 30)),
    "tk_09_range": ("tk_09", datetime(1996, 3, 5, 1)),
    "tk_09_empty": ("tk_09", datetime(2024, 1, 31)),
    "cc_01_range": ("cc_01", datetime(2024, 2, 3, 12)),
    "th_00_range": ("th_00", datetime(2024, 1, 30, 12)),
}


def _in_range(key: str, as_of: datetime) -> Query:
    return lambda spark, d: REPORTS[key](bridge.events(spark, d, *REPORTS[key].records), as_of)


for _name, (_key, _moment) in IN_RANGE.items():
    query(_name)(_in_range(_key, _moment))


@query("tk_04_users")
def _near_limit_users(spark, d):
    return near_limit(bridge.events(spark, d, "spend_limit"), AS_OF, latest_per_user=True)


# --- detections -----------------------------------------------------------------


def _detection(key: str) -> Query:
    return lambda spark, d: D.run(
        key, bridge.events(spark, d, D.DETECTIONS[key].record), AS_OF, None, None
    )


def _backtest(key: str) -> Query:
    record = D.DETECTIONS[key].record
    period = ORDER_YEARS if record in ("cost", "user_cost") else JANUARY
    return lambda spark, d: D.backtest(key, bridge.events(spark, d, record), *period)


for _key in D.DETECTIONS:
    query(_key)(_detection(_key))
    query(f"backtest_{_key}")(_backtest(_key))


@query("alerts")
def _alerts(spark, d):
    """All detections over January, and the spend spike over the years that have orders."""
    feed = lambda kind: bridge.events(spark, d, kind)
    return D.alerts(feed, *JANUARY).unionByName(D.alerts(feed, *ORDER_YEARS, "d_spike"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """The audit feed with all its events in one hour, so that counts per hour are high."""
    rows = bridge.activity_columns(bridge.dense(bridge.table(spark, d, "events")))
    return normalize(rows, "activity", collected_at=bridge.COLLECTED_AT)


@query("backtest_d_chat_dense")
def _backtest_chat(spark, d):
    return D.backtest("d_chat", _dense(spark, d), *JANUARY)


@query("d_stopped_later")
def _stopped_later(spark, d):
    """Seen from a day after the last event."""
    return D.run("d_stopped", bridge.events(spark, d, "activity"), datetime(2024, 2, 1), None, None)


@query("throttle_sso_6h")
def _throttle(spark, d):
    hits = D.backtest("d_sso", bridge.events(spark, d, "activity"), *JANUARY)
    return D.throttle(D.firings("d_sso", hits), D._delta("6h"))


# --- normalization: whole feeds as flat contract rows ------------------------------

_ACTOR = {"email": "ai.actor.email", "actor_id": "ai.actor.id"}
_HEAD = {"_time": "_time", "category": "ai.event_category"}


def _raw(*paths: str, dtype: str = "string") -> dict[str, tuple[str, str]]:
    return {f"raw_{p.replace('.', '_')}": (p, dtype) for p in paths}


NORMALIZED: dict[str, dict[str, str | tuple[str, str]]] = {
    "activity": {
        **_HEAD,
        **_ACTOR,
        "event_type": "ai.event_type",
        "event_id": "ai.event_id",
        "action": "ai.action",
        "outcome": "ai.outcome",
        "actor_type": "ai.actor.type",
        "ip": "ai.actor.ip",
        "user_agent": "ai.actor.user_agent",
        "org_id": "ai.org.id",
        "org_uuid": "ai.org.uuid",
        "resource_type": "ai.resource.type",
        "resource_id": "ai.resource.id",
        **_raw("visibility", "group_id", "claude_chat_id", "actor.api_key_id", "actor.directory_id"),
        **_raw("type"),
    },
    "user": {
        **_HEAD,
        **_ACTOR,
        "role": "ai.actor.role",
        "org_uuid": "ai.org.uuid",
        "resource_type": "ai.resource.type",
        "resource_id": "ai.resource.id",
        **_raw("id", "full_name", "email"),
    },
    "organization": {
        **_HEAD,
        "org_uuid": "ai.org.uuid",
        "resource_type": "ai.resource.type",
        "resource_id": "ai.resource.id",
        **_raw("uuid", "name", "created_at"),
    },
    "group": {
        **_HEAD,
        "resource_type": "ai.resource.type",
        "resource_id": "ai.resource.id",
        **_raw("name", "description", "source_type"),
        **_raw("roles", dtype="array<string>"),
    },
    "chat": {
        **_HEAD,
        "resource_type": "ai.resource.type",
        "resource_id": "ai.resource.id",
        **_raw("name", "messages"),
        **_raw("message_count", dtype="bigint"),
    },
    "file": {
        **_HEAD,
        "resource_type": "ai.resource.type",
        "resource_id": "ai.resource.id",
        **_raw("filename", "uploaded_by"),
        **_raw("size_bytes", dtype="bigint"),
    },
    "summary": {
        **_HEAD,
        **{
            n: f"ai.adoption.{n}"
            for n in (
                "daily_active_users",
                "weekly_active_users",
                "monthly_active_users",
                "seats",
                "pending_invites",
                "daily_rate",
                "weekly_rate",
                "monthly_rate",
            )
        },
        **_raw("ending_at"),
    },
    "usage": {
        **_HEAD,
        "model": "ai.model",
        "input_tokens": "ai.usage.input_tokens",
        "output_tokens": "ai.usage.output_tokens",
        "total_tokens": "ai.usage.total_tokens",
        **_raw("product", "model"),
        **_raw("uncached_input_tokens", dtype="bigint"),
    },
    "cost": {
        **_HEAD,
        "amount_usd": "ai.cost.amount_usd",
        "currency": "ai.cost.currency",
        **_raw("product", "model", "amount"),
    },
    "user_usage": {
        **_HEAD,
        **_ACTOR,
        "input_tokens": "ai.usage.input_tokens",
        "output_tokens": "ai.usage.output_tokens",
        "total_tokens": "ai.usage.total_tokens",
        **_raw("email"),
    },
    "user_cost": {**_HEAD, **_ACTOR, "amount_usd": "ai.cost.amount_usd", **_raw("email", "date")},
    "user_activity": {
        **_HEAD,
        **_ACTOR,
        **_raw(
            "claude_code_metrics.sessions",
            "claude_code_metrics.lines_of_code_added",
            "chat_metrics.messages_sent",
            "cowork_metrics.sessions",
            dtype="bigint",
        ),
    },
    "spend_limit": {
        **_HEAD,
        **_ACTOR,
        "resource_id": "ai.resource.id",
        "limit_usd": "ai.cost.limit_usd",
        "spend_usd": "ai.cost.spend_usd",
        "utilization_pct": "ai.cost.utilization_pct",
        **_raw("source.type", "source.seat_tier", "source.rbac_group_id", "period", "amount"),
    },
    "spend_limit_request": {
        **_HEAD,
        **_ACTOR,
        "resource_id": "ai.resource.id",
        "requested_limit_usd": "ai.cost.requested_limit_usd",
        "spend_usd": "ai.cost.spend_usd",
        **_raw("id", "status", "spend_summary"),
    },
}


def _flat(events: DataFrame, kind: str) -> DataFrame:
    """Contract columns by path, and members of ``raw`` by path and type."""
    return events.select(
        *[
            (F.col(path) if isinstance(path, str) else raw(events, *path)).alias(name)
            for name, path in NORMALIZED[kind].items()
        ]
    )


for _kind in NORMALIZED:
    query(f"normalize_{_kind}")(
        lambda spark, d, k=_kind: _flat(bridge.events(spark, d, k), k)
    )


def _landed(spark: SparkSession, d: str) -> DataFrame:
    """The activity feed written as JSON lines and read again."""
    path = shared_dir(spark, "landed")
    rows = bridge.feed(spark, d, "activity").select(F.to_json(F.struct("*"), MICROS))
    rows.write.text(path)
    return feeds.read_feed(spark, path, "activity")


@query("normalize_activity_json")
def _activity_json(spark, d):
    """The same feed landed as JSON lines: the VARIANT path."""
    events = normalize(_landed(spark, d), "activity", collected_at=bridge.COLLECTED_AT)
    return _flat(events, "activity")


@query("rule_hits")
def _rule_hits(spark, d):
    return rule_hits(bridge.events(spark, d, "activity"), providers.DEFAULT_RULES)


@query("rule_of_event")
def _rule_of_event(spark, d):
    """Deciding rule of every single event in each list, joined to the table of rules."""
    events = bridge.events(spark, d, "activity").select("ai.event_id", "ai.event_type")
    rules = providers.DEFAULT_RULES
    found = ", ".join(
        f"named_struct('kind', '{kind}', 'idx', {matched_rule_sql('event_type', rules, kind)})"
        for kind in ("category", "action", "resource", "outcome")
    )
    decided = events.selectExpr("event_id", f"explode(array({found})) AS f").select("event_id", "f.*")
    return decided.join(rules.table(spark), ["kind", "idx"]).select("event_id", "kind", "pattern", "value")


@query("sql_functions")
def _sql_functions(spark, d):
    sql_functions.register(spark)
    rows = bridge.feed(spark, d, "activity").selectExpr("type")
    cost = bridge.feed(spark, d, "cost").selectExpr("amount")
    classes = rows.groupBy("type").agg(F.count("*").alias("n")).selectExpr(
        "type AS name",
        "ai_classify(type, 'category') AS category",
        "ai_classify(type, 'outcome') AS outcome",
        "glob_match(type, 'org_*ed') AS org_past",
        "n",
    )
    usd = cost.selectExpr("cents_to_usd(amount) AS usd").agg(
        F.lit("cents").alias("name"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("outcome"),
        F.lit(None).cast("boolean").alias("org_past"),
        F.count("usd").alias("n"),
    )
    return classes.unionByName(usd)


# --- checks ---------------------------------------------------------------------


@query("violations")
def _violations(spark, d):
    """The contract checks on events that have been damaged on purpose."""
    events = bridge.events(spark, d)
    n = "CAST(substring_index(ai.event_id, '_', -1) AS BIGINT)"
    damaged = events.withColumn(
        "ai",
        F.col("ai")
        .withField("vendor", F.expr(f"CASE WHEN {n} % 50 = 0 THEN 'nobody' ELSE ai.vendor END"))
        .withField("action", F.expr(f"CASE WHEN {n} % 70 = 0 THEN NULL ELSE ai.action END"))
        .withField(
            "event_category",
            F.expr(
                "CASE WHEN ai.record = 'cost' AND ai.cost.amount_usd IS NULL THEN 'usage'"
                " ELSE ai.event_category END"
            ),
        )
        .withField("actor.email", F.expr(f"CASE WHEN {n} % 90 = 1 THEN 'null' ELSE ai.actor.email END")),
    )
    return quality.violation_counts(damaged)


@query("violations_clean")
def _violations_clean(spark, d):
    """Events of each kind, and how many broken rules the checks find in them: none."""
    events = bridge.events(spark, d)
    broken = quality.violation_counts(events).groupBy("record").agg(F.sum("count").alias("violations"))
    seen = events.groupBy("ai.record").agg(F.count("*").alias("events"))
    return seen.join(broken, "record", "left").fillna(0, ["violations"])


@query("coverage")
def _coverage(spark, d):
    return quality.coverage(bridge.events(spark, d))


@query("rule_problems")
def _rule_problems(spark, d):
    """Event names of the table as rule values: all lie outside the vocabulary."""
    names = bridge.table(spark, d, "events").select("event_type").distinct()
    values = names.select(F.lit("category").alias("kind"), F.col("event_type").alias("value"))
    allowed = providers.DEFAULT_RULES.table(spark).select("kind", "value").distinct()
    return values.join(allowed, ["kind", "value"], "left_anti")


@query("rule_problems_of")
def _rule_problems_of(spark, d):
    """Rules made of the table's event names: what their check says (V-07)."""
    names = bridge.table(spark, d, "events").select("event_type").distinct()
    rules = names.selectExpr("'action' AS kind", "event_type AS pattern", "event_type AS value")
    return quality.rule_table_problems(rules, "other", providers.VENDOR)


@query("category_gaps")
def _category_gaps(spark, d):
    """Records of the store without a fixed category, and gaps of the map itself (V-08)."""
    seen = bridge.events(spark, d).select("ai.record", "ai.event_category").distinct()
    open_ = seen.where("record <> 'activity'").groupBy("record").agg(
        F.count_distinct("event_category").alias("categories")
    )
    return open_.join(quality.category_map_gaps(spark), "record", "left")


@query("golden_damaged")
def _golden_damaged(spark, d):
    """Every seventh event lost on one side, every fifth twice on the other."""
    events = bridge.events(spark, d, "activity").withColumn(
        "n", F.expr("CAST(substring_index(ai.event_id, '_', -1) AS BIGINT)")
    )
    twice = events.where("n % 5 = 0")
    return quality.golden_diff(
        events.where("n % 7 <> 0").drop("n"), events.unionByName(twice).drop("n")
    ).groupBy("side").agg(F.sum("copies").alias("count"))


@query("golden_diff")
def _golden_diff(spark, d):
    """Typed path against JSON path over the whole feed: how many events, and how many differ."""
    a = bridge.events(spark, d, "activity")
    b = normalize(_landed(spark, d), "activity", collected_at=bridge.COLLECTED_AT)
    differ = quality.golden_diff(a, b).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("differ"))
    return a.agg(F.count("*").alias("events")).join(b.agg(F.count("*").alias("landed"))).join(differ)


# --- sources, cycles, store -------------------------------------------------------


@query("explode_pages")
def _explode_pages(spark, d):
    """Conversations as page documents of their rows' lines, exploded again."""
    pages = bridge.table(spark, d, "conversations").selectExpr(
        "conv_id",
        """try_parse_json(CASE WHEN turn = 1 THEN '{"data": "none", "has_more": false}'
            ELSE to_json(named_struct('data', transform(split(text, '\\n'),
                t -> named_struct('id', concat(conv_id, '-', turn), 'size', length(t))),
                'has_more', true)) END) AS record""",
    )
    records = feeds.explode_pages(pages)
    return records.selectExpr(
        "conv_id",
        "try_variant_get(record, '$.id', 'string') AS id",
        "try_variant_get(record, '$.size', 'bigint') AS size",
    ).groupBy("conv_id", "id").agg(F.count("*").alias("records"), F.sum("size").alias("size"))


@query("incremental_first")
def _incremental_first(spark, d):
    """State after a first cycle, 31 days back."""
    feed = bridge.feed(spark, d, "activity").where("created_at IS NOT NULL")
    rows, _ = collect.incremental(feed, collect.State(), AS_OF, backfill_days=31)
    return collect.watermark(rows)


@query("incremental_next")
def _incremental_next(spark, d):
    """All events after a given last one, in one uncut cycle."""
    feed = bridge.feed(spark, d, "activity")
    state = collect.State("activity_5", datetime(2024, 1, 10))
    rows, _ = collect.incremental(feed, state, AS_OF)
    return collect.watermark(rows)


@query("report_window")
def _report_window(spark, d):
    """Final days of the summary report at the as-of date."""
    start, end = collect.report_window(AS_OF, "2024-01-20")
    rows = collect.in_window(bridge.events(spark, d, "summary"), start, end)
    return rows.selectExpr("_time", "ai.adoption.daily_active_users AS daily_active_users")


@query("collect_cycle")
def _collect(spark, d):
    """Counts of one cycle with two switches off and one feed not available."""
    events = collect.collect(
        lambda kind: None if kind == "group" else bridge.feed(spark, d, kind),
        "main",
        AS_OF,
        {"collect_user_usage": False, "collect_cost": False},
        backfill_days=31,
    )
    return collect.ingest_counts(events).join(
        events.groupBy("sourcetype").agg(F.max("source").alias("source")), "sourcetype"
    )


class _Cycles:
    """Two cycles over a feed that grows: until 20 January, then all of it.

    The first one is throttled when it asks for groups and refused the chats.
    """

    done: dict[tuple[str, str], _Cycles] = {}

    def __init__(self, spark: SparkSession, d: str):
        self.spark = spark
        self.store, self.state, self.log = (shared_dir(spark, n) for n in ("cycles", "state", "log"))
        first = datetime(2024, 1, 20)

        def early(kind: str) -> DataFrame:
            if kind == "group":
                raise RuntimeError("Rate limited (429), gave up after 5 attempts")
            if kind == "chat":
                raise ConnectionError("connection refused")
            feed = bridge.feed(spark, d, kind)
            return feed.where(F.col("created_at") < first) if kind == "activity" else feed

        for feeds_of, when in ((early, first), (lambda kind: bridge.feed(spark, d, kind), AS_OF)):
            collect.run_cycle(
                spark, feeds_of, "main", when, self.store, self.state, self.log, backfill_days=31
            )

    @classmethod
    def of(cls, spark: SparkSession, d: str) -> _Cycles:
        """The cycles are the same for all queries of a session, so they run once in it."""
        key = (spark.sparkContext.applicationId, d)
        if key not in cls.done or not collect.StateTable(spark, cls.done[key].state).read()[0]:
            cls.done[key] = cls(spark, d)
        return cls.done[key]


@query("cycle_store")
def _cycle_store(spark, d):
    """What two cycles have loaded: each event once, the later delivery of what came twice."""
    events = store.read_store(spark, _Cycles.of(spark, d).store)
    return events.groupBy("record").agg(
        F.count("*").alias("count"), F.max("collected_at").alias("collected_at")
    )


@query("cycle_state")
def _cycle_state(spark, d):
    return collect.StateTable(spark, _Cycles.of(spark, d).state).rows()


def _cycle_report(key: str) -> Query:
    """A health report over the run log that the cycles wrote."""

    def build(spark, d):
        return REPORTS[key](runlog.read(spark, _Cycles.of(spark, d).log), AS_OF, None, None)

    return build


for _key in ("th_03", "th_04", "th_05"):
    query(f"{_key}_cycle")(_cycle_report(_key))


@query("bucket_feed")
def _bucket_feed(spark, d):
    """Usage and cost by hour, as a cycle normalizes them when it is told a bucket's width."""
    parts = [
        normalize(collect.bucket_feed(bridge.feed(spark, d, kind), kind, "1h"), kind, collected_at=AS_OF)
        for kind in ("usage", "cost")
    ]
    events = collect.union(parts)
    return events.select(
        "_time",
        "ai.record",
        raw(events, "product").alias("product"),
        "ai.model",
        "ai.usage.input_tokens",
        "ai.usage.output_tokens",
        "ai.usage.total_tokens",
        "ai.cost.amount_usd",
    )


@query("replay_events")
def _replay(spark, d):
    """Events written as JSON lines and read again (I-02)."""
    path = shared_dir(spark, "replay")
    store.export_json(bridge.events(spark, d, "activity"), path)
    return _flat(feeds.read_events(spark, path), "activity")


@query("collect_buckets")
def _buckets(spark, d):
    return collect.bucketed(bridge.events(spark, d, "usage", "cost"))


@query("ingest_counts")
def _ingest_counts(spark, d):
    return collect.ingest_counts(bridge.events(spark, d))


ORDER_KINDS = ("usage", "cost", "user_usage", "user_cost")


def _folded(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """A feed of which every row is kept, days of the order tables folded into one month.

    Their thousands of days would be as many folders of a store, of a few rows each.
    """
    feed = bridge.feed(spark, d, kind)
    column = "starting_at" if "starting_at" in feed.columns else "date"
    if kind in ORDER_KINDS:
        fold = f"timestampadd(DAY, day(CAST({column} AS DATE)) - 1, TIMESTAMP '2024-01-01 00:00:00')"
        feed = feed.withColumn(column, F.expr(fold).cast(feed.schema[column].dataType))
    return redact_chats(feed) if kind == "chat" else feed


def _folded_events(spark: SparkSession, d: str) -> DataFrame:
    return collect.union(
        [normalize(_folded(spark, d, k), k, collected_at=bridge.COLLECTED_AT) for k in feeds.FEEDS]
    )


@query("store_scan")
def _store_scan(spark, d):
    """All kinds written once, read with a predicate on the day."""
    path = shared_dir(spark, "store")
    store.write_events(_folded_events(spark, d), path)
    events = store.read_store(spark, path)
    rows = time_range(base(events), AS_OF, "-14d@d", "now")
    return stats(rows.select("event_date", "ai.record", "ai.event_category"), {"count": "count(*)"},
                 ["event_date", "record", "event_category"])


@query("upsert")
def _upsert(spark, d):
    """All events delivered, then all again with a later mark: each is kept once."""
    path = shared_dir(spark, "upsert")
    feed = bridge.feed(spark, d, "activity")
    store.upsert_events(normalize(feed, "activity", collected_at="2024-01-30 12:00:00"), path)
    store.upsert_events(normalize(feed, "activity", collected_at="2024-01-31 12:00:00"), path)
    return (
        store.read_store(spark, path)
        .groupBy("event_date")
        .agg(F.count("*").alias("count"), F.max("collected_at").alias("collected_at"))
    )


@query("upsert_kinds")
def _upsert_kinds(spark, d):
    """Every kind delivered twice: as many events as there are rows."""
    path = shared_dir(spark, "upsert")
    for _ in range(2):
        store.upsert_events(_folded_events(spark, d), path)
    return store.read_store(spark, path).groupBy("record").agg(F.count("*").alias("count"))


@query("upsert_reports")
def _upsert_reports(spark, d):
    """Report rows, which have no id, delivered twice: as many as there are rows.

    Their days are folded into one month, which keeps the store's folders few.
    """
    path = shared_dir(spark, "upsert")
    month = F.expr("timestampadd(DAY, day(starting_at) - 1, TIMESTAMP '2024-01-01 00:00:00')")
    for kind in ("usage", "cost"):
        feed = bridge.feed(spark, d, kind).withColumn("starting_at", month)
        for day in (30, 31):
            store.upsert_events(normalize(feed, kind, collected_at=f"2024-01-{day} 12:00:00"), path)
    return (
        store.read_store(spark, path)
        .groupBy("record")
        .agg(
            F.count("*").alias("count"),
            F.sum("ai.usage.output_tokens").alias("output_tokens"),
        )
    )


def _two_snapshots(spark, d):
    """Limits on two days; on the second nobody has spent anything."""
    path = shared_dir(spark, "limits")
    feed = bridge.feed(spark, d, "spend_limit")
    reset = feed.withColumn("period_to_date_spend", F.lit("0"))
    for day, rows in (("2024-01-30", feed), ("2024-02-02", reset)):
        store.upsert_events(normalize(rows, "spend_limit", collected_at=f"{day} 12:00:00"), path)
    return store.read_store(spark, path)


@query("upsert_snapshots")
def _upsert_snapshots(spark, d):
    return _two_snapshots(spark, d).groupBy("collected_at").agg(F.count("*").alias("count"))


@query("d_limit_store")
def _limit_store(spark, d):
    """Who had reached a limit on the first day, asked when the second is there."""
    return D.run("d_limit", _two_snapshots(spark, d), datetime(2024, 1, 30, 18))


@query("run_scope")
def _run_scope(spark, d):
    events = bridge.events(spark, d, "user_cost")
    both = store.stamp_run(events, "run1").unionByName(store.stamp_run(events, "run2"))
    return stats(store.of_run(both, "run2"), {"count": "count(*)"})


@query("union_kinds")
def _union_kinds(spark, d):
    events = bridge.events(spark, d)
    return events.groupBy("ai.record", "ai.event_category", "source").agg(
        F.count("*").alias("count"), F.min("_time").alias("first"), F.max("_time").alias("last")
    )


SECOND_VENDOR = Provider(
    vendor="openai",
    product="workspace",
    rules=RuleBook(
        vendor="openai",
        category=(("sign*", "authentication"), ("e?ror", "admin_change"), ("[!cv]*", "cost")),
        action=(("signup", "login"), ("*[ck]k", "update"), ("view", "read")),
        outcome=(("error", "failure"),),
    ),
)


@query("union_vendors")
def _union_vendors(spark, d):
    """A second vendor with its own event names and rules beside the first."""
    providers.register_provider(SECOND_VENDOR)
    native = bridge.table(spark, d, "events").selectExpr(
        "concat('b', event_id) AS id",
        "CAST(ts AS TIMESTAMP) AS created_at",
        "event_type AS type",
    )
    second = normalize(native, "activity", SECOND_VENDOR, bridge.COLLECTED_AT)
    events = collect.union([bridge.events(spark, d, "activity"), second])
    return events.groupBy(
        "ai.vendor",
        "ai.event_category",
        "ai.action",
        "ai.outcome",
        F.col("ai.resource.type").alias("resource_type"),
    ).agg(F.count("*").alias("count"))


# --- joins ------------------------------------------------------------------------


@query("users_with_org")
def _users_with_org(spark, d):
    tagged = joins.users_with_org(
        bridge.feed(spark, d, "user"), bridge.feed(spark, d, "organization")
    )
    return tagged.select("id", "organization_role", "organization_uuid", "organization_name")


def _targets(spark, d):
    """Every customer's address in capitals, and as many unknown ones."""
    return bridge.table(spark, d, "customer").selectExpr(
        "explode(array(upper(concat('cust', c_custkey, '@example.test')),"
        " concat('ghost', c_custkey, '@example.test'))) AS email"
    )


@query("chats_for_users")
def _chats_for_users(spark, d):
    return joins.chats_for_users(
        _targets(spark, d), bridge.feed(spark, d, "user"), bridge.feed(spark, d, "chat"), n=10
    )


@query("unmatched_targets")
def _unmatched(spark, d):
    return joins.unmatched_targets(_targets(spark, d), bridge.feed(spark, d, "user"))


@query("users_without_chats")
def _without_chats(spark, d):
    return joins.users_without_chats(
        _targets(spark, d), bridge.feed(spark, d, "user"), bridge.feed(spark, d, "chat")
    )


@query("group_members")
def _group_members(spark, d):
    return joins.group_members(bridge.feed(spark, d, "group"), bridge.members(spark, d))


@query("members_of")
def _members_of(spark, d):
    found = joins.members_of(
        bridge.feed(spark, d, "user"), bridge.members(spark, d), ["rbac_group_3", "rbac_group_7"]
    )
    return found.select("id", "full_name", "organization_role")


@query("users_in_both")
def _in_both(spark, d):
    """Users with a limit who have spent something, too."""
    return joins.users_in_both(
        bridge.events(spark, d, "spend_limit"), bridge.events(spark, d, "user_cost")
    )


def _directory(spark, d):
    """The audit feed's users as their directory had them, sync by sync."""
    return normalize(bridge.role_history(spark, d), "user")


@query("as_of_role")
def _as_of_role(spark, d):
    events = joins.as_of_role(bridge.events(spark, d, "activity"), _directory(spark, d))
    return events.select("ai.event_id", F.col("ai.actor.id").alias("actor_id"), "role")


@query("unknown_actors")
def _unknown_actors(spark, d):
    """Actors whom the directory did not have by the third day."""
    directory = time_range(_directory(spark, d), AS_OF, None, datetime(2024, 1, 3))
    return joins.unknown_actors(bridge.events(spark, d, "activity"), directory)


@query("sessions")
def _sessions(spark, d):
    return joins.sessions(bridge.events(spark, d, "activity"), "12 hours", SIGN_IN)


# --- operators --------------------------------------------------------------------


@query("time_range")
def _time_range(spark, d):
    events = bridge.events(spark, d, "activity")
    events = base(events, "activity", providers.VENDOR, AS_OF, "-9d@d", "@d")
    return stats(events.select("event_date"), {"count": "count(*)"}, ["event_date"])


@query("timechart_other")
def _timechart_other(spark, d):
    rows = bridge.events(spark, d, "activity").withColumn("actor_type", F.col("ai.event_type"))
    return timechart(rows, {"count": "count(*)"}, by="actor_type", limit=3)


@query("timechart_null")
def _timechart_null(spark, d):
    rows = bridge.events(spark, d, "activity").withColumn("resource", F.col("ai.resource.type"))
    return timechart(rows, {"count": "count(*)"}, by="resource", span="1 hour", limit=4)


@query("timechart_wide")
def _timechart_wide(spark, d):
    rows = bridge.events(spark, d, "activity").withColumn("outcome", F.col("ai.outcome"))
    return timechart(rows, {"count": "count(*)"}, by="outcome", pivot=True)


@query("dedup_latest")
def _dedup_latest(spark, d):
    """Newest event of each user."""
    rows = bridge.events(spark, d, "activity").select(
        F.col("ai.actor.id").alias("user_id"), "_time", "ai.event_id", "ai.event_type"
    )
    return dedup_latest(rows, ["user_id"], ["_time", "event_id"])


@query("trailing_baseline")
def _trailing(spark, d):
    events = bridge.events(spark, d, "cost")
    rows = events.select(
        "_time",
        raw(events, "product").alias("product"),
        F.col("ai.cost.amount_usd").alias("usd"),
    )
    return trailing_baseline(rows, "usd", ["product"])


@query("first_seen")
def _first_seen(spark, d):
    rows = bridge.events(spark, d, "activity").select(
        F.col("ai.actor.user_agent").alias("user_agent"), F.col("ai.actor.ip").alias("src_ip"), "_time"
    )
    return first_seen(rows, ["user_agent", "src_ip"])


# --- rollup -----------------------------------------------------------------------


@query("rollup_hourly")
def _rollup_hourly(spark, d):
    return rollup.hourly(bridge.events(spark, d, "activity"))


@query("rollup_counts")
def _rollup_counts(spark, d):
    path = shared_dir(spark, "rollup")
    rollup.update(_folded_events(spark, d), path)
    return rollup.counts(rollup.read(spark, path), "1 day")


@query("rollup_newest")
def _rollup_newest(spark, d):
    path = shared_dir(spark, "rollup")
    rollup.update(_folded_events(spark, d), path)
    return rollup.newest(rollup.read(spark, path))


# --- streams ----------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The activity feed as a stream over the events table."""
    schema = bridge.table(spark, d, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return normalize(bridge.activity_columns(files), "activity", collected_at=bridge.COLLECTED_AT)


def _finished(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = shared_dir(spark, "stream")
    started = ingest.write_stream(df, path, shared_dir(spark, "progress"))
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _window_stream(key: str) -> Query:
    return lambda spark, d: _finished(spark, stream_detections.windowed(key, _stream(spark, d)))


for _key in stream_detections.WINDOWED:
    query(f"stream_{_key}")(_window_stream(_key))


@query("stream_d_chat_dense")
def _stream_chat(spark, d):
    """The same over the feed with all events in one hour, and one much later that ends it."""
    path = shared_dir(spark, "dense")
    rows = bridge.dense(bridge.table(spark, d, "events"))
    rows.write.parquet(path)
    last = rows.orderBy(F.desc("ts")).limit(1).withColumns(
        {"ts": F.expr("ts + INTERVAL 6 HOURS"), "event_id": F.lit(0).cast("long")}
    )
    last.write.mode("append").parquet(path)
    stream = bridge.activity_columns(spark.readStream.schema(rows.schema).parquet(path))
    events = normalize(stream, "activity", collected_at=bridge.COLLECTED_AT)
    return _finished(spark, stream_detections.windowed("d_chat", events))


def _orders_stream(columns: Callable[[DataFrame], DataFrame], kind: str) -> Query:
    def build(spark, d):
        schema = bridge.table(spark, d, "orders").schema
        files = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
        return normalize(columns(files), kind, collected_at=bridge.COLLECTED_AT)

    return build


@query("stream_d_spike")
def _stream_spike(spark, d):
    events = _orders_stream(bridge.cost_columns, "cost")(spark, d)
    return _finished(spark, stateful.spend_spike(events))


@query("stream_d_topcost")
def _stream_topcost(spark, d):
    events = _orders_stream(bridge.user_cost_columns, "user_cost")(spark, d)
    return _finished(spark, stateful.top_cost(events))


@query("stream_d_limit")
def _stream_limit(spark, d):
    """Limits on two days, as a stream: the runs between them."""
    path = shared_dir(spark, "snapshots")
    snapshots = _two_snapshots(spark, d)
    snapshots.write.parquet(path)
    events = spark.readStream.schema(snapshots.schema).parquet(path)
    return _finished(spark, stateful.limit_reached(events))


@query("stream_d_stopped")
def _stream_stopped(spark, d):
    """The feed ended long ago, so its vendor's timer has run out when it has been read.

    A stream with such timers never ends by itself; it is stopped when the row is there.
    """
    df, path = stateful.stopped(_stream(spark, d)), shared_dir(spark, "stream")
    writer = df.writeStream.format("parquet").option("checkpointLocation", shared_dir(spark, "progress"))
    running = writer.option("path", path).trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 120
        while running.isActive and time.monotonic() < until:
            progress = running.lastProgress
            if progress and progress["batchId"] and any(op["numRowsTotal"] for op in progress["stateOperators"]):
                break  # the batch after the one that read the feed
            time.sleep(0.5)
        if running.exception():
            raise running.exception()
    finally:
        running.stop()
    found = spark.read.schema(df.schema).parquet(path)
    return found.where("lag_sec > 7200").select("vendor", "last").distinct()


@query("stream_sessions")
def _stream_sessions(spark, d):
    return _finished(spark, stateful.sessions(_stream(spark, d), "12 hours"))


@query("stream_feed")
def _stream_feed(spark, d):
    """The feed landed as JSON lines and read as a stream of files (I-03)."""
    path = shared_dir(spark, "landing")
    rows = bridge.feed(spark, d, "activity").select(F.to_json(F.struct("*"), MICROS))
    rows.repartition(3).write.text(path)
    stream = feeds.stream_feed(spark, path, "activity", max_files=2)
    events = normalize(stream, "activity", collected_at=bridge.COLLECTED_AT)
    return _flat(_finished(spark, events), "activity")


@query("stream_first_seen")
def _stream_first_seen(spark, d):
    """Every pair that occurs, once; within one batch any of its reads may be it."""
    found = _finished(spark, stream_detections.first_seen_consumers(_stream(spark, d)))
    return found.select("user_agent", "src_ip")


@query("stream_dedup")
def _stream_dedup(spark, d):
    twice = _stream(spark, d).withColumn("_copy", F.explode(F.expr("array(0, 1)"))).drop("_copy")
    events = _finished(spark, ingest.deduplicate(twice).select("ai.event_id", "event_date"))
    return events.groupBy("event_date").agg(F.count("*").alias("count"))


@query("stream_buckets")
def _stream_buckets(spark, d):
    return _finished(
        spark,
        ingest.bucket_sums(
            _stream(spark, d), {"count": "count(*)", "failures": "count_if(ai.outcome = 'failure')"}
        ),
    )


@query("stream_rollup")
def _stream_rollup(spark, d):
    paths = [shared_dir(spark, label) for label in ("events", "rollup", "progress")]
    ingest.load_rollup(_stream(spark, d), *paths).awaitTermination()
    return rollup.counts(rollup.read(spark, paths[1]), "1 hour")


@query("stream_throttle")
def _stream_throttle(spark, d):
    """Suppression as stream state over the firings of the chat and consumer detections."""
    events = bridge.events(spark, d, "activity")
    path = shared_dir(spark, "firings")
    for key in ("d_newapi", "d_multi_ip"):
        fired = D.firings(key, D.backtest(key, events, *JANUARY)).drop("severity")
        fired.write.mode("append").parquet(path)
    schema = "detection string, run_time timestamp, hits bigint"
    return _finished(spark, stream_detections.throttle(spark.readStream.schema(schema).parquet(path)))
