"""Single runs against our own small story, schedules against single runs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from govlens.plans import detections as D
from govlens.plans import rollup
from govlens.plans.normalize import normalize
from govlens.plans.reports import REPORTS
from govlens.sources import feeds, store
from govlens.streaming import detections as stream
from govlens.streaming import ingest

AS_OF = datetime(2026, 3, 10)


def event(i, when, kind, email="mia@example.test", ip=None, agent=None, **more):
    actor = {"type": "user_actor", "email_address": email, "ip_address": ip, "user_agent": agent}
    return {"id": f"a{i}", "created_at": when, "type": kind, "actor": actor, **more}


STORY = [
    *[event(i, f"2026-03-09T0{i}:10:00Z", "user_signed_in_sso", ip=f"10.0.0.{i}") for i in range(1, 5)],
    event(5, "2026-03-08T01:00:00Z", "user_signed_in_google", "bo@example.test", "10.0.0.9"),
    event(6, "2026-03-09T05:00:00Z", "org_sso_configuration_updated"),
    event(7, "2026-03-09T06:00:00Z", "org_data_export_started"),
    event(8, "2026-03-09T07:00:00Z", "workspace_api_key_created", "bo@example.test"),
    event(9, "2026-03-09T07:01:00Z", "org_api_key_revoked", "bo@example.test"),
    event(10, "2026-03-09T08:00:00Z", "rbac_role_assigned"),
    *[
        event(20 + i, f"2026-03-09T09:0{i}:00Z", "claude_chat_access_failed", claude_chat_id=f"c{i % 3}")
        for i in range(6)
    ],
    event(30, "2026-02-20T00:00:00Z", "compliance_api_accessed", None, "1.1.1.1", "old"),
    event(31, "2026-03-09T12:00:00Z", "compliance_api_accessed", None, "1.1.1.1", "old"),
    event(32, "2026-03-09T12:30:00Z", "compliance_api_accessed", None, "2.2.2.2", "new"),
]


@pytest.fixture
def events(spark, lines):
    feed = feeds.read_feed(spark, lines(STORY), "activity")
    return normalize(feed, "activity", collected_at=AS_OF).cache()


@pytest.mark.parametrize(
    "key, at, expected",
    [
        ("d_multi_ip", AS_OF, [("mia@example.test", 4)]),
        ("d_multi_ip", datetime(2026, 3, 9, 2), []),
        ("d_sso", datetime(2026, 3, 9, 6), [("mia@example.test", "org_sso_configuration_updated")]),
        ("d_sso", datetime(2026, 3, 9, 5), []),
        ("d_export", datetime(2026, 3, 9, 6, 5), [("mia@example.test", "org_data_export_started")]),
        ("d_apikey", datetime(2026, 3, 9, 7, 10), [("bo@example.test", "workspace_api_key_created")]),
        ("d_role", datetime(2026, 3, 9, 8, 15), [("mia@example.test", "rbac_role_assigned")]),
        ("d_chat", datetime(2026, 3, 9, 9, 20), [("mia@example.test", 6)]),
    ],
)
def test_single_run(events, key, at, expected):
    second = {"d_multi_ip": "ip_count", "d_chat": "count"}.get(key, "event_type")
    rows = [(r.user, r[second]) for r in D.run(key, events, at).collect()]
    assert (sorted(set(rows)) if key in D.LISTED else rows) == expected


def test_a_hit_counts_once_whatever_it_lists(spark):
    rows = [(datetime(2026, 3, 1), "u", 2500, f"10.0.{k // 250}.{k % 250}") for k in range(2500)]
    hits = spark.createDataFrame(rows, "run_time timestamp, user string, ip_count long, ips string")
    assert [r["hits"] for r in D.firings("d_multi_ip", hits).collect()] == [1]


def test_new_consumer(events):
    got = D.run("d_newapi", events, datetime(2026, 3, 10, 6, 30)).collect()
    assert [(r.user_agent, r.src_ip, r.first_seen, r["count"]) for r in got] == [
        ("new", "2.2.2.2", "03/09/2026 12:30:00", 1)
    ]


def test_ingestion_stopped(events):
    assert D.run("d_stopped", events, datetime(2026, 3, 9, 13)).count() == 0
    late = D.run("d_stopped", events, datetime(2026, 3, 9, 15)).first()
    assert (str(late.last), late.lag_sec) == ("2026-03-09 12:30:00", 9000.0)
    none = D.run("d_stopped", events, datetime(2026, 5, 1)).first()
    assert none.last is None and none.lag_sec > 1e9


def limits(spark, lines, rows):
    records = [
        {"created_at": "2025-01-01T00:00:00Z", "email": e, "user_id": e, "amount": a, "period_to_date_spend": s}
        for e, a, s in rows
    ]
    return feeds.read_feed(spark, lines(records), "spend_limit")


def test_spend_limits_go_by_collection_time(spark, lines):
    first = limits(spark, lines, [("a", "100", "100"), ("b", "0.000000", None), ("c", "100", "50")])
    one = normalize(first, "spend_limit", collected_at="2026-03-09 01:00:00")
    got = D.run("d_limit", one, AS_OF).collect()
    assert sorted((r.user, r.utilization_pct) for r in got) == [("a", 100.0), ("b", 100.0)]
    # A newer snapshot below the limit wins; after a day without one, silence.
    second = limits(spark, lambda r: lines(r, "two.jsonl"), [("a", "100", "20")])
    both = one.unionByName(normalize(second, "spend_limit", collected_at="2026-03-09 05:00:00"))
    assert [r.user for r in D.run("d_limit", both, AS_OF).collect()] == ["b"]
    assert D.run("d_limit", both, datetime(2026, 3, 20)).count() == 0
    assert REPORTS["tk_04"](both, AS_OF, None, None).first()["count"] == 2


@pytest.mark.parametrize("key", [k for k, d in D.DETECTIONS.items() if d.record == "activity"])
def test_schedule_equals_single_runs(spark, events, key):
    d = D.DETECTIONS[key]
    start, end = datetime(2026, 3, 8, 23), datetime(2026, 3, 10)
    hits = D.backtest(key, events, start, end).withColumn("run_time", F.col("run_time").cast("string"))
    got = {}
    for row in hits.collect():
        fields = row.asDict()
        got.setdefault(fields.pop("run_time"), []).append(str(sorted(fields.items())))
    for run_time in [r[0] for r in D.runs(spark, d, start, end).selectExpr("CAST(run_time AS STRING)").collect()]:
        single = D.run(key, events, datetime.fromisoformat(run_time)).collect()
        expected = sorted(str(sorted(r.asDict().items())) for r in single)
        assert sorted(got.pop(run_time, [])) == expected, run_time
    assert got == {}


def test_throttle_walks_from_firing_to_firing(spark):
    hours = [0, 1, 2, 3, 7, 8, 14, 30]
    fired = spark.createDataFrame([("d_multi_ip", 4, h, 1) for h in hours], "detection string, severity int, h int, hits long")
    fired = fired.selectExpr(
        "detection", "severity", "TIMESTAMP '2026-01-01 00:00:00' + make_dt_interval(0, h) AS run_time", "hits"
    )
    kept = D.throttle(fired, timedelta(hours=6)).selectExpr("(unix_seconds(run_time) - 1767225600) div 3600 AS h")
    assert sorted(r.h for r in kept.collect()) == [0, 7, 14, 30]
    assert D.throttle(fired).count() == 3  # twelve hours, the detection's own period


def finished(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    ingest.write_stream(df, path, str(tmp_path / f"{name}-progress")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def streamed(spark, lines, records=STORY, **kwargs):
    # A last event far ahead closes every window of the story.
    path = lines([*records, event(99, "2026-04-09T12:30:00Z", "billing_plan_updated")], "in/part.jsonl")
    feed = feeds.stream_feed(spark, path.rsplit("/", 1)[0], "activity", **kwargs)
    return normalize(feed, "activity", collected_at=AS_OF)


@pytest.fixture
def nested(lines, tmp_path):
    (tmp_path / "in").mkdir()
    return lines


@pytest.mark.parametrize("key", stream.WINDOWED)
def test_stream_equals_batch(spark, nested, events, tmp_path, key):
    got = finished(spark, stream.windowed(key, streamed(spark, nested, max_files=1)), tmp_path, "hits")
    batch = D.backtest(key, events, datetime(2026, 3, 1), datetime(2026, 3, 12))
    if key in ("d_multi_ip", "d_chat"):
        expected = batch.select(*got.columns).distinct()
    else:
        expected = D.firings(key, batch).select("run_time", "hits")
    assert expected.count() > 0
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_rare_matches_do_not_hold_the_watermark(spark, nested, tmp_path):
    hits = stream.windowed("d_export", streamed(spark, nested))
    assert finished(spark, hits, tmp_path, "hits").count() == 1


def test_stream_drops_repeated_events(spark, nested, tmp_path):
    rows = ingest.deduplicate(streamed(spark, nested, STORY + STORY)).select("ai.event_id")
    assert finished(spark, rows, tmp_path, "once").count() == len(STORY) + 1


def test_stream_loads_store_and_rollup(spark, nested, tmp_path):
    paths = [str(tmp_path / n) for n in ("events", "rollup", "progress")]
    ingest.load_rollup(streamed(spark, nested), *paths).awaitTermination()
    stored = store.read_store(spark, paths[0])
    assert stored.count() == len(STORY) + 1
    fresh = rollup.hourly(stored)
    kept = rollup.read(spark, paths[1]).drop("event_date")
    assert kept.select(*fresh.columns).exceptAll(fresh).count() == 0
    assert rollup.counts(kept, "1 day").agg(F.sum("count")).first()[0] == len(STORY) + 1


def test_throttled_stream_equals_batch(spark, tmp_path):
    fired = spark.range(40).selectExpr(
        "IF(id % 2 = 0, 'd_multi_ip', 'd_stopped') AS detection",
        "TIMESTAMP '2026-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS run_time",
        "id AS hits",
    )
    path = str(tmp_path / "fired")
    fired.coalesce(1).write.parquet(path)
    kept = finished(spark, stream.throttle(spark.readStream.schema(fired.schema).parquet(path)), tmp_path, "kept")
    expected = D.throttle(fired.withColumn("severity", F.lit(4))).drop("severity")
    assert expected.count() < 40
    assert kept.exceptAll(expected).count() == 0 and expected.exceptAll(kept).count() == 0
