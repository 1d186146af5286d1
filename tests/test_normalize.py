"""Small records of our own for every feed, through the open and the typed path."""

import json

import pytest
from pyspark.sql import functions as F

from govlens import contract, providers
from govlens.functions import values
from govlens.plans import quality
from govlens.plans.normalize import as_stored, normalize, redact_chats
from govlens.sources import feeds, store

AT = "2026-03-01 12:00:00"
HEAD = {"schema_version": "1.0.0", "vendor": providers.VENDOR, "product": providers.PRODUCT}
MIA = {"email": "mia@example.test", "id": "u1"}

# feed -> (record, expected ai without the head, expected raw)
CASES = {
    "activity": [
        (
            {
                "id": "a1",
                "created_at": "2026-02-03T10:00:00+01:00",
                "type": "project_visibility_changed",
                "actor": {
                    "type": "user_actor",
                    "user_id": "u1",
                    "email_address": "",
                    "email": "mia@example.test",
                    "ip_address": None,
                    "user_agent": "ua",
                    "api_key_id": "k1",
                },
                "organization_id": "o1",
                "organization_uuid": "",
                "claude_chat_id": "c1",
                "claude_project_id": "p1",
                "visibility": "private",
                "extra": {"deep": {"gone": None, "empty": ""}, "list": [None, "", {"x": None}]},
            },
            {
                "time": "2026-02-03T09:00:00Z",
                "record": "activity",
                "event_category": "admin_change",
                "event_type": "project_visibility_changed",
                "event_id": "a1",
                "action": "update",
                "outcome": "success",
                "actor": {**MIA, "type": "user_actor", "user_agent": "ua"},
                "org": {"id": "o1"},
                "resource": {"type": "project", "id": "p1"},
            },
            {
                "claude_chat_id": "c1",
                "claude_project_id": "p1",
                "visibility": "private",
                "actor": {"api_key_id": "k1"},
                "extra": {"list": ["", {}]},
            },
        ),
        (
            {"id": "a2", "created_at": "2026-02-03T10:00:00Z", "type": "", "event": "chat_created"},
            {
                "time": "2026-02-03T10:00:00Z",
                "record": "activity",
                "event_category": "usage",
                "event_type": "chat_created",
                "event_id": "a2",
                "action": "create",
                "outcome": "success",
            },
            None,
        ),
        (
            {
                "id": "a3",
                "created_at": "2026-02-03T10:00:00Z",
                "type": "chat_shared",
                "file_id": "f1",
                "actor": None,
            },
            {
                "time": "2026-02-03T10:00:00Z",
                "record": "activity",
                "event_category": "usage",
                "event_type": "chat_shared",
                "event_id": "a3",
                "action": "unknown",
                "outcome": "success",
                "resource": {"type": "other", "id": "f1"},
            },
            {"file_id": "f1"},
        ),
    ],
    "user": [
        (
            {
                "id": "u1",
                "full_name": "Mia",
                "email": "mia@example.test",
                "organization_role": "admin",
                "organization_uuid": "o-1",
                "created_at": "2026-01-01T00:00:00Z",
            },
            {
                "time": "2026-03-01T12:00:00Z",
                "record": "user",
                "event_category": "policy",
                "actor": {**MIA, "role": "admin"},
                "org": {"uuid": "o-1"},
                "resource": {"type": "user", "id": "u1"},
            },
            {"id": "u1", "full_name": "Mia", "created_at": "2026-01-01T00:00:00Z"},
        )
    ],
    "organization": [
        (
            {"uuid": "o-1", "name": ""},
            {
                "time": "2026-03-01T12:00:00Z",
                "record": "organization",
                "event_category": "policy",
                "org": {"uuid": "o-1"},
                "resource": {"type": "org", "id": "o-1"},
            },
            {"uuid": "o-1"},
        )
    ],
    "group": [
        (
            {"id": "g1", "name": "Ops", "roles": []},
            {
                "time": "2026-03-01T12:00:00Z",
                "record": "group",
                "event_category": "policy",
                "resource": {"type": "group", "id": "g1"},
            },
            {"id": "g1", "name": "Ops", "roles": []},
        )
    ],
    "file": [
        (
            {"id": "f1", "size_bytes": 10},
            {
                "time": "2026-03-01T12:00:00Z",
                "record": "file",
                "event_category": "content_access",
                "resource": {"type": "file", "id": "f1"},
            },
            {"id": "f1", "size_bytes": 10},
        )
    ],
    "summary": [
        (
            {"date": "2026-02-01", "daily_active_user_count": 3, "daily_adoption_rate": 38, "x": 1},
            {
                "time": "2026-02-01T00:00:00Z",
                "record": "summary",
                "event_category": "usage",
                "adoption": {"daily_active_users": 3, "daily_rate": 38.0},
            },
            {"x": 1},
        )
    ],
    "usage": [
        (
            {
                "starting_at": "2026-02-01T00:00:00Z",
                "date": "2026-02-09",
                "model": "all",
                "product": "chat",
                "uncached_input_tokens": 5,
                "cache_read_input_tokens": None,
                "cache_creation_input_tokens": 2,
                "output_tokens": 4,
            },
            {
                "time": "2026-02-01T00:00:00Z",
                "record": "usage",
                "event_category": "usage",
                "usage": {"input_tokens": 7, "output_tokens": 4, "total_tokens": 11},
            },
            {
                "date": "2026-02-09",
                "model": "all",
                "product": "chat",
                "uncached_input_tokens": 5,
                "cache_creation_input_tokens": 2,
            },
        ),
        (
            {"starting_at": "2026-02-01T00:00:00Z", "model": "m-1", "output_tokens": None},
            {
                "time": "2026-02-01T00:00:00Z",
                "record": "usage",
                "event_category": "usage",
                "model": "m-1",
            },
            {"model": "m-1"},
        ),
    ],
    "cost": [
        (
            {"starting_at": "2026-02-01T00:00:00Z", "amount": "1250.5", "currency": "USD"},
            {
                "time": "2026-02-01T00:00:00Z",
                "record": "cost",
                "event_category": "cost",
                "cost": {"amount_usd": 12.505, "currency": "USD"},
            },
            None,
        ),
        (
            {"starting_at": "2026-02-01T00:00:00Z", "amount": "5", "total_cost_usd": "7.25"},
            {
                "time": "2026-02-01T00:00:00Z",
                "record": "cost",
                "event_category": "cost",
                "cost": {"amount_usd": 7.25},
            },
            None,
        ),
        (
            {"starting_at": "2026-02-01T00:00:00Z", "amount": "unclear"},
            {"time": "2026-02-01T00:00:00Z", "record": "cost", "event_category": "cost"},
            None,
        ),
    ],
    "user_cost": [
        (
            {
                "date": "2026-02-01",
                "email": "",
                "actor": {"email_address": "mia@example.test", "user_id": "u1"},
                "amount": "100",
            },
            {
                "time": "2026-02-01T00:00:00Z",
                "record": "user_cost",
                "event_category": "cost",
                "actor": MIA,
                "cost": {"amount_usd": 1.0},
            },
            None,
        )
    ],
    "user_activity": [
        (
            {"date": "2026-02-01", "email": None, "claude_code_metrics": {"sessions": 0}},
            {"time": "2026-02-01T00:00:00Z", "record": "user_activity", "event_category": "usage"},
            {"claude_code_metrics": {"sessions": 0}},
        )
    ],
    "spend_limit": [
        (
            {
                "created_at": "2026-02-01T00:00:00Z",
                "updated_at": "2026-02-02T00:00:00Z",
                **{"email": "mia@example.test", "user_id": "u1"},
                "amount": "30000",
                "period_to_date_spend": "10000",
                "source": {"type": "seat_tier"},
            },
            {
                "time": "2026-02-01T00:00:00Z",
                "record": "spend_limit",
                "event_category": "cost",
                "actor": MIA,
                "resource": {"type": "user", "id": "u1"},
                "cost": {"limit_usd": 300.0, "spend_usd": 100.0, "utilization_pct": 33.3},
            },
            {"updated_at": "2026-02-02T00:00:00Z", "source": {"type": "seat_tier"}},
        ),
        (
            {"updated_at": "2026-02-02T00:00:00Z", "user_id": "u1", "amount": "0.000000"},
            {
                "time": "2026-02-02T00:00:00Z",
                "record": "spend_limit",
                "event_category": "cost",
                "actor": {"id": "u1"},
                "resource": {"type": "user", "id": "u1"},
                "cost": {"limit_usd": 0.0, "utilization_pct": 100.0},
            },
            None,
        ),
    ],
    "spend_limit_request": [
        (
            {
                "id": "r1",
                "status": "pending",
                "created_at": "2026-02-01T00:00:00Z",
                "actor": {"user_id": "u1"},
                "spend_summary": {"amount": "500", "period_to_date_spend": None},
            },
            {
                "time": "2026-02-01T00:00:00Z",
                "record": "spend_limit_request",
                "event_category": "policy",
                "actor": {"id": "u1"},
                "cost": {"requested_limit_usd": 5.0},
            },
            {"id": "r1", "status": "pending"},
        )
    ],
}


def exported(events):
    ai = F.expr(values.clean("ai", contract.AI_TYPE)).alias("ai")
    text = F.to_json(F.struct(ai, "raw"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return [json.loads(r[0]) for r in as_stored(events).select(text).collect()]


@pytest.mark.parametrize("typed", [False, True], ids=["open", "typed"])
@pytest.mark.parametrize("kind", CASES)
def test_record_becomes_event(spark, lines, kind, typed):
    records = [case[0] for case in CASES[kind]]
    path = lines(records)
    if typed:
        schema = spark.read.json(path).schema
        feed = feeds.read_feed(spark, path, kind, schema)
    else:
        feed = feeds.read_feed(spark, path, kind)
    events = exported(normalize(feed, kind, collected_at=AT))
    for event, (_, ai, raw) in zip(events, CASES[kind], strict=True):
        assert list(event["ai"])[0] == "time"
        assert event["ai"] == {**ai, **HEAD}
        # Schema inference reads an always empty object as text; skip only that.
        expected = None if raw is None else dict(raw)
        got = event.get("raw")
        if typed and expected and "extra" in expected:
            expected["extra"], got = None, {**got, "extra": None}
        assert got == expected


def test_text_counters_do_not_count(spark, lines):
    path = lines([{"starting_at": "2026-02-01", "uncached_input_tokens": "9", "output_tokens": 1}])
    event = exported(normalize(feeds.read_feed(spark, path, "usage"), "usage", collected_at=AT))[0]
    assert event["ai"]["usage"] == {"output_tokens": 1, "total_tokens": 1}


@pytest.mark.parametrize("typed", [False, True])
def test_messages_are_redacted_before_normalization(spark, lines, typed):
    path = lines([{"id": "c1", "messages": [{"role": "user", "text": "secret"}]}, {"id": "c2"}])
    schema = "id string, messages array<struct<role:string,text:string>>" if typed else None
    feed = feeds.read_feed(spark, path, "chat", schema)
    events = exported(normalize(redact_chats(feed), "chat", collected_at=AT))
    assert events[0]["raw"] == {"id": "c1", "message_count": 1, "messages": "[REDACTED]"}
    assert "secret" not in json.dumps(events)
    kept = exported(normalize(redact_chats(feed, True), "chat", collected_at=AT))
    assert kept[0]["raw"]["messages"][0]["text"] == "secret"


def test_unknown_record_is_refused():
    from govlens.plans.normalize import envelope

    with pytest.raises(ValueError, match="unknown record"):
        envelope("nonsense", "NULL", "NULL", providers.DEFAULT)


def test_all_events_keep_the_contract(spark, lines):
    from govlens.sources.collect import union

    parts = [
        normalize(
            feeds.read_feed(spark, lines([c[0] for c in cases], f"{kind}.jsonl"), kind),
            kind,
            collected_at=AT,
        )
        for kind, cases in CASES.items()
    ]
    events = union(parts)
    assert quality.violations(events).count() == 0
    full = quality.coverage(events).where("path IN ('ai.time', 'ai.vendor', 'ai.record')")
    assert full.where("pct < 100").count() == 0


def test_violations_are_found(spark, lines):
    path = lines([{"id": "a1", "created_at": "2026-02-03", "type": "x", "v": ["null", 'q,"null",']}])
    events = normalize(feeds.read_feed(spark, path, "activity"), "activity", collected_at=AT)
    broken = events.withColumn(
        "ai",
        F.col("ai").withField("vendor", F.lit("nobody")).withField("event_id", F.lit(None).cast("string")),
    )
    found = {(r.rule, r.path) for r in quality.violations(broken).collect()}
    assert found == {
        ("vocabulary", "ai.vendor"),
        ("required_activity", "ai.event_id"),
        ("null_text", "raw"),
    }


def test_export_and_replay(spark, lines, tmp_path):
    records = [c[0] for c in CASES["activity"]]
    events = normalize(feeds.read_feed(spark, lines(records), "activity"), "activity", collected_at=AT)
    path = str(tmp_path / "out")
    store.export_json(events, path)
    again = feeds.read_events(spark, path)
    assert quality.golden_diff(events, again).count() == 0
    assert again.where("_time = ai.time").count() == len(records)


def test_golden_diff_counts_copies(spark, lines):
    def of(*ids):
        records = [{"id": i, "created_at": "2026-02-03", "type": "x"} for i in ids]
        feed = feeds.read_feed(spark, lines(records, "-".join(ids) + ".jsonl"), "activity")
        return normalize(feed, "activity", collected_at=AT)

    found = quality.golden_diff(of("a", "a", "a", "b"), of("a", "b", "c")).collect()
    assert sorted((r.side, r.copies) for r in found) == [("actual", 2), ("expected", 1)]
