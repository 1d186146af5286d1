"""Stateful streams against the scheduled runs of the batch detections."""

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from govlens.operators import joins
from govlens.plans import detections as D
from govlens.plans.normalize import as_stored, normalize
from govlens.plans.reports.security import SIGN_IN
from govlens.providers import VENDOR
from govlens.streaming import ingest, stateful

AT = "2026-03-01 12:00:00"
DAY0 = datetime(2026, 1, 1)


def costs(spark, rows):
    feed = spark.createDataFrame(rows, "starting_at string, amount string, product string")
    return as_stored(normalize(feed, "cost", collected_at=AT))


def stream_of(spark, tmp_path, batches):
    """Events that arrive file by file, in this order."""
    path = tmp_path / "in"
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05 if k else 0)
    schema = batches[0].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def finished(spark, tmp_path, df):
    path = str(tmp_path / "out")
    ingest.write_stream(df, path, str(tmp_path / "progress")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def rows_of(df):
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect()
    )


def test_spike_stream_equals_its_schedule(spark, tmp_path):
    day = lambda k: f"2026-01-{k:02d}T00:00:00Z"
    first = [(day(k), str(1000 + 10 * k), "chat") for k in range(1, 9)]
    second = [(day(9), "9000", "chat"), (day(9), "500", "code"), (day(10), None, "chat"), (day(8), "70", "x")]
    third = [(day(k), str(500 * k), "chat") for k in (11, 12, 13, 25, 26, 27, 31)]
    parts = [costs(spark, rows) for rows in (first, second, third)]
    found = finished(spark, tmp_path, stateful.spend_spike(stream_of(spark, tmp_path, parts), delay="2 days"))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    until = datetime(2026, 1, 29)  # the watermark: two days before the last event
    expected = D.backtest("d_spike", whole, DAY0, until)
    assert rows_of(found.drop("vendor")) == rows_of(expected)
    assert {r.run_time.day for r in found.collect()} >= {10}
    assert {r.vendor for r in found.collect()} == {VENDOR}


def limits(spark, at, rows):
    feed = spark.createDataFrame(
        [(f"{u}@example.test", u, a, s, "2026-01-01T00:00:00Z") for u, a, s in rows],
        "email string, user_id string, amount string, period_to_date_spend string, created_at string",
    )
    return as_stored(normalize(feed, "spend_limit", collected_at=at))


def test_limit_stream_equals_its_schedule(spark, tmp_path):
    parts = [
        limits(spark, "2026-01-02 00:30:00", [("a", "100", "100"), ("b", "100", "10"), ("c", "0", None)]),
        limits(spark, "2026-01-02 03:00:00", [("a", "100", "20"), ("b", "100", "300")]),
        limits(spark, "2026-01-02 09:00:00", [("a", None, "20"), ("d", "100", "99")]),
        limits(spark, "2026-01-02 22:00:00", [("a", "100", "500")]),
        limits(spark, "2026-01-05 12:00:00", [("z", "100", "500")]),
    ]
    found = finished(spark, tmp_path, stateful.limit_reached(stream_of(spark, tmp_path, parts)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    expected = D.backtest("d_limit", whole, DAY0, datetime(2026, 1, 5, 11))
    columns = ["run_time", "user", "utilization_pct", "period_spend_usd", "spend_limit_usd"]
    assert rows_of(found.select(columns)) == rows_of(expected.select(columns))
    assert {r.user[0] for r in found.collect()} == {"a", "b", "c"}


def test_users_of_limits_share_keys(spark, tmp_path, monkeypatch):
    """More users than keys, over several batches: the schedule's rows, and a key's state for many users."""
    monkeypatch.setattr(stateful, "BUCKETS", 3)
    calls = tmp_path / "calls"
    calls.mkdir()
    real = stateful.Limits.handleInputRows

    def counted(self, key, rows, timerValues):
        (calls / __import__("uuid").uuid4().hex).touch()
        yield from real(self, key, rows, timerValues)

    monkeypatch.setattr(stateful.Limits, "handleInputRows", counted)
    parts = [
        limits(spark, at, [(f"u{k}", [None, "0", "100"][(k + d) % 3], [None, "40", "100", "250"][k * (d + 1) % 4]) for k in range(40)])
        for d, at in enumerate(("2026-01-02 00:30:00", "2026-01-02 03:00:00", "2026-01-02 22:00:00", "2026-01-03 23:00:00"))
    ] + [limits(spark, "2026-01-06 12:00:00", [("z", "100", "500")])]
    found = finished(spark, tmp_path, stateful.limit_reached(stream_of(spark, tmp_path, parts)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    expected = D.backtest("d_limit", whole, DAY0, datetime(2026, 1, 6, 11))
    columns = ["run_time", "user", "utilization_pct", "period_spend_usd", "spend_limit_usd"]
    assert rows_of(found.select(columns)) == rows_of(expected.select(columns)) and found.count() > 40
    assert len(list(calls.iterdir())) <= 3 * len(parts)  # a call per key and batch, not per user


def test_top_cost_stream_equals_its_schedule(spark, tmp_path):
    def spent(rows):
        feed = spark.createDataFrame(rows, "date string, email string, amount string")
        return as_stored(normalize(feed, "user_cost", collected_at=AT))

    parts = [
        spent([(f"2026-01-{d:02d}", f"u{(d * k) % 7}@example.test", str(100 * k)) for k in range(1, 9)])
        for d in range(1, 13)
    ] + [spent([("2026-01-12", None, "5"), ("2026-01-20", "z@example.test", "1")])]
    found = finished(spark, tmp_path, stateful.top_cost(stream_of(spark, tmp_path, parts), size=3))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    ranked = D.backtest("d_topcost", whole, DAY0, datetime(2026, 1, 17))
    w = D.Window.partitionBy("run_time").orderBy(F.desc("total_cost_usd"), "user")
    expected = ranked.withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")
    assert rows_of(found) == rows_of(expected.select("run_time", "user", "total_cost_usd"))


def test_an_idle_stream_fires(spark, tmp_path):
    """Nothing comes in after the first file: the timer runs out, for vendors that never sent, too."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    feed = spark.createDataFrame([("e1", str(now), "x")], "id string, created_at string, type string")
    events = as_stored(normalize(feed, "activity", collected_at=AT))
    expected = spark.createDataFrame([("mute",)], "vendor string")
    alerts = stateful.stopped(
        stream_of(spark, tmp_path, [events]), timedelta(seconds=6), timedelta(seconds=4), expected
    )
    writer = alerts.writeStream.format("memory").queryName("silence").outputMode("append")
    running = writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until:
            seen = spark.table("silence").collect()
            if sum(r.vendor == VENDOR for r in seen) > 1 and any(r.vendor == "mute" for r in seen):
                break
            time.sleep(1)
        assert running.exception() is None
    finally:
        running.stop()
    own = [r for r in seen if r.vendor == VENDOR]
    assert len(own) > 1 and all(r.last == now and r.lag_sec >= 6 for r in own)
    assert [r.last for r in seen if r.vendor == "mute"][0] is None


def activity(spark, rows):
    """(id, moment, user, type)."""
    feed = spark.createDataFrame(
        [(i, t, k, (u and f"{u}@example.test", u)) for i, t, u, k in rows],
        "id string, created_at string, type string, actor struct<email_address: string, user_id: string>",
    )
    return as_stored(normalize(feed, "activity", collected_at=AT))


def sign_ins(spark, rows):
    return activity(spark, [(f"e{k}", t, u, "user_signed_in_sso") for k, (u, t) in enumerate(rows)])


def brute_sessions(rows, gap):
    out, last = [], {}
    for user, t in sorted((u, datetime.fromisoformat(t)) for u, t in rows if u and t):
        if user in last and t - last[user][2] <= gap:
            last[user][2], last[user][3] = t, last[user][3] + 1
        else:
            last[user] = [f"{user}@example.test", t, t, 1]
            out.append(last[user])
    return sorted(map(tuple, out))


SIGNED = [
    ("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 02:00:00"), ("a", "2026-01-01 04:00:01"),
    ("a", "2026-01-01 04:00:01"), ("b", "2026-01-01 01:59:59"), ("b", "2026-01-01 02:00:00"),
    ("b", "2026-01-01 05:59:59.999999"), ("c", "2026-01-02 00:00:00"), (None, "2026-01-01 00:10:00"),
    *[("hot", f"2026-01-01 {h:02d}:{m:02d}:00") for h in range(12) for m in (0, 30)],
]


def test_sessions(spark):
    found = joins.sessions(sign_ins(spark, SIGNED), "2 hours", SIGN_IN)
    assert rows_of(found.select("user", "first_time", "last_time", "count")) == brute_sessions(
        SIGNED, timedelta(hours=2)
    )
    assert joins.sessions(sign_ins(spark, SIGNED).where("false")).count() == 0


def test_session_stream_merges(spark, tmp_path):
    """A sign-in that comes between two open sessions makes them one."""
    late = [SIGNED[k] for k in (0, 2, 4, 6)], [SIGNED[1], SIGNED[5]], [("z", "2026-01-03 00:00:00")]
    parts = [sign_ins(spark, rows) for rows in late]
    found = finished(spark, tmp_path, stateful.sessions(stream_of(spark, tmp_path, parts), delay="12 hours"))
    expected = brute_sessions(late[0] + late[1], timedelta(hours=2))
    assert rows_of(found.select("user", "first_time", "last_time", "count")) == expected


# --- joins over time -------------------------------------------------------------------


def directory(spark, rows):
    feed = spark.createDataFrame(
        [(u, role, t) for u, t, role in rows], "id string, organization_role string, _t string"
    ).selectExpr("id", "organization_role", "CAST(_t AS TIMESTAMP) AS _collected_at")
    return as_stored(normalize(feed, "user"))


@pytest.mark.parametrize("slot", ["1 day", "1 hour"])
def test_as_of_role(spark, slot):
    syncs = [("a", f"2026-01-0{d} 12:00:00", role) for d, role in ((1, "user"), (3, "admin"), (6, "user"))]
    syncs += [("b", "2026-01-05 00:00:00", "billing"), ("b", "2026-01-05 00:00:00", "admin"), ("c", "2026-01-02 00:00:00", None)]
    moments = [(f"2026-01-0{d} {h:02d}:00:00", u) for d in range(1, 9) for h in (0, 11, 12, 13) for u in ("a", "b", "c", None)]
    events = activity(spark, [(f"e{k}", t, u, "x") for k, (t, u) in enumerate(moments)])
    found = joins.as_of_role(events, directory(spark, syncs), slot)
    got = {r.event_id: r.role for r in found.select("ai.event_id", "role").collect()}
    for k, (t, user) in enumerate(moments):
        known = [(s, role) for u, s, role in syncs if u == user and role and s <= t]
        assert got[f"e{k}"] == (max(known)[1] if known else None)
    assert found.columns == [*events.columns, "role"] and len(got) == len(moments)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("bits", [1 << 26, 8])
def test_unknown_actors(spark, monkeypatch, bits):
    """With eight bits the filter lets many unknown ids through; the directory decides."""
    monkeypatch.setattr(joins, "FILTER_BITS", bits)
    users = directory(spark, [(f"u{k}", "2026-01-01 00:00:00", "user") for k in range(0, 40, 2)])
    rows = [(f"e{k}", f"2026-01-02 00:{k % 60:02d}:00", f"u{k % 41}", "x") for k in range(120)] + [("n", AT, None, "x")]
    found = joins.unknown_actors(activity(spark, rows), users)
    expected = {}
    for _, t, u, _ in rows:
        if u and int(u[1:]) % 2 or u == "u40":
            expected.setdefault(u, []).append(datetime.fromisoformat(t))
    assert rows_of(found) == sorted((u, len(ts), min(ts), max(ts)) for u, ts in expected.items())
    assert "bitmap" in found._jdf.queryExecution().optimizedPlan().toString()
    assert joins.unknown_actors(activity(spark, rows), users.where("false")).count() == 41


def test_users_in_both(spark):
    a, b = activity(spark, [("1", AT, "x", "t"), ("2", AT, "Y", "t"), ("3", AT, None, "t")]), None
    b = activity(spark, [("1", AT, "y", "t"), ("2", AT, "z", "t"), ("3", AT, None, "t"), ("4", AT, "y", "t")])
    assert [r.email for r in joins.users_in_both(a, b).collect()] == ["y@example.test"]
