"""Cycles that go on where the last one ended, their state and their log."""

import time
from datetime import datetime

import pytest

from govlens.plans.reports import REPORTS
from govlens.providers import VENDOR
from govlens.sources import collect, feeds, runlog, store, versions
from govlens.streaming import ingest

FIRST, SECOND = datetime(2026, 3, 10, 12), datetime(2026, 3, 11, 12)


class Account:
    """Landed feeds that grow between cycles."""

    def __init__(self, spark, lines):
        self.spark, self.lines, self.landed, self.broken = spark, lines, {}, {}

    def land(self, kind, records):
        old = self.landed.get(kind, [])
        self.landed[kind] = old + records

    def __call__(self, kind):
        if kind in self.broken:
            raise self.broken[kind]
        if kind not in self.landed:
            return None
        path = self.lines(self.landed[kind], f"{kind}{len(self.landed[kind])}.jsonl")
        return feeds.read_feed(self.spark, path, kind)


@pytest.fixture
def account(spark, lines, tmp_path):
    made = Account(spark, lines)
    made.paths = [str(tmp_path / n) for n in ("store", "state", "log")]
    made.run = lambda when, **more: collect.run_cycle(spark, made, "acme", when, *made.paths, **more)
    made.events = lambda: store.read_store(spark, made.paths[0])
    made.state = lambda: collect.StateTable(spark, made.paths[1]).read()
    made.log = lambda: runlog.read(spark, made.paths[2])
    return made


def audit(*ids, day=9):
    return [{"id": f"a{i:03d}", "created_at": f"2026-03-{day:02d}T00:00:{i % 3:02d}Z", "type": "x"} for i in ids]


def test_a_cycle_goes_on_where_the_last_one_ended(account):
    account.land("activity", audit(*range(10)))
    account.land("summary", [{"starting_at": f"2026-03-{d:02d}T00:00:00Z", "seat_count": d} for d in range(1, 11)])
    account.land("user", [{"id": "u1", "email": "u@example.test"}])
    assert account.run(FIRST) == {"activity": 10, "summary": 6, "user": 1}  # final days: 1 to 6 March
    version, states = account.state()
    assert version == 1
    assert states["activity"] == collect.State("a008", datetime(2026, 3, 9, 0, 0, 2))
    assert states["summary"].last_finalized == "2026-03-07"
    assert states["user"].last_sync == FIRST
    # nothing new but an event of the last second, one before the cursor, and a final day
    account.land("activity", audit(11) + audit(12, day=10))
    counts = account.run(SECOND)
    assert counts["activity"] == 2 and counts["summary"] == 1
    assert account.state()[0] == 2 and account.state()[1]["activity"].last_id == "a012"
    ids = [r.event_id for r in account.events().where("record = 'activity'").select("ai.event_id").collect()]
    assert len(ids) == len(set(ids)) == 12
    # an empty cycle leaves the cursor where it is
    account.landed.pop("user")
    before = account.state()[1]["activity"]
    assert account.run(SECOND)["activity"] == 0
    assert account.state()[1]["activity"] == before


def test_a_feed_that_fails_stays_where_it_was(account):
    account.land("activity", audit(1, 2))
    account.land("user", [{"id": "u1"}])
    account.broken["user"] = RuntimeError("Rate limited (429)")
    assert account.run(FIRST) == {"activity": 2}
    assert set(account.state()[1]) == {"activity"}
    log = {r.source: (r.level, r.message, r.rows) for r in account.log().collect()}
    assert log[f"{VENDOR}:compliance:directory:acme:users"] == ("ERROR", "RuntimeError: Rate limited (429)", None)
    assert log[f"{VENDOR}:compliance:activities:acme"] == ("INFO", "2 events loaded", 2)
    reports = {k: REPORTS[k](account.log(), SECOND).collect() for k in ("th_03", "th_04")}
    assert reports["th_03"][0]["count"] == 1 and reports["th_04"][0]["_raw"].startswith("RuntimeError")
    trend = REPORTS["th_05"](account.log(), datetime(2026, 3, 10, 13)).where("count > 0").collect()
    assert [(r.bucket, r["count"]) for r in trend] == [(FIRST, 1)]
    del account.broken["user"]
    assert account.run(SECOND)["user"] == 1


def test_a_cycle_that_is_lost_runs_again(account, monkeypatch):
    account.land("activity", audit(1, 2, 3))

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(collect.StateTable, "commit", lost)
        with pytest.raises(KeyboardInterrupt):
            account.run(FIRST)
    assert account.state() == (0, {}) and account.events().count() == 3
    assert account.run(FIRST) == {"activity": 3}
    assert account.events().count() == 3 and account.state()[0] == 1


def test_a_cycle_writes_nothing_that_is_there(spark, account):
    """State that is read whole each time and has not changed leaves the store's folders alone."""
    account.land("user", [{"id": f"u{k}", "email": f"u{k}@example.test"} for k in range(5)])
    account.run(FIRST)
    folders = lambda: {(r.record, r.load) for r in store._table(spark, account.paths[0]).folders().where("live").collect()}
    first = folders()
    account.land("activity", audit(1, 2, day=10))
    assert account.run(FIRST) == {"activity": 2, "user": 5}
    assert {x for x in folders() if x[0] == "user"} == first
    assert account.events().where("record = 'user'").count() == 5


def test_two_cycles_from_one_state(spark, account):
    account.land("activity", audit(1))
    account.run(FIRST)
    table = collect.StateTable(spark, account.paths[1])
    with pytest.raises(versions.Conflict):
        table.commit(0, {"activity": collect.State("b")})
    assert account.state()[1]["activity"].last_id == "a001"


def test_buckets_of_a_cycle(account):
    row = {"product": "chat", "model": "m"}
    account.land(
        "usage",
        [{**row, "starting_at": f"2026-03-05T{h:02d}:10:00Z", "output_tokens": 1, "uncached_input_tokens": 2} for h in (1, 1, 2)],
    )
    account.land(
        "cost",
        [
            {**row, "starting_at": "2026-03-05T01:10:00Z", "amount": "150.5", "currency": "USD"},
            {**row, "starting_at": "2026-03-05T01:20:00Z", "total_cost_usd": "2", "amount": "1", "currency": "USD"},
        ],
    )
    account.run(FIRST, bucket_width="1h")
    rows = account.events().select("record", "_time", "ai.usage.*", "ai.cost.amount_usd", "ai.cost.currency").collect()
    usage = sorted((r._time.hour, r.output_tokens, r.input_tokens) for r in rows if r.record == "usage")
    assert usage == [(1, 2, 4), (2, 1, 2)]
    assert [(r.amount_usd, r.currency) for r in rows if r.record == "cost"] == [(3.505, "USD")]


def test_streams_write_the_run_log(spark, account, tmp_path):
    """A row per batch, and one for the stream that fails."""
    listener = runlog.RunLog(spark, account.paths[2])
    spark.streams.addListener(listener)
    try:
        good = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).option("numPartitions", 1).load()
        running = (
            good.writeStream.queryName("good").format("noop")
            .option("checkpointLocation", str(tmp_path / "a")).trigger(processingTime="1 second").start()
        )

        def refuse(batch, _):
            raise RuntimeError("APIError 429")

        bad = ingest._each_batch(good, str(tmp_path / "b"), lambda batch: refuse(batch, 0))
        with pytest.raises(Exception, match="429"):
            bad.awaitTermination(30)
        until = time.monotonic() + 60
        while time.monotonic() < until:
            try:
                rows = account.log().collect()
            except Exception:  # nothing written yet
                rows = []
            if any(r.level == "ERROR" for r in rows) and any(r.source == "good" for r in rows):
                break
            time.sleep(1)
        running.stop()
    finally:
        spark.streams.removeListener(listener)
    assert any(r.source == "good" and r.rows > 0 and r.rows % 5 == 0 for r in rows), rows
    assert any(r.level == "ERROR" and "429" in r.message for r in rows)
