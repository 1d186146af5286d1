import contextlib
import io
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from govlens.plans.normalize import as_stored, normalize
from govlens.plans.reports import REPORTS
from govlens.providers import VENDOR
from govlens.sources import collect, feeds, store, versions

AS_OF = datetime(2026, 3, 10, 12)


def activity(i, day=1, kind="user_signed_in_sso", **more):
    return {
        "id": f"a{i:04d}",
        "created_at": f"2026-03-{day:02d}T{i % 24:02d}:00:00Z",
        "type": kind,
        "actor": {"type": "user_actor", "email_address": f"u{i % 3}@example.test"},
        **more,
    }


def events(spark, lines, records, at="2026-03-10 12:00:00"):
    feed = feeds.read_feed(spark, lines(records), "activity")
    return normalize(feed, "activity", collected_at=at)


def scan_of(df):
    """Details of the Parquet scan of the events in the plan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    blocks = [block.split("\n\n")[0] for block in out.getvalue().split("Scan parquet")]
    details = next(block for block in blocks if "ReadSchema: struct<ai:" in block)
    return dict(line.split(": ", 1) for line in details.splitlines() if ": " in line)


def test_upsert_is_idempotent_and_keeps_the_last_delivery(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    first = events(spark, lines, [activity(i, 1 + i % 3) for i in range(30)])
    store.upsert_events(first, path)
    store.upsert_events(first, path)
    assert store.read_store(spark, path).count() == 30
    later = events(
        spark, lines, [activity(i, 1 + i % 3, visibility="new") for i in range(28, 35)], "2026-03-11 12:00:00"
    )
    store.upsert_events(later, path)
    kept = store.read_store(spark, path)
    assert kept.count() == 35
    assert kept.where("try_variant_get(raw, '$.visibility', 'string') = 'new'").count() == 7
    # An older delivery that arrives late does not win.
    store.upsert_events(first, path)
    assert store.read_store(spark, path).where("collected_at > '2026-03-11'").count() == 7


def _limit(amount, spent, **more):
    return {"user_id": "u1", "amount": amount, "period_to_date_spend": spent,
            "created_at": "2026-01-01T00:00:00Z", "currency": "USD", **more}


def test_upsert_keeps_rows_that_differ_in_any_dimension(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    rows = [
        {"starting_at": "2026-03-01T00:00:00Z", "model": "m", "output_tokens": 5, "region": region,
         "context": {"window": window}, "tier": [tier]}
        for region in ("eu", "us") for window in (1, 2) for tier in ("a", "b")
    ]
    feed = feeds.read_feed(spark, lines(rows, "a.jsonl"), "usage")
    store.upsert_events(normalize(feed, "usage", collected_at="2026-03-02 00:00:00"), path)
    # corrected measures are newer deliveries of the same rows
    later = [{**r, "output_tokens": 9, "cache_read_input_tokens": 3} for r in rows]
    feed = feeds.read_feed(spark, lines(later, "b.jsonl"), "usage")
    store.upsert_events(normalize(feed, "usage", collected_at="2026-03-03 00:00:00"), path)
    kept = store.read_store(spark, path).select("ai.usage.output_tokens").collect()
    assert [r[0] for r in kept] == [9] * 8


def test_upsert_keeps_every_days_snapshot(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    for day, spent in ((2, "100"), (5, "10"), (5, "20")):
        feed = feeds.read_feed(spark, lines([_limit("100", spent)], f"{day}{spent}.jsonl"), "spend_limit")
        events = normalize(feed, "spend_limit", collected_at=f"2026-01-0{day} 12:0{spent[0]}:00")
        store.upsert_events(events, path)
    kept = store.read_store(spark, path).orderBy("collected_at").select("ai.cost.spend_usd").collect()
    assert [r[0] for r in kept] == [1.0, 0.2]


def test_upsert_survives_a_hot_event(spark, lines, tmp_path):
    many = events(spark, lines, [activity(1)] * 500 + [activity(2)])
    path = str(tmp_path / "store")
    store.upsert_events(many, path)
    assert store.read_store(spark, path).count() == 2
    text = store.newest_deliveries(many)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count_if" in text or "partial_count" in text  # copies shrink before they shuffle
    assert "Window" not in text


def _activity_rows():
    """Rows of one user and day that differ in numbers only, and two that do not differ."""
    row = {"date": "2026-03-01", "email": "u@example.test", "user_id": "u1"}
    return [{**row, "chat_metrics": {"messages_sent": n}} for n in (1, 2, 3, 3)]


def test_upsert_keeps_all_rows_of_a_delivery(spark, lines, tmp_path):
    path = str(tmp_path / "store")

    def load(rows, day):
        feed = feeds.read_feed(spark, lines(rows, f"{day}{len(rows)}.jsonl"), "user_activity")
        store.upsert_events(normalize(feed, "user_activity", collected_at=f"2026-03-0{day} 12:00:00"), path)

    def sent():
        found = store.read_store(spark, path).selectExpr(
            "try_variant_get(raw, '$.chat_metrics.messages_sent', 'int') AS n"
        )
        return sorted(r.n for r in found.collect())

    load(_activity_rows(), 2)
    assert sent() == [1, 2, 3, 3]
    load(_activity_rows(), 2)  # the same delivery again
    assert sent() == [1, 2, 3, 3]
    load(_activity_rows()[1:3], 2)  # and a part of it
    assert sent() == [1, 2, 3, 3]
    load(_activity_rows()[:2], 3)  # a later delivery takes the place of the whole
    assert sent() == [1, 2]
    load(_activity_rows(), 2)  # which an older one does not undo
    assert sent() == [1, 2]


def _live(spark, path):
    return {(str(r.event_date), r.load) for r in store._table(spark, path).folders().where("live").collect()}


def test_only_days_that_lose_rows_are_replaced(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    store.upsert_events(events(spark, lines, [activity(i, 1 + i % 3) for i in range(30)]), path)
    first = _live(spark, path)
    assert len({load for _, load in first}) == 1
    # the same again changes no folder, new events of a day lie beside its old ones
    store.upsert_events(events(spark, lines, [activity(i, 1 + i % 3) for i in range(30)]), path)
    assert _live(spark, path) == first
    store.upsert_events(events(spark, lines, [activity(i, 1) for i in range(40, 45)]), path)
    assert _live(spark, path) > first and store.read_store(spark, path).count() == 35
    # a later delivery of a part of a day, some of it twice: that day alone is written again
    second = _live(spark, path)
    some = [activity(i, 2) for i in (1, 4, 4, 50)]
    assert store.upsert_events(events(spark, lines, some, "2026-03-11 12:00:00"), path) == 4
    third = _live(spark, path)
    assert {x for x in third if x[0] != "2026-03-02"} == {x for x in second if x[0] != "2026-03-02"}
    assert not {x for x in third if x[0] == "2026-03-02"} & second
    kept = store.read_store(spark, path)
    assert kept.count() == kept.select("ai.event_id").distinct().count() == 36
    assert kept.where("collected_at > '2026-03-11'").count() == 3


@pytest.mark.parametrize("looked_up", [0, 1000])
def test_upsert_against_brute_force(spark, lines, tmp_path, monkeypatch, looked_up):
    """Named and nameless rows, copies, older and newer deliveries and events that change their day."""
    monkeypatch.setattr(store, "LOOKED_UP", looked_up)
    path, random_ = str(tmp_path / "store"), __import__("random").Random(looked_up)
    held: dict = {}
    for k in range(6):
        at = f"2026-03-1{random_.randrange(4)} 12:00:00"
        rows = []
        for _ in range(25):
            i = random_.randrange(12)
            row = activity(i, 1 + (i + (random_.random() < 0.1)) % 3, size=random_.randrange(2))
            if i % 2:
                row.pop("id")
            rows.append(row)
        store.upsert_events(normalize(feeds.read_feed(spark, lines(rows, f"{k}.jsonl"), "activity"), "activity", collected_at=at), path)
        days = {r["created_at"][:10] for r in rows}
        new: dict = {}
        for row in rows:
            new.setdefault(row.get("id") or json.dumps(row), []).append((at, json.dumps(row, sort_keys=True)))
        for key, found in new.items():
            # what lies in days that the batch does not touch takes no part
            before = held.get(key, [])
            part = [x for x in before if json.loads(x[1])["created_at"][:10] in days]
            rest = [x for x in before if x not in part]
            last = max(x[0] for x in part + found)
            named = key.startswith("a")
            kept = []
            for content in {x[1] for x in part + found}:
                n = [sum(x == (last, content) for x in side) for side in (part, found)]
                kept += [(last, content)] * max(n)
            held[key] = rest + ([kept[0]] if named and len({x[1] for x in kept}) == 1 else kept)
            if named and len({x[1] for x in kept}) > 1:
                held[key] = rest + [None]  # one of several contents, by their hash
                got = store.read_store(spark, path).where(f"ai.event_id = '{key}' AND collected_at = '{last}'")
                days_of = "'" + "','".join(days) + "'"
                (row,) = got.where(f"event_date IN ({days_of})").selectExpr("CAST(_time AS STRING) AS t", "try_variant_get(raw, '$.size', 'int') AS size").collect()
                (held[key][-1],) = {x for x in kept if json.loads(x[1])["size"] == row["size"] and json.loads(x[1])["created_at"][:10] == row.t[:10]}
    want = sorted((x[1] and json.loads(x[1]).get("id") or "", json.loads(x[1])["created_at"][:10], json.loads(x[1])["size"], x[0]) for v in held.values() for x in v)
    got = store.read_store(spark, path).selectExpr(
        "coalesce(ai.event_id, '') AS id", "CAST(event_date AS STRING) AS d", "try_variant_get(raw, '$.size', 'int') AS size", "CAST(collected_at AS STRING) AS at"
    )
    assert sorted(tuple(r) for r in got.collect()) == want


def test_kinds_that_come_again_are_left_alone(spark, lines, tmp_path, monkeypatch):
    """Kinds with and without ids in one load, large or not: nothing is written again."""
    usage = feeds.read_feed(spark, lines([{"starting_at": f"2026-03-0{1 + i % 3}T00:00:00Z", "output_tokens": i // 3, "line": str(i // 2)} for i in range(12)], "u.jsonl"), "usage")
    both = collect.union(
        [events(spark, lines, [activity(i, 1 + i % 3) for i in range(12)]), normalize(usage, "usage", collected_at="2026-03-10 12:00:00")]
    )
    for large in (store.LARGE, 0):
        monkeypatch.setattr(store, "LARGE", large)
        path = str(tmp_path / f"store{large}")
        assert store.upsert_events(both, path) == 24
        first = _live(spark, path)
        assert store.upsert_events(both, path) == 24 and _live(spark, path) == first
        counts = {r.record: r["count"] for r in store.read_store(spark, path).groupBy("record").count().collect()}
        assert counts == {"activity": 12, "usage": 12}
        assert store._table(spark, path).vacuum() == 0


def test_the_text_of_a_row_is_made_once_for_its_hashes(spark, lines):
    stored = as_stored(events(spark, lines, [activity(1, size=1)])).cache()
    plan = store.keyed(stored)._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("AS _text") == 1 and plan.count("StructsToJsonEvaluator") == 2  # raw, and the key's fields


def test_an_upsert_leaves_no_shuffle_files(spark, lines, tmp_path):
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        found = blocks.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before = shuffled()
    for day in (1, 2):
        store.upsert_events(events(spark, lines, [activity(i, 1 + i % 3) for i in range(60)], f"2026-03-1{day} 12:00:00"), str(tmp_path / "store"))
    assert not shuffled() - before


def test_a_load_that_is_killed_leaves_the_store_whole(spark, lines, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first = events(spark, lines, [activity(i, 1 + i % 3) for i in range(30)])
    store.upsert_events(first, path)
    later = events(spark, lines, [activity(i, 1 + i % 3) for i in range(60)], "2026-03-11 12:00:00")

    def lost(*_):
        raise KeyboardInterrupt  # after all files are written, before the switch

    with monkeypatch.context() as patch:
        patch.setattr(versions.Ledger, "commit", lost)
        with pytest.raises(KeyboardInterrupt):
            store.upsert_events(later, path)
    kept = store.read_store(spark, path)
    assert kept.count() == 30 and kept.where("collected_at > '2026-03-11'").count() == 0
    store.upsert_events(later, path)
    assert store.read_store(spark, path).where("collected_at > '2026-03-11'").count() == 60
    table = store._table(spark, path)
    assert table.vacuum() == 4  # three days of the first load, and the lost one as a whole
    assert store.read_store(spark, path).count() == 60 and table.vacuum() == 0


def test_two_writers_from_one_version(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    store.upsert_events(events(spark, lines, [activity(1)]), path)
    table = store._table(spark, path)
    version, rows = table.version(), store.read_store(spark, path)
    table.write(rows, True, expected=version)
    with pytest.raises(versions.Conflict):
        table.write(rows, True, expected=version)
    assert store.read_store(spark, path).count() == 1


def test_an_empty_load(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    assert store.upsert_events(events(spark, lines, [activity(1)]).where("false"), path) == 0
    assert store.read_store(spark, path).count() == 0


def test_a_large_load_is_written_where_it_is_read(spark, lines, tmp_path, monkeypatch):
    many = events(spark, lines, [activity(i, 1 + i % 9) for i in range(90)])
    plan = lambda: store._partitioned(many)._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" in plan()
    monkeypatch.setattr(store, "LARGE", 0)
    assert "Exchange" not in plan()
    path = str(tmp_path / "store")
    store.write_events(many, path)
    kept = store.read_store(spark, path)
    assert kept.count() == 90 and kept.select("event_date").distinct().count() == 9
    assert kept.where("event_date = DATE '2026-03-02'").count() == 10
    monkeypatch.setattr(store, "UNKNOWN", 1)  # what nothing is known of
    assert "REBALANCE" in plan()


def test_store_scan_prunes_partitions_and_columns(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    store.write_events(events(spark, lines, [activity(i, 1 + i % 9) for i in range(90)]), path)
    rows = REPORTS["se_07"](store.read_store(spark, path).where("record = 'activity'"), AS_OF, "-3d@d")
    scan = scan_of(rows)
    assert "event_date" in scan["PartitionFilters"] and "record" in scan["PartitionFilters"]
    pushed = scan["PushedFilters"]
    assert "EqualTo(ai.action,login)" in pushed
    assert "EqualTo(ai.event_category,authentication)" in pushed
    assert "raw" not in scan["ReadSchema"] and "usage" not in scan["ReadSchema"]
    # Days 7, 8 and 9 hold ten events each, spread over few users.
    assert sum(r["count"] for r in rows.collect()) == 0
    with_ip = [activity(i, 8, actor={"email_address": "x@example.test", "ip_address": "10.0.0.1"}) for i in range(3)]
    store.write_events(events(spark, lines, with_ip), path)
    assert [r["count"] for r in REPORTS["se_07"](store.read_store(spark, path), AS_OF, "-3d@d").collect()] == [3]


def test_days_become_literals(spark, lines, tmp_path):
    path = str(tmp_path / "store")
    all_events = events(spark, lines, [activity(i, 1 + i % 9) for i in range(90)])
    store.write_events(all_events, path)
    days = all_events.where("day(event_date) <= 2")
    chosen = store.of_days(store.read_store(spark, path), days)
    assert chosen.count() == 20
    assert "event_date" in scan_of(chosen)["PartitionFilters"]
    assert store.of_days(all_events, all_events.where("false")).count() == 0


def test_pages(spark, lines):
    pages = [
        {"data": [{"id": 1}, {"id": 2}], "has_more": True},
        {"data": "nothing"},
        {"has_more": False},
        {"data": []},
        {"data": [{"id": 3, "x": None}], "summaries": [{"id": 9}]},
    ]
    df = feeds.read_feed(spark, lines(pages), "activity")
    got = feeds.explode_pages(df).selectExpr("variant_get(record, '$.id', 'int') AS id").collect()
    assert sorted(r.id for r in got) == [1, 2, 3]
    assert feeds.explode_pages(df, feeds.FEEDS["summary"].page_key).count() == 1


def test_unreadable_lines_are_left_out(spark):
    df = spark.createDataFrame([('{"id": "a"}',), ("{broken",), ("",)], "value string")
    assert feeds.from_lines(df).count() == 1


def test_cycles_cover_every_event_once(spark, lines):
    feed = spark.createDataFrame(
        [(f"a{i:03d}", f"2026-03-0{1 + i // 40} 00:00:0{i % 2}") for i in range(120)], "id string, t string"
    ).selectExpr("id", "CAST(t AS TIMESTAMP) AS created_at")
    state, seen = collect.State(), []
    for _ in range(20):
        rows, advance = collect.incremental(feed, state, AS_OF, backfill_days=30, max_rows=25)
        batch = [r.id for r in rows.orderBy("created_at", "id").collect()]
        new_state = advance()
        if not batch:
            assert new_state is state
            break
        seen += batch
        state = new_state
    assert len(seen) == 120 and len(set(seen)) == 120
    recent, _ = collect.incremental(feed, collect.State(), AS_OF, backfill_days=8, max_rows=None)
    assert recent.count() == 40  # only 3 March is within eight days
    far, _ = collect.incremental(feed, collect.State(), datetime(2026, 12, 1), backfill_days=999)
    assert far.count() == 120  # as far back as was asked for


@pytest.mark.parametrize(
    "last, start",
    [(None, date(2026, 2, 28)), ("nonsense", date(2026, 2, 28)), ("2026-02-01", date(2026, 2, 1)),
     ("2026-03-07", date(2026, 3, 6))],
)
def test_report_window(last, start):
    assert collect.report_window(AS_OF, last) == (start, date(2026, 3, 7))


def test_toggles():
    assert "cost" not in collect.enabled({"collect_cost": False})
    assert collect.enabled({"collect_spend_limits": False})[-1] == "user_activity"
    assert len(collect.enabled()) == 8


def test_collect_without_full_access(spark, lines):
    landed = {"activity": feeds.read_feed(spark, lines([activity(1), activity(2)]), "activity")}
    got = collect.collect(landed.get, "acme", AS_OF, full_access=False, backfill_days=30)
    assert [r.asDict() for r in collect.ingest_counts(got).collect()] == [
        {"sourcetype": f"{VENDOR}:compliance:activity", "count": 2}
    ]
    assert got.first().source == f"{VENDOR}:compliance:activities:acme"


def test_bucket_widths(spark, lines):
    records = [
        {"starting_at": f"2026-03-01T0{h}:30:00Z", "product": "chat", "output_tokens": 1} for h in (1, 1, 2)
    ]
    rows = normalize(feeds.read_feed(spark, lines(records), "usage"), "usage", collected_at=AS_OF)
    sizes = {w: sorted(r.total_tokens for r in collect.bucketed(rows, w).collect()) for w in collect.BUCKETS}
    assert sizes == {"1d": [3], "1h": [1, 2], "1m": [1, 2]}


def test_run_scope(spark, lines):
    rows = events(spark, lines, [activity(1)])
    both = store.stamp_run(rows, "r1").unionByName(store.stamp_run(rows, "r2"))
    assert store.of_run(both, "r1").count() == 1


def test_shared_folder_follows_the_session(spark):
    from types import SimpleNamespace

    from govlens.session import shared_dir

    cluster = SimpleNamespace(
        conf={"spark.checkpoint.dir": "hdfs:///shared/"},
        sparkContext=SimpleNamespace(master="yarn", getConf=dict),
    )
    assert shared_dir(cluster, "x").startswith("hdfs:///shared/x-")
    cluster.conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster, "x")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


def test_json_of_nested_text_is_whole(spark, lines):
    text = "x" * 200_000
    rows = events(spark, lines, [activity(1, note={"long": text, "none": None})])
    kept = rows.select(F.to_json("raw")).first()[0]
    assert json.loads(kept)["note"] == {"long": text}
