from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from govlens.operators import joins
from govlens.operators.filters import base, moment, raw, time_range
from govlens.operators.stats import baseline_spike, latest, stats, timechart, with_values
from govlens.operators.tables import dedup_latest, top

NOON = datetime(2026, 3, 10, 12, 34, 56)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "modifier, expected",
    [
        ("now", NOON),
        ("-24h", datetime(2026, 3, 9, 12, 34, 56)),
        ("@d", datetime(2026, 3, 10)),
        ("-14d@d", datetime(2026, 2, 24)),
        ("-1h@h", datetime(2026, 3, 10, 11)),
        ("+30m", datetime(2026, 3, 10, 13, 4, 56)),
        (None, None),
    ],
)
def test_moment(modifier, expected):
    assert moment(modifier, NOON) == expected


def test_moment_refuses_other_text():
    with pytest.raises(ValueError):
        moment("tomorrow", NOON)


def test_time_range_is_half_open(spark):
    rows = spark.sql(
        "SELECT explode(array(TIMESTAMP '2026-03-09 12:34:56', TIMESTAMP '2026-03-10 12:34:56')) AS _time"
    )
    assert time_range(rows, NOON, "-24h", "now").collect()[0][0].day == 9
    assert time_range(rows, NOON, "-24h", "now").count() == 1


@pytest.fixture(scope="module")
def skewed(spark):
    """100 000 rows, a third of them one user's, with 5 000 values of that user."""
    return spark.range(100_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id % 500) END AS user",
        "CASE WHEN id % 7 <> 0 THEN concat('v', id % 15000) END AS value",
        "TIMESTAMP '2026-03-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS _time",
    )


def test_values_of_a_hot_key_are_rows(skewed):
    lists = with_values(
        skewed, ["user"], "value", "values", count="count", distinct="dc", first="a", last="b"
    ).cache()
    exact = skewed.groupBy("user").agg(
        F.count("*").alias("count"),
        F.count_distinct("value").alias("dc"),
        F.min("_time").alias("a"),
        F.max("_time").alias("b"),
    )
    heads = lists.select("user", "count", "dc", "a", "b").distinct()
    assert heads.exceptAll(exact).count() == 0 and exact.exceptAll(heads).count() == 0
    pairs = lists.where("values IS NOT NULL").select("user", F.col("values").alias("value"))
    expected = skewed.where("value IS NOT NULL").select("user", "value").distinct()
    assert pairs.exceptAll(expected).count() == 0 and expected.exceptAll(pairs).count() == 0


def test_values_keep_groups_without_any(spark):
    rows = spark.createDataFrame(
        [("a", None), ("a", None), ("b", "x"), (None, "y")], "user string, value string"
    )
    got = with_values(rows, ["user"], "value", "values", count="n").orderBy("user").collect()
    assert [(r.user, r.n, r["values"]) for r in got] == [("a", 2, None), ("b", 1, "x")]


def test_dedup_latest_combines_before_the_shuffle(skewed):
    newest = dedup_latest(skewed, ["user"], ["_time"])
    expected = skewed.groupBy("user").agg(F.max("_time").alias("_time"))
    assert newest.count() == 501
    assert newest.select("user", "_time").exceptAll(expected).count() == 0
    text = plan(newest)
    assert "Window" not in text and "partial_max_by" in text


def test_latest_skips_missing_values(spark):
    rows = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, None), ("b", 1, None)], "k string, _time int, v double"
    )
    got = dict(stats(rows, {"v": latest("v")}, ["k"]).collect())
    assert got == {"a": 5.0, "b": None}


def test_stats_without_keys_gives_one_row(spark):
    empty = spark.range(0)
    assert stats(empty, {"n": "count(*)", "s": "sum(id)"}).collect() == [(0, None)]


def test_timechart_fills_gaps_and_sums_up_other(spark):
    rows = spark.createDataFrame(
        [("2026-01-01 05:00:00", s) for s in "aaabbc"]
        + [("2026-01-03 05:00:00", s) for s in ["a", "d", None]],
        "t string, s string",
    ).withColumn("_time", F.expr("CAST(t AS TIMESTAMP)"))
    got = timechart(rows, {"n": "count(*)"}, by="s", limit=2).collect()
    cells = {(r.bucket.day, r.series): r.n for r in got}
    assert cells == {
        (1, "a"): 3, (1, "b"): 2, (1, "OTHER"): 1, (1, "NULL"): 0,
        (2, "a"): 0, (2, "b"): 0, (2, "OTHER"): 0, (2, "NULL"): 0,
        (3, "a"): 1, (3, "b"): 0, (3, "OTHER"): 1, (3, "NULL"): 1,
    }
    fixed = timechart(
        rows, {"n": "count(*)"}, zero=["n"], start=datetime(2025, 12, 31), end=datetime(2026, 1, 4)
    )
    assert [r.n for r in fixed.orderBy("bucket").collect()] == [0, 6, 0, 3]
    far = rows.selectExpr("t", "s", "TIMESTAMP '9026-01-01 00:00:00' AS _time")
    narrow = {"start": datetime(2026, 1, 1, 6), "end": datetime(2026, 1, 3, 1)}
    empty = timechart(rows.unionByName(far), {"n": "count(*)"}, zero=["n"], **narrow)
    assert [(r.bucket.day, r.n) for r in empty.orderBy("bucket").collect()] == [(1, 0), (2, 0), (3, 0)]
    assert timechart(rows.where("false"), {"n": "count(*)"}, by="s").count() == 0
    assert "CartesianProduct" not in plan(timechart(rows, {"n": "count(*)"}, by="s"))


def test_spike_uses_days_with_data(spark):
    days = [1, 2, 3, 5, 6, 8, 9, 10, 12]
    rows = spark.createDataFrame(
        [(f"2026-01-{d:02d}", 300.0 if d == 12 else 1000.0 if d == 1 else 100.0) for d in days],
        "t string, usd double",
    ).withColumn("_time", F.expr("CAST(t AS TIMESTAMP)"))
    assert baseline_spike(rows, "usd").collect() == [(300.0, 100.0)]
    assert baseline_spike(rows, "usd", factor=3.0).collect() == []


def test_top_keeps_k_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan(top(spark.range(1000), 5, [F.desc("id")]))


def test_base_and_raw(spark):
    rows = spark.sql(
        """SELECT named_struct('vendor', v, 'record', 'usage',
                   'resource', named_struct('type', 'chat')) AS ai,
                  parse_json('{"a": {"b": "7"}}') AS raw
           FROM VALUES ('x'), ('y'), (NULL) t(v)"""
    )
    assert base(rows, "usage").count() == 2
    assert base(rows, "usage", "x", resource__type="chat").count() == 1
    assert base(rows, "usage", "*", resource__type="file").count() == 0
    assert rows.select(raw(rows, "a.b", "int")).first()[0] == 7
    typed = rows.selectExpr("named_struct('a', named_struct('b', 7)) AS raw")
    assert typed.select(raw(typed, "a.b"), raw(typed, "a.c"), raw(typed, "z")).first() == ("7", None, None)


def test_chats_of_a_hot_user_are_limited_before_the_shuffle(spark):
    users = spark.createDataFrame(
        [("u1", "Mia@Example.test"), ("u9", "mia@example.test"), ("u2", "bo@example.test")],
        "id string, email string",
    )
    chats = spark.range(30_000).selectExpr(
        "concat('c', id) AS id", "concat('u', 1 + id div 30000) AS user_id", "CAST(id AS STRING) AS created_at"
    )
    targets = spark.createDataFrame([("MIA@example.test",), ("no@one.test",), ("bo@example.test",)], "email string")
    found = joins.chats_for_users(targets, users, chats, n=3)
    assert sorted(r.chat_id for r in found.collect()) == ["c0", "c1", "c10"]
    text = plan(found)
    assert "WindowGroupLimit" in text and "Partial" in text
    assert joins.unmatched_targets(targets, users).collect() == [("no@one.test",)]
    assert [r.email for r in joins.users_without_chats(targets, users, chats).collect()] == ["bo@example.test"]


def test_users_with_org_fill_gaps_only(spark):
    users = spark.createDataFrame(
        [("u1", None, "o1"), ("u2", "own", "o1"), ("u3", None, "gone")],
        "id string, organization_uuid string, _fetched_for string",
    )
    orgs = spark.createDataFrame(
        [("", "o1", "One"), (None, None, "None")], "uuid string, id string, name string"
    )
    got = joins.users_with_org(users, orgs).orderBy("id").collect()
    assert [(r.id, r.organization_uuid, r.organization_name) for r in got] == [
        ("u1", "o1", "One"),
        ("u2", "own", "One"),
    ]


def test_group_members(spark):
    groups = spark.createDataFrame([("g1", "Ops"), ("g2", "Dev")], "id string, name string")
    members = spark.createDataFrame(
        [("g1", "u1"), ("g2", "u1"), ("g2", "u2")], "group_id string, member_id string"
    )
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "id string")
    assert joins.group_members(groups, members).count() == 3
    assert sorted(r.id for r in joins.members_of(users, members, ["g1", "g2"]).collect()) == ["u1", "u2"]


def test_delta_of_schedule():
    from govlens.plans.detections import DETECTIONS, _first_run

    d = DETECTIONS["d_newapi"]
    assert _first_run(d, datetime(2026, 1, 1)) == datetime(2026, 1, 1, 6, 30)
    assert _first_run(d, datetime(2026, 1, 1, 6, 30)) == datetime(2026, 1, 2, 6, 30)
    assert d.suppress == timedelta(hours=12)


def test_dedup_needs_the_whole_key(spark):
    from govlens.operators.tables import dedup_latest

    rows = spark.createDataFrame(
        [("a", "x", 1), ("a", "x", 2), ("a", None, 3), (None, "x", 4), (None, None, 5)],
        "k string, l string, _time long",
    )
    assert [tuple(r) for r in dedup_latest(rows, ["k", "l"]).collect()] == [("a", "x", 2)]


def test_retries_are_whole_terms(spark):
    from govlens.plans.reports.health import RETRY

    lines = ["HTTP 429 from host", "cycle #14290", "rate LIMITED by host", "MyAPIErrors", "APIError: x"]
    df = spark.createDataFrame([(t,) for t in lines], "m string")
    assert [r[0] for r in df.select(F.col("m").rlike(RETRY)).collect()] == [True, False, True, False, True]
