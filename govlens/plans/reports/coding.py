"""Coding tool and connector use."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.operators.filters import like, raw
from govlens.operators.stats import stats, timechart
from govlens.operators.tables import table, top
from govlens.plans.reports.registry import report

TYPE, USER = "ai.event_type", "ai.actor.email"
# Fixed value: the product and metric prefix of the coding tool on the wire.
TOOL = "claude_code"


@report("cc_00", "Settings changes", "activity")
def settings_changes(ev, as_of):
    return table(
        ev.where(like(TYPE, f"{TOOL}_*")),
        {"_time": "_time", "event_type": TYPE, "email": USER},
        [F.desc("_time"), F.col("ai.event_id")],
    )


@report("cc_01", "Integration events", "activity", chart=True)
def integration_events(ev, as_of, over):
    rows = ev.where(like(TYPE, "mcp_*", "integration_*", "extension_*"))
    return timechart(rows.withColumn("event_type", F.col(TYPE)), {"count": "count(*)"}, by="event_type", **over)


@report("cc_02", "Active users", "user_activity")
def active_users(ev, as_of):
    rows = ev.where(raw(ev, f"{TOOL}_metrics.sessions", "bigint") > 0)
    return rows.agg(F.count_distinct(USER).alias("cc_users"))


@report("cc_03", "Spend", "cost")
def spend(ev, as_of):
    rows = ev.where(raw(ev, "product") == TOOL)
    return stats(rows, {"spend_usd": F.round(F.sum("ai.cost.amount_usd"), 2)})


@report("cc_04", "Tool accept and reject", "user_activity")
def accept_reject(ev, as_of):
    rows = ev.select(
        F.col(USER).alias("email"),
        raw(ev, f"{TOOL}_metrics.tool_accepted_count", "bigint").alias("a"),
        raw(ev, f"{TOOL}_metrics.tool_rejected_count", "bigint").alias("r"),
    )
    users = stats(rows, {"accepted": F.sum("a"), "rejected": F.sum("r")}, ["email"])
    both = F.col("accepted") + F.col("rejected")
    rate = F.when(both > 0, F.round(100 * F.col("rejected") / both, 1)).otherwise(F.lit(0.0))
    return top(users.withColumn("reject_rate", rate), 20, [F.desc("rejected"), F.col("email")])


@report("cc_05", "Connector usage", "user_activity")
def connectors(ev, as_of):
    rows = ev.select(
        F.col(USER).alias("email"),
        raw(ev, "chat_metrics.connectors_used_count", "bigint").alias("chat"),
        raw(ev, "cowork_metrics.connectors_used_count", "bigint").alias("cowork"),
    )
    users = stats(
        rows, {"chat_connectors": F.sum("chat"), "cowork_connectors": F.sum("cowork")}, ["email"]
    ).withColumn("total_connectors", F.col("chat_connectors") + F.col("cowork_connectors"))
    return top(
        users.where(F.col("total_connectors") > 0), 20, [F.desc("total_connectors"), F.col("email")]
    )
