"""Adoption, tokens, spend and spend limits."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from govlens.operators.filters import raw
from govlens.operators.stats import stats, timechart
from govlens.operators.tables import dedup_latest, table, top
from govlens.plans.reports.registry import report as _report

report = partial(_report, earliest="-30d@d")
USER = "ai.actor.email"
USD = "ai.cost.amount_usd"


def _newest(ev, column):
    """One row at most; the greatest time wins, then the greatest value."""
    return ev.select("_time", column).orderBy(F.desc("_time"), F.desc(column)).limit(1).drop("_time")


@report("tk_00", "Latest daily active users", "summary")
def latest_active(ev, as_of):
    rows = ev.withColumn("daily_active_users", F.col("ai.adoption.daily_active_users"))
    return _newest(rows, "daily_active_users")


@report("tk_01", "Latest adoption rate", "summary")
def latest_adoption(ev, as_of):
    rows = ev.withColumn("daily_adoption_rate", F.col("ai.adoption.daily_rate"))
    return _newest(rows, "daily_adoption_rate")


@report("tk_02", "Total spend", "cost")
def total_spend(ev, as_of):
    return stats(ev, {"total_spend": F.round(F.sum(USD), 2)})


@report("tk_03", "Total output tokens", "usage")
def total_output(ev, as_of):
    return stats(ev, {"output_tokens": F.sum("ai.usage.output_tokens")})


@report("tk_04", "Limits near exhaustion", "spend_limit")
def near_limit(ev, as_of, latest_per_user: bool = False):
    """Counts records; ``latest_per_user`` counts users by their newest record."""
    rows = ev.select(
        F.col("ai.actor.id").alias("user_id"),
        F.col("ai.cost.utilization_pct").alias("utilization_pct"),
        "_time",
        "collected_at",
    )
    if latest_per_user:
        rows = dedup_latest(rows, ["user_id"], ["_time", "collected_at", "utilization_pct"])
    return stats(rows.where(F.col("utilization_pct") >= 80), {"count": "count(*)"})


@report("tk_05", "Daily active users", "summary", chart=True)
def active_trend(ev, as_of, over):
    return timechart(
        ev,
        {
            "dau": F.avg("ai.adoption.daily_active_users"),
            "wau": F.avg("ai.adoption.weekly_active_users"),
        },
        **over,
    )


@report("tk_06", "Seat adoption rate", "summary", chart=True)
def adoption_trend(ev, as_of, over):
    return timechart(
        ev,
        {"daily": F.avg("ai.adoption.daily_rate"), "monthly": F.avg("ai.adoption.monthly_rate")},
        **over,
    )


@report("tk_07", "Token usage by product", "usage")
def tokens_by_product(ev, as_of):
    rows = ev.select(raw(ev, "product").alias("product"), "ai.usage.total_tokens")
    return stats(rows, {"total_tokens": F.sum("total_tokens")}, ["product"])


@report("tk_08", "Spend by product", "cost")
def spend_by_product(ev, as_of):
    rows = ev.select(raw(ev, "product").alias("product"), F.col(USD).alias("usd"))
    return stats(rows, {"spend_usd": F.sum("usd")}, ["product"]).orderBy(
        F.desc("spend_usd"), "product"
    )


@report("tk_09", "Daily spend trend", "cost", chart=True)
def spend_trend(ev, as_of, over):
    return timechart(ev, {"spend_usd": F.sum(USD)}, **over)


@report("tk_10", "Token volume trend", "usage", chart=True)
def token_trend(ev, as_of, over):
    return timechart(
        ev,
        {
            "output_tokens": F.sum("ai.usage.output_tokens"),
            "input_tokens": F.sum("ai.usage.input_tokens"),
        },
        **over,
    )


@report("tk_11", "Top users by cost", "user_cost")
def top_cost(ev, as_of):
    rows = ev.select(F.col(USER).alias("user"), F.col(USD).alias("usd"))
    users = stats(rows, {"cost_usd": F.sum("usd")}, ["user"])
    return top(users, 15, [F.desc("cost_usd"), F.col("user")])


@report("tk_12", "Top users by token volume", "user_usage")
def top_tokens(ev, as_of):
    rows = ev.select(F.col(USER).alias("email"), "ai.usage.output_tokens", "ai.usage.input_tokens")
    users = stats(
        rows,
        {"output_tokens": F.sum("output_tokens"), "input_tokens": F.sum("input_tokens")},
        ["email"],
    ).fillna(0, ["output_tokens", "input_tokens"])
    users = users.withColumn("total_tokens", F.col("output_tokens") + F.col("input_tokens"))
    return top(users, 15, [F.desc("total_tokens"), F.col("email")])


def _limits(rows, order, limit=None):
    return table(
        rows,
        {
            "email": USER,
            "limit_usd": "ai.cost.limit_usd",
            "spend_usd": "ai.cost.spend_usd",
            "utilization_pct": "ai.cost.utilization_pct",
            "limit_source": raw(rows, "source.type"),
            "period": raw(rows, "period"),
        },
        [F.desc_nulls_last(order), F.col(USER), F.desc("_time"), F.col("ai.cost.limit_usd")],
        limit,
    )


@report("tk_13", "Spend limit utilization", "spend_limit")
def high_utilization(ev, as_of):
    rows = ev.where(F.col("ai.cost.utilization_pct") >= 80)
    return _limits(rows, "ai.cost.utilization_pct")


@report("tk_14", "All effective spend limits", "spend_limit")
def effective_limits(ev, as_of):
    return _limits(ev, "ai.cost.spend_usd", limit=25)


@report("tk_15", "Pending spend limit requests", "spend_limit_request")
def pending_requests(ev, as_of):
    return table(
        ev.where(raw(ev, "status") == "pending"),
        {
            "_time": "_time",
            "email": USER,
            "status": raw(ev, "status"),
            "requested_limit_usd": "ai.cost.requested_limit_usd",
            "period_spend_usd": "ai.cost.spend_usd",
            "request_id": raw(ev, "id"),
        },
        [F.desc("_time"), F.col(USER), raw(ev, "id")],
    )
