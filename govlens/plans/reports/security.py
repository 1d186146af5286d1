"""Sign-ins, administrative changes, exports and access failures."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from govlens.operators.filters import like
from govlens.operators.stats import stats, timechart, with_values
from govlens.operators.tables import ctime, table
from govlens.plans.reports.registry import report as _report

A = "activity"
report = partial(_report, earliest="-7d@d")
COUNT = "count(*)"
TYPE, USER = "ai.event_type", "ai.actor.email"

SIGN_IN = "ai.event_category = 'authentication' AND ai.action = 'login'"
SIGN_OUT = "ai.event_category = 'authentication' AND ai.action = 'logout'"
IDENTITY = "ai.event_category = 'admin_change' AND ai.resource.type = 'identity'"
EXPORT = "ai.event_category = 'data_export' AND ai.action = 'export'"
UPLOAD = (
    "ai.event_category = 'content_access' AND ai.resource.type = 'file' AND ai.action = 'create'"
)
AUDIT_READ = "ai.event_category = 'data_export' AND ai.action = 'read'"


def _changes(df, **more):
    """The columns all change lists share, newest first."""
    columns = {"_time": "_time", "event_type": TYPE, "user": USER, **more}
    return table(df, columns, [F.desc("_time"), F.col("ai.event_id")])


ORG = {"organization_id": "ai.org.id"}


@report("se_00", "Sign-in events", A)
def sign_ins(ev, as_of):
    return stats(ev.where(SIGN_IN), {"count": COUNT})


@report("se_01", "Sign-out events", A)
def sign_outs(ev, as_of):
    return stats(ev.where(SIGN_OUT), {"count": COUNT})


@report("se_02", "SSO and identity changes", A)
def identity_changes(ev, as_of):
    return stats(ev.where(IDENTITY), {"count": COUNT})


@report("se_03", "Data exports", A)
def exports(ev, as_of):
    return stats(ev.where(EXPORT), {"count": COUNT})


@report("se_04", "File uploads", A)
def uploads(ev, as_of):
    return stats(ev.where(UPLOAD), {"count": COUNT})


@report("se_05", "Authentication timeline", A, chart=True)
def authentication_timeline(ev, as_of, over):
    rows = ev.where("ai.event_category = 'authentication'").withColumn("event_type", F.col(TYPE))
    return timechart(rows, {"count": COUNT}, by="event_type", **over)


@report("se_06", "Sign-in volume by method", A)
def methods(ev, as_of):
    rows = ev.where(SIGN_IN).withColumn("method", F.col(TYPE))
    return stats(rows, {"count": COUNT}, ["method"]).orderBy(F.desc("count"), "method")


@report("se_07", "Sign-ins by user and source IP", A)
def sign_ins_by_ip(ev, as_of):
    rows = ev.where(SIGN_IN).select(F.col(USER).alias("user"), F.col("ai.actor.ip").alias("src_ip"), "_time")
    seen = {"count": COUNT, "first_seen": F.min("_time"), "last_seen": F.max("_time")}
    return (
        stats(rows, seen, ["user", "src_ip"])
        .withColumns({"first_seen": ctime("first_seen"), "last_seen": ctime("last_seen")})
        .orderBy(F.desc("count"), "user", "src_ip")
    )


@report("se_08", "Multi-IP sign-ins", A)
def multi_ip(ev, as_of):
    rows = ev.where(SIGN_IN).select(F.col(USER).alias("user"), F.col("ai.actor.ip").alias("src_ip"), "_time")
    return (
        with_values(
            rows,
            ["user"],
            "src_ip",
            "ips",
            distinct="distinct_ips",
            first="first_seen",
            last="last_seen",
            having=F.col("distinct_ips") > 2,
        )
        .withColumns({"first_seen": ctime("first_seen"), "last_seen": ctime("last_seen")})
        .orderBy(F.desc("distinct_ips"), "user", "ips")
    )


@report("se_09", "SSO and identity admin changes", A)
def identity_detail(ev, as_of):
    return _changes(ev.where(IDENTITY), **ORG)


@report("se_10", "Privileged user lifecycle", A)
def privileged_users(ev, as_of):
    rows = ev.where(
        "ai.event_category = 'admin_change' AND ai.resource.type IN ('user', 'group')"
    )
    return _changes(rows, **ORG)


@report("se_11", "API key lifecycle", A)
def api_keys(ev, as_of):
    rows = ev.where("ai.event_category = 'admin_change' AND ai.resource.type = 'api_key'")
    return _changes(rows, actor_type="ai.actor.type")


@report("se_12", "Access failures", A)
def access_failures(ev, as_of):
    rows = ev.where("ai.outcome = 'failure'").withColumns({"event_type": F.col(TYPE), "user": F.col(USER)})
    return stats(rows, {"count": COUNT}, ["event_type", "user"]).orderBy(
        F.desc("count"), "event_type", "user"
    )


@report("se_13", "Configuration and project changes", A)
def configuration_changes(ev, as_of):
    return _changes(
        ev.where("ai.event_category = 'admin_change'"),
        resource_type="ai.resource.type",
        resource_id="ai.resource.id",
        **ORG,
    )


@report("se_14", "Audit API consumers", A)
def audit_consumers(ev, as_of):
    rows = ev.where(AUDIT_READ).select(
        F.col("ai.actor.user_agent").alias("user_agent"),
        F.col("ai.actor.ip").alias("src_ip"),
        "_time",
    )
    return (
        with_values(
            rows,
            ["user_agent"],
            "src_ip",
            "ip_list",
            count="count",
            distinct="ips",
            first="first_seen",
            last="last_seen",
        )
        .withColumns({"first_seen": ctime("first_seen"), "last_seen": ctime("last_seen")})
        .orderBy(F.desc("count"), "user_agent", "ip_list")
    )


@report("se_15", "Data export detail", A)
def export_detail(ev, as_of):
    return _changes(ev.where(EXPORT), **ORG)


@report("se_16", "File upload activity", A)
def upload_detail(ev, as_of):
    return _changes(ev.where(UPLOAD), file_id="ai.resource.id")


@report("se_17", "Directory sync activity", A)
def directory_sync(ev, as_of):
    rows = ev.where(like("ai.actor.type", "*scim*")).withColumn("event_type", F.col(TYPE))
    return stats(rows, {"count": COUNT}, ["event_type"]).orderBy(F.desc("count"), "event_type")
