"""Directory, projects, invites, exports, conversations, integrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from govlens.operators.filters import like, raw
from govlens.operators.stats import stats, timechart, with_values
from govlens.operators.tables import dedup_latest, table
from govlens.plans.reports.registry import report

A = "activity"
TYPE, USER = "ai.event_type", "ai.actor.email"
EXPORT = "ai.event_category = 'data_export'"
COUNT = "count(*)"


def _named(df):
    return df.withColumns({"event_type": F.col(TYPE), "actor": F.col(USER)})


def _by_type_and_actor(df):
    return stats(_named(df), {"count": COUNT}, ["event_type", "actor"]).orderBy(
        F.desc("count"), "event_type", "actor"
    )


def _vendors(ev, as_of):
    return stats(ev.select(F.col("ai.vendor").alias("vendor")), {"count": COUNT}, ["vendor"]).select(
        "vendor"
    )


for _key in ("ov_pop", "se_pop", "tk_pop"):
    report(_key, "Provider list", earliest="-7d@d")(_vendors)


@report("ov_00", "Synced users", "user")
def synced_users(ev, as_of):
    return ev.agg(F.count_distinct("ai.actor.id").alias("users"))


@report("ov_01", "Synced groups", "group")
def synced_groups(ev, as_of):
    return ev.agg(F.count_distinct("ai.resource.id").alias("groups"))


@report("ov_02", "Project events", A)
def project_events(ev, as_of):
    return stats(ev.where("ai.resource.type = 'project'"), {"count": COUNT})


@report("ov_03", "User invites", A)
def user_invites(ev, as_of):
    return stats(ev.where(like(TYPE, "org_user_invite_*")), {"count": COUNT})


@report("ov_04", "Data exports", A)
def data_exports(ev, as_of):
    return stats(ev.where(EXPORT), {"count": COUNT})


@report("ov_05", "Project lifecycle events", A, chart=True)
def project_lifecycle(ev, as_of, over):
    return timechart(_named(ev.where("ai.resource.type = 'project'")), {"count": COUNT}, by="event_type", **over)


@report("ov_06", "Project visibility changes", A)
def project_visibility(ev, as_of):
    return table(
        ev.where("ai.event_type = 'project_visibility_changed'"),
        {
            "_time": "_time",
            "actor": USER,
            "project_id": "ai.resource.id",
            "visibility": raw(ev, "visibility"),
        },
        [F.desc("_time"), F.col("ai.event_id")],
    )


@report("ov_07", "User invite lifecycle", A)
def invite_lifecycle(ev, as_of):
    invites = _named(ev.where(like(TYPE, "org_user_invite_*")))
    return stats(invites, {"count": COUNT}, ["event_type"]).orderBy("event_type")


@report("ov_08", "Data export activity", A)
def export_activity(ev, as_of):
    return table(
        ev.where(EXPORT),
        {"_time": "_time", "event_type": TYPE, "actor": USER, "org_id": "ai.org.id"},
        [F.desc("_time"), F.col("ai.event_id")],
    )


@report("ov_09", "Conversation events", A)
def conversation_events(ev, as_of):
    return _by_type_and_actor(ev.where("ai.resource.type = 'chat'"))


@report("ov_10", "File uploads", A)
def file_uploads(ev, as_of):
    uploads = (
        ev.where("ai.event_category = 'content_access' AND ai.resource.type = 'file'")
        .where(like(TYPE, "*_uploaded"))
        .select(F.col(USER).alias("actor"), F.col("ai.resource.id").alias("file_id"), "_time")
    )
    return with_values(
        uploads,
        ["actor"],
        "file_id",
        "files",
        count="count",
        top=([F.desc("count"), F.col("actor")], 20),
    ).orderBy(F.desc("count"), "actor", "files")


@report("ov_11", "Directory snapshot (users)", "user")
def user_snapshot(ev, as_of):
    rows = ev.select(
        F.col(USER).alias("email"),
        raw(ev, "full_name").alias("full_name"),
        F.col("ai.actor.role").alias("role"),
        F.col("ai.actor.id").alias("user_id"),
        "_time",
    )
    return dedup_latest(rows, ["user_id"], ["_time", "email", "role"]).drop("_time")


@report("ov_12", "Directory snapshot (groups)", "group")
def group_snapshot(ev, as_of):
    rows = ev.select(
        raw(ev, "name").alias("name"),
        raw(ev, "description").alias("description"),
        raw(ev, "source_type").alias("source_type"),
        raw(ev, "roles", "array<string>").alias("roles"),
        F.col("ai.resource.id").alias("group_id"),
        "_time",
    )
    return dedup_latest(rows, ["group_id"], ["_time", "name"]).drop("_time")


@report("ov_13", "Memory governance", A)
def memory_governance(ev, as_of):
    return _by_type_and_actor(ev.where("ai.resource.type = 'memory'"))


@report("ov_14", "Invite link hygiene", A)
def invite_links(ev, as_of):
    return table(
        ev.where(like(TYPE, "org_invite_link_*")),
        {"_time": "_time", "event_type": TYPE, "actor": USER},
        [F.desc("_time"), F.col("ai.event_id")],
    )


@report("ov_15", "Integrations activity", A)
def integrations(ev, as_of):
    return _by_type_and_actor(ev.where("ai.resource.type = 'integration'"))
