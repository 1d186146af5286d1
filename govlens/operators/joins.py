"""Directory joins over landed feeds (typed columns).

No side is broadcast by hint: none has a proven size, so Catalyst and adaptive
execution choose by measured size, and split a hot key where they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govlens.functions.values import first_text, text


def users_with_org(users: DataFrame, organizations: DataFrame) -> DataFrame:
    """Users tagged with the organization they were fetched for.

    ``_fetched_for`` names that organization. Its id and name fill gaps only, and
    users of an organization without an id do not occur.
    """
    orgs = organizations.select(
        F.expr(first_text("uuid", "id")).alias("_fetched_for"),
        F.expr(text("name")).alias("_org_name"),
    ).where(F.col("_fetched_for").isNotNull())
    joined = users.join(orgs, "_fetched_for", "inner")
    given_name = (
        F.col("organization_name") if "organization_name" in users.columns else F.lit(None)
    )
    return joined.withColumn(
        "organization_uuid", F.coalesce("organization_uuid", "_fetched_for")
    ).withColumn("organization_name", F.coalesce(given_name, "_org_name")).drop("_org_name")


def _by_email(users: DataFrame) -> DataFrame:
    """One user id per lower-case e-mail: the smallest, where there are several."""
    return (
        users.select(
            F.lower(F.expr(first_text("email_address", "email"))).alias("_email"),
            F.expr(first_text("id", "user_id")).alias("user_id"),
        )
        .where(F.col("_email").isNotNull() & F.col("user_id").isNotNull())
        .groupBy("_email")
        .agg(F.min("user_id").alias("user_id"))
    )


def _with_columns(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def chats_for_users(
    targets: DataFrame, users: DataFrame, chats: DataFrame, n: int = 10
) -> DataFrame:
    """Up to ``n`` chats, oldest first, of each e-mail in ``targets(email)``.

    The limit is the feature. Spark cuts each user's chats to ``n`` before the
    shuffle as well (a partial group limit), so one user's chats never gather.
    """
    users = _with_columns(users, "email_address", "email", "id", "user_id")
    wanted = targets.select("email", F.lower("email").alias("_email")).distinct()
    found = wanted.join(_by_email(users), "_email").select("email", "user_id")
    oldest = Window.partitionBy("user_id").orderBy("created_at", "id")
    first = (
        chats.where("id <> ''")
        .withColumn("rank", F.row_number().over(oldest))
        .where(F.col("rank") <= n)
    )
    return found.join(first.select("user_id", F.col("id").alias("chat_id"), "rank"), "user_id")


def unmatched_targets(targets: DataFrame, users: DataFrame) -> DataFrame:
    """E-mails that no user has."""
    users = _with_columns(users, "email_address", "email", "id", "user_id")
    wanted = targets.select("email", F.lower("email").alias("_email")).distinct()
    return wanted.join(_by_email(users), "_email", "left_anti").select("email")


def users_without_chats(targets: DataFrame, users: DataFrame, chats: DataFrame) -> DataFrame:
    """E-mails of known users who have no chat."""
    users = _with_columns(users, "email_address", "email", "id", "user_id")
    wanted = targets.select("email", F.lower("email").alias("_email")).distinct()
    found = wanted.join(_by_email(users), "_email").select("email", "user_id")
    return found.join(chats.where("id <> ''"), "user_id", "left_anti")


def group_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Members with their group; ``members(group_id, member_id)``."""
    return groups.select(F.col("id").alias("group_id"), "name").join(members, "group_id")


def members_of(users: DataFrame, members: DataFrame, group_ids: list[str]) -> DataFrame:
    """Users who belong to any of the named groups, each once."""
    chosen = members.where(F.col("group_id").isin(group_ids))
    return users.join(chosen, users["id"] == chosen["member_id"], "left_semi")


def users_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """E-mails that both event frames know, each once."""
    email = F.lower("ai.actor.email").alias("email")
    found = left.select(email).intersect(right.select(email))
    return found.where(F.col("email").isNotNull())


def as_of_role(events: DataFrame, users: DataFrame, slot: str = "1 day") -> DataFrame:
    """``events`` with ``role``: the actor's role in the last directory snapshot by then.

    A snapshot at the very moment of an event counts. Events without an actor or time, and
    those before their actor's first snapshot, have no role; of two snapshots at one moment
    the greater role counts.

    Both sides lie below one another and the last role is carried along in time order, so
    no event is paired with a range of snapshots. Actors are cut by ``slot`` of time, so a
    busy one is many groups; what a slot begins with comes from one row per actor and slot
    that the aggregates before it make.
    """
    actor, at = F.col("ai.actor.id"), F.col("_time")
    # Rows that cannot have a role are spread, not gathered under a null.
    spread = F.when(actor.isNull() | at.isNull(), F.xxhash64("ai.event_id", "_time", F.rand(7)))
    rows = events.select(
        "*",
        F.coalesce(actor, F.lit("")).alias("_actor"),
        F.window(F.coalesce(at, F.lit(0).cast("timestamp")), slot)["start"].alias("_slot"),
        F.coalesce(spread, F.lit(0)).alias("_spread"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast("string").alias("_role"),
    )
    known = (
        users.where("ai.record = 'user' AND ai.actor.role IS NOT NULL")
        .groupBy(F.col("ai.actor.id").alias("_actor"), "_time")
        .agg(F.max("ai.actor.role").alias("_role"))
        .where("_actor IS NOT NULL AND _time IS NOT NULL")
        .withColumn("_slot", F.window("_time", slot)["start"])
    )
    snapshots = known.withColumns({"_kind": F.lit(0), "_spread": F.lit(0).cast("long")})

    # Per actor and slot: the last role in it, then the last one before it.
    slots = (
        rows.where("_spread = 0").select("_actor", "_slot", "_role", "_time")
        .unionByName(known.select("_actor", "_slot", "_role", "_time"))
        .groupBy("_actor", "_slot")
        .agg(F.max_by("_role", F.when(F.col("_role").isNotNull(), F.col("_time"))).alias("_last"))
    )
    before = Window.partitionBy("_actor").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slots.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).select(
        "_actor", "_slot", "_before"
    ).where("_before IS NOT NULL")

    until = (
        Window.partitionBy("_actor", "_slot", "_spread")
        .orderBy("_time", "_kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    both = rows.unionByName(snapshots, allowMissingColumns=True)
    inside = both.withColumn("_inside", F.last("_role", ignorenulls=True).over(until)).where("_kind = 1")
    role = F.when(F.col("_spread") == 0, F.coalesce("_inside", "_before"))
    joined = inside.join(begins, ["_actor", "_slot"], "left").withColumn("role", role)
    return joined.select(*events.columns, "role")


# Bits of the filter over directory ids: 8 MB, whatever the directory holds.
FILTER_BITS = 1 << 26
_BUCKET = 8 * 4096  # bits in a row of Spark's bitmaps


def _place(column: str, seed: int) -> str:
    return f"pmod(xxhash64({column}, {seed}), {FILTER_BITS}L)"


def known_filter(ids: DataFrame, column: str) -> DataFrame:
    """A Bloom filter over ids: rows (bucket, bits), at most ``FILTER_BITS`` bits in all."""
    places = ids.where(f"{column} IS NOT NULL").selectExpr(
        f"explode(array({_place(column, 1)}, {_place(column, 2)})) AS place"
    )
    return places.groupBy(F.expr(f"place DIV {_BUCKET}").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(place % {_BUCKET})").alias("bits")
    )


def _maybe(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: false for ids that are surely not in the filter's."""
    for seed in (1, 2):
        place = _place(column, seed)
        side = table.select(F.col("bucket").alias(f"_b{seed}"), F.col("bits").alias(f"_bits{seed}"))
        # The filter's size is fixed, so it may go to every task.
        df = df.withColumn(f"_b{seed}", F.expr(f"{place} DIV {_BUCKET}")).join(
            F.broadcast(side), f"_b{seed}", "left"
        )
        byte = f"conv(hex(substring(_bits{seed}, CAST({place} % {_BUCKET} DIV 8 AS INT) + 1, 1)), 16, 10)"
        bit = f"CAST({place} % 8 AS INT)"
        df = df.withColumn(f"_hit{seed}", F.expr(f"coalesce(shiftright(CAST({byte} AS INT), {bit}) & 1, 0) = 1"))
    drop = [f"_{name}{seed}" for name in ("b", "bits", "hit") for seed in (1, 2)]
    return df.withColumn("_maybe", F.expr("_hit1 AND _hit2")).drop(*drop)


def unknown_actors(events: DataFrame, users: DataFrame) -> DataFrame:
    """Actor ids of events that no directory user has: (actor_id, count, first, last).

    A Bloom filter of the directory tells surely unknown ids where they are read. Only the
    ids it lets through, each once per task, are looked for in the directory itself; no
    event of a known actor is shuffled. Events without an actor are left out.
    """
    ids = users.where("ai.record = 'user'").select(F.col("ai.actor.id").alias("actor_id"))
    actors = (
        events.where("ai.actor.id IS NOT NULL")
        .groupBy(F.col("ai.actor.id").alias("actor_id"))
        .agg(
            F.count("*").alias("count"),
            F.min("_time").alias("first_time"),
            F.max("_time").alias("last_time"),
        )
    )
    tested = _maybe(actors, "actor_id", known_filter(ids, "actor_id"))
    surely = tested.where("NOT _maybe").drop("_maybe")
    checked = tested.where("_maybe").drop("_maybe").join(ids.distinct(), "actor_id", "left_anti")
    return surely.unionByName(checked)


def sessions(events: DataFrame, gap: str = "2 hours", match: Column | str | None = None) -> DataFrame:
    """Sessions of each user: (user, first_time, last_time, count).

    A session goes on as long as the next event comes within ``gap``. Events without a user
    or time take no part.

    Events within one interval of the gap's length are of one session, so each user's
    events first shrink to a row per interval, where they are read; the few rows left are
    put together in time order. A busy user never gathers more than intervals.
    """
    rows = events if match is None else events.where(match)
    length = F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {gap})")
    user = F.col("ai.actor.email").alias("user")
    parts = (
        rows.where("ai.actor.email IS NOT NULL AND _time IS NOT NULL")
        .groupBy(user, F.floor(F.unix_micros("_time") / length).alias("_part"))
        .agg(F.count("*").alias("n"), F.min("_time").alias("a"), F.max("_time").alias("b"))
    )
    order = Window.partitionBy("user").orderBy("_part")
    apart = F.unix_micros("a") - F.unix_micros(F.lag("b").over(order)) > length
    numbered = parts.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy("user", "_session")
        .agg(F.min("a").alias("first_time"), F.max("b").alias("last_time"), F.sum("n").alias("count"))
        .drop("_session")
    )
