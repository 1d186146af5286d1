"""The driver's tables seen as the 14 provider feeds.

Each feed is a projection over one whole table (the summary feed groups it by
day), so a query over a feed reads all rows of its table and only the columns it
needs. Both engines must be able to state the mapping, hence its plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import providers
from govlens.plans.normalize import normalize, redact_chats
from govlens.sources.collect import union
from govlens.sources.feeds import FEEDS

AS_OF = "2024-01-31 00:00:00"
COLLECTED_AT = "2024-01-30 12:00:00"

# Native event names that the bridge deals out over the rows.
EVENT_TYPES = (
    "billing_plan_updated",
    "chat_created",
    "claude_chat_access_failed",
    "claude_code_settings_updated",
    "claude_file_uploaded",
    "compliance_api_accessed",
    "conversation_renamed",
    "file_deleted",
    "group_member_added",
    "integration_installed",
    "mcp_server_added",
    "org_api_key_revoked",
    "org_data_export_started",
    "org_domain_verified",
    "org_invite_link_created",
    "org_jit_provisioning_enabled",
    "org_settings_viewed",
    "org_sso_configuration_updated",
    "org_user_invite_accepted",
    "org_user_invite_sent",
    "org_user_role_updated",
    "org_workspace_created",
    "platform_memory_updated",
    "project_created",
    "project_visibility_changed",
    "rbac_role_assigned",
    "sso_login_initiated",
    "user_name_changed",
    "user_signed_in_google",
    "user_signed_in_magic_link",
    "user_signed_in_sso",
    "user_signed_out",
    "workspace_api_key_created",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity_columns(events: DataFrame) -> DataFrame:
    """The audit feed over an ``events`` frame, batch or stream."""
    names = ", ".join(f"'{n}'" for n in EVENT_TYPES)
    named = events.selectExpr(
        "event_id",
        "user_id",
        "ts",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        f"element_at(array({names}), CAST((event_id * 7 + user_id) % 33 AS INT) + 1) AS type",
    )
    return named.selectExpr(
        "concat('activity_', event_id) AS id",
        "CAST(ts AS TIMESTAMP) AS created_at",
        "type",
        """named_struct(
            'type', CASE event_id % 11 WHEN 0 THEN 'api_actor'
                                       WHEN 5 THEN 'scim_directory_sync_actor'
                                       ELSE 'user_actor' END,
            'user_id', CASE WHEN event_id % 11 NOT IN (0, 5) THEN concat('user_', user_id) END,
            'email_address', CASE WHEN event_id % 11 IN (0, 5) THEN NULL
                                  WHEN event_id % 11 = 7 THEN ''
                                  ELSE concat('user', user_id, '@example.test') END,
            'email', CASE WHEN event_id % 11 = 7
                          THEN concat('user', user_id, '@example.test') END,
            'ip_address', CASE WHEN event_id % 17 <> 0
                               THEN concat('10.', user_id div 256, '.', user_id % 256, '.', k % 5)
                               END,
            'user_agent', concat('agent/', k % 7),
            'api_key_id', CASE WHEN event_id % 11 = 0 THEN concat('key_', user_id % 5) END,
            'directory_id', CASE WHEN event_id % 11 = 5 THEN 'dir_01' END) AS actor""",
        "concat('org_', user_id % 5) AS organization_id",
        "CASE WHEN event_id % 3 <> 0 THEN concat('uuid-', user_id % 5) ELSE '' END"
        " AS organization_uuid",
        "CASE WHEN type LIKE 'project%' THEN concat('proj_', user_id % 20) END"
        " AS claude_project_id",
        "CASE WHEN type LIKE '%chat%' OR type LIKE 'conversation%' OR event_id % 19 = 0"
        " THEN concat('chat_', k) END AS claude_chat_id",
        "CASE WHEN type LIKE '%file%' THEN concat('file_', event_id % 500) END AS file_id",
        "CASE WHEN type = 'project_visibility_changed'"
        " THEN CASE k % 2 WHEN 0 THEN 'organization' ELSE 'private' END END AS visibility",
        "CASE WHEN type = 'group_member_added' THEN concat('rbac_group_', k % 25) END AS group_id",
    )


def _activity(spark, d):
    return activity_columns(table(spark, d, "events"))


def _summary(spark, d):
    days = (
        table(spark, d, "events")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            F.expr("count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END)").alias("d"),
            F.expr(
                "count(DISTINCT CASE WHEN event_type IN ('purchase', 'click', 'view')"
                " THEN user_id END)"
            ).alias("w"),
            F.expr("count(DISTINCT user_id)").alias("m"),
            F.expr("count_if(event_type = 'signup')").alias("s"),
        )
    )
    return days.selectExpr(
        "CAST(day AS TIMESTAMP) AS starting_at",
        "CAST(day + INTERVAL 1 DAY AS STRING) AS ending_at",
        "d AS daily_active_user_count",
        "w AS weekly_active_user_count",
        "m AS monthly_active_user_count",
        "2000L AS seat_count",
        "s % 5 AS pending_invite_count",
        "CAST(d * 100 div 2000 AS DOUBLE) AS daily_adoption_rate",
        "CAST(w * 100 div 2000 AS DOUBLE) AS weekly_adoption_rate",
        "CAST(m * 100 div 2000 AS DOUBLE) AS monthly_adoption_rate",
    )


def _usage(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "CAST(l_shipdate AS TIMESTAMP) AS starting_at",
        "'1d' AS bucket_width",
        "CASE l_returnflag WHEN 'A' THEN 'chat' WHEN 'N' THEN 'claude_code' ELSE 'cowork' END"
        " AS product",
        "CASE l_linestatus WHEN 'O' THEN 'all' ELSE concat('model-', l_linenumber) END AS model",
        "CASE WHEN l_linenumber <> 7 OR l_linestatus <> 'F'"
        " THEN CAST(l_quantity * 100 AS BIGINT) END AS output_tokens",
        "CASE WHEN l_linenumber < 7 THEN CAST(l_quantity * 400 AS BIGINT) END"
        " AS uncached_input_tokens",
        "CASE WHEN l_linenumber < 6 THEN l_partkey % 50 END AS cache_read_input_tokens",
        "CASE WHEN l_linenumber < 5 THEN l_suppkey % 10 END AS cache_creation_input_tokens",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
        " AS line",
    )


_CENTS = "CAST(CAST(round({0} * 100) AS DECIMAL(18, 6)) AS STRING)"


def cost_columns(orders: DataFrame) -> DataFrame:
    """The cost feed over an ``orders`` frame, batch or stream."""
    return orders.selectExpr(
        "CAST(o_orderdate AS TIMESTAMP) AS starting_at",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'chat' WHEN '2-HIGH' THEN 'claude_code'"
        " ELSE 'cowork' END AS product",
        "'all' AS model",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'n/a'"
        f" ELSE {_CENTS.format('o_totalprice')} END AS amount",
        "CASE WHEN o_orderkey % 10 = 0"
        " THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS total_cost_usd",
        "'USD' AS currency",
        "concat('order-', o_orderkey) AS line",
    )


def _user_usage(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "CAST(CAST(l_shipdate AS DATE) AS STRING) AS date",
        "concat('supp', l_suppkey, '@example.test') AS email",
        "concat('supp_', l_suppkey) AS user_id",
        "CAST(l_quantity * 10 AS BIGINT) AS output_tokens",
        "CASE WHEN l_linenumber <> 4 THEN l_partkey % 1000 END AS uncached_input_tokens",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
        " AS line",
    )


def user_cost_columns(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS date",
        "CASE WHEN o_orderkey % 4 <> 0 THEN concat('cust', o_custkey, '@example.test') END"
        " AS email",
        "concat('cust_', o_custkey) AS user_id",
        "named_struct('email_address', concat('cust', o_custkey, '@example.test'),"
        " 'user_id', concat('cust_', o_custkey)) AS actor",
        f"{_CENTS.format('o_totalprice')} AS amount",
        "concat('order-', o_orderkey) AS line",
    )


def _user_activity(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k"
    )
    return rows.selectExpr(
        "CAST(CAST(ts AS DATE) AS STRING) AS date",
        "concat('user', user_id, '@example.test') AS email",
        "concat('user_', user_id) AS user_id",
        """named_struct(
            'sessions', CASE event_type WHEN 'signup' THEN 1L ELSE 0L END,
            'tool_accepted_count', CASE event_type WHEN 'click' THEN k ELSE 0L END,
            'tool_rejected_count', CASE event_type WHEN 'error' THEN k % 7 ELSE 0L END,
            'lines_of_code_added', CASE event_type WHEN 'purchase' THEN k * 10 END
           ) AS claude_code_metrics""",
        "named_struct('messages_sent', k, 'connectors_used_count',"
        " CASE event_type WHEN 'view' THEN k % 3 ELSE 0L END) AS chat_metrics",
        "named_struct('sessions', k % 2, 'connectors_used_count',"
        " CASE event_type WHEN 'purchase' THEN k % 2 ELSE 0L END) AS cowork_metrics",
    )


_LIMIT = (
    "CASE WHEN c_custkey % 10 = 0 THEN '0.000000' WHEN c_custkey % 97 = 1 THEN 'unknown'"
    " ELSE CAST(CAST(13701 * (1 + c_custkey % 7) AS DECIMAL(18, 6)) AS STRING) END"
)
_SPEND = f"CASE WHEN c_custkey % 13 <> 0 THEN {_CENTS.format('abs(c_acctbal) / 10')} END"


def _spend_limit(spark, d):
    return table(spark, d, "customer").selectExpr(
        "CASE WHEN c_custkey % 6 <> 0"
        " THEN TIMESTAMP '2024-01-30 00:00:00' + make_dt_interval(0, 0, 0, c_custkey % 86400) END"
        " AS created_at",
        "TIMESTAMP '2024-01-30 06:00:00' AS updated_at",
        "concat('cust', c_custkey, '@example.test') AS email",
        "concat('cust_', c_custkey) AS user_id",
        f"{_LIMIT} AS amount",
        f"{_SPEND} AS period_to_date_spend",
        "'monthly' AS period",
        "named_struct('type', CASE c_custkey % 3 WHEN 0 THEN 'rbac_group' ELSE 'seat_tier' END,"
        " 'seat_tier', CASE c_custkey % 3 WHEN 1 THEN 'standard' WHEN 2 THEN 'restricted' END,"
        " 'rbac_group_id', CASE c_custkey % 3 WHEN 0 THEN concat('rbac_group_', c_nationkey) END)"
        " AS source",
    )


def _spend_limit_request(spark, d):
    return table(spark, d, "customer").selectExpr(
        "concat('slr_', c_custkey) AS id",
        "CASE c_custkey % 4 WHEN 1 THEN 'approved' WHEN 2 THEN 'denied' ELSE 'pending' END"
        " AS status",
        "TIMESTAMP '2024-01-29 00:00:00' + make_dt_interval(0, 0, 0, c_custkey % 86400)"
        " AS created_at",
        "concat('cust', c_custkey, '@example.test') AS email",
        "concat('cust_', c_custkey) AS user_id",
        f"named_struct('amount', {_LIMIT}, 'period_to_date_spend', {_SPEND}) AS spend_summary",
    )


def _user(spark, d):
    """Two directory syncs, a day apart; roles move between them."""
    syncs = table(spark, d, "customer").selectExpr("*", "explode(array(0, 1)) AS sync")
    return syncs.selectExpr(
        "concat('cust_', c_custkey) AS id",
        "c_name AS full_name",
        "concat('cust', c_custkey, '@example.test') AS email",
        "CASE (c_custkey + sync) % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'user' ELSE 'billing' END"
        " AS organization_role",
        "CASE WHEN c_custkey % 5 <> 0 THEN concat('uuid-', c_nationkey % 5) END"
        " AS organization_uuid",
        "concat('uuid-', c_nationkey % 5) AS _fetched_for",
        f"TIMESTAMP '{COLLECTED_AT}' - make_dt_interval(1 - sync) AS _collected_at",
    )


def _organization(spark, d):
    return table(spark, d, "region").selectExpr(
        "concat('uuid-', r_regionkey) AS uuid",
        "CAST(NULL AS STRING) AS id",
        "CASE WHEN r_regionkey <> 4 THEN r_name END AS name",
        "'2023-12-28T21:16:51Z' AS created_at",
        f"TIMESTAMP '{COLLECTED_AT}' AS _collected_at",
    )


def _group(spark, d):
    return table(spark, d, "nation").selectExpr(
        "concat('rbac_group_', n_nationkey) AS id",
        "n_name AS name",
        "CASE WHEN n_nationkey % 4 <> 0 THEN concat('Members of ', n_name) ELSE '' END"
        " AS description",
        "CASE n_nationkey % 2 WHEN 0 THEN 'scim' ELSE 'direct' END AS source_type",
        "CASE WHEN n_nationkey % 3 <> 0 THEN array(concat('rbac_role_', n_regionkey))"
        " ELSE CAST(array() AS ARRAY<STRING>) END AS roles",
        "'2024-01-01T21:16:51Z' AS created_at",
        f"TIMESTAMP '{COLLECTED_AT}' AS _collected_at",
    )


def _chat(spark, d):
    """One chat per conversation row; each line of its whole text is a message."""
    return table(spark, d, "conversations").selectExpr(
        "concat('chat_', conv_id, '_', turn) AS id",
        "concat('Conversation ', conv_id) AS name",
        "CAST(TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(turn AS INT), 0)"
        " AS STRING) AS created_at",
        "concat('cust_', conv_id % 50) AS user_id",
        "transform(split(text, '\\n'), t -> named_struct('role', role, 'text', t)) AS messages",
        f"TIMESTAMP '{COLLECTED_AT}' AS _collected_at",
    )


def _file(spark, d):
    return table(spark, d, "documents").selectExpr(
        "concat('file_', doc_id) AS id",
        "concat('doc', doc_id, '.txt') AS filename",
        "n_chars AS size_bytes",
        "'2024-01-18T13:00:00Z' AS created_at",
        "concat('user_', doc_id % 150) AS uploaded_by",
        f"TIMESTAMP '{COLLECTED_AT}' AS _collected_at",
    )


def dense(events: DataFrame) -> DataFrame:
    """All rows of ``events``, with two users in a month that lasts an hour."""
    start = "unix_micros(TIMESTAMP '2024-01-01 00:00:00')"
    ts = f"timestamp_micros({start} + (unix_micros(CAST(ts AS TIMESTAMP)) - {start}) DIV 720)"
    return events.withColumns({"user_id": F.expr("user_id % 2"), "ts": F.expr(ts)})


def role_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory syncs of the audit feed's users: each day they sign up, with a new role."""
    days = (
        table(spark, sf_dir, "events")
        .where("event_type = 'signup'")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.max("ts").alias("ts"))
    )
    return days.selectExpr(
        "concat('user_', user_id) AS id",
        "concat('user', user_id, '@example.test') AS email",
        "CASE (user_id + day(day)) % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'user' ELSE 'billing' END"
        " AS organization_role",
        "CAST(ts AS TIMESTAMP) AS _collected_at",
    )


def _cost(spark, d):
    return cost_columns(table(spark, d, "orders"))


def _user_cost(spark, d):
    return user_cost_columns(table(spark, d, "orders"))


_FEEDS = {
    "activity": _activity,
    "user": _user,
    "organization": _organization,
    "group": _group,
    "chat": _chat,
    "file": _file,
    "summary": _summary,
    "usage": _usage,
    "cost": _cost,
    "user_usage": _user_usage,
    "user_cost": _user_cost,
    "user_activity": _user_activity,
    "spend_limit": _spend_limit,
    "spend_limit_request": _spend_limit_request,
}


def feed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One feed with typed columns, as a landing job would keep it."""
    return _FEEDS[kind](spark, sf_dir)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group membership: customers belong to the group of their nation."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('rbac_group_', c_nationkey) AS group_id", "concat('cust_', c_custkey) AS member_id"
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection jobs' own log."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END"
        " AS level",
        "concat('collector_', user_id % 4, '.log') AS source",
        """CASE WHEN event_type = 'view' AND user_id % 3 = 0
                THEN concat('Rate limited (429), retrying attempt ', event_id % 5)
                WHEN event_type = 'error' AND user_id % 5 = 0
                THEN concat('APIError in cycle #', event_id)
                ELSE concat('cycle #', event_id) END AS message""",
    )


def events_of(spark: SparkSession, sf_dir: str, kind: str, account: str = "main") -> DataFrame:
    rows = feed(spark, sf_dir, kind)
    if kind == "chat":
        rows = redact_chats(rows)
    return normalize(rows, kind, providers.DEFAULT, COLLECTED_AT, account)


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The normalized events of the named kinds, by default of all 14."""
    return union([events_of(spark, sf_dir, kind) for kind in kinds or FEEDS])
