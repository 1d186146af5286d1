"""The same questions in the SQL of another engine, over the same tables.

Each text repeats the mapping of a table to its feed, the rules as GLOB tests and
then the report itself, written for that engine. The lists of rules, vocabularies and
categories are the library's own; all else is written a second time.
"""

from __future__ import annotations

from govlens import providers
from govlens.contract import RECORD_CATEGORY, leaves
from govlens.functions.rules import VOCABULARY
from govlens.sources.bridge import EVENT_TYPES

VENDOR, PRODUCT = providers.VENDOR, providers.PRODUCT
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
COLLECTED = "TIMESTAMP '2024-01-30 12:00:00'"


def _case(column: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {column} GLOB '{p}' THEN '{v}'" for p, v in rules)
    return f"CASE {whens} ELSE {default} END"


_NAMES = ", ".join(f"'{n}'" for n in EVENT_TYPES)

CTES = {
    "act0": f"""
        SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k,
               ([{_NAMES}])[CAST((event_id * 7 + user_id) % 33 AS INT) + 1] AS event_type
        FROM events""",
    "act1": """
        SELECT *,
            CASE WHEN event_type LIKE 'project%' THEN 'proj_' || (user_id % 20) END AS project_id,
            CASE WHEN event_type LIKE '%chat%' OR event_type LIKE 'conversation%'
                   OR event_id % 19 = 0 THEN 'chat_' || k END AS chat_id,
            CASE WHEN event_type LIKE '%file%' THEN 'file_' || (event_id % 500) END AS file_id
        FROM act0""",
    "act": f"""
        SELECT event_id AS n, ts AS _time, event_type, 'activity_' || event_id AS event_id, k,
            {_case("event_type", providers.CATEGORY_RULES, "'usage'")} AS category,
            {_case("event_type", providers.ACTION_RULES, "'unknown'")} AS action,
            {_case("event_type", providers.OUTCOME_RULES, "'success'")} AS outcome,
            {_case("event_type", providers.RESOURCE_RULES,
                   "CASE WHEN coalesce(project_id, chat_id, file_id) IS NOT NULL"
                   " THEN 'other' END")} AS rtype,
            CASE WHEN event_type LIKE 'claude_chat%' OR event_type LIKE 'conversation%'
                   THEN coalesce(chat_id, project_id, file_id)
                 WHEN event_type LIKE '%file%' THEN coalesce(file_id, project_id, chat_id)
                 ELSE coalesce(project_id, chat_id, file_id) END AS rid,
            CASE WHEN event_id % 11 NOT IN (0, 5) THEN 'user' || user_id || '@example.test' END
                AS email,
            CASE WHEN event_id % 11 NOT IN (0, 5) THEN 'user_' || user_id END AS actor_id,
            CASE event_id % 11 WHEN 0 THEN 'api_actor' WHEN 5 THEN 'scim_directory_sync_actor'
                 ELSE 'user_actor' END AS actor_type,
            CASE WHEN event_id % 17 <> 0
                 THEN '10.' || (user_id // 256) || '.' || (user_id % 256) || '.' || (k % 5) END
                AS ip,
            'agent/' || (k % 7) AS user_agent,
            'org_' || (user_id % 5) AS org_id,
            CASE WHEN event_id % 3 <> 0 THEN 'uuid-' || (user_id % 5) END AS org_uuid,
            chat_id AS raw_chat_id,
            CASE WHEN event_type = 'project_visibility_changed'
                 THEN CASE WHEN k % 2 = 0 THEN 'organization' ELSE 'private' END END AS visibility,
            CASE WHEN event_type = 'group_member_added' THEN 'rbac_group_' || (k % 25) END
                AS group_id,
            CASE WHEN event_id % 11 = 0 THEN 'key_' || (user_id % 5) END AS api_key_id,
            CASE WHEN event_id % 11 = 5 THEN 'dir_01' END AS directory_id
        FROM act1""",
    "summary": """
        SELECT *, d * 100 // 2000 AS daily_rate, w * 100 // 2000 AS weekly_rate,
               m * 100 // 2000 AS monthly_rate
        FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS _time,
                     count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS d,
                     count(DISTINCT user_id)
                         FILTER (WHERE event_type IN ('purchase', 'click', 'view')) AS w,
                     count(DISTINCT user_id) AS m,
                     count(*) FILTER (WHERE event_type = 'signup') % 5 AS invites
              FROM events GROUP BY 1) g""",
    "usage0": """
        SELECT l_shipdate AS _time,
            CASE l_returnflag WHEN 'A' THEN 'chat' WHEN 'N' THEN 'claude_code' ELSE 'cowork' END
                AS product,
            CASE WHEN l_linestatus <> 'O' THEN 'model-' || l_linenumber END AS model,
            CASE WHEN l_linenumber <> 7 OR l_linestatus <> 'F'
                 THEN CAST(l_quantity * 100 AS BIGINT) END AS o,
            CASE WHEN l_linenumber < 7 THEN CAST(l_quantity * 400 AS BIGINT) END AS u,
            CASE WHEN l_linenumber < 6 THEN l_partkey % 50 END AS r,
            CASE WHEN l_linenumber < 5 THEN l_suppkey % 10 END AS c
        FROM lineitem""",
    "usage": """
        SELECT *, CASE WHEN i IS NOT NULL OR o IS NOT NULL THEN coalesce(i, 0) + coalesce(o, 0) END
                  AS t
        FROM (SELECT *, CASE WHEN u IS NOT NULL OR r IS NOT NULL OR c IS NOT NULL
                        THEN coalesce(u, 0) + coalesce(r, 0) + coalesce(c, 0) END AS i
              FROM usage0) x""",
    "cost": """
        SELECT o_orderdate AS _time,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'chat' WHEN '2-HIGH' THEN 'claude_code'
                 ELSE 'cowork' END AS product,
            CASE WHEN o_orderkey % 10 = 0 THEN round(o_totalprice, 2)
                 WHEN o_orderkey % 23 = 0 THEN NULL
                 ELSE round(o_totalprice * 100) / 100 END AS usd
        FROM orders""",
    "user_usage": """
        SELECT l_shipdate AS _time, 'supp' || l_suppkey || '@example.test' AS email,
            'supp_' || l_suppkey AS actor_id, CAST(l_quantity * 10 AS BIGINT) AS o,
            CASE WHEN l_linenumber <> 4 THEN l_partkey % 1000 END AS i
        FROM lineitem""",
    "user_cost": """
        SELECT o_orderdate AS _time, 'cust' || o_custkey || '@example.test' AS email,
            'cust_' || o_custkey AS actor_id, round(o_totalprice * 100) / 100 AS usd
        FROM orders""",
    "user_activity0": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "user_activity": """
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS _time,
            'user' || user_id || '@example.test' AS email, 'user_' || user_id AS actor_id, k,
            CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS sessions,
            CASE WHEN event_type = 'click' THEN k ELSE 0 END AS accepted,
            CASE WHEN event_type = 'error' THEN k % 7 ELSE 0 END AS rejected,
            CASE WHEN event_type = 'purchase' THEN k * 10 END AS lines,
            CASE WHEN event_type = 'view' THEN k % 3 ELSE 0 END AS chat_connectors,
            CASE WHEN event_type = 'purchase' THEN k % 2 ELSE 0 END AS cowork_connectors
        FROM user_activity0""",
    "limits0": """
        SELECT *,
            CASE WHEN c_custkey % 10 = 0 THEN 0.0
                 WHEN c_custkey % 97 = 1 THEN NULL
                 ELSE CAST(13701 * (1 + c_custkey % 7) AS DOUBLE) / 100 END AS limit_usd,
            CASE WHEN c_custkey % 13 <> 0 THEN round(abs(c_acctbal) / 10 * 100) / 100 END
                AS spend_usd
        FROM customer""",
    "limits": """
        SELECT 'cust' || c_custkey || '@example.test' AS email, 'cust_' || c_custkey AS actor_id,
            limit_usd, spend_usd,
            CASE WHEN limit_usd > 0 AND spend_usd IS NOT NULL
                 THEN round_even(100.0 * spend_usd / limit_usd, 1)
                 WHEN limit_usd = 0 THEN 100.0 END AS pct,
            CASE WHEN c_custkey % 6 <> 0
                 THEN TIMESTAMP '2024-01-30 00:00:00' + to_seconds(c_custkey % 86400)
                 ELSE TIMESTAMP '2024-01-30 06:00:00' END AS _time,
            CASE WHEN c_custkey % 3 = 0 THEN 'rbac_group' ELSE 'seat_tier' END AS source_type,
            CASE c_custkey % 3 WHEN 1 THEN 'standard' WHEN 2 THEN 'restricted' END AS seat_tier,
            CASE WHEN c_custkey % 3 = 0 THEN 'rbac_group_' || c_nationkey END AS rbac_group_id
        FROM limits0""",
    "requests": """
        SELECT 'slr_' || c_custkey AS id, 'cust' || c_custkey || '@example.test' AS email,
            'cust_' || c_custkey AS actor_id,
            CASE c_custkey % 4 WHEN 1 THEN 'approved' WHEN 2 THEN 'denied' ELSE 'pending' END
                AS status,
            TIMESTAMP '2024-01-29 00:00:00' + to_seconds(c_custkey % 86400) AS _time,
            limit_usd, spend_usd
        FROM limits0""",
    "users": f"""
        SELECT 'cust_' || c_custkey AS id, c_name AS full_name,
            'cust' || c_custkey || '@example.test' AS email,
            CASE (c_custkey + s.sync) % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'user' ELSE 'billing' END
                AS role,
            CASE WHEN c_custkey % 5 <> 0 THEN 'uuid-' || (c_nationkey % 5) END AS org_uuid,
            'uuid-' || (c_nationkey % 5) AS fetched_for,
            {COLLECTED} - to_days(CAST(1 - s.sync AS INT)) AS _time
        FROM customer, (VALUES (0), (1)) s(sync)""",
    "groups": """
        SELECT 'rbac_group_' || n_nationkey AS id, n_name AS name,
            CASE WHEN n_nationkey % 4 <> 0 THEN 'Members of ' || n_name END AS description,
            CASE WHEN n_nationkey % 2 = 0 THEN 'scim' ELSE 'direct' END AS source_type,
            CASE WHEN n_nationkey % 3 <> 0 THEN 'rbac_role_' || n_regionkey ELSE '' END AS roles
        FROM nation""",
    "chats": """
        SELECT 'chat_' || conv_id || '_' || turn AS id, 'Conversation ' || conv_id AS name,
            TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS created_at,
            'cust_' || (conv_id % 50) AS user_id,
            len(string_split(text, chr(10))) AS message_count
        FROM conversations""",
    "roles": """
        SELECT 'user_' || user_id AS actor_id, max(ts) AS _time,
            CASE (user_id + day(max(ts))) % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'user' ELSE 'billing' END
                AS role
        FROM events WHERE event_type = 'signup' GROUP BY user_id, CAST(ts AS DATE)""",
    "log": """
        SELECT ts,
            CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END
                AS level,
            'collector_' || (user_id % 4) || '.log' AS source,
            CASE WHEN event_type = 'view' AND user_id % 3 = 0
                 THEN 'Rate limited (429), retrying attempt ' || (event_id % 5)
                 WHEN event_type = 'error' AND user_id % 5 = 0
                 THEN 'APIError in cycle #' || event_id
                 ELSE 'cycle #' || event_id END AS message
        FROM events""",
}
_NEEDS = {
    "act1": ("act0",),
    "act": ("act0", "act1"),
    "usage": ("usage0",),
    "user_activity": ("user_activity0",),
    "limits": ("limits0",),
    "requests": ("limits0",),
}
ORACLE: dict[str, str] = {}


def q(name: str, ctes: str, body: str, *more: tuple[str, str]) -> None:
    """Register ``body`` behind the named feeds and further steps."""
    wanted: list[str] = []
    for cte in ctes.split():
        for part in (*_NEEDS.get(cte, ()), cte):
            if part not in wanted:
                wanted.append(part)
    parts = [(w, CTES[w]) for w in wanted] + list(more)
    head = "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in parts) if parts else ""
    ORACLE[name] = f"{head}\n{body}"


Range = tuple[str, str] | None  # first moment, and the one after the last


def _axis(cells: str, span: str, over: Range) -> str:
    first, last = f"(SELECT min(bucket) FROM {cells})", f"(SELECT max(bucket) FROM {cells})"
    if over:
        first = f"date_trunc('{span}', TIMESTAMP '{over[0]}')"
        last = f"date_trunc('{span}', TIMESTAMP '{over[1]}' - INTERVAL 1 MICROSECOND)"
    return f"unnest(generate_series({first}, {last}, INTERVAL 1 {span.upper()}))"


def _within(column: str, over: Range) -> str:
    if not over:
        return "true"
    return f"{column} >= TIMESTAMP '{over[0]}' AND {column} < TIMESTAMP '{over[1]}'"


def chart(
    name: str, ctes: str, rows: str, span: str = "day", limit: int = 10, over: Range = None
) -> None:
    """Counts per bucket and series; ``rows`` gives (t, series)."""
    q(
        name,
        ctes,
        "SELECT g.bucket, g.series, coalesce(n.count, 0) AS count"
        " FROM grid g LEFT JOIN named n USING (bucket, series)",
        ("rws", rows),
        (
            "cells",
            f"SELECT CAST(date_trunc('{span}', t) AS TIMESTAMP) AS bucket,"
            " coalesce(series, 'NULL') AS series, count(*) AS n FROM rws"
            f" WHERE {_within('t', over)} GROUP BY 1, 2",
        ),
        (
            "kept",
            "SELECT series FROM cells WHERE series <> 'NULL' GROUP BY 1"
            f" ORDER BY sum(n) DESC, series LIMIT {limit}",
        ),
        (
            "named",
            "SELECT bucket, CASE WHEN series = 'NULL' OR series IN (SELECT series FROM kept)"
            " THEN series ELSE 'OTHER' END AS series, CAST(sum(n) AS BIGINT) AS count"
            " FROM cells GROUP BY 1, 2",
        ),
        (
            "grid",
            f"SELECT b.bucket, s.series FROM (SELECT {_axis('named', span, over)} AS bucket) b,"
            " (SELECT DISTINCT series FROM named) s",
        ),
    )


def trend(
    name: str, ctes: str, table: str, aggs: dict[str, str], span: str = "day", over: Range = None
) -> None:
    """Several aggregates per bucket, gaps filled."""
    listed = ", ".join(f"{sql} AS {n}" for n, sql in aggs.items())
    shown = ", ".join(
        f"coalesce(c.{n}, 0) AS {n}" if sql == "count(*)" else f"c.{n}" for n, sql in aggs.items()
    )
    q(
        name,
        ctes,
        f"SELECT g.bucket, {shown} FROM grid g LEFT JOIN cells c USING (bucket)",
        (
            "cells",
            f"SELECT CAST(date_trunc('{span}', _time) AS TIMESTAMP) AS bucket, {listed}"
            f" FROM {table} WHERE {_within('_time', over)} GROUP BY 1",
        ),
        ("grid", f"SELECT {_axis('cells', span, over)} AS bucket"),
    )


# --- overview -------------------------------------------------------------------
for _key in ("ov_pop", "se_pop", "tk_pop"):
    q(_key, "", f"SELECT DISTINCT '{VENDOR}' AS vendor FROM events")
q("ov_00", "users", "SELECT count(DISTINCT id) AS users FROM users")
q("ov_01", "groups", "SELECT count(DISTINCT id) AS groups FROM groups")
q("ov_02", "act", "SELECT count(*) AS count FROM act WHERE rtype = 'project'")
q("ov_03", "act", "SELECT count(*) AS count FROM act WHERE event_type LIKE 'org_user_invite_%'")
q("ov_04", "act", "SELECT count(*) AS count FROM act WHERE category = 'data_export'")
for _key, _over in (
    ("ov_05", None),
    ("ov_05_range", ("2024-01-06 00:00:00", "2024-01-20 07:30:00")),
):
    chart(
        _key,
        "act",
        "SELECT _time AS t, event_type AS series FROM act WHERE rtype = 'project'",
        over=_over,
    )
q(
    "ov_06",
    "act",
    "SELECT _time, email AS actor, rid AS project_id, visibility FROM act"
    " WHERE event_type = 'project_visibility_changed'",
)
q(
    "ov_07",
    "act",
    "SELECT event_type, count(*) AS count FROM act WHERE event_type LIKE 'org_user_invite_%'"
    " GROUP BY 1",
)
q(
    "ov_08",
    "act",
    "SELECT _time, event_type, email AS actor, org_id FROM act WHERE category = 'data_export'",
)
for _key, _type in (("ov_09", "chat"), ("ov_13", "memory"), ("ov_15", "integration")):
    q(
        _key,
        "act",
        "SELECT event_type, email AS actor, count(*) AS count FROM act"
        f" WHERE rtype = '{_type}' AND email IS NOT NULL GROUP BY 1, 2",
    )
q(
    "ov_10",
    "act",
    """SELECT k.actor, k.count, v.files
       FROM (SELECT email AS actor, count(*) AS count FROM up GROUP BY 1
             ORDER BY count DESC, actor LIMIT 20) k
       LEFT JOIN (SELECT DISTINCT email AS actor, rid AS files FROM up WHERE rid IS NOT NULL) v
         USING (actor)""",
    (
        "up",
        "SELECT * FROM act WHERE category = 'content_access' AND rtype = 'file'"
        " AND event_type LIKE '%\\_uploaded' ESCAPE '\\' AND email IS NOT NULL",
    ),
)
q(
    "ov_11",
    "users",
    "SELECT max(email) AS email, max(full_name) AS full_name, arg_max(role, _time) AS role,"
    " id AS user_id FROM users GROUP BY id",
)
q("ov_12", "groups", "SELECT name, description, source_type, roles, id AS group_id FROM groups")
q(
    "ov_14",
    "act",
    "SELECT _time, event_type, email AS actor FROM act WHERE event_type LIKE 'org_invite_link_%'",
)

# --- security -------------------------------------------------------------------
SIGN_IN = "category = 'authentication' AND action = 'login'"
IDENTITY = "category = 'admin_change' AND rtype = 'identity'"
EXPORT = "category = 'data_export' AND action = 'export'"
UPLOAD = "category = 'content_access' AND rtype = 'file' AND action = 'create'"
READ = "category = 'data_export' AND action = 'read'"
for _key, _where in (
    ("se_00", SIGN_IN),
    ("se_01", "category = 'authentication' AND action = 'logout'"),
    ("se_02", IDENTITY),
    ("se_03", EXPORT),
    ("se_04", UPLOAD),
):
    q(_key, "act", f"SELECT count(*) AS count FROM act WHERE {_where}")
chart(
    "se_05",
    "act",
    "SELECT _time AS t, event_type AS series FROM act WHERE category = 'authentication'",
)
q(
    "se_06",
    "act",
    f"SELECT event_type AS method, count(*) AS count FROM act WHERE {SIGN_IN} GROUP BY 1",
)
_SEEN = (
    "strftime(min(_time), '%m/%d/%Y %H:%M:%S') AS first_seen,"
    " strftime(max(_time), '%m/%d/%Y %H:%M:%S') AS last_seen"
)
q(
    "se_07",
    "act",
    f"SELECT email AS user, ip AS src_ip, count(*) AS count, {_SEEN} FROM act"
    f" WHERE {SIGN_IN} AND email IS NOT NULL AND ip IS NOT NULL GROUP BY 1, 2",
)


def listed(source: str, keys: str, totals: str, value: str, name: str, having: str = "") -> str:
    """Totals per key next to its distinct values, one row each."""
    each = f"SELECT DISTINCT {keys}, {value} AS {name} FROM ({source}) s WHERE {value} IS NOT NULL"
    return (
        f"SELECT * FROM (SELECT {keys}, {totals} FROM ({source}) s GROUP BY {keys} {having}) k"
        f" LEFT JOIN ({each}) v USING ({keys})"
    )


q(
    "se_08",
    "act",
    listed(
        f"SELECT email AS user, * FROM act WHERE {SIGN_IN} AND email IS NOT NULL",
        "user",
        f"count(DISTINCT ip) AS distinct_ips, {_SEEN}",
        "ip",
        "ips",
        "HAVING count(DISTINCT ip) > 2",
    ),
)
q(
    "se_08_range",
    "act",
    listed(
        f"SELECT email AS user, * FROM act WHERE {SIGN_IN} AND email IS NOT NULL"
        " AND _time >= TIMESTAMP '2024-01-13' AND _time < TIMESTAMP '2024-01-20 07:30:00'",
        "user",
        f"count(DISTINCT ip) AS distinct_ips, {_SEEN}",
        "ip",
        "ips",
        "HAVING count(DISTINCT ip) > 2",
    ),
)
_CHANGE = "SELECT _time, event_type, email AS user{more} FROM act WHERE {where}"
for _key, _where, _more in (
    ("se_09", IDENTITY, ", org_id AS organization_id"),
    (
        "se_10",
        "category = 'admin_change' AND rtype IN ('user', 'group')",
        ", org_id AS organization_id",
    ),
    ("se_11", "category = 'admin_change' AND rtype = 'api_key'", ", actor_type"),
    (
        "se_13",
        "category = 'admin_change'",
        ", rtype AS resource_type, rid AS resource_id, org_id AS organization_id",
    ),
    ("se_15", EXPORT, ", org_id AS organization_id"),
    ("se_16", UPLOAD, ", rid AS file_id"),
):
    q(_key, "act", _CHANGE.format(more=_more, where=_where))
q(
    "se_12",
    "act",
    "SELECT event_type, email AS user, count(*) AS count FROM act WHERE outcome = 'failure'"
    " AND email IS NOT NULL GROUP BY 1, 2",
)
q(
    "se_14",
    "act",
    listed(
        f"SELECT * FROM act WHERE {READ}",
        "user_agent",
        f"count(*) AS count, count(DISTINCT ip) AS ips, {_SEEN}",
        "ip",
        "ip_list",
    ),
)
q(
    "se_17",
    "act",
    "SELECT event_type, count(*) AS count FROM act WHERE lower(actor_type) LIKE '%scim%' GROUP BY 1",
)

# --- tokens and money -----------------------------------------------------------
q("tk_00", "summary", "SELECT arg_max(d, _time) AS daily_active_users FROM summary")
q(
    "tk_01",
    "summary",
    "SELECT CAST(arg_max(daily_rate, _time) AS DOUBLE) AS daily_adoption_rate FROM summary",
)
q("tk_02", "cost", "SELECT round(sum(usd), 2) AS total_spend FROM cost")
q("tk_03", "usage", "SELECT CAST(sum(o) AS BIGINT) AS output_tokens FROM usage")
q("tk_04", "limits", "SELECT count(*) AS count FROM limits WHERE pct >= 80")
q("tk_04_users", "limits", "SELECT count(DISTINCT actor_id) AS count FROM limits WHERE pct >= 80")
trend("tk_05", "summary", "summary", {"dau": "round(avg(d), 4)", "wau": "round(avg(w), 4)"})
trend(
    "tk_06",
    "summary",
    "summary",
    {"daily": "round(avg(daily_rate), 4)", "monthly": "round(avg(monthly_rate), 4)"},
)
q(
    "tk_07",
    "usage",
    "SELECT product, CAST(sum(t) AS BIGINT) AS total_tokens FROM usage GROUP BY 1",
)
q("tk_08", "cost", "SELECT product, round(sum(usd), 4) AS spend_usd FROM cost GROUP BY 1")
trend("tk_09", "cost", "cost", {"spend_usd": "round(sum(usd), 4)"})
for _key, _over in (
    ("tk_09_range", ("1996-02-04 00:00:00", "1996-03-05 01:00:00")),
    ("tk_09_empty", ("2024-01-01 00:00:00", "2024-01-31 00:00:00")),
):
    trend(_key, "cost", "cost", {"spend_usd": "round(sum(usd), 4)"}, over=_over)
trend(
    "tk_10",
    "usage",
    "usage",
    {"output_tokens": "CAST(sum(o) AS BIGINT)", "input_tokens": "CAST(sum(i) AS BIGINT)"},
)
q(
    "tk_11",
    "user_cost",
    "SELECT email AS user, round(sum(usd), 4) AS cost_usd FROM user_cost GROUP BY 1"
    " ORDER BY sum(usd) DESC, 1 LIMIT 15",
)
q(
    "tk_12",
    "user_usage",
    "SELECT email, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens,"
    " CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens,"
    " CAST(coalesce(sum(o), 0) + coalesce(sum(i), 0) AS BIGINT) AS total_tokens"
    " FROM user_usage GROUP BY 1 ORDER BY total_tokens DESC, email LIMIT 15",
)
_LIMIT_LIST = (
    "SELECT email, limit_usd, spend_usd, pct AS utilization_pct, source_type AS limit_source,"
    " 'monthly' AS period FROM limits"
)
q("tk_13", "limits", f"{_LIMIT_LIST} WHERE pct >= 80")
q("tk_14", "limits", f"{_LIMIT_LIST} ORDER BY spend_usd DESC NULLS LAST, email LIMIT 25")
q(
    "tk_15",
    "requests",
    "SELECT _time, email, status, limit_usd AS requested_limit_usd,"
    " spend_usd AS period_spend_usd, id AS request_id FROM requests WHERE status = 'pending'",
)

# --- coding tool ----------------------------------------------------------------
q(
    "cc_00",
    "act",
    "SELECT _time, event_type, email FROM act WHERE event_type LIKE 'claude\\_code\\_%' ESCAPE '\\'",
)
for _key, _over in (
    ("cc_01", None),
    ("cc_01_range", ("2024-01-20 00:00:00", "2024-02-03 12:00:00")),
):
    chart(
        _key,
        "act",
        "SELECT _time AS t, event_type AS series FROM act"
        " WHERE regexp_matches(event_type, '^(mcp|integration|extension)_')",
        over=_over,
    )
q(
    "cc_02",
    "user_activity",
    "SELECT count(DISTINCT email) AS cc_users FROM user_activity WHERE sessions > 0",
)
q("cc_03", "cost", "SELECT round(sum(usd), 2) AS spend_usd FROM cost WHERE product = 'claude_code'")
q(
    "cc_04",
    "user_activity",
    """SELECT email, CAST(sum(accepted) AS BIGINT) AS accepted,
              CAST(sum(rejected) AS BIGINT) AS rejected,
              CASE WHEN sum(accepted) + sum(rejected) > 0
                   THEN round(100.0 * sum(rejected) / (sum(accepted) + sum(rejected)), 1)
                   ELSE 0.0 END AS reject_rate
       FROM user_activity GROUP BY 1 ORDER BY rejected DESC, email LIMIT 20""",
)
q(
    "cc_05",
    "user_activity",
    """SELECT email, CAST(sum(chat_connectors) AS BIGINT) AS chat_connectors,
              CAST(sum(cowork_connectors) AS BIGINT) AS cowork_connectors,
              CAST(sum(chat_connectors) + sum(cowork_connectors) AS BIGINT) AS total_connectors
       FROM user_activity GROUP BY 1
       HAVING sum(chat_connectors) + sum(cowork_connectors) > 0
       ORDER BY total_connectors DESC, email LIMIT 20""",
)

# --- pipeline health --------------------------------------------------------------
_TIMES = {
    "compliance:activity": "SELECT ts AS t FROM events",
    "compliance:user": "SELECT _time AS t FROM users",
    "compliance:organization": f"SELECT {COLLECTED} AS t FROM region",
    "compliance:group": f"SELECT {COLLECTED} AS t FROM nation",
    "compliance:chat_content": f"SELECT {COLLECTED} AS t FROM conversations",
    "compliance:file_metadata": f"SELECT {COLLECTED} AS t FROM documents",
    "analytics:summary": "SELECT _time AS t FROM summary",
    "analytics:usage": "SELECT l_shipdate AS t FROM lineitem",
    "analytics:cost": "SELECT o_orderdate AS t FROM orders",
    "analytics:user_usage": "SELECT l_shipdate AS t FROM lineitem",
    "analytics:user_cost": "SELECT o_orderdate AS t FROM orders",
    "analytics:user_activity": "SELECT _time AS t FROM user_activity",
    "analytics:spend_limit": "SELECT _time AS t FROM limits",
    "analytics:spend_limit_request": "SELECT _time AS t FROM requests",
}
_ALL = "users summary user_activity limits requests"
# End of the sourcetype -> record.
_RECORD_OF = dict(
    zip(
        _TIMES,
        "activity user organization group chat file summary usage cost user_usage user_cost"
        " user_activity spend_limit spend_limit_request".split(),
    )
)


def _all_times(*leave: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(t AS TIMESTAMP) AS t, '{VENDOR}:{name}' AS series FROM ({sql}) x"
        for name, sql in _TIMES.items()
        if name not in leave
    )


q(
    "th_00",
    _ALL,
    "SELECT series AS sourcetype, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last,"
    f" round((epoch_us({AS_OF}) - epoch_us(max(t))) / 60000000.0, 1) AS lag_minutes"
    " FROM times GROUP BY 1",
    ("times", _all_times()),
)
chart("th_01", _ALL, _all_times(), "hour", over=("2023-12-31 00:00:00", "2024-01-31 00:00:00"))
q(
    "th_00_range",
    _ALL,
    "SELECT series AS sourcetype, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last,"
    " round((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(t))) / 60000000.0, 1)"
    f" AS lag_minutes FROM times WHERE {_within('t', ('2024-01-29 12:00:00', '2024-01-30 12:00:00'))}"
    " GROUP BY 1",
    ("times", _all_times()),
)
q(
    "th_02",
    "act",
    "SELECT event_type, count(*) AS count FROM act GROUP BY 1 ORDER BY count DESC, 1 LIMIT 15",
)
q("th_03", "log", "SELECT source, count(*) AS count FROM log WHERE level = 'ERROR' GROUP BY 1")
q(
    "th_04",
    "log",
    "SELECT ts AS _time, source, message AS _raw FROM log WHERE level = 'ERROR'"
    " ORDER BY ts DESC, source, message LIMIT 20",
)
trend(
    "th_05",
    "log",
    "(SELECT ts AS _time FROM log WHERE regexp_matches(message, '(?i)(^|[^a-z0-9_])(rate limited|429|apierror)($|[^a-z0-9_])'))",
    {"count": "count(*)"},
    "hour",
)

# --- detections: one run over all time --------------------------------------------
_MULTI = listed(
    f"SELECT email AS user, * FROM {{src}} WHERE {SIGN_IN} AND email IS NOT NULL",
    "{run}user",
    "count(DISTINCT ip) AS ip_count",
    "ip",
    "ips",
    "HAVING count(DISTINCT ip) >= 3",
)
_APIKEY = "category = 'admin_change' AND rtype = 'api_key' AND action = 'create'"
_ROLE = "category = 'admin_change' AND rtype = 'user' AND event_type LIKE '%role%'"
_ROWS = "SELECT {run}_time, event_type, email AS user, org_id AS organization_id FROM {src} WHERE "
_CHAT = listed(
    "SELECT email AS user, * FROM {src} WHERE category = 'content_access' AND rtype = 'chat'"
    " AND outcome = 'failure' AND email IS NOT NULL",
    "{run}user",
    "count(*) AS count",
    "rid",
    "chats",
    "HAVING count(*) >= 5",
)
_NEWAPI = (
    "SELECT {run}user_agent, ip AS src_ip,"
    " strftime(min(_time), '%m/%d/%Y %H:%M:%S') AS first_seen, count(*) AS count"
    f" FROM {{src}} WHERE {READ} AND ip IS NOT NULL GROUP BY {{by}}user_agent, ip"
    " HAVING min(_time) >= {now} - INTERVAL 1 DAY"
)
_LIMITED = (
    "SELECT {run}email AS user, arg_max(pct, _time) AS utilization_pct,"
    " arg_max(spend_usd, _time) AS period_spend_usd, arg_max(limit_usd, _time) AS spend_limit_usd"
    " FROM {src} GROUP BY {by}email HAVING arg_max(pct, _time) >= 100"
)
_SINGLE = {
    "d_multi_ip": _MULTI,
    "d_sso": _ROWS + IDENTITY,
    "d_export": _ROWS + EXPORT,
    "d_apikey": _ROWS + _APIKEY,
    "d_role": _ROWS + _ROLE,
    "d_chat": _CHAT,
    "d_newapi": _NEWAPI,
}
for _key, _sql in _SINGLE.items():
    q(_key, "act", _sql.format(run="", by="", src="act", now=AS_OF))
q("d_limit", "limits", _LIMITED.format(run="", by="", src="limits"))
q(
    "d_topcost",
    "user_cost",
    "SELECT email AS user, round(sum(usd), 4) AS total_cost_usd FROM user_cost GROUP BY 1"
    " ORDER BY sum(usd) DESC, 1 LIMIT 20",
)
q(
    "d_spike",
    "cost",
    """SELECT y AS yesterday_usd, round(b, 4) AS baseline_avg_usd
       FROM (SELECT max(daily) FILTER (WHERE n = 1) AS y,
                    avg(daily) FILTER (WHERE n BETWEEN 2 AND 8) AS b
             FROM (SELECT daily, row_number() OVER (ORDER BY day DESC) AS n
                   FROM (SELECT date_trunc('day', _time) AS day, sum(usd) AS daily
                         FROM cost GROUP BY 1) d) r) f
       WHERE y > 1.5 * b""",
)
q(
    "d_stopped",
    "",
    f"""SELECT max(ts) AS last,
               round((epoch_us({AS_OF}) - epoch_us(max(ts))) / 1000000.0, 4) AS lag_sec
        FROM events HAVING epoch_us({AS_OF}) - epoch_us(max(ts)) > 7200000000""",
)


# --- detections over their schedules ----------------------------------------------
def schedule(first: str, last: str, step: str) -> tuple[str, str]:
    return (
        "runs",
        f"SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}',"
        f" INTERVAL {step})) AS run_time",
    )


JAN = {
    "d_multi_ip": (schedule("2023-12-31 06:00:00", "2024-01-31 00:00:00", "6 HOURS"), "24 HOURS"),
    "d_sso": (schedule("2023-12-31 01:00:00", "2024-01-31 00:00:00", "1 HOUR"), "1 HOUR"),
    "d_export": (schedule("2023-12-31 00:05:00", "2024-01-31 00:00:00", "1 HOUR"), "1 HOUR"),
    "d_apikey": (schedule("2023-12-31 00:10:00", "2024-01-31 00:00:00", "1 HOUR"), "1 HOUR"),
    "d_role": (schedule("2023-12-31 00:15:00", "2024-01-31 00:00:00", "1 HOUR"), "1 HOUR"),
    "d_chat": (schedule("2023-12-31 00:20:00", "2024-01-31 00:00:00", "1 HOUR"), "1 HOUR"),
    "d_newapi": (schedule("2023-12-31 06:30:00", "2024-01-31 00:00:00", "1 DAY"), None),
}


def _windowed(key: str) -> tuple[tuple[str, str], tuple[str, str]]:
    runs, back = JAN[key]
    start = f"run_time - INTERVAL {back}" if back else "date_trunc('day', run_time) - INTERVAL 30 DAYS"
    return runs, (
        "win",
        f"SELECT r.run_time, a.* FROM runs r JOIN act a ON a._time >= {start}"
        " AND a._time < r.run_time",
    )


def _hits(key: str) -> str:
    return _SINGLE[key].format(run="run_time, ", by="run_time, ", src="win", now="run_time")


for _key in JAN:
    q(f"backtest_{_key}", "act", _hits(_key), *_windowed(_key))
_LIMIT_STEPS = (
    schedule("2023-12-31 00:45:00", "2024-01-31 00:00:00", "4 HOURS"),
    (
        "win",
        f"SELECT r.run_time, l.* FROM runs r, limits l WHERE {COLLECTED} < r.run_time"
        f" AND {COLLECTED} >= r.run_time - INTERVAL 24 HOURS",
    ),
)
q(
    "backtest_d_limit",
    "limits",
    _LIMITED.format(run="run_time, ", by="run_time, ", src="win"),
    *_LIMIT_STEPS,
)
_DAYS = schedule("1994-12-31 08:00:00", "2001-12-31 00:00:00", "1 DAY")
_TOPCOST = """SELECT run_time, user, round(total, 4) AS total_cost_usd
       FROM (SELECT *, row_number() OVER (PARTITION BY run_time ORDER BY total DESC, user) AS n
             FROM (SELECT run_time, email AS user, sum(usd) AS total
                   FROM runs JOIN user_cost ON _time < run_time
                    AND _time >= run_time - INTERVAL 7 DAYS GROUP BY 1, 2) s) t
       WHERE n <= 20"""
q("backtest_d_topcost", "user_cost", _TOPCOST, _DAYS)
_SPIKE = """SELECT run_time, round(y, 4) AS yesterday_usd, round(b, 4) AS baseline_avg_usd
       FROM (SELECT run_time, max(daily) FILTER (WHERE n = 1) AS y,
                    avg(daily) FILTER (WHERE n BETWEEN 2 AND 8) AS b
             FROM (SELECT run_time, daily,
                          row_number() OVER (PARTITION BY run_time ORDER BY day DESC) AS n
                   FROM {runs} JOIN daily ON day < date_trunc('day', run_time)
                    AND day >= date_trunc('day', run_time) - INTERVAL 9 DAYS) r
             GROUP BY 1) f
       WHERE y > 1.5 * b"""
_SPIKE_STEPS = (
    schedule("1994-12-31 09:00:00", "2001-12-31 00:00:00", "1 DAY"),
    ("daily", "SELECT date_trunc('day', _time) AS day, sum(usd) AS daily FROM cost GROUP BY 1"),
)
q("backtest_d_spike", "cost", _SPIKE.format(runs="runs"), *_SPIKE_STEPS)
q(
    "backtest_d_stopped",
    "",
    """SELECT run_time, last, round(lag_us / 1000000.0, 4) AS lag_sec
       FROM (SELECT run_time, max(ts) AS last,
                    epoch_us(run_time) - coalesce(epoch_us(max(ts)), 0) AS lag_us
             FROM runs LEFT JOIN events ON ts < run_time AND ts >= run_time - INTERVAL 7 DAYS
             GROUP BY 1) l
       WHERE lag_us > 7200000000""",
    schedule("2023-12-31 00:25:00", "2024-01-31 00:00:00", "1 HOUR"),
)

q(
    "d_stopped_later",
    "",
    """SELECT max(ts) AS last, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 1000000.0, 4)
           AS lag_sec FROM events""",
)
# All events in one hour, of two users.
_DENSE = (
    (
        "dense",
        """SELECT event_id, user_id % 2 AS user_id, event_type, value, props,
               make_timestamp(epoch_us(TIMESTAMP '2024-01-01')
                              + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 720) AS ts
           FROM events""",
    ),
    ("act0", CTES["act0"].replace("FROM events", "FROM dense")),
    ("act1", CTES["act1"]),
    ("act", CTES["act"]),
)
q("backtest_d_chat_dense", "", _hits("d_chat"), *_DENSE, *_windowed("d_chat"))

# Suppression is a walk over the firings: the next one not before the silence ends.
def walk(name: str, ctes: str, silence: str, severity: str, *steps: tuple[str, str]) -> None:
    """``fired`` (detection, run_time, hits) is the last of the steps."""
    q(name, ctes, "", *steps)
    ORACLE[name] = (
        ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
        + f""",
    walk(detection, run_time, hits) AS (
        SELECT detection, min(run_time), arg_min(hits, run_time) FROM fired GROUP BY 1
        UNION ALL
        SELECT n.detection, n.run_time, n.hits FROM (
            SELECT f.detection, f.run_time, f.hits, row_number() OVER (
                       PARTITION BY w.detection, w.run_time ORDER BY f.run_time) AS k
            FROM walk w JOIN fired f ON f.detection = w.detection
             AND f.run_time >= w.run_time + {silence}) n
        WHERE n.k = 1)
    SELECT detection, {severity} AS severity, run_time, hits FROM walk"""
    )


walk(
    "throttle_sso_6h",
    "act",
    "INTERVAL 6 HOURS",
    "5",
    *_windowed("d_sso"),
    (
        "fired",
        f"SELECT 'd_sso' AS detection, run_time, count(*) AS hits FROM ({_hits('d_sso')}) h"
        " GROUP BY ALL",
    ),
)

# Detection, severity, minutes of silence.
_ALERTS = {
    "d_multi_ip": (4, 720),
    "d_sso": (5, 30),
    "d_export": (5, 30),
    "d_apikey": (4, 30),
    "d_role": (5, 30),
    "d_chat": (4, 120),
    "d_newapi": (4, 720),
    "d_stopped": (4, 240),
    "d_limit": (4, 720),
    "d_spike": (3, 1200),
}
_steps: list[tuple[str, str]] = []
for _key in JAN:
    (_, _runs), (_, _win) = _windowed(_key)
    _steps += [
        (f"runs_{_key}", _runs),
        (f"win_{_key}", _win.replace("FROM runs r", f"FROM runs_{_key} r")),
    ]
_steps.append(
    ("runs_stopped", schedule("2023-12-31 00:25:00", "2024-01-31 00:00:00", "1 HOUR")[1])
)
_fired = [
    f"SELECT '{_key}' AS detection, run_time,"
    f" {'count(DISTINCT user)' if _key in ('d_multi_ip', 'd_chat') else 'count(*)'} AS hits FROM ("
    + _SINGLE[_key].format(run="run_time, ", by="run_time, ", src=f"win_{_key}", now="run_time")
    + ") h GROUP BY ALL"
    for _key in JAN
]
_fired.append(
    "SELECT 'd_stopped' AS detection, run_time, 1 AS hits FROM runs_stopped LEFT JOIN events"
    " ON ts < run_time AND ts >= run_time - INTERVAL 7 DAYS GROUP BY run_time"
    " HAVING epoch_us(run_time) - coalesce(epoch_us(max(ts)), 0) > 7200000000"
)
_limit_runs, _limit_rows = _LIMIT_STEPS
_steps += [
    ("runs_limit", _limit_runs[1]),
    ("win_limit", _limit_rows[1].replace("FROM runs r", "FROM runs_limit r")),
    ("runs_spike", _SPIKE_STEPS[0][1]),
    _SPIKE_STEPS[1],
]
_fired.append(
    "SELECT 'd_limit' AS detection, run_time, count(*) AS hits FROM ("
    + _LIMITED.format(run="run_time, ", by="run_time, ", src="win_limit")
    + ") h GROUP BY ALL"
)
_fired.append(
    "SELECT 'd_spike' AS detection, run_time, count(*) AS hits FROM ("
    + _SPIKE.format(runs="runs_spike")
    + ") h GROUP BY ALL"
)
_steps.append(("fired", " UNION ALL ".join(_fired)))
_cases = " ".join(f"WHEN '{k}' THEN {m}" for k, (_, m) in _ALERTS.items())
_severities = " ".join(f"WHEN '{k}' THEN {v}" for k, (v, _) in _ALERTS.items())
walk(
    "alerts",
    "act limits cost",
    f"to_minutes(CASE w.detection {_cases} END)",
    f"CASE detection {_severities} END",
    *_steps,
)

# --- normalization ----------------------------------------------------------------
_ACT_ROWS = """
    SELECT _time, category, email, actor_id, event_type, event_id, action, outcome, actor_type, ip,
        user_agent, org_id, org_uuid, rtype AS resource_type, rid AS resource_id,
        visibility AS raw_visibility, group_id AS raw_group_id,
        raw_chat_id AS raw_claude_chat_id, api_key_id AS raw_actor_api_key_id,
        directory_id AS raw_actor_directory_id, CAST(NULL AS VARCHAR) AS raw_type
    FROM act"""
q("normalize_activity", "act", _ACT_ROWS)
q("normalize_activity_json", "act", _ACT_ROWS)
q(
    "normalize_user",
    "users",
    """SELECT _time, 'policy' AS category, email, id AS actor_id, role, org_uuid,
        'user' AS resource_type, id AS resource_id, id AS raw_id, full_name AS raw_full_name,
        CAST(NULL AS VARCHAR) AS raw_email FROM users""",
)
q(
    "normalize_organization",
    "",
    f"""SELECT {COLLECTED} AS _time, 'policy' AS category, 'uuid-' || r_regionkey AS org_uuid,
        'org' AS resource_type, 'uuid-' || r_regionkey AS resource_id,
        'uuid-' || r_regionkey AS raw_uuid,
        CASE WHEN r_regionkey <> 4 THEN r_name END AS raw_name,
        '2023-12-28T21:16:51Z' AS raw_created_at FROM region""",
)
q(
    "normalize_group",
    "groups",
    f"""SELECT {COLLECTED} AS _time, 'policy' AS category, 'group' AS resource_type,
        id AS resource_id, name AS raw_name, description AS raw_description,
        source_type AS raw_source_type, roles AS raw_roles FROM groups""",
)
q(
    "normalize_chat",
    "chats",
    f"""SELECT {COLLECTED} AS _time, 'content_access' AS category, 'chat' AS resource_type,
        id AS resource_id, name AS raw_name, '[REDACTED]' AS raw_messages,
        message_count AS raw_message_count FROM chats""",
)
q(
    "normalize_file",
    "",
    f"""SELECT {COLLECTED} AS _time, 'content_access' AS category, 'file' AS resource_type,
        'file_' || doc_id AS resource_id, 'doc' || doc_id || '.txt' AS raw_filename,
        'user_' || (doc_id % 150) AS raw_uploaded_by, n_chars AS raw_size_bytes FROM documents""",
)
q(
    "normalize_summary",
    "summary",
    """SELECT _time, 'usage' AS category, d AS daily_active_users, w AS weekly_active_users,
        m AS monthly_active_users, CAST(2000 AS BIGINT) AS seats, invites AS pending_invites,
        CAST(daily_rate AS DOUBLE) AS daily_rate, CAST(weekly_rate AS DOUBLE) AS weekly_rate,
        CAST(monthly_rate AS DOUBLE) AS monthly_rate,
        strftime(_time + INTERVAL 1 DAY, '%Y-%m-%d') AS raw_ending_at FROM summary""",
)
q(
    "normalize_usage",
    "usage",
    """SELECT _time, 'usage' AS category, usage.model, i AS input_tokens, o AS output_tokens,
        t AS total_tokens, product AS raw_product, coalesce(usage.model, 'all') AS raw_model,
        u AS raw_uncached_input_tokens FROM usage""",
)
q(
    "normalize_cost",
    "cost",
    """SELECT _time, 'cost' AS category, usd AS amount_usd, 'USD' AS currency,
        product AS raw_product, 'all' AS raw_model, CAST(NULL AS VARCHAR) AS raw_amount
       FROM cost""",
)
q(
    "normalize_user_usage",
    "user_usage",
    """SELECT _time, 'usage' AS category, email, actor_id, i AS input_tokens, o AS output_tokens,
        coalesce(i, 0) + o AS total_tokens, CAST(NULL AS VARCHAR) AS raw_email FROM user_usage""",
)
q(
    "normalize_user_cost",
    "user_cost",
    """SELECT _time, 'cost' AS category, email, actor_id, usd AS amount_usd,
        CAST(NULL AS VARCHAR) AS raw_email, CAST(NULL AS VARCHAR) AS raw_date FROM user_cost""",
)
q(
    "normalize_user_activity",
    "user_activity",
    """SELECT _time, 'usage' AS category, email, actor_id,
        CAST(sessions AS BIGINT) AS raw_claude_code_metrics_sessions,
        lines AS raw_claude_code_metrics_lines_of_code_added,
        k AS raw_chat_metrics_messages_sent, k % 2 AS raw_cowork_metrics_sessions
       FROM user_activity""",
)
q(
    "normalize_spend_limit",
    "limits",
    """SELECT _time, 'cost' AS category, email, actor_id, actor_id AS resource_id, limit_usd,
        spend_usd, pct AS utilization_pct, source_type AS raw_source_type,
        seat_tier AS raw_source_seat_tier, rbac_group_id AS raw_source_rbac_group_id,
        'monthly' AS raw_period, CAST(NULL AS VARCHAR) AS raw_amount FROM limits""",
)
q(
    "normalize_spend_limit_request",
    "requests",
    """SELECT _time, 'policy' AS category, email, actor_id, actor_id AS resource_id,
        limit_usd AS requested_limit_usd, spend_usd, id AS raw_id, status AS raw_status,
        CAST(NULL AS VARCHAR) AS raw_spend_summary FROM requests""",
)

# --- rules ------------------------------------------------------------------------
_BOOKS = {
    "category": (providers.CATEGORY_RULES, "usage"),
    "action": (providers.ACTION_RULES, "unknown"),
    "resource": (providers.RESOURCE_RULES, "other"),
    "outcome": (providers.OUTCOME_RULES, "success"),
}
_RULE_ROWS = ", ".join(
    f"('{kind}', {idx}, '{pattern}', '{value}')"
    for kind, (listed, default) in _BOOKS.items()
    for idx, (pattern, value) in [*enumerate(listed), (-1, ("", default))]
)
_RULES = ("rules", f"SELECT * FROM (VALUES {_RULE_ROWS}) r(kind, idx, pattern, value)")
_DECIDED = (
    "decided",
    """SELECT a.event_id, k.kind, coalesce(min(r.idx), -1) AS idx
       FROM act a CROSS JOIN (SELECT DISTINCT kind FROM rules) k
       LEFT JOIN rules r ON r.kind = k.kind AND r.idx >= 0 AND a.event_type GLOB r.pattern
       GROUP BY 1, 2""",
)
q(
    "rule_hits",
    "act",
    """SELECT r.kind, r.idx, r.pattern, r.value, coalesce(h.n, 0) AS events
       FROM rules r LEFT JOIN (SELECT kind, idx, count(*) AS n FROM decided GROUP BY 1, 2) h
         USING (kind, idx)""",
    _RULES,
    _DECIDED,
)
q(
    "rule_of_event",
    "act",
    "SELECT d.event_id, kind, r.pattern, r.value FROM decided d JOIN rules r USING (kind, idx)",
    _RULES,
    _DECIDED,
)
q(
    "sql_functions",
    "act",
    """SELECT event_type AS name, category, outcome, event_type GLOB 'org_*ed' AS org_past,
              count(*) AS n FROM act GROUP BY 1, 2, 3, 4
       UNION ALL
       SELECT 'cents', NULL, NULL, NULL, count(*) FROM orders
       WHERE o_orderkey % 10 <> 0 AND o_orderkey % 23 <> 0""",
)

# --- checks -----------------------------------------------------------------------
q(
    "violations",
    "act cost",
    """SELECT 'activity' AS record, 'vocabulary' AS rule, 'ai.vendor' AS path, count(*) AS count
       FROM act WHERE n % 50 = 0 HAVING count(*) > 0
       UNION ALL SELECT 'activity', 'required_activity', 'ai.action', count(*) FROM act
       WHERE n % 70 = 0 HAVING count(*) > 0
       UNION ALL SELECT 'activity', 'null_text', 'ai.actor.email', count(*) FROM act
       WHERE n % 90 = 1 HAVING count(*) > 0
       UNION ALL SELECT 'cost', 'record_category', 'ai.event_category', count(*) FROM cost
       WHERE usd IS NULL HAVING count(*) > 0""",
)
q(
    "violations_clean",
    _ALL,
    f"""SELECT record, count(*) AS events, CAST(0 AS BIGINT) AS violations
        FROM times JOIN (VALUES {', '.join(f"('{VENDOR}:{kind}', '{record}')" for kind, record in _RECORD_OF.items())})
             v(series, record) USING (series) GROUP BY 1""",
    ("times", _all_times()),
)
# Record -> its rows, and the fields that some or all of them have.
_N = "count(*)"
_SUBJECT = {"ai.resource.type": _N, "ai.resource.id": _N}
_USER = {"ai.actor.email": _N, "ai.actor.id": _N}
_COVERED = {
    "activity": (
        "act",
        {
            **{f"ai.{f}": _N for f in ("event_type", "event_id", "action", "outcome")},
            "ai.actor.email": "count(email)", "ai.actor.id": "count(actor_id)", "ai.actor.type": _N,
            "ai.actor.ip": "count(ip)", "ai.actor.user_agent": _N, "ai.org.id": _N,
            "ai.org.uuid": "count(org_uuid)", "ai.resource.type": "count(rtype)",
            "ai.resource.id": "count(rid)",
        },
    ),
    "user": ("users", {**_USER, **_SUBJECT, "ai.actor.role": _N, "ai.org.uuid": "count(org_uuid)"}),
    "organization": ("region", {**_SUBJECT, "ai.org.uuid": _N}),
    "group": ("groups", _SUBJECT),
    "chat": ("conversations", _SUBJECT),
    "file": ("documents", _SUBJECT),
    "summary": (
        "summary",
        {
            f"ai.adoption.{f}": _N
            for f in (
                "daily_active_users", "weekly_active_users", "monthly_active_users", "seats",
                "pending_invites", "daily_rate", "weekly_rate", "monthly_rate",
            )
        },
    ),
    "usage": (
        "usage",
        {
            "ai.model": "count(usage.model)", "ai.usage.input_tokens": "count(i)",
            "ai.usage.output_tokens": "count(o)", "ai.usage.total_tokens": "count(t)",
        },
    ),
    "cost": ("cost", {"ai.cost.amount_usd": "count(usd)", "ai.cost.currency": _N}),
    "user_usage": (
        "user_usage",
        {
            **_USER, "ai.usage.input_tokens": "count(i)", "ai.usage.output_tokens": _N,
            "ai.usage.total_tokens": _N,
        },
    ),
    "user_cost": ("user_cost", {**_USER, "ai.cost.amount_usd": _N}),
    "user_activity": ("user_activity", _USER),
    "spend_limit": (
        "limits",
        {
            **_USER, **_SUBJECT, "ai.cost.limit_usd": "count(limit_usd)",
            "ai.cost.spend_usd": "count(spend_usd)", "ai.cost.utilization_pct": "count(pct)",
        },
    ),
    "spend_limit_request": (
        "requests",
        {
            **_USER, **_SUBJECT, "ai.cost.requested_limit_usd": "count(limit_usd)",
            "ai.cost.spend_usd": "count(spend_usd)",
        },
    ),
}
_ENVELOPE = [f"ai.{f}" for f in ("time", "schema_version", "vendor", "product", "record", "event_category")]


def _covered(record: str) -> str:
    table, known = _COVERED[record]
    counts = {path: "CAST(0 AS BIGINT)" for path, _ in leaves()} | dict.fromkeys(_ENVELOPE, _N) | known
    rows = ", ".join(f"('{path}', c{k})" for k, path in enumerate(counts))
    columns = ", ".join(f"{sql} AS c{k}" for k, sql in enumerate(counts.values()))
    return (
        f"SELECT '{record}' AS record, path, present, round(100.0 * present / n, 2) AS pct"
        f" FROM (SELECT count(*) AS n, {columns} FROM {table}) t, (VALUES {rows}) v(path, present)"
    )


q(
    "coverage",
    f"act {_ALL} groups usage cost user_usage user_cost",
    " UNION ALL ".join(f"SELECT * FROM ({_covered(record)}) {record}_" for record in _COVERED),
)
q(
    "rule_problems",
    "",
    "SELECT DISTINCT 'category' AS kind, event_type AS value FROM events",
)
q(
    "rule_problems_of",
    "",
    f"""SELECT DISTINCT 'action' AS kind, event_type AS pattern, event_type AS value FROM events
        WHERE event_type NOT IN ({', '.join(repr(v) for v in VOCABULARY['action'])})
        UNION ALL SELECT 'vendor', '{VENDOR}', 'other'""",
)
q(
    "category_gaps",
    "",
    "SELECT record, CAST(1 AS BIGINT) AS categories, CAST(NULL AS VARCHAR) AS side FROM (VALUES "
    + ", ".join(f"('{r}')" for r in RECORD_CATEGORY)
    + ") v(record)",
)
q(
    "golden_damaged",
    "act",
    """SELECT 'expected' AS side, count(*) + count(*) FILTER (WHERE n % 7 = 0 AND n % 5 = 0) AS count
       FROM act WHERE n % 7 = 0 OR n % 5 = 0""",
)
q(
    "golden_diff",
    "",
    "SELECT count(*) AS events, count(*) AS landed, CAST(0 AS BIGINT) AS differ FROM events",
)

# --- sources, cycles, store -------------------------------------------------------
q(
    "explode_pages",
    "",
    """SELECT conv_id, conv_id || '-' || turn AS id, count(*) AS records,
              CAST(sum(length(line)) AS BIGINT) AS size
       FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line
             FROM conversations WHERE turn <> 1) l GROUP BY 1, 2""",
)
_LAST = (
    "SELECT arg_max(event_id, (_time, event_id)) AS last_id, max(_time) AS last_created_at,"
    " count(*) AS count FROM {0}"
)
q(
    "incremental_first",
    "act",
    _LAST.format("act"),
)
q(
    "incremental_next",
    "act",
    _LAST.format("act")
    + " WHERE (_time, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 'activity_5')",
)
q(
    "report_window",
    "summary",
    "SELECT _time, d AS daily_active_users FROM summary"
    " WHERE _time >= TIMESTAMP '2024-01-20' AND _time < TIMESTAMP '2024-01-28'",
)


def _count(kind: str, source: str, rows: str) -> str:
    return (
        f"SELECT '{VENDOR}:{kind}' AS sourcetype, count(*) AS count, '{VENDOR}:{source}' AS source"
        f" FROM {rows} HAVING count(*) > 0"
    )


_FINAL = "WHERE _time >= TIMESTAMP '2024-01-21' AND _time < TIMESTAMP '2024-01-28'"
q(
    "collect_cycle",
    "users summary usage user_cost user_activity limits requests",
    " UNION ALL ".join(
        [
            _count("compliance:activity", "compliance:activities:main", "events"),
            _count("compliance:organization", "compliance:directory:main:organizations", "region"),
            _count("compliance:user", "compliance:directory:main:users", "users"),
            _count("compliance:chat_content", "compliance:content:main:chat", "conversations"),
            _count("compliance:file_metadata", "compliance:content:main:file", "documents"),
            _count("analytics:summary", "analytics:main:summary", f"summary {_FINAL}"),
            _count("analytics:usage", "analytics:main:usage", f"usage {_FINAL}"),
            _count("analytics:user_cost", "analytics:main:user_cost", f"user_cost {_FINAL}"),
            _count(
                "analytics:user_activity", "analytics:main:user_activity", f"user_activity {_FINAL}"
            ),
            _count("analytics:spend_limit", "analytics:main:spend_limits", "limits"),
            _count(
                "analytics:spend_limit_request", "analytics:main:spend_limit_requests", "requests"
            ),
        ]
    ),
)
q(
    "collect_buckets",
    "usage cost",
    """SELECT CAST(date_trunc('day', _time) AS TIMESTAMP) AS bucket, 'usage' AS record, product,
              usage.model, CAST(sum(t) AS BIGINT) AS total_tokens, CAST(NULL AS DOUBLE) AS amount_usd
       FROM usage GROUP BY 1, 3, 4
       UNION ALL
       SELECT CAST(date_trunc('day', _time) AS TIMESTAMP), 'cost', product, NULL, NULL,
              round(sum(usd), 4) FROM cost GROUP BY 1, 3""",
)
q(
    "ingest_counts",
    _ALL,
    "SELECT series AS sourcetype, count(*) AS count FROM times GROUP BY 1",
    ("times", _all_times()),
)
# Days of the order tables are folded into one month.
_FOLDED = " UNION ALL ".join(
    f"SELECT {t} AS t, '{VENDOR}:{name}' AS series FROM ({sql}) x"
    for name, sql in _TIMES.items()
    for t in [
        "TIMESTAMP '2024-01-01' + to_days(CAST(day(t) - 1 AS INT))"
        if name in ("analytics:usage", "analytics:cost", "analytics:user_usage", "analytics:user_cost")
        else "CAST(t AS TIMESTAMP)"
    ]
)
_CATEGORY_OF = ", ".join(f"('{r}', '{c}')" for r, c in RECORD_CATEGORY.items())
_RECORDS = ", ".join(f"('{VENDOR}:{kind}', '{record}')" for kind, record in _RECORD_OF.items())
q(
    "store_scan",
    f"act {_ALL}",
    f"""SELECT CAST(t AS DATE) AS event_date, record, c.category AS event_category, count(*) AS count
        FROM times JOIN (VALUES {_RECORDS}) v(series, record) USING (series)
        JOIN (VALUES {_CATEGORY_OF}) c(record, category) USING (record)
        WHERE t >= TIMESTAMP '2024-01-17' AND t < {AS_OF} GROUP BY 1, 2, 3
        UNION ALL
        SELECT CAST(_time AS DATE), 'activity', category, count(*)
        FROM act WHERE _time >= TIMESTAMP '2024-01-17' AND _time < {AS_OF} GROUP BY 1, 2, 3""",
    ("times", _FOLDED),
)
q(
    "upsert_kinds",
    _ALL,
    f"""SELECT record, count(*) AS count
        FROM times JOIN (VALUES {_RECORDS}) v(series, record) USING (series) GROUP BY 1""",
    ("times", _all_times()),
)
_FIRST, _SECOND = "TIMESTAMP '2024-01-20'", AS_OF
_REPORT_DAYS = "_time >= TIMESTAMP '2024-01-10' AND _time < TIMESTAMP '2024-01-28'"
q(
    "cycle_store",
    _ALL,
    f"""SELECT 'activity' AS record, count(*) AS count, {_SECOND} AS collected_at FROM events
        UNION ALL SELECT 'user', count(*), {COLLECTED} FROM users
        UNION ALL SELECT 'organization', count(*), {COLLECTED} FROM region
        UNION ALL SELECT 'group', count(*), {COLLECTED} FROM nation
        UNION ALL SELECT 'chat', count(*), {COLLECTED} FROM conversations
        UNION ALL SELECT 'file', count(*), {COLLECTED} FROM documents
        UNION ALL SELECT 'summary', count(*), {_SECOND} FROM summary WHERE {_REPORT_DAYS}
        UNION ALL SELECT 'user_activity', count(*), {_SECOND} FROM user_activity WHERE {_REPORT_DAYS}
        UNION ALL SELECT 'spend_limit', 2 * count(*), {_SECOND} FROM limits
        UNION ALL SELECT 'spend_limit_request', 2 * count(*), {_SECOND} FROM requests""",
)
q(
    "cycle_state",
    "",
    f"""SELECT 'activity' AS input, arg_max('activity_' || event_id, (ts, 'activity_' || event_id)) AS last_id,
              max(ts) AS last_created_at, CAST(NULL AS VARCHAR) AS last_finalized,
              CAST(NULL AS TIMESTAMP) AS last_sync, CAST(2 AS BIGINT) AS version FROM events
        UNION ALL SELECT input, NULL, NULL, '2024-01-28', NULL, 2
        FROM (VALUES ('summary'), ('usage'), ('cost'), ('user_usage'), ('user_cost'), ('user_activity')) v(input)
        UNION ALL SELECT input, NULL, NULL, NULL, {AS_OF}, 2
        FROM (VALUES ('organization'), ('user'), ('group')) v(input)""",
)
_REFUSED = (
    "refused",
    f"""SELECT {_FIRST} AS ts, '{VENDOR}:compliance:directory:main:groups' AS source,
               'RuntimeError: Rate limited (429), gave up after 5 attempts' AS message FROM nation
        UNION SELECT {_FIRST}, '{VENDOR}:compliance:content:main:chat',
               'ConnectionError: connection refused' FROM conversations""",
)
q("th_03_cycle", "", "SELECT source, count(*) AS count FROM refused GROUP BY 1", _REFUSED)
q("th_04_cycle", "", "SELECT ts AS _time, source, message AS _raw FROM refused", _REFUSED)
q(
    "th_05_cycle",
    "",
    "SELECT ts AS bucket, count(*) AS count FROM refused WHERE message LIKE '%429%' GROUP BY 1",
    _REFUSED,
)
q(
    "bucket_feed",
    "usage cost",
    """SELECT CAST(date_trunc('hour', _time) AS TIMESTAMP) AS _time, 'usage' AS record, product, usage.model,
              CAST(CASE WHEN count(u) + count(r) + count(c) > 0
                   THEN coalesce(sum(u), 0) + coalesce(sum(r), 0) + coalesce(sum(c), 0) END AS BIGINT)
                  AS input_tokens,
              CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(t) AS BIGINT) AS total_tokens,
              CAST(NULL AS DOUBLE) AS amount_usd
       FROM usage GROUP BY 1, 3, 4
       UNION ALL
       SELECT CAST(date_trunc('hour', _time) AS TIMESTAMP), 'cost', product, NULL, NULL, NULL, NULL,
              round(sum(usd), 4) FROM cost GROUP BY 1, 3""",
)
q("replay_events", "act", _ACT_ROWS)
q("stream_feed", "act", _ACT_ROWS)
q(
    "upsert",
    "",
    "SELECT CAST(ts AS DATE) AS event_date, count(*) AS count,"
    " TIMESTAMP '2024-01-31 12:00:00' AS collected_at FROM events GROUP BY 1",
)
q(
    "upsert_reports",
    "usage",
    """SELECT 'usage' AS record, count(*) AS count, CAST(sum(o) AS BIGINT) AS output_tokens
       FROM usage
       UNION ALL SELECT 'cost', count(*), NULL FROM orders""",
)
q(
    "upsert_snapshots",
    "",
    """SELECT t AS collected_at, count(*) AS count FROM customer,
           (VALUES (TIMESTAMP '2024-01-30 12:00:00'), (TIMESTAMP '2024-02-02 12:00:00')) x(t)
       GROUP BY 1""",
)
q("d_limit_store", "limits", _LIMITED.format(run="", by="", src="limits"))
q("run_scope", "", "SELECT count(*) AS count FROM orders")
_KINDS = {
    "user": ("policy", "compliance:directory:main:users", "compliance:user"),
    "organization": ("policy", "compliance:directory:main:organizations", "compliance:organization"),
    "group": ("policy", "compliance:directory:main:groups", "compliance:group"),
    "chat": ("content_access", "compliance:content:main:chat", "compliance:chat_content"),
    "file": ("content_access", "compliance:content:main:file", "compliance:file_metadata"),
    "summary": ("usage", "analytics:main:summary", "analytics:summary"),
    "usage": ("usage", "analytics:main:usage", "analytics:usage"),
    "cost": ("cost", "analytics:main:cost", "analytics:cost"),
    "user_usage": ("usage", "analytics:main:user_usage", "analytics:user_usage"),
    "user_cost": ("cost", "analytics:main:user_cost", "analytics:user_cost"),
    "user_activity": ("usage", "analytics:main:user_activity", "analytics:user_activity"),
    "spend_limit": ("cost", "analytics:main:spend_limits", "analytics:spend_limit"),
    "spend_limit_request": (
        "policy",
        "analytics:main:spend_limit_requests",
        "analytics:spend_limit_request",
    ),
}
q(
    "union_kinds",
    f"act {_ALL}",
    " UNION ALL ".join(
        f"SELECT '{record}' AS record, '{category}' AS event_category,"
        f" '{VENDOR}:{source}' AS source, count(*) AS count, min(t) AS first, max(t) AS last"
        f" FROM times WHERE series = '{VENDOR}:{kind}'"
        for record, (category, source, kind) in _KINDS.items()
    )
    + f" UNION ALL SELECT 'activity', category, '{VENDOR}:compliance:activities:main', count(*),"
    " CAST(min(_time) AS TIMESTAMP), CAST(max(_time) AS TIMESTAMP) FROM act GROUP BY category",
    ("times", _all_times()),
)
q(
    "union_vendors",
    "act",
    f"""SELECT '{VENDOR}' AS vendor, category AS event_category, action, outcome,
              rtype AS resource_type, count(*) AS count FROM act GROUP BY ALL
       UNION ALL
       SELECT 'openai', CASE WHEN event_type GLOB 'sign*' THEN 'authentication'
                             WHEN event_type GLOB 'e?ror' THEN 'admin_change'
                             WHEN event_type GLOB '[!cv]*' THEN 'cost' ELSE 'usage' END,
              CASE event_type WHEN 'signup' THEN 'login' WHEN 'click' THEN 'update'
                              WHEN 'view' THEN 'read' ELSE 'unknown' END,
              CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END, NULL, count(*)
       FROM events GROUP BY ALL""",
)

# --- joins ------------------------------------------------------------------------
q(
    "users_with_org",
    "users",
    """SELECT u.id, u.role AS organization_role,
              coalesce(u.org_uuid, u.fetched_for) AS organization_uuid,
              CASE WHEN r_regionkey <> 4 THEN r_name END AS organization_name
       FROM users u JOIN region ON u.fetched_for = 'uuid-' || r_regionkey""",
)
_TARGETS = (
    "targets",
    """SELECT upper('cust' || c_custkey || '@example.test') AS email, 'cust_' || c_custkey AS uid
       FROM customer""",
)
q(
    "chats_for_users",
    "chats",
    """SELECT t.uid AS user_id, t.email, c.id AS chat_id, c.n AS rank
       FROM targets t JOIN (
           SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS INT)
               AS n FROM chats) c ON c.user_id = t.uid
       WHERE c.n <= 10""",
    _TARGETS,
)
q(
    "unmatched_targets",
    "",
    "SELECT 'ghost' || c_custkey || '@example.test' AS email FROM customer",
)
q(
    "users_without_chats",
    "chats",
    "SELECT t.uid AS user_id, t.email FROM targets t"
    " WHERE t.uid NOT IN (SELECT user_id FROM chats)",
    _TARGETS,
)
q(
    "group_members",
    "groups",
    "SELECT g.id AS group_id, g.name, 'cust_' || c_custkey AS member_id FROM customer"
    " JOIN groups g ON g.id = 'rbac_group_' || c_nationkey",
)
q(
    "members_of",
    "users",
    "SELECT id, full_name, role AS organization_role FROM users WHERE id IN"
    " (SELECT 'cust_' || c_custkey FROM customer WHERE c_nationkey IN (3, 7))",
)

q(
    "users_in_both",
    "limits user_cost",
    "SELECT DISTINCT email FROM limits WHERE email IN (SELECT email FROM user_cost)",
)
q(
    "as_of_role",
    "act roles",
    """SELECT a.event_id, a.actor_id, r.role FROM act a
       ASOF LEFT JOIN roles r ON a.actor_id = r.actor_id AND a._time >= r._time""",
)
q(
    "unknown_actors",
    "act roles",
    """SELECT actor_id, count(*) AS count, min(_time) AS first_time, max(_time) AS last_time FROM act
       WHERE actor_id IS NOT NULL AND actor_id NOT IN (
           SELECT actor_id FROM roles WHERE _time < TIMESTAMP '2024-01-03') GROUP BY 1""",
)
_SESSIONS = (
    "found",
    f"""SELECT user, min(_time) AS first_time, max(_time) AS last_time, count(*) AS count
        FROM (SELECT *, count(*) FILTER (WHERE apart) OVER (PARTITION BY user ORDER BY _time) AS k
              FROM (SELECT email AS user, _time, coalesce(_time - lag(_time) OVER (
                        PARTITION BY email ORDER BY _time) > INTERVAL 12 HOURS, true) AS apart
                    FROM act WHERE {SIGN_IN} AND email IS NOT NULL) s) n
        GROUP BY user, k""",
)
q("sessions", "act", "SELECT * FROM found", _SESSIONS)

# --- operators --------------------------------------------------------------------
q(
    "time_range",
    "act",
    "SELECT CAST(_time AS DATE) AS event_date, count(*) AS count FROM act"
    " WHERE _time >= TIMESTAMP '2024-01-22' AND _time < TIMESTAMP '2024-01-31' GROUP BY 1",
)
chart("timechart_other", "act", "SELECT _time AS t, event_type AS series FROM act", limit=3)
chart(
    "timechart_null", "act", "SELECT _time AS t, rtype AS series FROM act", span="hour", limit=4
)
q(
    "timechart_wide",
    "act",
    """SELECT CAST(date_trunc('day', _time) AS TIMESTAMP) AS bucket,
              count(*) FILTER (WHERE outcome = 'failure') AS failure,
              count(*) FILTER (WHERE outcome = 'success') AS success FROM act GROUP BY 1""",
)
q(
    "dedup_latest",
    "act",
    """SELECT actor_id AS user_id, max(_time) AS _time,
              arg_max(event_id, (_time, event_id)) AS event_id,
              arg_max(event_type, (_time, event_id)) AS event_type
       FROM act WHERE actor_id IS NOT NULL GROUP BY 1""",
)
q(
    "trailing_baseline",
    "cost",
    """SELECT product, day, round(daily, 4) AS daily, round(baseline, 4) AS baseline,
              coalesce(daily > 1.5 * baseline, false) AS spike
       FROM (SELECT *, avg(daily) OVER (PARTITION BY product ORDER BY day
                                        ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS baseline
             FROM (SELECT product, CAST(date_trunc('day', _time) AS TIMESTAMP) AS day,
                          sum(usd) AS daily FROM cost GROUP BY 1, 2) d) b""",
)
q(
    "first_seen",
    "act",
    "SELECT user_agent, ip AS src_ip, min(_time) AS first_seen, count(*) AS count FROM act"
    " WHERE ip IS NOT NULL GROUP BY 1, 2",
)

# --- rollup -----------------------------------------------------------------------
q(
    "rollup_hourly",
    "act",
    f"""SELECT CAST(date_trunc('hour', _time) AS TIMESTAMP) AS hour,
              '{VENDOR}:compliance:activity' AS sourcetype, '{VENDOR}' AS vendor,
              'activity' AS record, category AS event_category, event_type, action, outcome,
              count(*) AS count, CAST(NULL AS BIGINT) AS total_tokens,
              CAST(NULL AS DOUBLE) AS amount_usd, min(_time) AS first_time, max(_time) AS last_time
       FROM act GROUP BY ALL""",
)
q(
    "rollup_counts",
    _ALL,
    "SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS bucket, series AS sourcetype,"
    " count(*) AS count FROM times GROUP BY 1, 2",
    ("times", _FOLDED),
)
q(
    "rollup_newest",
    _ALL,
    "SELECT series AS sourcetype, max(t) AS last FROM times GROUP BY 1",
    ("times", _FOLDED),
)

# --- streams: windows that end by the watermark, an hour behind the newest event -----
_CLOSED = "run_time <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
for _key in ("d_sso", "d_export", "d_apikey", "d_role"):
    q(
        f"stream_{_key}",
        "act",
        f"SELECT run_time, count(*) AS hits FROM ({_hits(_key)}) h WHERE {_CLOSED} GROUP BY 1",
        *_windowed(_key),
    )
q(
    "stream_d_multi_ip",
    "act",
    f"SELECT DISTINCT run_time, user, ip_count FROM ({_hits('d_multi_ip')}) h WHERE {_CLOSED}",
    *_windowed("d_multi_ip"),
)
q(
    "stream_d_chat",
    "act",
    f"SELECT DISTINCT run_time, user, count FROM ({_hits('d_chat')}) h WHERE {_CLOSED}",
    *_windowed("d_chat"),
)
# One more event six hours after the last moves time past the runs before it.
q(
    "stream_d_chat_dense",
    "",
    f"SELECT DISTINCT run_time, user, count FROM ({_hits('d_chat')}) h"
    " WHERE run_time <= (SELECT max(ts) + INTERVAL 5 HOURS FROM dense)",
    *_DENSE,
    *_windowed("d_chat"),
)
_ORDER_DAYS = (
    "runs",
    "SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders) + INTERVAL {0},"
    " (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS run_time",
)
_FINAL_RUN = "run_time <= (SELECT max(o_orderdate) - INTERVAL 3 DAYS FROM orders)"
q(
    "stream_d_spike",
    "cost",
    f"SELECT '{VENDOR}' AS vendor, * FROM ({_SPIKE.format(runs='runs')}) s WHERE {_FINAL_RUN}",
    (_ORDER_DAYS[0], _ORDER_DAYS[1].format("9 HOURS")),
    _SPIKE_STEPS[1],
)
q(
    "stream_d_topcost",
    "user_cost",
    f"SELECT * FROM ({_TOPCOST}) s WHERE {_FINAL_RUN}",
    (_ORDER_DAYS[0], _ORDER_DAYS[1].format("8 HOURS")),
)
q(
    "stream_d_limit",
    "limits",
    _LIMITED.format(run="run_time, ", by="run_time, ", src="win"),
    schedule("2024-01-30 00:45:00", "2024-02-02 11:00:00", "4 HOURS"),
    _LIMIT_STEPS[1],
)
q("stream_d_stopped", "", f"SELECT '{VENDOR}' AS vendor, max(ts) AS last FROM events")
q(
    "stream_sessions",
    "act",
    "SELECT * FROM found WHERE last_time + INTERVAL 12 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    _SESSIONS,
)
q(
    "stream_first_seen",
    "act",
    f"SELECT DISTINCT user_agent, ip AS src_ip FROM act WHERE {READ} AND ip IS NOT NULL",
)
q("stream_dedup", "", "SELECT CAST(ts AS DATE) AS event_date, count(*) AS count FROM events GROUP BY 1")
q(
    "stream_buckets",
    "act",
    """SELECT bucket, count, failures FROM (
           SELECT CAST(date_trunc('day', _time) AS TIMESTAMP) AS bucket, count(*) AS count,
                  count(*) FILTER (WHERE outcome = 'failure') AS failures FROM act GROUP BY 1) b
       WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 DAYS FROM events)""",
)
q(
    "stream_rollup",
    "",
    f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket,
              '{VENDOR}:compliance:activity' AS sourcetype, count(*) AS count
       FROM events GROUP BY 1""",
)
_two = [s for s in _steps if s[0].endswith(("d_newapi", "d_multi_ip"))]
_two.append(("fired", " UNION ALL ".join(f for f in _fired if "d_newapi" in f or "d_multi_ip" in f)))
walk("stream_throttle", "act", "INTERVAL 12 HOURS", "0", *_two)
ORACLE["stream_throttle"] = ORACLE["stream_throttle"].replace(" 0 AS severity,", "")
