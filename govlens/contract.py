"""The versioned event contract: one row shape for every record of every vendor.

``ai`` is a fixed struct, ``raw`` an open VARIANT that keeps each provider field
the contract does not model. Absent values are null; empty strings never occur.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The closed vocabularies of contract version 1.0.0.
SCHEMA_VERSION = "1.0.0"
VENDORS = ("anthropic", "openai", "google")
CATEGORIES = (
    "authentication",
    "admin_change",
    "content_access",
    "usage",
    "cost",
    "policy",
    "data_export",
)
ACTIONS = (
    "login",
    "logout",
    "login_attempt",
    "create",
    "update",
    "delete",
    "read",
    "export",
    "request",
    "unknown",
)
OUTCOMES = ("success", "failure")
RESOURCE_TYPES = (
    "org",
    "project",
    "user",
    "group",
    "identity",
    "api_key",
    "chat",
    "file",
    "memory",
    "integration",
    "other",
)

ACTIVITY = "activity"

# The category of every record kind that rules do not classify.
RECORD_CATEGORY = {
    "user": "policy",
    "organization": "policy",
    "group": "policy",
    "chat": "content_access",
    "file": "content_access",
    "summary": "usage",
    "usage": "usage",
    "user_usage": "usage",
    "user_activity": "usage",
    "cost": "cost",
    "user_cost": "cost",
    "spend_limit": "cost",
    "spend_limit_request": "policy",
}
RECORDS = (ACTIVITY, *RECORD_CATEGORY)

REQUIRED = ("time", "schema_version", "vendor", "product", "record", "event_category")
REQUIRED_ACTIVITY = ("event_type", "event_id", "action", "outcome")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

AI_TYPE = _struct(
    time=_TS,
    schema_version=_S,
    vendor=_S,
    product=_S,
    record=_S,
    event_category=_S,
    event_type=_S,
    event_id=_S,
    action=_S,
    outcome=_S,
    model=_S,
    actor=_struct(email=_S, id=_S, type=_S, ip=_S, user_agent=_S, role=_S),
    org=_struct(id=_S, uuid=_S),
    resource=_struct(type=_S, id=_S),
    usage=_struct(input_tokens=_L, output_tokens=_L, total_tokens=_L),
    cost=_struct(
        amount_usd=_D,
        currency=_S,
        limit_usd=_D,
        spend_usd=_D,
        utilization_pct=_D,
        requested_limit_usd=_D,
    ),
    adoption=_struct(
        daily_active_users=_L,
        weekly_active_users=_L,
        monthly_active_users=_L,
        seats=_L,
        pending_invites=_L,
        daily_rate=_D,
        weekly_rate=_D,
        monthly_rate=_D,
    ),
)

EVENT_TYPE = T.StructType(
    [
        T.StructField("ai", AI_TYPE),
        T.StructField("raw", T.VariantType()),
        T.StructField("_time", _TS),
        T.StructField("sourcetype", _S),
        T.StructField("source", _S),
        T.StructField("collected_at", _TS),
        T.StructField("event_date", T.DateType()),
    ]
)


def leaves(dtype: T.StructType = AI_TYPE, prefix: str = "ai") -> list[tuple[str, T.DataType]]:
    """Dotted path and type of every scalar of the contract, in order."""
    found: list[tuple[str, T.DataType]] = []
    for field in dtype.fields:
        path = f"{prefix}.{field.name}"
        if isinstance(field.dataType, T.StructType):
            found += leaves(field.dataType, path)
        else:
            found.append((path, field.dataType))
    return found
