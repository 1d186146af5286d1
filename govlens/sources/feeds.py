"""The 14 provider feeds: names, declared columns, batch and stream readers.

A feed frame either has one VARIANT column ``record`` (JSON as it was landed,
unknown keys included) or typed columns. ``Fields`` reads both alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.functions.values import name

RECORD = "record"


@dataclass(frozen=True)
class Feed:
    """One provider feed; ``kind`` is the contract's record name."""

    kind: str
    folder: str  # landing folder and end of the sourcetype
    area: str
    source: str  # lineage, completed with vendor and account
    columns: dict[str, str]  # declared scalar columns by dotted path
    page_key: str = "data"

    def sourcetype(self, vendor: str) -> str:
        return f"{vendor}:{self.area}:{self.folder.removeprefix(self.area + '_')}"

    def lineage(self, vendor: str, account: str) -> str:
        return self.source.format(vendor=vendor, account=account)


_ACTOR = {"email": "string", "user_id": "string", "actor.email": "string",
          "actor.email_address": "string", "actor.user_id": "string"}
_TOKENS = {"output_tokens": "bigint", "uncached_input_tokens": "number",
           "cache_read_input_tokens": "number", "cache_creation_input_tokens": "number"}
_COST = {"amount": "string", "total_cost_usd": "string", "currency": "string"}
_COMPLIANCE = "{vendor}:compliance:"
_ANALYTICS = "{vendor}:analytics:{account}:"

# Wire names of the feeds and of the columns the contract uses.
FEEDS = {
    feed.kind: feed
    for feed in (
        Feed("activity", "compliance_activity", "compliance",
             _COMPLIANCE + "activities:{account}",
             {"id": "string", "created_at": "string", "type": "string", "event": "string",
              "actor.type": "string", "actor.user_id": "string",
              "actor.email_address": "string", "actor.email": "string",
              "actor.ip_address": "string", "actor.user_agent": "string",
              "organization_id": "string", "organization_uuid": "string",
              "claude_project_id": "string", "claude_chat_id": "string",
              "file_id": "string"}),
        Feed("user", "compliance_user", "compliance",
             _COMPLIANCE + "directory:{account}:users",
             {"id": "string", "email": "string", "organization_role": "string",
              "organization_uuid": "string"}),
        Feed("organization", "compliance_organization", "compliance",
             _COMPLIANCE + "directory:{account}:organizations",
             {"uuid": "string"}),
        Feed("group", "compliance_group", "compliance",
             _COMPLIANCE + "directory:{account}:groups",
             {"id": "string", "organization_uuid": "string"}),
        Feed("chat", "compliance_chat_content", "compliance",
             _COMPLIANCE + "content:{account}:chat",
             {"id": "string", "organization_uuid": "string"}),
        Feed("file", "compliance_file_metadata", "compliance",
             _COMPLIANCE + "content:{account}:file",
             {"id": "string", "organization_uuid": "string"}),
        Feed("summary", "analytics_summary", "analytics", _ANALYTICS + "summary",
             {"starting_at": "string", "date": "string", **_ACTOR,
              "daily_active_user_count": "bigint", "weekly_active_user_count": "bigint",
              "monthly_active_user_count": "bigint", "seat_count": "bigint",
              "pending_invite_count": "bigint", "daily_adoption_rate": "double",
              "weekly_adoption_rate": "double", "monthly_adoption_rate": "double"},
             page_key="summaries"),
        Feed("usage", "analytics_usage", "analytics", _ANALYTICS + "usage",
             {"starting_at": "string", "date": "string", **_ACTOR, **_TOKENS, "model": "string"}),
        Feed("cost", "analytics_cost", "analytics", _ANALYTICS + "cost",
             {"starting_at": "string", "date": "string", **_ACTOR, **_COST}),
        Feed("user_usage", "analytics_user_usage", "analytics", _ANALYTICS + "user_usage",
             {"starting_at": "string", "date": "string", **_ACTOR, **_TOKENS}),
        Feed("user_cost", "analytics_user_cost", "analytics", _ANALYTICS + "user_cost",
             {"starting_at": "string", "date": "string", **_ACTOR, **_COST}),
        Feed("user_activity", "analytics_user_activity", "analytics",
             _ANALYTICS + "user_activity",
             {"starting_at": "string", "date": "string", **_ACTOR}),
        Feed("spend_limit", "analytics_spend_limit", "analytics", _ANALYTICS + "spend_limits",
             {"created_at": "string", "updated_at": "string", **_ACTOR,
              "amount": "string", "period_to_date_spend": "string"}),
        Feed("spend_limit_request", "analytics_spend_limit_request", "analytics",
             _ANALYTICS + "spend_limit_requests",
             {"created_at": "string", "updated_at": "string", **_ACTOR,
              "spend_summary.amount": "string",
              "spend_summary.period_to_date_spend": "string"}),
    )
}


class Fields:
    """Columns of one feed frame by dotted path, typed or out of the VARIANT."""

    def __init__(self, df: DataFrame, kind: str, own: Iterable[str] = ()):
        """``own``: text columns that a provider names itself."""
        self.df = df
        self.declared = {**FEEDS[kind].columns, **dict.fromkeys(own, "string")}
        self.open = RECORD in df.columns and isinstance(df.schema[RECORD].dataType, T.VariantType)

    def dtype(self, path: str) -> T.DataType | None:
        """Type of a typed column; None when absent or inside the VARIANT."""
        found: T.DataType = self.df.schema
        if self.open:
            return None
        for part in path.split("."):
            if not isinstance(found, T.StructType) or part not in found.fieldNames():
                return None
            found = found[part].dataType
        return found

    def __getitem__(self, path: str) -> str:
        """SQL for one declared column; null where the frame does not have it."""
        declared = self.declared[path]
        sql_type = "bigint" if declared == "number" else declared
        if self.open:
            value = f"try_variant_get({RECORD}, '$.{path}', '{sql_type}')"
            if declared != "number":
                return value
            # Token counters count only when they are numbers, not text.
            item = f"schema_of_variant(try_variant_get({RECORD}, '$.{path}', 'variant'))"
            return f"(CASE WHEN {item} NOT IN ('STRING', 'VOID') THEN {value} END)"
        dtype = self.dtype(path)
        if dtype is None or (declared == "number" and not isinstance(dtype, T.NumericType)):
            return f"CAST(NULL AS {sql_type})"
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return name(path)
        same = dtype.simpleString() == sql_type
        return name(path) if same else f"CAST({name(path)} AS {sql_type})"


def read_feed(
    spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Landed JSON lines of one feed, one record per line.

    Without a schema each record stays whole as VARIANT; a declared schema gives
    typed columns and drops undeclared keys.
    """
    del kind  # every feed is landed the same way
    if schema is None:
        return spark.read.option("singleVariantColumn", RECORD).json(path)
    return spark.read.schema(schema).json(path)


def stream_feed(
    spark: SparkSession,
    path: str,
    kind: str,
    max_files: int | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """The same as a stream: each new file in the folder is read once."""
    del kind
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if schema is not None:
        return reader.schema(schema).json(path)
    lines = reader.text(path).where(F.trim("value") != "")
    return from_lines(lines)


def from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """A feed frame from a column of JSON text; unreadable lines are left out.

    They drop out of the explode, so that each line is parsed once: a filter on the
    record would be moved down and parse it a second time.
    """
    rest = [c for c in lines.columns if c != column]
    parsed = f"explode(array_compact(array(try_parse_json({name(column)}))))"
    return lines.select(*rest, F.expr(parsed).alias(RECORD))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Replay already normalized events from JSON lines ``{"ai":…, "raw":…}``."""
    from govlens import contract

    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", T.StructType([T.StructField("ai", contract.AI_TYPE)]))["ai"].alias(
            "ai"
        ),
        F.try_variant_get(F.try_parse_json("value"), "$.raw", "variant").alias("raw"),
    )
    return parsed.withColumn("_time", F.col("ai.time")).withColumn(
        "event_date", F.to_date("ai.time")
    )


def explode_pages(df: DataFrame, data_key: str = "data") -> DataFrame:
    """Records out of landed page documents ``{data_key: [...], …}``.

    A page whose list is missing or is no list gives nothing. Each list is
    exploded where its page was read; no page crosses a task.
    """
    items = F.try_variant_get(F.col(RECORD), f"$.{data_key}", "array<variant>")
    rest = [c for c in df.columns if c != RECORD]
    return df.select(*rest, F.explode(items).alias(RECORD))
