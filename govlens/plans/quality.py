"""Contract checks over whole event tables: violations, coverage, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens import contract
from govlens.functions import values as V
from govlens.functions.rules import VOCABULARY, RuleBook
from govlens.functions.values import quote
from govlens.plans.normalize import as_stored


def _in(column: str, allowed) -> str:
    return f"{column} IN ({', '.join(quote(v) for v in allowed)})"


# A null or the text "null" as a value at any depth of raw. Other strings are
# taken out first, so that their content cannot look like structure.
_TEXT = quote(r'("null")|"(?:[^"\\]++|\\.)*+"')
_NULL_VALUE = quote(r'[:,\[](null|"null")[,}\]]')
_NULL_IN_RAW = (  # the lambda binds the text, which is made once
    "exists(array(to_json(raw)), t -> contains(t, 'null')"
    f" AND rlike(regexp_replace(t, {_TEXT}, '$1'), {_NULL_VALUE}))"
)


def _checks() -> list[tuple[str, str, str]]:
    """(rule, path, SQL that holds for a violation)."""
    found = []
    for name in contract.REQUIRED:
        empty = f"ai.{name} IS NULL"
        if name != "time":
            empty += f" OR ai.{name} = ''"
        found.append(("required", f"ai.{name}", empty))
    is_activity = f"ai.record = {quote(contract.ACTIVITY)}"
    for name in contract.REQUIRED_ACTIVITY:
        found.append(
            ("required_activity", f"ai.{name}", f"{is_activity} AND coalesce(ai.{name}, '') = ''")
        )
    closed = {
        "schema_version": (contract.SCHEMA_VERSION,),
        "vendor": contract.VENDORS,
        "record": contract.RECORDS,
        "event_category": contract.CATEGORIES,
        "action": contract.ACTIONS,
        "outcome": contract.OUTCOMES,
        "resource.type": contract.RESOURCE_TYPES,
    }
    for name, allowed in closed.items():
        found.append(("vocabulary", f"ai.{name}", f"NOT ({_in(f'ai.{name}', allowed)})"))
    pairs = ", ".join(f"{quote(r)}, {quote(c)}" for r, c in contract.RECORD_CATEGORY.items())
    fixed = f"element_at(map({pairs}), ai.record)"
    found.append(
        ("record_category", "ai.event_category", f"ai.event_category <> {fixed}")
    )
    for path, dtype in contract.leaves():
        if isinstance(dtype, T.StringType):
            found.append(("null_text", path, f"{path} IN ('', 'null')"))
        elif path.endswith(("_usd", "_pct")):
            found.append(("not_a_number", path, f"isnan({path})"))
    found.append(("null_text", "raw", _NULL_IN_RAW))
    return found


def violations(events: DataFrame) -> DataFrame:
    """One row per event and broken rule; a conformant table gives none.

    One pass, no shuffle: the checks form an array per event of which only the
    broken ones are kept.
    """
    checks = ", ".join(
        f"CASE WHEN {test} THEN named_struct('rule', {quote(rule)}, 'path', {quote(path)}) END"
        for rule, path, test in _checks()
    )
    return as_stored(events).select(
        "ai.record",
        "ai.event_id",
        F.col("ai.actor.id").alias("actor_id"),
        F.col("ai.time").alias("time"),
        F.expr(f"explode(array_compact(array({checks})))").alias("_v"),
    ).select("record", "event_id", "actor_id", "time", "_v.rule", "_v.path")


def violation_counts(events: DataFrame) -> DataFrame:
    return violations(events).groupBy("record", "rule", "path").agg(F.count("*").alias("count"))


def coverage(events: DataFrame) -> DataFrame:
    """Share of events that have each contract field, per record: (record, path, pct)."""
    fields = contract.leaves()
    counts = [F.count(path).alias(f"c{i}") for i, (path, _) in enumerate(fields)]
    per_record = events.groupBy("ai.record").agg(F.count("*").alias("n"), *counts)
    pairs = ", ".join(
        f"named_struct('path', {quote(path)}, 'present', c{i})" for i, (path, _) in enumerate(fields)
    )
    return per_record.select("record", "n", F.expr(f"explode(array({pairs}))").alias("_f")).select(
        "record",
        "_f.path",
        F.col("_f.present").alias("present"),
        F.expr("round(100 * _f.present / n, 2)").alias("pct"),
    )


def rule_problems(spark: SparkSession, rules: RuleBook, vendor: str) -> DataFrame:
    """Rules whose value lies outside its vocabulary, or that are another vendor's."""
    return rule_table_problems(rules.table(spark), rules.vendor, vendor)


def rule_table_problems(rules: DataFrame, rules_vendor: str, vendor: str) -> DataFrame:
    """The same for rules in a table ``(kind, pattern, value)`` of any length."""
    spark = rules.sparkSession
    allowed = spark.createDataFrame(
        [(kind, value) for kind, values in VOCABULARY.items() for value in values],
        "kind string, value string",
    )
    outside = rules.join(allowed, ["kind", "value"], "left_anti").select("kind", "pattern", "value")
    wrong = spark.createDataFrame(
        [("vendor", vendor, rules_vendor)] if rules_vendor != vendor else [],
        "kind string, pattern string, value string",
    )
    return outside.unionByName(wrong)


def category_map_gaps(spark: SparkSession) -> DataFrame:
    """Records without a fixed category, and categories fixed for no record."""
    records = spark.createDataFrame([(r,) for r in contract.RECORDS], "record string")
    mapped = spark.createDataFrame(
        list(contract.RECORD_CATEGORY.items()), "record string, category string"
    )
    missing = records.where(F.col("record") != contract.ACTIVITY).join(
        mapped, "record", "left_anti"
    )
    extra = mapped.join(records, "record", "left_anti").select("record")
    return missing.withColumn("side", F.lit("unmapped")).unionByName(
        extra.withColumn("side", F.lit("unknown"))
    )


def canonical(events: DataFrame) -> DataFrame:
    """Events as JSON text, members in contract order, absent members left out."""
    ai = f"to_json({V.clean('ai', contract.AI_TYPE)}, {_TIME})"
    return as_stored(events).selectExpr(f"{ai} AS ai", "to_json(raw) AS raw")


_TIME = "map('timestampFormat', \"yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'\")"


def golden_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Events that one side has more often than the other: (ai, raw, side, copies).

    Both differences in one pass and one shuffle.
    """
    both = canonical(actual).withColumn("n", F.lit(1)).unionByName(
        canonical(expected).withColumn("n", F.lit(-1))
    )
    surplus = both.groupBy("ai", "raw").agg(F.sum("n").alias("n")).where("n <> 0")
    return surplus.selectExpr(
        "ai", "raw", "IF(n > 0, 'actual', 'expected') AS side", "abs(n) AS copies"
    )
