"""SQL functions for analysts, as temporary functions of the session: no Python
runs per row, Catalyst inlines their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

from govlens import providers
from govlens.functions import values as V
from govlens.functions.rules import VOCABULARY, classify_sql, quote
from govlens.providers import Provider


def _glob(value: str, pattern: str) -> str:
    """Whether text matches a glob from a column: ``*``, ``?``, ``[set]`` and ``[!set]``.

    The glob is cut into its tokens, each of which becomes its regular expression; a
    bracket that is never closed stands for itself.
    """
    token = V.quote(r"\[!?\]?[^\]]*\]|[\s\S]")
    body = "substring(t, 2, length(t) - 2)"
    safe = f"regexp_replace({{}}, {V.quote(r'([\\\[&^])')}, {V.quote(r'\\$1')})"
    negated = safe.format(f"substring({body}, 2)")
    plain = safe.format(body)
    regex = (
        f"array_join(transform(regexp_extract_all({pattern}, {token}, 0), t -> CASE"
        " WHEN t = '*' THEN '[\\\\s\\\\S]*' WHEN t = '?' THEN '[\\\\s\\\\S]'"
        f" WHEN length(t) > 3 AND t LIKE '[!%' THEN concat('[^', {negated}, ']')"
        f" WHEN length(t) > 2 AND t LIKE '[%' THEN concat('[', {plain}, ']')"
        f" ELSE regexp_replace(t, {V.quote(r'([^A-Za-z0-9_\s])')}, {V.quote(r'\\$1')}) END), '')"
    )
    return f"rlike({value}, concat('^(?:', {regex}, ')\\\\z'))"


def register(spark: SparkSession, provider: Provider = providers.DEFAULT) -> None:
    """``ai_classify(event_type, kind)``, ``cents_to_usd(text)``, ``event_time(text)``
    and ``glob_match(text, pattern)``."""
    kinds = " ".join(
        f"WHEN {quote(kind)} THEN {classify_sql('event_type', provider.rules, kind)}"
        for kind in VOCABULARY
    )
    bodies = {
        "ai_classify(event_type STRING, kind STRING) RETURNS STRING": f"CASE kind {kinds} END",
        "cents_to_usd(cents STRING) RETURNS DOUBLE": V.cents_to_usd("cents"),
        "event_time(value STRING) RETURNS TIMESTAMP": V.event_time("value"),
        "glob_match(value STRING, pattern STRING) RETURNS BOOLEAN": _glob("value", "pattern"),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
