"""Conversions from provider values to contract values, as SQL expressions.

The builders take and give SQL text: a whole record becomes one expression that
is parsed once, where a chain of Column objects costs a driver call per node.
"""

from __future__ import annotations

from pyspark.sql import types as T


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(path: str) -> str:
    """A dotted path as quoted SQL names."""
    return ".".join(f"`{part}`" for part in path.split("."))


_NUMBER = quote(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
_DATE = quote(r"^\s*\d{4}-\d{2}-\d{2}")


def text(sql: str) -> str:
    """Empty text counts as absent."""
    return f"nullif({sql}, '')"


def first_text(*options: str) -> str:
    return f"coalesce({', '.join(text(o) for o in options)})"


def event_time(sql: str, dtype: T.DataType | None = None) -> str:
    """A provider timestamp in UTC; a date means midnight, offsets are honoured,
    anything unreadable is null. The session time zone must be UTC."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return f"CAST({sql} AS TIMESTAMP)"
    return f"CASE WHEN rlike({sql}, {_DATE}) THEN try_cast(trim({sql}) AS TIMESTAMP) END"


def number(sql: str) -> str:
    """A double from text that is a plain decimal number, else null."""
    return f"CASE WHEN rlike({sql}, {_NUMBER}) THEN try_cast(trim({sql}) AS DOUBLE) END"


def cents_to_usd(sql: str) -> str:
    """Decimal cents as text to dollars; unreadable text is null."""
    return f"({number(sql)}) / 100"


def clean(sql: str, dtype: T.DataType, depth: int = 0) -> str:
    """Drop empty text, nulls and objects left without members, bottom-up.

    Lists lose only their null elements: empty text and empty objects inside a
    list stay, and so do empty lists.
    """
    if isinstance(dtype, T.StringType):
        return text(sql)
    if isinstance(dtype, T.StructType):
        members = [(f.name, clean(f"{sql}.`{f.name}`", f.dataType, depth)) for f in dtype.fields]
        present = " OR ".join(f"({member}) IS NOT NULL" for _, member in members)
        return f"CASE WHEN {present or 'false'} THEN {struct(members)} END"
    if isinstance(dtype, T.ArrayType):
        kept, element = f"filter({sql}, e -> e IS NOT NULL)", dtype.elementType
        if isinstance(element, T.StructType):
            item = f"i{depth}"
            members = [
                (f.name, clean(f"{item}.`{f.name}`", f.dataType, depth + 1)) for f in element.fields
            ]
            return f"transform({kept}, {item} -> {struct(members)})"
        if isinstance(element, T.ArrayType):
            item = f"i{depth}"
            return f"transform({kept}, {item} -> {clean(item, element, depth + 1)})"
        return kept
    if isinstance(dtype, T.MapType):
        return f"map_filter({sql}, (k, e) -> e IS NOT NULL)"
    return sql


def struct(members: list[tuple[str, str]]) -> str:
    return f"named_struct({', '.join(f'{quote(n)}, {m}' for n, m in members)})"


# Cleaning open JSON, where no schema is declared, works on the compact text that
# to_json gives a VARIANT. Strings are consumed whole, so that the rest of the
# pattern can only meet real structure. An emptied object takes its parents along, in
# one pass for LEVELS levels; deeper records get as many passes as they can need.
LEVELS = 32
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_EMPTY = r'(?:null|""|\{\})'
for _ in range(LEVELS):
    _EMPTY = r'(?:null|""|\{(?:' + _STRING + ":" + _EMPTY + r",?)*+\})"
_MEMBER = _STRING + ":" + _EMPTY
_DROP = quote(
    "|".join(
        [
            r"(?<=\{)(?:" + _MEMBER + r",)*+" + _MEMBER + r"(?=\})",
            r"(?<=\{)(?:" + _MEMBER + r",)++",
            "," + _MEMBER + r"(?=[,}])",
            r"(?<=\[)(?:null,)*+null(?=\])",
            r"(?<=\[)(?:null,)++",
            r",null(?=[,\]])",
            "(" + _STRING + ")",
        ]
    )
)
_SUSPECT = quote(r'null|:""|\{\}')


def clean_json(sql: str) -> str:
    """``clean`` for compact JSON text without a declared schema."""
    depth = f"(length({sql}) - length(replace({sql}, '{{', '')))"
    passes = f"sequence(1, CAST(greatest(1, ceil({depth} / {LEVELS})) AS INT))"
    cleaned = f"aggregate({passes}, {sql}, (text, n) -> regexp_replace(text, {_DROP}, '$1'))"
    return f"CASE WHEN rlike({sql}, {_SUSPECT}) THEN {cleaned} ELSE {sql} END"
