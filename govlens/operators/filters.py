"""Base filters: record, vendor, equality, globs and relative time ranges."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.functions import rules

_UNIT = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
_MODIFIER = re.compile(r"^(?:now|([+-]\d+)([smhdw]))?(?:@([smhd]))?$")


def moment(modifier: str | datetime | None, as_of: datetime) -> datetime | None:
    """``-24h``, ``-14d@d``, ``@d`` or ``now``, relative to ``as_of`` (naive UTC)."""
    if modifier is None or isinstance(modifier, datetime):
        return modifier
    match = _MODIFIER.match(modifier)
    if not match or not modifier:
        raise ValueError(f"not a time modifier: {modifier!r}")
    amount, unit, snap = match.groups()
    at = as_of
    if amount:
        at += timedelta(**{_UNIT[unit]: int(amount)})
    if snap:
        at = at.replace(microsecond=0)
        if snap in "mhd":
            at = at.replace(second=0)
        if snap in "hd":
            at = at.replace(minute=0)
        if snap == "d":
            at = at.replace(hour=0)
    return at


def at(when: datetime) -> Column:
    """A moment in UTC as a literal, whatever the time zone of the driver's machine."""
    return F.expr(f"TIMESTAMP '{when.isoformat(sep=' ')}'")


def on(when: datetime) -> Column:
    """Its day."""
    return F.expr(f"DATE '{when.date().isoformat()}'")


def time_range(
    df: DataFrame,
    as_of: datetime,
    earliest: str | datetime | None = None,
    latest: str | datetime | None = None,
    column: str = "_time",
) -> DataFrame:
    """Rows with ``earliest <= time < latest``.

    The event store is partitioned by day, so a predicate on the day goes along
    and whole partitions are skipped.
    """
    start, end = moment(earliest, as_of), moment(latest, as_of)
    days = column == "_time" and "event_date" in df.columns
    if start is not None:
        df = df.where(F.col(column) >= at(start))
        if days:
            df = df.where(F.col("event_date") >= on(start))
    if end is not None:
        df = df.where(F.col(column) < at(end))
        if days:
            df = df.where(F.col("event_date") <= on(end))
    return df


def base(
    events: DataFrame,
    record: str | None = None,
    provider: str | None = None,
    as_of: datetime | None = None,
    earliest: str | datetime | None = None,
    latest: str | datetime | None = None,
    **equal: str,
) -> DataFrame:
    """The first step of each query: one record kind, one vendor or any, a range.

    Further keywords compare contract fields, ``__`` standing for a dot:
    ``base(ev, "activity", resource__type="project")``.
    """
    vendor = F.col("ai.vendor")
    df = events.where(vendor.isNotNull() if provider in (None, "*") else vendor == provider)
    if record is not None:
        df = df.where(F.col("ai.record") == record)
    for name, value in equal.items():
        df = df.where(F.col("ai." + name.replace("__", ".")) == value)
    if earliest is not None or latest is not None:
        if as_of is None:
            raise ValueError("a relative range needs as_of")
        df = time_range(df, as_of, earliest, latest)
    return df


def like(column: str, *patterns: str) -> Column:
    """Case-insensitive glob search; several patterns are alternatives."""
    tests = [rules.glob_test(f"lower({column})", pattern.lower()) for pattern in patterns]
    return F.expr(" OR ".join(tests))


def raw(events: DataFrame, path: str, dtype: str = "string") -> Column:
    """A provider field the contract does not model; null where there is none."""
    found: T.DataType = events.schema["raw"].dataType
    if isinstance(found, T.VariantType):
        return F.try_variant_get(F.col("raw"), f"$.{path}", dtype)
    for part in path.split("."):
        if not isinstance(found, T.StructType) or part not in found.fieldNames():
            return F.lit(None).cast(dtype)
        found = found[part].dataType
    return F.col(f"raw.{path}").cast(dtype)
