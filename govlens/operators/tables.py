"""Projections, ordering, top-k, newest row per key, time formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(
    df: DataFrame,
    columns: dict[str, str | Column],
    order: Sequence[Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Named columns, sorted by source columns, cut only where a top-k is asked for.

    End the order with an id: the sort is distributed by ranges of its keys, and
    rows that share a time then still spread over tasks.
    """
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)
    return df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    )


def top(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in a total order; each task keeps only ``n``."""
    return df.orderBy(*order).limit(n)


def dedup_latest(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("_time",)
) -> DataFrame:
    """The newest row of each key; rows with a null in the key do not take part.

    An aggregate, not a window: copies of one key are reduced where they are
    read, so a key with a third of all rows never has to be sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(newest.alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def ctime(column: str | Column) -> Column:
    return F.date_format(column, "MM/dd/yyyy HH:mm:ss")


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
