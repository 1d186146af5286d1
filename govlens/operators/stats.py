"""Grouped statistics, value lists, time charts, baselines.

Every grouped result combines on the map side before it shuffles, so a key that
holds a third of the rows costs each task one partial row per key it meets.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govlens.operators.filters import at

Aggs = dict[str, Column | str]  # output name -> aggregate, as column or SQL


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) if keys else df


def _aggregates(aggs: Aggs) -> list[Column]:
    return [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in aggs.items()]


def stats(
    df: DataFrame, aggs: Aggs, by: Sequence[str] = (), having: Column | None = None
) -> DataFrame:
    """Aggregates by key; rows with a null key do not take part.

    Without keys the result is one row, also on empty input.
    """
    columns = _aggregates(aggs)
    if not by:
        out = df.agg(*columns)
    else:
        out = _present(df, by).groupBy(*by).agg(*columns)
    return out if having is None else out.where(having)


def latest(column: str, time: str = "_time", *ties: str) -> Column:
    """The value with the newest time among rows where there is a value."""
    order = F.struct(F.col(time), *[F.col(t) for t in ties], F.col(column))
    return F.max_by(F.when(F.col(column).isNotNull(), F.col(column)),
                    F.when(F.col(column).isNotNull(), order))


def with_values(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    values: str,
    *,
    count: str | None = None,
    distinct: str | None = None,
    first: str | None = None,
    last: str | None = None,
    having: Column | None = None,
    top: tuple[Sequence[Column], int] | None = None,
    time: str = "_time",
) -> DataFrame:
    """Statistics by key next to the distinct values of a column, one row per value.

    A key's totals repeat on its rows; a key without values has one row with null. No list
    is built and no group is gathered in one place, so a key with millions of values is a
    result like any other: rows first shrink to one per (key, value), which spreads a hot
    key over its values, and totals, the filter and the top-k work on those. Totals and
    list read all columns of those rows, so that both come out of one shuffle.
    """
    measures = [F.count("*").alias("_n")]
    if first or last:
        measures += [F.min(time).alias("_first"), F.max(time).alias("_last")]
    pairs = _present(df, by).groupBy(*by, value).agg(*measures)

    there = "_n > 0 AND _first <= _last" if first or last else "_n > 0"  # always, but not to Spark
    known = F.expr(f"CASE WHEN {there} THEN `{value}` END")
    totals = [F.count(known).alias(distinct or "_distinct")]
    if count:
        totals.append(F.sum("_n").alias(count))
    if first:
        totals.append(F.min("_first").alias(first))
    if last:
        totals.append(F.max("_last").alias(last))
    groups = pairs.groupBy(*by).agg(*totals)
    if having is not None:
        groups = groups.where(having)
    if top is not None:
        groups = groups.orderBy(*top[0]).limit(top[1])

    # Shuffled by key unless the groups are measured small; where it shuffles,
    # adaptive execution splits a hot key's pairs and repeats its one group row.
    found = pairs.select(*by, known.alias(values)).where(F.col(values).isNotNull())
    out = groups.join(found, list(by), "left")
    return out if distinct else out.drop("_distinct")


_SPAN = {"1 day": "day", "1 hour": "hour"}


def bucket(time: str = "_time", span: str = "1 day") -> Column:
    """Start of the calendar bucket."""
    if span in _SPAN:
        return F.date_trunc(_SPAN[span], F.col(time))
    return F.window(F.col(time), span)["start"]


BLOCK = 4096  # buckets of an axis that one row makes in one task


def timechart(
    df: DataFrame,
    aggs: Aggs,
    by: str | None = None,
    span: str = "1 day",
    limit: int = 10,
    start: datetime | None = None,
    end: datetime | None = None,
    pivot: bool = False,
    zero: Sequence[str] = (),
) -> DataFrame:
    """Aggregates per time bucket, gaps filled.

    The chart goes from the bucket of ``start`` to the last one that begins before ``end``,
    whether there are rows or not; what lies outside does not count. An end that is not
    given is that of the rows.
    With ``by`` there is one additive measure (count or sum) and the result is
    long: (bucket, series, value). The ``limit`` greatest series keep their name,
    the others add up to OTHER, rows without a series are NULL, and empty cells
    are 0. Without ``by`` the result has one column per aggregate; an empty bucket
    shows 0 in the columns of ``zero`` (counts) and null otherwise.
    """
    rows = df.where(F.col("_time").isNotNull())
    if start is not None:
        rows = rows.where(F.col("_time") >= at(start))
    if end is not None:
        rows = rows.where(F.col("_time") < at(end))
    rows = rows.withColumn("bucket", bucket(span=span))
    if by is None:
        grouped = rows.groupBy("bucket").agg(*_aggregates(aggs))
        filled = _span_of(grouped, span, start, end).join(grouped, "bucket", "left")
        return filled.fillna(0, list(zero)) if zero else filled

    (name,) = aggs
    (measure,) = _aggregates(aggs)
    rows = rows.withColumn("series", F.coalesce(F.col(by), F.lit("NULL")))
    cells = rows.groupBy("bucket", "series").agg(measure)
    kept = (
        cells.where(F.col("series") != "NULL")
        .groupBy("series")
        .agg(F.sum(name).alias("_total"))
        .orderBy(F.desc("_total"), "series")
        .limit(limit)
        .select("series", F.lit(True).alias("_kept"))
    )
    # At most `limit` rows, so this side always fits a broadcast.
    named = (
        cells.join(F.broadcast(kept), "series", "left")
        .withColumn(
            "series",
            F.when(F.col("_kept") | (F.col("series") == "NULL"), F.col("series")).otherwise(
                F.lit("OTHER")
            ),
        )
        .groupBy("bucket", "series")
        .agg(F.sum(name).alias(name))
    )
    grid = _span_of(named, span, start, end, "series")
    out = grid.join(named, ["bucket", "series"], "left").fillna(0, [name])
    return out.groupBy("bucket").pivot("series").agg(F.first(name)) if pivot else out


def _span_of(
    cells: DataFrame,
    span: str,
    start: datetime | None,
    end: datetime | None,
    series: str | None = None,
) -> DataFrame:
    """Every bucket from first to last, with every series name if there are any.

    One row holds both ends and the few series names. It becomes a row per ``BLOCK`` of
    buckets, these are dealt out, and each becomes its buckets: however far apart the ends
    lie, no task makes the axis alone.
    """
    ends = [F.min("bucket").alias("_a"), F.max("bucket").alias("_b")]
    if series:
        ends.append(F.collect_set(series).alias("_series"))
    line = cells.agg(*ends)
    line = line.withColumns(
        {"_start": at(start) if start else F.col("_a"), "_end": F.col("_b")}
        | ({"_end": at(end - timedelta(microseconds=1))} if end else {})
    )
    line = line.withColumns({"_start": bucket("_start", span), "_end": bucket("_end", span)})
    line = line.where("_start IS NOT NULL AND _end IS NOT NULL")
    names = ["_series"] if series else []
    step = f"INTERVAL {span}"
    blocks = line.selectExpr(
        f"explode(sequence(_start, _end, {step} * {BLOCK})) AS _block", "_end", *names
    ).repartition("_block")
    until = f"least(_end, _block + {step} * {BLOCK - 1})"
    grid = blocks.selectExpr(f"explode(sequence(_block, {until}, {step})) AS bucket", *names)
    return grid.select("bucket", F.explode("_series").alias(series)) if series else grid


def baseline_spike(
    df: DataFrame,
    value: str,
    n: int = 7,
    factor: float = 1.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Newest day against the mean of the ``n`` days with data before it.

    Rows are summed per day first; what is ranked are a few days per key.
    """
    daily = (
        _present(df, by).where(F.col("_time").isNotNull())
        .withColumn("day", bucket())
        .groupBy(*by, "day")
        .agg(F.sum(value).alias("daily"))
    )
    if not by:
        daily = daily.orderBy(F.desc("day")).limit(n + 1)  # all that the window may see
    newest = Window.partitionBy(*by).orderBy(F.desc("day"))
    recent = daily.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= n + 1)
    recent_days = recent.groupBy(*by) if by else recent
    return recent_days.agg(
        F.max(F.when(F.col("n") == 1, F.col("daily"))).alias("yesterday_usd"),
        F.avg(F.when(F.col("n").between(2, n + 1), F.col("daily"))).alias("baseline_avg_usd"),
    ).where(F.col("yesterday_usd") > factor * F.col("baseline_avg_usd"))


def trailing_baseline(
    df: DataFrame, value: str, by: Sequence[str], n: int = 7, factor: float = 1.5
) -> DataFrame:
    """Each day of each key against its previous ``n`` days with data."""
    daily = (
        _present(df, by)
        .withColumn("day", bucket())
        .groupBy(*by, "day")
        .agg(F.sum(value).alias("daily"))
    )
    before = Window.partitionBy(*by).orderBy("day").rowsBetween(-n, -1)
    return daily.withColumn("baseline", F.avg("daily").over(before)).withColumn(
        "spike", F.coalesce(F.col("daily") > factor * F.col("baseline"), F.lit(False))
    )


def first_seen(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """First time each combination of keys occurs, and how often."""
    return stats(df, {"first_seen": F.min("_time"), count: F.count("*")}, keys)
