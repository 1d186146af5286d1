"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """``rows`` with ``nth`` <= n: the first ``n`` of each value of ``by`` in hash order.

    ``order`` is a 64-bit hash. The values of ``by`` are what a model tells apart, so the
    driver, which holds the model, also counts their rows first. A hash bound that leaves about
    four times ``n`` rows of a value then cuts the rows where they are read, so what is
    shuffled and ranked does not grow with the table.
    """
    counts = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("value")).count().collect()
    bounds = [
        part
        for r in sorted(counts, key=lambda r: str(r["value"]))
        if r["count"] > 4 * n
        for part in (F.lit(r["value"]), F.lit(int(2**64 * 4 * n // r["count"]) - 2**63))
    ]
    if bounds:
        bound = F.element_at(F.create_map(*bounds), F.col(by))
        rows = rows.where(F.col(order) <= F.coalesce(bound, F.lit(2**63 - 1)))
    return (
        rows.where(F.col(by).isNotNull())
        .withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))
        .where(F.col("nth") <= n)
    )


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    rows_per_class: int,
    max_chars: int,
    learnable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[tuple[bytes, int]]:
    """At most ``rows_per_class`` texts of up to ``max_chars`` of either label, in hash order.

    Only rows for which ``learnable`` holds (on ``id_col``) are seen; rows without label or
    text teach nothing. The ids are chosen from the labels first, so that texts are found
    by a join with a bounded table; rows and characters bound what reaches the driver.
    """
    labelled = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learnable)
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .distinct()
        .withColumn("__order", F.xxhash64(F.col("__id").cast("string"), F.lit(label_col)))
    )
    chosen = first_by_hash(labelled, "__label", "__order", rows_per_class).select(
        "__id", "__label"
    )
    rows = (
        docs.where(F.char_length(text_col).between(1, max_chars) & learnable)
        .select(id_col, F.col(text_col).cast("binary").alias("__text"))
        # at most 2 * rows_per_class ids
        .join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
        .groupBy("__id", "__label")
        .agg(F.min("__text").alias("__text"))
        .collect()
    )
    return [
        (bytes(r["__text"]), r["__label"])
        for r in sorted(rows, key=lambda r: (str(r["__id"]), r["__label"]))
    ]
