"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts are a group, which stays whole. The law is ``bytes``: the sums of the shards'
sizes are as near as differencing brings them.

1. ``group_sizes`` sums the bytes of each group, combined before they are shuffled.
2. ``items``: a group of a share of all bytes of 1 / ``PARTS`` or more is an item by
   itself; the others are bundled by hash into items of about that share. There are at
   most some ``2 * PARTS`` items, however large the corpus is.
3. ``difference``: each item begins as a partial partition, itself in one shard and the
   others empty. The two partial partitions of the largest spread are combined, the
   fullest shards of one with the emptiest of the other, until one is left; the
   combinations are then followed back to every item.
4. ``shard`` looks up the item of each document, and numbers the documents of a shard
   part by part of the input (``_numbered``), so no shard is ever in one task.

Defined results: null text is empty and in the group of empty texts. Every row counts, also
repeated ones, which are of one group. A group of more than an even share fills a shard
alone. An empty table gives no rows. Columns with the names of new ones are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import staged

SHARDS = 16
PARTS = 1 << 15  # bounds the items: what one differencing holds
LAW = "bytes"

# A group is known by 64 bits of its text: groups that share them stay together as well.
_GROUP = "xxhash64(coalesce({text}, ''))"
_SIZE = "CAST(octet_length(coalesce({text}, '')) AS BIGINT) + 1"


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with its group, size and crc32."""
    text = f"`{text_col}`"
    new = ("_group", "size", "text_crc32")
    rest = [f"`{c}`" for c in docs.columns if c not in (text_col, *new)]
    return docs.selectExpr(
        *rest,
        f"{_GROUP.format(text=text)} AS _group",
        f"{_SIZE.format(text=text)} AS size",
        f"crc32(CAST(coalesce({text}, '') AS BINARY)) AS text_crc32",
    )


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_group").agg(F.sum("size").alias("size"))


def items(groups: DataFrame, parts: int = PARTS) -> DataFrame:
    """``groups`` with the item each belongs to: (alone, key); the key of a lone group is its own."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    share = max(1, total // parts)
    alone = F.col("size") >= share
    key = F.when(alone, F.col("_group")).otherwise(F.expr(f"pmod(_group, {parts}L)"))
    return groups.withColumn("alone", alone).withColumn("key", key)


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. Ties go by the order of items, so equal input gives equal shards."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    # a partial partition: its sums less the least one, descending, and the place of each
    # of its shards in the combination that made it
    heap = [(-int(size), k, (int(size),) + (0,) * (shards - 1)) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = []  # (partition, partition, places of the first's shards, of the second's)
    while len(heap) > 1:
        _, a, full = heapq.heappop(heap)
        _, b, other = heapq.heappop(heap)
        both = [x + y for x, y in zip(full, reversed(other))]
        order = sorted(range(shards), key=both.__getitem__, reverse=True)
        place = [0] * shards
        for to, k in enumerate(order):
            place[k] = to
        least = both[order[-1]]
        sums = tuple(both[k] - least for k in order)
        heapq.heappush(heap, (-sums[0], n + len(made), sums))
        made.append((a, b, place))
    final: dict[int, list[int]] = {heap[0][1]: list(range(shards))}
    out = np.zeros(n, np.int64)
    for k in range(len(made) - 1, -1, -1):
        where = final.pop(n + k)
        a, b, place = made[k]
        own = [where[to] for to in place]
        for part, shards_of in ((a, own), (b, own[::-1])):
            if part < n:
                out[part] = shards_of[0]
            else:
                final[part] = shards_of
    if n == 1:
        out[0] = final[0][0]
    return out


def assignment(groups: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """(alone, key, shard) of every item: at most some ``2 * parts`` rows."""
    rows = (
        items(groups, parts)
        .groupBy("alone", "key")
        .agg(F.sum("size").alias("size"))
        .toArrow()
        .sort_by([("size", "descending"), ("alone", "ascending"), ("key", "ascending")])
    )
    of = difference(rows["size"].to_numpy(), shards)
    rows = rows.drop_columns(["size"]).append_column("shard", [of.astype(np.int32)])
    return groups.sparkSession.createDataFrame(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (staged, with _part and _at) with ``slot``, gapless within each shard.

    ``_part`` is the task that wrote a row and ``_at`` its place there. Rows are numbered
    within (part, shard); where a part's numbers begin is a running sum over the parts'
    counts, a row for each part and shard.
    """
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_at"))
    return (
        rows.withColumn("_within", within)
        .join(begin, ["_part", "shard"])
        .withColumn("slot", F.expr("_begin + _within - 1"))
        .drop("_begin", "_within", "_part", "_at")
    )


def shard(
    docs: DataFrame, text_col: str = "text", shards: int = SHARDS, parts: int = PARTS
) -> DataFrame:
    """``docs`` without its text, with size, text_crc32, law, shard and slot."""
    rows = sized(docs, text_col)
    groups = staged(group_sizes(rows), "group-sizes")
    table = assignment(groups, shards, parts)
    lone = table.where("alone").selectExpr("key AS _group", "shard AS _own")
    bundles = table.where("NOT alone").selectExpr("key AS _bundle", "shard AS _shared")
    placed = (
        rows.withColumn("_bundle", F.expr(f"pmod(_group, {parts}L)"))
        .join(F.broadcast(lone), "_group", "left")
        .join(F.broadcast(bundles), "_bundle", "left")
        .withColumn("shard", F.coalesce("_own", "_shared"))
        .drop("_group", "_bundle", "_own", "_shared")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return _numbered(staged(placed, "placed")).withColumn("law", F.lit(LAW))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return shard(docs.select("doc_id", "text")).select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
