"""Approximate nearest neighbours by a permutation index.

1. A vector is represented by the order of all pivots by their distance to it. It is posted
   in the inverted files of its first ``post`` pivots; a query reads the files of its first
   ``probe`` pivots. A candidate that stands in two files is looked at in the query's first.
2. Candidates are ranked by footrule: the sum, over the pivots, of how far apart a pivot
   stands in the two orders. Those up to the query's cut are kept, ties included. The cut is
   what a share of ``SHARE`` of a sample's vectors stays within, so that about this share of
   all rows does, in whatever files they lie.
3. What is kept is ranked again by Euclidean distance in double precision; each query's best
   of all files are its neighbours.

The only sample are the vectors that pivots are chosen from (``SAMPLE`` for each pivot);
every valid row is indexed. Pivots are one for ``ROWS_PER_PIVOT`` rows up to ``PIVOTS``, taken
farthest first from a sample by hash, so dense groups of near copies do not draw them. Files
longer than ``BLOCK`` rows are dealt to several blocks, also when all their vectors are
equal; a task holds one block and streams the queries past it.

What is missed are rows none of whose first ``post`` pivots is among the query's first
``probe``, and rows beyond the cut. Tables of up to ``LEAST`` rows are searched exactly.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component
and rows without id take no part. Vectors of different dimensions are no candidates of each
other; each dimension is searched by itself. Rows that share an id are candidates of their
own, but one query. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIVOTS, POST, PROBE = 250, 8, 64
ROWS_PER_PIVOT = 16
SHARE = 0.19  # of all rows, up to a query's cut by footrule
LEAST = 64  # rows within the cut, if there are so many
SAMPLE = 20  # vectors that are looked at for each pivot
BLOCK = 8192
SLICE = 64  # queries that go past a block at a time

_FOUND = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def valid(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part."""
    return table.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    ).where(F.col("vec_id").isNotNull() & valid(F.col("vec")))


def sampled(rows: DataFrame, number: int, enough: int) -> np.ndarray:
    """At most ``enough`` distinct vectors by hash; one that fills the table counts once."""
    bound = 2**63 - 1
    if number > enough:
        bound = int(2**64 * (enough / number) - 2**63)
    order = F.xxhash64("vec")
    few = rows.select("vec", order.alias("h")).where(F.col("h") <= bound)
    found = few.groupBy("h").agg(F.first("vec").alias("vec")).orderBy("h").limit(enough).collect()
    if SAMPLE * len(found) < enough < number:  # most rows below the bound are copies, or hashed above it
        found = rows.groupBy(order.alias("h")).agg(F.first("vec").alias("vec")).orderBy("h")
        found = found.limit(enough).collect()
    return np.array([r["vec"] for r in found], np.float64)


def farthest_first(sample: np.ndarray, n: int) -> list[int]:
    """Rows of ``sample``: the first, then always the one farthest from all before."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    least = 1e-24 * away.max()
    while len(chosen) < n:
        k = int(away.argmax())
        if away[k] <= least:
            break
        chosen.append(k)
        away = np.minimum(away, ((sample - sample[k]) ** 2).sum(axis=1))
    return chosen


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def orders(vecs: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivots' numbers by distance to each vector, nearest first."""
    distance = (pivots * pivots).sum(axis=1)[None, :] - 2 * vecs @ pivots.T
    return np.argsort(distance, axis=1, kind="stable").astype(np.uint8)


def footrule(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How far apart the pivots stand in each row's places and in ``place``, in all."""
    return np.abs(rows - place).sum(axis=1, dtype=np.int64)


def cuts(asked: np.ndarray, sample: np.ndarray, share: float) -> np.ndarray:
    """The footrule within which ``share`` of the sample's places lie, for each of ``asked``."""
    if share >= 1:
        return np.full(len(asked), np.iinfo(np.int64).max)
    k = min(len(sample) - 1, int(np.ceil(share * len(sample))))
    return np.array([np.partition(footrule(sample, place), k)[k] for place in asked], np.int64)


def ordered(rows: DataFrame, pivots: np.ndarray, sample: np.ndarray | None = None, share: float = 1.0) -> DataFrame:
    """``rows`` with ``near``, all pivots in order as bytes, and, against a sample, their ``cut``."""
    context = rows.sparkSession.sparkContext
    known = None if sample is None else places(orders(sample, pivots), len(pivots))
    shipped = context.broadcast((pivots, known))
    size = pivots.shape[1]

    def order(batches: Iterator[pa.RecordBatch]):
        own, compared = shipped.value
        for batch in batches:
            near = orders(_matrix(batch.column("vec"), size), own)
            cut = np.zeros(len(near), np.int64)
            if compared is not None:
                cut = cuts(places(near, len(own)), compared, share)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.tobytes() for r in near], pa.binary()), pa.array(cut)],
                names=[*batch.schema.names, "near", "cut"],
            )

    more = [T.StructField("near", T.BinaryType()), T.StructField("cut", T.LongType())]
    return rows.mapInArrow(order, T.StructType([*rows.schema.fields, *more]))


def _first(near: str, n: int) -> Column:
    """Numbers of the first pivots of ``near``."""
    count = F.least(F.length(near), F.lit(n))
    return F.transform(
        F.sequence(F.lit(1), count), lambda k: F.conv(F.hex(F.substring(F.col(near), k, F.lit(1))), 16, 10).cast("int")
    )


class Block:
    """The rows of one block of an inverted file."""

    def __init__(self, pivot: int, ids, vecs, near, post: int):
        self.pivot, self.ids, self.vecs, self.posted = pivot, ids, vecs, near[:, :post]
        self.places = places(near, near.shape[1])
        self.reranked = 0

    def nearest(self, query: int, vec: np.ndarray, place: np.ndarray, cut: int, k: int, probe: int):
        """(id, distance) of the best ``k`` of this block's rows within the query's cut.

        ``place`` has the place of every pivot in the query's order.
        """
        # files that the query reads before this one have shown it these rows already
        reads = np.where(place < probe, place, np.int16(1 << 14))
        rows = np.flatnonzero(
            (reads[self.posted].min(axis=1) == place[self.pivot]) & (self.ids != query)
        )
        rows = rows[footrule(self.places[rows], place) <= cut]
        self.reranked += len(rows)
        off = self.vecs[rows] - vec
        distance = np.sqrt((off * off).sum(axis=1))
        best = np.lexsort((self.ids[rows], distance))[:k]
        return self.ids[rows][best], distance[best]


def places(near: np.ndarray, width: int) -> np.ndarray:
    """Place of every pivot in each row's order."""
    out = np.zeros((len(near), width), np.int16)
    np.put_along_axis(out, near.astype(np.int64), np.arange(near.shape[1], dtype=np.int16)[None, :].repeat(len(near), 0), 1)
    return out


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    pivots: int = PIVOTS,
    post: int = POST,
    probe: int = PROBE,
    share: float = SHARE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``rows`` for each of ``queries``.

    Both have vec_id and vec (see ``vectors``); a query's own id is no candidate.
    """
    counts = dict(rows.groupBy(F.size("vec")).count().collect())  # a row per dimension
    parts = [
        _search(
            rows.where(F.size("vec") == size), queries.where(F.size("vec") == size), n, k, pivots, post, probe, share
        )
        for size, n in sorted(counts.items())
    ]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _search(rows, queries, number: int, k: int, pivots: int, post: int, probe: int, share: float) -> DataFrame:
    """``search`` over ``number`` rows of one dimension."""
    spark = rows.sparkSession
    pivots = min(pivots, 255, max(2, number // ROWS_PER_PIVOT))
    sample = sampled(rows, number, SAMPLE * pivots)
    base = sample[farthest_first(sample, pivots)]
    width, size = base.shape
    if number <= LEAST:
        share, probe = 1.0, width
    share = max(share, LEAST / number)
    post, probe = min(post, width), min(probe, width)
    columns = ("side", "vec_id", "vec", "near", "cut")
    posted = ordered(rows, base).select(
        F.explode(_first("near", post)).alias("pivot"), F.lit(0).alias("side"), *columns[1:]
    )
    asked = ordered(queries.groupBy("vec_id").agg(F.min("vec").alias("vec")), base, sample, share).select(
        F.explode(_first("near", probe)).alias("pivot"), F.lit(1).alias("side"), *columns[1:]
    )
    # one row per pivot: how many blocks its file takes
    files = posted.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    files = spark.createDataFrame(
        [(r["pivot"], r["blocks"]) for r in files.collect()], "pivot int, blocks int"
    )
    dealt = posted.join(F.broadcast(files), "pivot").withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    )
    copied = asked.join(F.broadcast(files), "pivot").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    keys = ["pivot", "block"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = (
        dealt.unionByName(copied)
        .drop("blocks")
        .repartition(partitions, *keys)
        .sortWithinPartitions(*keys, "side")
    )

    def meet(batches: Iterator[pa.RecordBatch]):
        key, held, block = None, [], None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in [*keys, "side"])))
            cuts = [0, *[i for i in range(1, len(marks)) if marks[i] != marks[i - 1]], len(marks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part, (pivot, number, side) = batch.slice(lo, hi - lo), marks[lo]
                if key != (pivot, number):
                    key, held, block = (pivot, number), [], None
                if side == 0:
                    held.append(part)
                    continue
                if block is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks()
                    column = {c: table.column(c).combine_chunks() for c in ("vec_id", "vec", "near")}
                    block = Block(
                        pivot,
                        np.asarray(column["vec_id"]),
                        _matrix(column["vec"], size),
                        np.frombuffer(b"".join(column["near"].to_pylist()), np.uint8).reshape(-1, width),
                        post,
                    )
                    held = []
                yield from _asked(part, block, k, probe, size, width)

    found = both.mapInArrow(meet, _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _asked(part: pa.RecordBatch, block: Block, k: int, probe: int, size: int, width: int):
    for at in range(0, part.num_rows, SLICE):
        some = part.slice(at, SLICE)
        ids, vecs = some.column("vec_id").to_pylist(), _matrix(some.column("vec"), size)
        full = np.frombuffer(b"".join(some.column("near").to_pylist()), np.uint8).reshape(-1, width)
        out: list[list] = [[], [], []]
        for q, vec, place, cut in zip(ids, vecs, places(full, width), some.column("cut").to_pylist()):
            found, distance = block.nearest(q, vec, place, cut, k, probe)
            out[0].append(np.full(len(found), q, np.int64))
            out[1].append(found)
            out[2].append(distance)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(out[0]), pa.int64()),
                pa.array(np.concatenate(out[1]), pa.int64()),
                pa.array(np.concatenate(out[2]), pa.float64()),
            ],
            names=["query_id", "vec_id", "score"],
        )


def report(embeddings: DataFrame) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 100."""
    rows = vectors(embeddings, "vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))
