"""Join of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more.

The join is exact, and it links classes of equal sets, not rows, so copies cost one hash:

1. ``frequencies``: all n-grams of all texts are counted in a sketch of fixed size. It gives
   one global order, rare n-grams first.
2. ``signatures``: every text once more; its set's hash, size, hashed bitmaps, some
   min-hashes and its *prefix*: the first n - ceil(percent * n) + 1 members in the global
   order. Two sets that are similar enough share a prefix member, whatever the order.
3. Stars: classes that share a min-hash are compared with one of them. This is linear,
   and it joins most of a large group of near copies before any pairs are looked at.
4. Tiles: prefix members meet in one shuffle, packed by bucket. Those in which at least two
   components meet are dealt to tiles by member, size band (similar sets lie in the same or the
   next band; a set finds larger ones by the first half of its prefix, about) and, for
   long postings, pairs of blocks of rows, so a tile is bounded. In a tile, pairs of
   different components whose sizes allow it are tested by bitmaps: bits that one has and
   the other lacks bound the overlap from above. A tile gives a forest of the components
   that may be linked, not the pairs.
5. Components that a forest holds together are a group; its classes meet once, in blocks,
   with their texts, and sorted sets made from these are intersected.
6. Links become components by alternating stars on the edge list.

Only counts of fixed size reach the driver (the sketch and a filter of needed keys); links,
components and sets stay tables.

Defined results: null and empty texts have the empty set, which links with nothing, not
even with another. Repeated rows are copies of each other. A component is named by its
smallest non-null id; a row with null id takes part like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import give_back, release, staged, text_runs, tidy
from govlens.llm.shingles import mix, shingle_sets

WORDS = 5
PERCENT = 80
ROUNDS = 12  # min-hashes a class is compared by before the tiles
SKETCH_BITS = 18  # counters per row of the frequency sketch, two rows
SKETCH_PARTS = 32
SIEVE_BITS = 24
LANES = 8  # 64-bit words of the short bitmap
WIDE = 1 << 14  # bits of a wide bitmap at most; it has 2 to 4 per member
BAND = 1.26  # sizes of similar sets differ by a factor of 1.25 at most
PAIRS = 1024  # bitmaps compared at a time
BLOCK = 1024  # rows of a posting on either side of a tile
PACKED = 1 << 21  # prefix members a task holds before it passes them on, about
TILE_MEMBERS = 1 << 20  # members of the sets on either side of an exact tile, about
GIVE_BACK = 1 << 20  # bytes of an exact tile after which its worker gives free memory back

# Odd multipliers, one per min-hash.
_ONES = [(0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xC2B2AE3D27D4EB4F << k) % 2**64 | 1 for k in range(64)]


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A member's counters in the two rows of the sketch."""
    size = np.uint64((1 << SKETCH_BITS) - 1)
    row = 1 << SKETCH_BITS
    return (
        (h & size).astype(np.int64),
        ((h >> np.uint64(SKETCH_BITS)) & size).astype(np.int64) + row,
    )


def _summed(parts: DataFrame, op: str) -> np.ndarray:
    """Counter rows (part, values) combined per part on the cluster, then read: fixed size."""

    def combine(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(raw, np.int64 if op == "add" else np.uint8)
                if part not in total:
                    total[part] = values.copy()
                elif op == "add":
                    total[part] += values
                else:
                    total[part] |= values
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(total), pa.int32()),
                    pa.array([v.tobytes() for v in total.values()], pa.binary()),
                ],
                names=["part", "counts"],
            )

    rows = parts.repartition(SKETCH_PARTS, "part").mapInArrow(tidy(combine), parts.schema).collect()
    return np.concatenate(
        [
            np.frombuffer(bytes(r["counts"]), np.int64 if op == "add" else np.uint8)
            for r in sorted(rows, key=lambda r: r["part"])
        ]
    ) if rows else np.zeros(0, np.int64)


_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_PARTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def frequencies(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """64 * log2 of every counter of the sketch: how common the members counted there are.

    Counters hold many members each, so a member stands out by some hundredths only; coarser
    steps would let frequent passages into the prefixes of large inputs.
    """

    def count(batches: Iterator[pa.RecordBatch]):
        release()
        total = np.zeros(2 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, texts in text_runs(batch, text_col):
                h = np.concatenate([*shingle_sets(texts, words), np.zeros(0, np.uint64)])
                for cells in _cells(h):
                    total += np.bincount(cells, minlength=len(total))
        yield from _whole(total)

    counts = _summed(docs.select(text_col).mapInArrow(tidy(count), _PARTS), "add")
    if not len(counts):
        counts = np.zeros(2 << SKETCH_BITS, np.int64)
    return np.round(64 * np.log2(counts + 1)).astype(np.uint16)


def _whole(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All parts, also those without counts, so that parts keep their places."""
    pieces = np.split(values, SKETCH_PARTS)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(range(SKETCH_PARTS), pa.int32()),
            pa.array([p.tobytes() for p in pieces], pa.binary()),
        ],
        names=["part", "counts"],
    )


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _first_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Members of a prefix by which a set finds those that are as large or larger: these share
    more of it, 2 * percent of 100 + percent at least, so it takes fewer of its members."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def signatures(
    docs: DataFrame, id_col: str, text_col: str, words: int, percent: int
) -> DataFrame:
    """Per row: row (unique), id, k1 and k2 (hashes of the text), n, sig, bitmap lanes, keys, prefix."""
    import xxhash

    weight = docs.sparkSession.sparkContext.broadcast(frequencies(docs, text_col, words))
    kinds = [
        ("row", pa.int64(), T.LongType()),
        ("id", None, docs.schema[id_col].dataType),
        ("k1", pa.int64(), T.LongType()),
        ("k2", pa.int64(), T.LongType()),
        ("n", pa.int64(), T.LongType()),
        ("sig", pa.binary(), T.BinaryType()),
        *[(f"w{k}", pa.int64(), T.LongType()) for k in range(LANES)],
        ("wide", pa.binary(), T.BinaryType()),
        ("keys", pa.list_(pa.int64()), T.ArrayType(T.LongType())),
        ("prefix", pa.list_(pa.int64()), T.ArrayType(T.LongType())),
    ]
    seeds = np.array(_ONES[:ROUNDS], np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]):
        release()
        common = weight.value
        for batch in batches:
            for part, texts in text_runs(batch, "text"):
                n, sig, lanes, wide, keys, prefix = [], [], [], [], [], []
                for h in shingle_sets(texts, words):
                    n.append(len(h))
                    sig.append(xxhash.xxh3_128_digest(h.tobytes()))
                    bits = np.zeros(64 * LANES, bool)
                    bits[(h >> np.uint64(48)) % np.uint64(64 * LANES)] = True
                    lanes.append(np.packbits(bits).view(np.int64))
                    wide.append(_wide(h))
                    if not len(h):
                        keys.append([])
                        prefix.append([])
                        continue
                    keys.append(
                        np.array([(h * s ^ (h >> np.uint64(29)) * s).min() for s in seeds]).view(np.int64)
                    )
                    first, second = _cells(h)
                    rank = np.minimum(common[first], common[second]).astype(np.uint64)
                    rank = (rank << np.uint64(48)) | (mix(h) >> np.uint64(16))
                    size = _prefix_size(len(h), percent)
                    # the first ones of the prefix stand before the others
                    early = int(_first_size(len(h), percent))
                    chosen = np.argpartition(rank, sorted({early - 1, size - 1}))[:size]
                    prefix.append(h[chosen].view(np.int64))
                words8 = np.array(lanes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("id"),
                        part.column("k1"),
                        part.column("k2"),
                        pa.array(n, pa.int64()),
                        pa.array(sig, pa.binary()),
                        *[pa.array(words8[:, k]) for k in range(LANES)],
                        pa.array(wide, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(prefix, pa.list_(pa.int64())),
                    ],
                    names=[k[0] for k in kinds],
                )

    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        *_text_keys(text_col),
        F.col(text_col).alias("text"),
    )
    schema = T.StructType([T.StructField(name, kind) for name, _, kind in kinds])
    return staged(source.mapInArrow(tidy(sign), schema), "signatures")


def _wide(h: np.ndarray) -> bytes:
    """A bitmap as wide as the set asks for, a power of two; halves fold onto each other."""
    size = min(WIDE, max(64, 1 << (4 * len(h) - 1).bit_length() >> 1)) if len(h) else 64
    bits = np.zeros(size, bool)
    bits[((h >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _same_width(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the narrowest one's width, as rows of 64-bit words."""
    least = min(map(len, bitmaps))
    if any(len(b) != least for b in bitmaps):
        folded = []
        for b in bitmaps:
            row = np.frombuffer(b, np.uint8).reshape(-1, least)
            folded.append(np.bitwise_or.reduce(row, axis=0).tobytes())
        bitmaps = folded
    return np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)


def _text_keys(text_col: str) -> list[Column]:
    """Two hashes by which a text is found again."""
    return [
        F.xxhash64(F.col(text_col)).alias("k1"),
        F.xxhash64(F.lit("second"), F.col(text_col)).alias("k2"),
    ]


def _room(a: str, b: str) -> Column:
    """Whether sizes and bitmaps of two sets allow the similarity: an upper bound."""
    lanes = range(LANES)

    def lacks(x: str, y: str) -> Column:
        return sum(
            (F.bit_count(F.col(f"{x}.w{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}.w{k}")))) for k in lanes),
            F.lit(0),
        )

    overlap = F.least(
        F.col(f"{a}.n") - lacks(a, b),
        F.col(f"{b}.n") - lacks(b, a),
    )
    return (F.lit(100) + PERCENT) * overlap >= F.lit(PERCENT) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bit array of fixed size in which the bits of all keys (column k1) are set."""

    def mark(batches: Iterator[pa.RecordBatch]):
        bits = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            bits[np.asarray(batch.column(0)) & ((1 << SIEVE_BITS) - 1)] = True
        yield from _whole(np.packbits(bits))

    bits = _summed(keys.select("k1").mapInArrow(tidy(mark), _PARTS), "or")
    return bits if len(bits) else np.zeros(1 << (SIEVE_BITS - 3), np.uint8)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & ((1 << SIEVE_BITS) - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def texts_of(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """node, text for ``nodes`` (node, k1, k2): one text for each.

    A sieve of fixed size keeps most other texts out of the shuffle, and a task passes each
    text on once, so a text that a third of all rows share is one row per task.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_sieve(nodes))

    def wanted(batches: Iterator[pa.RecordBatch]):
        own, seen = bits.value, set()
        for batch in batches:
            keys = np.asarray(batch.column("k1"))
            keep = np.zeros(len(keys), bool)
            for k in np.flatnonzero(_passes(own, keys)):
                key = int(keys[k])
                if key not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    keep[k] = True
            if keep.any():
                yield batch.filter(pa.array(keep))

    source = docs.select(*_text_keys(text_col), F.col(text_col).alias("text"))
    # a text's class is unique, so copies go where the join has put them together already
    return (
        source.mapInArrow(tidy(wanted), source.schema)
        .join(nodes, ["k1", "k2"])
        .dropDuplicates(["k1", "k2"])
        .select("node", "text")
    )


def verified(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, text_col: str, words: int, percent: int
) -> DataFrame:
    """Those of ``pairs`` (a, b: class nodes) whose sets are similar enough, exactly."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keyed = staged(needed.join(classes.select("node", "k1", "k2"), "node"), "needed")
    # both sides of the pairs read them; as a table they are compressed and made once
    texts = staged(texts_of(docs, keyed, text_col), "texts")
    both = (
        pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
        .select("a", "b", F.col("text_a"), F.col("text_b"))
    )

    def decide(batches: Iterator[pa.RecordBatch]):
        sets: dict[int, np.ndarray] = {}

        def set_of(node: int, text: bytes) -> np.ndarray:
            if node not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[node] = next(iter(shingle_sets([text], words)))
            return sets[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts_a = batch.column("text_a").cast(pa.binary())
            texts_b = batch.column("text_b").cast(pa.binary())
            keep = []
            for k in range(len(a)):
                x = set_of(a[k], texts_a[k].as_py())
                y = set_of(b[k], texts_b[k].as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((100 + percent) * shared >= percent * (len(x) + len(y)))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    return both.mapInArrow(tidy(decide), pairs.select("a", "b").schema)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``edges`` (a, b).

    Alternating large and small stars: each round links every neighbour to the smallest one
    around, and the number of rounds grows with the logarithm of a component's width.
    """
    edges = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = staged(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state


def _labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``classes`` with their component; a class without links is its own."""
    return classes.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def _stars(classes: DataFrame) -> DataFrame:
    """Pairs (a, b): each class and the first class, in hash order, that shares a min-hash."""
    keyed = classes.select("node", F.posexplode("keys").alias("round", "key"))
    order = F.struct(F.xxhash64("node", "round").alias("h"), F.col("node").alias("node"))
    centre = keyed.groupBy("round", "key").agg(
        F.min(order)["node"].alias("centre"), F.count("*").alias("size")
    )
    near = (
        keyed.join(centre.where(F.col("size") > 1), ["round", "key"])
        .where(F.col("node") != F.col("centre"))
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )
    shapes = classes.select("node", "n", *[f"w{k}" for k in range(LANES)])
    return (
        near.alias("p")
        .join(shapes.alias("x"), F.col("p.a") == F.col("x.node"))
        .join(shapes.alias("y"), F.col("p.b") == F.col("y.node"))
        .where(_room("x", "y"))
        .select("p.a", "p.b")
    )


def _met(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (member, tile, upper, first, node) of the tiles of prefix members in which two rows meet.

    A tile holds a member's sets of one size band (upper) and those of the band below that are
    to find larger ones, which takes their first members only (first). Each task packs its
    members by bucket, 7 bytes for one: 32 bits within the bucket, the row in its run of 65,536,
    the band. Two members that agree in these bits share a tile, which costs tests, not links.
    """
    buckets = 4 * int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that are not a class go here, or in the join with classes if the sieve is crowded
    leads = signed.sparkSession.sparkContext.broadcast(
        _sieve(classes.select(F.xxhash64("node").alias("k1")))
    )
    packed = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("run", T.LongType()),
            T.StructField("members", T.BinaryType()),
            T.StructField("rows", T.BinaryType()),
            T.StructField("bands", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]):
        release()
        own = leads.value
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pa.array(_passes(own, np.asarray(batch.column("key")))))
            lists = batch.column("prefix")
            sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
            n = np.asarray(batch.column("n"))
            band = np.floor(np.log(np.maximum(n, 1)) / math.log(BAND)).astype(np.uint8)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = place < np.repeat(_first_size(n, PERCENT), sizes)
            member = np.asarray(lists.flatten()).view(np.uint64)
            held.append((member, np.repeat(np.asarray(batch.column("row")), sizes), np.repeat(band, sizes) | first * np.uint8(128)))
            size += len(member)
            if size > PACKED:
                yield from _packed(held, buckets)
                held, size = [], 0
        if size:
            yield from _packed(held, buckets)

    def meet(batches: Iterator[pa.RecordBatch]):
        bucket, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if row[0] != bucket and held:
                    yield from _tiled(bucket, held)
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield from _tiled(bucket, held)

    schema = T.StructType(
        [
            T.StructField("member", T.LongType()),
            T.StructField("tile", T.IntegerType()),
            T.StructField("upper", T.BooleanType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("node", T.LongType()),
        ]
    )
    source = signed.select("row", F.xxhash64("row").alias("key"), "n", "prefix")
    return (
        source.mapInArrow(tidy(pack), packed)
        .repartition(buckets // 4, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(tidy(meet), schema)
    )


def _packed(held: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Members, rows and bands of a task as one row for each bucket and run of rows."""
    member, row, band = (np.concatenate(x) for x in zip(*held))
    run = row >> 16
    bucket = ((member >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((run, bucket))
    member, row, band, run, bucket = member[order], row[order], band[order], run[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (run[1:] != run[:-1])])
    ends = np.r_[starts[1:], len(row)]
    columns = (member.astype(np.uint32), (row & 0xFFFF).astype(np.uint16), band)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[starts]),
            pa.array(run[starts]),
            *[pa.array([c[lo:hi].tobytes() for lo, hi in zip(starts, ends)], pa.binary()) for c in columns],
        ],
        names=["bucket", "run", "members", "rows", "bands"],
    )


def _tiled(bucket: int, held: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket's tiles in which a row may find a larger or an equally large one."""
    member = np.concatenate([np.frombuffer(m, np.uint32) for _, m, _, _ in held]).astype(np.uint64)
    node = np.concatenate([(run << 16) + np.frombuffer(r, np.uint16).astype(np.int64) for run, _, r, _ in held])
    band = np.frombuffer(b"".join(b for *_, b in held), np.uint8)
    first, band = band >= 128, band & 127
    key = member << np.uint64(7) | band
    order = np.argsort(key, kind="stable")
    key, node, first = key[order], node[order], first[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[starts, len(key)])
    firsts = np.add.reduceat(first.astype(np.int64), starts)
    # sizes of the band below stand right before, if the member has any
    follows = np.r_[False, key[starts][1:] == key[starts][:-1] + np.uint64(1)]
    below = np.where(follows, np.r_[0, firsts[:-1]], 0)
    busy = (count + below >= 2) & (firsts + below >= 1)
    upper = np.repeat(busy, count)
    lower = np.repeat(np.r_[(busy & follows)[1:], False], count) & first
    at = np.r_[np.flatnonzero(upper), np.flatnonzero(lower)]
    if len(at):
        is_upper = np.arange(len(at)) < upper.sum()
        short = (key[at] >> np.uint64(7)).astype(np.int64)
        tile = (key[at] & np.uint64(127)).astype(np.int32) + ~is_upper
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.int64(bucket) << 32 | short),
                pa.array(tile.astype(np.int32)),
                pa.array(is_upper),
                pa.array(first[at]),
                pa.array(node[at]),
            ],
            names=["member", "tile", "upper", "first", "node"],
        )


def _tiles(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of components with rows that meet in a tile and whose bitmaps allow a link.

    Of all such pairs a forest is given: what is connected by them is connected by it.
    """
    rows = postings.join(classes.select("node", "component", "n"), "node")
    # without two components, a larger set or one that is to find it, a tile is idle
    busy = (
        rows.groupBy("member", "tile")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.max("upper").alias("upper"),
            F.max("first").alias("first"),
            F.count("*").alias("size"),
        )
        .where((F.col("low") != F.col("high")) & F.col("upper") & F.col("first"))
        .select("member", "tile", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node", "member"), F.col("blocks")).cast("int")
    other = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")),
    )
    # bitmaps join only what is left
    dealt = (
        rows.join(busy, ["member", "tile"])
        .withColumn("own", own)
        .withColumn("at", F.explode(other))
        .select(
            "member", "tile", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "own",
            "upper", "first", "node", "component", "n",
        )
        .join(classes.select("node", "wide"), "node")
    )
    keys = ["member", "tile", "i", "j"]
    partitions = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, *keys).sortWithinPartitions(*keys)

    def meet(batches: Iterator[pa.RecordBatch]):
        held: pa.Table | None = None
        forest = Forest()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            marks = np.stack([np.asarray(table.column(k)) for k in keys])
            edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            cut = int(edges[-1]) if len(edges) else 0
            held = table.slice(cut)
            if cut:
                yield from _meetings(table.slice(0, cut), edges, forest)
        if held is not None and held.num_rows:
            yield from _meetings(held, np.array([held.num_rows]), forest)

    return dealt.mapInArrow(tidy(meet), _EDGES).distinct()


class Forest:
    """Which nodes are joined; it forgets when it holds too many, which only repeats edges."""

    MOST = 1_000_000

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        while (up := parent.get(node, node)) != node:
            parent[node] = node = parent.get(up, up)
        return node

    def join(self, a: int, b: int) -> bool:
        """Join two nodes; whether they were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if len(self.parent) > self.MOST:
            self.parent.clear()
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        return np.array([self.root(n) for n in nodes.tolist()], np.int64)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _meetings(table: pa.Table, ends: np.ndarray, forest: Forest) -> Iterator[pa.RecordBatch]:
    """Edges between components in whose rows sizes and bitmaps allow a link.

    ``ends``: where tiles end. Components that ``forest`` holds together are not compared
    again, so the edges are fewer than the components, not as many as the pairs.
    """
    names = ("component", "n", "own", "upper", "first", "i", "j")
    column = {c: np.asarray(table.column(c)) for c in names}
    wide = table.column("wide")
    out: list[tuple[int, int]] = []
    begin = 0
    for end in ends:
        part = slice(begin, end)
        begin, start = end, begin
        size, upper, early = column["n"][part], column["upper"][part], column["first"][part]
        component, own = column["component"][part], column["own"][part]
        if (component == component[0]).all():
            continue
        two = column["i"][start] != column["j"][start]
        uppers = np.flatnonzero(upper)
        joined = forest.roots(component)
        bits = None
        for lo in range(0, len(uppers), 128):
            if (joined == joined[0]).all():
                break
            x = uppers[lo : lo + 128, None]
            # pairs of two upper rows are looked at once; in a tile of two blocks only across
            may = (joined != joined[x]) & (~upper | (np.arange(len(size)) < x))
            may &= early | early[x]
            if two:
                may &= own != own[x]
            may &= 100 * np.minimum(size, size[x]) >= PERCENT * np.maximum(size, size[x])
            at, ys = np.nonzero(may)
            if not len(at):
                continue
            if bits is None:
                bits = _same_width(wide.slice(start, end - start).to_pylist())
            xs = x[at, 0]
            before = len(out)
            for k in range(0, len(xs), PAIRS):
                a, b = xs[k : k + PAIRS], ys[k : k + PAIRS]
                lack_a = np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64)
                lack_b = np.bitwise_count(bits[b] & ~bits[a]).sum(axis=1, dtype=np.int64)
                overlap = np.minimum(size[a] - lack_a, size[b] - lack_b)
                fits = np.flatnonzero((100 + PERCENT) * overlap >= PERCENT * (size[a] + size[b]))
                for one, other in zip(component[a[fits]].tolist(), component[b[fits]].tolist()):
                    if forest.join(one, other):
                        out.append((min(one, other), max(one, other)))
            if len(out) > before:
                joined = forest.roots(component)
    if out:
        yield _edge_batch(out)


def joined_exactly(
    meetings: DataFrame, docs: DataFrame, contracted: DataFrame, text_col: str, words: int, percent: int
) -> DataFrame:
    """Links (a, b: class nodes) that join what is similar enough among components that meet.

    Components that meet, directly or through others, are a group. Its classes are dealt to
    tiles by pairs of blocks, each with its text, and a tile intersects the sets of classes of
    different components. The largest component's classes are alike already, so their blocks
    only meet those of the others. A tile gives a forest, never all pairs.
    """
    grouped = components(meetings).withColumnsRenamed({"component": "group", "node": "component"})
    grouped = staged(
        grouped.unionByName(grouped.select(F.col("group").alias("component"), "group").distinct()), "groups"
    )
    members = contracted.select("node", "component", "n", "k1", "k2").join(grouped.distinct(), "component")
    members = staged(members, "members")
    parts = members.groupBy("group", "component").agg(F.count("*").alias("rows"))
    largest = parts.groupBy("group").agg(F.max(F.struct("rows", "component"))["component"].alias("main"))
    # side 0 is the largest component, 1 the rest
    sided = members.join(largest, "group").withColumn("side", (F.col("component") != F.col("main")).cast("int"))

    def blocks(side: int) -> Column:
        share = F.sum(F.when(F.col("side") == side, F.greatest(F.lit(1 / BLOCK), F.col("n") / TILE_MEMBERS)))
        return F.ceil(F.coalesce(share, F.lit(0.0))).cast("int")

    cuts = sided.groupBy("group").agg(blocks(0).alias("mains"), blocks(1).alias("rest"))
    placed = sided.join(cuts, "group").withColumn(
        "own",
        F.when(F.col("side") == 0, F.pmod(F.xxhash64("node"), F.col("mains")))
        .otherwise(F.pmod(F.xxhash64("node"), F.col("rest")) + F.col("mains"))
        .cast("int"),
    )
    # a block of the rest meets all others, one of the largest component those of the rest
    last = F.col("mains") + F.col("rest") - 1
    others = F.filter(
        F.sequence(F.when(F.col("side") == 0, F.col("mains")).otherwise(F.lit(0)), last),
        lambda k: k != F.col("own"),
    )
    tiles = F.transform(others, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    texts = texts_of(docs, staged(members.select("node", "k1", "k2"), "needed"), text_col)
    dealt = (
        placed.join(texts, "node")
        .withColumn("at", F.explode(tiles))
        .select("group", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "own", "node", "component", "text")
    )

    def decide(table: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for batch in table.to_batches():
            for _, texts in text_runs(batch, "text"):
                sets += shingle_sets(texts, words)
        node, component = np.asarray(table.column("node")), np.asarray(table.column("component"))
        links = _links(sets, node, component, percent)
        if table.nbytes > GIVE_BACK:
            sets.clear()
            give_back()
        return pa.Table.from_batches([_edge_batch(links)])

    return dealt.groupBy("group", "i", "j").applyInArrow(decide, _EDGES)


def _links(
    sets: list[np.ndarray], node: np.ndarray, component: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Pairs of nodes that join the components of similar sets; overlaps are counted exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    members = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    forest, out = Forest(), []
    joined = component.copy()
    names, count = np.unique(component, return_counts=True)
    largest = names[count.argmax()]
    # every pair of two components has a row outside the largest
    for x in np.flatnonzero(component != largest):
        other = joined != joined[x]
        if not other.any():
            continue
        lo, hi = np.searchsorted(members, sets[x]), np.searchsorted(members, sets[x], side="right")
        spans = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
        shared = np.bincount(owner[spans], minlength=len(sets))
        fits = other & ((100 + percent) * shared >= percent * (size + size[x]))
        for y in np.flatnonzero(fits):
            if forest.join(int(component[x]), int(component[y])):
                a, b = int(node[x]), int(node[y])
                out.append((min(a, b), max(a, b)))
        if fits.any():
            joined = forest.roots(component)
    return out


def linked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per row of ``docs``: row, id, k1, k2 (hashes of its text), n (set size), node
    (its class), component (smallest class linked with it), first (the row that stands for
    the component) and component_id (smallest id in the component)."""
    if percent != PERCENT:
        raise ValueError("the tests in tiles are made for PERCENT")
    signed = signatures(docs, id_col, text_col, words, percent)
    some = signed.where(F.col("n") > 0)
    # one class per distinct set; it is named by its row with the smallest id
    lead = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("row").alias("row"))
    light = ["n", "k1", "k2", "sig", *[f"w{k}" for k in range(LANES)], "wide", "keys"]
    named = some.groupBy("sig").agg(F.min(lead).alias("lead"))
    classes = staged(
        some.select("row", *light)
        .join(named.select(F.col("lead.row").alias("row"), F.col("lead").alias("lead")), "row")
        .withColumnRenamed("row", "node"),
        "classes",
    )
    stars = staged(verified(staged(_stars(classes), "stars"), docs, classes, text_col, words, percent), "links")
    contracted = staged(
        _labelled(classes.select("node", "n", "k1", "k2", "wide"), components(stars)), "contracted"
    )
    meetings = staged(_tiles(staged(_met(some, classes), "postings"), contracted), "meetings")
    more = staged(joined_exactly(meetings, docs, contracted, text_col, words, percent), "links")
    found = components(stars.unionByName(more))
    labelled = staged(
        _labelled(classes.select("sig", "node", "lead"), found), "components"
    )
    heads = labelled.groupBy("component").agg(F.min("lead").alias("head"))
    names = labelled.join(heads, "component").select(
        "sig", "node", "component", F.col("head.row").alias("first"), F.col("head.id").alias("component_id")
    )
    rows = signed.select("row", "id", "k1", "k2", "n", "sig")
    filled = rows.where(F.col("n") > 0).join(names, "sig").drop("sig")
    empty = rows.where(F.col("n") == 0).select(
        "row", "id", "k1", "k2", "n",
        F.col("row").alias("node"), F.col("row").alias("component"),
        F.col("row").alias("first"), F.col("id").alias("component_id"),
    )
    return filled.unionByName(empty)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, and every row without words.

    The rows that stay are found again by id and by the hashes of their text. Rows that are
    alike in all of these are copies, of which one stays, unless they have no words.
    """
    found = linked(docs, id_col, text_col)
    names = docs.columns
    keys = ["__no", "__id", "__k1", "__k2"]

    def key(doc_id: str, k1: Column, k2: Column) -> list[Column]:
        # null ids and null texts are values like others here
        return [
            F.col(doc_id).isNull().alias("__no"),
            F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__id"),
            k1.alias("__k1"),
            k2.alias("__k2"),
        ]

    kept = found.where((F.col("row") == F.col("first")) & (F.col("n") > 0)).select(
        *key("id", F.col("k1"), F.col("k2"))
    )
    rows = docs.select("*", *key(id_col, *_text_keys(text_col)))
    blank = docs.where(~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return rows.join(kept, keys).dropDuplicates(keys).select(names).unionByName(blank)


def report(docs: DataFrame) -> DataFrame:
    """Every document's set size and component."""
    return linked(docs.select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id"
    )
