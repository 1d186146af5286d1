"""Best-fit packing of tokenised documents by patterns and non-negative least squares.

1. ``tokenise``: every document becomes token ids and an end id, cut into pieces of at
   most ``capacity`` ids. Only documents longer than that are cut.
2. ``Plan``: patterns of a few piece lengths that fill a sequence exactly are enumerated,
   their repeat counts are fitted to the histogram of lengths by non-negative least
   squares and rounded to what the histogram holds, and the lengths left over are packed
   best-fit decreasing. All of this works on the histogram, whose size is ``capacity``.
3. ``pack``: pieces of a length are numbered across the cluster and take the places of
   that length in the plan by number. Numbering is by (length, salt): common lengths get
   as many salts as their count asks for, so no length lands in one task.

Defined results: null and empty text is the end id alone. Rows repeat as in the input:
each row's pieces get places of their own. An empty table gives no sequence.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import held, keep, staged, text_runs, tidy

CAPACITY = 2048
END = 0
PARTNERS = 32  # common lengths that three-piece patterns are made with
FIT_ROUNDS = 60
ROWS_PER_SALT = 250_000
CACHED_WORDS = 1_500_000  # per worker, about 200 bytes each
CACHED_BYTES = 64 << 20  # of these words' letters

# A run of ASCII punctuation that ends a word after a letter or digit is a token run of its own
# (an apostrophe could begin a contraction, a bar could end a special token).
_TAIL = re.compile(rb"(?<=[a-z0-9])[!\"#$%&()*+,./:;=?@-]+\Z")
_MARK = b"<|"  # special tokens hold it
SEPARATOR = "<|startoftext|>"

PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Places(dict):
    """Word -> number; a word that is looked up for the first time gets the next one."""

    def __init__(self):
        self.new: list[bytes] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        self.bytes += len(word)
        return number


class Tokeniser:
    """Token ids of texts, word by word through a cache.

    The vocabulary drops white space and never joins across it, so a text's ids are its
    words' ids in order; so are those of a word and of the punctuation behind it. Words that
    were not seen lately go to the library in few calls, held apart by a special token.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self._clear()

    def _clear(self) -> None:
        self.place = Places()
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.filled = 0

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the library."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        plain = [k for k, w in enumerate(words) if _MARK not in w]
        groups = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        joined = [
            f" {SEPARATOR} ".join(words[k].decode("utf-8", "replace") for k in group)
            for group in groups
        ]
        for group, found in zip(
            groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ):
            ids = np.array(found.ids, np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.separator))
            for k, part in zip(group, parts):
                out[k] = part
            for k in group[1:]:
                out[k] = out[k][1:]  # its separator
        marked = [k for k, w in enumerate(words) if _MARK in w]
        texts = [words[k].decode("utf-8", "replace") for k in marked]
        for k, found in zip(
            marked, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ):
            out[k] = np.array(found.ids, np.uint32)
        return out

    def _learn(self) -> None:
        """Fill in the words that have got a number since the last call."""
        if not self.place.new:
            return
        first = len(self.place) - len(self.place.new)
        whole, tailed = [], []
        for word in self.place.new:
            tail = None if _MARK in word else _TAIL.search(word)
            (tailed.append((word, tail.start())) if tail else whole.append(word))
        # the parts of tailed words are words as well, and may be new ones
        known = len(self.place)
        pairs = [(self.place[w], self.place[w[:at]], self.place[w[at:]]) for w, at in tailed]
        whole += self.place.new[known - first :]
        self.place.new = []
        encoded = self._encode(whole)
        numbers = np.array([self.place[w] for w in whole], np.int64)
        sizes = np.array([len(e) for e in encoded], np.int64)
        self._store(numbers, sizes, np.concatenate([*encoded, np.zeros(0, np.uint32)]))
        if pairs:
            of, a, b = np.array(pairs, np.int64).T
            two = np.stack([a, b], axis=1).ravel()
            self._store(of, self.size[a] + self.size[b], self._gather(two))

    def _store(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while len(self.start) < len(self.place):
            self.start, self.size = (np.concatenate([x, x]) for x in (self.start, self.size))
        while len(self.flat) < self.filled + len(ids):
            self.flat = np.concatenate([self.flat, self.flat])
        self.start[numbers] = self.filled + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of words one after the other."""
        size = self.size[numbers]
        skip = np.repeat(self.start[numbers] - (np.cumsum(size) - size), size)
        return self.flat[skip + np.arange(len(skip))]

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self.place) > CACHED_WORDS or self.place.bytes > CACHED_BYTES:
            self._clear()
        at = self.place.__getitem__
        numbers = []
        for text in texts:
            # the vocabulary is in lower case, so A-Z may be lowered before the cache (special
            # tokens are known by their case, so a text that could hold one stays as it is)
            words = (text if _MARK in text else text.lower()).split()
            numbers.append(np.fromiter(map(at, words), np.int64, len(words)))
        self._learn()
        for number in numbers:
            ids = self._gather(number)
            out = np.empty(len(ids) + 1, "<u4")
            out[:-1] = ids
            out[-1] = END
            yield out


def tokenise(
    docs: DataFrame,
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary_path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the other columns of ``docs``, piece, start, length, ids_crc32 (and ids).

    The vocabulary file is read once, by the driver. Columns of these names are replaced.
    """
    with open(vocabulary_path or vocabulary(), encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    token = uuid.uuid4().hex
    fields = [f.name for f in PIECE.fields] + ["ids"]
    names = [c for c in docs.columns if c != text_col and c not in fields]
    docs = docs.select(text_col, *names)
    kinds = {
        "piece": pa.int32(),
        "start": pa.int64(),
        "length": pa.int64(),
        "ids_crc32": pa.int64(),
    }

    def run(batches: Iterator[pa.RecordBatch]):
        own = held("tokeniser", token, lambda: Tokeniser(shipped.value))
        for batch in batches:
            for part, texts in text_runs(batch, text_col):
                row, more, tokens = [], {k: [] for k in kinds}, []
                for k, ids in enumerate(own.ids(texts)):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own_ids = ids[start : start + capacity]
                        row.append(k)
                        more["piece"].append(piece)
                        more["start"].append(start)
                        more["length"].append(len(own_ids))
                        more["ids_crc32"].append(zlib.crc32(own_ids.tobytes()))
                        if with_ids:
                            tokens.append(own_ids.astype(np.int32))
                if with_ids:
                    more["ids"] = pa.array(tokens, pa.list_(pa.int32()))
                yield keep(part.take(pa.array(row)), names, more, kinds)

    schema = [docs.schema[c] for c in names] + PIECE.fields
    if with_ids:
        schema.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.mapInArrow(tidy(run), T.StructType(schema))


class Plan:
    """How many sequences of which lengths to make from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        left = np.zeros(capacity + 1, np.int64)
        for length, count in histogram.items():
            left[length] = count
        # kinds of sequence: ([(length, copies), ...], how many)
        self.kinds: list[tuple[list[tuple[int, int]], int]] = []
        self._patterns(left)
        self._best_fit(left)
        self._places()

    def _enumerate(self, left: np.ndarray) -> np.ndarray:
        """Patterns of up to three lengths that are there and fill a sequence; rows of (P, 3)."""
        full, there = self.capacity, np.flatnonzero(left)
        out = []
        if left[full]:
            out.append(np.array([[full, 0, 0]]))
        a = there[there < full]
        two = a[(a >= full - a) & (left[full - a] > 0)]
        out.append(np.stack([two, full - two, 0 * two], axis=1))
        common = a[np.argsort(-left[a], kind="stable")][:PARTNERS]
        for b in common:
            c = full - a - b
            ok = (c > 0) & (left[np.maximum(c, 0)] > 0)
            out.append(np.sort(np.stack([a[ok], 0 * a[ok] + b, c[ok]], axis=1), axis=1)[:, ::-1])
        return np.unique(np.concatenate(out), axis=0)

    def _patterns(self, left: np.ndarray) -> None:
        """Fit repeat counts of the patterns and take them, rounded, from what is left."""
        patterns = self._enumerate(left)
        if not len(patterns):
            return
        goal = left.astype(np.float64)
        goal[0] = 0
        size = len(left)

        def uses(x):  # lengths that x repeats use
            total = np.zeros(size)
            for column in patterns.T:
                total += np.bincount(column, x, size)
            total[0] = 0
            return total

        def gain(per_length):  # the transpose: sum over a pattern's lengths
            return per_length[patterns].sum(axis=1)

        # multiplicative updates keep every count non-negative and lower the squared error
        x = np.full(len(patterns), max(1.0, goal.sum() / len(patterns) / 3))
        wanted = gain(goal)
        for _ in range(FIT_ROUNDS):
            x *= wanted / np.maximum(gain(uses(x)), 1e-9)
        for k in np.argsort(-x, kind="stable"):
            parts: dict[int, int] = {}
            for length in patterns[k]:
                if length:
                    parts[int(length)] = parts.get(int(length), 0) + 1
            times = min(int(np.rint(x[k])), *(int(left[p]) // m for p, m in parts.items()))
            if times > 0:
                self.kinds.append((sorted(parts.items(), reverse=True), times))
                for p, m in parts.items():
                    left[p] -= m * times

    def _best_fit(self, left: np.ndarray) -> None:
        """Longest first into the fullest sequence with room, counted by kinds of sequence."""
        room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

        def put(at: int, parts: list[tuple[int, int]], times: int) -> None:
            if times:
                room.setdefault(at, []).append((parts, times))

        for length in range(self.capacity, 0, -1):
            count = int(left[length])
            for space in sorted(s for s in room if s >= length):
                if not count:
                    break
                each = space // length
                for parts, times in room.pop(space):
                    full = min(times, count // each)
                    put(space - each * length, [*parts, (length, each)], full)
                    count -= full * each
                    times -= full
                    if times and count:  # fewer than a sequence takes
                        put(space - count * length, [*parts, (length, count)], 1)
                        count, times = 0, times - 1
                    put(space, parts, times)
            each = self.capacity // length
            put(self.capacity - each * length, [(length, each)], count // each)
            if count % each:
                put(self.capacity - count % each * length, [(length, count % each)], 1)
        for space in sorted(room):
            self.kinds += room[space]

    def _places(self) -> None:
        """For each length: first piece number, copies, first sequence and offset of each kind."""
        places: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for parts, times in self.kinds:
            offset = 0
            for length, copies in parts:
                at = used.get(length, 0)
                places.setdefault(length, []).append((at, copies, first, offset))
                used[length] = at + copies * times
                offset += copies * length
            first += times
        self.sequences = first
        self.places = {k: np.array(v, np.int64).T for k, v in places.items()}

    def locate(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the ``number``-th pieces of a length."""
        at, copies, first, offset = self.places[length]
        k = np.searchsorted(at, number, side="right") - 1
        rest = number - at[k]
        return first[k] + rest // copies[k], offset[k] + rest % copies[k] * length


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a length column) with sequence_id and offset.

    ``order`` names columns that tell pieces of one length apart; pieces alike in all of
    them are interchangeable. ``pieces`` is read several times and should be staged.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    # at most ``capacity`` rows
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = Plan(histogram, capacity)
    counts = [(k, -(-n // ROWS_PER_SALT)) for k, n in sorted(histogram.items())] or [(0, 1)]
    # Rows given as Python objects would start a second set of workers on each executor.
    salts = spark.createDataFrame(
        pa.table([pa.array(c, pa.int64()) for c in zip(*counts)], ["__length", "__salts"])
    )
    salted = (
        pieces.join(F.broadcast(salts), F.col("length") == F.col("__length"))
        .withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__salts")))
        .drop("__length", "__salts")
    )
    # one row for each length and ROWS_PER_SALT pieces of it
    offsets: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for length, salt, n in sorted(
        tuple(r) for r in salted.groupBy("length", "__salt").count().collect()
    ):
        offsets[length, salt] = total.get(length, 0)
        total[length] = offsets[length, salt] + n
    numbered = salted.withColumn(
        "__nth",
        F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1,
    )
    shipped = spark.sparkContext.broadcast((plan, offsets))
    names = pieces.columns
    kinds = {"sequence_id": pa.int64(), "offset": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]):
        own, before = shipped.value
        for batch in batches:
            length = np.asarray(batch.column("length"))
            salt = np.asarray(batch.column("__salt"))
            number = np.asarray(batch.column("__nth")).astype(np.int64)
            sequence, offset = np.zeros_like(number), np.zeros_like(number)
            for at in np.split(
                by := np.lexsort((salt, length)),
                np.flatnonzero(np.diff(length[by]) | np.diff(salt[by])) + 1,
            ):
                if len(at):
                    key = int(length[at[0]]), int(salt[at[0]])
                    sequence[at], offset[at] = own.locate(key[0], number[at] + before[key])
            yield keep(batch, names, {"sequence_id": sequence, "offset": offset}, kinds)

    schema = T.StructType(
        [
            *pieces.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    return numbered.mapInArrow(tidy(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, lengths of the pieces in order.

    Needs pieces with their ids; a sequence has at most ``capacity`` of them.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.col("parts")["ids"]).alias("ids"),
            F.col("parts")["length"].alias("lengths"),
        )
    )


def report(docs: DataFrame) -> DataFrame:
    """Every piece of every document with its place."""
    pieces = staged(tokenise(docs.select("doc_id", "text")), "pieces")
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"])
