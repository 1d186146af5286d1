"""Alignment of two tokenizers: byte groups, links between tokens, and how frequent they are.

Tokenizer A reads space + text, B reads text and adds the space itself, so both cut the
same bytes. Places where a token of each ends cut a text into groups; two tokens are
linked where their bytes overlap.

1. A text is cut before plain spaces inside it (``_UNIT``). There both tokenizers cut as
   well: A splits its text before such a space, and no piece of B has a space behind
   another character. So a text's tokens, groups and links are those of its units, and a
   unit is aligned once per worker as long as it stays in the cache. For the same reason
   new units go to the libraries in few calls, as one text.
2. ``Aligner`` takes the libraries' spans of every text as coarse cuts: A's character
   offsets and the byte spans of B's result proto. Where a span's width is not the length
   of the token's decoded bytes (parts of a character, byte-fallback tokens), decoded
   lengths place the cuts behind the run's start. Tokens count only if their bytes joined
   are the text.
3. ``align`` gives every document's tokens, groups and distinct linked id pairs.
4. ``pair_counts`` sums links over the corpus, combined within tasks first. Pairs above a
   count that at most ``COMMON`` pairs reach are looked up in sorted arrays by each task;
   the rest is joined by pair, whatever their number.

Defined results: null and empty texts, and texts whose joined tokens are not space + text,
have no tokens: empty lists and zeros. Repeated rows count each time. Columns with the
names of new ones are replaced. Memory is bounded by a run of texts (one at least), the
cache, and the longest unit, which the libraries see whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import held, keep, staged, text_runs

# A space that begins a unit: not behind a space, and before a byte that begins no white space.
_UNIT = re.compile(rb"(?<=[^ ])(?= [!-~\xc3-\xdf\xe0\xe4-\xf4])")
# A unit that may stand behind another: it begins so, and no space ends it.
_PLAIN = re.compile(rb" [!-~\xc3-\xdf\xe0\xe4-\xf4](?:.*[^ ])?", re.DOTALL)
JOINED = 4000  # plain units that go to a library as one text
CACHED_BYTES = 4_000_000  # of units, per worker; with their tokens about forty times that
COMMON = 1 << 18  # pairs that tasks look up; bounds what is sent to them
FLUSH = 1 << 20  # distinct pairs a task holds before it gives out their counts
_B_SPAN = 1 << 20  # pair = A id * this + B id; more than either vocabulary holds

ALIGNED = T.StructType(
    [
        T.StructField("a_ids", T.ArrayType(T.IntegerType())),
        T.StructField("b_ids", T.ArrayType(T.IntegerType())),
        T.StructField("a_group", T.ArrayType(T.IntegerType())),  # A tokens of each group
        T.StructField("b_group", T.ArrayType(T.IntegerType())),
        T.StructField("pairs", T.ArrayType(T.LongType())),  # distinct linked id pairs
        T.StructField("links", T.ArrayType(T.IntegerType())),  # and how many links each has
    ]
)


def vocabularies() -> tuple[str, str]:
    """The default vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), _edges(size)


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of ``flat`` one after the other."""
    skip = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[skip + np.arange(len(skip))]


def _sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = _edges(values)
    return total[edge[1:]] - total[edge[:-1]]


def refined(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse spans and decoded lengths.

    Spans that are as wide as their token stand. In a run of others, the lengths count
    from where the run begins.
    """
    loose = end - begin != size
    if not loose.any():
        return end
    first = loose & ~np.concatenate([[False], loose[:-1]])
    run = np.cumsum(first) - 1
    total = np.cumsum(size)
    start = begin[first] - (total - size)[first]
    return np.where(loose, start[np.maximum(run, 0)] + total, end)


def _decoded(unit: bytes) -> str:
    """A unit as text; bytes that are no text have no tokens."""
    try:
        return unit.decode()
    except UnicodeDecodeError:
        return ""


class Numbers(dict):
    """Unit -> number; a unit that is looked up for the first time gets the next one."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, unit: bytes) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class Column:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.values = np.zeros(1 << 12, dtype)
        self.filled = 0

    def append(self, more: np.ndarray) -> None:
        while self.filled + len(more) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.filled : self.filled + len(more)] = more
        self.filled += len(more)


class Aligner:
    """Both vocabularies and the cache of aligned units."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = _byte_of()
        entries = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, k in self.a.get_vocab(with_added_tokens=False).items():
            entries[k] = bytes(byte_of[c] for c in entry)
        self.a_bytes, self.a_at = _flat(entries)
        entries = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            if self.b.is_byte(k):
                entries.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(k) or self.b.is_unknown(k):
                entries.append(b"")
            else:
                entries.append(piece.replace("▁", " ").encode())
        self.b_bytes, self.b_at = _flat(entries)
        self._clear()

    NAMES = ("a_ids", "b_ids", "a_group", "b_group", "pairs")

    def _clear(self) -> None:
        self.number = Numbers()
        self.bytes = 0
        self.good = Column(bool)
        self.flat = {n: Column(np.int64 if n == "pairs" else np.int32) for n in self.NAMES}
        self.start = {n: Column(np.int64) for n in self.NAMES}
        self.size = {n: Column(np.int64) for n in self.NAMES}

    def _calls(self, units: list[bytes]) -> list[tuple[str, list[int]]]:
        """Texts for the libraries, each of one unit or more, and which units they hold."""
        plain = [k for k, u in enumerate(units) if _PLAIN.fullmatch(u)]
        odd = sorted(set(range(len(units))) - set(plain))
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)] + [[k] for k in odd]
        found = []
        for group in groups:
            try:
                found.append((b"".join([units[k] for k in group]).decode(), group))
            except UnicodeDecodeError:  # some unit is no text: that one has no tokens
                found += [(text, [k]) for k in group if (text := _decoded(units[k]))]
        return found

    def _read_a(self, text: str, data: np.ndarray):
        """Ids of A's tokens and the bytes that their spans begin and end at."""
        found = self.a.encode(text, add_special_tokens=False)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)
        # character offsets to bytes: places of the characters' first bytes
        firsts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        return np.array(found.ids, np.int64), firsts[spans[:, 0]], firsts[spans[:, 1]]

    def _read_b(self, text: str):
        # B adds the space that a text begins with here; its spans do not know of it
        found = self.b.encode(text[1:], return_type="proto")
        flat = chain.from_iterable((p.id, p.begin, p.end) for p in found.pieces)
        ids, begin, end = np.fromiter(flat, np.int64).reshape(-1, 3).T
        begin = begin + 1
        begin[:1] = 0
        return ids, begin, end + 1

    _spans_a, _spans_b = _read_a, _read_b

    @staticmethod
    def _cuts(ids, begin, end, table, at, edge, data):
        """Byte ends of tokens, and the units whose tokens' bytes joined are the unit.

        ``edge`` are the units' edges in ``data``. Tokens that reach over an edge are of no
        unit; they occur where a unit is not what its tokens say.
        """
        size = at[ids + 1] - at[ids]
        cut = refined(begin, end, size)
        of = np.searchsorted(edge, cut) - 1
        inside = cut - size >= edge[of]
        joined = _ragged(table, at[ids], size)
        if len(joined) == len(data) and inside.all() and (joined == data).all():
            return cut, of, np.ones(len(edge) - 1, bool)
        good = np.zeros(len(edge) - 1, bool)
        for k, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])):
            own = (of == k) & inside
            text = b"".join(table[at[i] : at[i + 1]].tobytes() for i in ids[own])
            good[k] = text == data[lo:hi].tobytes()
        return cut, of, good

    def _learn(self, units: list[bytes]) -> None:
        """Align the units, in the order of their numbers, and keep what was found."""
        calls = self._calls(units)
        order = [k for _, group in calls for k in group]
        parts = {n: [] for n in self.NAMES}
        sizes = {n: np.zeros(len(units), np.int64) for n in self.NAMES}
        good = np.zeros(len(units), bool)
        for text, group in calls:
            data, edge = _flat([units[k] for k in group])
            a_ids, *a_spans = self._read_a(text, data)
            b_ids, *b_spans = self._read_b(text)
            a = self._cuts(a_ids, *a_spans, self.a_bytes, self.a_at, edge, data)
            b = self._cuts(b_ids, *b_spans, self.b_bytes, self.b_at, edge, data)
            (a_cut, a_of, a_good), (b_cut, b_of, b_good) = a, b
            right = a_good & b_good
            a_in, b_in = right[a_of], right[b_of]
            a_ids, a_cut, b_ids, b_cut = a_ids[a_in], a_cut[a_in], b_ids[b_in], b_cut[b_in]
            # each piece between neighbouring cuts of either kind links the two tokens it is of
            cuts = np.union1d(a_cut, b_cut)
            a_of, b_of = np.searchsorted(a_cut, cuts), np.searchsorted(b_cut, cuts)
            both = np.intersect1d(a_cut, b_cut, assume_unique=True)
            found = {
                "a_ids": (a_ids, a_cut),
                "b_ids": (b_ids, b_cut),
                "a_group": (self._between(a_cut, both), both),
                "b_group": (self._between(b_cut, both), both),
                "pairs": (a_ids[a_of] * _B_SPAN + b_ids[b_of], cuts),
            }
            good[group] = right
            for name, (values, places) in found.items():
                parts[name].append(values)
                sizes[name][group] = self._between(places, edge[1:])
        self._store(order, good, parts, sizes)

    @staticmethod
    def _between(cuts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """How many cuts lie in each stretch that ends at one of ``stops``."""
        return np.diff(np.searchsorted(cuts, stops, side="right"), prepend=0)

    def _store(self, order: list[int], good: np.ndarray, parts: dict, sizes: dict) -> None:
        """Values lie in the order of the calls, starts and sizes in that of the numbers."""
        self.good.append(good)
        for name in self.NAMES:
            size = sizes[name]
            start = np.zeros(len(size), np.int64)
            start[order] = np.cumsum(size[order]) - size[order]
            self.start[name].append(self.flat[name].filled + start)
            self.size[name].append(size)
            self.flat[name].append(np.concatenate([*parts[name], np.zeros(0, np.int64)]))

    def units(self, text: bytes) -> list[bytes]:
        return _UNIT.split(b" " + text) if text else []

    def runs(self, texts: list[bytes]):
        """Per kind of output: the values of all texts, and how many each text has."""
        if self.bytes > CACHED_BYTES:
            self._clear()
        number = self.number.__getitem__
        numbers = []
        for text in texts:
            units = self.units(text)
            numbers.append(np.fromiter(map(number, units), np.int64, len(units)))
        if self.number.new:
            self.bytes += sum(map(len, self.number.new))
            self._learn(self.number.new)
            self.number.new = []
        count = np.array([len(n) for n in numbers], np.int64)
        edge, every = _edges(count), np.concatenate([*numbers, np.zeros(0, np.int64)])
        bad = _sums((~self.good.values[every]).astype(np.int64), edge) > 0
        every = every[~np.repeat(bad, count)]
        edge = _edges(np.where(bad, 0, count))
        out = {}
        for name in self.NAMES:
            start, sizes = self.start[name].values[every], self.size[name].values[every]
            out[name] = (_ragged(self.flat[name].values, start, sizes), _sums(sizes, edge))
        return out


def _lists(values: np.ndarray, sizes: np.ndarray, dtype: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_edges(sizes).astype(np.int32)), pa.array(values, dtype))


def _distinct(pairs: np.ndarray, sizes: np.ndarray):
    """Distinct pairs of each text with their number of links, texts in order."""
    key = np.sort(np.repeat(np.arange(len(sizes)) * _B_SPAN**2, sizes) + pairs)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    text, pair = np.divmod(key[at], _B_SPAN**2)
    return pair, np.diff(np.append(at, len(key))), np.bincount(text, minlength=len(sizes))


Batches = Iterator[pa.RecordBatch]


def _aligned(docs: DataFrame, text_col: str, a_path: str | None, b_path: str | None):
    """The other columns of ``docs``, and the pass over batches that aligns them.

    The vocabulary files are read once, by the driver.
    """
    default = vocabularies()
    with open(a_path or default[0], encoding="utf-8") as a, open(b_path or default[1], "rb") as b:
        shipped = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    token = uuid.uuid4().hex
    names = [c for c in docs.columns if c != text_col and c not in ALIGNED.fieldNames()]
    ints, longs = pa.int32(), pa.int64()

    def run(batches: Batches) -> Batches:
        own = held("aligner", token, lambda: Aligner(*shipped.value))
        for batch in batches:
            for part, texts in text_runs(batch, text_col):
                found = own.runs(texts)
                pairs, links, sizes = _distinct(*found["pairs"])
                more = {n: _lists(*found[n], ints) for n in Aligner.NAMES[:4]}
                more["pairs"] = _lists(pairs, sizes, longs)
                more["links"] = _lists(links, sizes, ints)
                yield keep(part, names, more, {})

    return names, run


def align(
    docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    """``docs`` without its text, with ``ALIGNED``: tokens, groups and linked pairs."""
    names, run = _aligned(docs, text_col, a_path, b_path)
    fields = [docs.schema[c] for c in names]
    return docs.select(text_col, *names).mapInArrow(run, T.StructType(fields + ALIGNED.fields))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and how many each row has."""
    return np.asarray(column.flatten()), np.asarray(pa.compute.list_value_length(column)).astype(np.int64)


class Signs:
    """The bytes of each id with the sign behind it."""

    def __init__(self):
        self.of: dict[str, np.ndarray] = {s: np.zeros(0, object) for s in ",|;"}

    def __call__(self, sign: str, ids: np.ndarray) -> np.ndarray:
        top = int(ids.max(initial=0)) + 1
        if top > len(self.of[sign]):
            self.of[sign] = np.array([f"{k}{sign}".encode() for k in range(2 * top)], object)
        return self.of[sign][ids]


def group_digests(part: pa.RecordBatch, sign: Signs) -> list[str]:
    """The hex sha256 of ``a1,a2|b1;a3|b2,b3`` of each row: ids of A and B, group by group.

    Rows without tokens have the empty string.
    """
    (a, n_a), (b, n_b), (ga, _), (gb, _) = (
        _values(part.column(c)) for c in ("a_ids", "b_ids", "a_group", "b_group")
    )
    # the last token of a group and side has a sign of its own behind it
    a_end, b_end = _edges(ga)[1:] - 1, _edges(gb)[1:] - 1
    a_text, b_text = sign(",", a), sign(",", b)
    a_text[a_end], b_text[b_end] = sign("|", a[a_end]), sign(";", b[b_end])
    size = np.stack([ga, gb], axis=1).ravel().astype(np.int64)
    side = np.repeat(np.tile([False, True], len(ga)), size)
    every = np.empty(len(a) + len(b), object)
    every[~side], every[side] = a_text, b_text
    edge = _edges(n_a + n_b)
    return [
        hashlib.sha256(b"".join(every[lo:hi])[:-1]).hexdigest() if hi > lo else ""
        for lo, hi in zip(edge[:-1], edge[1:])
    ]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def digested(
    docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    """``align`` with counts and ``groups_sha256`` in place of tokens and groups.

    They are derived from the aligned batches in the task that made them.
    """
    names, run = _aligned(docs, text_col, a_path, b_path)
    types = {**dict.fromkeys(COUNTS, pa.int64()), "groups_sha256": pa.string()}

    def derive(batches: Batches) -> Batches:
        sign = Signs()
        for part in run(batches):
            n_a, n_b, n_groups = (_values(part.column(c))[1] for c in ("a_ids", "b_ids", "a_group"))
            links, sizes = _values(part.column("links"))
            more = (n_a, n_b, n_groups, _sums(links, _edges(sizes)), group_digests(part, sign))
            yield keep(part, [*names, "pairs", "links"], dict(zip(types, more)), types)

    fields = [docs.schema[c] for c in names] + ALIGNED.fields[-2:]
    fields += [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("groups_sha256", T.StringType())]
    return docs.select(text_col, *names).mapInArrow(derive, T.StructType(fields))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of each id pair over all rows, and whether its B id has no better: (pair, n, best)."""

    def run(batches: Iterator[pa.RecordBatch]):
        pairs, links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, _ = _values(batch.column("pairs"))
            more, _ = _values(batch.column("links"))
            pairs, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            links = np.bincount(
                place, np.concatenate([links, more]), minlength=len(pairs)
            ).astype(np.int64)  # exact below 2^53
            if len(pairs) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(links)], ["pair", "n"])
                pairs, links = pairs[:0], links[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(links)], ["pair", "n"])

    partial = aligned.select("pairs", "links").mapInArrow(run, "pair long, n long")
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = staged(counts, "pair-counts")
    b = F.expr(f"pair % {_B_SPAN}L").alias("_b")
    # one row per id of B, so the vocabulary bounds this side
    best = counts.groupBy(b).agg(F.max("n").alias("_most"))
    return counts.withColumn("_b", b).join(F.broadcast(best), "_b").select(
        "pair", "n", (F.col("n") == F.col("_most")).alias("best")
    )


def _common_from(counts: DataFrame, most: int) -> int:
    """The least count, a power of two, that at most ``most`` pairs reach."""
    sizes = dict(
        counts.groupBy(F.expr("length(bin(n)) - 1").alias("e")).agg(F.count("*")).collect()
    )  # at most 64 rows
    reached, e = 0, 63
    while e >= 0 and reached + sizes.get(e, 0) <= most:
        reached += sizes.get(e, 0)
        e -= 1
    return 1 << (e + 1)


def with_pair_sums(aligned: DataFrame, most: int = COMMON) -> DataFrame:
    """``aligned`` (staged) with n_best and count_sum, without its pairs.

    ``_row`` names a row. Common pairs are added up in the task that reads the row; the
    others go through a join and come back as one sum per row.
    """
    counts = staged(pair_counts(aligned), "pairs")
    floor = _common_from(counts, most)
    held = counts.where(F.col("n") >= floor).toArrow().sort_by("pair")  # at most `most` rows
    names = [c for c in aligned.columns if c not in ("pairs", "links")]
    if not len(held):
        known = aligned.selectExpr(*names, "0L AS n_best", "0L AS count_sum", "pairs", "links")
    else:
        arrays = tuple(held[c].to_numpy() for c in ("pair", "n", "best"))
        shipped = aligned.sparkSession.sparkContext.broadcast(arrays)

        def run(batches: Iterator[pa.RecordBatch]):
            pair, n, best = shipped.value
            for batch in batches:
                (pairs, sizes), (links, _) = _values(batch.column("pairs")), _values(batch.column("links"))
                place = np.minimum(np.searchsorted(pair, pairs), len(pair) - 1)
                found, edge = pair[place] == pairs, _edges(sizes)
                rest = _sums((~found).astype(np.int64), edge)
                yield keep(
                    batch,
                    names,
                    {
                        "n_best": pa.array(_sums(np.where(found & best[place], links, 0), edge)),
                        "count_sum": pa.array(_sums(np.where(found, links * n[place], 0), edge)),
                        "pairs": _lists(pairs[~found], rest, pa.int64()),
                        "links": _lists(links[~found], rest, pa.int32()),
                    },
                    {},
                )

        fields = [aligned.schema[c] for c in names]
        fields += [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]
        fields += [aligned.schema[c] for c in ("pairs", "links")]
        known = aligned.select(*names, "pairs", "links").mapInArrow(run, T.StructType(fields))
    if floor <= 1:  # all pairs are common
        return known.drop("pairs", "links")
    known = staged(known, "pair-sums")
    rest = (
        known.selectExpr("_row", "explode(arrays_zip(pairs, links)) AS p")
        .selectExpr("_row", "p.pairs AS pair", "p.links AS links")
        .join(counts.where(F.col("n") < floor), "pair")
        .groupBy("_row")
        .agg(
            F.sum(F.expr("CASE WHEN best THEN links ELSE 0 END")).alias("_best"),
            F.sum(F.col("links") * F.col("n")).alias("_sum"),
        )
    )
    return known.drop("pairs", "links").join(rest, "_row", "left").selectExpr(
        *names, "n_best + coalesce(_best, 0L) AS n_best", "count_sum + coalesce(_sum, 0L) AS count_sum"
    )


def report(docs: DataFrame, **paths) -> DataFrame:
    """The contract's counts and digest of every document."""
    aligned = digested(docs.select("doc_id", "text"), **paths)
    aligned = staged(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    return with_pair_sums(aligned).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
