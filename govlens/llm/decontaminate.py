"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Normal form: A-Z in lower case; words are maximal runs of anything but ASCII
characters that are neither digits nor letters. A window is ``window`` consecutive
words of an item; an item with fewer words, but not none, is one window. All windows
form one automaton over word numbers, and each text is read once; word numbers are
mapped back to character offsets of the original text only where something matched.

The automaton is built from the benchmark's text, which the driver reads in blocks of
``block_bytes``: however long the benchmark is, one block's automaton is in a worker's
memory, and each block is one pass (a narrow stage, no shuffle). The last one merges the
hits of all blocks word by word.

Defined results: null or empty text has no words and no hits. Items without words, with
a null id or null text match nothing. Several rows of one item id count as one item.
Every document row gives one result row, repeated rows included.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import held, keep, text_runs, tidy

WINDOW = 13
BLOCK_BYTES = 32 << 20

# Upper case to lower case; every ASCII character that is no letter or digit to a space.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
# The same words in an original text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("first", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
        ]
    )
)
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(
                ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE
            )
            for key, items_of in owners.items():
                self.automaton.add_word(key, (len(key), tuple(items_of)))
            self.automaton.make_automaton()

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs (first word, last word) inside any window, and the items they are of."""
        if self.automaton is None or not found:
            return [], set()
        number = self.numbers.get
        runs, items = [], set()
        for end, (size, owners) in self.automaton.iter(tuple(number(w, 0) for w in found)):
            runs.append((end - size + 1, end))
            items.update(owners)
        return merge(runs), items


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int):
    """The benchmark's items in blocks of about ``size`` bytes, streamed through the driver."""
    rows = (
        benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
        .toLocalIterator()
    )
    block: list[tuple[str, bytes]] = []
    held = 0
    for item, text in rows:
        block.append((item, bytes(text)))
        held += len(text)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def _matcher(token: str, block, window: int) -> Matcher:
    """This worker's automaton of a broadcast block; the last two are kept."""
    return held("matcher", token, lambda: Matcher(block.value, window), most=2)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with, in one struct column ``contamination``:

    A column of that name in ``docs`` is replaced. Fields:
    n_words, n_hit (words inside occurrences of windows), items (sorted ids as strings),
    spans (start and end offsets in characters of the original text, end exclusive).
    """
    spark = docs.sparkSession
    docs = docs.drop("contamination")
    hits = T.StructType(
        [
            T.StructField("runs", HITS),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    kind = pa.struct([("runs", _SPANS), ("items", pa.list_(pa.string()))])
    shipped = [
        spark.sparkContext.broadcast(block)
        for block in item_blocks(benchmark, item_col, item_text_col, block_bytes)
    ]
    marked, passes = docs, []
    for block in shipped[:-1]:
        passes.append(f"__hits_{len(passes)}")
        token = uuid.uuid4().hex

        def scan(batches, block=block, name=passes[-1], token=token):
            matcher = _matcher(token, block, window)
            for batch in batches:
                for part, texts in text_runs(batch, text_col):
                    found = []
                    for text in texts:
                        runs, items = matcher.hits(words(text))
                        found.append(
                            {
                                "runs": [{"first": a, "last": b} for a, b in runs],
                                "items": sorted(items),
                            }
                        )
                    yield keep(part, part.schema.names, {name: found}, {name: kind})

        marked = marked.mapInArrow(
            tidy(scan), T.StructType([*marked.schema.fields, T.StructField(passes[-1], hits)])
        )
    return _summed(marked, docs, text_col, passes, shipped[-1] if shipped else None, window)


def _summed(
    marked: DataFrame, docs: DataFrame, text_col: str, passes: list[str], block, window: int
) -> DataFrame:
    """The last pass: hits of the last block, if there is one, merged with those of all others.

    Each pass is a worker of its own beside those of the same task, so one block takes one.
    """
    names, token = docs.columns, uuid.uuid4().hex
    result = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField(
                "spans",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("start", T.IntegerType()),
                            T.StructField("end", T.IntegerType()),
                        ]
                    )
                ),
            ),
        ]
    )
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )

    def sums(batches: Iterator[pa.RecordBatch]):
        matcher = _matcher(token, block, window) if block else None
        for batch in batches:
            for part, texts in text_runs(batch, text_col):
                hits = [part.column(p).to_pylist() for p in passes]
                out = []
                for k, text in enumerate(texts):
                    found = words(text)
                    runs, items = matcher.hits(found) if matcher else ([], set())
                    runs = merge([*runs, *((r["first"], r["last"]) for h in hits for r in h[k]["runs"])])
                    spans = []
                    if runs:
                        at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
                        spans = [{"start": at[a][0], "end": at[b][1]} for a, b in runs]
                    out.append(
                        {
                            "n_words": len(found),
                            "n_hit": sum(b - a + 1 for a, b in runs),
                            "items": sorted(items.union(*(h[k]["items"] for h in hits))),
                            "spans": spans,
                        }
                    )
                yield keep(part, names, {"contamination": out}, {"contamination": kind})

    schema = T.StructType([*docs.schema.fields, T.StructField("contamination", result)])
    return marked.mapInArrow(tidy(sums), schema)


def contaminated(n_words, n_hit):
    """At least one word in twenty lies in a window of a test item."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of its items and the verdict."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark)
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(c["n_words"], c["n_hit"]).alias("contaminated"),
    )

