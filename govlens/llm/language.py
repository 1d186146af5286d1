"""Language identification by cross-parsing against suffix automata.

For every language the labelled text becomes one suffix automaton. A text is parsed
from left to right into the longest phrases that occur in that language's text; the
language that needs fewest phrases, each weighted by the bits of naming a place in the
labelled text, wins. A symbol that the labelled text lacks costs twice that: once for the
phrase, once because no place holds it.

Normal form: lower case, every run of characters that are no letters is one space.

Learning takes a bounded sample of labelled rows: ``docs_per_language`` documents of
each language by hash order, a passage of ``passage_chars`` from each, and of these as
many characters as the bounds allow: ``total_chars`` shared by all languages, and a table
of ``TABLE_ENTRIES`` shared likewise (two states a character, one entry for each state and
symbol of the language, so a language of many symbols gives fewer characters; the first
symbol is always learned). Every text is parsed whole: the symbols of
many texts are cut into pieces that walk all automata in step, one table lookup per
symbol and language, so memory depends on a run of about one megabyte of text. A cut
adds at most one phrase to each language alike.

Defined results: null text, text without a letter, and any text when no labelled row
exists give ``und`` with score 0. Ties go to the language first in order. Labelled rows
with null text or null language teach nothing. Rows repeat in the result as in the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import fold, held, keep, text_runs, tidy
from govlens.llm.samples import first_by_hash

DOCS_PER_LANGUAGE = 300
PASSAGE_CHARS = 400
TOTAL_CHARS = 160_000
TABLE_ENTRIES = 1 << 25  # five bytes each
PIECE = 256
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    flags = np.zeros(0x110000, bool)
    for point in range(0x30000):
        flags[point] = chr(point).isalpha()
    flags[0x30000:0x32000] = True
    return flags


_LETTERS: list[np.ndarray] = []


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def normal(points: np.ndarray) -> np.ndarray:
    """Letters stay, each run of other characters becomes one space (code 32)."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    letter = _LETTERS[0][points]
    out = np.where(letter, points, 32)
    repeat = np.zeros(len(out), bool)
    repeat[1:] = ~letter[1:] & ~letter[:-1]
    return out[~repeat]


class Model:
    """Suffix automata of all languages in one table of next states.

    A state is the offset of its row, which has an entry for each symbol of its own
    language and a last one for all others. Where a phrase ends, the entry holds the state
    that the next phrase reaches with this symbol, and ``ended`` a one. A symbol that
    the language lacks is a phrase of its own: it leads back to the root and counts for
    the phrase before it, if there is one, and for itself.
    """

    def __init__(
        self,
        passages: dict[str, list[str]],
        total_chars: int = TOTAL_CHARS,
        table_entries: int = TABLE_ENTRIES,
    ):
        self.languages = sorted(passages)
        number = max(1, len(self.languages))
        texts = [
            self._sample(passages[k], total_chars // number, table_entries // number)
            for k in self.languages
        ]
        alphabet = np.unique(np.concatenate([*texts, np.array([32], np.uint32)]))
        self.alphabet = alphabet
        # a language's own number of every symbol of the alphabet, and of all others
        self.own = np.zeros((len(texts), len(alphabet) + 1), np.int32)
        tables, counts, self.roots, self.bits = [], [], [], []
        base = 0
        for k, text in enumerate(texts):
            letters = np.unique(text)
            self.own[k] = len(letters)
            self.own[k, np.searchsorted(alphabet, letters)] = np.arange(len(letters))
            own = self._automaton(np.searchsorted(letters, text).tolist(), len(letters) + 1)
            missing = own < 0
            root = np.where(own[0] < 0, 0, own[0])
            reached = np.where(missing, root[None, :], own).astype(np.int64)
            tables.append((reached * own.shape[1] + base).ravel())
            count = missing.astype(np.int8) + (missing & (own[0] < 0)[None, :])
            count[0] -= missing[0]
            counts.append(count.ravel())
            self.roots.append(base)
            self.bits.append(np.log2(max(2, len(text))))
            base += own.size
        # offsets fit 31 bits unless a caller allows larger tables
        kind = np.int32 if base < 2**31 else np.int64
        self.table = np.concatenate([t.astype(kind) for t in tables] or [np.zeros(0, kind)])
        self.ended = np.concatenate(counts or [np.zeros(0, np.int8)])
        self.bits = np.array(self.bits)

    @staticmethod
    def _sample(passages: list[str], chars: int, entries: int) -> np.ndarray:
        """Passages in a row, a space behind each, as far as the bounds of a language allow."""
        space = np.array([32], np.uint32)
        parts, taken, seen = [], 0, space
        for passage in passages:
            points = normal(code_points(passage))[: max(1, chars - taken)]
            more = np.union1d(seen, points)
            # two states a character, one entry for each symbol and one for all others
            room = entries // (2 * (len(more) + 1)) - taken - len(parts) - 1
            if room < len(points):
                points = points[: max(0 if parts else 1, room)]
                more = np.union1d(seen, points)
            parts += [points, space] if len(points) else []
            taken, seen = taken + len(points), more
            if taken >= chars or room <= len(points):
                break
        return np.concatenate(parts or [space])

    @staticmethod
    def _automaton(symbols: list[int], width: int) -> np.ndarray:
        """Next states of the suffix automaton of a text, -1 where there is none."""
        table = np.full((2 * len(symbols) + 2, width), -1, np.int32)
        link, length = [-1], [0]
        last = 0
        for symbol in symbols:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and table[at, symbol] < 0:
                table[at, symbol] = new
                at = link[at]
            if at != -1:
                there = int(table[at, symbol])
                if length[there] == length[at] + 1:
                    link[new] = there
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[there])
                    table[copy] = table[there]
                    while at != -1 and table[at, symbol] == there:
                        table[at, symbol] = copy
                        at = link[at]
                    link[there] = link[new] = copy
            last = new
        return table[: len(length)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of every text in every language, and whether the text has a letter."""
        counts, _, lettered = self.parse(texts)
        return counts, lettered

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``phrases``, with the number of each text's symbols that a language lacks between."""
        points = [normal(code_points(t)) for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        lacking = np.zeros_like(counts)
        lettered = np.array([bool((p != 32).any()) for p in points])
        if not len(self.languages) or not sizes.sum():
            return counts, lacking, lettered
        flat = np.concatenate(points)
        symbols = np.searchsorted(self.alphabet, flat)
        symbols[symbols == len(self.alphabet)] = 0
        known = self.alphabet[symbols] == flat
        symbols = np.where(known, symbols, len(self.alphabet)).astype(np.int32)
        of = np.repeat(np.arange(len(texts)), sizes)
        for k, own in enumerate(self.own):
            lacking[k] = np.bincount(of[own[symbols] == own[-1]], minlength=len(texts))
        # pieces of all texts, longest first, so that those still going are a prefix
        pieces = (sizes + PIECE - 1) // PIECE
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * PIECE
        size = np.minimum(PIECE, sizes[owner] - nth * PIECE)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        grid = symbols[np.minimum(start[None, :] + np.arange(PIECE)[:, None], len(symbols) - 1)]
        going = np.searchsorted(-size, -np.arange(PIECE), side="left")
        roots = np.array(self.roots, self.table.dtype)[:, None]
        state = np.repeat(roots, len(owner), axis=1)
        ends = np.ones(state.shape, np.int32)
        for step in range(PIECE):
            n = going[step]
            if not n:
                break
            at = state[:, :n] + self.own[:, grid[step, :n]]
            ends[:, :n] += self.ended[at]
            state[:, :n] = self.table[at]
        ends -= state == roots  # nothing behind the last phrase
        for k in range(len(self.languages)):
            counts[k] = np.bincount(owner, ends[k], len(texts)).astype(np.int64)
        return counts, lacking, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of every text, and whether it has a letter."""
        counts, lacking, lettered = self.parse(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), lettered.tolist()
        cost = (counts + lacking) * self.bits[:, None]
        best = cost.argmin(axis=0)
        gap = np.minimum(cost - cost.min(axis=0), 1000.0)
        score = 1.0 / np.exp2(-gap).sum(axis=0)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0).tolist(), lettered.tolist()


def learn(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
    passage_chars: int = PASSAGE_CHARS,
    total_chars: int = TOTAL_CHARS,
) -> Model:
    """A model of the languages in ``labelled``, from a bounded sample of it."""
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    length = F.char_length(text_col)
    start = F.pmod(order, F.greatest(F.lit(1), length - passage_chars + 1)) + 1
    usable = labelled.where(F.col(lang_col).isNotNull() & (F.char_length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"),
        order.alias("order"),
        F.substring(F.col(text_col), start.cast("int"), F.lit(passage_chars)).alias("passage"),
    )
    rows = (
        first_by_hash(usable, "lang", "order", docs_per_language)
        .select("lang", "nth", "passage")
        .collect()
    )
    passages: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["nth"])):
        passages.setdefault(row["lang"], []).append(row["passage"])
    return Model(passages, total_chars)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and lettered (whether the text has a letter, also when
    there is no language to tell); columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "lettered")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    token = uuid.uuid4().hex
    names = docs.columns
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "lettered": pa.bool_()}

    def predict(batches: Iterator[pa.RecordBatch]):
        own = held("language", token, lambda: shipped.value)
        for batch in batches:
            for part, texts in text_runs(batch, text_col):
                lang, score, has = own.judge([t.decode("utf-8", "replace") for t in texts])
                yield keep(part, names, {"lang_pred": lang, "score": score, "lettered": has}, kinds)

    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("lettered", T.BooleanType()),
        ]
    )
    return docs.mapInArrow(tidy(predict), schema)


def report(docs: DataFrame) -> DataFrame:
    """Every document's language, learned from the folds that are not held out."""
    held_out = fold("doc_id", 4) == 2
    model = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )
