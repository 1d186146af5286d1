"""Fill-in-middle transformation by displacement scatter.

1. ``planned`` (SQL functions): a hash of the id draws two cuts, which split a text into
   prefix, middle and suffix, and its form: ``psm`` (prefix, suffix, middle), ``spm``
   (suffix, prefix, middle) or ``plain``, each part behind its mark.
2. ``transform`` scans the texts of a run for the bytes of the cuts. A whole part moves by
   one distance, so difference arrays that change at the cuts give every byte of the run
   its shift: a cumulative sum and one numpy scatter write all outputs of the run.
3. ``restore`` finds the marks in the outputs, and the inverse of those shifts gathers the
   texts from them. It sees nothing but output and form.

Defined results: null text is empty, and empty texts and texts that hold a mark stay as
they are (plain). A null id draws like the id ''. Equal rows give equal rows. Columns with
the names of new ones are replaced, other columns are kept. Arrays of shifts cover a
window of ``WINDOW`` bytes at a time, so a long text takes its own size and little more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import keep, text_runs

# Marks of the three parts, and the shares of 100 that the hash draws.
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"
WINDOW = 1 << 20

_FORMS = ("plain", "psm", "spm")
_PLAN = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
    ]
)


def planned(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    seed: str = SEED,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
) -> DataFrame:
    """``docs`` with n (code points), form, prefix_chars and middle_chars.

    Numbers h1 to h4 are the first four groups of eight digits of the hex sha256 of
    ``seed:id``; the cuts are h1 and h2 modulo n + 1, h3 and h4 draw the form.
    """
    digest = f"sha2(concat({seed!r}, ':', coalesce(CAST(`{id_col}` AS STRING), '')), 256)"
    h = [f"CAST(conv(substr({digest}, {8 * k + 1}, 8), 16, 10) AS BIGINT)" for k in range(4)]
    text = f"coalesce(`{text_col}`, '')"
    n = f"CAST(char_length({text}) AS BIGINT)"
    marked = " OR ".join(f"contains({text}, '{m.decode()}')" for m in MARKS)
    form = (
        f"CASE WHEN {text} = '' OR {marked} OR {h[2]} % 100 >= {plain_from} THEN 'plain'"
        f" WHEN {h[3]} % 100 < {spm_below} THEN 'spm' ELSE 'psm' END"
    )
    a, b = (f"({x} % ({n} + 1))" for x in h[:2])
    rest = [f"`{c}`" for c in docs.columns if c not in _PLAN.fieldNames()]
    cut = lambda sql: f"CASE WHEN {form} <> 'plain' THEN {sql} END"
    return docs.selectExpr(
        *rest,
        f"{n} AS n",
        f"{form} AS form",
        f"{cut(f'least({a}, {b})')} AS prefix_chars",
        f"{cut(f'abs({a} - {b})')} AS middle_chars",
    )


class Shifts:
    """Where the bytes of a run go: one shift per byte, stated where it changes.

    ``at`` ascends from 0 and may repeat (an empty part); the last shift at a byte holds.
    """

    def __init__(self, at: np.ndarray, shift: np.ndarray):
        self.at = at
        self.change = np.diff(shift, prepend=0)  # the difference array, where it is not 0

    def targets(self, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """The targets of bytes [lo, hi), a window at a time."""
        shift = 0
        for lo in range(0, size, WINDOW):
            hi = min(size, lo + WINDOW)
            first, last = np.searchsorted(self.at, (lo, hi))
            place = np.zeros(hi - lo, np.int64)
            np.add.at(place, self.at[first:last] - lo, self.change[first:last])
            place[0] += shift
            np.cumsum(place, out=place)
            shift = int(place[-1])
            place += np.arange(lo, hi)
            yield lo, hi, place


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _cut_bytes(source: np.ndarray, edge: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Byte of the ``chars``-th code point of each text, by a scan for first bytes.

    The scan goes over a window at a time: it counts the code points before each text,
    then finds the wanted ones.
    """
    steps = range(0, len(source), WINDOW)
    seen = _edges(np.array([np.count_nonzero(_firsts(source, k)) for k in steps], np.int64))
    before = _rank(source, edge[:-1], seen)
    wanted = before + chars
    out = np.repeat(np.int64(len(source)), len(wanted))  # behind the last code point
    part = np.searchsorted(seen, wanted, side="right") - 1
    for k, lo in enumerate(steps):
        mine = part == k
        if mine.any():
            out[mine] = lo + np.flatnonzero(_firsts(source, lo))[wanted[mine] - seen[k]]
    return out


def _firsts(source: np.ndarray, lo: int) -> np.ndarray:
    return (source[lo : lo + WINDOW] & 0xC0) != 0x80


def _rank(source: np.ndarray, places: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte of ``places``."""
    out = np.repeat(seen[-1], len(places))
    part = places // WINDOW
    for k, lo in enumerate(range(0, len(source), WINDOW)):
        mine = part == k
        if mine.any():
            counts = _edges(_firsts(source, lo))
            out[mine] = seen[k] + counts[places[mine] - lo]
    return out


def scatter(
    source: np.ndarray, edge: np.ndarray, form: np.ndarray, prefix: np.ndarray, middle: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of a run of texts and their edges; ``form`` indexes plain, psm, spm."""
    begin, end, moved = edge[:-1], edge[1:], form > 0
    cut1, cut2 = begin.copy(), begin.copy()
    cut1[moved] = _cut_bytes(source, edge, prefix)[moved]
    cut2[moved] = _cut_bytes(source, edge, prefix + middle)[moved]
    n_p, n_m, n_s = cut1 - begin, cut2 - cut1, end - cut2
    n_s[~moved] = (end - begin)[~moved]  # a plain text is one part that does not move
    out_edge = _edges(n_p + n_m + n_s + np.where(moved, 9, 0))
    base = out_edge[:-1]
    psm = form == 1
    p_to = np.where(psm, base + 3, base + 6 + n_s)
    s_to = np.where(moved, np.where(psm, base + 6 + n_p, base + 3), base)
    m_to = np.where(moved, base + 9 + n_p + n_s, base)
    at = np.stack([begin, cut1, cut2], axis=1).ravel()
    shift = np.stack([p_to - begin, m_to - cut1, s_to - cut2], axis=1).ravel()
    out = np.empty(int(out_edge[-1]), np.uint8)
    for lo, hi, place in Shifts(at, shift).targets(len(source)):
        out[place] = source[lo:hi]
    for mark, to in zip(MARKS, (p_to, s_to, m_to)):
        out[(to[moved] - 3)[:, None] + np.arange(3)] = np.frombuffer(mark, np.uint8)
    return out, out_edge


def gather(out: np.ndarray, out_edge: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a run of outputs and their edges: the inverse of ``scatter``.

    An output that is not plain has each mark once. The first and the third mark are the
    ends of parts that lie in the order of the form.
    """
    begin, end, moved = out_edge[:-1], out_edge[1:], form > 0
    mark = np.zeros((len(form), 3), np.int64)  # places of <P>, <S> and <M>
    for lo in range(0, len(out), WINDOW):
        window = out[lo : lo + WINDOW + 2]
        found = np.flatnonzero((window[:-2] == MARKS[0][0]) & (window[2:] == MARKS[0][2]))
        letter = window[found + 1]
        place = found + lo
        text = np.searchsorted(out_edge, place, side="right") - 1
        inside = moved[text] & (place + 3 <= end[text])
        for k, sign in enumerate(MARKS):
            mine = inside & (letter == sign[1])
            mark[text[mine], k] = place[mine]
    psm = form == 1
    p_from, s_from, m_from = (mark + 3).T
    n_p = np.where(psm, mark[:, 1], mark[:, 2]) - p_from
    n_s = np.where(psm, mark[:, 2], mark[:, 0]) - s_from
    n_m = end - m_from
    for part, size in ((n_p, 0), (n_m, 0), (n_s, end - begin)):
        part[~moved] = np.broadcast_to(size, len(form))[~moved]
    edge = _edges(n_p + n_m + n_s)
    at = np.stack([edge[:-1], edge[:-1] + n_p, edge[:-1] + n_p + n_m], axis=1)
    come = np.stack([p_from, m_from, np.where(moved, s_from, begin)], axis=1)
    come[~moved, :2] = at[~moved, :2]
    text = np.empty(int(edge[-1]), np.uint8)
    for lo, hi, place in Shifts(at.ravel(), (come - at).ravel()).targets(len(text)):
        text[lo:hi] = out[place]
    return text, edge


def _strings(data: np.ndarray, edge: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(edge.astype(np.int32))
    return pa.StringArray.from_buffers(len(edge) - 1, offsets, pa.py_buffer(data))


def _run(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), _edges(np.array([len(t) for t in texts], np.int64))


def _forms(part: pa.RecordBatch, column: str = "form") -> np.ndarray:
    return np.array([_FORMS.index(f) for f in part.column(column).to_pylist()], np.int64)


def transform(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **draw) -> DataFrame:
    """``docs`` without its text, with the plan of ``planned`` and ``output``."""
    plan = planned(docs, text_col, id_col, **draw)
    names = [c for c in plan.columns if c not in (text_col, "output")]
    plan = plan.select(text_col, *names)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, texts in text_runs(batch, text_col):
                source, edge = _run(texts)
                chars = [
                    np.asarray(part.column(c).fill_null(0)) for c in ("prefix_chars", "middle_chars")
                ]
                out = _strings(*scatter(source, edge, _forms(part), *chars))
                yield keep(part, names, {"output": out}, {})

    schema = T.StructType([*[plan.schema[c] for c in names], T.StructField("output", T.StringType())])
    return plan.mapInArrow(run, schema)


def restore(transformed: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``transformed`` with ``restored``, the text before the transformation."""
    names = [c for c in transformed.columns if c not in (output_col, "restored")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, outputs in text_runs(batch, output_col):
                out, edge = _run(outputs)
                text = _strings(*gather(out, edge, _forms(part, form_col)))
                yield keep(part, [*names, output_col], {"restored": text}, {})

    fields = [transformed.schema[c] for c in [*names, output_col]]
    return transformed.select(*names, output_col).mapInArrow(
        run, T.StructType([*fields, T.StructField("restored", T.StringType())])
    )


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest of every document's output and of the text rebuilt from it."""
    return restore(transform(docs.select("doc_id", "text"))).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
