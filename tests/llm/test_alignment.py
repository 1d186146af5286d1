import collections
import hashlib
import random

import numpy as np
import pytest

from govlens.llm import alignment
from govlens.llm.alignment import Aligner, refined

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def libraries():
    a_path, b_path = alignment.vocabularies()
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return Aligner(a.read(), b.read())


def tokens(own, text):
    """Whole texts through both libraries: ids and decoded bytes, or nothing."""
    if not text:
        return [], []
    want = b" " + text.encode()
    a = own.a.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    piece = lambda table, at, k: table[at[k] : at[k + 1]].tobytes()
    a_bytes = [piece(own.a_bytes, own.a_at, k) for k in a]
    b_bytes = [piece(own.b_bytes, own.b_at, k) for k in b]
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return [], []
    return list(zip(a, a_bytes)), list(zip(b, b_bytes))


def spans(found):
    at = 0
    for k, piece in found:
        yield k, at, at + len(piece)
        at += len(piece)


def brute(own, texts):
    each, total = [], collections.Counter()
    for text in texts:
        a, b = (list(spans(t)) for t in tokens(own, text))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, lo = [], 0
        for hi in ends:
            side = [",".join(str(k) for k, s, e in t if lo <= s and e <= hi) for t in (a, b)]
            groups.append("|".join(side))
            lo = hi
        links, first = [], 0
        for k, s, e in a:  # spans ascend, so the first overlap only moves on
            while first < len(b) and b[first][2] <= s:
                first += 1
            j = first
            while j < len(b) and b[j][1] < e:
                links.append((k, b[j][0]))
                j += 1
        total.update(links)
        each.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = collections.Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [
        (
            n_a,
            n_b,
            n_groups,
            len(links),
            sum(total[p] == most[p[1]] for p in links),
            sum(total[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if n_a else "",
        )
        for n_a, n_b, n_groups, links, text in each
    ]


def odd_texts():
    rng = random.Random(5)
    parts = [
        "the", " ", "  ", "\n", "\t", "é", "中文", "😀", "don't", "'s", " 's", "x", "<|endoftext|>", "<s>", "<0x0A>",
        " ", "　", " ", "12345", "...", "_", "é", "́", "Ⅷ", "²", "\x00", "\x85", "naïve", "русский",
        " ı", "𓆫", "\r\n", "A", "—", "﻿", "İ",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(400)]
    return texts + [None, "", " ", "  ", "\n", "a", " a", "a ", "has ▁ mark", "same same", "same same", "word " * 3000]


def given_texts(n):
    return [
        r[0]
        for r in duckdb.sql(
            f"SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id LIMIT {n}"
        ).fetchall()
    ]


def check(spark, documents, own, texts):
    found = alignment.report(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == brute(own, texts)


def test_odd_texts(spark, documents, libraries):
    check(spark, documents, libraries, odd_texts())


def test_given_texts(spark, documents, libraries):
    check(spark, documents, libraries, given_texts(200))


def test_rare_pairs_are_joined(spark, documents, libraries, monkeypatch):
    """Few pairs fit the looked-up part; the join gives the rest the same sums."""
    monkeypatch.setattr(alignment.with_pair_sums, "__defaults__", (20,))
    check(spark, documents, libraries, given_texts(60) + odd_texts()[:60])


def test_small_runs_of_counts(spark, documents, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "FLUSH", 10)
    check(spark, documents, libraries, odd_texts()[:80])


def test_refined_cuts_are_the_decoded_lengths(libraries):
    texts = [t for t in odd_texts() if t and tokens(libraries, t)[0]]
    for text in texts:
        for unit in libraries.units(text.encode()):
            data, _ = alignment._flat([unit])
            for (ids, begin, end), at in (
                (libraries._spans_a(unit.decode(), data), libraries.a_at),
                (libraries._spans_b(unit.decode()), libraries.b_at),
            ):
                size = at[ids + 1] - at[ids]
                assert (refined(begin, end, size) == np.cumsum(size)).all(), unit


def test_bytes_that_are_no_text(libraries):
    libraries._clear()
    out = libraries.runs([b"good text", b"bad \xff\xfe text", b"good text"])
    sizes = out["a_ids"][1]
    assert sizes[1] == 0 and sizes[0] == sizes[2] > 0


def test_cache_is_emptied(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_BYTES", 50)
    texts = [t.encode() for t in odd_texts() if t]
    libraries._clear()
    small = [libraries.runs([t]) for t in texts]
    monkeypatch.setattr(alignment, "CACHED_BYTES", 1 << 30)
    libraries._clear()
    for text, before in zip(texts, small):
        for name, (values, sizes) in libraries.runs([text]).items():
            assert (values == before[name][0]).all() and (sizes == before[name][1]).all()


def test_lists_and_other_columns(spark, libraries):
    df = spark.createDataFrame([(1, "hello wörld", "mine")], "doc_id long, text string, a_ids string")
    row = alignment.align(df).first()
    assert row.a_ids == libraries.a.encode(" hello wörld").ids and row.b_ids == libraries.b.encode("hello wörld")
    assert sum(row.a_group) == len(row.a_ids) and sum(row.b_group) == len(row.b_ids)
    assert sum(row.links) == len(row.a_ids) + len(row.b_ids) - len(row.a_group)


def test_empty_tables(spark, documents):
    assert alignment.report(documents([])).count() == 0
    row = alignment.report(documents([(1, None)])).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")


def test_lengths_place_the_cuts_of_ordinary_text(libraries, monkeypatch):
    """Spans of the libraries are only asked for where tokens joined are not the text."""
    texts = ["Plain words, and some more of them.", "Größe naïve façade 12345 don't", "日本 ok"]
    libraries._clear()
    monkeypatch.setattr(Aligner, "_joined", staticmethod(lambda *a: None), raising=False)
    with_spans = libraries.runs([t.encode() for t in texts])
    monkeypatch.undo()
    libraries._clear()
    asked = []
    monkeypatch.setattr(Aligner, "_spans_a", lambda *a: asked.append(a))
    monkeypatch.setattr(Aligner, "_spans_b", lambda *a: asked.append(a))
    without = libraries.runs([t.encode() for t in texts])
    assert not asked
    for name in Aligner.NAMES:
        for x, y in zip(with_spans[name], without[name]):
            assert x.tolist() == y.tolist()
    libraries._clear()


def test_spans_of_both_libraries_cut_every_text(libraries, monkeypatch):
    """Ordinary text, too, is cut by the spans; cuts that are not the spans' are not made."""
    text = "Plain words, and some more of them."
    libraries._clear()
    read, seen = {n: getattr(Aligner, n) for n in ("_read_a", "_read_b")}, []
    for name, real in read.items():
        monkeypatch.setattr(Aligner, name, lambda *a, name=name, real=real: seen.append(name) or real(*a))
    out = libraries.runs([text.encode()])
    assert set(seen) == set(read) and out["a_ids"][0].tolist() == libraries.a.encode(" " + text).ids
    libraries._clear()

    def moved(self, text, data):  # one cut a byte early, in widths that no token has
        ids, begin, end = read["_read_a"](self, text, data)
        return ids, np.maximum(begin - 1, 0), np.where(end == end.max(), end, end - 1)

    monkeypatch.setattr(Aligner, "_read_a", moved)
    assert libraries.runs([text.encode()])["a_group"][0].tolist() != out["a_group"][0].tolist()
    libraries._clear()
