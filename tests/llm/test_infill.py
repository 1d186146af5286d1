import hashlib
import random

import numpy as np
import pytest

from govlens.llm import infill

MARK = {"P": "<P>", "S": "<S>", "M": "<M>"}


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in MARK.values()) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = {"P": text[:i], "M": text[i:j], "S": text[j:]}
    form = "spm" if h4 % 100 < 20 else "psm"
    order = "SPM" if form == "spm" else "PSM"
    return n, form, i, j - i, "".join(MARK[k] + parts[k] for k in order)


def rows():
    rng = random.Random(11)
    alphabet = "ab <>PSM\n" + "é中😀ß"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "a", "中", "<P>", "x<M>y", "<", "<<S", "same", "same", "z" * 5000 + "中" * 5000]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (7, texts[7]), (7, texts[7])]


@pytest.mark.parametrize("window", [3, 64, 1 << 20])
def test_scatter_and_gather(monkeypatch, window):
    monkeypatch.setattr(infill, "WINDOW", window)
    expected = [brute(*row) for row in rows()]
    texts = [(t or "").encode() for _, t in rows()]
    forms = np.array([("plain", "psm", "spm").index(e[1]) for e in expected])
    cuts = [np.array([e[k] or 0 for e in expected]) for k in (2, 3)]
    source, edge = infill._run(texts)
    out, out_edge = infill.scatter(source, edge, forms, *cuts)
    pieces = [out[a:b].tobytes().decode() for a, b in zip(out_edge, out_edge[1:])]
    assert pieces == [e[4] for e in expected]
    back, back_edge = infill.gather(out, out_edge, forms)
    assert back.tobytes() == source.tobytes() and (back_edge == edge).all()


def test_report(spark, documents):
    found = infill.report(documents(rows())).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = []
    for doc_id, text in rows():
        n, form, prefix, middle, output = brute(doc_id, text)
        expected.append((doc_id, n, form, prefix, middle, sha(output), sha(text)))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_outputs_and_other_columns(spark):
    df = spark.createDataFrame([(1, "hello wörld", "x", "y")], "doc_id long, text string, form string, n string")
    row = infill.restore(infill.transform(df)).first()
    assert row.restored == "hello wörld" and row.output == brute(1, "hello wörld")[4]


def test_other_seed_draws_otherwise(spark, documents):
    df = documents([(k, "some text of a length") for k in range(50)])
    a, b = (
        {r.doc_id: (r.form, r.prefix_chars) for r in infill.transform(df, seed=s).collect()} for s in "12"
    )
    assert a != b


def test_empty_table(spark, documents):
    assert infill.report(documents([])).count() == 0
