import random

import numpy as np

from govlens.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ver", "öß", "ung"], "cc": ["eau", "ré", "ça", "lo"]}


def text(lang, rng, words):
    return " ".join(
        "".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words)
    )


def longest_phrases(source, target):
    """Cross-parsing by search: phrases of ``target`` that occur in ``source``."""
    count, at = 0, 0
    while at < len(target):
        size = 0
        while at + size < len(target) and target[at : at + size + 1] in source:
            size += 1
        at += max(1, size)
        count += 1
    return count


def test_phrases_match_a_search(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 10_000)
    rng = random.Random(0)
    model = language.Model({"aa": [text("aa", rng, 60)], "bb": [text("bb", rng, 60)]}, 400)
    texts = [text("aa", rng, 30), text("bb", rng, 1), "kalomi kaloschverx!", "x", "öß  12 öß"]
    counts, lettered = model.phrases(texts)
    assert lettered.all()
    for k, lang in enumerate(("aa", "bb")):
        rng = random.Random(0)
        first = text("aa", rng, 60)
        own = first if lang == "aa" else text("bb", rng, 60)
        points = language.normal(language.code_points(own))[:200]
        source = "".join(map(chr, points)) + " "
        for j, t in enumerate(texts):
            target = "".join(map(chr, language.normal(language.code_points(t))))
            assert counts[k][j] == longest_phrases(source, target), (lang, t)


def test_pieces_do_not_change_who_wins(spark):
    rng = random.Random(1)
    model = language.Model({k: [text(k, rng, 200)] for k in SYLLABLES})
    long = [text(k, rng, 3000) for k in SYLLABLES]
    assert model.predict(long)[0] == list(SYLLABLES)
    assert model.predict([long[1] + long[1] + long[0]])[0] == ["bb"]


def test_learned_languages_and_odd_rows(documents):
    rng = random.Random(5)
    rows = [(k, text(l, rng, 40), l) for k, l in enumerate(list(SYLLABLES) * 40)]
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "12 !", "aa"), (None, "verschöß", None), (1, "Ж", "cc")]
    out = language.report(documents(rows + odd)).collect()
    assert len(out) == len(rows) + len(odd)
    right = [r["lang_pred"] == list(SYLLABLES)[r["doc_id"] % 3] for r in out if r["doc_id"] is not None and 1 < r["doc_id"] < 500]
    assert np.mean(right) == 1.0
    assert all(0 <= r["score"] <= 1 for r in out)
    und = {r["doc_id"]: r["score"] for r in out if r["lang_pred"] == "und"}
    assert und == {500: 0.0, 501: 0.0, 502: 0.0}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)


def test_without_labels(documents):
    out = language.report(documents([(1, "some text", None), (2, "more", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)] * 2
    assert language.report(documents([])).count() == 0


def test_wide_alphabets():
    rng = random.Random(3)
    wide = {f"w{k}": [chr(0x4E00 + 1000 * k + s) for s in range(1000)] for k in range(4)}

    def words(lang, n):
        return "".join(rng.choices(wide[lang], k=n))

    passages = {k: [words(k, 400) for _ in range(100)] for k in wide}
    model = language.Model(passages)
    assert len(model.table) <= language.TABLE_ENTRIES and len(model.table) == len(model.ended)
    names, scores = model.predict([words(k, 60) for k in wide for _ in range(5)])
    assert names == [k for k in wide for _ in range(5)] and min(scores) > 0.99
    # a bound below one passage still learns something of each, and no more than it allows
    tiny = language.Model({**passages, "aa": [text("aa", rng, 60)]}, table_entries=5 * 4000)
    assert len(tiny.table) <= 5 * 4000
    assert tiny.predict([text("aa", rng, 40)])[0] == ["aa"]


def test_sample_takes_the_first_by_hash_of_large_and_small_values(spark):
    from pyspark.sql import functions as F

    from govlens.llm.samples import first_by_hash

    rows = spark.range(5000).select(
        F.when(F.col("id") < 4900, "hot").when(F.col("id") < 4990, "mid").when(F.col("id") < 4999, "few").alias("by"),
        F.xxhash64("id").alias("order"),
    )
    got = first_by_hash(rows, "by", "order", 20)
    want: dict[str, list[int]] = {}
    for r in rows.collect():
        want.setdefault(r["by"], []).append(r["order"])
    assert {(r["by"], r["nth"], r["order"]) for r in got.collect()} == {
        (by, k + 1, order) for by, all_ in want.items() if by for k, order in enumerate(sorted(all_)[:20])
    }
    assert first_by_hash(rows.limit(0), "by", "order", 20).count() == 0
