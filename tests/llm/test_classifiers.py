import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from govlens.llm import quality, toxicity
from govlens.llm.samples import first_by_hash, labelled_sample

GOOD = ["the river runs", "a calm evening", "people walk home", "bread and butter"]
BAD = ["%%% $$$ ###", "BUY!! NOW!!", "click | here | click", "&&& win ***"]
TOXIC = ["stinker", "stinkers", "lowstink"]


def prose(rng, bad=False, words=40):
    return ". ".join(rng.choices(BAD if bad else GOOD, k=words // 3))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def auc(score, truth):
    order = np.argsort(np.argsort(score))
    truth = np.array(truth, bool)
    return (order[truth].mean() - order[~truth].mean()) / len(truth) + 0.5


def test_numeric_gradients_of_the_recurrent_network():
    rng = random.Random(0)
    net = toxicity.Network()
    texts = [toxicity.words(prose(rng).encode()) + ["stinker"] * (k % 2) for k in range(4)] + [["one"], ["a"] * 70]
    truth = np.array([k % 2 for k in range(6)])
    net.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
    net.p["word"] = np.random.default_rng(1).normal(0, 0.3, (len(net.vocabulary) + 1, 8))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grads = net._gradients(texts, truth)

    def loss():
        net.fitted = True
        score = net.score([" ".join(t).encode() for t in texts])
        return -np.where(truth == 1, np.log(score), np.log1p(-score)).mean()

    for name in ("out", "bias", "focus", "attend", "rec_f", "rec_b", "in_f", "shift_b", "word"):
        flat, own = net.p[name].reshape(-1), grads[name].reshape(-1)
        for at in np.argsort(-np.abs(own))[:2]:
            was, step = flat[at], 1e-3
            flat[at] = was + step
            up = loss()
            flat[at] = was - step
            down = loss()
            flat[at] = was
            assert own[at] == pytest.approx((up - down) / 2 / step, rel=0.05, abs=1e-4), name


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 150)
    monkeypatch.setattr(toxicity, "STEPS", 120)
    monkeypatch.setattr(toxicity, "WINDOWS", 128)


def table(spark, documents, kind):
    rng, rows, marks = random.Random(7), [], []
    for k in range(240):
        one = rng.random() < 0.5
        text = prose(rng, bad=kind == "quality" and not one, words=rng.choice([9, 40, 600]))
        if kind == "toxic" and one:
            words = text.split()
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
            text = " ".join(words)
        rows.append((k, text))
        marks.append((k, int(one), int(one), "x"))
    odd = [(900, None), (901, ""), (902, " . "), (None, "bread"), (3, rows[3][1])]
    odd_marks = [(900, 1, 1, "x"), (None, 0, 0, "x"), (5, None, None, "x"), (7777, 1, 0, "x")]
    return documents(rows + odd), labels(spark, marks + odd_marks), dict((m[0], m[1]) for m in marks)


@pytest.mark.parametrize(
    "kind, report, folds, held", [("quality", quality.report, 5, 0), ("toxic", toxicity.report, 4, 2)]
)
def test_held_out_accuracy_and_odd_rows(spark, documents, quick, kind, report, folds, held):
    docs, marks, truth = table(spark, documents, kind)
    out = report(docs, marks).collect()
    assert len(out) == 245 and {tuple(r.asDict()) for r in out} == {("doc_id", "held_out", "score", "predicted")}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
    test = [r for r in out if r["doc_id"] in truth and r["held_out"]]
    assert auc([r["score"] for r in test], [truth[r["doc_id"]] for r in test]) > 0.95
    three = [r["score"] for r in out if r["doc_id"] == 3]
    assert len(three) == 2 and three[0] == pytest.approx(three[1], abs=1e-6)


def test_scores_do_not_depend_on_neighbours(quick):
    rng = random.Random(2)
    rows = [(prose(rng, bad=k % 2 == 1, words=60).encode(), 1 - k % 2) for k in range(40)]
    texts = [b"", b"a", b"x" * 256, b"y" * 257, b"z" * 513, prose(rng, words=900).encode()]
    net = quality.Network().fit(rows)
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], atol=1e-5)
    net = toxicity.Network().fit(rows)
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], atol=1e-5)


def test_whole_texts_are_scored(quick):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        words = prose(rng, words=60).split()
        if k % 2:
            words.insert(rng.randrange(len(words)), "stinker")
        rows.append((" ".join(words).encode(), k % 2))
    net = toxicity.Network().fit(rows)
    clean = prose(rng, words=3000)
    low, high = net.score([clean.encode(), (clean + " stinker").encode()])
    assert high > low and high > 0.3


def test_words_are_read_to_their_end(quick):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        words = prose(rng, words=60).split()
        if k % 2:
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
        rows.append((" ".join(words).encode(), k % 2))
    net = toxicity.Network().fit(rows)
    for text in ("people_walk_home_and_the_river_runs_{}", "people" * 4 + "{}", "река" * 4 + "_{}"):
        low, high = net.score([text.format(w).encode() for w in ("evening", "stinkers")])
        assert high > low + 1e-4, text
    owner = toxicity.grams(["ab", "x" * 5000, "é"])[1]
    assert np.bincount(owner).tolist() == [3, 3 * 5002 - 9, 3]


def test_without_labels(spark, documents):
    docs, none = documents([(1, "a b"), (2, None)]), labels(spark, [(1, 1, 1, "x")])
    assert [r["score"] for r in quality.report(docs, none).collect()] == [0.5, 0.5]
    assert [r["score"] for r in toxicity.report(docs, none).collect()] == [0.0, 0.0]
    assert quality.report(documents([]), none).count() == 0


def test_samples_are_bounded(spark, documents):
    rows = spark.range(20_000).select(
        F.xxhash64("id").alias("order"), F.when(F.col("id") < 19_000, "big").otherwise("small").alias("by")
    )
    counts = first_by_hash(rows, "by", "order", 50).groupBy("by").count().collect()
    assert {r["by"]: r["count"] for r in counts} == {"big": 50, "small": 50}
    docs = documents([(k, f"text {k}") for k in range(50)])
    marks = labels(spark, [(k, k % 2, 0, "x") for k in range(50)])
    sample = labelled_sample(docs, marks, "quality", 7, 100, F.col("doc_id") >= 10)
    assert len(sample) == 14 and all(int(t.split()[1]) >= 10 for t, _ in sample)
