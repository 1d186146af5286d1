import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from govlens.llm import packing

TEXTS = [
    "Hello, world's end! don't. x" * 3,
    "",
    None,
    "É è ß, ». ﬁ\xa0a\x1cb ＡB̈ 12 345.6",
    "<|endoftext|>, a<|ENDOFTEXT|>. b <|startoftext|>",
    "word " * 5000,
    "a,b;c! it's!'s x,́ y",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary())


def test_ids_are_the_librarys(tokenizer):
    own = packing.Tokeniser(open(packing.vocabulary(), encoding="utf-8").read())
    texts = [(t or "") for t in TEXTS]
    for ids, text in zip(own.ids([t.encode() for t in texts]), texts):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_cache_may_overflow(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    own = packing.Tokeniser(open(packing.vocabulary(), encoding="utf-8").read())
    for text in ("a b c", "d e f g h", "a h b"):
        (ids,) = own.ids([text.encode()])
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_tightly(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.paretovariate(0.7))) for _ in range(rng.choice([0, 1, 50, 3000]))]
    plan = packing.Plan(dict(Counter(lengths)), 64)
    used = Counter()
    for parts, times in plan.kinds:
        assert times > 0 and sum(n * m for n, m in parts) <= 64
        for n, m in parts:
            used[n] += m * times
    assert used == Counter(lengths)
    taken = set()
    for length, count in Counter(lengths).items():
        for sequence, offset in zip(*plan.locate(length, np.arange(count))):
            cells = {(int(sequence), int(offset) + k) for k in range(length)}
            assert not cells & taken
            taken |= cells
    assert plan.sequences <= -(-sum(lengths) // 64) * 1.02 + 1


def test_pack_is_whole_gapless_and_tight(spark, documents, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 7)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["aa", "bb", "cc"], k=rng.randrange(900)))) for k in range(60)]
    rows += list(enumerate(TEXTS, 100)) + [(5, rows[5][1]), (None, "same"), (None, "same")]
    out = packing.report(documents(rows)).collect()
    by_doc, by_sequence = Counter(), {}
    want = Counter()
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    for r in out:
        by_doc[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_sequences_hold_the_ids(spark, documents):
    docs = documents([(1, "one two three"), (2, "four"), (3, None)]).select("doc_id", "text")
    pieces = packing.tokenise(docs, with_ids=True).cache()
    made = packing.sequences(packing.pack(pieces, ["doc_id", "piece"])).collect()
    whole = pieces.agg(F.sum("length")).first()[0]
    assert len(made) == 1 and len(made[0]["ids"]) == whole == sum(made[0]["lengths"])
    assert made[0]["ids"].count(0) == 3


def test_empty_table(documents):
    assert packing.report(documents([])).count() == 0


def test_plan_reaches_the_cluster_without_python_rows(spark, documents):
    """Python rows would start a second set of workers on each executor."""
    pieces = packing.tokenise(documents([(1, "a b c"), (2, "d e")]).select("doc_id", "text"))
    spark.createDataFrame(pieces.toArrow()).createOrReplaceTempView("pieces")
    packed = packing.pack(spark.table("pieces"), ["doc_id", "piece"])
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in packed.collect()) == [1, 2]
