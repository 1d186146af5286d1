import random
import zlib

import corpus_pipeline
from tests.llm import test_decontaminate, test_ngram_join

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(tmp_path, spark, documents):
    rng = random.Random(9)
    rows = []
    for k in range(50):
        words = [f"word{rng.randrange(4000)}x{chr(97 + rng.randrange(26))}" for _ in range(rng.choice([4, 30, 120]))]
        rows.append((k, " ".join(words), rng.choice(["en", "de"]), f"s{k % 5}"))
    item = " ".join(f"bench{chr(97 + k)}" for k in range(20))
    rows += [(60, rows[1][1]), (61, rows[2][1] + " tail"), (62, "12 34"), (63, None), (64, "")]
    rows += [(65, f"start {item} end"), (66, "password = hunter2hunter2 is mine"), (None, "no id here")]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, item


def test_stages_and_run_against_brute_force(spark, documents, tmp_path):
    rows, item = make(tmp_path, spark, documents)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    # language: a letter is needed
    kept = {k for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    docs = STAGES["language_id"](spark, docs, str(tmp_path))
    assert docs.columns == COLUMNS and {r["doc_id"] for r in docs.collect()} == kept
    # near duplicates: the smallest id of each group
    groups = test_ngram_join.brute([(k, texts[k]) for k in kept])
    firsts = {c for _, _, c in groups}
    docs = STAGES["ngram_jaccard_join"](spark, docs, str(tmp_path))
    assert docs.columns == COLUMNS and {r["doc_id"] for r in docs.collect()} == firsts
    # contamination
    verdict = test_decontaminate.brute([(k, texts[k]) for k in firsts], [(1, item)])
    clean = {r[0] for r in verdict if not r[-1]}
    assert 65 in firsts - clean
    docs = STAGES["decontamination"](spark, docs, str(tmp_path))
    assert docs.columns == COLUMNS and {r["doc_id"] for r in docs.collect()} == clean
    # secrets
    docs = STAGES["secret_scan"](spark, docs, str(tmp_path)).cache()
    assert docs.columns == COLUMNS
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert after.pop(66) == "[secret:assign] is mine"
    assert after == {k: texts[k] for k in clean - {66}}
    # packing, and the whole run
    pieces = STAGES["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, pieces)) == sorted(map(key, whole))
    assert {r["doc_id"] for r in whole} == clean


def test_an_empty_table_goes_through(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_documents_without_any_label_go_through(spark, documents, tmp_path):
    rows = [(1, "some words of a clean text"), (2, "quite another one"), (3, "12 34"), (4, None), (5, ""), (6, "é")]
    docs = documents(rows, lang=None)
    kept = STAGES["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS and {r["doc_id"] for r in kept.collect()} == {1, 2, 6}
    # the only labelled document is in the held-out fold
    held = next(k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 4 == 2)
    docs = docs.unionByName(documents([(held, "labelled words")]))
    kept = STAGES["language_id"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 6, held}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2, 6, held}
