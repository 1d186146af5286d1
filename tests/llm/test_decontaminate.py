import hashlib
import re

from pyspark.sql import functions as F

from govlens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for window, owners in windows.items():
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append(
            (doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
        )
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


LONG = " ".join(f"q{k}" for k in range(30))
ITEMS = [(1, LONG), (20, "Short, item é here"), (3, None), (4, "..."), (None, "a b"), (5, LONG), (6, "q3")]
DOCS = [
    (1, "intro " + LONG.upper().replace(" ", ", ") + " end"),
    (2, "say short-item É... here! and shortitem é here"),
    (3, "say short-item é... here! " + "filler " * 200),
    (4, " ".join(f"q{k}" for k in range(4, 16))),
    (5, None),
    (6, ""),
    (7, "!!!"),
    (1, "q3"),
    (None, "x " + " ".join(f"q{k}" for k in range(10, 24)) + " q3 " + "tail " * 400),
    (9, "nothing of it"),
]


def test_against_brute_force(spark, documents):
    found = decontaminate.report(documents(DOCS), benchmark(spark, ITEMS)).collect()
    assert sorted(map(tuple, found), key=str) == brute(DOCS, ITEMS)


def test_blocks_of_items_give_the_same(spark, documents):
    docs = documents(DOCS).select("doc_id", "text")
    whole = decontaminate.decontaminate(docs, benchmark(spark, ITEMS))
    parts = decontaminate.decontaminate(docs, benchmark(spark, ITEMS), block_bytes=1)
    assert sorted(whole.collect(), key=str) == sorted(parts.collect(), key=str)


def test_one_block_takes_one_worker_a_task(spark, documents):
    found = decontaminate.decontaminate(documents(DOCS), benchmark(spark, ITEMS))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_spans_lie_in_the_original(spark, documents):
    rows = decontaminate.decontaminate(documents(DOCS), benchmark(spark, ITEMS)).collect()
    for row in rows:
        for start, end in row["contamination"]["spans"]:
            piece = words(row["text"][start:end])
            assert piece and row["text"][start:end].strip() == row["text"][start:end]
        covered = sum(len(words(row["text"][a:b])) for a, b in row["contamination"]["spans"])
        assert covered == row["contamination"]["n_hit"]


def test_empty_tables(spark, documents):
    none = decontaminate.report(documents(DOCS[:2]), benchmark(spark, [])).collect()
    assert [(r["n_hit"], r["contaminated"]) for r in none] == [(0, False)] * 2
    assert decontaminate.report(documents([]), benchmark(spark, ITEMS)).count() == 0


def test_clashing_column_is_replaced(spark, documents):
    docs = documents(DOCS[:1]).withColumn("contamination", F.lit("old"))
    row = decontaminate.decontaminate(docs, benchmark(spark, ITEMS)).first()
    assert row["contamination"]["n_hit"] == 30 and row["source"] == "s0"
