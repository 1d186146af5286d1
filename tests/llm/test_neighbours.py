import numpy as np
import pytest

from govlens.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def brute(rows, k=10):
    good = [
        (i, np.array(v, np.float32).astype(float))
        for i, v, *_ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q)
            out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=32).tolist(), 0, "x") for k in range(1500)]
    got, want = found(neighbours.report(table(spark, rows))), brute(rows)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q in want for s, i in got[q]}
    for (q, i), s in exact.items():
        x, y = (np.array(rows[n][1], np.float32).astype(float) for n in (q, i))
        assert s == pytest.approx(np.sqrt(((x - y) ** 2).sum()), rel=1e-12)


def test_small_odd_tables_are_exact(spark):
    rows = [(k, [float(k % 7), 1.0, float(k)], 0, "x") for k in range(40)]
    rows += [(100, None, 0, "x"), (200, [], 0, "x"), (300, [0.0, 0.0, 0.0], 0, "x")]
    rows += [(400, [1.0, None, 2.0], 0, "x"), (500, [1.0, float("nan"), 2.0], 0, "x")]
    rows += [(600, [1.0, float("inf"), 2.0], 0, "x"), (None, [1.0, 1.0, 1.0], 0, "x")]
    rows += [(700, [3.0, 1.0, 3.0], 0, "x")]
    got, want = found(neighbours.report(table(spark, rows))), brute(rows)
    assert got == want and set(got) == {0, 700}


def test_one_vector_that_fills_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rows = [(k, [1.0, 2.0], 0, "x") for k in range(301)] + [(1000, [5.0, 5.0], 0, "x")]
    got = found(neighbours.report(table(spark, rows)))
    assert [i for _, i in got[100]] == list(range(10)) and {s for s, _ in got[100]} == {0.0}
    assert [i for _, i in got[1000]] == list(range(10))


def test_fewer_than_ten_and_none(spark):
    rows = [(0, [1.0, 0.0], 0, "x"), (3, [0.0, 1.0], 0, "x"), (3, [0.0, 1.0], 0, "x")]
    assert found(neighbours.report(table(spark, rows))) == {0: [(2**0.5, 3)] * 2}
    assert neighbours.report(table(spark, [])).count() == 0


def test_another_dimension_changes_nothing_for_the_rest(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).tolist(), 0, "x") for k in range(301)]
    alone = found(neighbours.report(table(spark, rows)))
    odd = [(1000, [1.0, 2.0, 3.0], 0, "x"), (1100, [1.0, 2.0, 5.0], 0, "x")]
    both = found(neighbours.report(table(spark, rows + odd)))
    assert {q: both[q] for q in alone} == alone and set(alone) == {0, 100, 200, 300}
    assert both[1000] == [(2.0, 1100)] and both[1100] == [(2.0, 1000)]


@pytest.mark.parametrize("clusters, part", [(1, 0.0), (1, 0.33), (20, 0.9)])
def test_at_most_a_fifth_of_the_rows_is_reranked(clusters, part):
    """One block with all rows, as if each query read every file."""
    rng = np.random.default_rng(3)
    n, d = 6000, 64
    vecs = rng.normal(size=(n, d))
    hot = rng.random(n) < part
    centres = rng.normal(size=(clusters, d))
    vecs[hot] = (centres[rng.integers(clusters, size=n)] + 0.1 * rng.normal(size=(n, d)))[hot]
    sample = vecs[rng.choice(n, neighbours.SAMPLE * neighbours.PIVOTS, replace=False)]
    base = sample[neighbours.farthest_first(sample, neighbours.PIVOTS)]
    near = neighbours.orders(vecs, base)
    known = neighbours.places(neighbours.orders(sample, base), len(base))
    asked = rng.choice(n, 60, replace=False)
    place = neighbours.places(near[asked], len(base))
    hits = looked = 0
    for q, own, cut in zip(asked, place, neighbours.cuts(place, known, neighbours.SHARE)):
        kept = neighbours.footrule(neighbours.places(near, len(base)), own) <= cut
        looked += kept.sum()
        distance = ((vecs - vecs[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        hits += kept[np.argsort(distance)[:10]].sum()
    assert looked <= 0.2 * n * len(asked) and hits >= 0.9 * 10 * len(asked)


def test_recall_with_hot_clusters_of_near_copies(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for clusters, part in ((1, 0.33), (20, 0.9)):
        n = 4000
        vecs = unit(rng.normal(size=(n, 64)))
        hot = rng.random(n) < part
        centres = unit(rng.normal(size=(clusters, 64)))
        near = centres[rng.integers(clusters, size=n)] + 0.01 * rng.normal(size=(n, 64))
        vecs[hot] = unit(near)[hot]
        rows = [(k, v.tolist(), 0, "x") for k, v in enumerate(vecs)]
        got, want = found(neighbours.report(table(spark, rows))), brute(rows)
        for kind in (True, False):
            asked = [q for q in want if hot[q] == kind]
            hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in asked)
            assert hits >= 0.97 * 10 * len(asked), (clusters, kind)
