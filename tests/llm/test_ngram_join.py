import random
import re

import numpy as np
import pytest

from govlens.llm import ngram_join
from govlens.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def brute_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """doc rows -> (id, set size, smallest id reachable), by all pairs."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((doc_id, len(sets[k]), min(group) if group else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, ngram_join.report(df).collect()), key=str)


def test_sets_match_the_definition():
    texts = ["", "one", "A b  c\td", "a b c d e", "É é A\x0bb\x1cc d e f G", "x " * 50, "w" * 3000]
    sets = list(shingle_sets([t.encode() for t in texts]))
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]


def test_long_texts_go_through_in_segments():
    text = (" ".join(f"w{k}" for k in range(400_000))).encode()
    hashes = word_hashes(text)
    assert len(hashes) == 400_000 == len(set(hashes.tolist()))
    assert hashes[123_456] == word_hashes(b"w123456")[0]


def test_against_all_pairs(documents):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    rows = []
    for k in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 9, 60, 200]))
        if k % 3 == 0:
            base = base + passage
        rows.append((1000 - len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(copy).upper()))
    rows += [(None, rows[3][1]), (5, ""), (6, None), (7, " \t"), (8, ""), (9, rows[0][1]), (9, rows[0][1])]
    assert found(documents(rows)) == brute(rows)


def test_chain_of_near_copies(documents):
    """Neighbours of a chain are alike, its ends are not."""
    words = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(30):
        words = words[4:] + [f"n{k}_{j}" for j in range(4)]
        rows.append((k, " ".join(words)))
    assert {r[2] for r in found(documents(rows))} == {0} and found(documents(rows)) == brute(rows)


def test_large_tiles_are_cut_into_blocks(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rng = random.Random(1)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(50):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            copy[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(copy)))
    assert found(documents(rows)) == brute(rows)


def near_misses(rows, edits):
    """A text's copies, each with ``edits`` words of its own: like the text or not, never like each other."""
    rng = random.Random(2)
    base = [f"b{k}" for k in range(150)]
    out = [(k, " ".join(base + [f"e{k}"])) for k in range(3)]
    for k in range(3, rows):
        copy = list(base)
        for at in rng.sample(range(150), edits[k % len(edits)]):
            copy[at] = f"x{k}_{at}"
        out.append((k, " ".join(copy)))
    return out


def test_tiles_give_a_forest_not_all_pairs(documents, monkeypatch):
    """What meets grows with a group's rows, not with their square."""
    met, tiles = [], ngram_join._tiles
    monkeypatch.setattr(ngram_join, "_tiles", lambda *a: met.append(tiles(*a)) or met[0])
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rows = near_misses(240, [2, 3, 4])
    assert found(documents(rows)) == brute(rows)
    assert met[0].count() < 4 * len(rows)


@pytest.mark.parametrize("members", [1 << 20, 1000])
def test_groups_are_cut_into_blocks_of_rows_and_members(documents, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "TILE_MEMBERS", members)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rows = near_misses(90, [1, 2, 3, 4])
    rows += [(k + 100, t.replace("b1 ", f"y{k} ")) for k, t in rows[3:60]]
    assert found(documents(rows)) == brute(rows)


def test_a_forest_that_forgets_only_repeats(monkeypatch):
    monkeypatch.setattr(ngram_join.Forest, "MOST", 2)
    forest = ngram_join.Forest()
    edges = [(a, b) for a in range(6) for b in range(a) if forest.join(a, b)]
    kept = ngram_join.Forest()
    monkeypatch.setattr(ngram_join.Forest, "MOST", 100)
    for edge in edges:
        kept.join(*edge)
    assert {kept.root(k) for k in range(6)} == {0}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c d e f")]])
def test_nothing_to_join(documents, rows):
    assert found(documents(rows)) == brute(rows)


def test_representatives_keep_one_row_of_each(documents):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(4, text), (2, text), (2, text), (7, text + " end"), (9, "other words"), (None, ""), (None, None)]
    kept = ngram_join.representatives(documents(rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(
        [(2, text), (9, "other words"), (None, ""), (None, None)], key=str
    )


def test_members_are_packed_in_seven_bytes_and_meet_with_all_they_may():
    """A small set finds larger ones by its first members, so rows that cannot meet are not dealt."""
    rng = np.random.default_rng(3)
    member = rng.integers(0, 300, 2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row = rng.integers(0, 1 << 34, 2000)
    band, first = rng.integers(0, 6, 2000).astype(np.uint8), rng.random(2000) < 0.4
    half = [(x[:900], x[900:]) for x in (member, row, band | first * np.uint8(128))]
    sent = [b for part in zip(*half) for b in ngram_join._packed([part], 8)]
    payload = sum(len(v) for b in sent for k in (2, 3, 4) for v in b.column(k).to_pylist())
    assert payload == 7 * 2000
    held = {}
    for b in sent:
        for bucket, *rest in zip(*(b.column(k).to_pylist() for k in range(5))):
            held.setdefault(bucket, []).append(rest)
    tiles = [t for bucket in sorted(held) for b in ngram_join._tiled(bucket, held[bucket]) for t in b.to_pylist()]
    met = {}
    for t in tiles:
        met.setdefault((t["member"], t["tile"]), set()).add((t["node"], t["upper"]))
    together = {frozenset((a, b)) for t in met.values() for a, _ in t for b, up in t if up and a != b}
    for a in range(2000):
        for b in np.flatnonzero(member == member[a]):
            # a smaller or equal set that holds the member among its first ones meets the larger one
            if a != b and first[a] and 0 <= int(band[b]) - int(band[a]) <= 1:
                assert frozenset((int(row[a]), int(row[b]))) in together
    assert all(t["upper"] or t["first"] for t in tiles) and all(len(t) > 1 for t in met.values())
