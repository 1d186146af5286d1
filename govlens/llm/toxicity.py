"""Toxicity by a bidirectional gated recurrent network with attention, written in numpy.

Inputs of a step are a word's own vector (words seen often enough when learning) and the
mean of the vectors of its character n-grams (all words, whole however long). Both directions read windows of
``SPAN`` words that overlap and together cover the whole text; attention pools the states
of a window into one logit; a text is toxic unless none of its windows is:
p = 1 - prod(1 - p_window).

Learning takes at most ``rows_per_class`` labelled texts of up to ``max_chars`` characters of
either label. All windows of all texts are scored; the windows of a run of texts (about a
megabyte) go through the network in step, so memory does not depend on a text's length
beyond its own words.

Defined results: null text, empty text and text without words have no window, their score
is that of no evidence (0). Without labelled rows of both labels every score is 0. Rows
repeat as in the input.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import fold
from govlens.llm.quality import Adam, scored, sigmoid
from govlens.llm.samples import labelled_sample

ROWS_PER_CLASS = 2500
MAX_CHARS = 8_000
SPAN, STRIDE = 32, 24
HIDDEN, WORD, GRAM, POOL = 8, 8, 8, 8
VOCABULARY, SEEN_TIMES = 20_000, 4
BUCKETS = 1 << 14
STEPS, WINDOWS = 300, 1024
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def words(text: bytes) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower())


def grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of 3 to 5 bytes of all words, and each one's word."""
    raw = [b"^" + w.encode("utf-8", "replace") + b"$" for w in distinct]
    sizes = np.array([len(r) for r in raw])
    letters = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # bytes to the word's end
    buckets, owner = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(left >= n)
        value = np.full(len(at), n * 2654435761 % 2**32, np.uint32)
        for k in range(n):
            value = (value ^ letters[at + k]) * np.uint32(16777619)
        value ^= value >> np.uint32(15)
        buckets.append((value % np.uint32(BUCKETS)).astype(np.int32))
        owner.append(word[at])
    return np.concatenate(buckets), np.concatenate(owner)


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def init(*shape, scale=None):
            return rng.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)

        self.vocabulary: dict[str, int] = {}
        self.p = {
            "gram": init(BUCKETS, GRAM, scale=0.3),
            "attend": init(2 * HIDDEN, POOL),
            "attend_shift": np.zeros(POOL, np.float32),
            "focus": init(POOL),
            "out": init(2 * HIDDEN),
            "bias": np.full(1, -3, np.float32),
        }
        for way in ("f", "b"):
            self.p[f"in_{way}"] = init(WORD + GRAM, 3 * HIDDEN)
            self.p[f"shift_{way}"] = np.zeros(3 * HIDDEN, np.float32)
            self.p[f"rec_{way}"] = init(HIDDEN, 3 * HIDDEN)
        self.fitted = False

    def _inputs(self, distinct: list[str]):
        """Vectors of distinct words: own vector and mean of n-grams; a last row is padding."""
        own = np.array([self.vocabulary.get(w, 0) for w in distinct] + [0])
        x = np.zeros((len(distinct) + 1, WORD + GRAM), np.float32)
        x[:, :WORD] = self.p["word"][own]
        if not distinct:
            return x, own, None, None, None
        buckets, owner = grams(distinct)
        count = np.maximum(1, np.bincount(owner, minlength=len(distinct)))
        for j in range(GRAM):
            sums = np.bincount(owner, self.p["gram"][:, j][buckets], len(distinct))
            x[:-1, WORD + j] = sums / count
        return x, own, buckets, owner, count

    def _direction(self, way: str, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, tape=None):
        """Hidden states (steps, windows, HIDDEN) of one direction.

        ``gates``: input part of the gates for each distinct word; ``index``, ``mask``:
        (steps, windows). With a tape, what the backward pass needs is kept.
        """
        steps, n = index.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        rec = self.p[f"rec_{way}"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x = gates[index[t]]
            u = h @ rec
            zr = 1.0 / (1.0 + np.exp(-np.clip(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN], -30, 30)))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            before = h
            h = (c + z * (before - c)) * mask[t][:, None]
            out[t] = h
            if tape is not None:
                tape.append((t, before, z, r, c, u[:, 2 * HIDDEN :]))
        return out

    def _windows(self, numbers: list[np.ndarray], pad: int):
        """Windows of all texts: word numbers (SPAN, windows), which exist, and whose they are."""
        index, owner = [], []
        for k, ids in enumerate(numbers):
            if not len(ids):
                continue
            count = 1 + max(0, -(-(len(ids) - SPAN) // STRIDE))
            padded = np.full((count - 1) * STRIDE + SPAN, pad, np.int32)
            padded[: len(ids)] = ids
            index.append(np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::STRIDE])
            owner.append(np.full(count, k))
        if not index:
            return np.zeros((SPAN, 0), np.int32), np.zeros((SPAN, 0), np.float32), np.zeros(0, int)
        index = np.ascontiguousarray(np.concatenate(index).T)
        return index, (index != pad).astype(np.float32), np.concatenate(owner)

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        mixed = np.tanh(states @ self.p["attend"] + self.p["attend_shift"])
        weight = mixed @ self.p["focus"] + (mask - 1) * 30
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        return mixed, weight, pooled, pooled @ self.p["out"] + self.p["bias"]

    def fit(self, rows: list[tuple[bytes, int]], seed: int = 5) -> Network:
        split = [(words(t), y) for t, y in rows]
        toxic = [w for w, y in split if y == 1 and w]
        clean = [w for w, y in split if y == 0 and w]
        if not toxic or not clean:
            return self
        rng = np.random.default_rng(seed)
        seen = Counter(w for text, _ in split for w in set(text))
        known = [w for w, n in sorted(seen.items(), key=lambda i: (-i[1], i[0])) if n >= SEEN_TIMES]
        self.vocabulary = {w: k + 1 for k, w in enumerate(known[:VOCABULARY])}
        self.p["word"] = rng.normal(0, 0.3, (len(self.vocabulary) + 1, WORD)).astype(np.float32)
        self.p["word"][0] = 0
        adam = Adam(self.p, 0.01)
        for step in range(STEPS):
            if step == STEPS * 2 // 3:
                adam.rate = 0.003
            batch, truth, held = [], [], 0
            while held < WINDOWS:
                for source, y in ((toxic, 1), (clean, 0), (clean, 0)):
                    batch.append(source[rng.integers(len(source))])
                    truth.append(y)
                    held += 1 + len(batch[-1]) // STRIDE
            adam.update(self._gradients(batch, np.array(truth)))
            self.p["word"][0] = 0
        self.fitted = True
        return self

    def _gradients(self, batch: list[list[str]], truth: np.ndarray) -> dict[str, np.ndarray]:
        place: dict[str, int] = {}
        numbers = [
            np.array([place.setdefault(w, len(place)) for w in text], np.int32) for text in batch
        ]
        x, own, buckets, word, count = self._inputs(list(place))
        index, mask, owner = self._windows(numbers, len(place))
        tapes = {"f": [], "b": []}
        states = np.concatenate(
            [
                self._direction(way, x @ self.p[f"in_{way}"] + self.p[f"shift_{way}"], index, mask, tapes[way])
                for way in ("f", "b")
            ],
            axis=2,
        )
        mixed, weight, pooled, logit = self._pool(states, mask)
        p = sigmoid(logit)
        # minus log of the chance that no window is toxic
        none = np.bincount(owner, np.logaddexp(0, logit), len(batch))
        some = np.maximum(1e-6, -np.expm1(-none))
        push = np.where(truth == 1, -np.exp(-none) / some, 1.0) / len(batch)
        d_logit = (p * push[owner]).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_mixed = d_score[..., None] * self.p["focus"] * (1 - mixed * mixed)
        g["focus"] = np.einsum("tnp,tn->p", mixed, d_score)
        g["attend"] = states.reshape(-1, 2 * HIDDEN).T @ d_mixed.reshape(-1, POOL)
        g["attend_shift"] = d_mixed.sum(axis=(0, 1))
        d_states = weight[..., None] * d_pooled + d_mixed @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for k, way in enumerate(("f", "b")):
            d_gates = self._back(way, d_states[..., k * HIDDEN : (k + 1) * HIDDEN], tapes[way], mask, g)
            flat = index.ravel()
            sums = np.stack(
                [np.bincount(flat, d_gates[..., j].ravel(), len(x)) for j in range(3 * HIDDEN)], axis=1
            ).astype(np.float32)
            sums[-1] = 0
            g[f"in_{way}"] = x.T @ sums
            g[f"shift_{way}"] = sums.sum(axis=0)
            d_x += sums @ self.p[f"in_{way}"].T
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], own, d_x[:, :WORD])
        g["gram"] = np.zeros_like(self.p["gram"])
        share = d_x[:-1, WORD:] / count[:, None]
        for j in range(GRAM):
            g["gram"][:, j] = np.bincount(buckets, share[word, j], BUCKETS)
        return g

    def _back(self, way: str, d_out: np.ndarray, tape: list, mask: np.ndarray, g: dict) -> np.ndarray:
        rec = self.p[f"rec_{way}"]
        d_rec = np.zeros_like(rec)
        d_gates = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
        d_h = np.zeros((mask.shape[1], HIDDEN), np.float32)
        for t, before, z, r, c, u in reversed(tape):
            d_h = (d_h + d_out[t]) * mask[t][:, None]
            d_c = d_h * (1 - z) * (1 - c * c)
            d_z = d_h * (before - c) * z * (1 - z)
            d_r = d_c * u * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_rec += before.T @ d_u
            d_h = d_h * z + d_u @ rec.T
        g[f"rec_{way}"] = d_rec
        return d_gates

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        place: dict[str, int] = {}
        put = place.setdefault
        numbers = [
            np.array([put(w, len(place)) for w in words(t)], np.int32) for t in texts
        ]
        x = self._inputs(list(place))[0]
        gates = {w: x @ self.p[f"in_{w}"] + self.p[f"shift_{w}"] for w in ("f", "b")}
        index, mask, owner = self._windows(numbers, len(place))
        logits = np.zeros(len(owner), np.float64)
        for lo in range(0, len(owner), 4096):
            part = slice(lo, lo + 4096)
            at, on = index[:, part], mask[:, part]
            states = np.concatenate(
                [self._direction(w, gates[w], at, on) for w in ("f", "b")], axis=2
            )
            logits[part] = self._pool(states, on)[3]
        none = np.bincount(owner, np.logaddexp(0, logits), len(texts))
        return -np.expm1(-none)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's toxicity, learned from the folds that are not held out."""
    held_out = fold("doc_id", 4) == 2
    rows = labelled_sample(docs, labels, "toxic", ROWS_PER_CLASS, MAX_CHARS, ~held_out)
    return scored(docs.select("doc_id", "text"), Network().fit(rows)).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
