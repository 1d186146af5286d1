"""Text quality by a byte-level convolutional network, written in numpy.

Bytes are embedded, learned filters run over every position of the text, responses are
max-pooled over overlapping chunks that cover the whole document, and the chunks' pooled
vectors (their mean and their maximum) and the logarithm of the first chunk's length go
into one logistic unit.

Learning takes at most ``rows_per_class`` labelled texts of up to ``max_chars`` characters
of either label and a few chunks of each text per step. Scoring reads every byte of
every text; memory depends on runs of about one megabyte.

Defined results: null and empty text are scored as one chunk of zero bytes. Without
labelled rows of both labels every score is 0.5. Rows repeat as in the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens.llm.common import fold, held, keep, text_runs
from govlens.llm.samples import labelled_sample

ROWS_PER_CLASS = 2000
MAX_CHARS = 20_000
HALF = 256  # a chunk is two halves, the next begins one half later
WIDTH, EMBED, FILTERS = 6, 8, 24
STEPS, BATCH, CHUNKS = 500, 48, 2
TILE = 1 << 15
THRESHOLD = 0.3


class Adam:
    """First-order updates with running moments."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(
                np.float32
            ),
            "shift": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS + 1, np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.fitted = False

    def _patches(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Embedded bytes of the windows that begin at positions ``at``."""
        return self.p["embed"][data[at[..., None] + np.arange(WIDTH)]].reshape(
            *at.shape, WIDTH * EMBED
        )

    def _responses(self, data: np.ndarray) -> np.ndarray:
        embedded = self.p["embed"][data]
        n = len(data) - WIDTH + 1
        flat = np.lib.stride_tricks.as_strided(
            embedded, (n, WIDTH * EMBED), (embedded.strides[0], embedded.strides[1])
        )
        return np.ascontiguousarray(flat) @ self.p["filter"]

    @staticmethod
    def _passage(text: bytes, rng: np.random.Generator) -> bytes:
        size = int(rng.integers(30, 2 * HALF))
        start = int(rng.integers(max(1, len(text) - size + 1)))
        return text[start : start + size]

    @staticmethod
    def _length(sizes: np.ndarray) -> np.ndarray:
        return np.log2(np.minimum(sizes, 2 * HALF) / (2 * HALF)).astype(np.float32)[:, None] / 4

    def fit(self, rows: list[tuple[bytes, int]], seed: int = 11) -> Network:
        good = [t for t, y in rows if y == 1]
        bad = [t for t, y in rows if y == 0]
        if not good or not bad:
            return self
        rng = np.random.default_rng(seed)
        adam = Adam(self.p, 0.01)
        size = 2 * HALF
        for step in range(STEPS):
            if step == STEPS * 2 // 3:
                adam.rate = 0.003
            texts = [good[k] for k in rng.integers(len(good), size=BATCH // 2)]
            texts += [bad[k] for k in rng.integers(len(bad), size=BATCH - BATCH // 2)]
            # one text in four is seen as a short passage, so that length alone says nothing
            texts = [t if rng.random() > 0.25 else self._passage(t, rng) for t in texts]
            truth = np.array([1.0] * (BATCH // 2) + [0.0] * (BATCH - BATCH // 2), np.float32)
            data = np.zeros((BATCH, CHUNKS, size + WIDTH - 1), np.uint8)
            valid = np.zeros((BATCH, CHUNKS), np.int64)
            for i, text in enumerate(texts):
                starts = np.arange(0, max(1, len(text) - HALF), HALF)
                chosen = rng.permutation(starts)[:CHUNKS]
                for j, start in enumerate(chosen):
                    piece = np.frombuffer(text[start : start + size], np.uint8)
                    data[i, j, : len(piece)] = piece
                    valid[i, j] = max(1, len(piece))
            flat = data.reshape(BATCH * CHUNKS, -1)
            count = valid.reshape(-1)
            response = self._responses(flat.reshape(-1))
            # windows over the seam of two chunks are not looked at
            full = np.full((len(flat), flat.shape[1], FILTERS), -np.inf, np.float32)
            full.reshape(-1, FILTERS)[: len(response)] = response
            for i, n in enumerate(count):
                full[i, n:] = -np.inf
            top = full.argmax(axis=1)
            pooled = np.take_along_axis(full, top[:, None, :], 1)[:, 0] + self.p["shift"]
            pooled[count == 0] = 0
            active = np.maximum(pooled, 0).reshape(BATCH, CHUNKS, FILTERS)
            some = (valid > 0).sum(axis=1)[:, None]
            mean = active.sum(axis=1) / some
            peak_at = active.argmax(axis=1)
            peak = np.take_along_axis(active, peak_at[:, None, :], 1)[:, 0]
            length = self._length(np.array([max(1, len(t)) for t in texts]))
            feature = np.concatenate([mean, peak, length], axis=1)
            error = (sigmoid(feature @ self.p["out"] + self.p["bias"]) - truth) / BATCH
            error = error.astype(np.float32)
            grads = {"out": feature.T @ error + 1e-4 * self.p["out"], "bias": error.sum(keepdims=True)}
            d_feature = error[:, None] * self.p["out"]
            d_active = np.repeat((d_feature[:, None, :FILTERS] / some[:, :, None]), CHUNKS, axis=1)
            peaks = np.zeros_like(d_active)
            np.put_along_axis(peaks, peak_at[:, None, :], d_feature[:, None, FILTERS : 2 * FILTERS], 1)
            d_pooled = ((d_active + peaks) * (active > 0)).reshape(-1, FILTERS)
            grads["shift"] = d_pooled.sum(axis=0)
            chunk, kernel = np.nonzero(d_pooled)
            amount = d_pooled[chunk, kernel]
            at = chunk * flat.shape[1] + top[chunk, kernel]
            source = flat.reshape(-1)
            patch = self._patches(source, at)
            d_filter = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
            np.add.at(d_filter, kernel, patch * amount[:, None])
            grads["filter"] = np.ascontiguousarray(d_filter.T)
            d_patch = (self.p["filter"].T[kernel] * amount[:, None]).reshape(-1, EMBED)
            letters = source[at[:, None] + np.arange(WIDTH)].reshape(-1)
            d_embed = np.zeros_like(self.p["embed"])
            np.add.at(d_embed, letters, d_patch)
            grads["embed"] = d_embed
            adam.update(grads)
        self.fitted = True
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), 0.5)
        pad = b"\0" * (WIDTH - 1)
        sizes = np.array([max(1, len(t)) for t in texts], np.int64)
        data = np.frombuffer(b"".join((t or b"\0") + pad for t in texts), np.uint8)
        starts = np.cumsum(sizes + WIDTH - 1) - (sizes + WIDTH - 1)
        halves = (sizes + HALF - 1) // HALF
        owner = np.repeat(np.arange(len(texts)), halves)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(halves) - halves, halves)
        begin = starts[owner] + nth * HALF
        end = np.minimum(begin + HALF, (starts + sizes)[owner])
        peaks = np.empty((len(owner), FILTERS), np.float32)
        lo = 0
        while lo < len(owner):
            hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + TILE, side="right")))
            base = begin[lo]
            response = self._responses(data[base : end[hi - 1] + WIDTH - 1])
            cuts = np.stack([begin[lo:hi], end[lo:hi]], axis=1).ravel() - base
            cuts = np.minimum(cuts, len(response) - 1)
            peaks[lo:hi] = np.maximum.reduceat(response, cuts, axis=0)[::2]
            # the very last half ends with the array, where a cut cannot stand
            last = begin[hi - 1] - base
            peaks[hi - 1] = response[last : end[hi - 1] - base].max(axis=0)
            lo = hi
        # a chunk is a half and the next one of the same text; a lone half is a chunk
        chunk = peaks.copy()
        joined = owner[1:] == owner[:-1]
        chunk[:-1][joined] = np.maximum(peaks[:-1], peaks[1:])[joined]
        tail = np.ones(len(owner), bool)
        tail[1:] = ~joined
        drop = np.zeros(len(owner), bool)
        drop[1:] = joined
        drop[:-1] &= ~joined  # only last halves that belong to the chunk before
        active = np.maximum(chunk + self.p["shift"], 0)
        active_used = active[~drop]
        who = owner[~drop]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        number = np.diff(np.r_[first, len(who)])[:, None]
        mean = np.add.reduceat(active_used, first, axis=0) / number
        peak = np.maximum.reduceat(active_used, first, axis=0)
        feature = np.concatenate([mean, peak, self._length(sizes)], axis=1)
        z = feature @ self.p["out"] + self.p["bias"]
        return sigmoid(z.astype(np.float64))


def scored(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with the model's score of every whole text; a column of that name is replaced."""
    docs = docs.drop("score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    token = uuid.uuid4().hex
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        own = held("network", token, lambda: shipped.value)
        for batch in batches:
            for part, texts in text_runs(batch, text_col):
                yield keep(part, names, {"score": own.score(texts)}, {"score": pa.float64()})

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's quality, learned from the folds that are not held out."""
    held_out = fold("doc_id", 5) == 0
    rows = labelled_sample(docs, labels, "quality", ROWS_PER_CLASS, MAX_CHARS, ~held_out)
    return scored(docs.select("doc_id", "text"), Network().fit(rows)).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
