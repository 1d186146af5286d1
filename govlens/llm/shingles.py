"""Sets of word n-grams as sorted 64-bit hashes, for many texts at once in numpy.

Words are runs of anything but space and \\x09-\\x0D, with A-Z in lower case. A text's set
holds its distinct sequences of ``n`` words; with fewer words, but not none, the whole
sequence is the only member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 18  # a worker keeps 16 bytes for each byte, and needs some 30 more at a time
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < size:
        size = max(size, _SEGMENT + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = []
        for base in (_BASE, inverse):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS.append(np.multiply.accumulate(row))
    return _POWERS[0], _POWERS[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for every word of a text, in order; long texts go through in segments."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _SEGMENT)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        data = np.frombuffer(text[at:end], np.uint8)
        at = end
        space = _SPACE[data]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * inverse[starts]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of each text; empty for texts without words."""
    joined = [t.lower() for t in texts]  # bytes.lower changes A-Z only
    # one pass over all texts' bytes; the separator ends a word
    words = word_hashes(b"\n".join(joined))
    counts = [len(t.split()) for t in joined]
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams = mix(grams) + words[k : len(words) - n + 1 + k]
        grams = mix(grams)
    at = 0
    for count in counts:
        if count >= n:
            yield np.unique(grams[at : at + count - n + 1])
        elif count:
            h = np.full(1, count, np.uint64)
            for w in words[at : at + count]:
                h = mix(h * np.uint64(3)) + w
            yield mix(h)
        else:
            yield np.zeros(0, np.uint64)
        at += count
