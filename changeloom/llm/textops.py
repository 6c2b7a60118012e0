"""Word hashing in Python workers: whole texts, in pieces of bounded size."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from .common import mix64

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text that are worked on at a time (a single longer text is one piece).
PIECE = 4 << 20


def pieces(texts):
    """Ranges (start, end) of ``texts`` of about PIECE bytes."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t is not None else 0
        if held >= PIECE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without \\x20 and \\x09-\\x0D, A-Z lower-cased) of all texts; offsets per text."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
    ends = np.cumsum([0] + [len(w) for w in words])
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(ends[-1])), ends


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a shorter text is one shingle as a whole."""
    h, ends = word_hashes(texts)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        rolled += mix64(h[j : j + len(rolled)] + np.uint64(j + 1)) * odd[j % 5]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix64(np.array([whole], np.uint64) * odd[0] + x)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
