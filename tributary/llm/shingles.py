"""Word shingles of many documents at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from tributary.llm.pretokens import span_hashes

#: Words of a shingle.
WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's shingles end to end, in order, and how many each has.

    Words are runs of ASCII letters (without case), digits and non-ASCII bytes. A
    document of 1 to ``size`` words has one shingle, of all its words.
    """
    n = len(offsets) - 1
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edge = inside[1:] != inside[:-1]
    heads = offsets[1:-1]
    if len(heads):
        heads = heads[(heads > 0) & (heads < len(data))]
        cut = heads[inside[heads] & inside[heads + 1]]  # words of two documents that touch
    else:
        cut = heads
    places = np.flatnonzero(edge)
    starts, ends = places[0::2], places[1::2]
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    words = span_hashes(_LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    counts = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    # The place of each shingle's first word.
    ends_at = np.cumsum(counts)
    at = np.arange(int(counts.sum())) + np.repeat(first[:-1] - (ends_at - counts), counts)
    length = np.repeat(np.minimum(n_words, size), counts)
    out = np.zeros(len(at), np.uint64)
    short = bool((n_words < size).any())
    for k in range(size):
        part = padded[at + k] * _ODD[k]
        out += np.where(k < length, part, np.uint64(0)) if short else part
    return mix64(out), counts
