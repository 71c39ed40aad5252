"""Vectorised pre-tokenisation: where the words of byte-level BPE begin.

The rule is the public pattern of the 50k byte-level vocabularies::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

worked out with array operations over the bytes of many documents at once.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)
EDGE = 255
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of each character of valid UTF-8."""
    if not len(data) or data.max() < 0x80:
        return np.arange(len(data)), data
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    rest = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        which = np.flatnonzero((points >= low) & (points < high) & (data[at] >= 0xC0))
        value = points[which] & mask
        for k in range(1, more + 1):
            value = (value << 6) | (rest[at[which] + k] & 0x3F)
        points[which] = value | (1 << 30)
    return at, points & ((1 << 30) - 1)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which words start; documents are ``data[offsets[i]:offsets[i + 1]]``."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, points = code_points(data)
    n = len(at)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads if n == len(data) else np.searchsorted(at, heads)] = True
    first[n] = True
    before = np.empty_like(kind)
    before[0] = EDGE
    before[1:] = kind[:-1]
    before[first[:n]] = EDGE
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[first[1:]] = EDGE
    white = kind == SPACE
    blank = points == 0x20
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1]
    joined &= before == SPACE
    start = np.where(white, (before != SPACE) | ((after != SPACE) & (after != EDGE)), (kind != before) & ~joined)
    quotes = np.flatnonzero((points == 0x27) & start)
    if len(quotes):
        wide = np.concatenate([points.astype(np.int32), np.zeros(3, np.int32)])
        edge = np.concatenate([first, np.ones(3, bool)])
        one, two = np.where(edge[quotes + 1], 0, wide[quotes + 1]), np.where(edge[quotes + 1] | edge[quotes + 2], 0, wide[quotes + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, size in ((quotes[short], 2), (quotes[long], 3)):
            start[which + 1] = False
            ends = which + size
            start[ends[ends < n]] = True
    return at[start]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (_P, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        have = both[0], both[1]
        if size <= 8 << 20:
            _POWERS[0] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, all from one running sum."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out
