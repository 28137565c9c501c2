"""Word shingles of whole texts as 64-bit hashes, computed over many texts at once.

Words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; a set holds the hashes of all runs of `words` words, or of the whole
sequence if there are fewer; a text without words has an empty set.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []
#: So many powers are kept.
_KEPT = (1 << 18) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(32)
    h *= _STEP
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""

    def made(size: int) -> list[np.ndarray]:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, out=x))
        return out

    if n > _KEPT:
        return tuple(made(n))
    if not _powers:
        _powers[:] = made(_KEPT)
    return _powers[0][:n], _powers[1][:n]


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word of all texts, and the one after its last."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = _WHITE[raw]
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    full = off[:-1][off[:-1] < off[1:]]
    before[full] = True
    after[off[1:][off[:-1] < off[1:]] - 1] = True
    return np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and how many words each text has."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    start, end = word_bounds(raw, off)
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[raw] * power, out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, off))


def shingle_hashes(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of all texts, in order, and how many each text has (repeated ones count)."""
    w, count = word_hashes(raw, off)
    if not len(w):
        return w, count
    first = np.concatenate([[0], np.cumsum(count)])
    many = np.maximum(count - words + 1, (count > 0).astype(np.int64))
    run = w.copy()
    for k in range(1, words):
        nxt = np.zeros_like(w)
        nxt[:-k] = w[k:]
        run = mix(run) + nxt
    out_first = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(count)), many)
    out = run[first[text] + np.arange(len(text)) - out_first[text]]
    for t in np.flatnonzero((count > 0) & (count < words)):
        h = np.array([count[t]], np.uint64)
        for i in range(first[t], first[t + 1]):
            h = mix(h) + w[i : i + 1]
        out[out_first[t]] = h[0]
    return mix(out), many


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int):
    """For each text its sorted distinct hashes."""
    h, many = shingle_hashes(raw, off, words)
    at = np.concatenate([[0], np.cumsum(many)])
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.unique(h[a:b])
