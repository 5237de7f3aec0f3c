"""Sets of word shingles as sorted 64-bit hashes, and MinHash values over them.

Words are runs of letters, digits and underscores, lower-cased. A text of fewer words than a shingle has,
but of one at least, is one shingle; a text without words has none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

WORDS = 5
#: Characters hashed at a time.
SEGMENT = 500_000
_NO_WORD = re.compile(r"\W").search
_BASE = 0x9E6C63D0876A9A63
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse for i < n, modulo 2 ** 64."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """Of each code point, whether it is a letter, a digit or an underscore."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a lower-cased text starts, and its hash: a polynomial of its code points, from running sums."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = _in_words()[code]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    up, down = powers(_BASE, 1 << max(20, len(code).bit_length()))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * up[: len(code)], out=total[1:])
    return first, mixed((total[end] - total[first]) * down[first])


def _segments(text: str) -> list[str]:
    """A long text cut between words."""
    out, at = [], 0
    while len(text) - at > 2 * SEGMENT and (m := _NO_WORD(text, at + SEGMENT)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order."""
    out: list[np.ndarray] = []
    part: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if part:
            first, hashes = _hashed("\n".join(part))
            ends = np.cumsum([len(t) + 1 for t in part])
            out.extend(np.split(hashes, np.searchsorted(first, ends[:-1])))
            part.clear()
            size = 0

    for text in texts:
        low = text.lower()
        if len(low) > SEGMENT:
            flush()
            out.append(np.concatenate([_hashed(s)[1] for s in _segments(low)]))
            continue
        if size + len(low) > SEGMENT:
            flush()
        part.append(low)
        size += len(low)
    flush()
    return out


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    out = []
    for w in word_hashes(texts):
        if len(w):
            n = max(1, len(w) - words + 1)
            h = np.zeros(n, np.uint64)
            for k in range(min(words, len(w))):
                h = mixed(h + _MIX) ^ w[k : k + n]
            w = np.unique(mixed(h))
        out.append(w)
    return out


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    return shingle_sets([text], words)[0]


def minhash_parameters(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def minhash(sets: list[np.ndarray], n: int) -> np.ndarray:
    """`n` 32-bit MinHash values of each non-empty set (sets x n)."""
    a, b = minhash_parameters(n)
    out = np.empty((len(sets), n), np.uint32)
    lo = 0
    while lo < len(sets):  # pieces that fit a cache
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= 50_000):
            total += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[lo : hi - 1]]])
        h = np.empty_like(low)
        for k in range(n):
            np.multiply(low, a[k], out=h)
            h += b[k]
            h ^= high
            h *= np.uint32(0x85EBCA6B)
            out[lo:hi, k] = np.minimum.reduceat(h, starts)
        lo = hi
    return out
