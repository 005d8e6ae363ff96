"""Five-word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import functools

import numpy as np

SIZE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up = np.cumprod(np.full(size, _BASE, np.uint64))
    down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (ASCII letters in lower case), and words of each text."""
    joined = b"\n".join([b"", *texts, b""])
    raw = np.frombuffer(joined.translate(_LOWER), np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers(1 << max(21, int(len(raw)).bit_length()))
    total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])
    words = mixed((total[ends - 1] - total[starts - 1]) * down[starts])
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, begins))
    return words, counts


def shingle_sets(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often each occurs there, and how many each text has.

    A text of fewer words than a shingle has one shingle of all of them; a text
    without words has none.
    """
    words, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    n = np.maximum(counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    most = np.repeat(np.minimum(counts, size), n)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = most > k
        if inside.all():
            h += words[at + k] * np.uint64(_STEP[k])
        else:
            h[inside] += words[at[inside] + k] * np.uint64(_STEP[k])
    h = mixed(h)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    where = np.flatnonzero(new)
    return h[where], np.diff(np.append(where, len(h))), np.bincount(owner[where], minlength=len(texts))
