"""Words and 5-word shingles of whole texts as 64-bit hashes, in numpy.

A word is a run of anything but space and tab..carriage return, with A-Z in
lower case. A text of fewer words than a shingle has its whole word sequence as
its one shingle; a text without words has none. Equal words and shingles have
equal hashes; different ones collide with a chance of about 2 ** -64 a pair.
"""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WIDTH = 5
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xD6E8FEB86659FD93 << k)) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(WIDTH)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finisher)."""
    x = (x ^ (x >> np.uint64(30))) * _K[2]
    x = (x ^ (x >> np.uint64(27))) * _K[3]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of every word in order."""
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    gap = (code == 32) | ((code >= 9) & (code <= 13))
    at = np.flatnonzero(~gap)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    size = np.diff(np.append(first, len(at)))
    c = code[at]
    c = (c + np.where((c >= 65) & (c <= 90), np.uint32(32), np.uint32(0))).astype(np.uint64)
    # a word's hash is the sum of hashes of (character, place in the word)
    place = (np.arange(len(at)) - np.repeat(first, size)).astype(np.uint64)
    return mix(np.add.reduceat(mix(c * _K[0] + place * _K[1]), first) + size.astype(np.uint64))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hash of every shingle in order, repeats included."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        whole = np.full(1, n, np.uint64)
        for k in range(n):
            whole = whole * _K[3] + words[k : k + 1] * _ODD[k]
        return mix(whole)
    total = words[: n - WIDTH + 1] * _ODD[0]
    for k in range(1, WIDTH):
        total = total + words[k : n - WIDTH + 1 + k] * _ODD[k]
    return mix(total)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text))
