"""Word shingles as sorted 64-bit sets, and fast similarity sketches of them.

Edge cases: a null text and one without words have the empty set, which is not sketched; a text of fewer words than a
shingle is one shingle; repeated shingles count once; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from .bpe_core import Memo

# fixed values: odd multipliers of a 64-bit finaliser
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

word_hash = Memo(xxhash.xxh3_64_intdigest)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a whole text, hashed and sorted.

    Words are runs of bytes other than space and 09 to 0D, A-Z lowered.  A text of fewer words is one shingle, of its
    own kind for each number of words; a text without words has none.
    """
    tokens = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not tokens:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(word_hash.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h * STEP) ^ w[k : len(w) - n + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * MIX[0]
    return np.unique(mix(h))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches: a row of `size` coordinates for each non-empty set.

    Round i hashes each element to a bin and a value; a coordinate is the least (round, value) that fell into its bin.
    Rounds go on until all coordinates of a set are filled; from round `size` on, round `size` + k places every element
    in bin k, so 2 * size rounds always suffice.  Filled coordinates never change in later rounds.
    """
    out = np.full((len(sets), size), EMPTY)
    flat = out.ravel()
    active = np.arange(len(sets))
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(active * size, [len(s) for s in sets])
    look = 4
    for i in range(2 * size):
        h = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1))
        if i < size:
            at = row + ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            at = row + (i - size)
        np.minimum.at(flat, at, np.uint64(i) << np.uint64(52) | h & np.uint64((1 << 52) - 1))
        if i + 1 >= look:
            look = max(i + 3, int(1.25 * (i + 1)))
            open_rows = (out[active] == EMPTY).any(1)
            if not open_rows.any():
                break
            active = active[open_rows]
            keep = np.isin(row, active * size)
            elements, row = elements[keep], row[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` coordinates of each sketch."""
    n, size = sketch.shape
    bands = size // rows
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for k in range(rows):
        h = mix((h * STEP) ^ sketch[:, k : bands * rows : rows])
    return h
