"""Hashes of words and of five-word shingles, for many texts at once.

Words are runs of characters other than space and the control characters 9 to 13; A to Z are lower-cased.
A word's hash is a polynomial over its bytes modulo 2^64, a shingle's hash mixes its words' hashes in
order. A text of fewer than five words has its whole sequence as one shingle; one without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE = 0x9E3779B97F4A7C15 | 1
UNDO = pow(BASE, -1, 1 << 64)
TEXT_ROWS = 200  # hashed at once: some thirty bytes of memory for each of their bytes
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), the texts' words in one row."""
    if len(texts) > TEXT_ROWS:
        parts = [word_hashes(texts[at : at + TEXT_ROWS]) for at in range(0, len(texts), TEXT_ROWS)]
        return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    space = SPACES[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    power = np.full(len(data), BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power, out=sums[1:])
    undo = np.full(len(data), UNDO, np.uint64)
    undo[0] = 1
    np.cumprod(undo, out=undo)
    hashes = mix((sums[ends] - sums[starts]) * undo[starts])
    bounds = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return hashes, counts


def shingle_hashes(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if not texts:
        return []
    hashes, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix(rolled + hashes[k : k + len(rolled)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for h in hashes[at : at + n]:
                whole = mix(whole + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
