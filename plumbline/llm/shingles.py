"""Sets of word shingles as sorted integers, from flat arrays.

Words are runs of anything but ASCII white space, A to Z in lower case. A shingle is five words in a row; a text with fewer words
is one shingle of all of them; a text without words has none. A shingle is held as a 56-bit hash of its words' 64-bit hashes: two
different shingles meet in one pair of texts with n and m shingles with a chance of n * m / 2**56.
"""

from __future__ import annotations

import hashlib

import numpy as np

from plumbline.llm.hashing import hashes, mix

WIDTH = 5
BITS = 56
MASK = np.uint64((1 << BITS) - 1)
_ROW = np.random.default_rng(11).integers(1, 1 << 63, WIDTH + 1, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    return mix(h) & MASK


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and how many each text has."""
    data = np.frombuffer(b"".join(texts), np.uint8).copy()
    sizes = np.array([len(t) for t in texts], np.int64)
    data[(data >= 65) & (data <= 90)] += 32
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[np.cumsum(sizes)] = True
    edge[0] = True
    starts = np.flatnonzero(~space & (edge[:-1] | np.r_[True, space[:-1]])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & (edge[1:] | np.r_[space[1:], True])) + 1 if len(data) else starts
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    return hashes(data, starts, ends - starts), np.bincount(doc, minlength=len(texts))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, count = words(texts)
    first = np.cumsum(count) - count
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width if len(rolled) else 0):
        rolled += h[i : len(h) - width + 1 + i] * _ROW[i]
    rolled = _mix(rolled)
    out = []
    for lo, n in zip(first.tolist(), count.tolist()):
        if n >= width:
            out.append(np.unique(rolled[lo : lo + n - width + 1]))
        elif n:
            out.append(_mix((h[lo : lo + n] * _ROW[:n]).sum(keepdims=True) + _ROW[width:] * np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits of a cryptographic digest that stand for a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
