"""Hashes and exact groups of many byte runs of one array, eight bytes a step.

A run's hash mixes its length and each eight bytes of it in turn with a bijective, non-linear mix, so runs of one length of up to eight bytes
never meet, and others do with a chance of 2**-64 a pair. Runs of more than ``LONG`` bytes take a cryptographic digest. ``groups``
is exact: runs that a hash puts together are compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 256
_SEED = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run; which: one of two independent ones."""
    words, n = _words(data), lengths.astype(np.int64)
    h = mix(_SEED[which] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long = n > LONG
    at = np.flatnonzero(~long & (n > 0))
    step = 0
    while len(at):
        rest = n[at] - step
        h[at] = mix((h[at] + np.uint64(0xA4093822299F31D1)) ^ (words[starts[at] + step] & _KEEP[np.minimum(rest, 8)]))
        at, step = at[rest > 8], step + 8
    for i in np.flatnonzero(long):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + n[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return h


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    """Whether each run of n bytes from a on equals that from b on."""
    words = _words(data)
    at, step = np.flatnonzero((n > 0) & (n <= LONG) & (a != b)), 0
    while len(at):
        keep = _KEEP[np.minimum(n[at] - step, 8)]
        if ((words[a[at] + step] ^ words[b[at] + step]) & keep).any():
            return False
        at, step = at[n[at] - step > 8], step + 8
    return all(np.array_equal(data[a[i] : a[i] + n[i]], data[b[i] : b[i] + n[i]]) for i in np.flatnonzero((n > LONG) & (a != b)))


def groups(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One run of each distinct byte string, and which of them each run is; exact whatever the hashes h."""
    h = hashes(data, starts, lengths) if h is None else h
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    if np.array_equal(lengths, lengths[one][which]) and equal(data, starts, starts[one][which], lengths):
        return one, which
    raw, order = data.tobytes(), {}  # two byte strings share a hash: go by the bytes
    which = np.array([order.setdefault(raw[s : s + n], len(order)) for s, n in zip(starts.tolist(), lengths.tolist())])
    _, one = np.unique(which, return_index=True)
    return one, which
