"""Minimal acyclic transducer over bytes: words in sorted order become a shared-suffix automaton whose outputs number them.

Words that end alike share states; every edge carries how many words sort before those that pass it, and the sum along
a word's path is the word's number, under which its ids lie in one array. All parts are flat arrays in one buffer, which a
process maps into memory. Lookup walks all asked words together, one byte a step.
"""

from __future__ import annotations

import numpy as np

MAGIC = np.int64(0x504C4D42)


def compile(words: dict[bytes, list[int]]) -> bytes:
    """The buffer for words and their ids."""
    items = sorted(words)
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, byte, child: the states that may still grow

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            signature = (final[child], tuple(edges[child].items()))
            edges[parent][byte] = register.setdefault(signature, child)

    last = b""
    for word in items:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            edges[state][byte] = len(edges) - 1
            path.append((state, byte, len(edges) - 1))
            state = len(edges) - 1
        final[state] = True
        last = word
    settle(0)
    # Number the reachable states, children before parents, and count the words below each.
    count: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        rest = [t for t in edges[s].values() if t not in count]
        if rest and s not in count:
            stack += rest
            continue
        count[s] = final[s] + sum(count[t] for t in edges[s].values())
        stack.pop()
    number = {s: i for i, s in enumerate(sorted(count))}
    key, target, skip = [], [], []
    for s, i in number.items():
        before = int(final[s])
        for byte in sorted(edges[s]):
            key.append(i << 8 | byte)
            target.append(number[edges[s][byte]])
            skip.append(before)
            before += count[edges[s][byte]]
    order = np.argsort(np.array(key, np.int64), kind="stable")
    ids = [words[w] for w in items]
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int64)
    parts = [
        np.array(key, np.int64)[order], np.array(target, np.int64)[order], np.array(skip, np.int64)[order], np.array([final[s] for s in sorted(count)], np.int64),
        offsets, np.array([x for w in ids for x in w], np.int64),
    ]
    head = np.array([MAGIC, *map(len, parts)], np.int64)
    return b"".join(p.tobytes() for p in [head, *parts])


class Automaton:
    """Reads a compiled buffer, mapped or in memory."""

    def __init__(self, buffer):
        data = np.frombuffer(buffer, np.int64) if not isinstance(buffer, np.memmap) else buffer.view(np.int64)
        if data[0] != MAGIC:
            raise ValueError("not a compiled lexicon")
        sizes, at = data[1:7], 7
        parts = []
        for n in sizes:
            parts.append(data[at : at + n])
            at += n
        self.key, self.target, self.skip, self.final, self.offsets, self.ids = parts

    @property
    def states(self) -> int:
        return len(self.final)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each byte run of data, or -1 where the lexicon lacks it."""
        number = np.full(len(starts), -1, np.int64)
        if not len(self.key):
            return number
        alive = np.flatnonzero(lengths > 0)
        state, total, step = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64), 0
        while len(alive):
            want = state << 8 | data[starts[alive] + step]
            edge = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[edge] == want
            alive, edge = alive[ok], edge[ok]
            state, total, step = self.target[edge], total[ok] + self.skip[edge], step + 1
            ended = lengths[alive] == step
            hit = ended & (self.final[state] == 1)
            number[alive[hit]] = total[hit]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
        return number
