"""A trie of globally ordered sets, joined with many probes at once."""

from __future__ import annotations

import numpy as np

NUMERATOR, DENOMINATOR = 75, 100


def needed(a, b, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
    """The smallest intersection of sets of a and b items whose Jaccard similarity reaches the threshold."""
    return -(-numerator * (a + b) // (denominator + numerator))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Trie:
    """Ordered sets that begin alike share nodes. A node is a run of items; it knows the sets that end with
    it, its children, and the least and largest sizes of the sets below it."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        sizes = [len(s) for s in self.sets]
        common = [0] * len(sets)  # items shared with the set before
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[i] = int(differ[0]) if len(differ) else n
        # Nodes: (run, least size, largest size, depth after the run, children, sets that end here).
        self.nodes: list[tuple] = []
        todo = [(0, len(sets), 0, None)] if sets else []
        while todo:
            lo, hi, depth, parent = todo.pop()
            stop = min([sizes[lo], *common[lo + 1 : hi]])
            ended, children, i = [], [], lo
            if parent is not None:
                parent.append(len(self.nodes))
            self.nodes.append((self.sets[lo][depth:stop], min(sizes[lo:hi]), max(sizes[lo:hi]), stop, children, ended))
            while i < hi:
                if sizes[i] == stop:
                    ended.append(i)
                    i += 1
                    continue
                j = i + 1
                while j < hi and common[j] > stop:
                    j += 1
                todo.append((i, j, stop, children))
                i = j

    def join(self, probes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of a set, number of a probe, size of their intersection) of all similar pairs.

        One traversal serves all probes: at a node each probe that is still possible has its partial overlap with the path, which every
        set below shares; a probe leaves a subtree when what both sides have left can't reach the threshold.
        """
        empty = np.zeros(0, np.int64)
        size = np.array([len(p) for p in probes], np.int64)
        if not self.nodes or not size.sum():
            return empty, empty, empty
        items, rank = np.unique(np.concatenate(probes), return_inverse=True)
        many, owner = len(items), np.repeat(np.arange(len(probes)), size)
        by_item = np.argsort(rank, kind="stable")
        holders, edge = owner[by_item], np.searchsorted(rank[by_item], np.arange(many + 1))
        line, begin = owner * (many + 1) + rank, np.cumsum(size) - size
        found, stack = [], [(0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            node, live, shared = stack.pop()
            run, least, largest, depth, children, ended = self.nodes[node]
            left = size[live]
            if len(run):
                at = np.searchsorted(items, run)
                at = at[items[np.minimum(at, many - 1)] == run]
                if len(at):
                    hit = holders[_ranges(edge[at], edge[at + 1] - edge[at])]
                    shared = shared + np.bincount(hit, minlength=len(size))[live]
                passed = np.searchsorted(items, run[-1], "right")
                left = left - (np.searchsorted(line, live * (many + 1) + passed) - begin[live])
            able = shared + np.minimum(left, largest - depth) >= needed(size[live], least)
            live, shared = live[able], shared[able]
            if not len(live):
                continue
            for i in ended:
                ok = shared >= needed(size[live], len(self.sets[i]))
                if ok.any():
                    found.append((np.full(int(ok.sum()), self.order[i]), live[ok], shared[ok]))
            stack += [(c, live, shared) for c in children]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty)

    def similar(self, probe: np.ndarray) -> list[tuple[int, int]]:
        """(number of a set, size of its intersection with the probe) of all sets similar to one probe."""
        i, _, n = self.join([probe])
        return list(zip(i.tolist(), n.tolist()))
