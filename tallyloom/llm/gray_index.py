"""A hierarchical index over 64-bit fingerprints in Gray order, for links within a Hamming distance.

Fingerprints of a bucket are sorted by Gray rank (the position of the pattern in the binary
reflected Gray code), so neighbours in the order share long bit patterns. Runs of FAN nodes get an
upper node with the mask and the pattern of the bits that all its members share. A search goes
down level by level and adds up differing bits: a node's mask leaves out the bits that its parent
has counted. A node beyond the limit is pruned with all that it holds; a node whose members must
all be within the limit is accepted whole.
"""

from __future__ import annotations

import numpy as np

FAN = 4
ALL = np.uint64(2**64 - 1)
#: Pairs of query and node looked at together.
FRONTIER = 1 << 17


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The position of each pattern in the Gray code: the inverse of v ^ (v >> 1)."""
    out = values.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> np.uint64(shift))
    return out


class Forest:
    """Roots of a union-find over 0..n-1, joined in bulk; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while (root != (up := self.parent[root])).any():
            root = up
        self.parent[x] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)


class GrayIndex:
    """Levels of nodes over distinct fingerprints that are sorted by bucket and then by Gray rank."""

    def __init__(self, bucket: np.ndarray, values: np.ndarray):
        self.values = values.astype(np.uint64)
        #: Pairs of fingerprints that the last search compared one by one.
        self.compared = 0
        n = len(values)
        #: For each level: the bits shared, their values, the first child and one past the last, the bucket.
        self.levels = [(np.full(n, ALL), self.values, None, None, bucket)]
        while True:
            shared, pattern, _, _, of = self.levels[-1]
            fresh = np.r_[True, of[1:] != of[:-1]]
            if fresh.all():
                break
            run = np.arange(len(of))
            place = run - np.maximum.accumulate(np.where(fresh, run, 0))
            starts = np.flatnonzero(place % FAN == 0)
            ends = np.r_[starts[1:], len(of)]
            ones = np.bitwise_and.reduceat(shared & pattern, starts)
            zeros = np.bitwise_and.reduceat(shared & ~pattern, starts)
            self.levels.append((ones | zeros, ones, starts, ends, of[starts]))

    def leaves(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The first fingerprint below each node."""
        for _, _, starts, _, _ in reversed(self.levels[1 : level + 1]):
            nodes = starts[nodes]
        return nodes

    def joined(self, limit: int) -> Forest:
        """Joins fingerprints of one bucket that differ in at most limit bits; no link is lost.

        Whatever is joined is connected by such links: a group accepted whole for a query is joined
        by its first member, and is itself connected since its members differ in few bits.
        """
        forest = Forest(len(self.values))
        self.compared = 0
        tight = []
        for level, (shared, _, starts, ends, _) in enumerate(self.levels):
            loose = 64 - np.bitwise_count(shared).astype(np.int64)
            tight.append(loose <= limit)
            if starts is not None and tight[level].any():  # all members are within the limit of each other
                group = np.flatnonzero(tight[level])
                sizes = (ends - starts)[group]
                first = np.repeat(starts[group], sizes)
                child = first + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                forest.join(self.leaves(level - 1, first), self.leaves(level - 1, child))
        top = len(self.levels) - 1
        of = self.levels[top][4]
        sizes = np.bincount(np.searchsorted(of, self.levels[0][4]), minlength=len(of))
        ask = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        root = np.searchsorted(of, self.levels[0][4][ask])
        for a in range(0, len(ask), FRONTIER // 64):
            self.search(forest, ask[a : a + FRONTIER // 64], root[a : a + FRONTIER // 64], top, limit, tight)
        return forest

    def search(self, forest: Forest, query: np.ndarray, node: np.ndarray, level: int, limit: int, tight: list) -> None:
        stack = [(query, node, level, np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64))]
        while stack:
            query, node, level, differ, counted = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half], level, differ[:half], counted[:half]), (query[half:], node[half:], level, differ[half:], counted[half:])]
                continue
            shared, pattern, starts, ends, _ = self.levels[level]
            mask = shared[node]
            differ = differ + np.bitwise_count((self.values[query] ^ pattern[node]) & mask & ~counted)
            keep = differ <= limit
            query, node, differ, mask = query[keep], node[keep], differ[keep], mask[keep]
            if level == 0:
                self.compared += len(keep)
                forest.join(query, node)
                continue
            loose = 64 - np.bitwise_count(mask).astype(np.int64)
            whole = differ + loose <= limit
            if whole.any():
                forest.join(query[whole], self.leaves(level, node[whole]))
                query, node, differ, mask = query[~whole], node[~whole], differ[~whole], mask[~whole]
            sizes = (ends - starts)[node]
            child = np.repeat(starts[node], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            query, differ, mask = np.repeat(query, sizes), np.repeat(differ, sizes), np.repeat(mask, sizes)
            later = self.leaves(level - 1, child) + FAN ** (level - 1) > query  # each pair once: members before the query have asked for it
            stack.append((query[later], child[later], level - 1, differ[later], mask[later]))
