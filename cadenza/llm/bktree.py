"""BK-trees over 64-bit fingerprints as arrays: many trees are built and searched at once.

A node's children are keyed by their integer Hamming distance to it. Searching follows only the
edges whose key differs from the node's distance by at most the radius (triangle inequality).
"""

from __future__ import annotations

import numpy as np

SPAN = 65  # distances 0 to 64


class Forest:
    """One BK-tree for each tree id; items of a tree are consecutive in no particular order."""

    def __init__(self, tree: np.ndarray, value: np.ndarray):
        self.value = value
        n = len(value)
        slot = tree.astype(np.int64)  # where each item not yet placed waits: a tree, then (node, edge)
        waiting = np.arange(n)
        keys, nodes = [], []
        self.root: dict[str, np.ndarray] = {}
        level = 0
        while len(waiting):
            at, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
            placed = waiting[first]
            if level == 0:
                self.roots = (at, placed)
            else:
                keys.append(at)
                nodes.append(placed)
            parent = placed[inverse]
            left = waiting != parent
            waiting, parent = waiting[left], parent[left]
            slot = parent * SPAN + np.bitwise_count(value[waiting] ^ value[parent])
            level += 1
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.node = key[order], (np.concatenate(nodes) if nodes else np.empty(0, np.int64))[order]

    def search(self, tree: np.ndarray, value: np.ndarray, radius: int):
        """Yield (query numbers, item numbers) within radius, level by level."""
        where = np.searchsorted(self.roots[0], tree)
        where = np.minimum(where, len(self.roots[0]) - 1) if len(self.roots[0]) else where
        query = np.flatnonzero(self.roots[0][where] == tree) if len(self.roots[0]) else np.empty(0, np.int64)
        node = self.roots[1][where[query]] if len(query) else np.empty(0, np.int64)
        while len(query):
            distance = np.bitwise_count(value[query] ^ self.value[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.key, node * SPAN + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.key, node * SPAN + np.minimum(distance + radius, SPAN - 1), side="right")
            n = high - low
            query = np.repeat(query, n)
            start = np.repeat(low - (np.cumsum(n) - n), n)
            node = self.node[start + np.arange(len(query))]


def components(n: int, edges) -> np.ndarray:
    """Smallest item number reachable from each of n items; edges: iterable of (left, right) arrays."""
    label = np.arange(n)

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if np.array_equal(up, x):
                return x
            x = up

    for left, right in edges:
        while len(left):
            a, b = top(left), top(right)
            apart = a != b
            if not apart.any():
                break
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    return top(label)
