"""BK-trees over 64-bit fingerprints, built and searched for many shards at once with numpy.

A node's children are keyed by their integer Hamming distance to it.  All shards of a task are
handled level by level together: each shard's first member is its root; the others compare with
the node they have reached and go down the edge of that distance, where the first to arrive
becomes the node.  A search follows only edges whose distance is within the radius of the query's
own distance to the node.
"""

from __future__ import annotations

import numpy as np

#: Query-node comparisons per numpy step, which bounds the memory of a search.
STEP = 1 << 19


class Forest:
    """One tree for each shard; ``shard`` must be sorted, ``fp`` are the members' fingerprints."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp, self.shard = fp, shard
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int16)
        if not n:
            return
        head = np.concatenate(([True], shard[1:] != shard[:-1]))
        self.roots = np.flatnonzero(head)
        at = self.roots[np.cumsum(head) - 1]
        moving = np.flatnonzero(~head)
        at = at[moving]
        while len(moving):
            d = np.bitwise_count(fp[moving] ^ fp[at]).astype(np.int16)
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            moving, at, d, slot = moving[order], at[order], d[order], slot[order]
            first = np.concatenate(([True], slot[1:] != slot[:-1]))
            self.parent[moving[first]], self.edge[moving[first]] = at[first], d[first]
            child = moving[first][np.cumsum(first) - 1]
            moving, at = moving[~first], child[~first]
        order = np.lexsort((self.edge, self.parent))
        order = order[self.parent[order] >= 0]
        self.children = order  # by parent, then edge
        self.slots = self.parent[order] * 65 + self.edge[order]

    def within(self, radius: int):
        """Yield arrays (i, j) of all members i, j < i of one shard at distance <= radius, in steps."""
        n = len(self.fp)
        if n < 2:
            return
        head = np.concatenate(([True], self.shard[1:] != self.shard[:-1]))
        root = self.roots[np.cumsum(head) - 1]
        size = np.diff(np.concatenate((self.roots, [n])))[np.cumsum(head) - 1]
        asking = np.flatnonzero(size > 1)
        # A stack of frontiers keeps memory bounded: large ones are cut before they are expanded.
        stack = [(asking[i : i + STEP], root[asking[i : i + STEP]]) for i in range(0, len(asking), STEP)]
        while stack:
            query, node = stack.pop()
            if not len(query):
                continue
            d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (node < query)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right")
            many = high - low
            some = many > 0
            query, low, many = query[some], low[some], many[some]
            if not len(query):
                continue
            total = np.cumsum(many)
            start = 0
            while start < len(query):
                base = total[start] - many[start]
                stop = max(int(np.searchsorted(total, base + STEP, side="right")), start + 1)
                m, lo = many[start:stop], low[start:stop]
                offset = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                stack.append((np.repeat(query[start:stop], m), self.children[np.repeat(lo, m) + offset]))
                start = stop
