"""Prefix trees of n-gram sets, many at a time, on flat arrays.

A place is a list of sets. Inside it n-grams are ranked by how many of its sets hold them, most frequent first, and a
set's path is its n-grams in that order, so like sets share the beginning of their paths. Sorted paths and the lengths of
their common beginnings are the tree: a node is a run of sorted sets and the part of the path that they share beyond
their parent. A set goes down the tree with the overlap counted along the path, once for all sets below a node. A branch
is left when the overlap so far and the length that remains can't reach the threshold, or when all below it is connected
with the set already. One step takes the whole frontier of many sets in many places together.

n-grams that one set of a place holds can't be shared: they count in lengths and are in no path.
"""

from __future__ import annotations

import numpy as np


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. lengths[0] of them, then those of the next."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Forest:
    """The trees of some places. Sets are numbered by place and path; nodes come after their parents."""

    def __init__(self, grams: np.ndarray, lengths: np.ndarray, place: np.ndarray):
        m = len(lengths)
        owner = np.repeat(np.arange(m), lengths)
        ids, gram = np.unique(grams, return_inverse=True)
        at, where, seen = np.unique(place[owner] * np.int64(len(ids)) + gram, return_inverse=True, return_counts=True)
        del gram
        at_place = at // max(1, len(ids))
        order = np.lexsort((at, -seen, at_place))
        order = order[seen[order] > 1]  # a place's shared n-grams, most frequent first
        rank = np.full(len(at), -1, np.int64)
        rank[order] = np.arange(len(order))
        self.base = np.searchsorted(at_place[order], np.arange(place[-1] + 2 if m else 1))  # where a place's ranks begin
        path = rank[where]
        shared = path >= 0
        path = np.sort(owner[shared] * np.int64(len(order) + 1) + path[shared])
        self.shared = np.bincount(owner[shared], minlength=m)
        path -= np.repeat(np.arange(m), self.shared) * np.int64(len(order) + 1)
        ends = np.cumsum(self.shared)
        starts = ends - self.shared
        raw = path.astype(">u4").tobytes()
        self.sets = np.array(sorted(range(m), key=lambda i: (place[i], raw[4 * starts[i] : 4 * ends[i]])), np.int64)
        self.path, self.start = path, starts[self.sets]
        self.shared, self.place, self.size = self.shared[self.sets], place[self.sets], lengths[self.sets]
        self._build()

    def _common(self, a: int, b: int) -> int:
        n = min(self.shared[a], self.shared[b])
        apart = self.path[self.start[a] : self.start[a] + n] != self.path[self.start[b] : self.start[b] + n]
        k = int(apart.argmax()) if n else 0
        return k if n and apart[k] else int(n)

    def _build(self) -> None:
        """Nodes as (place, low, high, depth): runs of sets with a common beginning, and each set by itself."""
        m, nodes = len(self.sets), []
        stack: list[tuple[int, int]] = []
        for i in range(m + 1):
            new = i == m or i == 0 or self.place[i] != self.place[i - 1]
            depth, low = (-1, i) if new else (self._common(i - 1, i), i - 1)
            while stack and stack[-1][0] > depth:
                d, low = stack.pop()
                nodes.append((low, i, d, 0))
            if i == m:
                break
            if new:
                stack = [(0, i)]
            elif stack[-1][0] < depth:
                stack.append((depth, low))
        nodes += [(i, i + 1, n, 1) for i, n in enumerate(self.shared.tolist())]
        low, high, depth, leaf = np.array(nodes, np.int64).reshape(-1, 4).T
        order = np.lexsort((leaf, depth, -high, low))
        self.low, self.high, self.depth, self.leaf = low[order], high[order], depth[order], leaf[order].astype(bool)
        parent, open_ = np.full(len(order), -1, np.int64), []
        for k, (a, b) in enumerate(zip(self.low.tolist(), self.high.tolist())):
            while open_ and self.high[open_[-1]] < b or open_ and self.high[open_[-1]] <= a:
                open_.pop()
            if open_:
                parent[k] = open_[-1]
            if not self.leaf[k]:
                open_.append(k)
        self.top = np.flatnonzero(parent < 0)  # one for each place, of depth 0
        self.above = np.where(parent < 0, 0, self.depth[parent])
        kids = np.argsort(parent, kind="stable")[len(self.top) :]
        self.kids, self.first_kid = kids, np.searchsorted(parent[kids], np.arange(len(order) + 1))
        runs = np.stack([self.low, self.high], 1).ravel()
        pad = lambda x: np.append(x, x[-1:])
        self.least = np.minimum.reduceat(pad(self.size), runs)[::2]
        self.most = np.maximum.reduceat(pad(self.size), runs)[::2]
        self.most_shared = np.maximum.reduceat(pad(self.shared), runs)[::2]
        self.runs = runs

    def links(self, connected: np.ndarray, num: int, den: int, room: int) -> list[tuple[int, int]]:
        """Pairs of sets, by their numbers in the caller's order. connected: a name of each set's component at the start."""
        up = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        name, out = connected[self.sets].copy(), []
        first = np.searchsorted(self.place, np.arange(self.place[-1] + 1))
        nth = np.arange(len(self.sets)) - first[self.place]
        wave = np.where(nth == 0, 0, 1 + np.floor(np.log2(np.maximum(nth, 1)) / 2)).astype(np.int64)  # 1, then 3, 12, 48 .. of a place
        width = self.base[self.place + 1] - self.base[self.place]
        label = np.bincount(self.place[self.low], self.depth - self.above, len(first)).astype(np.int64)
        cost = (label + width)[self.place] if len(label) == len(width) else label[self.place] + width
        for w in range(int(wave.max()) + 1):
            turn = np.flatnonzero(wave == w)
            for part in np.split(turn, np.flatnonzero(np.diff(np.cumsum(cost[turn]) // room)) + 1):
                low, high = (np.minimum.reduceat(np.append(name, name[-1:]), self.runs)[::2], np.maximum.reduceat(np.append(name, name[-1:]), self.runs)[::2])
                met = self._down(part, width, name, np.where(low == high, low, -1), num, den)
                if len(met[0]):
                    for a, b in zip(*(x.tolist() for x in met)):
                        x, y = root(int(name[a])), root(int(name[b]))
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            out.append((int(self.sets[a]), int(self.sets[b])))
                    uniq, inverse = np.unique(name, return_inverse=True)
                    name = np.array([root(int(x)) for x in uniq])[inverse]
        return out

    def _down(self, part: np.ndarray, width: np.ndarray, name: np.ndarray, one: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of `part` and the sets after them. one: the component of all sets below a node, or -1."""
        holds_at = np.cumsum(width[part]) - width[part]
        holds = np.zeros(int(width[part].sum()) + 1, bool)
        shift = holds_at - self.base[self.place[part]]
        mine = _ragged(self.start[part], self.shared[part])
        holds[self.path[mine] + np.repeat(shift, self.shared[part])] = True
        q, node = np.arange(len(part)), self.top[self.place[part]]
        overlap, found = np.zeros(len(part), np.int64), []
        while len(q):
            set_, n = part[q], self.size[part[q]]
            ok = (self.high[node] > set_ + 1) & (one[node] != name[set_]) & (den * self.most[node] >= num * n) & (den * n >= num * self.least[node])
            q, node, overlap, set_, n = q[ok], node[ok], overlap[ok], set_[ok], n[ok]
            if not len(q):
                break
            length = self.depth[node] - self.above[node]
            steps = _ragged(self.start[self.low[node]] + self.above[node], length)
            hits = np.concatenate([[0], np.cumsum(holds[self.path[steps] + np.repeat(shift[q], length)])])
            ends = np.cumsum(length)
            overlap = overlap + hits[ends] - hits[ends - length]
            best = overlap + np.minimum(self.shared[set_] - overlap, self.most_shared[node] - self.depth[node])
            ok = den * best >= num * (n + self.least[node] - best)
            q, node, overlap, set_, n = q[ok], node[ok], overlap[ok], set_[ok], n[ok]
            leaf = self.leaf[node]
            ends_at = self.low[node[leaf]]
            link = (den * overlap[leaf] >= num * (n[leaf] + self.size[ends_at] - overlap[leaf])) & (ends_at > set_[leaf])
            found.append((set_[leaf][link], ends_at[link]))
            q, node, overlap = q[~leaf], node[~leaf], overlap[~leaf]
            kids = self.first_kid[node + 1] - self.first_kid[node]
            q, overlap, node = np.repeat(q, kids), np.repeat(overlap, kids), self.kids[_ragged(self.first_kid[node], kids)]
        empty = np.zeros(0, np.int64)
        return (np.concatenate([empty, *(a for a, _ in found)]), np.concatenate([empty, *(b for _, b in found)]))


def forest_links(grams: np.ndarray, lengths: np.ndarray, place: np.ndarray, connected: np.ndarray, num: int, den: int, room: int = 1 << 22) -> list[tuple[int, int]]:
    """Pairs of positions that connect what is linked within each place, as many as it takes.

    grams: the distinct n-grams of set after set; lengths: how many each has; place: rising numbers from 0; connected: equal
    where two sets of a place are connected already; room: how many cells a step may look at.
    """
    if len(lengths) < 2 or not len(grams):
        return []
    return _Forest(np.asarray(grams), np.asarray(lengths, np.int64), np.asarray(place, np.int64)).links(np.asarray(connected, np.int64), num, den, room)


def tree_links(sets: list[np.ndarray], num: int, den: int, loose: list[bool] | None = None) -> list[tuple[int, int]]:
    """The links of one place. Sets that aren't loose are connected already."""
    if len(sets) < 2:
        return []
    tied = np.zeros(len(sets), bool) if loose is None else ~np.asarray(loose, bool)
    connected = np.where(tied, int(tied.argmax()), np.arange(len(sets)))
    return forest_links(np.concatenate(sets), [len(s) for s in sets], np.zeros(len(sets), np.int64), connected, num, den)
