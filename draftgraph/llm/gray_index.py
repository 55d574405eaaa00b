"""Gray-order hierarchical index over fingerprints, and the links inside groups of them.

Fingerprints of a group are sorted by their rank in the reflected Gray code, where neighbours differ
in few bits. Runs of ``FAN`` neighbours form a node, runs of nodes a node above: a node has the mask
of the bits that all below share, and their pattern. Two nodes differ at least in the bits where
both masks hold and the patterns disagree; if that is over the radius, no pair below is in reach and
both groups are pruned at once. Pairs of nodes that are one component already are pruned as well, so
a dense group costs no all-pairs work and gives a spanning set of links, not all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FAN = 8
FRONT = 400_000


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position in the reflected Gray code of each row of 64-bit words, most significant first."""
    r = words.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    odd = np.zeros(len(r), bool)
    for k in range(r.shape[1]):  # an odd number of ones before turns the rest over
        parity = (r[:, k] & np.uint64(1)).astype(bool)
        r[odd, k] = ~r[odd, k]
        odd = odd ^ parity
    return r


def _levels(words: np.ndarray, group: np.ndarray):
    """From the items up: for each level (pattern, mask, first child, end child) until each group is
    one node. ``group`` is ascending."""
    pattern, mask = words, np.full_like(words, np.uint64(0xFFFFFFFFFFFFFFFF))
    levels = [(pattern, mask, None, None)]
    while True:
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        if len(starts) == len(group) and len(levels) > 1:
            return levels
        inside = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        first = np.flatnonzero(inside % FAN == 0)
        all_and = np.bitwise_and.reduceat(pattern, first, axis=0)
        all_or = np.bitwise_or.reduceat(pattern, first, axis=0)
        mask = np.bitwise_and.reduceat(mask, first, axis=0) & ~(all_and ^ all_or)
        pattern = all_and & mask
        levels.append((pattern, mask, first, np.append(first[1:], len(group))))
        group = group[first]


class _Sets:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that brought two sets together."""
        took = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                took.append((x, y))
        return took

    def labels(self) -> np.ndarray:
        """The least member of each set; a parent is never larger than its child."""
        p = np.array(self.parent)
        while True:
            q = p[p]
            if (q == p).all():
                self.parent = p.tolist()
                return p
            p = q


def _distance(pattern, mask, a, b) -> np.ndarray:
    both = (pattern[a] ^ pattern[b]) & mask[a] & mask[b]
    return np.bitwise_count(both).sum(axis=1, dtype=np.int32)


def _near(words: np.ndarray, group: np.ndarray, radius: int, labels: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In batches (row, row, differing bits), the pairs of rows of equal ``group``, both in index order,
    within ``radius``; but no pairs from two nodes below which all rows have one of the ``labels``, which
    are asked for anew before each batch."""
    n = len(words)
    levels = _levels(words, group)
    top = len(levels) - 1
    ids = np.arange(len(levels[top][0]))
    ranges = []  # the items below each node of each level
    lo, hi = np.arange(n), np.arange(n) + 1
    for _, _, first, end in levels:
        if first is not None:
            lo, hi = lo[first], hi[end - 1]
        ranges.append((lo, hi))

    def uniform(level: int):
        """Whether a node's items are one set, and which."""
        label = labels()
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        lo, hi = ranges[level]
        return changes[lo] == changes[hi - 1], label[lo]

    stack = [(top, ids[i : i + FRONT], ids[i : i + FRONT]) for i in range(0, len(ids), FRONT)]
    while stack:
        level, a, b = stack.pop()
        pattern, mask, first, end = levels[level]
        apart = _distance(pattern, mask, a, b)
        if level == 0:
            keep = np.flatnonzero((a != b) & (apart <= radius))
            yield a[keep], b[keep], apart[keep]
            continue
        one, label = uniform(level)
        keep = ~(one[a] & one[b] & (label[a] == label[b])) & (apart <= radius)
        a, b = a[keep], b[keep]
        for start in range(0, len(a), FRONT // (FAN * FAN)):
            x, y = a[start : start + FRONT // (FAN * FAN)], b[start : start + FRONT // (FAN * FAN)]
            nx, ny = end[x] - first[x], end[y] - first[y]
            many = nx * ny
            pair = np.repeat(np.arange(len(x)), many)
            i = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            cx, cy = first[x][pair] + i // ny[pair], first[y][pair] + i % ny[pair]
            half = cx <= cy
            stack.append((level - 1, cx[half], cy[half]))


def _join_near(words: np.ndarray, group: np.ndarray, radius: int, sets: _Sets) -> list[tuple[int, int]]:
    """Bring together in ``sets`` the rows of equal ``group``, both in index order, that a chain of rows
    within ``radius`` joins; the pairs that did it, in each batch the closest first."""
    apart = np.bitwise_count(words[1:] ^ words[:-1]).sum(axis=1)
    near = np.flatnonzero((group[1:] == group[:-1]) & (apart <= radius))
    near = near[np.argsort(apart[near], kind="stable")]
    took = sets.join(near, near + 1)
    for a, b, apart in _near(words, group, radius, sets.labels):
        closest = np.argsort(apart, kind="stable")
        took += sets.join(a[closest], b[closest])
    return took


def _sorted_groups(words: np.ndarray, group: np.ndarray):
    """(order, words, group) in index order, without rows that are alone in their group."""
    rank = gray_rank(words)
    order = np.lexsort([rank[:, k] for k in reversed(range(rank.shape[1]))] + [group])
    words, group = words[order], group[order]
    sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group)))
    alone = np.repeat(sizes == 1, sizes)
    return order[~alone], words[~alone], group[~alone]


NO_LINKS = np.zeros(0, np.int64), np.zeros(0, np.int64)


def group_links(words: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of ``words`` (n x k, uint64) of equal ``group`` that differ in at most
    ``radius`` bits: (row, row) pairs, each row with the first of its set in the group, so at most
    one link a row. Rows reach each other by these links exactly when a chain of close rows joins
    them."""
    if len(words) < 2:
        return NO_LINKS
    order, words, group = _sorted_groups(words, group)
    if not len(order):
        return NO_LINKS
    sets = _Sets(len(order))
    _join_near(words, group, radius, sets)
    label = sets.labels()
    linked = np.flatnonzero(label != np.arange(len(order)))
    return order[linked], order[label[linked]]


def group_forest(words: np.ndarray, group: np.ndarray, radii: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the same links, of pairs that are themselves within the last of ``radii``
    (ascending); rows that pairs within an earlier one join are joined by such pairs. At most one pair
    a row and group. Where a pair may turn out to be no link, rows that it alone joined can have other
    links: ``group_pairs`` has those."""
    if len(words) < 2:
        return NO_LINKS
    order, words, group = _sorted_groups(words, group)
    if not len(order):
        return NO_LINKS
    sets, took = _Sets(len(order)), []
    for radius in radii:
        took += _join_near(words, group, radius, sets)
    pairs = np.array(took, np.int64).reshape(-1, 2)
    return order[pairs[:, 0]], order[pairs[:, 1]]


def group_pairs(words: np.ndarray, group: np.ndarray, label: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In batches, all pairs of rows of equal ``group`` and different ``label`` within ``radius``."""
    if len(words) < 2:
        return
    order, words, group = _sorted_groups(words, group)
    if not len(order):
        return
    label = label[order]
    for a, b, _ in _near(words, group, radius, lambda: label):
        apart = label[a] != label[b]
        if apart.any():
            yield order[a[apart]], order[b[apart]]
