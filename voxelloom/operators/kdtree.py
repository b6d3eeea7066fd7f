"""Balanced k-d trees in NumPy: which points of a set lie within a distance of each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Relative allowance on squared distances, so that a distance equal to the radius but for rounding counts.
SLACK = 1e-9


class KdTree:
    """All leaves hold the same number of places; places without a point hold index -1."""

    def __init__(self, points: np.ndarray, leaf: int = 16):
        n, d = points.shape
        levels = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        width = max(1, -(-n // (1 << levels)))
        index = np.full(width << levels, -1, dtype=np.int64)
        index[:n] = np.arange(n)
        places = np.empty((len(index), d))
        places[:n] = points
        # Fewer than one for each leaf, spread over the points: places that lie together would all be near each other.
        spare = len(index) - n
        places[n:] = points[np.arange(spare) * n // max(1, spare)] if n else 0.0
        boxes = []
        for level in range(levels + 1):
            nodes = places.reshape(1 << level, -1, d)
            low, high = nodes.min(axis=1), nodes.max(axis=1)
            boxes.append((low, high))
            if level < levels:
                widest = (high - low).argmax(axis=1)
                along = np.take_along_axis(nodes, widest[:, None, None], axis=2)[:, :, 0]
                order = np.argsort(along, axis=1, kind="stable")
                order += (np.arange(1 << level) * nodes.shape[1])[:, None]
                places, index = places[order.ravel()], index[order.ravel()]
        self.leaves = places.reshape(1 << levels, -1, d)
        self.index = index.reshape(1 << levels, -1)
        self.boxes = boxes

    def pairs(self, other: KdTree | None, radius: float, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of indices at most radius apart: of this tree (i != j, each pair once), or of this one and another."""
        most = radius * radius * (1 + SLACK)
        own = other is None
        that = self if own else other
        a = b = np.zeros(1, dtype=np.int64)
        la, lb = 0, 0
        while la < len(self.boxes) - 1 or lb < len(that.boxes) - 1:
            if la < len(self.boxes) - 1:
                la += 1
                a, b = np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])
            if lb < len(that.boxes) - 1:
                lb += 1
                a, b = np.concatenate([a, a]), np.concatenate([2 * b, 2 * b + 1])
            if own:
                keep = a <= b
                a, b = a[keep], b[keep]
            (alo, ahi), (blo, bhi) = self.boxes[la], that.boxes[lb]
            gap = np.maximum(0.0, np.maximum(alo[a] - bhi[b], blo[b] - ahi[a]))
            keep = (gap * gap).sum(axis=1) <= most
            a, b = a[keep], b[keep]
        wa, wb = self.leaves.shape[1], that.leaves.shape[1]
        step = max(1, chunk // (wa * wb))
        d = self.leaves.shape[2]
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            square = np.zeros((len(x), wa, wb))
            for k in range(d):
                apart = self.leaves[x, :, k][:, :, None] - that.leaves[y, :, k][:, None, :]
                square += apart * apart
            k, i, j = np.nonzero(square <= most)
            left, right = self.index[x[k], i], that.index[y[k], j]
            keep = (left >= 0) & (right >= 0)
            if own:
                keep &= (x[k] != y[k]) | (i < j)
            yield left[keep], right[keep]


    def in_boxes(self, low: np.ndarray, high: np.ndarray, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(box, point) of the points in each box, its borders included."""
        box, node = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for level, (nlow, nhigh) in enumerate(self.boxes):
            if level:
                box, node = np.concatenate([box, box]), np.concatenate([2 * node, 2 * node + 1])
            keep = ((nlow[node] <= high[box]) & (nhigh[node] >= low[box])).all(axis=1)
            box, node = box[keep], node[keep]
        step = max(1, chunk // self.leaves.shape[1])
        for at in range(0, len(box), step):
            b, leaf = box[at : at + step], node[at : at + step]
            places = self.leaves[leaf]
            k, i = np.nonzero(((places >= low[b][:, None]) & (places <= high[b][:, None])).all(axis=2) & (self.index[leaf] >= 0))
            yield b[k], self.index[leaf[k], i]


def split_box(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Splits of a k-d tree with that many leaves over a sample: rows (axis, value, left, right).

    A child >= 0 is another row, a child < 0 the leaf -child - 1. Each node halves its leaves at the matching
    quantile of its widest axis. A node whose points are all equal can't be split and is one leaf.
    """
    rows: list[tuple[int, float, int, int]] = []
    count = 0

    def build(p: np.ndarray, want: int) -> int:
        nonlocal count
        spread = p.max(axis=0) - p.min(axis=0) if len(p) else np.zeros(1)
        if want <= 1 or len(p) < 2 or not spread.max() > 0:
            count += 1
            return -count
        axis = int(spread.argmax())
        left_leaves = want // 2
        along = np.sort(p[:, axis])
        at = max(1, len(p) * left_leaves // want)
        value = along[at - 1]
        if value == along[-1]:
            value = along[along < value][-1]
        k = len(rows)
        rows.append((axis, float(value), 0, 0))
        low = p[:, axis] <= value
        rows[k] = (axis, float(value), build(p[low], left_leaves), build(p[~low], want - left_leaves))
        return k

    root = build(points, leaves)
    assert root == 0 or not rows
    return rows


def descend(points: np.ndarray, splits: list[tuple[int, float, int, int]], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, leaf, home) of every point's own leaf and of every leaf whose side of each split is within reach."""
    n = len(points)
    if not splits:
        return np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    axis, value = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    child = np.array([[s[2], s[3]] for s in splits])
    who, node, home = np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        x, v = points[who, axis[node]], value[node]
        left, right = x <= v + reach, x > v - reach
        who, home, node = (
            np.concatenate([who[left], who[right]]),
            np.concatenate([(home & (x <= v))[left], (home & (x > v))[right]]),
            np.concatenate([child[node[left], 0], child[node[right], 1]]),
        )
        leaf = node < 0
        done.append((who[leaf], -node[leaf] - 1, home[leaf]))
        who, node, home = who[~leaf], node[~leaf], home[~leaf]
    return tuple(np.concatenate(x) for x in zip(*done))


def descend_boxes(low: np.ndarray, high: np.ndarray, splits: list[tuple[int, float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(box, leaf) of every leaf that a box, its borders included, may share a point with."""
    n = len(low)
    if not splits:
        return np.arange(n), np.zeros(n, dtype=np.int64)
    axis, value = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    child = np.array([[s[2], s[3]] for s in splits])
    who, node = np.arange(n), np.zeros(n, dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(who):
        v = value[node]
        left, right = low[who, axis[node]] <= v, high[who, axis[node]] > v
        who, node = np.concatenate([who[left], who[right]]), np.concatenate([child[node[left], 0], child[node[right], 1]])
        leaf = node < 0
        done.append((who[leaf], -node[leaf] - 1))
        who, node = who[~leaf], node[~leaf]
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
