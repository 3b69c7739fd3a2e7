"""Exact one-to-one matching of two box sets, one by one or many at once.

Many sets are bucketed by size and padded to a common shape, so that a bucket's
overlaps are one tensor. Where every box of one side overlaps at most one box of
the other, which is the usual case, sums over the tensor are the answer. The
other sets are solved together: shortest augmenting paths with potentials, each
step taken in all sets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: IoU thresholds 0.50, 0.55 .. 0.95.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
#: Overlaps held at once; a pair of sets with more is matched by itself.
CELLS = 1 << 20


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every row of ``a`` with every row of ``b`` (x1, y1, x2, y2)."""
    a, b = a.reshape(-1, 1, 4).astype(float), b.reshape(1, -1, 4).astype(float)
    w = np.clip(np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]), 0, None)
    h = np.clip(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]), 0, None)
    shared = w * h
    size = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    whole = size(a) + size(b) - shared
    return np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of all rows or all columns with the largest total gain (shortest augmenting paths with potentials)."""
    if gain.size == 0:
        return []
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, base, last = row, 0.0, -1
        while True:
            step = base + cost[at] - row_price[at] - col_price
            better = ~done & (step < dist)
            dist[better], via[better] = step[better], last
            last = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[last] = dist[last], True
            if owner[last] < 0:
                break
            at = int(owner[last])
        visited = np.flatnonzero(done)
        row_price[row] += base
        for col in visited:
            if col != last:
                row_price[owner[col]] += base - dist[col]
            col_price[col] -= base - dist[col]
        while last >= 0:
            before = via[last]
            owner[last] = row if before < 0 else owner[before]
            last = int(before)
    pairs = [(int(r), c) for c, r in enumerate(owner) if r >= 0]
    return [(c, r) for r, c in pairs] if flip else pairs


def matched(iou: np.ndarray, threshold: float | None = None) -> tuple[int, float]:
    """How many pairs match, and their total IoU.

    With a threshold: as many pairs at or above it as there can be, and among
    those the largest total. Without: the largest total, over overlapping pairs.
    """
    if iou.size == 0:
        return 0, 0.0
    allowed = iou > 0 if threshold is None else iou >= threshold
    if not allowed.any():
        return 0, 0.0
    bonus = 0.0 if threshold is None else 2.0 * min(iou.shape)
    pairs = [(i, j) for i, j in assign(np.where(allowed, iou + bonus, 0.0)) if allowed[i, j]]
    return len(pairs), float(sum(iou[i, j] for i, j in pairs))


def largest(edges: list[list[int]]) -> int:
    """The most pairs that can be made: ``edges`` has, for each row, the columns it may take (augmenting paths)."""
    owner: dict[int, int] = {}

    def place(row: int, tried: set[int]) -> bool:
        for col in edges[row]:
            if col not in tried:
                tried.add(col)
                if col not in owner or place(owner[col], tried):
                    owner[col] = row
                    return True
        return False

    return sum(place(row, set()) for row in range(len(edges)))


def true_positives(iou: np.ndarray) -> list[int]:
    """Matches at each of ``THRESHOLDS``; the same edges match alike, and none match none."""
    out: list[int] = []
    before = -1
    for t in THRESHOLDS:
        allowed = iou >= t
        n = int(allowed.sum())
        if n != before:  # edges only ever go as the threshold rises
            out.append(largest([np.flatnonzero(r).tolist() for r in allowed]) if n else 0)
        else:
            out.append(out[-1])
        before = n
    return out


def assign_many(gain: np.ndarray) -> np.ndarray:
    """For each matrix of ``gain`` (sets, rows, columns; no more rows than columns), the column of every row in an assignment of the largest total gain."""
    sets, n, m = gain.shape
    cost = -gain
    row_price, col_price = np.zeros((sets, n)), np.zeros((sets, m))
    owner = np.full((sets, m), -1)
    for row in range(n):
        dist, via, done = np.full((sets, m), np.inf), np.full((sets, m), -1), np.zeros((sets, m), bool)
        at, base, last = np.full(sets, row), np.zeros(sets), np.full(sets, -1)
        open_ = np.arange(sets)
        while len(open_):
            step = base[open_, None] + cost[open_, at[open_]] - row_price[open_, at[open_], None] - col_price[open_]
            better = ~done[open_] & (step < dist[open_])
            dist[open_] = np.where(better, step, dist[open_])
            via[open_] = np.where(better, last[open_, None], via[open_])
            ahead = np.where(done[open_], np.inf, dist[open_])
            last[open_] = nearest = ahead.argmin(axis=1)
            base[open_] = ahead[np.arange(len(open_)), nearest]
            done[open_, nearest] = True
            held = owner[open_, nearest]
            open_ = open_[held >= 0]
            at[open_] = held[held >= 0]
        row_price[:, row] += base
        gap = np.where(done, base[:, None] - dist, 0.0)
        col_price -= gap
        which, col = np.nonzero(done & (owner >= 0))
        row_price[which, owner[which, col]] += gap[which, col]
        open_ = np.arange(sets)
        while len(open_):  # hand columns on along the path
            col = last[open_]
            before = via[open_, col]
            owner[open_, col] = np.where(before < 0, row, owner[open_, before])
            last[open_] = before
            open_ = open_[before >= 0]
    out = np.full((sets, n), -1)
    which, col = np.nonzero(owner >= 0)
    out[which, owner[which, col]] = col
    return out


def _totals(gain: np.ndarray) -> np.ndarray:
    """The largest total gain of each matrix; gains that are not above zero are no pairs."""
    if gain.shape[1] > gain.shape[2]:
        gain = gain.transpose(0, 2, 1)
    edges = gain > 0
    rows_apart, cols_apart = (edges.sum(axis=k).max(axis=1) <= 1 for k in (1, 2))  # a column (row) has one row (column) at most
    out = np.where(rows_apart, gain.max(axis=2).sum(axis=1), gain.max(axis=1).sum(axis=1))
    hard = np.flatnonzero(~rows_apart & ~cols_apart)
    if len(hard):
        some = gain[hard]
        col = assign_many(some)
        out[hard] = np.take_along_axis(some, col[:, :, None], axis=2)[:, :, 0].sum(axis=1)
    return out


def _buckets(n: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Sets of like sizes with the shape that holds them: powers of two a side, and at most ``CELLS`` overlaps together."""
    wide, high = (1 << np.ceil(np.log2(np.maximum(x, 1))).astype(int) for x in (n, m))
    order = np.lexsort((high, wide))
    cuts = np.flatnonzero(np.diff(wide[order]) | np.diff(high[order])) + 1
    for part in np.split(order, cuts):
        shape = int(wide[part[0]]), int(high[part[0]])
        step = max(1, CELLS // (shape[0] * shape[1]))
        for lo in range(0, len(part), step):
            yield part[lo : lo + step], *shape


def _padded(boxes: np.ndarray, at: np.ndarray, which: np.ndarray, size: int) -> np.ndarray:
    """(sets, size, 4): the boxes of some sets; what is missing has no area."""
    out = np.zeros((len(which), size, 4))
    sizes = at[which + 1] - at[which]
    row = np.repeat(np.arange(len(which)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = boxes[np.repeat(at[which], sizes) + place]
    return out


def match_many(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, totals: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Matches at each of ``THRESHOLDS`` and the largest total IoU (0 unless asked for) of many pairs of sets; ``a`` and ``b`` hold all boxes, ``*_at`` where each set's begin (and the end)."""
    n, m = np.diff(a_at), np.diff(b_at)
    counts, total = np.zeros((len(n), len(THRESHOLDS)), np.int32), np.zeros(len(n))
    both = np.flatnonzero((n > 0) & (m > 0))
    for part, wide, high in _buckets(n[both], m[both]) if len(both) else ():
        which = both[part]
        left, right = _padded(a, a_at, which, wide)[:, :, None], _padded(b, b_at, which, high)[:, None]
        w, h = (np.clip(np.minimum(left[..., k + 2], right[..., k + 2]) - np.maximum(left[..., k], right[..., k]), 0, None) for k in (0, 1))
        shared = w * h
        size = [(x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]) for x in (left, right)]
        whole = size[0] + size[1] - shared
        iou = np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)
        before, known = None, np.zeros(len(which), np.int32)
        for k, threshold in enumerate(THRESHOLDS):
            allowed = iou >= threshold
            edges = allowed.sum(axis=(1, 2))
            new = np.flatnonzero(edges != before) if k else np.flatnonzero(edges)  # edges only ever go as the threshold rises
            known[new] = np.rint(_totals(allowed[new].astype(float))) if len(new) else 0
            counts[which, k] = known
            before = edges
        if totals:
            total[which] = _totals(iou)
    return counts, total
