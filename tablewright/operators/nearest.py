"""Numpy helpers of the nearest-neighbour search: a tree of cells, distance bounds of cells, k best rows.

They see a bounded sample, the cells' bounds, or the rows of one task, never a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TOGETHER = 1 << 21  # numbers that a step works on at a time
_MORE = 1 - 1e-9  # keeps rounding from lifting a bound above a true distance


def matrix(rows, names) -> np.ndarray:
    """Columns of Arrow rows as a matrix of doubles, NULL as NaN."""
    return np.column_stack([rows.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])


def blocks(points: np.ndarray, numbers: int):
    """(first row, rows) of points that are compared together with so many numbers."""
    step = max(1, TOGETHER // max(1, numbers))
    return ((first, points[first : first + step]) for first in range(0, len(points), step))


def squared_distances(receivers: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Squared distances over the coordinates both rows have, scaled up to all.

    Rows without a common coordinate are infinitely far apart.
    """
    total = np.zeros((len(receivers), len(donors)))
    shared = np.zeros((len(receivers), len(donors)))
    for a, b in zip(receivers.T, donors.T):
        gap = (a[:, None] - b[None, :]) ** 2
        known = ~np.isnan(gap)
        total += np.where(known, gap, 0.0)
        shared += known
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = total * receivers.shape[1] / shared
    return np.where(shared > 0, scaled, np.inf)


@dataclass
class CellTree:
    """A tree that gives every row a cell: each node asks whether one coordinate is NULL, below a cut, or not below.

    Node ``n`` has its three children in ``children[n]`` (NULL, below, not below); a negative child is cell -child - 1.
    """

    coordinate: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    cells: int

    def cells_of(self, points: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(points), dtype=np.int64)
        if self.cells == 1:
            return cell
        node, open_ = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        while len(open_):
            at = node[open_]
            x = points[open_, self.coordinate[at]]
            turn = np.where(np.isnan(x), 0, np.where(x < self.cut[at], 1, 2))
            node[open_] = self.children[at, turn]
            ended = node[open_] < 0
            cell[open_[ended]] = -node[open_[ended]] - 1
            open_ = open_[~ended]
        return cell


def grow_tree(sample: np.ndarray, cells: int) -> CellTree:
    """A tree of about ``cells`` cells with like shares of the sample; identical points stay in one cell."""
    coordinate, cut, children = [], [], []
    least = max(2, len(sample) // max(cells, 1))
    ended = 0
    waiting = [(np.arange(len(sample)), None)]
    while waiting:
        rows, place = waiting.pop()
        x = sample[rows]
        known = ~np.isnan(x)
        split = None
        if len(rows) > least and cells > 1:
            low = np.where(known, x, np.inf).min(axis=0)
            high = np.where(known, x, -np.inf).max(axis=0)
            with np.errstate(invalid="ignore"):
                spread = np.where(known.any(axis=0), high - low, 0.0)
            mixed = known.any(axis=0) & ~known.all(axis=0)
            if np.nanmax(spread, initial=0.0) > 0:
                split = int(np.nanargmax(spread))
                values = np.sort(x[known[:, split], split])
                at = values[len(values) // 2]
                middle = at if at > values[0] else values[np.searchsorted(values, at, "right")]
            elif mixed.any():
                split, middle = int(np.argmax(mixed)), -np.inf
        if split is None:
            node, ended = -ended - 1, ended + 1
        else:
            node = len(coordinate)
            coordinate.append(split)
            cut.append(middle)
            children.append([0, 0, 0])
            value = x[:, split]
            sides = (~known[:, split], known[:, split] & (value < middle), known[:, split] & ~(value < middle))
            waiting += [(rows[side], (node, turn)) for turn, side in enumerate(sides)]
        if place is not None:
            children[place[0]][place[1]] = node
    return CellTree(np.array(coordinate, dtype=np.int64), np.array(cut), np.array(children, dtype=np.int64).reshape(-1, 3), ended)


@dataclass
class Cells:
    """What all rows of each cell have in common: bounds and number of known values per coordinate."""

    cell: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    known: np.ndarray

    def least_distances(self, points: np.ndarray) -> np.ndarray:
        """For each point and cell, a distance that no row of the cell is nearer than.

        Coordinates that all rows of the cell know are shared for sure. Those that some rows know may be shared: the
        smallest gaps among them are taken in as long as they lower the mean. Infinite values have no bound.
        """
        width = points.shape[1]
        with np.errstate(invalid="ignore"):
            gaps = np.maximum(np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None]), 0.0) ** 2
        asked = ~np.isnan(points)[:, None, :]
        always = asked & (self.known == self.rows[:, None])[None]
        perhaps = asked & ((self.known > 0) & (self.known < self.rows[:, None]))[None]
        total = np.where(always, gaps, 0.0).sum(axis=2)
        count = always.sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            best = np.where(count > 0, total / count, np.inf)
            if perhaps.any():
                further = np.sort(np.where(perhaps, gaps, np.inf), axis=2)
                for j in range(width):
                    total = total + further[:, :, j]
                    count = count + 1
                    best = np.minimum(best, np.where(np.isfinite(total), total / count, np.inf))
        best[np.isinf(points).any(axis=1)[:, None] | (np.isinf(self.low) | np.isinf(self.high)).any(axis=1)[None]] = 0.0
        return best * width * _MORE

    def homes(self, points: np.ndarray, k: int) -> np.ndarray:
        """Which cells points visit first: for each gap the nearest cell with k donors for it, or else with any."""
        least = self.least_distances(points)
        visits = np.zeros(least.shape, dtype=bool)
        for t in range(points.shape[1]):
            open_ = np.flatnonzero(np.isnan(points[:, t]))
            full, any_ = (np.where(self.known[:, t] >= n, least[open_], np.inf) for n in (k, 1))
            far = np.where(np.isfinite(full).any(axis=1)[:, None], full, any_)
            home = far.argmin(axis=1)
            some = np.isfinite(far[np.arange(len(open_)), home])
            visits[open_[some], home[some]] = True
        return visits

    def within(self, points: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Which cells may have donors as near as the limits of the points' gaps."""
        least = self.least_distances(points)
        visits = np.zeros(least.shape, dtype=bool)
        for t in range(points.shape[1]):
            near = (self.known[:, t] > 0)[None] & np.isfinite(least) & (least <= limits[:, t][:, None])
            visits |= np.isnan(points[:, t])[:, None] & near
        return visits


def k_best(points: np.ndarray, donors: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, donor, distance) of each point's k nearest donors that have a value; the earlier donor wins a tie."""
    usable = np.flatnonzero(~np.isnan(values))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first, block in blocks(points, len(usable)):
        distance = squared_distances(block, donors[usable])
        if distance.shape[1] > k:
            limit = np.partition(distance, k - 1, axis=1)[:, k - 1]
            point, donor = np.nonzero((distance <= limit[:, None]) & np.isfinite(distance))
        else:
            point, donor = np.nonzero(np.isfinite(distance))
        near = distance[point, donor]
        order = np.lexsort((donor, near, point))
        point, donor, near = point[order], donor[order], near[order]
        heads = np.flatnonzero(np.diff(point, prepend=-1))
        rank = np.arange(len(point)) - np.repeat(heads, np.diff(np.append(heads, len(point))))
        kept = rank < k
        found.append((point[kept] + first, usable[donor[kept]], near[kept]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))
