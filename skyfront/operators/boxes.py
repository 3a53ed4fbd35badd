"""The region that a front leaves undominated, as disjoint boxes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Boxes:
    """Disjoint boxes [low, high) that fill what lies beyond ``ref`` and no point so far dominates.

    A new point takes from every box that reaches below it the corner that it dominates; what is left of
    such a box is cut along one objective after another. So points can come one at a time, in any
    order, and boxes that a point doesn't reach stay as they are.
    """

    def __init__(self, ref: Iterable[float]):
        self.ref = np.asarray(tuple(ref), float)
        self.low, self.high = self.ref[None].copy(), np.full((1, len(self.ref)), np.inf)

    def add(self, point: np.ndarray) -> Boxes:
        point = np.asarray(point, float)
        hit = (self.low < point).all(1)
        if not hit.any():
            return self
        lows, highs = [self.low[~hit]], [self.high[~hit]]
        low, high = self.low[hit], self.high[hit].copy()
        for k, p in enumerate(point):
            over = high[:, k] > p
            rest = low[over].copy()
            rest[:, k] = p
            lows.append(rest)
            highs.append(high[over].copy())
            high[:, k] = np.minimum(high[:, k], p)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        return self

    def take(self, points: np.ndarray) -> Boxes:
        """High points first, so that those below them cost nothing."""
        points = np.asarray(points, float).reshape(-1, len(self.ref))
        for p in points[np.argsort(-points.sum(1), kind="stable")]:
            self.add(p)
        return self

    def gain(self, y: np.ndarray, rows: int = 4096) -> np.ndarray:
        """The volume that each row of ``y`` would add."""
        out = np.empty(len(y))
        for i in range(0, len(y), rows):
            out[i : i + rows] = np.maximum(np.minimum(y[i : i + rows, None], self.high) - self.low, 0).prod(2).sum(1)
        return out

    def slope(self, y: np.ndarray) -> np.ndarray:
        """The derivative of :meth:`gain` by each objective, [rows, objectives]."""
        sides = np.maximum(np.minimum(y[:, None], self.high) - self.low, 0)
        inside = (y[:, None] > self.low) & (y[:, None] < self.high)
        out = np.empty(y.shape)
        for k in range(y.shape[1]):
            out[:, k] = (inside[:, :, k] * np.delete(sides, k, 2).prod(2)).sum(1)
        return out
