"""Maximising a smooth function within a box, by a projected quasi-Newton method."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def climb(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 80, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """A point no lower than ``x``, and its value. ``f`` gives value and gradient.

    Directions come from the updates of Broyden, Fletcher, Goldfarb and Shanno, for the coordinates
    that no bound holds; steps are halved until the value rises enough, and cut off at the bounds.
    """
    x = np.clip(np.asarray(x, float), low, high)
    value, slope = f(x)
    curve = np.eye(len(x))  # the inverse of the negative second derivatives, as learnt so far
    for _ in range(steps):
        free = ~((x <= low) & (slope < 0) | (x >= high) & (slope > 0))
        if not np.isfinite(value) or not np.abs(slope[free]).max(initial=0.0) > tolerance:
            break
        direction = np.zeros(len(x))
        direction[free] = curve[np.ix_(free, free)] @ slope[free]
        if direction @ slope <= 0:
            curve = np.eye(len(x))
            direction = np.where(free, slope, 0.0)
        length = min(1.0, float((high - low).max()) / np.abs(direction).max())
        for _ in range(30):
            trial = np.clip(x + length * direction, low, high)
            new, new_slope = f(trial)
            if new > value and new >= value + 1e-4 * slope @ (trial - x):
                break
            length /= 2
        else:
            break
        moved, turned = trial - x, slope - new_slope
        if (c := moved @ turned) > 1e-14:
            side = np.eye(len(x)) - np.outer(moved, turned) / c
            curve = side @ curve @ side.T + np.outer(moved, moved) / c
        gained, x, value, slope = new - value, trial, new, new_slope
        if gained <= tolerance * (1e-3 + abs(value)) * 1e-3:
            break
    return x, value
