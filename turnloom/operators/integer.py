"""A small exact integer program on the driver: bounded simplex for the bound, branch and bound for the proof.

It solves max c.z with A z = 0, 0 <= z <= u, z integer, for few rows (features) and as many columns as there are
distinct vectors. Bounds come from the dual prices, which are valid whatever their rounding; solutions are checked in
whole numbers.
"""

from __future__ import annotations

import math
import time

import numpy as np

#: A reduced cost or a step below this counts as zero.
TINY = 1e-9


class NotCertified(RuntimeError):
    """No solution could be proved best within the limits."""


def _pivots(cols: np.ndarray, cost: np.ndarray, upper: np.ndarray, x: np.ndarray, basis: np.ndarray, at_upper: np.ndarray) -> np.ndarray:
    """Primal simplex with bounds from a feasible basis; ``x``, ``basis`` and ``at_upper`` end at an optimum. Gives the prices."""
    m, n = cols.shape
    stalled = 0
    while True:
        b = cols[:, basis]
        prices = np.linalg.solve(b.T, cost[basis])
        gain = cost - prices @ cols
        gain[basis] = 0.0
        worth = np.where(at_upper, -gain, gain)
        worth[upper <= 0] = 0.0
        # Dantzig's rule, Bland's where the walk makes no headway
        enter = int(np.argmax(worth > TINY)) if stalled > 2 * (m + 1) else int(np.argmax(worth))
        if worth[enter] <= TINY:
            return prices
        sign = -1.0 if at_upper[enter] else 1.0
        d = sign * np.linalg.solve(b, cols[:, enter])
        room = np.full(m, np.inf)
        down, up = d > TINY, d < -TINY
        room[down] = np.maximum(x[basis][down], 0.0) / d[down]
        room[up] = np.maximum(upper[basis][up] - x[basis][up], 0.0) / -d[up]
        step = min(float(room.min()), float(upper[enter]))
        stalled = stalled + 1 if step <= TINY else 0
        x[basis] -= step * d
        x[enter] += sign * step
        if upper[enter] <= room.min():
            at_upper[enter] = not at_upper[enter]
            x[enter] = upper[enter] if at_upper[enter] else 0.0
            continue
        tied = np.flatnonzero(room <= step + TINY)
        leave = int(tied[np.argmin(basis[tied])])
        gone = basis[leave]
        at_upper[gone] = bool(up[leave])
        x[gone] = upper[gone] if up[leave] else 0.0
        basis[leave] = enter
        at_upper[enter] = False


def relaxation(c: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, np.ndarray] | None:
    """(upper bound, z) of the program without integrality between ``low`` and ``high``; None where nothing is feasible."""
    m, n = a.shape
    rest = -(a @ low)
    cols = np.hstack([a, np.diag(np.where(rest < 0, -1.0, 1.0))])
    upper = np.concatenate([high - low, np.full(m, np.inf)])
    x = np.concatenate([np.zeros(n), np.abs(rest)])
    basis, at_upper = np.arange(n, n + m), np.zeros(n + m, bool)
    if np.abs(rest).max(initial=0.0) > TINY:
        _pivots(cols, np.concatenate([np.zeros(n), -np.ones(m)]), upper, x, basis, at_upper)
        if x[n:].sum() > 1e-6:
            return None
    upper[n:] = 0.0
    x[n:] = 0.0
    prices = _pivots(cols, np.concatenate([c, np.zeros(m)]), upper, x, basis, at_upper)
    reduced = c - prices @ a
    bound = float(prices @ rest + c @ low + np.maximum(reduced, 0.0) @ (high - low))
    return bound, low + x[:n]


def maximise(c: list[int], a: list[list[int]], caps: list[int], start: list[int], seconds: float = 1800.0, nodes: int = 200_000) -> list[int]:
    """The best integer z, proved. ``start`` is feasible. NotCertified where the limits end the search before the proof."""
    cost = np.array(c, float)
    rows = np.array(a, float).reshape(len(a), len(c))
    scaled = rows / np.maximum(1.0, np.abs(rows).max(axis=1, keepdims=True, initial=0.0))
    best, value = list(start), sum(k * z for k, z in zip(c, start))
    until = time.monotonic() + seconds
    stack = [(np.zeros(len(c)), np.array(caps, float))]
    while stack:
        nodes -= 1
        if nodes < 0 or time.monotonic() > until:
            raise NotCertified("no certified maximum match: the search was ended by its limits")
        low, high = stack.pop()
        solved = relaxation(cost, scaled, low, high)
        if solved is None or math.floor(solved[0] + 1e-4) <= value:
            continue
        z = solved[1]
        whole = [int(v) for v in np.rint(z)]
        if np.abs(z - np.rint(z)).max(initial=0.0) < 1e-6 and all(sum(k * v for k, v in zip(row, whole)) == 0 for row in a):
            size = sum(k * v for k, v in zip(c, whole))
            if size > value:
                best, value = whole, size
            continue
        part = np.abs(z - np.rint(z))
        i = int(np.argmax(part))
        cut = math.floor(z[i] + 1e-9)
        above, below = (low.copy(), high), (low, high.copy())
        above[0][i], below[1][i] = cut + 1, cut
        # the nearer side is searched first
        stack += [below, above] if z[i] - cut > 0.5 else [above, below]
    return best
