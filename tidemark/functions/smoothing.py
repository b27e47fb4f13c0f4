"""Additive damped exponential smoothing with an optional season, fitted by a simplex search: a kernel for one series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

#: The range of the damping factor.
DAMPING = (0.8, 0.98)


@dataclass(frozen=True)
class Parameters:
    level: float
    trend: float
    season: float
    damping: float


@dataclass
class Path:
    """One-step forecasts of a series, and after each value the level, the trend and the coming season's terms."""

    ahead: list[float]
    levels: list[float]
    trends: list[float]
    terms: list[float]  # the season's first terms, then the term of each value
    cycle: int

    def point(self, i: int, horizon: int, damping: float) -> float:
        """The forecast `horizon` steps after value i."""
        out = self.levels[i] + self.trends[i] * sum(damping**k for k in range(1, horizon + 1))
        if self.cycle:
            # the term of the latest cycle that is known after value i
            back = i + horizon - self.cycle * -(-horizon // self.cycle)
            out += self.terms[self.cycle + back]
        return out


def first_states(y: Sequence[float], cycle: int) -> tuple[float, float, list[float]]:
    """Level, trend and season before the first value: from two cycles, or from two values without a season."""
    if not cycle:
        return y[0] - (y[1] - y[0]), y[1] - y[0], []
    one, two = (sum(y[k * cycle : (k + 1) * cycle]) / cycle for k in (0, 1))
    slope = (two - one) / cycle
    level = one - slope * (cycle + 1) / 2
    rest = [(y[i] - level - slope * (i + 1) + y[i + cycle] - level - slope * (i + cycle + 1)) / 2 for i in range(cycle)]
    mean = sum(rest) / cycle
    return level + mean, slope, [r - mean for r in rest]


def path(y: Sequence[float], p: Parameters, cycle: int = 0) -> Path:
    """The recursion over a series; cycle 0: no season."""
    level, trend, season = first_states(y, cycle)
    a, b, g, d = p.level, p.trend, p.season, p.damping
    ahead, levels, trends, terms = [], [], [], list(season)
    for i, v in enumerate(y):
        s = terms[i] if cycle else 0.0
        base = level + d * trend
        ahead.append(base + s)
        new = a * (v - s) + (1 - a) * base
        trend = b * (new - level) + (1 - b) * d * trend
        level = new
        if cycle:
            terms.append(g * (v - base) + (1 - g) * s)
        levels.append(level)
        trends.append(trend)
    return Path(ahead, levels, trends, terms, cycle)


def squared_error(y: Sequence[float], p: Parameters, cycle: int = 0) -> float:
    """The squares of path's one-step errors in sum, without the path: a search asks for it some hundred times."""
    level, trend, terms = first_states(y, cycle)
    a, b, g, d = p.level, p.trend, p.season, p.damping
    left_a, left_b, left_g = 1 - a, 1 - b, 1 - g
    errors = []
    if cycle:
        for i, v in enumerate(y):
            s = terms[i]
            base = level + d * trend
            errors.append((v - (base + s)) ** 2)
            new = a * (v - s) + left_a * base
            trend = b * (new - level) + left_b * d * trend
            level = new
            terms.append(g * (v - base) + left_g * s)
    else:
        for v in y:
            base = level + d * trend
            errors.append((v - base) ** 2)
            new = a * v + left_a * base
            trend = b * (new - level) + left_b * d * trend
            level = new
    return sum(errors)


def simplex(f: Callable[[list[float]], float], start: Sequence[float], *, step: float = 1.0, rounds: int = 160, tolerance: float = 1e-7) -> list[float]:
    """Nelder and Mead's search for a minimum; the same start gives the same end."""
    n = len(start)
    points = [list(start), *([x + step * (i == j) for j, x in enumerate(start)] for i in range(n))]
    ranked = sorted(((f(p), p) for p in points), key=lambda t: t[0])
    for _ in range(rounds):
        if ranked[-1][0] - ranked[0][0] <= tolerance * (abs(ranked[0][0]) + tolerance):
            break
        worst, p = ranked[-1]
        centre = [sum(q[j] for _, q in ranked[:-1]) / n for j in range(n)]
        at = lambda t: [c + t * (c - x) for c, x in zip(centre, p, strict=True)]
        one = at(1.0)
        value = f(one)
        if value < ranked[0][0]:
            far = at(2.0)
            best = min((f(far), far), (value, one), key=lambda t: t[0])
        elif value < ranked[-2][0]:
            best = (value, one)
        else:
            near = at(0.5 if value < worst else -0.5)
            best = (f(near), near)
            if best[0] >= min(value, worst):
                least = ranked[0][1]
                rest = [[(x + y) / 2 for x, y in zip(q, least, strict=True)] for _, q in ranked[1:]]
                ranked = sorted([ranked[0], *((f(q), q) for q in rest)], key=lambda t: t[0])
                continue
        ranked = sorted([*ranked[:-1], best], key=lambda t: t[0])
    return ranked[0][1]


def _share(x: float) -> float:
    return 1 / (1 + math.exp(-max(min(x, 40.0), -40.0)))


def parameters(x: Sequence[float]) -> Parameters:
    """From the search's unbounded numbers."""
    return Parameters(_share(x[0]), _share(x[1]), _share(x[2]) if len(x) > 3 else 0.0, DAMPING[0] + (DAMPING[1] - DAMPING[0]) * _share(x[-1]))


def fitted(y: Sequence[float], cycle: int = 0, start: Sequence[float] | None = None) -> list[float]:
    """The search's numbers of least squared one-step error over a series."""

    def loss(x: list[float]) -> float:
        return squared_error(y, parameters(x), cycle)

    first = [0.0, -2.0, -1.0, 1.0] if cycle else [0.0, -2.0, 1.0]
    if start is None or len(start) != len(first):
        start = first
    return simplex(loss, start)


def interval(point: float, errors: np.ndarray, horizon: int) -> tuple[float, float, float]:
    """(point, low, high): the mean error is taken off, and quantiles 0.1 and 0.9 of the rest, times the root of the horizon,
    are added; low and high hold the point."""
    bias = float(errors.mean())
    q = np.quantile(errors - bias, [0.1, 0.9]) * math.sqrt(horizon)
    point += bias
    return point, min(point, point + q[0]), max(point, point + q[1])
