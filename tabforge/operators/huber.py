"""Linear Huber regression on random Fourier features whose mapped rows are never kept (L3g).

MLlib's ``LinearRegression(loss="huber")`` writes every mapped row (64 numbers, whatever the table's width) into blocks of its own, on disk
what memory does not take.  Here only the rows they are made of are held, by the caller.  A pass over them maps a slice at a time and gives
one row of sums a partition; the driver adds these up and takes the optimizer's step.

The model is MLlib's, up to the order of sums: loss, scale and penalty, features scaled by their standard deviation and centred through the
intercept, all ones to begin with, and Breeze's ``LBFGSB`` (Byrd, Lu, Nocedal & Zhu 1995; strong Wolfe line search), which keeps the scale above 0.
A constant label gives the constant model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Residuals beyond so many scales count linearly; MLlib's figure.
EPSILON = 1.35
#: Rows mapped at once: their map stays in the processor's cache.
SLICE = 512
#: sin(2 pi g) / g as a polynomial in g^2, for |g| <= 1/4.
SINE = [(-1) ** k * (2 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(12)]

#: Longer steps looked at beside one that is itself longer than the first.
AHEAD = 7

Losses = Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]]


class Map:
    """Rows to Fourier features, ``SLICE`` at a time, in arrays that are used again."""

    def __init__(self, rff: dict):
        self.w, self.b = np.array(rff["w"]).T / (2 * math.pi), np.array(rff["b"]) / (2 * math.pi)
        self.scale = math.sqrt(2.0 / rff["dim"])
        self.turns, self.z = (np.empty((SLICE, rff["dim"])) for _ in range(2))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The map of these rows; the next call writes over it."""
        g, z = self.turns[:len(x)], self.z[:len(x)]
        np.matmul(x, self.w, out=g)
        g += self.b
        # cos(2 pi g) = sin(2 pi (1/4 - |g|)) for the part of a turn left, |g| <= 1/2: several times as fast as cos
        np.rint(g, out=z)
        g -= z
        np.abs(g, out=g)
        np.subtract(0.25, g, out=g)
        square = g * g
        np.multiply(square, SINE[-1], out=z)
        for c in SINE[-2:0:-1]:
            z += c
            z *= square
        z += SINE[0]
        z *= g
        z *= self.scale
        return z


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels; the label is the last column."""
    for batch in batches:
        t = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        for i in range(0, len(t), SLICE):
            yield np.ascontiguousarray(t[i:i + SLICE, :-1]), t[i:i + SLICE, -1]


def _collected(rows: DataFrame, sums: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], tuple[int, list]]) -> list[tuple[int, np.ndarray]]:
    """Count and sums of each partition that has rows, in the partitions' order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, values = sums(_slices(batches))
        yield pa.RecordBatch.from_pydict({"at": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()),
                                          "sums": pa.array([[float(v) for v in values]], pa.list_(pa.float64()))})

    found = rows.mapInArrow(run, "at long, n long, sums array<double>").collect()
    return [(r["n"], np.array(r["sums"])) for r in sorted(found, key=lambda r: r["at"]) if r["n"]]


def moments(rows: DataFrame, rff: dict) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sample standard deviations of the mapped features and, last, of the label."""
    def sums(slices):
        mapped, n, first, total, square, low, high = Map(rff), 0, None, 0.0, 0.0, math.inf, -math.inf
        for x, y in slices:
            v = np.column_stack([mapped(x), y])
            first = v[0].copy() if first is None else first
            v -= first                                  # differences from a row: sums of squares lose nothing to the mean's size
            n, total, square = n + len(v), total + v.sum(0), square + np.einsum("ij,ij->j", v, v)
            low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        return n, [] if first is None else [*(first + total / n), *(square - total * total / n), *low, *high]

    n, mean, m2, low, high = 0, 0.0, 0.0, math.inf, -math.inf
    k = rff["dim"] + 1
    for m, v in _collected(rows, sums):
        apart, n = v[:k] - mean if n else 0.0, n + m
        mean, m2 = (mean + apart * (m / n), m2 + v[k:2 * k] + apart * apart * (m * (n - m) / n)) if n > m else (v[:k], v[k:2 * k])
        low, high = np.minimum(low, v[2 * k:2 * k + (len(v) - 2 * k) // 2]), np.maximum(high, v[2 * k + (len(v) - 2 * k) // 2:])
    if not n:
        raise ValueError("no rows to fit")
    std = np.sqrt(np.maximum(m2, 0.0) / max(n - 1, 1))
    if (low == high).all():
        std[:-1] = 0.0                                  # one point, however its maps were rounded
    return n, mean, std


def fit(rows: DataFrame, rff: dict, penalty: float, max_iter: int = 100, tol: float = 1e-6) -> dict:
    """``coef``, ``intercept`` and ``scale`` for ``rows`` (features in the map's order, then the label; all known doubles), and the ``history`` of losses."""
    dim = rff["dim"]
    n, mean, std = moments(rows, rff)
    if std[-1] == 0.0:
        return {"coef": [0.0] * dim, "intercept": float(mean[-1]), "scale": 1.0, "history": [0.0]}
    inverse = np.divide(1.0, std[:-1], out=np.zeros(dim), where=std[:-1] > 0)
    centre = mean[:-1] * inverse

    def losses(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Loss and gradient at each point, by one pass: the rows are mapped once for all."""
        p = np.array(points)
        coef, sigma = p[:, :dim], p[:, -1]
        linear, offset = (coef * inverse).T, p[:, dim] - coef @ centre

        def sums(slices):
            mapped, n, at = Map(rff), 0, np.zeros((len(p), dim + 3))
            with np.errstate(all="ignore"):
                for x, y in slices:
                    z = mapped(x)
                    off = y[:, None] - (z @ linear + offset)
                    near = np.clip(off / sigma, -EPSILON, EPSILON)       # the scale may be next to 0
                    square = np.einsum("ij,ij->j", near, near)
                    n += len(y)
                    at[:, :dim] -= near.T @ z
                    at[:, dim] -= near.sum(0)
                    at[:, dim + 1] += 0.5 * (len(y) - square)
                    at[:, dim + 2] += np.einsum("ij,ij->j", near, off) + 0.5 * sigma * (len(y) - square)
            return n, at.ravel()

        s = (sum(v for _, v in _collected(rows, sums)) / n).reshape(len(p), -1)
        return [(float(v[-1] + 0.5 * penalty * (c @ c)), np.concatenate([inverse * v[:dim] - v[dim] * centre + penalty * c, v[dim:dim + 2]])) for v, c in zip(s, coef)]

    start = np.ones(dim + 2)
    start[dim] += centre.sum()
    lower, upper = np.full(dim + 2, -np.finfo(float).max), np.full(dim + 2, np.finfo(float).max)
    lower[-1] = 5e-324
    p, history = minimize(losses, start, lower, upper, max_iter, tol)
    return {"coef": (p[:dim] * inverse).tolist(), "intercept": float(p[dim] - p[:dim] @ centre), "scale": float(p[-1]), "history": history}


# ---- Breeze's LBFGSB --------------------------------------------------------------
class SearchError(Exception):
    """No step was found along the direction."""


class History:
    """The last ``size`` steps and the Hessian ``theta I - W M W'`` they imply."""

    def __init__(self, n: int, size: int = 10):
        self.size, self.theta = size, 1.0
        self.w, self.m = np.zeros((n, 2 * size)), np.zeros((2 * size, 2 * size))
        self.s, self.y = np.zeros((n, 0)), np.zeros((n, 0))

    def after(self, s: np.ndarray, y: np.ndarray) -> History:
        if not np.finfo(float).eps * np.linalg.norm(y) < abs(s @ y):
            return self
        h = History(len(s), self.size)
        h.s, h.y = (np.column_stack([a, v])[:, -self.size:] for a, v in ((self.s, s), (self.y, y)))
        h.theta = (y @ y) / (y @ s)
        h.w = np.column_stack([h.y, h.s * h.theta])
        a = h.s.T @ h.y
        low = np.tril(a, -1)
        h.m = np.linalg.inv(np.block([[-np.diag(np.diag(a)), low.T], [low, (h.s.T @ h.s) * h.theta]]))
        return h


def _cauchy_point(h: History, x: np.ndarray, g: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first minimum of the quadratic model along the projected gradient, and W' of the way there."""
    n = len(x)
    t = np.where(g == 0, np.finfo(float).max, (x - np.where(g < 0, upper, lower)) / g)
    d = np.where((g == 0) | (t == 0), 0.0, -g)
    found, p, c = x.copy(), h.w.T @ d, np.zeros(len(h.m))
    first = g @ d
    second = -h.theta * first - p @ (h.m @ p)
    step, old = -(first / second), 0.0
    order = np.argsort(t, kind="stable")
    i = int(np.argmax(t[order] != 0))
    while i < n and t[order[i]] - old <= step:
        b = order[i]
        ahead = t[b] - old
        found[b] = upper[b] if d[b] > 0 else lower[b]
        z = found[b] - x[b]
        c = c + p * ahead
        w = h.w[b]
        first += ahead * second + g[b] * g[b] + h.theta * g[b] * z - g[b] * (w @ (h.m @ c))
        second += -h.theta * g[b] * g[b] - 2.0 * g[b] * (w @ (h.m @ p)) - g[b] * g[b] * (w @ (h.m @ w))
        p = p + w * g[b]
        d[b] = 0.0
        step, old, i = -first / second, t[b], i + 1
    step = max(step, 0.0)
    rest = order[i:]
    found[rest] = x[rest] + (old + step) * d[rest]
    return found, c + p * step


def _subspace_minimum(h: History, cauchy: np.ndarray, x: np.ndarray, c: np.ndarray, g: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The quadratic model's minimum over the variables that the Cauchy point leaves free, cut at the bounds."""
    free = np.flatnonzero((cauchy != upper) & (cauchy != lower))
    w = h.w[free]
    r = (g + (cauchy - x) * h.theta - h.w @ (h.m @ c))[free]
    inner = np.eye(len(h.m)) - h.m @ ((w.T @ w) / h.theta)
    du = -(r / h.theta + (w @ np.linalg.solve(inner, h.m @ (w.T @ r))) / h.theta ** 2)
    room = np.where(du > 0, upper[free] - cauchy[free], lower[free] - cauchy[free])[du != 0] / du[du != 0]
    out = cauchy.copy()
    out[free] += max(min(1.0, room.min(initial=1.0)), 0.0) * du
    return out


def _between(a: tuple, b: tuple) -> float:
    """The minimum of the cubic through two points (place, value, slope), not near their ends."""
    (t, f, d), (u, e, k) = a, b
    with np.errstate(all="ignore"):
        s = d + k - 3 * np.float64(f - e) / (t - u)
        q = np.sqrt(s * s - d * k)
        v = u - (u - t) * (k + q - s) / (k - d + 2 * q)
    return float(min(max(v, t + 0.1 * (u - t)), t + 0.9 * (u - t))) if v == v else math.nan


def _line_search(phi: Callable[..., tuple[float, float]], bound: float, most: int = 64) -> float:
    """A step of at most ``bound`` by the strong Wolfe conditions (1e-4, 0.9), tried from 1 up.  ``phi`` is told which steps may come next."""
    if bound < 1.0:
        raise ValueError("the bound leaves no whole step")
    f0, d0 = phi(0.0)
    if d0 > 0:
        raise SearchError

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(most):
            t = _between(high, low) if low[0] > high[0] else _between(low, high)
            if t != t:
                raise SearchError
            c = (t, *phi(t))
            if c[1] > f0 + 1e-4 * t * d0 or c[1] >= low[1]:
                high = c
            elif abs(c[2]) <= 0.9 * abs(d0):
                return t
            else:
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchError

    t, low = 1.0, (0.0, f0, d0)
    for i in range(most):
        ahead = [min(t * 1.5 ** k, bound) for k in range(1, AHEAD + 1)] if i else []
        c = (t, *phi(t, *ahead))
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > f0 + 1e-4 * t * d0 or (c[1] >= low[1] and i):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(d0):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        if t == bound:
            return bound
        t = min(1.5 * t, bound)
    raise SearchError


def minimize(f: Losses, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """Where Breeze's ``LBFGSB`` stops from ``start``, and the values on its way."""
    seen: list = []

    def at(*points: np.ndarray) -> tuple[float, np.ndarray]:
        if not any(np.array_equal(p, points[0]) for p, _ in seen):
            seen[:] = zip(points, f(list(points)))
        return next(v for p, v in seen if np.array_equal(p, points[0]))

    def step(x: np.ndarray, d: np.ndarray, t: float) -> np.ndarray:
        return np.clip(x + d * t, lower, upper)

    x = start
    value, g = at(x)
    h, first, recent, history, failed, k = History(len(x)), value, [math.inf], [value], False, 0
    while k < max_iter:
        if np.abs(np.clip(x - g, lower, upper) - x).max() < 1e-5 or np.linalg.norm(g) <= max(tol * abs(value), 1e-8):
            break
        if len(recent) >= 2 and abs(value - max(recent)) <= tol * abs(first):
            break
        try:
            with np.errstate(all="ignore"):
                cauchy, c = _cauchy_point(h, x, g, lower, upper)
                cauchy = np.clip(cauchy, lower, upper)
                d = (np.clip(_subspace_minimum(h, cauchy, x, c, g, lower, upper), lower, upper) if k else cauchy) - x
                room = (np.where(d < 0, lower, upper) - x)[d != 0] / d[d != 0]

            def phi(*steps: float) -> tuple[float, float]:
                v, slope = at(*(step(x, d, t) for t in steps))
                return v, float(slope @ d)

            there = step(x, d, _line_search(phi, float(room.min(initial=math.inf))))
        except SearchError:
            if failed:
                break
            failed, h = True, History(len(x))
            history.append(value)
            continue
        value, now = at(there)
        h = h.after(there - x, now - g)
        x, g, failed, k = there, now, False, k + 1
        recent = [*recent, value][-20:]
        history.append(value)
    return x, history
