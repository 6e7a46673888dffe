"""Small models of one group's rows: a tanh network, linear ones and trees. Groups are dealt to tasks by Spark."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

#: Layers of the network, its penalty, its seeds, iterations at most, and the largest gradient at which it stops.
LAYERS, PENALTY, SEEDS, ITERATIONS, TOLERANCE = (8, 4), 0.08, (17, 42, 91), 600, 1e-4
#: A fall of the value, beside its size, at which a fit ends.
STILL = 2.2e-9
CLIP = 6.0


def scaler(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the columns; a deviation under 1e-9 counts as 1."""
    sd = train.std(axis=0)
    return train.mean(axis=0), np.where(sd < 1e-9, 1.0, sd)


def scaled(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / sd, -CLIP, CLIP)


def quasi_newton(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, memory: int = 10) -> tuple[np.ndarray, bool]:
    """A minimum of ``f`` (value and gradient) by limited-memory BFGS; whether the gradient came under ``tolerance``, or the value stood still.

    The line search halves and doubles between bounds until the value has fallen
    enough and the slope has flattened (weak Wolfe conditions).
    """
    value, g = f(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for k in range(iterations):
        if np.abs(g).max() <= tolerance:
            return w, True
        d, kept = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ d)
            d -= a * y
            kept.append(a)
        if steps:
            s, y, rho = steps[-1]
            d *= 1 / (rho * (y @ y))
        for (s, y, rho), a in zip(steps, reversed(kept), strict=True):
            d += (a - rho * (y @ d)) * s
        slope = -(g @ d)
        if slope >= 0:  # no descent: start anew from the gradient
            d, slope, steps = g, -(g @ g), []
        low, high, t = 0.0, np.inf, 1.0 if steps or k else min(1.0, 1 / np.abs(g).sum())
        for _ in range(40):
            found, h = f(w - t * d)
            if not found <= value + 1e-4 * t * slope:
                high = t
            elif -(h @ d) < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * t
        s, y = -t * d, h - g
        if not found < value:
            return w, False
        still = value - found <= STILL * max(abs(value), abs(found), 1.0)
        w, value, g = w + s, found, h
        if still:
            return w, True
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[-(memory - 1) :], (s, y, 1 / (s @ y))]
    return w, bool(np.abs(g).max() <= tolerance)


def _shapes(inputs: int) -> list[tuple[int, int]]:
    sizes = (inputs, *LAYERS, 1)
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def _unflat(w: np.ndarray, inputs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in _shapes(inputs):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def network_told(w: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Forecasts of the network with the flat weights ``w``."""
    *hidden, (last, bias) = _unflat(w, z.shape[1])
    for m, b in hidden:
        z = np.tanh(z @ m + b)
    return (z @ last + bias)[:, 0]


def network_loss(w: np.ndarray, zt: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Half the mean squared error and ``penalty`` over the number of rows times half the squared weights without biases; its gradient.

    ``zt`` has a row for each column of the inputs, so that every sum runs along memory.
    """
    n, ((m1, b1), (m2, b2), (m3, b3)) = len(y), _unflat(w, len(zt))
    h1 = np.tanh(m1.T @ zt + b1[:, None])
    h2 = np.tanh(m2.T @ h1 + b2[:, None])
    e = m3[:, 0] @ h2 + b3[0] - y
    we = (e if weights is None else weights * e) / n
    d2 = m3 * we * (1 - h2 * h2)
    d1 = (m2 @ d2) * (1 - h1 * h1)
    p = penalty / n
    value = 0.5 * (we @ e) + 0.5 * p * ((m1 * m1).sum() + (m2 * m2).sum() + (m3 * m3).sum())
    parts = (zt @ d1.T + p * m1, d1.sum(axis=1), h1 @ d2.T + p * m2, d2.sum(axis=1), (h2 @ we)[:, None] + p * m3, we.sum(keepdims=True))
    return float(value), np.concatenate([x.ravel() for x in parts])


def fit_network(z: np.ndarray, y: np.ndarray, seed: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Flat weights of a network fitted to scaled rows, and whether it converged."""
    g = np.random.default_rng(seed)
    start = []
    for a, b in _shapes(z.shape[1]):
        bound = np.sqrt(6 / (a + b))
        start.append(g.uniform(-bound, bound, a * b + b))
    zt = np.ascontiguousarray(z.T)
    return quasi_newton(lambda w: network_loss(w, zt, y, weights), np.concatenate(start))


# linear models, from sums that can be aggregated anywhere ---------------------------------------


class Sums(NamedTuple):
    """Row count, means, and centred second moments (per row) of columns and target."""

    n: float
    mean: np.ndarray
    mean_y: float
    xx: np.ndarray
    xy: np.ndarray


def sums(z: np.ndarray, y: np.ndarray) -> Sums:
    c = z - z.mean(axis=0)
    return Sums(len(y), z.mean(axis=0), y.mean(), c.T @ c / len(y), c.T @ (y - y.mean()) / len(y))


def fit_ridge(s: Sums, penalty: float = 30.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of least squared error plus ``penalty`` times the squared weights; 0 is plain regression (least norm)."""
    a = s.xx + penalty / s.n * np.eye(len(s.xy))
    w = np.linalg.solve(a, s.xy) if penalty else np.linalg.lstsq(a, s.xy, rcond=None)[0]
    return w, float(s.mean_y - s.mean @ w)


def fit_elastic(s: Sums, strength: float = 0.001, share: float = 0.25, iterations: int = 5000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Weights and intercept of half the mean squared error plus ``strength`` times (``share`` of the absolute, the rest of half the squared weights), by coordinate descent."""
    w, curve = np.zeros(len(s.xy)), np.diag(s.xx) + strength * (1 - share)
    for _ in range(iterations):
        moved = 0.0
        for j in range(len(w)):
            if curve[j] <= 0:
                continue
            rest = s.xy[j] - s.xx[j] @ w + s.xx[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - strength * share, 0.0) / curve[j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= tolerance:
            break
    return w, float(s.mean_y - s.mean @ w)


def newton_step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, c: float = 0.1) -> np.ndarray:
    """The next weights (the last is the intercept, which bears no penalty) of a logistic fit with squared weights over 2 ``c``."""
    ridge = np.eye(len(w)) / c
    ridge[-1, -1] = 0.0
    return w - np.linalg.solve(hessian + ridge, gradient + ridge @ w)


def fit_logistic(z: np.ndarray, up: np.ndarray, c: float = 0.1, iterations: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Weights and, last, the intercept of a logistic fit by Newton's steps."""
    a = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(a.shape[1])
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        new = newton_step(w, a.T @ (p - up), (a * (p * (1 - p))[:, None]).T @ a, c)
        done, w = np.abs(new - w).max() <= tolerance, new
        if done:
            break
    return w


# trees -----------------------------------------------------------------------------------------


class Tree(NamedTuple):
    """Nodes in the order of a heap: the feature and the last bin that goes left (feature -1 at leaves), and the value of each node."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


def edges(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Cuts of each column between neighbouring values, all if they are fewer than ``bins``, else at equal shares of the rows."""
    out = []
    for column in x.T:
        values, counts = np.unique(column, return_counts=True)
        between = (values[1:] + values[:-1]) / 2
        if len(between) >= bins:
            at = np.searchsorted(np.cumsum(counts), np.arange(1, bins) * len(column) / bins)
            between = between[np.unique(np.minimum(at, len(between) - 1))]
        out.append(between)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])


def best_split(b: np.ndarray, g: np.ndarray, w: np.ndarray, width: int, least: float) -> tuple[int, int, float]:
    """(feature, last bin to the left, gain) of the split that lowers the weighted squared error of ``g`` most; feature -1 if none leaves ``least`` on both sides.

    One histogram over all features and bins holds the weights, another the sums.
    """
    k = b.shape[1]
    at = (b + np.arange(k) * width).ravel()
    count = np.bincount(at, np.repeat(w, k), k * width).reshape(k, width)
    total = np.bincount(at, np.repeat(w * g, k), k * width).reshape(k, width)
    left, sum_left = count.cumsum(axis=1), total.cumsum(axis=1)
    right, sum_right = left[:, -1:] - left, sum_left[:, -1:] - sum_left
    fits = (left >= least) & (right >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, sum_left**2 / left + sum_right**2 / right - sum_left[:, -1:] ** 2 / left[:, -1:], -1.0)
    best = int(gain.argmax())
    feature, cut = divmod(best, width)
    return (feature, cut, float(gain.flat[best])) if gain.flat[best] > 1e-14 else (-1, 0, 0.0)


def grow(b: np.ndarray, g: np.ndarray, w: np.ndarray, depth: int, least: float = 20) -> tuple[Tree, np.ndarray]:
    """A tree on binned columns, level by level, and the node that each row ends in."""
    size, width = 2 ** (depth + 1) - 1, int(b.max(initial=0)) + 1
    tree = Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size))
    node = np.zeros(len(b), int)
    for n in range(size):
        inside = np.flatnonzero((node == n) & (w > 0))
        if not len(inside):
            continue
        tree.value[n] = np.average(g[inside], weights=w[inside])
        if 2 * n + 2 < size:
            tree.feature[n], tree.cut[n], _ = best_split(b[inside], g[inside], w[inside], width, least)
        if tree.feature[n] >= 0:
            every = node == n
            node[every] = 2 * n + 1 + (b[every, tree.feature[n]] > tree.cut[n])
    return tree, node


def leaves(tree: Tree, b: np.ndarray) -> np.ndarray:
    node = np.zeros(len(b), int)
    while (split := tree.feature[node] >= 0).any():
        f = tree.feature[node[split]]
        node[split] = 2 * node[split] + 1 + (b[split, f] > tree.cut[node[split]])
    return node


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, seed: int = 17) -> Callable[[np.ndarray], np.ndarray]:
    """The mean of trees on rows drawn with replacement."""
    cuts, g = edges(x), np.random.default_rng(seed)
    b = binned(x, cuts)
    draws = (np.bincount(g.integers(0, len(y), len(y)), minlength=len(y)).astype(float) for _ in range(trees))
    made = [grow(b, y, w, depth)[0] for w in draws]
    return lambda new: np.mean([t.value[leaves(t, binned(new, cuts))] for t in made], axis=0)


def fit_boosting(x: np.ndarray, y: np.ndarray, loss: str = "squared_error", trees: int = 80, depth: int = 2, rate: float = 0.03, share: float = 0.9) -> Callable[[np.ndarray], np.ndarray]:
    """Trees on what is left of the target: its difference, the sign of it (``absolute_error``), or the difference up to its ``share`` point (``huber``).

    A leaf adds the mean, the median, or the median with the mean of what is cut
    off around it.
    """
    cuts, ones = edges(x), np.ones(len(y))
    b = binned(x, cuts)
    start = float(y.mean() if loss == "squared_error" else np.median(y))
    now, made = np.full(len(y), start), []
    for _ in range(trees):
        left = y - now
        limit = np.quantile(np.abs(left), share) if loss == "huber" else 0.0
        g = left if loss == "squared_error" else np.sign(left) if loss == "absolute_error" else np.clip(left, -limit, limit)
        tree, node = grow(b, g, ones, depth)
        if loss != "squared_error":
            for n in np.unique(node):
                inside = left[node == n]
                middle = np.median(inside)
                tree.value[n] = middle + (np.clip(inside - middle, -limit, limit).mean() if loss == "huber" else 0.0)
        now = now + rate * tree.value[node]
        made.append(tree)
    return lambda new: start + rate * sum(t.value[leaves(t, binned(new, cuts))] for t in made)
