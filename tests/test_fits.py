"""The small models against their conditions of optimality and against exhaustive search."""

import numpy as np
import pytest

from tideline.functions import fits


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 7))
    y = 0.02 * np.tanh(x[:, 0] - 0.5 * x[:, 1]) + 0.01 * g.normal(size=400)
    return fits.scaled(x, *fits.scaler(x)), y


def test_quasi_newton_finds_the_valley():
    def valley(w):
        a, b = w
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    w, done = fits.quasi_newton(valley, np.array([-1.2, 1.0]), tolerance=1e-8)
    assert done and w == pytest.approx([1, 1], abs=1e-4)
    assert not fits.quasi_newton(valley, np.array([-1.2, 1.0]), iterations=3)[1]


def test_network_gradient_and_convergence(data):
    z, y = data
    w = np.random.default_rng(0).normal(size=7 * 8 + 8 + 8 * 4 + 4 + 4 + 1)
    weights = np.linspace(0.5, 1.5, len(y))
    value, g = fits.network_loss(w, z.T, y, weights)
    for i in range(0, len(w), 7):
        step = np.zeros(len(w))
        step[i] = 1e-6
        assert (fits.network_loss(w + step, z.T, y, weights)[0] - fits.network_loss(w - step, z.T, y, weights)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-5, abs=1e-8)
    fitted, done = fits.fit_network(z, y, 17)
    assert done and np.abs(fits.network_loss(fitted, z.T, y)[1]).max() <= 2 * fits.TOLERANCE
    fitted, _ = fits.fit_network(z, y / y.std(), 17)
    assert fits.network_loss(fitted, z.T, y / y.std())[0] < 0.5 * 0.5  # under half of the variance is left
    assert (fits.fit_network(z, y, 42)[0] == fits.fit_network(z, y, 42)[0]).all()


def test_linear_models_meet_their_conditions(data):
    z, y = data
    s = fits.sums(z, y)
    w, b = fits.fit_ridge(s, 30.0)
    left = z @ w + b - y
    assert np.abs(z.T @ left + 30 * w).max() < 1e-9 and abs(left.sum()) < 1e-9
    w, b = fits.fit_ridge(s, 0.0)
    assert np.abs(z.T @ (z @ w + b - y)).max() < 1e-9
    w, b = fits.fit_elastic(s, 0.004, 0.25)
    pull = z.T @ (y - z @ w - b) / len(y) - 0.004 * 0.75 * w
    on = w != 0
    assert on.any() and not on.all()
    assert np.abs(pull[on] - 0.001 * np.sign(w[on])).max() < 1e-6 and np.abs(pull[~on]).max() <= 0.001 + 1e-6
    up = y > 0
    w = fits.fit_logistic(z, up)
    p = 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))
    assert np.abs(w[:-1] + 0.1 * (z.T @ (p - up))).max() < 1e-6 and abs((p - up).sum()) < 1e-6


def test_splits_equal_an_exhaustive_search():
    g = np.random.default_rng(8)
    for trial in range(20):
        x = g.integers(0, 12, (60, 4)).astype(float)
        y, w = g.normal(size=60), g.integers(0, 3, 60).astype(float)
        best = (0.0, -1, 0.0)
        error = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()
        whole = error(w > 0)
        for f in range(4):
            for v in np.unique(x[:, f])[:-1]:
                left, right = (x[:, f] <= v) & (w > 0), (x[:, f] > v) & (w > 0)
                if w[left].sum() >= 8 and w[right].sum() >= 8 and whole - error(left) - error(right) > best[0] + 1e-12:
                    best = (whole - error(left) - error(right), f, v)
        cuts = fits.edges(x)
        b = fits.binned(x, cuts)
        feature, cut, gain = fits.best_split(b[w > 0], y[w > 0], w[w > 0], int(b.max()) + 1, 8)
        assert gain == pytest.approx(best[0]) and feature == best[1]
        assert ((b[:, feature] <= cut) == (x[:, feature] <= best[2]))[w > 0].all()
    assert fits.best_split(np.zeros((10, 2), int), np.arange(10.0), np.ones(10), 1, 2)[0] == -1


def test_binning_of_many_values_is_even():
    x = np.random.default_rng(1).normal(size=(10_000, 1))
    counts = np.bincount(fits.binned(x, fits.edges(x, 64))[:, 0])
    assert len(counts) == 64 and counts.max() < 1.1 * counts.min()


@pytest.mark.parametrize("loss", ["squared_error", "absolute_error", "huber"])
def test_boosting_and_forest_learn_steps(loss):
    g = np.random.default_rng(5)
    x = g.normal(size=(600, 3))
    y = np.where(x[:, 1] > 0.3, 1.0, -1.0) * np.where(x[:, 2] > 0, 1.0, 0.2) + 0.05 * g.normal(size=600)
    y[:5] += 50  # outliers, which the robust losses ignore
    new = g.normal(size=(500, 3))
    want = np.where(new[:, 1] > 0.3, 1.0, -1.0) * np.where(new[:, 2] > 0, 1.0, 0.2)
    told = fits.fit_boosting(x, y, loss, trees=200, rate=0.1)(new)
    assert np.abs(told - want).mean() < (0.9 if loss == "squared_error" else 0.2)
    assert np.corrcoef(fits.fit_forest(x[5:], y[5:], trees=20)(new), want)[0, 1] > 0.95
    # a tree's leaf is the mean of its rows
    b = fits.binned(x, fits.edges(x))
    tree, node = fits.grow(b, y, np.ones(600), 3)
    assert all(tree.value[n] == pytest.approx(y[node == n].mean()) for n in np.unique(node)) and (fits.leaves(tree, b) == node).all()
    assert min(np.bincount(node)[np.unique(node)]) >= 20
