"""Recursive indicators of one group's bars, for grouped pandas functions.

A smoothing is a recursion over a group's bars, which no window expression gives.
A symbol's daily bars are few thousand rows a decade, so a group is small whatever
the number of trades beneath. All smoothings of a group run in one pass, a column
each. Variants that share a name differ in seeding and stay apart on purpose.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd

PERIOD = 14
SPANS = (12, 20, 26, 50)


def smoothed(x: np.ndarray, weight: float | np.ndarray) -> np.ndarray:
    """Each column's exponential smoothing, which begins with the first value that is known."""
    out, state = np.empty(x.shape), np.full(x.shape[1:], np.nan)
    for i, row in enumerate(x):
        state = np.where(np.isnan(state), row, state + weight * (row - state))
        out[i] = state
    return out


def seeded(x: np.ndarray, n: int) -> np.ndarray:
    """Smoothing by 1 / n of the rows from ``n`` on, begun with the mean of rows 1 to ``n``; unknown before."""
    start = np.full(x.shape, np.nan)
    if len(x) > n:
        start[n:] = x[n:]
        start[n] = x[1 : n + 1].mean(axis=0)
    return smoothed(start, 1 / n)


def strength_index(gain: np.ndarray, loss: np.ndarray, tiny: float, flat: float) -> np.ndarray:
    """100 - 100 / (1 + gain / loss): 100 without losses, ``flat`` without gains too."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(loss > tiny, 100 - 100 / (1 + gain / loss), np.where(gain > tiny, 100.0, flat))
    return np.where(np.isnan(loss), np.nan, out)


def moves(b: pd.DataFrame) -> np.ndarray:
    """Gain, loss, true range and directional movement up and down of every bar; the first bar has a range only."""
    high, low, close = (b[c].to_numpy(float) for c in ("high", "low", "close"))
    out = np.zeros((len(b), 5))
    if not len(b):
        return out
    out[0, :2], out[:, 2] = np.nan, high - low
    change, up, down = np.diff(close), np.diff(high), -np.diff(low)
    out[1:, 0], out[1:, 1] = np.maximum(change, 0), np.maximum(-change, 0)
    out[1:, 2] = np.maximum(out[1:, 2], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    out[1:, 3], out[1:, 4] = np.where((up > down) & (up > 0), up, 0), np.where((down > up) & (down > 0), down, 0)
    return out


def directional_index(plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """100 |plus - minus| / (plus + minus), unknown where there was no movement at all."""
    total = plus + minus
    return np.divide(100 * np.abs(plus - minus), total, out=np.full(len(total), np.nan), where=total > 0)


def rsi_seeded(close: pd.Series, n: int = PERIOD) -> pd.Series:
    """Wilder smoothing begun with the mean of the first n changes; null before. No losses: 100, or 50 without gains too."""
    change = np.diff(close.to_numpy(float), prepend=np.nan)
    parts = seeded(np.column_stack([np.maximum(change, 0), np.maximum(-change, 0)]), n)
    return pd.Series(strength_index(parts[:, 0], parts[:, 1], 1e-12, 50.0), close.index)


def adx_sums(b: pd.DataFrame, n: int = PERIOD) -> float:
    """The plain mean of the last n directional indices of seeded smoothings; null with fewer than 2 n bars after the first."""
    if len(b) < 2 * n + 1:
        return float("nan")
    parts = seeded(moves(b)[:, 3:], n)[n + 1 :]
    return float(np.mean(np.nan_to_num(directional_index(parts[:, 0], parts[:, 1]))[-n:]))


def indicators(b: pd.DataFrame) -> pd.DataFrame:
    """All recursive indicators of a group's bars: means of SPANS, MACD, both strength indices, range and direction."""
    b = b.sort_values("day", ignore_index=True)
    close = b["close"].to_numpy(float)
    spans = np.array([2 / (n + 1) for n in SPANS])
    first = smoothed(np.column_stack([moves(b), *[close] * len(SPANS)]), np.concatenate([np.full(5, 1 / PERIOD), spans]))
    gain, loss, atr, plus, minus = first[:, :5].T
    with np.errstate(divide="ignore", invalid="ignore"):
        plus_di, minus_di = (np.where(atr > 0, 100 * x / atr, np.nan) for x in (plus, minus))
    means = dict(zip(SPANS, first[:, 5:].T, strict=True))
    macd = means[12] - means[26]
    second = smoothed(np.column_stack([macd, directional_index(plus, minus)]), np.array([0.2, 1 / PERIOD]))
    signal, adx = second.T
    rsi = strength_index(gain, loss, 0.0, 100.0)
    rsi[:PERIOD] = np.nan
    columns = {f"ema_{n}": x for n, x in means.items()} | {"macd": macd, "signal": signal, "histogram": macd - signal, "rsi_seeded": rsi_seeded(b["close"]), "rsi_ewm": rsi}
    return b.assign(**columns, atr=atr, plus_di=plus_di, minus_di=minus_di, adx=adx)


COLUMNS = [f"ema_{n}" for n in SPANS] + ["macd", "signal", "histogram", "rsi_seeded", "rsi_ewm", "atr", "plus_di", "minus_di", "adx"]
INDICATORS = ", ".join(f"{c} double" for c in COLUMNS)


def last_report(b: pd.DataFrame, weights: dict[str, float], window: int = 12, least: int = 47) -> dict | None:
    """Intraday momentum at the last of a group's bars (ts, c, v), in units of the session's volatility.

    Null with fewer than ``least`` bars or without volatility. Parts that cannot be
    told leave their weight to the others.
    """
    b = b.sort_values("ts", ignore_index=True)
    if len(b) < least:
        return None
    day = b["ts"].dt.date
    session = b[day == day.iloc[-1]]
    enough = len(session) >= 2 * window
    basis = session if enough else b
    sigma = float(np.diff(np.log(basis["c"])).std(ddof=1)) if len(basis) > 2 else 0.0
    if sigma <= 1e-12:
        return None
    c = b["c"].to_numpy(float)
    n = min(window, len(c) - 1)
    speed = lambda at: float(np.log(c[at] / c[at - n]) / (sigma * np.sqrt(n) + 1e-12))
    velocity, before = speed(-1), speed(-1 - n) if len(c) > 2 * n else 0.0
    means = smoothed(np.column_stack([c, c]), np.array([2 / 13, 2 / 27]))
    macd = means[:, 0] - means[:, 1]
    histogram = macd[-1] - smoothed(macd[:, None], 0.2)[-1, 0]
    parts = {"velocity": velocity, "acceleration": velocity - before, "rsi": (float(rsi_seeded(b["c"]).iloc[-1]) - 50) / 25, "macd": float(histogram / (c[-1] * sigma + 1e-12))}
    if len(basis) > window:
        parts["drift"] = float(np.log(basis["c"].iloc[-1] / basis["c"].iloc[0]) / (sigma * np.sqrt(len(basis) - 1)))
    traded = basis.loc[basis["v"] > 0, "v"].to_numpy(float)
    if len(traded) >= 2 * window:
        ratio = abs(np.log(traded[-window:].mean() / np.sort(traded)[len(traded) // 2]))
        parts["volume"] = float(-ratio if velocity < 0 else ratio)
    w, x = np.array([weights[k] for k in parts]), np.array(list(parts.values()))
    mean = float(w @ x / w.sum())
    spread = float(np.sqrt(w @ (x - mean) ** 2 / w.sum()))
    t = mean / (spread / np.sqrt(len(x)) + 1e-12)
    agreement = abs(mean) / (abs(mean) + spread + 1e-12)
    strength = round(100 * (2 / (1 + np.exp(-np.clip(abs(mean) * (0.5 + agreement), -40, 40))) - 1))
    moved = max(abs(velocity), abs(parts.get("drift", 0.0)))
    gained = abs(velocity) - abs(before)
    lengths = day[day != day.iloc[-1]].value_counts()
    expected = int(lengths.max()) if len(lengths) else len(session)
    left = max(1, expected - len(session))
    return {name: parts.get(name) for name in weights} | {
        "t": t,
        "strength": int(strength),
        "direction": "neutral" if abs(t) < 1 or moved < 1 else "up" if mean > 0 else "down",
        "trend": "stable" if abs(gained) < 1 / np.sqrt(window) else "stronger" if gained > 0 else "weaker",
        "price": float(c[-1]),
        "sigma": sigma,
        "session_bars": len(session),
        "remaining": left,
        "expected_move": float(c[-1] * sigma * np.sqrt(left) * (1 + abs(t) / (1 + abs(t)))),
    }


def order_statistic(scores: np.ndarray, coverage: float) -> float:
    """The score at rank min(n, ceil((n + 1) coverage)); null of none."""
    if not len(scores):
        return float("nan")
    rank = min(len(scores), math.ceil((len(scores) + 1) * coverage)) - 1
    return float(np.partition(scores, rank)[rank])


def adaptive_widths(calibration: np.ndarray, error: np.ndarray, day: np.ndarray, target_day: np.ndarray, coverage: float, last: int = 126, rate: float = 0.01) -> tuple[np.ndarray, np.ndarray, float]:
    """Rolling and adaptive widths of rows in the order of days, and the last level of miscoverage.

    The scores are those of the calibration rows and of all rows whose target has
    matured before the day, the latest ``last``. Each matured row moves the level
    once, by whether it had missed the adaptive width that it was given.
    """
    scores = np.concatenate([calibration, error])
    alpha, done, rolling, adaptive = 1 - coverage, 0, [], []
    for j in range(len(error)):
        while done < j and target_day[done] < day[j]:
            alpha = float(np.clip(alpha + rate * ((1 - coverage) - (error[done] > adaptive[done])), 0.01, 0.99))
            done += 1
        known = scores[max(0, len(calibration) + done - last) : len(calibration) + done]
        rolling.append(order_statistic(known, coverage))
        adaptive.append(order_statistic(known, 1 - alpha))
    return np.array(rolling), np.array(adaptive), alpha


def running_median(x: np.ndarray) -> np.ndarray:
    """The median of the values up to each one: two heaps keep the lower and the upper half."""
    low: list[float] = []
    high: list[float] = []
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        if low and v < -low[0]:
            heapq.heappush(low, -v)
        else:
            heapq.heappush(high, v)
        if len(low) > len(high):
            heapq.heappush(high, -heapq.heappop(low))
        elif len(high) > len(low) + 1:
            heapq.heappush(low, -heapq.heappop(high))
        out[i] = high[0] if len(high) > len(low) else (high[0] - low[0]) / 2
    return out


def matured_so_far(rows: pd.DataFrame, last: int) -> pd.DataFrame:
    """For each day on which targets of a group matured (``at``): their mean, that of the last ones, and the majority's direction with the median size."""
    rows = rows.sort_values(["target_day", "day"], ignore_index=True)
    y = rows["target_return"].to_numpy()
    n, run = np.arange(1, len(y) + 1), np.cumsum(y)
    rolling = (run - np.concatenate((np.zeros(min(last, len(y))), run))[: len(y)]) / np.minimum(n, last)
    sign = np.where(np.cumsum(y > 0) >= 0.5 * n, 1.0, -1.0)
    out = rows.assign(at=rows["target_day"], mean=run / n, rolling=rolling, majority=sign * running_median(np.abs(y)))
    return out.drop_duplicates("at", keep="last")[["symbol", "horizon", "at", "mean", "rolling", "majority"]]


def _digamma(n: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1 on."""
    harmonic = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, max(2, int(n.max()))))))
    return harmonic[n - 1] - 0.5772156649015329


def neighbour_radius(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its k-th neighbour, the larger of both coordinates' differences.

    ``x`` is sorted. Neighbours are sought among those next in it, twice as many
    for the points that may have nearer ones beyond.
    """
    n, width = len(x), min(len(x) - 1, 4 * k)
    out, left = np.empty(n), np.arange(n)
    while len(left):
        at = left[:, None] + np.concatenate((np.arange(-width, 0), np.arange(1, width + 1)))
        inside = (at >= 0) & (at < n)
        near = at.clip(0, n - 1)
        d = np.where(inside, np.maximum(np.abs(x[near] - x[left, None]), np.abs(y[near] - y[left, None])), np.inf)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        before = np.where(left - width - 1 >= 0, x[left] - x[(left - width - 1).clip(0)], np.inf)
        after = np.where(left + width + 1 < n, x[(left + width + 1).clip(max=n - 1)] - x[left], np.inf)
        done = kth <= np.minimum(before, after)
        out[left[done]] = kth[done]
        left, width = left[~done], min(n - 1, 2 * width)
    return out


def _around(values: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many values lie within each one's radius, itself included."""
    ordered = np.sort(values)
    return np.searchsorted(ordered, values + radius, side="right") - np.searchsorted(ordered, values - radius, side="left")


def neighbour_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information of two continuous variables in nats, from the distances to the k-th neighbours (Kraskov and others, 2004); NaN with k rows or fewer, 0 at least.

    Both are divided by their deviations. Neighbours in each alone are those nearer than the k-th in both.
    """
    if len(x) <= k:
        return float("nan")
    x, y = (v / (v.std() or 1.0) for v in (x, y))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    radius = neighbour_radius(x, y, k) * (1 - 1e-9)  # the k-th itself is not nearer
    nx, ny = np.maximum(_around(x, radius), 1), np.maximum(_around(y, radius), 1)
    of = lambda n: float(_digamma(np.array([n]))[0])
    return max(0.0, of(len(x)) + of(k) - float(_digamma(nx).mean() + _digamma(ny).mean()))
