"""Recursive series kernels and the grouped map that runs them.

Each kernel reads float arrays of one security, in date order, gaps as NaN, and returns
arrays of the same length with NaN for "not available". ``per_security`` runs kernels over
Arrow tables; one security's history is what a task holds. Recursions run over lists, as a
number of an array costs several times one of a list.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Series = dict[str, np.ndarray]


def per_security(df: DataFrame, kernel: Callable[[Series], Series], inputs: list[str], outputs: list[str]) -> DataFrame:
    """``df`` with the columns ``outputs`` (doubles, NaN as null) that ``kernel`` computes of each security's sorted series."""
    kept = [c for c in df.columns if c not in outputs]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*kept).dtypes), *(f"`{c}` double" for c in outputs)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        series = {c: table.column(c).to_numpy().astype(np.float64) for c in inputs}
        with np.errstate(all="ignore"):
            found = kernel(series)
        for c in outputs:
            values = np.where(np.isfinite(found[c]), found[c], np.nan)
            table = table.append_column(c, pa.array(values, pa.float64(), from_pandas=True))
        return table

    return df.select(*kept).groupBy("security_id").applyInArrow(run, schema)


def ewm(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean seeded with the first value, shown from the span-th value on; a gap carries the state."""
    a, e, n = 2.0 / (span + 1), math.nan, 0
    b, out = 1 - a, []
    for v in x.tolist():
        if v == v:
            e = a * v + b * e if n else v
            n += 1
            out.append(e if n >= span else math.nan)
        else:
            out.append(math.nan)
    return np.array(out, np.float64)


def ema_seeded(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean seeded with the mean of the first n finite values that follow one another."""
    out = np.full(len(x), np.nan)
    good = np.isfinite(x)
    run = 0
    for i in range(len(x)):
        run = run + 1 if good[i] else 0
        if run == n:
            a, e = 2.0 / (n + 1), float(x[i - n + 1 : i + 1].mean())
            out[i] = e
            for j in range(i + 1, len(x)):
                e = a * x[j] + (1 - a) * e
                out[j] = e
            break
    return out


def wilder(x: np.ndarray, n: int, start: int) -> np.ndarray:
    """Wilder's mean: seeded with the mean of n values from ``start``; a gap in the seed voids the series, a later one only its bar."""
    out = np.full(len(x), np.nan)
    seed = x[start : start + n]
    if len(seed) < n or not np.isfinite(seed).all():
        return out
    a = float(seed.mean())
    found = [a]
    for v in x[start + n :].tolist():
        if v == v:
            a = (a * (n - 1) + v) / n
            found.append(a)
        else:
            found.append(math.nan)
    out[start + n - 1 :] = found
    return out


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    """Wilder's strength index; no move at all gives 50, no loss 100, no gain 0."""
    d = np.r_[np.nan, np.diff(close)]
    up, down = np.where(np.isnan(d), np.nan, np.maximum(d, 0)), np.where(np.isnan(d), np.nan, np.maximum(-d, 0))
    g, l = wilder(up, n, 1), wilder(down, n, 1)
    plain = 100 - 100 / (1 + g / np.where(l == 0, np.nan, l))
    return np.where(np.isnan(g), np.nan, np.where(l == 0, np.where(g == 0, 50.0, 100.0), np.where(g == 0, 0.0, plain)))


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    before = np.r_[np.nan, c[:-1]]
    tr = np.fmax(h - l, np.fmax(np.abs(h - before), np.abs(l - before)))
    return np.where(np.isfinite(h) & np.isfinite(l), tr, np.nan)


def atr(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    return wilder(true_range(h, l, c), n, 0)


def kama(x: np.ndarray, n: int, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Kaufman's adaptive mean: smoothing by the efficiency ratio over n bars."""
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    quick, calm = 2.0 / (fast + 1), 2.0 / (slow + 1)
    path = np.r_[0.0, np.abs(np.diff(x))].cumsum()
    k = x[n]
    out[n] = k
    for i in range(n + 1, len(x)):
        way = path[i] - path[i - n]
        er = abs(x[i] - x[i - n]) / way if way > 0 else 0.0
        k += (er * (quick - calm) + calm) ** 2 * (x[i] - k)
        out[i] = k
    return out


def directional(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(+DI, -DI, DX, ADX) with Wilder sums of directional movement over Wilder's mean true range.

    Without any movement there is no DX, and after a bar without one no ADX.
    """
    size = len(c)
    out = [np.full(size, np.nan) for _ in range(4)]
    if size < n:
        return tuple(out)
    up, down = np.r_[0.0, np.diff(h)], np.r_[0.0, -np.diff(l)]
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = true_range(h, l, c)
    p, m, t = (float(x) for x in (plus[1:n].sum(), minus[1:n].sum(), tr[1:n].mean() if n > 1 else tr[0]))
    rise, fall, run = plus.tolist(), minus.tolist(), tr.tolist()
    ups, downs, spreads = [], [], []
    for i in range(n - 1, size):
        if i >= n:
            p, m, t = p - p / n + rise[i], m - m / n + fall[i], (t * (n - 1) + run[i]) / n
        a = b = d = math.nan
        if t > 0:
            a, b = 100 * p / t, 100 * m / t
            both = a + b
            d = 100 * abs(a - b) / both if both > 0 else math.nan
        ups.append(a)
        downs.append(b)
        spreads.append(d)
    for values, found in zip(out, (ups, downs, spreads)):
        values[n - 1 :] = found
    if size >= 2 * n:
        known = out[2][n - 1 : 2 * n]
        a = float(np.nanmean(known)) if np.isfinite(known).any() else np.nan
        means = [a]
        for x in out[2][2 * n :].tolist():
            a = (a * (n - 1) + x) / n
            means.append(a)
        out[3][2 * n - 1 :] = means
    return tuple(out)


def supertrend(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int, k: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, direction): starts long on the lower band; flips when the close passes the previous basic band."""
    size = len(c)
    line, way = [math.nan] * size, [math.nan] * size
    r = atr(h, l, c, n)
    upper, lower = ((h + l) / 2 + k * r).tolist(), ((h + l) / 2 - k * r).tolist()
    r, c = r.tolist(), c.tolist()
    begun = False
    for i in range(size):
        if r[i] != r[i]:
            continue
        if not begun:
            line[i], way[i], begun, at, d = lower[i], 1.0, True, lower[i], 1.0
            before = i
            continue
        lo, hi = lower[i], upper[i]
        if c[before] >= at:
            lo = max(lo, lower[before])
        if c[before] <= at:
            hi = min(hi, upper[before])
        if d > 0 and c[i] < lower[before]:
            d = -1.0
        elif d < 0 and c[i] > upper[before]:
            d = 1.0
        at = lo if d > 0 else hi
        line[i], way[i], before = at, d, i
    return np.array(line), np.array(way)


def parabolic(h: np.ndarray, l: np.ndarray, step: float = 0.02, top: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Parabolic stop and reverse (stop, direction); starts long at the first low."""
    size = len(h)
    stop, way = np.full(size, np.nan), np.full(size, np.nan)
    if not size:
        return stop, way
    long_, af, far, at = True, step, h[0], l[0]
    stop[0], way[0] = at, 1.0
    for i in range(1, size):
        at = at + af * (far - at)
        if long_:
            at = min(at, l[i - 1], l[i - 2] if i > 1 else l[i - 1])
            if l[i] < at:
                long_, at, far, af = False, far, l[i], step
            elif h[i] > far:
                far, af = h[i], min(top, af + step)
        else:
            at = max(at, h[i - 1], h[i - 2] if i > 1 else h[i - 1])
            if h[i] > at:
                long_, at, far, af = True, far, h[i], step
            elif l[i] < far:
                far, af = l[i], min(top, af + step)
        stop[i], way[i] = at, 1.0 if long_ else -1.0
    return stop, way


def fisher(h: np.ndarray, l: np.ndarray, n: int) -> np.ndarray:
    """Fisher transform of the mid price's place between the last n highs and lows; a flat range holds the state."""
    mid = (h + l) / 2
    out = np.full(len(mid), np.nan)
    v = f = 0.0
    for i in range(n - 1, len(mid)):
        lo, hi = np.fmin.reduce(l[i - n + 1 : i + 1]), np.fmax.reduce(h[i - n + 1 : i + 1])
        if not hi > lo or mid[i] != mid[i]:
            continue
        v = min(0.999, max(-0.999, 0.66 * ((mid[i] - lo) / (hi - lo) - 0.5) + 0.67 * v))
        f = 0.5 * np.log((1 + v) / (1 - v)) + 0.5 * f
        out[i] = f
    return out


def volume_index(c: np.ndarray, v: np.ndarray, rising: bool, start: float = 1000.0) -> np.ndarray:
    """Positive (rising) or negative volume index: compounds returns of bars whose volume rose or fell."""
    out = np.full(len(c), start)
    for i in range(1, len(c)):
        moves = v[i] > v[i - 1] if rising else v[i] < v[i - 1]
        step = c[i] / c[i - 1] if moves and c[i - 1] else 1.0
        out[i] = out[i - 1] * step if step == step else out[i - 1]
    return out


def cooldown(on: np.ndarray, wait: int) -> np.ndarray:
    """Greedy suppression: an event is kept if it comes more than ``wait`` rows after the last kept one."""
    out, last = np.zeros(len(on)), -np.inf
    for i in np.flatnonzero(on > 0):
        if i > last + wait:
            out[i], last = 1.0, i
    return out
