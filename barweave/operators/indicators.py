"""On-demand technical indicators: 64 families in eight categories, over adjusted bars.

A family says what it needs: columns before the folds, recursive folds, and stages of window
expressions, each of which may read the stage before it. ``compute`` merges the needs of the
wanted families, so a plan holds exactly their expressions: one shuffle by security, one
grouped map if any of them recurses, none if all are windows. Values that aren't available
are null (never NaN), so flags made of them are null too. Results are for use in memory:
there is no sink for them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.windows import (
    change, col, crosses_down, crosses_up, div, finite, highest, lag, lead, lowest, mean, median_of, previous, series, std, total,
        trailing,
)
from .features import add_adjusted

O, H, L, C, V = "adjusted_open", "adjusted_high", "adjusted_low", "adjusted_close", "volume"
BASE = ["security_id", "date", O, H, L, C, V]
#: Outputs that one plan holds at most.
PLAN_OUTPUTS = 240
Columns = dict[str, Column]
Fold = Callable[[K.Series], tuple[np.ndarray, ...]]


@dataclass
class Needs:
    """What a family is made of: ``before`` the folds, folds by their outputs, then stages that read what came earlier.

    ``read``: the names that are read at all, where that is known; of a fold's outputs only those go on.
    """

    before: Columns = field(default_factory=dict)
    folds: dict[tuple[str, ...], Fold] = field(default_factory=dict)
    stages: list[Columns] = field(default_factory=list)
    read: set[str] | None = None


@dataclass(frozen=True)
class Indicator:
    id: str
    category: str
    outputs: tuple[str, ...]
    build: Callable[[], Needs]
    causal: bool = True
    note: str = ""


_registry: dict[str, Indicator] = {}


def register(id: str, category: str, outputs: list[str], causal: bool = True, note: str = ""):
    """Register the function below as the family's needs."""

    def add(build: Callable[[], Needs]) -> Callable[[], Needs]:
        _registry[id] = Indicator(id, category, tuple(outputs), build, causal, note)
        return build

    return add


def get(id: str) -> Indicator:
    return _registry[id]


def specs(category: str | None = None, id: str | None = None, mining_only: bool = False) -> list[Indicator]:
    """Registered indicators of a category and id; for mining only those that look back."""
    fits = lambda s: (category is None or s.category == category) and (id is None or s.id == id) and (s.causal
        or not mining_only)
    return [s for s in _registry.values() if fits(s)]


def categories() -> list[str]:
    return list(dict.fromkeys(s.category for s in _registry.values()))


def flag(c: Column) -> Column:
    """A condition that is false where it isn't known."""
    return F.coalesce(c, F.lit(False))


def true_range() -> Column:
    """The largest of the bar's range and its distances from the close before; the first bar has its range."""
    return F.greatest(col(H) - col(L), F.abs(col(H) - lag(C)), F.abs(col(L) - lag(C)))


def typical() -> Column:
    return (col(H) + col(L) + col(C)) / 3


def middle() -> Column:
    return (col(H) + col(L)) / 2


def place() -> Column:
    """A bar's number in its security."""
    return F.row_number().over(series()).cast("double")


def _ema(s: K.Series, n: int) -> np.ndarray:
    """The close's exponential mean, computed once a series."""
    key = f"__ema{n}"
    if key not in s:
        s[key] = K.ewm(s[C], n)
    return s[key]


def _lines(s: K.Series) -> tuple[np.ndarray, np.ndarray]:
    """The difference of the 12 and 26 bar means, and that in hundredths of the slower."""
    line = _ema(s, 12) - _ema(s, 26)
    return line, line / np.where(_ema(s, 26) == 0, np.nan, _ema(s, 26)) * 100


# ---- trend

SMA = (5, 10, 20, 30, 50, 60, 100, 120, 150, 200, 250)
EMA = (5, 10, 12, 20, 26, 50, 60, 100, 120, 200)
_TRENDS = (20, 50, 200)


@register(
    "sma", "trend",
    [*(f"sma_{n}" for n in SMA), *(f"close_to_sma_{n}" for n in SMA),
        *(f"sma_{n}_{x}" for x in ("slope", "direction") for n in _TRENDS),
     *(f"close_above_sma{n}" for n in _TRENDS), "sma20_above_sma50", "sma50_above_sma200", "golden_cross_50_200", "death_cross_50_200"],
)
def _sma() -> Needs:
    first = {f"sma_{n}": mean(C, n) for n in SMA}
    second = {f"close_to_sma_{n}": change(C, f"sma_{n}") for n in SMA}
    second |= {f"sma_{n}_slope": change(f"sma_{n}", lag(f"sma_{n}", 5)) for n in _TRENDS}
    second |= {f"close_above_sma{n}": col(C) > col(f"sma_{n}") for n in _TRENDS}
    second |= {"sma20_above_sma50": col("sma_20") > col("sma_50"), "sma50_above_sma200": col("sma_50") > col("sma_200")}
    second |= {"golden_cross_50_200": crosses_up("sma_50", "sma_200"), "death_cross_50_200": crosses_down("sma_50", "sma_200")}
    sign = lambda c: F.when(c > 0, 1).when(c < 0, -1).otherwise(0)
    third = {f"sma_{n}_direction": sign(col(f"sma_{n}_slope")) for n in _TRENDS}
    return Needs(stages=[first, second, third])


@register("ema", "trend", [*(f"ema_{n}" for n in EMA), "ema12_cross_ema26_up", "ema12_cross_ema26_down"])
def _ema_family() -> Needs:
    folds = {(f"ema_{n}",): lambda s, n=n: (_ema(s, n),) for n in EMA}
    crosses = {"ema12_cross_ema26_up": crosses_up("ema_12", "ema_26"), "ema12_cross_ema26_down": crosses_down("ema_12", "ema_26")}
    return Needs(folds=folds, stages=[crosses])


def weighted(c: str | Column, n: int) -> Column:
    """Mean with weights 1 to n, the latest weighing most, from two sums over the frame; null unless all n are there."""
    return (total(col(c) * col("__i"), n) - (col("__i") - n) * total(c, n)) / (n * (n + 1) / 2)


@register("wma", "trend", [f"wma_{n}" for n in (10, 20, 50, 100)])
def _wma() -> Needs:
    return Needs(stages=[{"__i": place()}, {f"wma_{n}": weighted(C, n) for n in (10, 20, 50, 100)}])


def _nested(s: K.Series, n: int, depth: int) -> list[np.ndarray]:
    """Seeded exponential means of the close, each of the one before."""
    out = [s[C]]
    for _ in range(depth):
        out.append(K.ema_seeded(out[-1], n))
    return out[1:]


@register("dema", "trend", [f"dema_{n}" for n in (10, 20, 50)], note="seeded at the first run of finite values")
def _dema() -> Needs:
    def fold(s: K.Series, n: int) -> tuple[np.ndarray]:
        one, two = _nested(s, n, 2)
        return (2 * one - two,)

    return Needs(folds={(f"dema_{n}",): lambda s, n=n: fold(s, n) for n in (10, 20, 50)})


@register("tema", "trend", [f"tema_{n}" for n in (10, 20, 50)], note="seeded at the first run of finite values")
def _tema() -> Needs:
    def fold(s: K.Series, n: int) -> tuple[np.ndarray]:
        one, two, three = _nested(s, n, 3)
        return (3 * (one - two) + three,)

    return Needs(folds={(f"tema_{n}",): lambda s, n=n: fold(s, n) for n in (10, 20, 50)})


@register("hma", "trend", [f"hma_{n}" for n in (9, 20, 55)])
def _hma() -> Needs:
    raw = {f"__h{n}": 2 * weighted(C, n // 2) - weighted(C, n) for n in (9, 20, 55)}
    return Needs(stages=[{"__i": place()}, raw, {f"hma_{n}": weighted(f"__h{n}", round(math.sqrt(n))) for n in (9, 20, 55)}])


@register("kama", "trend", ["kama_10", "kama_20"])
def _kama() -> Needs:
    return Needs(folds={(f"kama_{n}",): lambda s, n=n: (K.kama(s[C], n),) for n in (10, 20)})


@register("vwma", "trend", [f"vwma_{n}" for n in (10, 20, 50)])
def _vwma() -> Needs:
    return Needs(stages=[{f"vwma_{n}": div(total(col(C) * col(V), n), total(V, n)) for n in (10, 20, 50)}])


@register(
    "macd", "trend",
    ["macd", "macd_signal", "macd_histogram", "macd_cross_signal_up", "macd_cross_signal_down", "macd_cross_zero_up",
        "macd_cross_zero_down"],
)
def _macd() -> Needs:
    folds = {("macd", "macd_signal"): lambda s: (_lines(s)[0], K.ewm(_lines(s)[0], 9))}
    made = {"macd_histogram": col("macd") - col("macd_signal")}
    made |= {"macd_cross_signal_up": crosses_up("macd", "macd_signal"), "macd_cross_signal_down": crosses_down("macd", "macd_signal")}
    made |= {"macd_cross_zero_up": (col("macd") > 0) & (lag("macd") <= 0),
        "macd_cross_zero_down": (col("macd") < 0) & (lag("macd") >= 0)}
    return Needs(folds=folds, stages=[made])


@register("ppo", "trend", ["ppo", "ppo_signal", "ppo_histogram"])
def _ppo() -> Needs:
    return Needs(folds={("ppo", "ppo_signal"): lambda s: (_lines(s)[1], K.ewm(_lines(s)[1], 9))},
        stages=[{"ppo_histogram": col("ppo") - col("ppo_signal")}])


@register("apo", "trend", ["apo"])
def _apo() -> Needs:
    return Needs(folds={("apo",): lambda s: (_lines(s)[0],)})


@register(
    "adx", "trend",
    [*(f"{x}_{n}" for n in (14, 20) for x in ("plus_di", "minus_di", "dx", "adx")), *(f"adx14_gt_{n}" for n in (20, 25, 40)),
     "plus_di_cross_minus_di_up", "plus_di_cross_minus_di_down"],
    note="DI is a sum over a mean, so about the period times the usual scale; ADX stays null after a bar without DX",
)
def _adx() -> Needs:
    names = lambda n: tuple(f"{x}_{n}" for x in ("plus_di", "minus_di", "dx", "adx"))
    folds = {names(n): lambda s, n=n: K.directional(s[H], s[L], s[C], n) for n in (14, 20)}
    made = {f"adx14_gt_{n}": col("adx_14") > n for n in (20, 25, 40)}
    made |= {"plus_di_cross_minus_di_up": crosses_up("plus_di_14", "minus_di_14"),
        "plus_di_cross_minus_di_down": crosses_down("plus_di_14", "minus_di_14")}
    return Needs(folds=folds, stages=[made])


@register("aroon", "trend", [f"aroon_{x}_{n}" for n in (14, 25) for x in ("up", "down", "osc")])
def _aroon() -> Needs:
    made: Columns = {}
    for n in (14, 25):
        frame = trailing(n)
        full = (F.count(H).over(frame) == n) & (F.count(L).over(frame) == n)
        # The first of equal extremes counts: arrays are searched from the oldest bar on.
        highs, lows = F.collect_list(F.col(H)).over(frame), F.collect_list(F.col(L)).over(frame)
        made[f"aroon_up_{n}"] = F.when(full, 100.0 * F.array_position(highs, F.max(H).over(frame)) / n)
        made[f"aroon_down_{n}"] = F.when(full, 100.0 * F.array_position(lows, F.min(L).over(frame)) / n)
    return Needs(stages=[made, {f"aroon_osc_{n}": col(f"aroon_up_{n}") - col(f"aroon_down_{n}") for n in (14, 25)}])


@register("vortex", "trend", ["vortex_pos_14", "vortex_neg_14"], note="bars without a value before them count as 0 in the sums")
def _vortex() -> Needs:
    one = {"__tr": true_range(), "__i": place(), "__vp": F.abs(col(H) - lag(L)), "__vm": F.abs(col(L) - lag(H))}
    frame = trailing(14)
    moved = F.sum("__tr").over(frame)
    share = lambda c: F.when((col("__i") > 14) & (moved > 0), div(F.coalesce(F.sum(c).over(frame), F.lit(0.0)), moved))
    return Needs(stages=[one, {"vortex_pos_14": share("__vp"), "vortex_neg_14": share("__vm")}])


@register("mass_index", "trend", ["mass_index"])
def _mass_index() -> Needs:
    def fold(s: K.Series) -> tuple[np.ndarray]:
        inner = K.ewm(s[H] - s[L], 9)
        outer = K.ewm(inner, 9)
        return (inner / np.where(outer == 0, np.nan, outer),)

    return Needs(folds={("__mass",): fold}, stages=[{"mass_index": total("__mass", 25)}])


@register("choppiness", "trend", ["choppiness_14"])
def _choppiness() -> Needs:
    wide = highest(H, 14) - lowest(L, 14)
    return Needs(stages=[{"__tr": true_range()}, {"choppiness_14": 100.0 * F.ln(div(total("__tr", 14), wide)) / math.log(14)}])


def _flips(name: str, way: str) -> Columns:
    return {f"{name}_flip_up": (col(way) == 1) & (lag(way) == -1), f"{name}_flip_down": (col(way) == -1) & (lag(way) == 1)}


@register("supertrend", "trend",
    [*(f"supertrend_10_{k}{s}" for k in (2, 3, 4) for s in ("", "_dir")), "supertrend_flip_up", "supertrend_flip_down"])
def _supertrend() -> Needs:
    folds = {(f"supertrend_10_{k}", f"supertrend_10_{k}_dir"): lambda s, k=k: K.supertrend(s[H], s[L], s[C], 10, k) for k in (2, 3, 4)}
    return Needs(folds=folds, stages=[_flips("supertrend", "supertrend_10_3_dir")])


@register("psar", "trend", ["psar", "psar_direction", "psar_flip_up", "psar_flip_down"])
def _psar() -> Needs:
    return Needs(folds={("psar", "psar_direction"): lambda s: K.parabolic(s[H], s[L])}, stages=[_flips("psar", "psar_direction")])


_LINES = (20, 60, 120)


def _joined(n: int, parts: int) -> Columns:
    """Mean, spread and co-variation with time of n * parts closes from those of n closes, at lags of n.

    Neighbouring runs are put together as such (no difference of running sums), so a level doesn't blur the spread. A close
    that isn't there leaves no mean of its runs.
    """
    at = lambda c: [col(f"__{c}_line{n}") if i == 0 else lag(f"__{c}_line{n}", n * i) for i in range(parts)]
    means, spreads, slopes = at("m"), at("q"), at("s")
    mean = reduce(add, means) / parts
    # Runs in time order have centres that lie as far from the middle on either side.
    pulls = [(means[i] - means[-1 - i]) * (n * n * (parts - 1 - 2 * i) / 2.0) for i in range(parts // 2)]
    size = n * parts
    return {f"__m_line{size}": mean, f"__q_line{size}": reduce(add, [*spreads, *((m - mean) * (m - mean) * n for m in means)]),
        f"__s_line{size}": reduce(add, [*slopes, *pulls])}


@register(
    "linreg", "trend",
    [f"{x}_{n}" for n in _LINES
        for x in ("linreg_slope", "linreg_slope_norm", "linreg_r2", "linreg_zscore", "dist_from_linreg", "corr_time")],
)
def _linreg() -> Needs:
    """The line through the last n closes, put together of runs of 5, 20 and 60 closes by lags: a bar costs the same for any n."""
    closes = [col(C) if i == 0 else lag(C, i) for i in range(5)]
    level = reduce(add, closes) / 5
    five = {"__m_line5": level, "__q_line5": reduce(add, [(c - level) * (c - level) for c in closes]),
        "__s_line5": (closes[0] - closes[4]) * 2.0 + (closes[1] - closes[3])}
    made: Columns = {}
    for n in _LINES:
        sxx = n * (n * n - 1) / 12.0
        spread, sxy = col(f"__q_line{n}"), col(f"__s_line{n}")
        slope = sxy / sxx
        off = col(C) - (col(f"__m_line{n}") + slope * (n - 1) / 2.0)
        left = F.greatest(spread - slope * sxy, F.lit(0.0))
        full = col(f"__m_line{n}").isNotNull()
        varied = full & (spread > 1e-12)
        made |= {f"linreg_slope_{n}": F.when(full, slope), f"linreg_slope_norm_{n}": F.when(full, div(slope, C))}
        made |= {f"linreg_r2_{n}": F.when(varied, div(slope * sxy, spread)),
            f"corr_time_{n}": F.when(varied, div(sxy, F.sqrt(spread * sxx)))}
        made |= {f"linreg_zscore_{n}": F.when(full & (left > 1e-12), div(off, F.sqrt(left / (n - 1)))),
            f"dist_from_linreg_{n}": F.when(full, div(off, C))}
    return Needs(stages=[five, _joined(5, 4), _joined(20, 3), _joined(60, 2), made])


# ---- momentum

RSI = (2, 6, 9, 14, 21)


def _rsi_fold(n: int) -> dict[tuple[str, ...], Fold]:
    return {(f"rsi_{n}",): lambda s: (K.rsi(s[C], n),)}


@register("rsi", "momentum", [*(f"rsi_{n}" for n in RSI), "rsi14_le_30", "rsi14_ge_70"])
def _rsi() -> Needs:
    folds: dict[tuple[str, ...], Fold] = {}
    for n in RSI:
        folds |= _rsi_fold(n)
    return Needs(folds=folds, stages=[{"rsi14_le_30": col("rsi_14") <= 30, "rsi14_ge_70": col("rsi_14") >= 70}])


def within(c: str, low: str, high: str, n: int) -> Column:
    """Where a value lies in the range of the last n bars, from 0 to 1."""
    return div(col(c) - lowest(low, n), highest(high, n) - lowest(low, n))


@register("stochastic", "momentum", ["stoch_k_14", "stoch_d_14", "stoch_slow_d_14", "stoch_oversold", "stoch_overbought"])
def _stochastic() -> Needs:
    second = {"stoch_d_14": mean("stoch_k_14", 3), "stoch_oversold": col("stoch_k_14") <= 20,
        "stoch_overbought": col("stoch_k_14") >= 80}
    return Needs(stages=[{"stoch_k_14": 100.0 * within(C, L, H, 14)}, second, {"stoch_slow_d_14": mean("stoch_d_14", 3)}])


@register("stoch_rsi", "momentum", ["stoch_rsi_raw", "stoch_rsi_k", "stoch_rsi_d"])
def _stoch_rsi() -> Needs:
    raw = {"stoch_rsi_raw": 100.0 * within("rsi_14", "rsi_14", "rsi_14", 14)}
    return Needs(folds=_rsi_fold(14), stages=[raw, {"stoch_rsi_k": mean("stoch_rsi_raw", 3)}, {"stoch_rsi_d": mean("stoch_rsi_k", 3)}])


@register("cci", "momentum", ["cci_14", "cci_20"], note="deviations from each bar's own mean")
def _cci() -> Needs:
    gaps = {f"__gap{n}": col("__tp") - mean("__tp", n) for n in (14, 20)}
    made = {f"cci_{n}": div(f"__gap{n}", 0.015 * mean(F.abs(col(f"__gap{n}")), n)) for n in (14, 20)}
    return Needs(stages=[{"__tp": typical()}, gaps, made])


@register("williams_r", "momentum", ["williams_r_14", "williams_r_28"])
def _williams() -> Needs:
    return Needs(stages=[{f"williams_r_{n}": -100.0 * div(highest(H, n) - col(C), highest(H, n) - lowest(L, n)) for n in (14, 28)}])


@register("roc", "momentum", [f"roc_{n}" for n in (5, 10, 20, 60, 120)])
def _roc() -> Needs:
    return Needs(stages=[{f"roc_{n}": change(C, lag(C, n)) for n in (5, 10, 20, 60, 120)}])


@register("momentum", "momentum", [f"mom_{n}" for n in (5, 10, 20)])
def _momentum() -> Needs:
    return Needs(stages=[{f"mom_{n}": col(C) - lag(C, n) for n in (5, 10, 20)}])


@register("cmo", "momentum", ["cmo_14", "cmo_20"])
def _cmo() -> Needs:
    made = {}
    for n in (14, 20):
        up, down = total(F.greatest(col("__d"), col("__d") * 0), n), total(F.greatest(-col("__d"), col("__d") * 0), n)
        made[f"cmo_{n}"] = F.when(up + down == 0, 0.0).otherwise(100.0 * div(up - down, up + down))
    return Needs(stages=[{"__d": col(C) - lag(C)}, made])


def _moves(s: K.Series) -> np.ndarray:
    return np.r_[np.nan, np.diff(s[C])]


@register("tsi", "momentum", ["tsi"], note="seeded at the first run of finite values")
def _tsi() -> Needs:
    def fold(s: K.Series) -> tuple[np.ndarray]:
        smooth = lambda x: K.ema_seeded(K.ema_seeded(x, 25), 13)
        size = smooth(np.abs(_moves(s)))
        return (100.0 * smooth(_moves(s)) / np.where(size == 0, np.nan, size),)

    return Needs(folds={("tsi",): fold})


@register("ultimate_oscillator", "momentum", ["ultimate_oscillator"])
def _ultimate() -> Needs:
    floor = F.least(col(L), lag(C))
    part = lambda n: div(total("__bp", n), total("__span", n))
    made = {"ultimate_oscillator": 100.0 * (4 * part(7) + 2 * part(14) + part(28)) / 7}
    return Needs(stages=[{"__bp": col(C) - floor, "__span": F.greatest(col(H), lag(C)) - floor}, made])


@register("awesome_oscillator", "momentum", ["awesome_oscillator"])
def _awesome() -> Needs:
    return Needs(stages=[{"__mid": middle()}, {"awesome_oscillator": mean("__mid", 5) - mean("__mid", 34)}])


@register("dpo", "momentum", ["dpo_20"])
def _dpo() -> Needs:
    return Needs(stages=[{"dpo_20": lag(C, 11) - mean(C, 20)}])


@register("trix", "momentum", ["trix_15"], note="seeded at the first run of finite values")
def _trix() -> Needs:
    return Needs(folds={("__e3",): lambda s: (_nested(s, 15, 3)[-1],)}, stages=[{"trix_15": change("__e3", lag("__e3"))}])


@register("fisher", "momentum", ["fisher_10", "fisher_10_signal"])
def _fisher() -> Needs:
    return Needs(folds={("fisher_10",): lambda s: (K.fisher(s[H], s[L], 10),)}, stages=[{"fisher_10_signal": lag("fisher_10")}])


@register("rvi", "momentum", ["rvi_10", "rvi_signal_10"])
def _rvi() -> Needs:
    return Needs(stages=[{"rvi_10": div(mean(col(C) - col(O), 10), mean(col(H) - col(L), 10))}, {"rvi_signal_10": mean("rvi_10", 4)}])


@register("close_vs_close_26", "momentum", ["close_vs_close_26"])
def _close_vs_close() -> Needs:
    return Needs(stages=[{"close_vs_close_26": change(C, lag(C, 26))}])


def percentile(c: str, n: int) -> Column:
    """The share of the known values of the last n bars that are at most this one; the frame must have n bars, not n values."""
    known = F.collect_list(c).over(trailing(n))  # leaves nulls out
    full = F.count(F.lit(1)).over(trailing(n)) == n
    return F.when(full & col(c).isNotNull(), F.size(F.filter(known, lambda x: x <= col(c))) / F.size(known))


@register(
    "zscore_percentile", "momentum",
    [*(f"{x}_zscore_{n}" for x in ("close", "return", "volume") for n in _LINES), "price_position_252", "volume_percentile_60",
        "volatility_percentile_60"],
)
def _zscore() -> Needs:
    score = lambda c, n: div(col(c) - mean(c, n), std(c, n))
    second = {f"{x}_zscore_{n}": score(c, n) for x, c in (("close", C), ("return", "__r"), ("volume", V)) for n in _LINES}
    second |= {"price_position_252": percentile(C, 252), "volume_percentile_60": percentile(V, 60), "__vol": std("__r", 20)}
    return Needs(stages=[{"__r": change(C, lag(C))}, second, {"volatility_percentile_60": percentile("__vol", 60)}])


# ---- volatility


def _atr_fold(n: int) -> dict[tuple[str, ...], Fold]:
    return {(f"atr_{n}",): lambda s: (K.atr(s[H], s[L], s[C], n),)}


@register("atr", "volatility", ["true_range", "atr_5", "atr_14", "atr_20", "natr_14", "natr_20"])
def _atr() -> Needs:
    made = {"true_range": true_range()} | {f"natr_{n}": 100.0 * div(f"atr_{n}", C) for n in (14, 20)}
    return Needs(folds=_atr_fold(5) | _atr_fold(14) | _atr_fold(20), stages=[made])


@register("hist_vol", "volatility", [f"{x}_{n}" for n in (10, 20, 60) for x in ("stdev_ret", "hist_vol")])
def _hist_vol() -> Needs:
    second = {f"stdev_ret_{n}": std("__r", n) for n in (10, 20, 60)} | {f"hist_vol_{n}": std("__r", n) * math.sqrt(252)
        for n in (10, 20, 60)}
    return Needs(stages=[{"__r": change(C, lag(C))}, second])


@register("ohlc_vol", "volatility",
    [f"{x}_{n}" for x in ("parkinson", "garman_klass", "rogers_satchell", "yang_zhang") for n in (20, 60)])
def _ohlc_vol() -> Needs:
    ln = lambda a, b: F.ln(div(a, b))
    wide, body = ln(H, L), ln(C, O)
    one = {"__pk": wide * wide / (4 * math.log(2)), "__gk": 0.5 * wide * wide - (2 * math.log(2) - 1) * body * body}
    one |= {"__rs": ln(H, C) * ln(H, O) + ln(L, C) * ln(L, O), "__oc": ln(O, lag(C)), "__cc": ln(C, lag(C))}
    yearly = lambda x: F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0)) * 252))
    two: Columns = {}
    for n in (20, 60):
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        two |= {f"parkinson_{n}": yearly(mean("__pk", n)), f"garman_klass_{n}": yearly(mean("__gk", n)),
            f"rogers_satchell_{n}": yearly(mean("__rs", n))}
        square = lambda c: mean(col(c) * col(c), n)  # noqa: B023, E731
        two[f"yang_zhang_{n}"] = yearly(square("__oc") + k * square("__cc") + (1 - k) * mean("__rs", n))
    return Needs(stages=[one, two])


@register("ulcer", "volatility", ["ulcer_14", "ulcer_20"])
def _ulcer() -> Needs:
    fall = {f"__dd{n}": 100.0 * div(col(C) - highest(C, n), highest(C, n)) for n in (14, 20)}
    return Needs(stages=[fall, {f"ulcer_{n}": F.sqrt(mean(col(f"__dd{n}") * col(f"__dd{n}"), n)) for n in (14, 20)}])


@register("chaikin_vol", "volatility", ["chaikin_volatility_10"])
def _chaikin_vol() -> Needs:
    return Needs(folds={("__ema_hl",): lambda s: (K.ewm(s[H] - s[L], 10),)},
        stages=[{"chaikin_volatility_10": change("__ema_hl", lag("__ema_hl", 10))}])


def _band(n: int, k: int) -> Columns:
    return {f"bb_{n}_{k}_mid": mean(C, n), f"bb_{n}_{k}_upper": mean(C, n) + k * std(C, n),
        f"bb_{n}_{k}_lower": mean(C, n) - k * std(C, n)}


@register(
    "bollinger", "volatility",
    [*(f"bb_{n}_2_{x}" for n in (20, 10, 50) for x in ("mid", "upper", "lower")),
        *(f"bb_20_{k}_{x}" for k in (1, 3) for x in ("mid", "upper", "lower")),
     "bb_20_2_width", "bb_20_2_pctb", "close_above_bb_upper", "close_below_bb_lower", "cross_above_bb_upper", "cross_below_bb_lower",
     "reentry_from_upper", "reentry_from_lower"],
)
def _bollinger() -> Needs:
    one: Columns = {}
    for n, k in ((20, 1), (20, 2), (20, 3), (10, 2), (50, 2)):
        one |= _band(n, k)
    up, low, mid = col("bb_20_2_upper"), col("bb_20_2_lower"), col("bb_20_2_mid")
    two = {"bb_20_2_width": div(up - low, mid), "bb_20_2_pctb": div(col(C) - low, up - low)}
    two |= {"close_above_bb_upper": col(C) > up, "close_below_bb_lower": col(C) < low}
    above, below = col("close_above_bb_upper"), col("close_below_bb_lower")
    was_above, was_below = flag(lag("close_above_bb_upper")), flag(lag("close_below_bb_lower"))
    three = {"cross_above_bb_upper": above & ~was_above, "cross_below_bb_lower": below & ~was_below}
    three |= {"reentry_from_upper": ~above & was_above, "reentry_from_lower": ~below & was_below}
    return Needs(stages=[one, two, three])


def _keltner_lines() -> tuple[dict[tuple[str, ...], Fold], Columns]:
    lines = {"kc_upper": col("kc_mid") + 2 * col("atr_10"), "kc_lower": col("kc_mid") - 2 * col("atr_10")}
    return {("kc_mid",): lambda s: (_ema(s, 20),)} | _atr_fold(10), lines


@register("keltner", "volatility", ["kc_mid", "kc_upper", "kc_lower", "kc_width", "kc_position", "kc_breakout_up", "kc_breakout_down"])
def _keltner() -> Needs:
    folds, lines = _keltner_lines()
    up, low = col("kc_upper"), col("kc_lower")
    made = {"kc_width": div(up - low, "kc_mid"), "kc_position": div(col(C) - low, up - low), "kc_breakout_up": col(C) > up,
        "kc_breakout_down": col(C) < low}
    return Needs(folds=folds, stages=[lines, made])


@register("squeeze", "volatility", ["squeeze_on", "squeeze_off", "squeeze_release"])
def _squeeze() -> Needs:
    folds, lines = _keltner_lines()
    on = (col("bb_20_2_upper") < col("kc_upper")) & (col("bb_20_2_lower") > col("kc_lower"))
    release = col("squeeze_off") & flag(lag("squeeze_on"))
    return Needs(folds=folds, stages=[lines | _band(20, 2), {"squeeze_on": on, "squeeze_off": ~on}, {"squeeze_release": release}])


@register("donchian", "volatility",
    [f"donchian_{n}_{x}" for n in (20, 55) for x in ("upper", "lower", "mid", "pos", "breakout_up", "breakout_down")])
def _donchian() -> Needs:
    made: Columns = {}
    for n in (20, 55):
        up, low = highest(H, n), lowest(L, n)
        made |= {f"donchian_{n}_upper": up, f"donchian_{n}_lower": low, f"donchian_{n}_mid": (up + low) / 2,
            f"donchian_{n}_pos": within(C, L, H, n)}
        made |= {f"donchian_{n}_breakout_up": col(C) > previous(F.max, H, n),
            f"donchian_{n}_breakout_down": col(C) < previous(F.min, L, n)}
    return Needs(stages=[made])


# ---- volume


def _so_far():
    """All bars of the security up to this one."""
    return series().rowsBetween(Window.unboundedPreceding, 0)


def _flow() -> Column:
    """Volume by where the close lies in the bar's range, from -1 to 1; null on a flat bar."""
    return div((col(C) - col(L)) - (col(H) - col(C)), col(H) - col(L)) * col(V)


def _ad_line() -> Column:
    return F.sum(F.coalesce(_flow(), F.lit(0.0))).over(_so_far())


@register("volume_sma", "volume", [*(f"volume_sma_{n}" for n in (5, 10, 20, 60)), *(f"volume_ratio_{n}" for n in (5, 20, 60))])
def _volume_sma() -> Needs:
    made = {f"volume_sma_{n}": mean(V, n) for n in (5, 10, 20, 60)}
    return Needs(stages=[made | {f"volume_ratio_{n}": div(V, previous(F.avg, V, n)) for n in (5, 20, 60)}])


@register("obv", "volume", ["obv"])
def _obv() -> Needs:
    return Needs(stages=[{"__signed": F.coalesce(F.signum(col(C) - lag(C)) * col(V), F.lit(0.0))},
        {"obv": F.sum("__signed").over(_so_far())}])


@register("ad_line", "volume", ["ad_line"])
def _ad() -> Needs:
    return Needs(stages=[{"ad_line": _ad_line()}])


@register("cmf", "volume", ["cmf_20"])
def _cmf() -> Needs:
    return Needs(stages=[{"cmf_20": div(total(_flow(), 20), total(V, 20))}])


@register("chaikin_osc", "volume", ["chaikin_oscillator"])
def _chaikin_osc() -> Needs:
    fold = {("chaikin_oscillator",): lambda s: (K.ewm(s["__ad"], 3) - K.ewm(s["__ad"], 10),)}
    return Needs(before={"__ad": _ad_line()}, folds=fold)


@register("mfi", "volume", ["mfi_14"])
def _mfi() -> Needs:
    step, flow = col("__tp") - lag("__tp"), col("__tp") * col(V)
    two = {"__gain": F.when(step > 0, flow).when(step <= 0, flow * 0), "__loss": F.when(step < 0, flow).when(step >= 0, flow * 0)}
    up, down = total("__gain", 14), total("__loss", 14)
    index = F.when(down == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1 + div(up, down)))
    return Needs(stages=[{"__tp": typical()}, two, {"mfi_14": F.when(up + down != 0, index)}])


@register("force_index", "volume", ["force_index_13"])
def _force() -> Needs:
    return Needs(folds={("force_index_13",): lambda s: (K.ewm(_moves(s) * s[V], 13),)})


@register("eom", "volume", ["eom_14"])
def _eom() -> Needs:
    moved = {"__eom": div(col("__mid") - lag("__mid"), div(V, col(H) - col(L)))}
    return Needs(stages=[{"__mid": middle()}, moved, {"eom_14": mean("__eom", 14)}])


@register("pvt", "volume", ["pvt"])
def _pvt() -> Needs:
    return Needs(stages=[{"__pvt": F.coalesce(change(C, lag(C)) * col(V), F.lit(0.0))}, {"pvt": F.sum("__pvt").over(_so_far())}])


@register("nvi_pvi", "volume", ["nvi", "pvi"])
def _nvi_pvi() -> Needs:
    return Needs(folds={("nvi",): lambda s: (K.volume_index(s[C], s[V], False),),
        ("pvi",): lambda s: (K.volume_index(s[C], s[V], True),)})


@register("volume_roc", "volume", ["volume_roc_10", "volume_roc_20"])
def _volume_roc() -> Needs:
    return Needs(stages=[{f"volume_roc_{n}": change(V, lag(V, n)) for n in (10, 20)}])


@register("rolling_vwap", "volume", ["rolling_vwap_20", "rolling_vwap_60"])
def _rolling_vwap() -> Needs:
    return Needs(stages=[{f"rolling_vwap_{n}": div(total(typical() * col(V), n), total(V, n)) for n in (20, 60)}])


# ---- ichimoku, support and resistance, candles


@register(
    "ichimoku", "ichimoku",
    ["tenkan", "kijun", "senkou_a_raw", "senkou_b_raw", "cloud_a_at_t", "cloud_b_at_t", "cloud_top", "cloud_bottom", "cloud_thickness",
     "price_above_cloud", "price_inside_cloud", "price_below_cloud", "tenkan_above_kijun", "tenkan_cross_kijun_up",
     "tenkan_cross_kijun_down",
     "cloud_bullish", "cloud_bearish", "cloud_breakout_up", "cloud_breakout_down"],
)
def _ichimoku() -> Needs:
    half = lambda n: (highest(H, n) + lowest(L, n)) / 2
    one = {"tenkan": half(9), "kijun": half(26), "senkou_b_raw": half(52), "senkou_a_raw": (half(9) + half(26)) / 2}
    two = {"cloud_a_at_t": lag("senkou_a_raw", 26), "cloud_b_at_t": lag("senkou_b_raw", 26),
        "tenkan_above_kijun": col("tenkan") > col("kijun")}
    two |= {"tenkan_cross_kijun_up": crosses_up("tenkan", "kijun"), "tenkan_cross_kijun_down": crosses_down("tenkan", "kijun")}
    a, b = col("cloud_a_at_t"), col("cloud_b_at_t")
    # Where only one line is known it is the cloud's top and bottom.
    three = {"cloud_top": F.greatest(a, b), "cloud_bottom": F.least(a, b), "cloud_bullish": a > b, "cloud_bearish": a < b}
    top, bottom = col("cloud_top"), col("cloud_bottom")
    four = {"cloud_thickness": top - bottom, "price_above_cloud": col(C) > top, "price_below_cloud": col(C) < bottom}
    four |= {"price_inside_cloud": (col(C) <= top) & (col(C) >= bottom)}
    four |= {"cloud_breakout_up": crosses_up(C, "cloud_top"), "cloud_breakout_down": crosses_down(C, "cloud_bottom")}
    return Needs(stages=[one, two, three, four])


@register("visual_chikou_shifted", "ichimoku", ["visual_chikou_shifted"], causal=False, note="looks 26 bars ahead; for charts only")
def _chikou() -> Needs:
    return Needs(stages=[{"visual_chikou_shifted": lead(C, 26)}])


@register(
    "support_resistance", "breakout",
    [*(f"{x}_{n}" for n in (20, 55, 60, 120, 252) for x in ("roll_high", "roll_low", "dist_high", "dist_low", "channel_pos")),
     *(f"{x}_{n}" for n in (20, 55, 252) for x in ("prior_high_breakout", "prior_low_breakdown", "new_high", "new_low"))],
)
def _support_resistance() -> Needs:
    made: Columns = {}
    for n in (20, 55, 60, 120, 252):
        up, low = highest(H, n), lowest(L, n)
        made |= {f"roll_high_{n}": up, f"roll_low_{n}": low, f"dist_high_{n}": change(C, up), f"dist_low_{n}": change(C, low)}
        made |= {f"channel_pos_{n}": within(C, L, H, n)}
    for n in (20, 55, 252):
        up, low = previous(F.max, H, n), previous(F.min, L, n)
        made |= {f"prior_high_breakout_{n}": col(C) > up, f"prior_low_breakdown_{n}": col(C) < low}
        made |= {f"new_high_{n}": col(H) >= up, f"new_low_{n}": col(L) <= low}  # a tie counts as new
    return Needs(stages=[made])


FIBONACCI = (236, 382, 500, 618, 786)


@register("rolling_fib_60", "breakout", [f"{x}rolling_fib_60_{k}" for x in ("", "dist_") for k in FIBONACCI])
def _rolling_fib() -> Needs:
    up, low = highest(H, 60), lowest(L, 60)
    levels = {f"rolling_fib_60_{k}": up - (up - low) * (k / 1000) for k in FIBONACCI}
    return Needs(stages=[levels, {f"dist_{x}": div(col(C) - col(x), C) for x in levels}])


@register(
    "pivots", "breakout",
    ["pivot_p", *(f"pivot_{x}{i}" for x in "rs" for i in (1, 2, 3)), "fib_pivot_p",
        *(f"fib_pivot_{x}{i}" for x in "rs" for i in (1, 2)),
     "cam_r1", "cam_s1", "woodie_p", "woodie_r1", "woodie_s1"],
)
def _pivots() -> Needs:
    """Levels of the bar before."""
    high, low, close, start = (lag(x) for x in (H, L, C, O))
    mid, span, woodie = (high + low + close) / 3, high - low, (high + low + 2 * start) / 4
    made = {"pivot_p": mid, "pivot_r1": 2 * mid - low, "pivot_s1": 2 * mid - high, "pivot_r2": mid + span, "pivot_s2": mid - span}
    made |= {"pivot_r3": high + 2 * (mid - low), "pivot_s3": low - 2 * (high - mid), "fib_pivot_p": mid}
    for i, k in ((1, 0.382), (2, 0.618)):
        made |= {f"fib_pivot_r{i}": mid + span * k, f"fib_pivot_s{i}": mid - span * k}
    made |= {"cam_r1": close + span * 1.1 / 12, "cam_s1": close - span * 1.1 / 12}
    return Needs(stages=[made | {"woodie_p": woodie, "woodie_r1": 2 * woodie - low, "woodie_s1": 2 * woodie - high}])


def _candle_parts() -> Columns:
    """Body, range and shadows of a bar."""
    o, h, l, c = (col(x) for x in (O, H, L, C))
    return {"__body": c - o, "__range": h - l, "__up": h - F.greatest(o, c), "__low": F.least(o, c) - l}


@register(
    "candle_anatomy", "candles",
    ["body_pct", "body_abs_pct", "upper_shadow_pct", "lower_shadow_pct", "range_pct", "bullish_bar", "bearish_bar", "gap_up",
        "gap_down",
     "inside_bar", "outside_bar", "nr4", "nr7", "wide_range_bar", "consecutive_up_days", "consecutive_down_days",
     "higher_high", "higher_low", "lower_high", "lower_low", "hh_hl_state", "lh_ll_state"],
)
def _candle_anatomy() -> Needs:
    o, h, l, c = (col(x) for x in (O, H, L, C))
    ph, pl, pc = lag(H), lag(L), lag(C)
    two = {"body_pct": div("__body", c), "body_abs_pct": div(F.abs(col("__body")), c), "range_pct": div("__range", c)}
    two |= {"upper_shadow_pct": div("__up", c), "lower_shadow_pct": div("__low", c), "bullish_bar": c > o, "bearish_bar": c < o}
    two |= {"gap_up": o > pc, "gap_down": o < pc, "inside_bar": (h <= ph) & (l >= pl), "outside_bar": (h >= ph) & (l <= pl)}
    two |= {f"nr{n}": col("__range") == lowest("__range", n) for n in (4, 7)}
    frame = trailing(20)
    two["wide_range_bar"] = col("__range") > 1.8 * F.when(F.count("__range")
        .over(frame) == 20, median_of(F.collect_list("__range").over(frame)))
    two |= {"higher_high": h > ph, "higher_low": l > pl, "lower_high": h < ph, "lower_low": l < pl}
    two |= {"hh_hl_state": (h > ph) & (l > pl), "lh_ll_state": (h < ph) & (l < pl)}
    # A streak is as long as the way back to the last bar that broke it.
    two |= {"__no_rise": F.when(~flag(c > pc), col("__i")), "__no_fall": F.when(~flag(c < pc), col("__i"))}
    since = lambda x: col("__i") - F.max(x).over(_so_far())
    three = {"consecutive_up_days": since("__no_rise"), "consecutive_down_days": since("__no_fall")}
    return Needs(stages=[_candle_parts() | {"__i": place()}, two, three])


PATTERNS = [
    "doji", "long_legged_doji", "hammer", "hanging_man", "inverted_hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing",
    "bullish_harami", "bearish_harami", "bullish_marubozu", "bearish_marubozu", "spinning_top", "morning_star", "evening_star",
    "three_white_soldiers", "three_black_crows", "piercing_line", "dark_cloud_cover", "three_inside_up", "three_inside_down",
]


@register("candlestick_patterns", "candles", PATTERNS)
def _candlestick_patterns() -> Needs:
    o, h, l, c = (col(x) for x in (O, H, L, C))
    o1, h1, l1, c1, o2, c2 = lag(O), lag(H), lag(L), lag(C), lag(O, 2), lag(C, 2)
    size, span, up, low = F.abs(col("__body")), col("__range"), col("__up"), col("__low")
    real, rises, falls, rose, fell = span > 0, c > o, c < o, c1 > o1, c1 < o1
    doji = real & (size <= 0.1 * span)
    pin = lambda long, short: real & (long >= 2 * size) & (short <= 0.3 * size + 1e-12) & (size <= 0.35 * span)
    inside = (h <= h1) & (l >= l1) & (size < F.abs(o1 - c1))
    bare = real & (up <= 0.08 * span) & (low <= 0.08 * span)
    pause = F.abs(c1 - o1) <= 0.35 * (h1 - l1)
    half1, half2 = (o1 + c1) / 2, (o2 + c2) / 2
    two = {"doji": doji, "long_legged_doji": doji & (up >= 0.3 * span) & (low >= 0.3 * span)}
    two |= {"hammer": pin(low, up) & (c <= c1), "hanging_man": pin(low, up) & (c >= c1)}
    two |= {"inverted_hammer": pin(up, low) & (c <= c1), "shooting_star": pin(up, low) & (c >= c1)}
    two |= {"bullish_engulfing": rises & fell & (c >= o1) & (o <= c1), "bearish_engulfing": falls & rose & (c <= o1) & (o >= c1)}
    two |= {"bullish_harami": fell & rises & inside, "bearish_harami": rose & falls & inside}
    two |= {"bullish_marubozu": bare & rises, "bearish_marubozu": bare & falls}
    two |= {"spinning_top": real & (size <= 0.3 * span) & (up >= 0.2 * span) & (low >= 0.2 * span)}
    two |= {"morning_star": (c2 < o2) & pause & rises & (c > half2), "evening_star": (c2 > o2) & pause & falls & (c < half2)}
    two |= {"three_white_soldiers": rises & rose & (c2 > o2) & (c > c1) & (c1 > c2),
        "three_black_crows": falls & fell & (c2 < o2) & (c < c1) & (c1 < c2)}
    two |= {"piercing_line": fell & rises & (o < c1) & (c > half1) & (c < o1),
        "dark_cloud_cover": rose & falls & (o > c1) & (c < half1) & (c > o1)}
    three = {"three_inside_up": flag(lag("bullish_harami")) & rises & (c > h1),
        "three_inside_down": flag(lag("bearish_harami")) & falls & (c < l1)}
    return Needs(stages=[_candle_parts(), two, three])


def merged(families: list[Indicator]) -> Needs:
    """The needs of several families together; equal names are equal expressions."""
    out = Needs()
    for family in families:
        needs = family.build()
        out.before |= needs.before
        out.folds |= needs.folds
        for i, stage in enumerate(needs.stages):
            if i == len(out.stages):
                out.stages.append({})
            out.stages[i] |= stage
    return out


def pruned(needs: Needs, outputs: set[str]) -> Needs:
    """What of ``needs`` the outputs read, by the names in the text of the columns."""
    read, stages = set(outputs), []
    for stage in reversed(needs.stages):
        kept = {n: c for n, c in stage.items() if n in read}
        read |= {word for c in kept.values() for word in re.findall(r"\w+", str(c))}
        stages.insert(0, kept)
    folds = {names: fold for names, fold in needs.folds.items() if read & set(names)}
    return Needs(needs.before if folds else {}, folds, stages, read)


def _added(df: DataFrame, needs: Needs) -> DataFrame:
    if needs.before:
        df = df.withColumns(needs.before)
    if needs.folds:
        folds = dict(needs.folds)  # what the workers get; columns stay with the driver
        names = [n for outputs in folds for n in outputs if needs.read is None or n in needs.read]

        def kernel(s: K.Series) -> K.Series:
            return {n: x for outputs, fold in folds.items() for n, x in zip(outputs, fold(s)) if n in names}

        df = K.per_security(df, kernel, [O, H, L, C, V, *needs.before], names).drop(*needs.before)
    for stage in needs.stages:
        if new := {n: c for n, c in stage.items() if n not in df.columns}:
            df = df.withColumns(new)
    return df


def compute(prices: DataFrame, groups: list[str] | None = None, ids: list[str] | None = None, start: str | None = None,
    end: str | None = None, outputs: set[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Base columns and the outputs of the families of ``groups`` and ``ids`` (all unless given), of bars from ``start`` to ``end``.

    ``outputs``: only these of the families' outputs; ``keep``: columns of ``prices`` that go along.

    Families share one plan, up to PLAN_OUTPUTS columns: one shuffle and one sort for all their
    windows. More are computed in several plans over the same bars, joined by bar.
    """
    base = add_adjusted(prices).select(*BASE, *keep)
    shown = lambda s: [c for c in s.outputs if outputs is None or c in outputs]
    wanted = [s for s in _registry.values() if (ids is None or s.id in ids) and (groups is None or s.category in groups)]
    parts: list[list[Indicator]] = []
    size = 0
    for s in wanted:
        if not parts or size + len(shown(s)) > PLAN_OUTPUTS:
            parts.append([])
            size = 0
        parts[-1].append(s)
        size += len(shown(s))
    out = None
    for mine in parts:
        needs = merged(mine)
        made = _added(base, needs if outputs is None else pruned(needs, {c for s in mine for c in shown(s)}))
        types = dict(made.dtypes)
        names = [c for c in dict.fromkeys(c for s in mine for c in shown(s)) if out is None or c not in out.columns]
        part = made.select(*BASE, *keep, *((finite(c).alias(c) if types[c] == "double" else F.col(c)) for c in names))
        out = part if out is None else out.join(part.drop(*BASE[2:], *keep), ["security_id", "date"])
    out = base if out is None else out
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    return out.filter(F.col("date") <= F.lit(end).cast("date")) if end else out


def refuse_to_persist(*_: object) -> None:
    """Indicators are recomputed, never stored."""
    raise RuntimeError("indicators are for use in memory only")
