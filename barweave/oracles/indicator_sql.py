"""SQL for every indicator family, written from the definitions, to check the queries against another engine.

A family's SQL is a chain of selects over the adjusted bars ``x`` (o, h, l, c, v and the bar's
number i), each adding columns to the one before; recursive definitions are recursive tables
over the bar's number. Doubles are rounded to the family's digits: price levels to fewer, as
their last bits depend on the order of additions. Negative digits are significant ones, for products
of any size.
"""

from __future__ import annotations

import math

W = "PARTITION BY security_id ORDER BY date"
#: Digits of families whose values are not ratios; all others have six.
DIGITS = {
    **dict.fromkeys(("sma", "ema", "wma", "dema", "tema", "hma", "kama", "vwma", "macd", "apo", "supertrend", "psar", "bollinger",
        "keltner", "atr"), 4),
    **dict.fromkeys(("ichimoku", "support_resistance", "rolling_fib_60", "pivots", "linreg", "zscore_percentile", "fisher", "tsi",
        "cci", "adx"), 4),
    **dict.fromkeys(("ad_line", "chaikin_osc", "force_index", "pvt", "obv", "mass_index", "mfi", "stoch_rsi", "rsi", "ppo"), 4),
    "momentum": 8, "visual_chikou_shifted": 8, "eom": 1, "nvi_pvi": -9,
}


def digits(family: str) -> int:
    return DIGITS.get(family, 6)


def _lag(c: str, n: int = 1) -> str:
    return f"(lag({c}, {n}) OVER ({W}))"


def _over(f: str, c: str, n: int) -> str:
    return f"({f}({c}) OVER ({W} ROWS {n - 1} PRECEDING))"


def _g(f: str, c: str, n: int) -> str:
    """f over the last n bars, null unless all have a value."""
    return f"(CASE WHEN {_over('count', c, n)} = {n} THEN {_over(f, c, n)} END)"


def _before(f: str, c: str, n: int) -> str:
    frame = f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"(CASE WHEN count({c}) OVER {frame} = {n} THEN {f}({c}) OVER {frame} END)"


def _d(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif({b}, 0))"


def _pos(c: str, low: str, high: str, n: int) -> str:
    return _d(f"{c} - {_g('min', low, n)}", f"{_g('max', high, n)} - {_g('min', low, n)}")


def _up(a: str, b: str) -> str:
    return f"({a} > {b} AND {_lag(a)} <= {_lag(b)})"


def _down(a: str, b: str) -> str:
    return f"({a} < {b} AND {_lag(a)} >= {_lag(b)})"


BASE = (f"x AS MATERIALIZED (SELECT security_id, date, ao AS o, ah AS h, al AS l, ac AS c, volume AS v, row_number() OVER ({W}) AS i "
    f"FROM adj)")
TR = f"greatest(h - l, abs(h - {_lag('c')}), abs(l - {_lag('c')}))"


class Chain:
    """CTEs after ``x``, the last of which is ``at``."""

    def __init__(self) -> None:
        self.ctes: list[str] = []
        self.at = "x"

    def add(self, **columns: str) -> Chain:
        name = f"s{len(self.ctes)}"
        made = ", ".join(f"{e} AS {n}" for n, e in columns.items())
        self.ctes.append(f"{name} AS MATERIALIZED (SELECT *, {made} FROM {self.at})")
        self.at = name
        return self

    def fold(self, first: str, start: dict[str, str], step: dict[str, str], keep: dict[str, str]) -> Chain:
        """A recursion over the bars of a security.

        ``start`` on the bar where ``first`` holds, ``step`` from state r to bar x on all later ones.
        """
        r, name, source = f"r{len(self.ctes)}", f"s{len(self.ctes) + 1}", self.at
        begin = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in start.items())
        onward = ", ".join(f"({e})::DOUBLE" for e in step.values())
        self.ctes.append(
            f"{r} AS MATERIALIZED (WITH RECURSIVE r AS (SELECT security_id, i, {begin} FROM {source} AS x WHERE {first}"
            f" UNION ALL SELECT x.security_id, x.i, {onward} FROM r JOIN {source} AS x ON x.security_id = r.security_id AND x.i = "
            f"r.i + 1) SELECT * FROM r)"
        )
        kept = ", ".join(f"{e} AS {n}" for n, e in keep.items())
        self.ctes.append(f"{name} AS MATERIALIZED (SELECT x.*, {kept} FROM {source} AS x LEFT JOIN {r} AS r USING (security_id, i))")
        self.at = name
        return self

    def ewm(self, **wanted: tuple[str, int]) -> Chain:
        """Exponential means of columns without inner gaps, seeded with the first value, shown from the n-th on."""
        start, step, keep = {}, {}, {}
        for name, (c, n) in wanted.items():
            a = 2.0 / (n + 1)
            start |= {f"e_{name}": f"x.{c}", f"k_{name}": f"CASE WHEN x.{c} IS NULL THEN 0 ELSE 1 END"}
            moved = f"{a!r}::DOUBLE * x.{c} + {1 - a!r}::DOUBLE * r.e_{name}"
            step |= {f"e_{name}": f"CASE WHEN x.{c} IS NULL THEN r.e_{name} WHEN r.e_{name} IS NULL THEN x.{c} ELSE {moved} END"}
            step |= {f"k_{name}": f"r.k_{name} + CASE WHEN x.{c} IS NULL THEN 0 ELSE 1 END"}
            keep[name] = f"CASE WHEN r.k_{name} >= {n} AND x.{c} IS NOT NULL THEN r.e_{name} END"
        return self.fold("x.i = 1", start, step, keep)

    def seeded(self, **wanted: tuple[str, int, float]) -> Chain:
        """Means seeded with that of the first n values, then moved by the given share of each new one."""
        start, step, keep = {}, {}, {}
        for name, (c, n, a) in wanted.items():
            known = f"CASE WHEN x.{c} IS NULL THEN 0 ELSE 1 END"
            start |= {f"e_{name}": f"coalesce(x.{c}, 0) / {n}", f"k_{name}": known}
            moved = f"r.e_{name} + {a!r}::DOUBLE * (x.{c} - r.e_{name})"
            step |= {f"e_{name}": f"CASE WHEN x.{c} IS NULL THEN r.e_{name} WHEN r.k_{name} < {n} THEN r.e_{name} + x.{c} / {n} ELSE "
                f"{moved} END"}
            step |= {f"k_{name}": f"r.k_{name} + {known}"}
            keep[name] = f"CASE WHEN r.k_{name} >= {n} AND x.{c} IS NOT NULL THEN r.e_{name} END"
        return self.fold("x.i = 1", start, step, keep)


def _round(value: str, n: int) -> str:
    if n < 0:
        return f"CAST(printf('%.{-n - 1}e', {value}) AS DOUBLE)"
    return f"round(({value}) + 3.14159265e-{n + 3}::DOUBLE, {n}) + 0.0::DOUBLE"


Family = tuple[Chain, dict[str, str], dict[str, str]]


def _windows() -> dict[str, Family]:
    """Families without a recursion: (chain, doubles, other columns)."""
    f: dict[str, Family] = {}
    sma, trends = (5, 10, 20, 30, 50, 60, 100, 120, 150, 200, 250), (20, 50, 200)
    ch = Chain().add(**{f"sma_{n}": _g("avg", "c", n)
        for n in sma}).add(**{f"slope{n}": f"{_d(f'sma_{n}', _lag(f'sma_{n}', 5))} - 1" for n in trends})
    flags = {f"close_above_sma{n}": f"c > sma_{n}" for n in trends} | {"sma20_above_sma50": "sma_20 > sma_50",
        "sma50_above_sma200": "sma_50 > sma_200"}
    flags |= {"golden_cross_50_200": _up("sma_50", "sma_200"), "death_cross_50_200": _down("sma_50", "sma_200")}
    flags |= {f"sma_{n}_direction": f"CASE WHEN slope{n} > 0 THEN 1 WHEN slope{n} < 0 THEN -1 ELSE 0 END" for n in trends}
    f["sma"] = ch, {f"sma_{n}": f"sma_{n}" for n in sma} | {f"close_to_sma_{n}": f"{_d('c', f'sma_{n}')} - 1"
        for n in sma} | {f"sma_{n}_slope": f"slope{n}" for n in trends}, flags

    def wma(c: str, n: int) -> str:
        terms = " + ".join(f"{n - k} * {_lag(c, k)}" for k in range(n))
        return f"({terms}) / {n * (n + 1) / 2}"

    f["wma"] = Chain(), {f"wma_{n}": wma("c", n) for n in (10, 20, 50, 100)}, {}
    ch = Chain().add(**{f"h{n}": f"2 * {wma('c', n // 2)} - {wma('c', n)}" for n in (9, 20, 55)})
    f["hma"] = ch, {f"hma_{n}": wma(f"h{n}", round(math.sqrt(n))) for n in (9, 20, 55)}, {}
    f["vwma"] = Chain(), {f"vwma_{n}": _d(_g("sum", "(c * v)", n), _g("sum", "v", n)) for n in (10, 20, 50)}, {}
    ch = Chain().add(**{f"{a}{n}": _over("list", c, n) for n in (14, 25) for a, c in (("hs", "h"), ("ls", "l"))})
    up = lambda n: f"CASE WHEN len(hs{n}) = {n} THEN 100.0::DOUBLE * list_position(hs{n}, list_max(hs{n})) / {n} END"
    down = lambda n: f"CASE WHEN len(ls{n}) = {n} THEN 100.0::DOUBLE * list_position(ls{n}, list_min(ls{n})) / {n} END"
    f["aroon"] = ch, {k: e for n in (14, 25)
        for k, e in ((f"aroon_up_{n}", up(n)), (f"aroon_down_{n}", down(n)), (f"aroon_osc_{n}", f"({up(n)}) - ({down(n)})"))}, {}
    ch = Chain().add(tr=TR, vp=f"abs(h - {_lag('l')})", vm=f"abs(l - {_lag('h')})")
    part = lambda c: f"CASE WHEN i > 14 AND {_over('sum', 'tr', 14)} > 0 THEN {_over('sum', c, 14)} / {_over('sum', 'tr', 14)} END"
    f["vortex"] = ch, {"vortex_pos_14": part("vp"), "vortex_neg_14": part("vm")}, {}
    ch = Chain().add(tr=TR).add(q=_d(_g("sum", "tr", 14), f"{_g('max', 'h', 14)} - {_g('min', 'l', 14)}"))
    f["choppiness"] = ch, {"choppiness_14": f"100 * ln(q) / {math.log(14)!r}::DOUBLE"}, {}
    lines: dict[str, str] = {}
    ch = Chain()
    for n in (20, 60, 120):
        full = f"CASE WHEN {_over('count', 'c', n)} = {n} THEN"
        frame = f"OVER ({W} ROWS {n - 1} PRECEDING)"
        ch.add(**{f"b{n}": f"{full} regr_slope(c, i) {frame} END", f"a{n}": f"{full} avg(c) {frame} END",
            f"t{n}": f"{full} var_pop(c) {frame} * {n} END"})
        off = f"(c - a{n} - b{n} * {(n - 1) / 2})"
        sxx = n * (n * n - 1) / 12.0
        left = f"greatest(t{n} - b{n} * b{n} * {sxx}, 0)"
        lines |= {f"linreg_slope_{n}": f"b{n}", f"linreg_slope_norm_{n}": _d(f"b{n}", "c"), f"dist_from_linreg_{n}": _d(off, "c")}
        lines[f"linreg_r2_{n}"] = f"CASE WHEN t{n} > 1e-12 THEN b{n} * b{n} * {sxx} / t{n} END"
        lines[f"corr_time_{n}"] = f"CASE WHEN t{n} > 1e-12 THEN b{n} * sqrt({sxx}::DOUBLE / t{n}) END"
        lines[f"linreg_zscore_{n}"] = f"CASE WHEN {left} > 1e-12 THEN {off} / sqrt({left} / {n - 1}) END"
    f["linreg"] = ch, lines, {}

    ch = Chain().add(k=f"100 * {_pos('c', 'l', 'h', 14)}").add(kd=_g("avg", "k", 3))
    f["stochastic"] = ch, {"stoch_k_14": "k", "stoch_d_14": "kd",
        "stoch_slow_d_14": _g("avg", "kd", 3)}, {"stoch_oversold": "k <= 20", "stoch_overbought": "k >= 80"}
    ch = Chain().add(tp="(h + l + c) / "
        "3").add(**{f"g{n}": f"tp - {_g('avg', 'tp', n)}" for n in (14, 20)}).add(**{f"a{n}": f"abs(g{n})" for n in (14, 20)})
    f["cci"] = ch, {f"cci_{n}": _d(f"g{n}", f"0.015::DOUBLE * {_g('avg', f'a{n}', n)}") for n in (14, 20)}, {}
    f["williams_r"] = Chain(), {f"williams_r_{n}": f"-100 * "
        f"{_d(_g('max', 'h', n) + ' - c', _g('max', 'h', n) + ' - ' + _g('min', 'l', n))}" for n in (14, 28)}, {}
    f["roc"] = Chain(), {f"roc_{n}": f"{_d('c', _lag('c', n))} - 1" for n in (5, 10, 20, 60, 120)}, {}
    f["momentum"] = Chain(), {f"mom_{n}": f"c - {_lag('c', n)}" for n in (5, 10, 20)}, {}
    f["close_vs_close_26"] = Chain(), {"close_vs_close_26": f"{_d('c', _lag('c', 26))} - 1"}, {}
    ch = Chain().add(d=f"c - {_lag('c')}").add(u="CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END",
        w="CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END")
    ch.add(**{f"{x}{n}": _g("sum", x, n) for n in (14, 20) for x in "uw"})
    f["cmo"] = ch, {f"cmo_{n}": f"CASE WHEN u{n} + w{n} = 0 THEN 0 ELSE {_d(f'100 * (u{n} - w{n})', f'u{n} + w{n}')} END"
        for n in (14, 20)}, {}
    ch = Chain().add(fl=f"least(l, {_lag('c')})").add(bp="c - fl", sp=f"greatest(h, {_lag('c')}) - fl")
    share = lambda n: _d(_g("sum", "bp", n), _g("sum", "sp", n))
    f["ultimate_oscillator"] = ch, {"ultimate_oscillator": f"100 * (4 * {share(7)} + 2 * {share(14)} + {share(28)}) / 7"}, {}
    f["awesome_oscillator"] = Chain().add(m="(h + l) / 2"), {"awesome_oscillator": f"{_g('avg', 'm', 5)} - {_g('avg', 'm', 34)}"}, {}
    f["dpo"] = Chain(), {"dpo_20": f"{_lag('c', 11)} - {_g('avg', 'c', 20)}"}, {}
    ch = Chain().add(b="c - o", r="h - l").add(q=_d(_g("avg", "b", 10), _g("avg", "r", 10)))
    f["rvi"] = ch, {"rvi_10": "q", "rvi_signal_10": _g("avg", "q", 4)}, {}
    ch = Chain().add(r=f"{_d('c', _lag('c'))} - 1").add(vol=_g("stddev_samp", "r", 20), cs=_over("list", "c", 252),
        vs=_over("list", "v", 60))
    ch.add(ws=f"CASE WHEN i >= 60 THEN list_filter({_over('list', 'vol', 60)}, lambda y: y IS NOT NULL) END")
    z = {f"{x}_zscore_{n}": _d(f"{c} - {_g('avg', c, n)}", _g("stddev_samp", c, n))
        for x, c in (("close", "c"), ("return", "r"), ("volume", "v")) for n in (20, 60, 120)}
    at_most = lambda xs, x: f"len(list_filter({xs}, lambda y: y <= {x}))::DOUBLE / len({xs})"
    z["price_position_252"] = f"CASE WHEN i >= 252 THEN {at_most('cs', 'c')} END"
    z["volume_percentile_60"] = f"CASE WHEN i >= 60 THEN {at_most('vs', 'v')} END"
    z["volatility_percentile_60"] = f"CASE WHEN vol IS NOT NULL AND ws IS NOT NULL THEN {at_most('ws', 'vol')} END"
    f["zscore_percentile"] = ch, z, {}

    ch = Chain().add(r=f"{_d('c', _lag('c'))} - 1")
    sd = {f"stdev_ret_{n}": _g("stddev_samp", "r", n) for n in (10, 20, 60)}
    f["hist_vol"] = ch, sd | {f"hist_vol_{n}": f"{_g('stddev_samp', 'r', n)} * sqrt(252::DOUBLE)" for n in (10, 20, 60)}, {}
    ch = Chain().add(hl="ln(h / l)", co="ln(c / o)", rs="ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)", oc=f"ln(o / {_lag('c')})",
        cc=f"ln(c / {_lag('c')})")
    ch.add(pk=f"hl * hl / {4 * math.log(2)!r}::DOUBLE", gk=f"0.5::DOUBLE * hl * hl - {2 * math.log(2) - 1!r}::DOUBLE * co * co",
        oo="oc * oc", c2="cc * cc")
    yearly = lambda e: f"CASE WHEN ({e}) IS NOT NULL THEN sqrt(greatest({e}, 0) * 252) END"
    out = {f"{k}_{n}": yearly(_g("avg", c, n)) for k, c in (("parkinson", "pk"), ("garman_klass", "gk"), ("rogers_satchell", "rs"))
        for n in (20, 60)}
    for n in (20, 60):
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        out[f"yang_zhang_{n}"] = yearly(f"{_g('avg', 'oo', n)} + {k!r}::DOUBLE * {_g('avg', 'c2', n)} + {1 - k!r}::DOUBLE * "
            f"{_g('avg', 'rs', n)}")
    f["ohlc_vol"] = ch, out, {}
    ch = Chain().add(**{f"p{n}": _g("max", "c", n) for n in (14, 20)}).add(**{f"d{n}": f"(100 * (c - p{n}) / p{n}) ** 2"
        for n in (14, 20)})
    f["ulcer"] = ch, {f"ulcer_{n}": f"sqrt({_g('avg', f'd{n}', n)})" for n in (14, 20)}, {}
    bands = ((20, 1), (20, 2), (20, 3), (10, 2), (50, 2))
    ch = Chain().add(**{f"m{n}": _g("avg", "c", n) for n in (10, 20, 50)},
        **{f"sd{n}": _g("stddev_samp", "c", n) for n in (10, 20, 50)})
    ch.add(up="m20 + 2 * sd20", lo="m20 - 2 * sd20").add(hi="c > up", lw="c < lo").add(hi0=f"coalesce({_lag('hi')}, false)",
        lw0=f"coalesce({_lag('lw')}, false)")
    out = {f"bb_{n}_{k}_{x}": e for n, k in bands
        for x, e in (("mid", f"m{n}"), ("upper", f"m{n} + {k} * sd{n}"), ("lower", f"m{n} - {k} * sd{n}"))}
    out |= {"bb_20_2_width": _d("up - lo", "m20"), "bb_20_2_pctb": _d("c - lo", "up - lo")}
    flags = {"close_above_bb_upper": "hi", "close_below_bb_lower": "lw", "cross_above_bb_upper": "hi AND NOT hi0",
        "cross_below_bb_lower": "lw AND NOT lw0"}
    f["bollinger"] = ch, out, flags | {"reentry_from_upper": "NOT hi AND hi0", "reentry_from_lower": "NOT lw AND lw0"}
    out, flags = {}, {}
    for n in (20, 55):
        out |= {f"donchian_{n}_upper": _g("max", "h", n), f"donchian_{n}_lower": _g("min", "l", n),
            f"donchian_{n}_pos": _pos("c", "l", "h", n)}
        out[f"donchian_{n}_mid"] = f"({_g('max', 'h', n)} + {_g('min', 'l', n)}) / 2"
        flags |= {f"donchian_{n}_breakout_up": f"c > {_before('max', 'h', n)}",
            f"donchian_{n}_breakout_down": f"c < {_before('min', 'l', n)}"}
    f["donchian"] = Chain(), out, flags

    out = {f"volume_sma_{n}": _g("avg", "v", n) for n in (5, 10, 20, 60)}
    f["volume_sma"] = Chain(), out | {f"volume_ratio_{n}": _d("v", _before("avg", "v", n)) for n in (5, 20, 60)}, {}
    so_far = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"
    f["obv"] = Chain().add(s=f"coalesce(sign(c - {_lag('c')}) * v, 0)"), {"obv": f"sum(s) {so_far}"}, {}
    flow = _d("(c - l) - (h - c)", "h - l") + " * v"
    f["ad_line"] = Chain().add(s=f"coalesce({flow}, 0)"), {"ad_line": f"sum(s) {so_far}"}, {}
    f["cmf"] = Chain().add(s=flow), {"cmf_20": _d(_g("sum", "s", 20), _g("sum", "v", 20))}, {}
    ch = Chain().add(tp="(h + l + c) / 3").add(st=f"tp - {_lag('tp')}").add(u="CASE WHEN st > 0 THEN tp * v WHEN st <= 0 THEN 0 END",
        w="CASE WHEN st < 0 THEN tp * v WHEN st >= 0 THEN 0 END")
    ch.add(us=_g("sum", "u", 14), ws=_g("sum", "w", 14))
    f["mfi"] = ch, {"mfi_14": "CASE WHEN us + ws <> 0 THEN CASE WHEN ws = 0 THEN 100 ELSE 100 - 100 / (1 + us / ws) END END"}, {}
    ch = Chain().add(m="(h + l) / 2").add(e=_d(f"m - {_lag('m')}", _d("v", "h - l")))
    f["eom"] = ch, {"eom_14": _g("avg", "e", 14)}, {}
    f["pvt"] = Chain().add(s=f"coalesce(({_d('c', _lag('c'))} - 1) * v, 0)"), {"pvt": f"sum(s) {so_far}"}, {}
    f["volume_roc"] = Chain(), {f"volume_roc_{n}": f"{_d('v', _lag('v', n))} - 1" for n in (10, 20)}, {}
    f["rolling_vwap"] = Chain().add(tv="(h + l + c) / 3 * v"), {f"rolling_vwap_{n}": _d(_g("sum", "tv", n), _g("sum", "v", n))
        for n in (20, 60)}, {}

    half = lambda n: f"(({_g('max', 'h', n)} + {_g('min', 'l', n)}) / 2)"
    ch = Chain().add(tn=half(9), kj=half(26), sb=half(52)).add(sa="(tn + kj) / 2").add(ca=_lag("sa", 26),
        cb=_lag("sb", 26)).add(top="greatest(ca, cb)", bot="least(ca, cb)")
    out = {"tenkan": "tn", "kijun": "kj", "senkou_a_raw": "sa", "senkou_b_raw": "sb", "cloud_a_at_t": "ca", "cloud_b_at_t": "cb",
        "cloud_top": "top", "cloud_bottom": "bot", "cloud_thickness": "top - bot"}
    flags = {"price_above_cloud": "c > top", "price_below_cloud": "c < bot", "price_inside_cloud": "c <= top AND c >= bot",
        "tenkan_above_kijun": "tn > kj"}
    flags |= {"tenkan_cross_kijun_up": _up("tn", "kj"), "tenkan_cross_kijun_down": _down("tn", "kj"), "cloud_bullish": "ca > cb",
        "cloud_bearish": "ca < cb"}
    f["ichimoku"] = ch, out, flags | {"cloud_breakout_up": _up("c", "top"), "cloud_breakout_down": _down("c", "bot")}
    f["visual_chikou_shifted"] = Chain(), {"visual_chikou_shifted": f"lead(c, 26) OVER ({W})"}, {}
    out, flags = {}, {}
    for n in (20, 55, 60, 120, 252):
        out |= {f"roll_high_{n}": _g("max", "h", n), f"roll_low_{n}": _g("min", "l", n), f"channel_pos_{n}": _pos("c", "l", "h", n)}
        out |= {f"dist_high_{n}": f"{_d('c', _g('max', 'h', n))} - 1", f"dist_low_{n}": f"{_d('c', _g('min', 'l', n))} - 1"}
    for n in (20, 55, 252):
        up, low = _before("max", "h", n), _before("min", "l", n)
        flags |= {f"prior_high_breakout_{n}": f"c > {up}", f"prior_low_breakdown_{n}": f"c < {low}", f"new_high_{n}": f"h >= {up}",
            f"new_low_{n}": f"l <= {low}"}
    f["support_resistance"] = Chain(), out, flags
    ch = Chain().add(up=_g("max", "h", 60),
        lo=_g("min", "l", 60)).add(**{f"f{k}": f"up - (up - lo) * {k / 1000}::DOUBLE" for k in (236, 382, 500, 618, 786)})
    f["rolling_fib_60"] = ch, {f"rolling_fib_60_{k}": f"f{k}"
        for k in (236, 382, 500, 618, 786)} | {f"dist_rolling_fib_60_{k}": _d(f"c - f{k}", "c") for k in (236, 382, 500, 618, 786)}, {}
    ch = Chain().add(ph=_lag("h"), pl=_lag("l"), pc=_lag("c"), po=_lag("o")).add(p="(ph + pl + pc) / 3", s="ph - pl",
        w="(ph + pl + 2 * po) / 4")
    out = {"pivot_p": "p", "pivot_r1": "2 * p - pl", "pivot_s1": "2 * p - ph", "pivot_r2": "p + s", "pivot_s2": "p - s",
        "pivot_r3": "ph + 2 * (p - pl)", "pivot_s3": "pl - 2 * (ph - p)", "fib_pivot_p": "p"}
    out |= {f"fib_pivot_{x}{i}": f"p {sign} s * {k}::DOUBLE" for i, k in ((1, 0.382), (2, 0.618))
        for x, sign in (("r", "+"), ("s", "-"))}
    f["pivots"] = ch, out | {"cam_r1": "pc + s * 1.1::DOUBLE / 12", "cam_s1": "pc - s * 1.1::DOUBLE / 12", "woodie_p": "w",
        "woodie_r1": "2 * w - pl", "woodie_s1": "2 * w - ph"}, {}

    parts = {"b": "c - o", "rg": "h - l", "us": "h - greatest(o, c)", "ls": "least(o, c) - l", "ph": _lag("h"), "pl": _lag("l"),
        "pc": _lag("c"), "po": _lag("o"), "c2": _lag("c", 2), "o2": _lag("o", 2)}
    ch = Chain().add(**parts).add(r4=_g("min", "rg", 4), r7=_g("min", "rg", 7), md=_g("median", "rg", 20),
        nu="CASE WHEN coalesce(c > pc, false) THEN NULL ELSE i END", nd="CASE WHEN coalesce(c < pc, false) THEN NULL ELSE i END")
    out = {"body_pct": _d("b", "c"), "body_abs_pct": _d("abs(b)", "c"), "upper_shadow_pct": _d("us", "c"),
        "lower_shadow_pct": _d("ls", "c"), "range_pct": _d("rg", "c")}
    out |= {"consecutive_up_days": f"(i - max(nu) {so_far})::DOUBLE", "consecutive_down_days": f"(i - max(nd) {so_far})::DOUBLE"}
    flags = {"bullish_bar": "c > o", "bearish_bar": "c < o", "gap_up": "o > pc", "gap_down": "o < pc",
        "inside_bar": "h <= ph AND l >= pl", "outside_bar": "h >= ph AND l <= pl", "nr4": "rg = r4", "nr7": "rg = r7"}
    flags |= {"wide_range_bar": "rg > 1.8::DOUBLE * md", "higher_high": "h > ph", "higher_low": "l > pl", "lower_high": "h < ph",
        "lower_low": "l < pl", "hh_hl_state": "h > ph AND l > pl", "lh_ll_state": "h < ph AND l < pl"}
    f["candle_anatomy"] = ch, out, flags
    ch = Chain().add(**parts).add(z="abs(b)", doji="rg > 0 AND abs(b) <= 0.1::DOUBLE * rg")
    pin = lambda a, e: f"rg > 0 AND {a} >= 2 * z AND {e} <= 0.3::DOUBLE * z + 1e-12::DOUBLE AND z <= 0.35::DOUBLE * rg"
    ch.add(ham=pin("ls", "us"), inv=pin("us", "ls"), bare="rg > 0 AND us <= 0.08::DOUBLE * rg AND ls <= 0.08::DOUBLE * rg",
        ins="h <= ph AND l >= pl AND z < abs(po - pc)", pause="abs(pc - po) <= 0.35::DOUBLE * (ph - pl)")
    ch.add(bh="pc < po AND c > o AND ins", sh="pc > po AND c < o AND ins")
    flags = {"doji": "doji", "long_legged_doji": "doji AND us >= 0.3::DOUBLE * rg AND ls >= 0.3::DOUBLE * rg",
        "hammer": "ham AND c <= pc", "hanging_man": "ham AND c >= pc", "inverted_hammer": "inv AND c <= pc",
        "shooting_star": "inv AND c >= pc"}
    flags |= {"bullish_engulfing": "c > o AND pc < po AND c >= po AND o <= pc",
        "bearish_engulfing": "c < o AND pc > po AND c <= po AND o >= pc", "bullish_harami": "bh", "bearish_harami": "sh",
        "bullish_marubozu": "bare AND c > o", "bearish_marubozu": "bare AND c < o"}
    flags |= {"spinning_top": "rg > 0 AND z <= 0.3::DOUBLE * rg AND us >= 0.2::DOUBLE * rg AND ls >= 0.2::DOUBLE * rg",
        "morning_star": "c2 < o2 AND pause AND c > o AND c > (o2 + c2) / 2",
        "evening_star": "c2 > o2 AND pause AND c < o AND c < (o2 + c2) / 2"}
    flags |= {"three_white_soldiers": "c > o AND pc > po AND c2 > o2 AND c > pc AND pc > c2",
        "three_black_crows": "c < o AND pc < po AND c2 < o2 AND c < pc AND pc < c2",
        "piercing_line": "pc < po AND c > o AND o < pc AND c > (po + pc) / 2 AND c < po"}
    flags |= {"dark_cloud_cover": "pc > po AND c < o AND o > pc AND c < (po + pc) / 2 AND c > po",
        "three_inside_up": f"coalesce({_lag('bh')}, false) AND c > o AND c > ph",
        "three_inside_down": f"coalesce({_lag('sh')}, false) AND c < o AND c < pl"}
    f["candlestick_patterns"] = ch, {}, flags
    return f


def _recursive() -> dict[str, Family]:
    """Families with a recursion."""
    f: dict[str, Family] = {}
    spans = (5, 10, 12, 20, 26, 50, 60, 100, 120, 200)
    ch = Chain().ewm(**{f"ema_{n}": ("c", n) for n in spans})
    f["ema"] = ch, {f"ema_{n}": f"ema_{n}" for n in spans}, {"ema12_cross_ema26_up": _up("ema_12", "ema_26"),
        "ema12_cross_ema26_down": _down("ema_12", "ema_26")}
    ch = Chain().ewm(e1=("c", 12), e2=("c", 26)).add(m="e1 - e2").ewm(s=("m", 9))
    flags = {"macd_cross_signal_up": _up("m", "s"), "macd_cross_signal_down": _down("m", "s"),
        "macd_cross_zero_up": f"m > 0 AND {_lag('m')} <= 0", "macd_cross_zero_down": f"m < 0 AND {_lag('m')} >= 0"}
    f["macd"] = ch, {"macd": "m", "macd_signal": "s", "macd_histogram": "m - s"}, flags
    ch = Chain().ewm(e1=("c", 12), e2=("c", 26)).add(m=_d("e1 - e2", "e2") + " * 100").ewm(s=("m", 9))
    f["ppo"] = ch, {"ppo": "m", "ppo_signal": "s", "ppo_histogram": "m - s"}, {}
    f["apo"] = Chain().ewm(e1=("c", 12), e2=("c", 26)), {"apo": "e1 - e2"}, {}
    ch = Chain()
    for k in range(1, 4):
        ch.seeded(**{f"e{k}_{n}": ("c" if k == 1 else f"e{k - 1}_{n}", n, 2 / (n + 1)) for n in (10, 20, 50)})
    f["dema"] = ch, {f"dema_{n}": f"2 * e1_{n} - e2_{n}" for n in (10, 20, 50)}, {}
    f["tema"] = ch, {f"tema_{n}": f"3 * (e1_{n} - e2_{n}) + e3_{n}" for n in (10, 20, 50)}, {}
    ch = Chain().add(d=f"abs(c - {_lag('c')})").add(**{f"w{n}": _g("sum", "d", n) for n in (10, 20)},
        **{f"p{n}": _lag("c", n) for n in (10, 20)})
    ch.add(**{f"q{n}": f"(coalesce({_d(f'abs(c - p{n})', f'w{n}')}, 0) * {2 / 3 - 2 / 31!r}::DOUBLE + {2 / 31!r}::DOUBLE) ** 2"
        for n in (10, 20)})
    for n in (10, 20):
        ch.fold(f"x.i = {n + 1}", {"k": "x.c"}, {"k": f"r.k + x.q{n} * (x.c - r.k)"}, {f"kama_{n}": "r.k"})
    f["kama"] = ch, {f"kama_{n}": f"kama_{n}" for n in (10, 20)}, {}

    ch = Chain().add(tr=TR, up=f"h - {_lag('h')}", dn=f"{_lag('l')} - l").add(pd="CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END",
        md="CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END")
    out: dict[str, str] = {}
    for n in (14, 20):
        seed = lambda c, f_: f"(SELECT {f_}(y.{c}) FROM {ch.at} AS y WHERE y.security_id = x.security_id AND y.i BETWEEN 2 AND {n})"  # noqa: B023, E731
        start = {"p": seed("pd", "sum"), "m": seed("md", "sum"), "t": seed("tr", "avg")}
        step = {"p": f"r.p - r.p / {n} + x.pd", "m": f"r.m - r.m / {n} + x.md", "t": f"(r.t * {n - 1} + x.tr) / {n}"}
        ch.fold(f"x.i = {n}", start, step,
            {f"di{n}": "CASE WHEN r.t > 0 THEN 100 * r.p / r.t END", f"dm{n}": "CASE WHEN r.t > 0 THEN 100 * r.m / r.t END"})
        ch.add(**{f"dx{n}": _d(f"100 * abs(di{n} - dm{n})", f"CASE WHEN di{n} + dm{n} > 0 THEN di{n} + dm{n} END")})
        first = f"(SELECT avg(y.dx{n}) FROM {ch.at} AS y WHERE y.security_id = x.security_id AND y.i BETWEEN {n} AND {2 * n})"
        ch.fold(f"x.i = {2 * n}", {"a": first}, {"a": f"(r.a * {n - 1} + x.dx{n}) / {n}"}, {f"adx{n}": "r.a"})
        out |= {f"plus_di_{n}": f"di{n}", f"minus_di_{n}": f"dm{n}", f"dx_{n}": f"dx{n}", f"adx_{n}": f"adx{n}"}
    flags = {f"adx14_gt_{k}": f"adx14 > {k}" for k in (20, 25, 40)}
    f["adx"] = ch, out, flags | {"plus_di_cross_minus_di_up": _up("di14", "dm14"), "plus_di_cross_minus_di_down": _down("di14", "dm14")}
    ch = Chain().add(hl="h - l").ewm(e1=("hl", 9)).ewm(e2=("e1", 9)).add(q=_d("e1", "e2"))
    f["mass_index"] = ch, {"mass_index": _g("sum", "q", 25)}, {}

    ch = Chain().add(tr=TR).seeded(a=("tr", 10, 0.1)).add(mid="(h + l) / 2")
    out, flags = {}, {}
    for k in (2, 3, 4):
        ch.add(**{f"u{k}": f"mid + {k} * a", f"w{k}": f"mid - {k} * a"})
        ch.add(**{f"pu{k}": _lag(f"u{k}"), f"pw{k}": _lag(f"w{k}"), f"pc{k}": _lag("c")})
        way = f"CASE WHEN r.d > 0 AND x.c < x.pw{k} THEN -1 WHEN r.d < 0 AND x.c > x.pu{k} THEN 1 ELSE r.d END"
        low = f"CASE WHEN x.pc{k} >= r.s THEN greatest(x.w{k}, x.pw{k}) ELSE x.w{k} END"
        high = f"CASE WHEN x.pc{k} <= r.s THEN least(x.u{k}, x.pu{k}) ELSE x.u{k} END"
        ch.fold("x.i = 10", {"s": f"x.w{k}", "d": "1"}, {"s": f"CASE WHEN ({way}) > 0 THEN {low} ELSE {high} END", "d": way},
            {f"st{k}": "r.s", f"sd{k}": "r.d"})
        out |= {f"supertrend_10_{k}": f"st{k}", f"supertrend_10_{k}_dir": f"sd{k}"}
    f["supertrend"] = ch, out, {"supertrend_flip_up": f"sd3 = 1 AND {_lag('sd3')} = -1",
        "supertrend_flip_down": f"sd3 = -1 AND {_lag('sd3')} = 1"}
    ch = Chain().add(h1=_lag("h"), l1=_lag("l")).add(h2=f"coalesce({_lag('h', 2)}, h1)", l2=f"coalesce({_lag('l', 2)}, l1)")
    at = "(r.s + r.a * (r.e - r.s))"
    long_stop, short_stop = f"least({at}, x.l1, x.l2)", f"greatest({at}, x.h1, x.h2)"
    turns = f"CASE WHEN r.d > 0 THEN x.l < {long_stop} ELSE x.h > {short_stop} END"
    better = "CASE WHEN r.d > 0 THEN x.h > r.e ELSE x.l < r.e END"
    step = {
        "s": f"CASE WHEN {turns} THEN r.e WHEN r.d > 0 THEN {long_stop} ELSE {short_stop} END",
        "d": f"CASE WHEN {turns} THEN -r.d ELSE r.d END",
        "e": f"CASE WHEN {turns} THEN CASE WHEN r.d > 0 THEN x.l ELSE x.h END WHEN {better} THEN CASE WHEN r.d > 0 THEN x.h ELSE x.l "
        f"END ELSE r.e END",
        "a": f"CASE WHEN {turns} THEN 0.02 WHEN {better} THEN least(0.2::DOUBLE, r.a + 0.02::DOUBLE) ELSE r.a END",
    }
    ch.fold("x.i = 1", {"s": "x.l", "d": "1", "e": "x.h", "a": "0.02"}, step, {"ps": "r.s", "pd": "r.d"})
    f["psar"] = ch, {"psar": "ps", "psar_direction": "pd"}, {"psar_flip_up": f"pd = 1 AND {_lag('pd')} = -1",
        "psar_flip_down": f"pd = -1 AND {_lag('pd')} = 1"}

    ch = Chain().add(d=f"c - {_lag('c')}").add(u="CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END",
        w="CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END")
    rsi = (2, 6, 9, 14, 21)
    ch.seeded(**{f"{x}{n}": (x, n, 1 / n) for n in rsi for x in "uw"})
    index = lambda n: f"CASE WHEN u{n} IS NULL THEN NULL WHEN w{n} = 0 THEN CASE WHEN u{n} = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + u{n} / w{n}) END"
    f["rsi"] = ch, {f"rsi_{n}": index(n) for n in rsi}, {"rsi14_le_30": f"({index(14)}) <= 30", "rsi14_ge_70": f"({index(14)}) >= 70"}
    ch = Chain().add(d=f"c - {_lag('c')}").add(u="CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END",
        w="CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END")
    ch.seeded(u14=("u", 14, 1 / 14),
        w14=("w", 14, 1 / 14)).add(q=index(14)).add(s=f"100 * {_pos('q', 'q', 'q', 14)}").add(k=_g("avg", "s", 3))
    f["stoch_rsi"] = ch, {"stoch_rsi_raw": "s", "stoch_rsi_k": "k", "stoch_rsi_d": _g("avg", "k", 3)}, {}
    ch = Chain().add(d=f"c - {_lag('c')}").add(a="abs(d)").seeded(d1=("d", 25, 2 / 26),
        a1=("a", 25, 2 / 26)).seeded(d2=("d1", 13, 2 / 14), a2=("a1", 13, 2 / 14))
    f["tsi"] = ch, {"tsi": _d("100 * d2", "a2")}, {}
    ch = Chain().seeded(e1=("c", 15, 2 / 16)).seeded(e2=("e1", 15, 2 / 16)).seeded(e3=("e2", 15, 2 / 16))
    f["trix"] = ch, {"trix_15": f"{_d('e3', _lag('e3'))} - 1"}, {}
    ch = Chain().add(hi=_g("max", "h", 10),
        lo=_g("min", "l", 10)).add(y="0.66::DOUBLE * (((h + l) / 2 - lo) / nullif(hi - lo, 0) - 0.5::DOUBLE)")
    value = "least(0.999::DOUBLE, greatest(-0.999::DOUBLE, x.y + 0.67::DOUBLE * r.v))"
    step = {"v": f"CASE WHEN x.y IS NULL THEN r.v ELSE {value} END",
        "f": f"CASE WHEN x.y IS NULL THEN r.f ELSE 0.5::DOUBLE * ln((1 + {value}) / (1 - {value})) + 0.5::DOUBLE * r.f END"}
    ch.fold("x.i = 1", {"v": "0", "f": "0"}, step, {"fi": "CASE WHEN x.y IS NOT NULL THEN r.f END"})
    f["fisher"] = ch, {"fisher_10": "fi", "fisher_10_signal": _lag("fi")}, {}

    ch = Chain().add(tr=TR).seeded(**{f"a{n}": ("tr", n, 1 / n) for n in (5, 14, 20)})
    f["atr"] = ch, {"true_range": "tr"} | {f"atr_{n}": f"a{n}" for n in (5, 14, 20)} | {f"natr_{n}": _d(f"100 * a{n}", "c")
        for n in (14, 20)}, {}
    f["chaikin_vol"] = Chain().add(hl="h - l").ewm(e=("hl", 10)), {"chaikin_volatility_10": f"{_d('e', _lag('e', 10))} - 1"}, {}
    ch = Chain().add(tr=TR).seeded(a=("tr", 10, 0.1)).ewm(m=("c", 20)).add(up="m + 2 * a", lo="m - 2 * a")
    f["keltner"] = ch, {"kc_mid": "m", "kc_upper": "up", "kc_lower": "lo", "kc_width": _d("up - lo", "m"),
        "kc_position": _d("c - lo", "up - lo")}, {"kc_breakout_up": "c > up", "kc_breakout_down": "c < lo"}
    ch = Chain().add(tr=TR).seeded(a=("tr", 10, 0.1)).ewm(m=("c", 20)).add(bm=_g("avg", "c", 20),
        sd=_g("stddev_samp", "c", 20)).add(sq="bm + 2 * sd < m + 2 * a AND bm - 2 * sd > m - 2 * a")
    f["squeeze"] = ch, {}, {"squeeze_on": "sq", "squeeze_off": "NOT sq", "squeeze_release": f"NOT sq AND coalesce({_lag('sq')}, false)"}
    ch = Chain().add(s=f"coalesce({_d('(c - l) - (h - c)', 'h - l')} * v, 0)").add(ad=f"sum(s) OVER ({W} ROWS UNBOUNDED "
        f"PRECEDING)").ewm(e3=("ad", 3), e10=("ad", 10))
    f["chaikin_osc"] = ch, {"chaikin_oscillator": "e3 - e10"}, {}
    f["force_index"] = Chain().add(fo=f"(c - {_lag('c')}) * v").ewm(e=("fo", 13)), {"force_index_13": "e"}, {}
    ch = Chain().add(g=f"coalesce({_d('c', _lag('c'))}, 1)", pv=_lag("v"))
    ch.fold("x.i = 1", {"n": "1000", "p": "1000"},
        {"n": "CASE WHEN x.v < x.pv THEN r.n * x.g ELSE r.n END", "p": "CASE WHEN x.v > x.pv THEN r.p * x.g ELSE r.p END"},
            {"nv": "r.n", "pvi_": "r.p"})
    f["nvi_pvi"] = ch, {"nvi": "nv", "pvi": "pvi_"}, {}
    return f


def _families() -> dict[str, Family]:
    return _windows() | _recursive()


def table(name: str) -> str:
    """A family's values as a select over the bars' tables, not rounded."""
    chain, doubles, flags = _families()[name]
    values = ", ".join(f"{e} AS {c}" for c, e in (doubles | flags).items())
    return f"WITH {', '.join([BASE, *chain.ctes])} SELECT security_id, date, {values} FROM {chain.at}"


def sql(bars: str) -> dict[str, str]:
    """The SQL of each family, given that of the bars."""
    out = {}
    for name, (_, doubles, flags) in _families().items():
        shown = ", ".join([*(f"{_round(c, digits(name))} AS {c}" for c in doubles), *flags])
        out[name] = f"WITH {bars}, made AS ({table(name)}) SELECT security_id, date, {shown} FROM made"
    return out
