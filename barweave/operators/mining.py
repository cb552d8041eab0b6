"""Rule mining: boolean states, their activations, outcome statistics of states and pairs, and frozen evaluation.

A state is a named boolean expression; a pattern is one state or two joined by " AND ". All
patterns of a window are scored at once, by state from rows packed to bits (``pattern_counts``);
by entry each row becomes the list of its true states, from which the patterns that hold are
made, exploded and grouped by pattern and date, then by pattern. Cutoffs, winsor bounds and the choice of patterns are frozen on the window
they are learnt from; what reaches the driver is a row a pattern.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.windows import average_rank, column_quantiles, div, finite, nearest_quantiles, series
from . import fold_counts, pattern_counts
from .research import clipped, long, newey_west, price_bucket_floor, vix_terciles, with_regimes

AND = " AND "


@dataclass(frozen=True)
class State:
    """A named state: its family, its source (states of one source and first word don't pair), the column it reads, and a test of it."""

    name: str
    family: str
    source: str
    column: str
    op: str = "true"
    value: float = 0.0

    def expression(self, columns: set[str]) -> Column:
        """Null and missing inputs count as false."""
        if self.column not in columns:
            return F.lit(False)
        x = F.col(self.column)
        tests = {
            "true": lambda: x.cast("boolean"), "le": lambda: x <= self.value, "ge": lambda: x >= self.value,
            "gt": lambda: x > self.value, "lt": lambda: x < self.value, "eq": lambda: x == self.value,
        }
        return F.coalesce(tests[self.op](), F.lit(False))

    @property
    def kin(self) -> str:
        """States of the same kin are variants of one thing."""
        return f"{self.source}|{self.name.split('_')[0]}"


# Names, families, sources and tests of the states, in the order in which pairs are named.
STATES: tuple[State, ...] = (
    State("rsi14_le_30", "MOMENTUM", "rsi", "rsi_14", "le", 30),
    State("rsi14_ge_70", "MOMENTUM", "rsi", "rsi_14", "ge", 70),
    State("price_above_sma20", "TREND", "sma", "close_above_sma20"),
    State("price_above_sma50", "TREND", "sma", "close_above_sma50"),
    State("price_above_sma200", "TREND", "sma", "close_above_sma200"),
    State("sma20_gt_sma50", "TREND", "sma", "sma20_above_sma50"),
    State("sma50_gt_sma200", "TREND", "sma", "sma50_above_sma200"),
    State("golden_cross", "TREND", "sma", "golden_cross_50_200"),
    State("death_cross", "TREND", "sma", "death_cross_50_200"),
    State("macd_positive", "TREND", "macd", "macd", "gt", 0),
    State("macd_cross_up", "TREND", "macd", "macd_cross_signal_up"),
    State("adx_gt_25", "TREND", "adx", "adx14_gt_25"),
    State("stochastic_oversold", "MOMENTUM", "stoch", "stoch_oversold"),
    State("stochastic_overbought", "MOMENTUM", "stoch", "stoch_overbought"),
    State("bb_below_lower", "BAND_CHANNEL", "bb", "close_below_bb_lower"),
    State("bb_above_upper", "BAND_CHANNEL", "bb", "close_above_bb_upper"),
    State("bb_reentry_lower", "BAND_CHANNEL", "bb", "reentry_from_lower"),
    State("bollinger_squeeze", "BAND_CHANNEL", "squeeze", "squeeze_on"),
    State("squeeze_release", "BAND_CHANNEL", "squeeze", "squeeze_release"),
    State("price_above_cloud", "ICHIMOKU", "ichimoku", "price_above_cloud"),
    State("price_below_cloud", "ICHIMOKU", "ichimoku", "price_below_cloud"),
    State("tk_cross_up", "ICHIMOKU", "ichimoku", "tenkan_cross_kijun_up"),
    State("tk_cross_down", "ICHIMOKU", "ichimoku", "tenkan_cross_kijun_down"),
    State("supertrend_up", "TREND", "supertrend", "supertrend_10_3_dir", "eq", 1),
    State("supertrend_flip_up", "TREND", "supertrend", "supertrend_flip_up"),
    State("donchian_20_breakout", "BREAKOUT", "donchian", "donchian_20_breakout_up"),
    State("volume_ratio20_gt_1_5", "VOLUME", "volume", "volume_ratio_20", "gt", 1.5),
    State("volume_ratio20_gt_2", "VOLUME", "volume", "volume_ratio_20", "gt", 2),
    State("new_high_252", "BREAKOUT", "sr", "new_high_252"),
    State("new_low_252", "BREAKOUT", "sr", "new_low_252"),
    State("hammer", "CANDLE", "candle", "hammer"),
    State("bullish_engulfing", "CANDLE", "candle", "bullish_engulfing"),
    State("bearish_engulfing", "CANDLE", "candle", "bearish_engulfing"),
)
#: States of the daily features, each taken only where the state it stands for isn't there.
ALIASES: tuple[tuple[State, str], ...] = (
    (State("feat_rsi14_le_30", "MOMENTUM", "feature", "rsi_14", "le", 30), "rsi14_le_30"),
    (State("feat_volume_ratio20_gt_1_5", "VOLUME", "feature", "volume_ratio_20d", "gt", 1.5), "volume_ratio20_gt_1_5"),
    (State("feat_close_above_ma200", "TREND", "feature", "ma_200_distance", "gt", 0), "price_above_sma200"),
    (State("feat_close_above_ma50", "TREND", "feature", "ma_50_distance", "gt", 0), "price_above_sma50"),
    (State("feat_close_above_ma20", "TREND", "feature", "ma_20_distance", "gt", 0), "price_above_sma20"),
)
#: Columns that get quantile states, their families, and the column each stands for (itself where none).
QUANTILE_SOURCES: tuple[tuple[str, str, str | None], ...] = (
    ("hist_vol_20", "VOLATILITY", None),
    ("volatility_20d", "VOLATILITY", "hist_vol_20"),
    ("dist_high_252", "BREAKOUT", None),
    ("distance_high_252d", "BREAKOUT", "dist_high_252"),
    ("volume_ratio_20", "VOLUME", None),
    ("volume_ratio_20d", "VOLUME", "volume_ratio_20"),
    ("natr_14", "VOLATILITY", None),
    ("atr_pct_14", "VOLATILITY", "natr_14"),
    ("adx_14", "TREND", None),
)
QUANTILES = (0.2, 0.4, 0.6, 0.8)
MIN_QUANTILE_ROWS = 100
#: Patterns that are followed through all folds.
TRACKED = ("rsi14_ge_70", "rsi14_ge_70 AND volume_ratio20_gt_2", "adx_gt_25 AND bb_above_upper",
    "donchian_20_breakout AND volume_ratio20_gt_2")
#: Days from this one on are never evaluated.
HOLDOUT_START = "2026-09-21"
#: The expanding folds (name, learnt from, to, evaluated from, to; the last one is open).
FOLDS: tuple[tuple[str, str, str, str, str | None], ...] = (
    ("fold1_eval_2021", "2018-01-02", "2020-12-31", "2021-01-04", "2021-12-31"),
    ("fold2_eval_2022", "2018-01-02", "2021-12-31", "2022-01-03", "2022-12-30"),
    ("fold3_eval_2023", "2018-01-02", "2022-12-30", "2023-01-03", "2023-12-29"),
    ("fold4_eval_2024", "2018-01-02", "2023-12-29", "2024-01-02", "2024-12-31"),
    ("fold5_eval_2025", "2018-01-02", "2024-12-31", "2025-01-02", "2025-12-31"),
    ("fold6_eval_2026", "2018-01-02", "2025-12-31", "2026-01-02", None),
)
#: The indicator families whose outputs the states and quantiles read.
FAMILIES = (
    "sma", "macd", "adx", "supertrend", "rsi", "stochastic", "bollinger", "squeeze", "donchian", "hist_vol", "atr",
    "volume_sma", "ichimoku", "support_resistance", "candlestick_patterns",
)
NEAR_DUPLICATE = "near-duplicate of a feature alias; interpret once"


@dataclass(frozen=True)
class Support:
    """Least rows, dates and securities of a pattern, and the rate of false discoveries."""

    rows: int = 1000
    dates: int = 100
    securities: int = 30
    fdr: float = 0.10


Frozen = dict[str, dict[str, float]]
Bounds = tuple[float, float] | None


def horizon_of(target: str) -> int:
    """The sessions ahead that a target's name ends with; 20 without one."""
    last = target.rsplit("_", 1)[-1]
    return int(last[:-1]) if last.endswith("d") and last[:-1].isdigit() else 20


def excess_of(target: str) -> str:
    """The excess outcome that goes with a target."""
    return target if target.startswith("forward_excess") else target.replace("forward_return_", "forward_excess_spy_")


def window(df: DataFrame, start: str, end: str | None) -> DataFrame:
    df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col("date") <= F.lit(end).cast("date"))


def before_holdout(end: str | None) -> str:
    """An end that doesn't reach the days that are held out for good."""
    last = str(_day(HOLDOUT_START, -1))
    return last if end is None else min(end, last)


def _day(text: str, days: int = 0):
    from datetime import date, timedelta

    return date.fromisoformat(text) + timedelta(days=days)


# ---- frames and states


def frame(panel: DataFrame, indicators: DataFrame) -> DataFrame:
    """The mining frame: a panel of features and outcomes with indicators; of columns that both have, the panel's stay."""
    extra = [c for c in indicators.columns if c not in panel.columns]
    return panel.join(indicators.select("security_id", "date", *extra), ["security_id", "date"], "left")


def latest_mature(df: DataFrame, target: str) -> str | None:
    """The last date with a known target."""
    if target not in df.columns:
        return None
    found = df.filter(F.col(target).isNotNull()).agg(F.max("date")).first()[0]
    return None if found is None else str(found)


def base_states(columns: set[str]) -> list[State]:
    """States whose columns are there, or whose own flags are by name, and aliases of those that aren't."""
    out = [s if s.column in columns else replace(s, column=s.name, op="true") for s in STATES if {s.column, s.name} & columns]
    have = {s.name for s in out}
    return out + [s for s, preferred in ALIASES if preferred not in have and s.column in columns]


def freeze(df: DataFrame) -> Frozen:
    """Quantiles of the quantile sources that are there with enough values; a stand-in only without the column it stands for."""
    there = [c for c, _, _ in QUANTILE_SOURCES if c in df.columns]
    if not there:
        return {}
    found = column_quantiles(df, there, list(QUANTILES))
    return _preferred({c: {f"q{round(q * 100)}": v for q, v in zip(QUANTILES, values)} for c, (n, values) in found.items()
        if n >= MIN_QUANTILE_ROWS})


def _preferred(rows: Frozen) -> Frozen:
    """Without stand-ins of columns that are there."""
    out: Frozen = {}
    for c, _, preferred in QUANTILE_SOURCES:
        if c in rows and preferred not in out:
            out[c] = rows[c]
    return out


def freeze_folds(df: DataFrame, parts: list[dict[str, str]]) -> list[Frozen]:
    """``freeze`` on each fold's discover window, all in one pass; only the cutoffs that states have."""
    there = [c for c, _, _ in QUANTILE_SOURCES if c in df.columns]
    if not there or not parts:
        return [{} for _ in parts]
    spans = [fold_counts.Span(_day(f["start"]), _day(f["end"])) for f in parts]
    found = fold_counts.quantiles(df, there, spans, [0.2, 0.8])
    return [_preferred({c: dict(zip(("q20", "q80"), values)) for c, (n, values) in of.items() if n >= MIN_QUANTILE_ROWS}) for of in found]


def quantile_states(frozen: Frozen) -> list[State]:
    """analysis_q_{column}_le_q20 and _ge_q80 of the frozen columns."""
    family = {c: f for c, f, _ in QUANTILE_SOURCES}
    out = []
    for c, cuts in frozen.items():
        out += [State(f"analysis_q_{c}_le_q20", family[c], "analysis_quantile", c, "le", cuts["q20"])]
        out += [State(f"analysis_q_{c}_ge_q80", family[c], "analysis_quantile", c, "ge", cuts["q80"])]
    return out


def states_of(columns: list[str], frozen: Frozen) -> list[State]:
    return base_states(set(columns)) + quantile_states({c: q for c, q in frozen.items() if c in columns})


def bounds_of(df: DataFrame, target: str) -> Bounds:
    """1 and 99 % of a target."""
    n, found = column_quantiles(df, [target], [0.01, 0.99])[target]
    return (found[0], found[1]) if n else None


def daily_quantile_flags(df: DataFrame, c: str) -> DataFrame:
    """cs_q_{c}_le_q20 and cs_q_{c}_ge_q80 by the day's own ranks; unlike the frozen ones."""
    n = F.count(F.col(c)).over(Window.partitionBy("date"))
    place = div(average_rank(c, ["date"]) - 1, n)
    return df.withColumns({f"cs_q_{c}_le_q20": place <= 0.2, f"cs_q_{c}_ge_q80": place >= 0.8})


def apply_states(df: DataFrame, states: list[State]) -> DataFrame:
    """``df`` with a column a state; a column of that name is replaced."""
    columns = set(df.columns)
    return df.withColumns({s.name: s.expression(columns) for s in states}) if states else df


def family_of(pattern: str, states: list[State]) -> str:
    """The family of a pattern's states, MIXED where they differ."""
    known = {s.name: s.family for s in states}
    found = {known.get(n, "MIXED") for n in pattern.split(AND)}
    return found.pop() if len(found) == 1 else "MIXED"


# ---- activations of one pattern


def conjunction(pattern: str, columns: list[str]) -> Column:
    """A pattern's flag: null counts as false, and a name that isn't there makes it false."""
    return reduce(lambda a, b: a & b,
        (F.coalesce(F.col(n), F.lit(False)) if n in columns else F.lit(False) for n in pattern.split(AND)))


def with_entries(df: DataFrame, flag: str) -> DataFrame:
    """__entry.

    The flag's first row of a run; __episode: the run's number. Filter to the window first, so that its first row can
    enter.
    """
    on = F.coalesce(F.col(flag), F.lit(False))
    marked = df.withColumn("__entry", on & ~F.coalesce(F.lag(on).over(series()), F.lit(False)))
    runs = F.sum(F.col("__entry").cast("int")).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__episode", F.when(on, runs))


def with_cooldown(df: DataFrame, flag: str, wait: int) -> DataFrame:
    """__kept: entries that come more than ``wait`` rows after the last kept one; stateful, so by grouped map."""
    d = with_entries(df, flag).withColumn("__on", F.col("__entry").cast("double"))
    d = kernels.per_security(d, lambda s: {"__keep": kernels.cooldown(s["__on"], wait)}, ["__on"], ["__keep"])
    return d.withColumn("__kept", F.col("__keep") == 1).drop("__on", "__keep")


def activate(df: DataFrame, pattern: str, mode: str = "state", wait: int = 0) -> DataFrame:
    """Rows where the pattern is active, by state (any true row) or by entry with cooldown."""
    df = df.withColumn("__flag", conjunction(pattern, df.columns))
    if mode == "state":
        return df.filter("__flag").drop("__flag")
    made = with_cooldown(df, "__flag", wait) if wait else with_entries(df, "__flag").withColumn("__kept", F.col("__entry"))
    return made.filter("__kept").drop("__flag", "__entry", "__episode", "__kept")


def frequency(df: DataFrame, pattern: str, wait: int = 20) -> DataFrame:
    """(flag_rows, entries, kept, episodes, n_dates, n_securities) of a pattern."""
    d = with_cooldown(df.withColumn("__flag", conjunction(pattern, df.columns)), "__flag", wait)
    on = F.col("__flag")
    return d.agg(
        F.count_if(on).alias("flag_rows"), F.count_if("__entry").alias("entries"), F.count_if("__kept").alias("kept"),
        F.countDistinct(F.when(on, F.struct("security_id", "__episode"))).alias("episodes"),
        F.countDistinct(F.when(on, F.col("date"))).alias("n_dates"), F.countDistinct(F.when(on, F.col("security_id")))
            .alias("n_securities"),
    )


# ---- scores of many patterns at once


def pruned(a: State, b: State) -> bool:
    """Pairs that aren't tried: of aliases, and of variants of one thing."""
    return "feature" in (a.source, b.source) or a.kin == b.kin


def pairs_of(states: list[State]) -> list[tuple[str, str]]:
    """Pairs that are tried, in the states' order."""
    return [(a.name, b.name) for i, a in enumerate(states) for b in states[i + 1 :] if not pruned(a, b)]


def _patterns(states: list[State], columns: set[str], wanted: list[str] | None, pairs: bool) -> Column:
    """The patterns that hold in a row. Pairs are made of its own true states, so a row costs what it has, not all pairs."""
    marked = [F.when(s.expression(columns),
        F.struct(F.lit(s.name).alias("name"), F.lit(s.kin).alias("kin"), F.lit(s.source).alias("source"))) for s in states]
    on = F.filter(F.array(*marked), lambda x: x.isNotNull())
    single = F.transform(on, lambda x: x["name"])
    if not pairs:
        return single if wanted is None else F.array_intersect(single, F.array(*map(F.lit, wanted)))

    def with_later(held: Column) -> Column:
        def of(a: Column, i: Column) -> Column:
            later = F.slice(held, i + 2, F.size(held))
            fits = F.filter(later, lambda b: (b["kin"] != a["kin"]) & (b["source"] != "feature") & (a["source"] != "feature"))
            return F.transform(fits, lambda b: F.concat(a["name"], F.lit(AND), b["name"]))

        return F.flatten(F.transform(held, of))

    both = F.get(F.transform(F.array(on), with_later), F.lit(0))  # the list is made once
    every = F.concat(single, both)
    return every if wanted is None else F.array_intersect(every, F.array(*map(F.lit, wanted)))


def _greedy(places: Column, wait: int) -> Column:
    """Of sorted structs with a place, those that come more than ``wait`` after the last kept one."""
    none = F.slice(places, F.lit(1), F.lit(0))
    fits = lambda kept, x: (F.size(kept) == 0) | (x["at"] > F.element_at(kept, -1)["at"] + wait)
    return F.aggregate(places, none, lambda kept, x: F.when(fits(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def hits(
    df: DataFrame, states: list[State], target: str, excess: str | None = None, wanted: list[str] | None = None,
    pairs: bool = True, mode: str = "state", wait: int = 0, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(pattern, security_id, date, y, x, keep...): the rows that each pattern keeps, outcomes not known yet too.

    ``mode`` entry: the first rows of runs; with ``wait``, only entries more than so many rows
    after the last kept one, by a fold over each security's entries of a pattern.
    """
    made = _patterns(states, set(df.columns), wanted, pairs)
    y, x = F.col(target).alias("y"), F.col(excess if excess and excess in df.columns else target).alias("x")
    rows = df.select("security_id", "date", y, x, *keep, made.alias("on"))
    if mode == "entry":
        rows = rows.withColumn("was", F.lag("on").over(series())).withColumn("at", F.row_number().over(series()))
        rows = rows.withColumn("on", F.when(F.col("was").isNull(), F.col("on")).otherwise(F.array_except("on", "was"))).drop("was")
    out = rows.withColumn("pattern", F.explode("on")).drop("on")
    if mode == "entry" and wait:
        held = out.groupBy("pattern", "security_id").agg(F.array_sort(F.collect_list(F.struct("at", "date", "y", "x", *keep)))
            .alias("all"))
        out = held.select("pattern", "security_id", F.explode(_greedy(F.col("all"), wait))
            .alias("h")).select("pattern", "security_id", "h.*")
    return out.select("pattern", "security_id", "date", "y", "x", *keep)


def daily_baseline(df: DataFrame, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., date, base): the mean outcome of all rows of a date."""
    return df.filter(F.col(target).isNotNull()).groupBy(*by, "date").agg(F.avg(target).alias("base"))


STATS = (
    "kept", "n", "n_dates", "n_securities", "mean", "median", "winsor_mean", "positive_ratio", "excess_mean", "excess_median",
    "daily_mean", "daily_median", "daily_positive_ratio", "newey_west_t", "vs_baseline_mean", "vs_baseline_nw_t", "vs_baseline_n",
)


def pattern_stats(found: DataFrame, base: DataFrame, lag: int, winsor: Column, by: tuple[str, ...] = (),
    same: bool = False) -> DataFrame:
    """(by..., pattern, STATS...): statistics of each pattern's rows, and of its daily means against the baseline's.

    What is shuffled for the daily series are sums by pattern and date. ``winsor``: the outcome
    y clipped.
    ``same``: the excess x is the outcome y itself, so its statistics are the outcome's.
    """
    keys = [*by, "pattern"]
    known = F.col("y").isNotNull()
    on = lambda c: F.when(known, F.col(c))
    flat = found.groupBy(*keys).agg(
        F.count("*").alias("kept"), F.count("y").alias("n"), F.countDistinct(on("date"))
            .alias("n_dates"), F.countDistinct(on("security_id")).alias("n_securities"),
        F.avg("y").alias("mean"), F.median("y").alias("median"), F.avg(F.when(known, winsor)).alias("winsor_mean"),
        F.avg((F.col("y") > 0).cast("double")).alias("positive_ratio"),
        *([] if same else [F.avg(on("x")).alias("excess_mean"), F.median(on("x")).alias("excess_median")]),
    )
    if same:
        flat = flat.withColumns({"excess_mean": F.col("mean"), "excess_median": F.col("median")})
    daily = found.filter(known).groupBy(*keys, "date").agg(F.avg("y").alias("day"))
    daily = daily.join(F.broadcast(base), [*by, "date"], "left").withColumn("diff", F.col("day") - F.col("base"))
    days = daily.groupBy(*keys).agg(F.median("day").alias("daily_median"), F.avg((F.col("day") > 0).cast("double"))
        .alias("daily_positive_ratio"))
    own = newey_west(daily, "day", lag, keys).select(*keys, F.col("mean").alias("daily_mean"), F.col("nw_t").alias("newey_west_t"))
    other = newey_west(daily.filter(F.col("diff").isNotNull()), "diff", lag, keys)
    other = other.select(*keys, F.col("mean").alias("vs_baseline_mean"), F.col("nw_t").alias("vs_baseline_nw_t"), F.col("n")
        .alias("vs_baseline_n"))
    out = flat.join(days, keys, "left").join(own, keys, "left").join(other, keys, "left")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) if c == "vs_baseline_n" else F.col(c) for c in STATS))


def score(
    df: DataFrame, states: list[State], target: str, excess: str | None = None, bounds: Bounds = None, lag: int | None = None,
    wanted: list[str] | None = None, pairs: bool = True, mode: str = "state", wait: int = 0,
) -> DataFrame:
    """(pattern, STATS...) of the states and, unless told otherwise, their pairs, all of them at once.

    By state, rows are packed and read several times, so ``df`` should be held; what comes back are a row a pattern.
    """
    if mode == "state":
        return _scored(df, states, target, excess, bounds, horizon_of(target) if lag is None else lag, wanted, pairs)
    found = hits(df, states, target, excess, wanted, pairs, mode, wait)
    return pattern_stats(found, daily_baseline(df, target), horizon_of(target) if lag is None else lag, clipped("y", bounds),
        same=excess in (None, target) or excess not in df.columns)


def _scored(df: DataFrame, states: list[State], target: str, excess: str | None, bounds: Bounds, lag: int, wanted: list[str] | None,
    pairs: bool) -> DataFrame:
    place = {s.name: i for i, s in enumerate(states)}
    patterns = [(n, i, i) for n, i in place.items()]
    patterns += [(a + AND + b, place[a], place[b]) for a, b in pairs_of(states)] if pairs else []
    asked = None if wanted is None else set(wanted)
    patterns = [p for p in patterns if asked is None or p[0] in asked]
    schema = ", ".join(["pattern string", *(f"{c} {'long' if c in _LONGS else 'double'}" for c in STATS)])
    if not patterns:
        return df.sparkSession.createDataFrame([], schema)
    other = excess is not None and excess != target and excess in df.columns
    columns = set(df.columns)
    rows = pattern_counts.packed(df, [s.expression(columns) for s in states], finite(F.col(target).cast("double")),
        finite(F.col(excess).cast("double")) if other else None)
    products = pattern_counts.Products(patterns, len(states))
    met = {r["p"]: r["n_securities"] for r in pattern_counts.securities(rows, products).collect()}  # a row a pattern each
    found = [r.asDict() for r in pattern_counts.about(pattern_counts.daily(rows, products, bounds), lag).collect()]
    median = pattern_counts.medians(rows, products, "y")
    of_excess = pattern_counts.medians(rows, products, "x") if other else median
    out = []
    for r in found:
        p = r["p"]
        r |= {"n_securities": met.get(p, 0), "median": median.get(p), "excess_median": of_excess.get(p)}
        out.append((patterns[p][0], *(r[c] for c in STATS)))
    return df.sparkSession.createDataFrame(out, schema)


def supported(stats: DataFrame, support: Support) -> DataFrame:
    return (stats.filter((F.col("kept") >= support.rows) & (F.col("n_dates") >= support.dates) & (F.col("n_securities") >= support.securities)))


def normal_p(t: float | None, df: int | None = None) -> float | None:
    """Two-sided normal p; null under two degrees of freedom."""
    return None if t is None or (df is not None and df < 2) else math.erfc(abs(t) / math.sqrt(2))


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """q: the running least of p * m / rank from the largest p down; null p stay out."""
    m = F.count(F.col(p)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last(), "pattern"))
    d = df.withColumn("__r", rank).withColumn("__x", F.when(F.col(p).isNotNull(), F.least(F.col(p) * m / F.col("__r"), F.lit(1.0))))
    later = Window.orderBy("__r").rowsBetween(0, Window.unboundedFollowing)
    return d.withColumn("q", F.when(F.col(p).isNotNull(), F.min("__x").over(later))).drop("__r", "__x")


def _q_values(ps: dict[str, float | None]) -> dict[str, float | None]:
    """The same for the driver's rows."""
    known = sorted((p, n) for n, p in ps.items() if p is not None)
    out: dict[str, float | None] = dict.fromkeys(ps)
    least = 1.0
    for i in range(len(known), 0, -1):
        p, name = known[i - 1]
        least = min(least, p * len(known) / i)
        out[name] = least
    return out


def direction(row: Row | dict) -> int:
    """The sign of the median excess, or of the median without one."""
    value = row["excess_median"] if row["excess_median"] is not None else row["median"]
    return 0 if value is None else (value > 0) - (value < 0)


@dataclass
class Discovery:
    """What a window taught: states, frozen cutoffs, winsor bounds, and a row a scored pattern."""

    states: list[State]
    frozen: Frozen
    bounds: Bounds
    rows: list[dict]
    singles: list[str]
    passed: list[str]
    tried: list[str]

    @property
    def selected(self) -> list[str]:
        return [r["pattern"] for r in self.rows if r["selected"]]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.get(c) for c, _ in _ROW) for r in self.rows], ", ".join(f"{c} {t}" for c, t in _ROW))


_LONGS = ("kept", "n", "n_dates", "n_securities", "vs_baseline_n")
_ROW = [
    ("pattern", "string"), ("family", "string"), ("rule_size", "int"), ("sample_status", "string"),
        *((c, "long" if c in _LONGS else "double") for c in STATS),
    ("p", "double"), ("q", "double"), ("selected", "boolean"), ("direction", "int"), ("overlap_flag", "string"),
        ("duplicate_warning", "string"),
]


def _overlap_flag(both: int, n_a: int, n_b: int) -> str | None:
    """HIGH_OVERLAP where one state nearly implies the other, or the pair nearly is one of them."""
    either = n_a + n_b - both
    shares = [both / n > 0.95 for n in (n_a, n_b) if n] + [either > 0 and both / either > 0.9] + [both / n > 0.9 for n in (n_a, n_b)
        if n]
    return "HIGH_OVERLAP" if any(shares) else None


def discover(
    df: DataFrame, target: str, start: str, end: str, support: Support = Support(), size: int = 2, mode: str = "state", wait: int = 0,
    states: list[State] | None = None,
) -> Discovery:
    """Patterns of a window: states with enough support, pairs of those, p against the daily baseline, q over all that are supported.

    States that lack support are listed as such; pairs that lack it are not. ``states``: other
    states than those of the frame's columns and frozen quantiles.
    """
    dev = window(df, start, end)
    frozen = freeze(dev) if states is None else {}
    states = states_of(df.columns, frozen) if states is None else states
    bounds, excess = bounds_of(dev, target), excess_of(target)
    single = {r["pattern"]: r.asDict() for r in score(dev, states, target, excess, bounds, pairs=False, mode=mode, wait=wait).collect()}
    passed = [s for s in states if s.name in single and _fits(single[s.name], support)]
    tried = [AND.join(p) for p in pairs_of(passed)] if size > 1 else []
    pair: dict[str, dict] = {}
    if tried:
        found = supported(score(dev, passed, target, excess, bounds, wanted=tried, mode=mode, wait=wait), support)
        pair = {r["pattern"]: r.asDict() for r in found.collect()}  # a row a pattern
    empty = dict.fromkeys(STATS) | dict.fromkeys(_LONGS, 0)
    rows = [{"pattern": s.name} | empty | single.get(s.name, {}) | {"rule_size": 1, "overlap_flag": None} for s in states]
    counts = _flag_counts(dev, passed, list(pair)) if mode == "entry" and pair else {n: r["kept"] for n, r in (single | pair).items()}
    for p in tried:
        if p in pair:
            a, b = p.split(AND)
            rows.append(pair[p] | {"rule_size": 2, "overlap_flag": _overlap_flag(counts.get(p, 0), counts.get(a, 0), counts.get(b, 0))})
    for r in rows:
        r["direction"] = direction(r)
    return _judged(Discovery(states, frozen, bounds, rows, [s.name for s in states], [s.name for s in passed], tried), support)


def _judged(found: Discovery, support: Support) -> Discovery:
    """Its rows with p, q and whether each is selected."""
    rows, states, ps = found.rows, found.states, {}
    for r in rows:
        r["family"] = family_of(r["pattern"], states)
        r["sample_status"] = "ok" if _fits(r, support) else "INSUFFICIENT_SAMPLE"
        against = r["vs_baseline_nw_t"] is not None
        t, n = (r["vs_baseline_nw_t"], r["vs_baseline_n"]) if against else (r["newey_west_t"], r["n_dates"])
        r["p"] = normal_p(t, max(n - 1, 1))
        if r["sample_status"] == "ok":
            ps[r["pattern"]] = r["p"]
    qs = _q_values(ps)
    twice = {n for s, preferred in ALIASES for n in (s.name, preferred) if {s.name, preferred} <= {x.name for x in states}}
    for r in rows:
        r["q"] = qs.get(r["pattern"])
        r["selected"] = r["q"] is not None and r["q"] <= support.fdr
        doubled = NEAR_DUPLICATE if twice & set(r["pattern"].split(AND)) else None
        r["duplicate_warning"] = r["overlap_flag"] or doubled
    return found


def _fits(row: dict, support: Support) -> bool:
    return row["kept"] >= support.rows and row["n_dates"] >= support.dates and row["n_securities"] >= support.securities


def _flag_counts(df: DataFrame, states: list[State], pairs: list[str]) -> dict[str, int]:
    """Rows of each state and pair, whatever the outcome."""
    made = _patterns(states, set(df.columns), [s.name for s in states] + pairs, True)
    return {r["p"]: r["count"] for r in df.select(F.explode(made).alias("p")).groupBy("p").count().collect()}


def evaluate(df: DataFrame, found: Discovery, target: str, start: str, end: str | None = None, mode: str = "state",
    wait: int = 0) -> DataFrame:
    """Selected patterns on a later window, nothing refitted: (pattern, STATS..., found_effect, same_direction, effect_ratio).

    The window never reaches the days held out for good.
    """
    spark = df.sparkSession
    later = window(df, start, before_holdout(end))
    chosen = [r for r in found.rows if r["selected"]]
    effects = [(r["pattern"], r["direction"], r["excess_median"] or r["median"], r["q"]) for r in chosen]
    table = spark.createDataFrame(effects, "pattern string, direction int, found_effect double, q double")
    if not chosen:
        stats = score(later.limit(0), found.states, target, excess_of(target), found.bounds, wanted=[""], pairs=False)
    else:
        stats = score(later, found.states, target, excess_of(target), found.bounds, wanted=found.selected, mode=mode, wait=wait)
    both = table.join(stats, "pattern", "left")
    effect = F.when(F.coalesce("excess_median", F.lit(0.0)) != 0, F.col("excess_median")).otherwise(F.col("median"))
    sign = F.signum(F.coalesce("excess_median", "median"))
    same = F.coalesce((F.col("direction") != 0) & (sign == F.col("direction")), F.lit(False))
    ratio = F.when(F.abs("found_effect") > 1e-12, effect / F.col("found_effect"))
    return both.withColumns({"same_direction": same, "effect_ratio": ratio}).drop("direction")


def ranked(evaluated: DataFrame, found: Discovery) -> DataFrame:
    """Evaluated patterns, the best first: by q, then the size of the t against the baseline, then the rows kept."""
    t = {r["pattern"]: (abs(r["vs_baseline_nw_t"] or 0.0), r["kept"] or r["n"] or 0) for r in found.rows}
    rows = [(p, *v) for p, v in t.items()]
    table = evaluated.sparkSession.createDataFrame(rows, "pattern string, found_t double, found_kept long")
    order = [F.col("q").asc_nulls_last(), F.col("found_t").desc(), F.col("found_kept").desc(), "pattern"]
    placed = evaluated.join(table, "pattern").withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return placed.orderBy("place")


def reasons(found: Discovery, patterns: list[str]) -> dict[str, str]:
    """Why each pattern is in or out: SELECTED, FDR_FAIL, INSUFFICIENT_SUPPORT, PAIR_PRUNED or NOT_GENERATED.

    A pair is looked for in either order.
    """
    rows = {r["pattern"]: r for r in found.rows}
    known = {s.name: s for s in found.states}
    out = {}
    for p in patterns:
        parts = p.split(AND)
        names = {p, AND.join(reversed(parts))}
        row = next((rows[n] for n in names if n in rows), None)
        if row is not None:
            out[p] = "SELECTED" if row["selected"] else "FDR_FAIL" if row["sample_status"] == "ok" else "INSUFFICIENT_SUPPORT"
        elif names & set(found.tried):
            out[p] = "INSUFFICIENT_SUPPORT"
        elif len(parts) == 2 and set(parts) <= set(found.passed) and pruned(known[parts[0]], known[parts[1]]):
            out[p] = "PAIR_PRUNED"
        else:
            out[p] = "NOT_GENERATED"
    return out


def selection_summary(found: Discovery, support: Support = Support()) -> dict[str, float | int | None]:
    """Counts of what was generated, supported, tested and selected, and the smallest p and q."""
    ok = [r for r in found.rows if r["sample_status"] == "ok"]
    ps, qs = [r["p"] for r in ok if r["p"] is not None], [r["q"] for r in ok if r["q"] is not None]
    made = {
        "n_generated_singles": len(found.singles), "n_support_passed_singles": len(found.passed), "n_generated_pairs": len(found.tried),
        "n_support_passed_pairs": sum(r["rule_size"] == 2 for r in found.rows), "n_statistical_tests": len(ps),
        "min_raw_p": min(ps, default=None), "min_fdr_q": min(qs, default=None),
    }
    return made | {f"n_q_le_{t}": sum(q <= t / 100 for q in qs) for t in (10, 20, 30)} | {"selection_threshold": support.fdr}


# ---- folds


def folds(mature: str | None = None, table: tuple[tuple[str, str, str, str, str | None], ...] = FOLDS) -> list[dict[str, str]]:
    """Folds with their last day: an open one ends with the last known outcome; none reaches the days held out for good.

    Folds that would be empty are left out.
    """
    out = []
    for name, start, end, first, last in table:
        last = before_holdout(last or mature)
        if last >= first:
            out.append({"fold": name, "start": start, "end": end, "eval_start": first, "eval_end": last})
    return out


def yearly_folds(ends: list[str], start: str) -> tuple[tuple[str, str, str, str, str | None], ...]:
    """Expanding folds that learn up to each end and evaluate the next calendar year."""
    years = [int(e[:4]) + 1 for e in ends]
    return tuple((f"fold{i}_eval_{y}", start, e, f"{y}-01-01", f"{y}-12-31") for i, (e, y) in enumerate(zip(ends, years), 1))


def _by_fold(values: dict[str, float | None]) -> Column:
    """A constant a fold."""
    return reduce(lambda out, kv: F.when(F.col("fold") == kv[0], F.lit(kv[1])).otherwise(out), values.items(), F.lit(None)
        .cast("double"))


def dealt(df: DataFrame, parts: list[dict[str, str]]) -> DataFrame:
    """Each row once for every fold and role (discover, eval) whose window it is in."""
    inside = lambda a, b: F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    marks = []
    for f in parts:
        for role, a, b in (("discover", f["start"], f["end"]), ("eval", f["eval_start"], f["eval_end"])):
            marks.append(F.when(inside(a, b), F.struct(F.lit(f["fold"]).alias("fold"), F.lit(role).alias("role"))))
    return df.withColumn("__f", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull()))).select("__f.*", *df.columns)


def walk_forward(df: DataFrame, target: str, parts: list[dict[str, str]], tracked: tuple[str, ...] = TRACKED, mode: str = "state",
    wait: int = 0) -> DataFrame:
    """(fold, role, pattern, STATS..., effect, direction) of tracked patterns, all folds in one pass.

    Each fold's quantile cutoffs and winsor bounds are frozen on its own discover window and
    used for both of its windows. A pattern that never holds has no row.
    """
    rows = dealt(df, parts)
    learnt = rows.filter(F.col("role") == "discover")
    there = [c for c, _, _ in QUANTILE_SOURCES if c in df.columns]
    names = [f["fold"] for f in parts]
    limits = {r["fold"]: (r["q0"], r["q1"]) for r in nearest_quantiles(learnt, target, [0.01, 0.99], ["fold"]).collect()}
    cuts: dict[str, Frozen] = {n: {} for n in names}
    if there:
        values = long(learnt, there, "source", "value", ["fold"]).filter(~F.isnan("value"))
        n = values.groupBy("fold", "source").agg(F.count("*").alias("n"))
        found = nearest_quantiles(values, "value", [0.2, 0.8], ["fold", "source"]).join(n,
            ["fold", "source"]).filter(F.col("n") >= MIN_QUANTILE_ROWS)
        got = {(r["fold"], r["source"]): {"q20": r["q0"], "q80": r["q1"]} for r in found.collect()}
        for name in names:
            for c, _, preferred in QUANTILE_SOURCES:
                if (name, c) in got and preferred not in cuts[name]:
                    cuts[name][c] = got[name, c]
    wide = rows
    states = base_states(set(df.columns))
    for c, family, _ in QUANTILE_SOURCES:
        for op, q in (("le", "q20"), ("ge", "q80")):
            values = {n: cuts[n][c][q] for n in names if c in cuts[n]}
            if values:
                state, cut = f"analysis_q_{c}_{op}_{q}", _by_fold(values)
                wide = wide.withColumn(state, F.coalesce(F.col(c) <= cut if op == "le" else F.col(c) >= cut, F.lit(False)))
                states = [*states, State(state, family, "analysis_quantile", state)]
    need = {n for p in tracked for n in p.split(AND)}
    used = [s for s in states if s.name in need]
    # Runs and cooldowns are those of a security inside one fold's window.
    keyed = wide.withColumn("__sid", F.col("security_id")).withColumn("security_id", F.concat_ws("\x1f", "fold", "role", "security_id"))
    found = hits(keyed, used, target, target, list(tracked), True, mode, wait, ("fold", "role", "__sid"))
    found = found.withColumn("security_id", F.col("__sid")).drop("__sid")
    low, high = (_by_fold({n: v[i] for n, v in limits.items()}) for i in (0, 1))
    winsor = F.least(F.greatest(F.col("y"), F.coalesce(low, F.col("y"))), F.coalesce(high, F.col("y")))
    stats = pattern_stats(found, daily_baseline(rows, target, ("fold", "role")), horizon_of(target), winsor, ("fold", "role"), True)
    effect = F.coalesce("excess_median", "median")
    return stats.withColumns({"effect": effect, "direction": F.coalesce(F.signum(effect), F.lit(0.0)).cast("int")})


def stability(walked: DataFrame) -> DataFrame:
    """Per pattern over its folds: signs, how many share the first one's, upper medians of effect and t, extremes."""
    t = F.coalesce("vs_baseline_nw_t", "newey_west_t")
    rows = walked.filter(F.col("role") == "eval").select("pattern", "fold", "effect", "direction", t.alias("t"))
    upper = lambda c: F.get(F.array_sort(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))
    first = F.min_by(F.when(F.col("direction") != 0, F.col("direction")), F.when(F.col("direction") != 0, F.col("fold")))
    out = rows.groupBy("pattern").agg(
        F.count("*").alias("folds_tested"), F.count_if(F.col("direction") > 0).alias("positive_effect_folds"),
        F.count_if(F.col("direction") < 0).alias("negative_effect_folds"), first.alias("first"), upper("effect")
            .alias("median_fold_effect"),
        F.min("effect").alias("min_fold_effect"), F.max("effect").alias("max_fold_effect"), upper("t").alias("median_fold_nw_t"),
    )
    same = F.when(F.col("first") > 0, F.col("positive_effect_folds")).when(F.col("first") < 0,
        F.col("negative_effect_folds")).otherwise(0)
    return out.withColumn("same_direction_folds", same.cast("long")).drop("first")


def walk_forward_full(df: DataFrame, target: str, parts: list[dict[str, str]], support: Support = Support(),
    tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """(fold, n_generated_singles, ..., n_selected, n_same_direction, reasons): discovery on each fold, evaluated in its next year.

    All folds come from one pass over packed rows, which are read twice, so ``df`` should be held. Of medians only the sign is
    read, which counts of positive and negative outcomes tell.
    """
    rows = []
    for f, found, later in _walked(df, target, parts, support):
        chosen = [r for r in found.rows if r["selected"]]
        same = sum(r["direction"] != 0 and later.get(r["pattern"]) == r["direction"] for r in chosen)
        rows.append({"fold": f["fold"], "n_selected": len(chosen), "n_same_direction": same,
            "reasons": reasons(found, list(tracked))} | selection_summary(found, support))
    whole = ("n_generated_singles n_support_passed_singles n_generated_pairs n_support_passed_pairs n_statistical_tests n_selected "
        "n_same_direction".split())
    schema = "fold string, " + ", ".join(f"{c} long"
        for c in whole) + ", min_raw_p double, min_fdr_q double, reasons map<string,string>"
    names = ["fold", *whole, "min_raw_p", "min_fdr_q", "reasons"]
    return df.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def _walked(df: DataFrame, target: str, parts: list[dict[str, str]], support: Support) -> list[tuple[dict, Discovery, dict[str, int]]]:
    """Each fold, what it discovered, and the signs of its supported patterns in its later window. Bounds aren't frozen: no mean is read."""
    if not parts:
        return []
    cuts, columns = freeze_folds(df, parts), set(df.columns)
    base = base_states(columns)
    states = [[*base, *quantile_states(c)] for c in cuts]
    # A place a base state, and one a fold and quantile state.
    place = [{s.name: i for i, s in enumerate(base)} for _ in parts]
    tests = [s.expression(columns) for s in base]
    for own, known in zip(states, place):
        for s in own[len(base):]:
            known[s.name] = len(tests)
            tests.append(s.expression(columns))
    at: dict[tuple[int, int], int] = {}
    names: list[dict[str, int]] = []
    for own, known in zip(states, place):
        pairs = [(s.name, s.name) for s in own] + pairs_of(own)
        names.append({a if a == b else a + AND + b: at.setdefault((known[a], known[b]), len(at)) for a, b in pairs})
    excess = excess_of(target)
    other = excess != target and excess in columns
    products = pattern_counts.Products([("", *p) for p in at], len(tests))
    spans = []
    for f, own in zip(parts, names):
        for a, b in ((f["start"], f["end"]), (f["eval_start"], before_holdout(f["eval_end"]))):
            spans.append(fold_counts.Span(_day(a), _day(b), tuple(own.values())))
    rows = pattern_counts.packed(fold_counts.within(df, spans), tests, finite(F.col(target).cast("double")),
        finite(F.col(excess).cast("double")) if other else None)
    met = fold_counts.securities(rows, products, spans) if at else {}
    stated = fold_counts.about(rows, products, spans, horizon_of(target)).collect() if at else []  # a row a window and pattern
    found = {(r["w"], r["p"]): r.asDict() for r in stated}
    out, empty = [], dict.fromkeys(STATS) | dict.fromkeys(_LONGS, 0)
    for i, (f, own, known) in enumerate(zip(parts, states, names)):
        stats = {n: empty | found[2 * i, p] | {"pattern": n, "n_securities": met.get((2 * i, p), 0), "vs_baseline_n": found[2 * i, p]["n_dates"]}
            for n, p in known.items() if (2 * i, p) in found}
        passed = [s for s in own if s.name in stats and _fits(stats[s.name], support)]
        tried = [AND.join(p) for p in pairs_of(passed)]
        made = [empty | {"pattern": s.name} | stats.get(s.name, {}) | {"rule_size": 1, "overlap_flag": None} for s in own]
        for p in tried:
            if p in stats and _fits(stats[p], support):
                flag = _overlap_flag(*(stats[n]["kept"] for n in (p, *p.split(AND))))
                made.append(stats[p] | {"rule_size": 2, "overlap_flag": flag})
        out.append((f, _judged(Discovery(own, cuts[i], None, made, [s.name for s in own], [s.name for s in passed], tried), support)))
    asked = [(w, known[r["pattern"]]) for i, ((_, d), known) in enumerate(zip(out, names)) for r in d.rows if r["selected"]
        for w in (2 * i, 2 * i + 1)]
    signs = _signs_of_medians(rows, products, spans, {k: found[k] for k in asked if k in found})
    for i, ((_, d), known) in enumerate(zip(out, names)):
        for r in d.rows:
            r["direction"] = signs.get((2 * i, known[r["pattern"]]), 0)
    return [(f, d, {n: signs[2 * i + 1, p] for n, p in known.items() if (2 * i + 1, p) in signs})
        for i, ((f, d), known) in enumerate(zip(out, names))]


def _signs_of_medians(rows: DataFrame, products: pattern_counts.Products, spans: list[fold_counts.Span],
    found: dict[tuple[int, int], dict]) -> dict[tuple[int, int], int]:
    """By window and pattern, the sign of the median excess, or of the median outcome where no excess is known."""
    out, between = {}, {"y": [], "x": []}
    for k, r in found.items():
        value = "x" if r["xn"] else "y"
        n, up, down = (r["xn"], r["xup"], r["xdown"]) if r["xn"] else (r["n"], r["up"], r["down"])
        if n and up == down == n / 2:
            between[value].append(k)
        else:
            # The middle values' signs: of an even number of values one of the two may be zero.
            out[k] = 0 if not n else (2 * up >= n) - (2 * down >= n)
    for value, asked in between.items():
        if asked:
            found_middle = fold_counts.middle_pairs(rows, value, products, spans, asked)
            out |= {k: (v > 0) - (v < 0) for k, v in found_middle.items()}
    return out


# ---- one pattern, or two states, in detail


def overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """(both, either, jaccard, b_given_a, a_given_b, high_overlap) of two flags, in one aggregation."""
    x, y = (F.coalesce(F.col(c), F.lit(False)) for c in (a, b))
    s = df.agg(F.count_if(x & y).alias("both"), F.count_if(x | y).alias("either"), F.count_if(x).alias("na"), F.count_if(y).alias("nb"))
    s = s.select("both", "either", div("both", "either").alias("jaccard"), div("both", "na").alias("b_given_a"), div("both", "nb")
        .alias("a_given_b"))
    return s.withColumn("high_overlap", (F.col("jaccard") > 0.9) | (F.col("b_given_a") > 0.95) | (F.col("a_given_b") > 0.95))


def incremental(df: DataFrame, parent: str, extra: str, target: str, lag: int = 20, bounds: Bounds = None) -> DataFrame:
    """A pair against its parent: differences of median, winsorised and daily means, and the daily difference's robust t."""
    x = F.coalesce(F.col(parent), F.lit(False))
    y = x & F.coalesce(F.col(extra), F.lit(False))
    rows = df.filter(x & F.col(target).isNotNull()).withColumn("__w", clipped(target, bounds)).withColumn("__y", y)
    on = lambda c: F.when(F.col("__y"), F.col(c))
    flat = rows.agg((F.median(on(target)) - F.median(target)).alias("median_diff"), (F.avg(on("__w")) - F.avg("__w"))
        .alias("winsor_diff"))
    daily = rows.groupBy("date").agg((F.avg(on(target)) - F.avg(target)).alias("diff")).filter(F.col("diff")
        .isNotNull()).withColumn("one", F.lit(1))
    return flat.crossJoin(newey_west(daily, "diff", lag, ["one"])
        .select(F.col("mean").alias("daily_diff"), F.col("nw_t").alias("diff_nw_t")))


def concentration(df: DataFrame, pattern: str, mode: str = "state", wait: int = 0) -> DataFrame:
    """(n, n_securities, top1_share, top5_share) of a pattern's rows."""
    counts = activate(df, pattern, mode, wait).groupBy("security_id").agg(F.count("*").alias("c"))
    top = counts.orderBy(F.col("c").desc(), "security_id").limit(5).agg(F.max("c").alias("top1"), F.sum("c").alias("top5"))
    both = counts.agg(F.sum("c").alias("n"), F.count("*").alias("n_securities")).crossJoin(top)
    return both.select("n", "n_securities", div("top1", "n").alias("top1_share"), div("top5", "n").alias("top5_share"))


def leave_one_out(df: DataFrame, pattern: str, target: str, mode: str = "state", wait: int = 0) -> DataFrame:
    """(dropped, full_median, dropped_median, delta_median, dropped_n): the median without the security that has most rows."""
    rows = activate(df, pattern, mode, wait).select("security_id", F.col(target).alias("y"))
    top = rows.groupBy("security_id").agg(F.count("*").alias("c")).orderBy(F.col("c")
        .desc(), "security_id").limit(1).select(F.col("security_id").alias("dropped"))
    left = F.when(F.col("security_id") != F.col("dropped"), F.col("y"))
    out = rows.join(F.broadcast(top)).groupBy("dropped").agg(F.median("y").alias("full_median"), F.median(left)
        .alias("dropped_median"), F.count(left).alias("dropped_n"))
    return out.select("dropped", "full_median", "dropped_median", (F.col("dropped_median") - F.col("full_median"))
        .alias("delta_median"), "dropped_n")


def by_year(df: DataFrame, pattern: str, target: str, first: int, last: int, bounds: Bounds = None, mode: str = "state",
    wait: int = 0) -> DataFrame:
    """(year, n, mean, median, winsor_mean, positive_ratio) for every year of the range, empty ones with n 0."""
    rows = activate(df, pattern, mode, wait).filter(F.col(target).isNotNull()).groupBy(F.year("date").alias("year"))
    y = F.col(target)
    made = rows.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.median(y).alias("median"), F.avg(clipped(target, bounds))
        .alias("winsor_mean"), F.avg((y > 0).cast("double")).alias("positive_ratio"))
    years = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(made, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def floor_audit(df: DataFrame, pattern: str, target: str, bounds: Bounds = None, lag: int | None = None) -> DataFrame:
    """(subset, STATS...): the pattern's statistics by price floor."""
    found = activate(df, pattern).select("security_id", "date", F.col(target).alias("y"), F.col(target)
        .alias("x"), F.explode(price_bucket_floor()).alias("pattern"))
    stats = pattern_stats(found, daily_baseline(df.limit(0), target), horizon_of(target) if lag is None else lag, clipped("y", bounds))
    return stats.withColumnRenamed("pattern", "subset")


def regime_audit(df: DataFrame, pattern: str, target: str, bounds: Bounds = None, lag: int | None = None) -> DataFrame:
    """(kind, subset, STATS...): the pattern's statistics by regime of either kind."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("regime")) for k in ("spy_regime", "vix_regime"))))
    rows = activate(df, pattern).withColumn("__r", kinds).filter(F.col("__r.regime").isNotNull())
    found = rows.select("security_id", "date", F.col(target).alias("y"), F.col(target).alias("x"), F.col("__r.kind")
        .alias("kind"), F.col("__r.regime").alias("pattern"))
    base = daily_baseline(df.limit(0), target).withColumn("kind", F.lit(""))
    stats = pattern_stats(found, base, horizon_of(target) if lag is None else lag, clipped("y", bounds), ("kind",))
    return stats.withColumnRenamed("pattern", "subset")


MODES = (("state", 0), ("entry", 0), ("entry", 20))


def inspect(df: DataFrame, pattern: str, target: str, start: str, end: str, later_start: str,
    later_end: str | None = None) -> dict[str, DataFrame]:
    """One pattern in detail, cutoffs and bounds frozen on the first window; nothing is selected.

    modes: statistics by mode, cooldown and window; concentration, leave_one_out, years: by mode;
    floors, regimes; for pairs also overlap and incremental (against either parent).
    """
    dev = window(df, start, end)
    frozen, bounds = freeze(dev), bounds_of(dev, target)
    states = [s for s in states_of(df.columns, frozen) if s.name in pattern.split(AND)]
    stated = apply_states(df, states)
    windows = {"analysis": window(stated, start, end), "validation": window(stated, later_start, before_holdout(later_end))}
    tag = lambda d, mode, wait: d.withColumns({"mode": F.lit(mode), "cooldown": F.lit(wait)})
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    first, last = int(start[:4]), int(before_holdout(later_end)[:4])
    whole = windows["analysis"].unionByName(windows["validation"])
    scored = [
        tag(score(w, states, target, target, bounds, wanted=[pattern], mode=mode, wait=wait), mode, wait)
            .withColumn("window", F.lit(name))
        for mode, wait in MODES for name, w in windows.items()
    ]
    a = windows["analysis"]
    out = {
        "modes": union(scored),
        "concentration": union([tag(concentration(a, pattern, m, w), m, w) for m, w in MODES]),
        "leave_one_out": union([tag(leave_one_out(a, pattern, target, m, w), m, w) for m, w in MODES]),
        "years": union([tag(by_year(whole, pattern, target, first, last, bounds, m, w), m, w) for m, w in MODES]),
        "floors": floor_audit(stated, pattern, target, bounds),
    }
    if {"spy_ma200_distance", "vix_close"} <= set(df.columns):
        out["regimes"] = regime_audit(with_regimes(stated, vix_terciles(dev)), pattern, target, bounds)
    parts = pattern.split(AND)
    if len(parts) == 2:
        x, y = parts
        lag = horizon_of(target)
        out["overlap"] = overlap(a, x, y)
        against = [incremental(a, p, q, target, lag, bounds).withColumn("parent", F.lit(p)) for p, q in ((x, y), (y, x))]
        out["incremental"] = union(against)
    return out


def refuse_to_persist(*_: object) -> None:
    """Mining results are printed, never stored."""
    raise RuntimeError("mining results are for use in memory only")
