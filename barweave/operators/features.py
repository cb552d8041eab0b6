"""The daily feature set: 52 columns of adjusted prices, benchmarks and a volatility index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.windows import change, div, finite, highest, lag, lowest, mean, previous, std

RETURNS = (1, 3, 5, 10, 20, 60)
MEANS = (5, 10, 20, 50, 120, 200)
SLOPES = (20, 50, 200)
SPREADS = (10, 20, 60)
VOLUMES = (5, 20, 60)
RANGES = (20, 60, 252)
RELATIVE = (5, 20, 60)
#: Nulled on bars whose raw prices contradict each other.
OHLC_DEPENDENT = ["atr_14", "atr_pct_14", *(f"distance_{s}_{n}d" for s in ("high", "low") for n in RANGES), "gap_return",
    "intraday_return", "daily_range_pct", "upper_wick_pct", "lower_wick_pct"]
VALUES = [
    *(f"ret_{n}d" for n in RETURNS), *(f"ma_{n}_distance" for n in MEANS), *(f"ma_{n}_slope" for n in SLOPES), "rsi_14",
        *(f"volatility_{n}d" for n in SPREADS), *OHLC_DEPENDENT[:2],
    *(f"volume_ratio_{n}d" for n in VOLUMES), *OHLC_DEPENDENT[2:],
        *(f"rel_{b}_{n}d" for b in ("spy", "qqq", "sector") for n in RELATIVE),
    *(f"spy_ret_{n}d" for n in RELATIVE), "spy_ma200_distance", "qqq_ret_20d", "vix_close", "vix_change_5d", "vix_change_20d",
]
IDENTITY = ["security_id", "ticker_at_time", "date", "feature_version", "calculated_at", "calculation_code_version"]


def by_date() -> WindowSpec:
    """A market series by date: one row a session, so few rows in all."""
    return Window.orderBy("date")


def add_adjusted(df: DataFrame) -> DataFrame:
    """adjusted_open, _high, _low, _close.

    Raw prices times adj_close / close; all null where that factor isn't a finite number above or below zero.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))) & (F.col(c) != 0)
    valid = ok("close") & ok("adj_close")
    factor = div("adj_close", "close")
    made = {f"adjusted_{c}": F.when(valid, F.col(c) * factor) for c in ("open", "high", "low")}
    return df.withColumns(made | {"adjusted_close": F.when(valid, F.col("adj_close"))})


def at_least(a: str | Column, b: str | Column) -> Column:
    """a >= b within the larger of 0.001 and a hundred-thousandth of the prices."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    slack = F.greatest(F.lit(1e-3), F.lit(1e-5) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))
    return a + slack >= b


def ohlc_valid() -> Column:
    """Do the raw prices agree with each other, within tolerance? Null prices don't contradict."""
    pairs = (("high", "open"), ("high", "close"), ("high", "low"), ("open", "low"), ("close", "low"))
    ok = F.lit(True)
    for a, b in pairs:
        ok = ok & F.coalesce(at_least(a, b), F.lit(True))
    return ok


def benchmark_features(bench: DataFrame, name: str) -> DataFrame:
    """(date, {name}_ret_5d, _20d, _60d, {name}_ma200_distance) of a market series; few thousand rows, one a session."""
    c = "adj_close"
    full = F.count(c).over(by_date().rowsBetween(-199, 0)) == 200
    ma = F.when(full, F.avg(c).over(by_date().rowsBetween(-199, 0)))
    return bench.select("date", *(change(c, F.lag(c, n).over(by_date())).alias(f"{name}_ret_{n}d") for n in RELATIVE), change(c, ma)
        .alias(f"{name}_ma200_distance"))


def vix_features(vix: DataFrame) -> DataFrame:
    """(date, vix_close, vix_change_5d, vix_change_20d), lagged by the index's own rows."""
    return vix.select("date", F.col("close")
        .alias("vix_close"), *(change("close", F.lag("close", n).over(by_date())).alias(f"vix_change_{n}d") for n in (5, 20)))


def price_features(df: DataFrame) -> DataFrame:
    """Window features of each security: one shuffle by security, two rounds of windows."""
    c, h, l, o = (f"adjusted_{x}" for x in ("close", "high", "low", "open"))
    one = {f"ret_{n}d": change(c, lag(c, n)) for n in RETURNS}
    one |= {f"__ma{n}": mean(c, n) for n in MEANS}
    one |= {f"volume_ratio_{n}d": div("volume", previous(F.avg, "volume", n)) for n in VOLUMES}
    one |= {f"distance_high_{n}d": change(c, highest(h, n)) for n in RANGES}
    one |= {f"distance_low_{n}d": change(c, lowest(l, n)) for n in RANGES}
    one["gap_return"] = change(o, lag(c, 1))
    body = {
        "intraday_return": change(c, o),
        "daily_range_pct": div(F.col(h) - F.col(l), c),
        "upper_wick_pct": div(F.col(h) - F.greatest(o, c), c),
        "lower_wick_pct": div(F.least(o, c) - F.col(l), c),
    }
    df = df.withColumns(one).withColumns(body)
    two = {f"ma_{n}_distance": change(c, f"__ma{n}") for n in MEANS}
    two |= {f"ma_{n}_slope": change(f"__ma{n}", lag(f"__ma{n}", 5)) for n in SLOPES}
    two |= {f"volatility_{n}d": std("ret_1d", n) for n in SPREADS}
    return df.withColumns(two).drop(*(f"__ma{n}" for n in MEANS))


def wilder_features(df: DataFrame) -> DataFrame:
    """rsi_14, atr_14 and atr_pct_14; recursive, so computed by grouped map."""

    def kernel(s: kernels.Series) -> kernels.Series:
        h, l, c = (s[f"adjusted_{x}"] for x in ("high", "low", "close"))
        return {"rsi_14": kernels.rsi(c, 14), "atr_14": kernels.atr(h, l, c, 14)}

    found = kernels.per_security(df, kernel, ["adjusted_high", "adjusted_low", "adjusted_close"], ["rsi_14", "atr_14"])
    return found.withColumn("atr_pct_14", div("atr_14", "adjusted_close"))


def compute(prices: DataFrame, spy: DataFrame, qqq: DataFrame, vix: DataFrame, start: str | None = None, end: str | None = None,
    version: str = "v1", code_version: str = "1", calculated_at: Column | None = None) -> DataFrame:
    """All identity and value columns of the bars from ``start`` to ``end``; windows see the bars before.

    Market series have a row a session, so they are broadcast and joined on the date alone;
    a missing date stays null, nothing is carried forward.
    """
    df = price_features(wilder_features(add_adjusted(prices)))
    for series in (benchmark_features(spy, "spy"), benchmark_features(qqq, "qqq"), vix_features(vix)):
        df = df.join(F.broadcast(series), "date", "left")
    df = df.withColumns({f"rel_{b}_{n}d": F.col(f"ret_{n}d") - F.col(f"{b}_ret_{n}d") for b in ("spy", "qqq") for n in RELATIVE})
    df = df.withColumns({f"rel_sector_{n}d": F.lit(None).cast("double") for n in RELATIVE})
    valid = ohlc_valid()
    df = df.withColumns({c: F.when(valid, F.col(c)) for c in OHLC_DEPENDENT})
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    ids = {"feature_version": F.lit(version), "calculation_code_version": F.lit(code_version),
        "calculated_at": F.current_timestamp() if calculated_at is None else calculated_at}
    return df.withColumns(ids).select(*IDENTITY, *(finite(c).alias(c) for c in VALUES))
