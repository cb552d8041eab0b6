"""Cross-sectional research statistics over a panel of features and forward outcomes.

A panel has security_id, date, raw_close, features and targets. Cutoffs (winsor bounds,
volatility terciles) are frozen on the development window and then applied everywhere;
they are the only values that reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank, div, medians, middle, nearest_quantiles, pearson, quintile, top_rows

SUBSETS = ("all", "ge_1", "ge_5", "ge_20", "lt_1", "1_to_5", "5_to_20", "ge_20_bucket")
PROFILE = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def research_daily(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Every feature row with the labels of its security and date, where there are any.

    Versions aren't part of the key: two versions of a label give two rows.
    """
    from .features import VALUES as FEATURES
    from .labels import VALUES as LABELS

    right = labels.select("security_id", "date", "label_version", *LABELS)
    left = features.select("security_id", F.col("ticker_at_time").alias("ticker"), "date", "feature_version", *FEATURES)
    return left.join(right, ["security_id", "date"], "left").select(*left.columns, "label_version", *LABELS)


def panel(features: DataFrame, labels: DataFrame, members: DataFrame, classes: DataFrame, prices: DataFrame, issues: DataFrame,
    universe: str, wanted: tuple[str, ...] = ("COMMON_EQUITY",)) -> DataFrame:
    """The research view: features with labels of a universe's members of the wanted classes, with raw close and a validity flag."""
    inside = members.filter(F.col("universe_name") == universe).select("security_id").distinct()
    critical = issues.filter((F.col("severity") == "critical") & ~F.col("resolved")).select("security_id",
        "date").distinct().withColumn("__bad", F.lit(True))
    kept = labels.drop("ticker_at_time", "calculated_at", "calculation_code_version")
    df = features.drop("calculated_at", "calculation_code_version").join(kept, ["security_id", "date"]).join(inside, "security_id",
        "left_semi")
    df = df.join(classes.select("security_id", "instrument_class"), "security_id", "left").filter(F.col("instrument_class")
        .isin(*wanted))
    df = df.join(prices.select("security_id", "date", F.col("close").alias("raw_close")), ["security_id", "date"], "left")
    return df.join(critical, ["security_id", "date"], "left").withColumn("data_quality_valid", F.col("__bad").isNull()).drop("__bad")


def assign_split(df: DataFrame, development_end: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col("date") <= F.lit(development_end).cast("date"), "development").otherwise("validation"))


def in_split(df: DataFrame, split: str, start: str, end: str) -> DataFrame:
    """Development: from ``start`` to ``end``; validation: after ``end``."""
    d = F.col("date")
    return df.filter(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")) if split == "development" else d > F.lit(end)
        .cast("date"))


def long(df: DataFrame, columns: list[str], name: str, value: str, keep: list[str]) -> DataFrame:
    """One row a column: (keep..., name, value), without nulls."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v")) for c in columns)))
    return df.select(*keep, rows.alias("__x")).select(*keep, F.col("__x.n").alias(name), F.col("__x.v")
        .alias(value)).filter(F.col(value).isNotNull())


_MEDIAN = 2  # its place in ``summary``


def summary(value: str = "value") -> list[Column]:
    """Count, mean, median, deviation, share above zero and plain t of a column."""
    x = F.col(value)
    std = F.stddev_samp(x)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x)
        .alias("median"), std.alias("std"), F.avg((x > 0).cast("double"))
            .alias("positive_ratio"), F.try_divide(F.avg(x), std / F.sqrt(F.count(x))).alias("t_stat")]


def summarised(rows: DataFrame, by: list[str], value: str = "value", *extra: Column) -> DataFrame:
    """``summary`` and further aggregates of few large groups; their medians come without a task that holds a group's values."""
    stats = rows.groupBy(*by).agg(*(c for i, c in enumerate(summary(value)) if i != _MEDIAN), *extra, middle(value).alias("__q"))
    found = medians(rows, value, by, stats).withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by))
    out = stats.join(F.broadcast(found), same, "left")
    others = [c for c in stats.columns if c not in (*by, "n", "mean", "__q")]
    return out.select(*by, "n", "mean", "median", *others)


def sample_status(n: Column, dates: Column, rows_needed: int = 1000, dates_needed: int = 100) -> Column:
    return F.when((n >= rows_needed) | (dates >= dates_needed), "ok").otherwise("insufficient")


def baseline(df: DataFrame, targets: list[str]) -> DataFrame:
    """Statistics of each target over all rows and by year; year null: all."""
    rows = long(df, targets, "target", "value", ["date"])
    rows = rows.withColumn("year", F.explode(F.array(F.lit(None).cast("int"), F.year("date"))))
    out = summarised(rows, ["target", "year"], "value", F.countDistinct("date").alias("n_dates"))
    return out.withColumn("status", sample_status(F.col("n"), F.col("n_dates")))


def coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls, distinct values, extremes and exact nearest-rank quantiles of each feature."""
    total = df.agg(F.count("*").alias("rows"))
    rows = long(df, features, "feature", "value", [])
    stats = rows.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct"), F.min("value")
        .alias("min"), F.max("value").alias("max"))
    names = {f"q{i}": f"p{int(q * 100)}" for i, q in enumerate(PROFILE)}
    quantiles = nearest_quantiles(rows, "value", list(PROFILE), ["feature"]).withColumnsRenamed(names)
    wide = stats.join(quantiles, "feature").join(F.broadcast(total)).withColumn("null_ratio", 1 - div("n", "rows"))
    return wide.withColumn("high_null", F.col("null_ratio") >= 0.3).drop("rows")


def with_quintiles(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, value, quintile): each feature's daily quintile."""
    rows = long(df, features, "feature", "value", list(dict.fromkeys(["date", "security_id", *keep])))
    return rows.withColumn("quintile", quintile("value", ["date", "feature"]))


def cutoffs(df: DataFrame, targets: list[str]) -> dict[str, tuple[float, float]]:
    """Frozen 1 % and 99 % bounds of each target."""
    rows = nearest_quantiles(long(df, targets, "target", "value", []), "value", [0.01, 0.99], ["target"]).collect()
    return {r["target"]: (r["q0"], r["q1"]) for r in rows}


def clipped(c: str | Column, bounds: tuple[float, float] | None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c if bounds is None else F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(bounds[0])), F.lit(bounds[1])))


def _per_target(bounds: dict[str, tuple[float, float]], side: int) -> Column:
    return reduce(lambda out, kv: F.when(F.col("target") == kv[0], F.lit(kv[1][side])).otherwise(out), bounds.items(), F.lit(None)
        .cast("double"))


def quintile_stats(df: DataFrame, features: list[str], targets: list[str],
    bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Statistics of each target in each feature's quintiles, with trimmed and winsorised means where bounds are given."""
    rows = with_quintiles(df, features, targets)
    rows = long(rows.drop("value"), targets, "target", "value", ["date", "security_id", "feature", "quintile"])
    bounds = bounds or {}
    low, high = _per_target(bounds, 0), _per_target(bounds, 1)
    inside = (F.col("value") >= F.coalesce(low, F.col("value"))) & (F.col("value") <= F.coalesce(high, F.col("value")))
    winsor = F.least(F.greatest(F.col("value"), F.coalesce(low, F.col("value"))), F.coalesce(high, F.col("value")))
    extra = [F.avg(F.when(inside, F.col("value"))).alias("trimmed_mean"), F.avg(winsor)
        .alias("winsor_mean"), F.try_divide(F.stddev_samp("value"), F.sqrt(F.count("value")))
            .alias("std_error"), F.countDistinct("date").alias("n_dates")]
    return rows.groupBy("feature", "target", "quintile").agg(*summary(), *extra)


def spreads(stats: DataFrame) -> DataFrame:
    """Fifth minus first quintile of each feature and target, and how monotone the five means are."""
    pick = lambda c, q: F.max(F.when(F.col("quintile") == q, F.col(c)))
    return stats.groupBy("feature",
        "target").agg(*((pick(c, 5) - pick(c, 1)).alias(f"{c}_spread") for c in ("mean", "median", "winsor_mean")),
        pearson(F.col("quintile").cast("double"), "mean").alias("monotonicity"))


def daily_spread(df: DataFrame, features: list[str], target: str, by: list[str] | None = None) -> DataFrame:
    """(by..., feature, date, spread): each day's mean outcome of the fifth quintile minus that of the first."""
    by = by or []
    rows = with_quintiles(df, features, [target, *by]).filter(F.col(target).isNotNull())
    side = lambda q: F.avg(F.when(F.col("quintile") == q, F.col(target)))
    return rows.groupBy(*by, "feature", "date").agg((side(5) - side(1)).alias("spread")).filter(F.col("spread").isNotNull())


def newey_west(series: DataFrame, value: str, lag: int, by: list[str]) -> DataFrame:
    """(by..., n, mean, nw_t): the mean's t with Bartlett weights over positional lags; null under three dates or without variance.

    One value a date: the ordered series of a group is short, and its lagged products are a window.
    """
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("date")
    d = series.withColumn("__n", F.count(value).over(group)).withColumn("__d", F.col(value) - F.avg(value).over(group))
    d = d.withColumn("__l", F.least(F.lit(max(lag, 1)), F.col("__n") - 1))
    d = d.withColumns({f"__k{k}": F.lag("__d", k).over(order) * F.col("__d") for k in range(1, max(lag, 1) + 1)})
    gammas = [F.sum(f"__k{k}").alias(f"g{k}") for k in range(1, max(lag, 1) + 1)]
    g = d.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(F.col("__d") * F.col("__d"))
        .alias("g0"), F.max("__l").alias("l"), *gammas)
    v = F.col("g0")
    for k in range(1, max(lag, 1) + 1):
        v = v + F.when(F.lit(k) <= F.col("l"), 2 * (1 - k / (F.col("l") + 1)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0))).otherwise(0.0)
    v = v / F.col("n")
    t = F.when((F.col("n") >= 3) & (v > 1e-18), F.col("mean") / F.sqrt(v / F.col("n")))
    return g.select(*by, "n", "mean", t.alias("nw_t"))


def overlapping_spread(df: DataFrame, features: list[str], target: str, horizon: int) -> DataFrame:
    """The daily spread series of each feature: mean, median, share above zero, plain and autocorrelation-robust t."""
    series = daily_spread(df, features, target)
    return series.groupBy("feature").agg(*summary("spread")).join(newey_west(series, "spread", horizon, ["feature"])
        .select("feature", "nw_t"), "feature")


def extreme_dates(df: DataFrame, features: list[str], target: str, k: int = 5) -> DataFrame:
    """The k dates of the highest and of the lowest spread of each feature."""
    series = daily_spread(df, features, target)
    rank = lambda o: F.row_number().over(Window.partitionBy("feature").orderBy(o, "date"))
    marked = series.withColumn("high", rank(F.col("spread").desc())).withColumn("low", rank(F.col("spread").asc()))
    return marked.filter((F.col("high") <= k) | (F.col("low") <= k)).select("feature", "date", "spread",
        F.when(F.col("high") <= k, F.col("high")).alias("high_rank"), F.when(F.col("low") <= k, F.col("low")).alias("low_rank"))


def ic_by_date(df: DataFrame, features: list[str], target: str, by: list[str] | None = None) -> DataFrame:
    """(by..., feature, date, ic, n): rank correlation of feature and target over the rows that have both."""
    by = by or []
    rows = long(df.filter(F.col(target).isNotNull()), features, "feature", "value", [*by, "date", target])
    keys = [*by, "feature", "date"]
    ranked = rows.withColumn("a", average_rank("value", keys)).withColumn("b", average_rank(target, keys))
    return ranked.groupBy(*keys).agg(pearson("a", "b").alias("ic"), F.count("*").alias("n"))


def rank_ic(df: DataFrame, features: list[str], target: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation, information ratio and share above zero of the daily rank correlations."""
    by = by or []
    x = F.col("ic")
    days = ic_by_date(df, features, target, by).filter(x.isNotNull())
    return days.groupBy(*by, "feature").agg(F.count(x).alias("n_dates"), F.avg(x).alias("mean_ic"), F.median(x)
        .alias("median_ic"), F.stddev_samp(x).alias("std_ic"), F.try_divide(F.avg(x), F.stddev_samp(x))
            .alias("ic_ir"), F.avg((x > 0).cast("double")).alias("positive_ratio"))


def redundancy(df: DataFrame, features: list[str], limit: float = 0.95) -> DataFrame:
    """Mean daily rank correlation of each pair of features; ranks are taken over all of a feature's values, then pairs are matched."""
    ranked = df.select("date", *(average_rank(f, ["date"]).alias(f) for f in features))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    daily = ranked.groupBy("date").agg(*(pearson(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    means = daily.agg(*(F.avg(f"p{i}").alias(f"p{i}") for i in range(len(pairs))))
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("mean_corr"))
        for i, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(a).alias("feature_a"), F.lit(a).alias("feature_b"), F.lit(1.0).alias("mean_corr")) for a in features]
    out = means.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return out.withColumn("redundant", (F.col("feature_a") != F.col("feature_b")) & (F.abs("mean_corr") >= limit))


def vix_terciles(df: DataFrame) -> tuple[float | None, float | None]:
    """Frozen terciles of vix_close, weighted by rows."""
    r = nearest_quantiles(df, "vix_close", [1 / 3, 2 / 3]).first()
    return (r["q0"], r["q1"]) if r else (None, None)


def with_regimes(df: DataFrame, terciles: tuple[float | None, float | None]) -> DataFrame:
    """spy_regime (a missing distance counts as below) and vix_regime (missing stays null)."""
    low, high = terciles
    v = F.col("vix_close")
    vix = F.when(v.isNull(), None).when(v <= low, "vix_low").when(v <= high,
        "vix_medium").otherwise("vix_high") if low is not None else F.lit(None).cast("string")
    return df.withColumns({"spy_regime": F.when(F.col("spy_ma200_distance") > 0, "spy_above_ma200")
        .otherwise("spy_below_ma200"), "vix_regime": vix})


def regime_stats(df: DataFrame, targets: list[str]) -> DataFrame:
    """Statistics of each target by regime of either kind."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("regime")) for k in ("spy_regime", "vix_regime"))))
    rows = long(df.withColumn("__r", kinds), targets, "target", "value", ["__r"]).select("__r.kind", "__r.regime", "target",
        "value").filter(F.col("regime").isNotNull())
    return summarised(rows, ["kind", "regime", "target"])


def price_bucket(c: str = "raw_close") -> Column:
    x = F.col(c)
    return F.when(x < 1, "lt_1").when(x < 5, "1_to_5").when(x < 20, "5_to_20").when(x.isNotNull(), "ge_20")


def price_bucket_floor(c: str = "raw_close") -> Column:
    """The floors that a price reaches: all, raw_close_ge_1, _5 and _20."""
    x = F.col(c)
    names = [F.lit("all"), *(F.when(x >= k, F.lit(f"raw_close_ge_{k}")) for k in (1, 5, 20))]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def price_sensitivity(df: DataFrame, target: str) -> DataFrame:
    rows = df.filter(F.col(target).isNotNull()).withColumn("bucket", price_bucket()).filter(F.col("bucket").isNotNull())
    return summarised(rows, ["bucket"], target, F.avg((F.abs(F.col(target)) > 0.5).cast("double")).alias("extreme_share"))


def with_subsets(df: DataFrame) -> DataFrame:
    """Each row once for every price subset it is in: all, floors 1, 5 and 20, and its bucket."""
    x = F.col("raw_close")
    names = [F.lit("all"), *(F.when(x >= k, F.lit(f"ge_{k}")) for k in (1, 5, 20)), F.concat(F.lit("bucket_"), price_bucket())]
    return df.withColumn("price_subset", F.explode(F.filter(F.array(*names), lambda n: n.isNotNull())))


def overlay(df: DataFrame, features: list[str], target: str) -> dict[str, DataFrame]:
    """Size, baseline, rank IC and spread by price subset."""
    rows = with_subsets(df)
    sizes = rows.groupBy("price_subset").agg(F.count("*").alias("n"), F.countDistinct("security_id")
        .alias("n_securities"), F.countDistinct("date").alias("n_dates"))
    base = summarised(rows.filter(F.col(target).isNotNull()), ["price_subset"], target)
    ranks = rows.filter(F.col(target).isNotNull())
    spread = long(rows, features, "feature", "value", ["price_subset", "date", "security_id", target]).withColumn("quintile",
        quintile("value", ["price_subset", "date", "feature"])).filter(F.col(target).isNotNull())
    side = lambda q: F.avg(F.when(F.col("quintile") == q, F.col(target)))
    return {"sizes": sizes, "baseline": base, "ic": rank_ic(ranks, features, target, ["price_subset"]),
        "spread": spread.groupBy("price_subset", "feature").agg((side(5) - side(1)).alias("mean_spread"))}


def _by_bucket(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.col("bucket").alias("key"), "n")


def _most(rows: DataFrame, name: str, key: str, k: int = 15) -> DataFrame:
    """The k most frequent keys, with their share of all rows."""
    counted = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    top = counted.orderBy(F.col("n").desc(), "key").limit(k).crossJoin(total)
    return top.select(F.lit(name).alias("table"), "key", "n", F.try_divide("n", "total").alias("share"))


def low_price_concentration(df: DataFrame, target: str) -> DataFrame:
    """(table, key, n, share).

    Rows by price bucket, outcomes above 2 by bucket, the top 1 % and 0.1 % by bucket, and their top 15 securities and
    dates.
    """
    rows = df.filter(F.col(target).isNotNull()).withColumn("bucket", F.coalesce(price_bucket(), F.lit("unknown")))
    rows = rows.select("security_id", "date", "bucket", target)
    total = rows.count()
    tails = {name: top_rows(rows, target, max(1, round(total * f)), ["security_id", "date"])
        for name, f in (("top_1pct", 0.01), ("top_01pct", 0.001))}
    parts = [_by_bucket(rows, "rows"), _by_bucket(rows.filter(F.abs(F.col(target)) > 2), "above_2"),
        *(_by_bucket(x, n) for n, x in tails.items())]
    out = reduce(DataFrame.unionByName, parts)
    out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("table")))
    for name, x in tails.items():
        out = out.unionByName(_most(x, f"ticker_{name}", "security_id")).unionByName(_most(x, f"date_{name}", "date"))
    return out


def excess_name(target: str) -> str:
    """The excess outcome of a target; its own name for an excess."""
    return target.replace("forward_return_", "forward_excess_spy_", 1) if target.startswith("forward_return_") else target


def horizon(target: Column) -> Column:
    """The sessions that a target's name ends with."""
    return F.try_to_number(F.regexp_extract(target, r"_(\d+)d$", 1), F.lit("999")).cast("int")


def _robust(rows: DataFrame, by: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Statistics of (by..., target, value, excess, date).

    Plain, trimmed and winsorised means, exact nearest quartiles, shares above zero.
    """
    low, high = _per_target(bounds, 0) if bounds else F.lit(None).cast("double"), _per_target(bounds,
        1) if bounds else F.lit(None).cast("double")
    v, bounded = F.col("value"), low.isNotNull()
    inside = F.when(bounded & (v >= low) & (v <= high), v)
    winsor = F.when(bounded, F.least(F.greatest(v, low), high))
    keys = [*by, "target"]
    flat = rows.groupBy(*keys).agg(
        F.count("*").alias("sample_count"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.avg(inside)
            .alias("trimmed_mean_1pct"),
        F.avg(winsor).alias("winsorized_mean_1pct"), F.avg((v > 0).cast("double")).alias("positive_ratio"),
        F.avg((F.col("excess") > 0).cast("double")).alias("excess_positive_ratio"), F.stddev_samp(v).alias("std"),
        F.try_divide(F.avg(v), F.stddev_samp(v) / F.sqrt(F.count(v))).alias("tstat"),
    )
    quartiles = nearest_quantiles(rows, "value", [0.25, 0.75], keys).withColumnsRenamed({"q0": "p25", "q1": "p75"})
    return flat.join(quartiles, keys).withColumn("horizon", horizon(F.col("target")))


def _outcomes(df: DataFrame, targets: list[str], keep: list[str]) -> DataFrame:
    """(keep..., target, value, excess): one row a known outcome, with the excess that goes with it."""
    of = lambda t: F.col(excess_name(t)) if excess_name(t) in df.columns else F.lit(None).cast("double")
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("value"), of(t).alias("excess")) for t in targets)))
    return df.select(*keep, rows.alias("__x")).select(*keep, "__x.*").filter(F.col("value").isNotNull())


def robust_baseline(df: DataFrame, targets: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(target, horizon, distinct_dates, ...): robust statistics of each target; dates are those of the whole window."""
    dates = df.agg(F.countDistinct("date").alias("distinct_dates"))
    return _robust(_outcomes(df, targets, ["date"]), [], bounds).crossJoin(F.broadcast(dates))


def robust_quantiles(df: DataFrame, features: list[str], targets: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(feature, quintile, target, horizon, distinct_dates, sample_status, ...): a long table of robust statistics."""
    wanted = list(dict.fromkeys([*targets, *(excess_name(t) for t in targets if excess_name(t) in df.columns)]))
    rows = with_quintiles(df, features, wanted)
    dates = rows.groupBy("feature", "quintile").agg(F.countDistinct("date").alias("distinct_dates"))
    made = _robust(_outcomes(rows.drop("value"), targets, ["feature", "quintile", "date"]), ["feature", "quintile"], bounds)
    out = made.join(F.broadcast(dates), ["feature", "quintile"])
    return out.withColumn("sample_status", sample_status(F.col("sample_count"), F.col("distinct_dates")))


def robust_spreads(quantiles: DataFrame) -> DataFrame:
    """(feature, target, horizon, q1_n, q5_n, raw_mean_spread, median_spread, winsorized_mean_spread) between the outer quintiles."""
    pick = lambda c, q: F.max(F.when(F.col("quintile") == q, F.col(c)))
    names = {"mean": "raw_mean_spread", "median": "median_spread", "winsorized_mean_1pct": "winsorized_mean_spread"}
    made = [pick("sample_count", 1).alias("q1_n"), pick("sample_count", 5).alias("q5_n")]
    made += [(pick(c, 5) - pick(c, 1)).alias(n) for c, n in names.items()]
    out = quantiles.groupBy("feature", "target", "horizon").agg(*made)
    return out.filter(F.col("q1_n").isNotNull() & F.col("q5_n").isNotNull())


def feature_summary(df: DataFrame, features: list[str], target: str, start: str, end: str, horizon: int) -> DataFrame:
    """One row a feature: rank IC, robust t of the daily spread and median spread of both windows, over all rows and those priced at 5 or more.

    Bounds are frozen on the development window.
    """
    bounds = cutoffs(in_split(df, "development", start, end), [target])
    counts = [F.lit(f).alias("feature") for f in features]
    out = df.sparkSession.range(1).select(F.explode(F.array(*counts)).alias("feature"))
    for split in ("development", "validation"):
        window = in_split(df, split, start, end)
        n = window.agg(F.count("*").alias(f"{split}_n"))
        out = out.crossJoin(F.broadcast(n))
        for prefix, rows in (("", window), ("price_ge_5_", window.filter(F.col("raw_close") >= 5))):
            ic = rank_ic(rows, features, target).select("feature", F.col("mean_ic").alias(f"{prefix}{split}_ic"))
            t = newey_west(daily_spread(rows, features, target), "spread", horizon, ["feature"])
            t = t.select("feature", F.col("nw_t").alias(f"{prefix}{split}_overlapping_nw_t"))
            spread = robust_spreads(robust_quantiles(rows, features, [target], bounds))
            spread = spread.select("feature", F.col("median_spread").alias(f"{prefix}{split}_median_q5_q1"))
            for part in (ic, t, spread):
                out = out.join(part, "feature", "left")
    return out


def reconcile(prices: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, n): which of the three tables have a security and date."""
    keys = ["security_id", "date"]
    mark = lambda df, c: df.select(*keys).distinct().withColumn(c, F.lit(True))
    every = mark(prices, "p").join(mark(features, "f"), keys, "full_outer").join(mark(labels, "l"), keys, "full_outer")
    has = {c: F.col(c).isNotNull() for c in "pfl"}
    bucket = F.when(has["p"] & has["f"] & has["l"], "all_three").when(has["p"] & has["f"], "price_feature").when(has["p"] & has["l"],
        "price_label").when(has["f"] & has["l"], "feature_label").when(has["p"], "price_only").when(has["f"],
        "feature_only").otherwise("label_only")
    return every.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def reconcile_securities(prices: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """(verdict, n): in how many of the three tables securities are, by row counts.

    all_three, price_only, feature_only, label_only, partial (two of them), and of all_three
    those whose counts differ, as row_count_mismatch.
    """
    count = lambda df, c: df.groupBy("security_id").agg(F.count("*").alias(c))
    every = count(prices, "p").join(count(features, "f"), "security_id", "full_outer").join(count(labels, "l"), "security_id",
        "full_outer")
    has = [F.col(c).isNotNull() for c in "pfl"]
    there = sum(x.cast("int") for x in has)
    only = F.when(has[0], "price_only").when(has[1], "feature_only").otherwise("label_only")
    verdict = F.when(there == 3, "all_three").when(there == 1, only).otherwise("partial")
    differ = (there == 3) & ((F.col("p") != F.col("f")) | (F.col("p") != F.col("l")))
    marks = F.filter(F.array(verdict, F.when(differ, "row_count_mismatch")), lambda x: x.isNotNull())
    return every.select(F.explode(marks).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def price_feature_recon(prices: DataFrame, features: DataFrame, tracked: DataFrame) -> DataFrame:
    """(matched, expected_missing, unexpected_missing): price rows without a feature row are expected for securities that have none."""
    keys = ["security_id", "date"]
    marked = prices.select(*keys).join(features.select(*keys).distinct().withColumn("f", F.lit(True)), keys, "left")
    marked = marked.join(tracked.select("security_id").distinct().withColumn("t", F.lit(True)), "security_id", "left")
    missing = F.col("f").isNull()
    return marked.agg(F.count_if(~missing).alias("matched"), F.count_if(missing & F.col("t").isNull())
        .alias("expected_missing"), F.count_if(missing & F.col("t").isNotNull()).alias("unexpected_missing"))


def missing_examples(prices: DataFrame, features: DataFrame, tracked: DataFrame, n: int = 20) -> DataFrame:
    """The first n price rows without a feature row of securities that should have one."""
    return missing_identity(prices, features).join(tracked.select("security_id")
        .distinct(), "security_id", "left_semi").orderBy("security_id", "date").limit(n)


def missing_identity(prices: DataFrame, features: DataFrame) -> DataFrame:
    """Price rows without a feature row of the same security and date."""
    return prices.select("security_id", "date").join(features.select("security_id", "date"), ["security_id", "date"], "left_anti")


def scope_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(in_both, only_first, only_second) of two sets of security ids."""
    x, y = a.select("security_id"), b.select("security_id")
    parts = [("in_both", x.intersect(y)), ("only_first", x.subtract(y)), ("only_second", y.subtract(x))]
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, d in parts])
