"""Registered queries over the derived bar panel, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels
from .functions.windows import change, lag, mean, nearest_quantiles, quintile, rounded, series
from .operators import calendar, classify, features, indicators, labels, mining, quality, research
from .oracles import indicator_sql
from .sources import catalog, fixture, lake, providers
from .streaming import bars as event_bars

DEV_START, DEV_END = "1995-01-01", "1999-12-31"
FEATURES = ["ret_20d", "ma_20_distance", "volatility_20d", "volume_ratio_20d"]
TARGETS = ["forward_return_5d", "forward_return_20d"]
NOW = "2002-01-01 00:00:00"

# ---- shared inputs


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return fixture.bars(spark, d)


def _features(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit(NOW).cast("timestamp")
    return features.compute(_bars(spark, d), fixture.benchmark(spark, d), fixture.benchmark(spark, d, "O"), fixture.vix(spark, d),
        calculated_at=at)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.compute(_bars(spark, d), fixture.benchmark(spark, d), calculated_at=F.lit(NOW).cast("timestamp"))


def _light(spark: SparkSession, d: str) -> DataFrame:
    """A small panel of window features and outcomes, for statistics."""
    b = features.add_adjusted(_bars(spark, d))
    c = "adjusted_close"
    b = b.withColumns({"ret_20d": change(c, lag(c, 20)), "__r": change(c, lag(c)), "ma_20_distance": change(c, mean(c, 20))})
    b = b.withColumns({"volatility_20d": F.when(F.count("__r").over(series().rowsBetween(-19, 0)) == 20, F.stddev_samp("__r")
        .over(series().rowsBetween(-19, 0)))})
    lagged = series().rowsBetween(-20, -1)
    b = b.withColumn("volume_ratio_20d",
        F.when(F.count("volume").over(lagged) == 20, F.try_divide("volume", F.avg("volume").over(lagged))))
    b = b.withColumns({f"forward_return_{h}d": change(F.lead("adj_close", h).over(series()), "adj_close") for h in (5, 20)})
    b = b.join(F.broadcast(features.vix_features(fixture.vix(spark, d)).select("date", "vix_close")), "date", "left")
    b = b.join(F.broadcast(features.benchmark_features(fixture.benchmark(spark, d), "spy").select("date", "spy_ma200_distance")),
        "date", "left")
    return b.withColumn("raw_close", F.col("close")).select("security_id", "date", "raw_close", *FEATURES, *TARGETS, "vix_close",
        "spy_ma200_distance")


BARS_SQL = """
raw AS (SELECT printf('S%06d', l_suppkey) AS security_id, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p,
  l_extendedprice / l_quantity * (1 - l_discount) AS q, l_orderkey AS k, l_linenumber AS n, l_tax AS tax, l_quantity AS size,
l_linestatus AS status FROM lineitem),
bars0 AS (SELECT security_id, date, arg_min(p, (k, n, p)) AS open, max(p) * (1 + max(tax)) AS high, min(q) * (1 - max(tax)) AS low,
arg_max(q, (k, n, q)) AS close, sum(size) AS volume FROM raw GROUP BY ALL),
bars AS (SELECT *, close * (1 - 0.02::DOUBLE * (2001 - year(date))) AS adj_close,
  CASE WHEN month(date) = 3 AND day(date) <= 7 THEN round(close * 0.01::DOUBLE, 2) ELSE 0.0 END::DOUBLE AS dividend,
  CASE WHEN dayofyear(date) = 100 AND year(date) % 3 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS stock_split, 'T' || substr(security_id, 2,
6) AS ticker_at_time FROM bars0),
mkt0 AS (SELECT date, arg_max(q, (k, n, q)) AS close FROM raw GROUP BY ALL), mkt AS (SELECT date, close * (1 - 0.02::DOUBLE * (2001
- year(date))) AS adj_close FROM mkt0),
vix AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 10000 AS close FROM orders GROUP BY 1),
adj AS (SELECT *, open * (adj_close / close) AS ao, high * (adj_close / close) AS ah, low * (adj_close / close) AS al, adj_close AS
ac FROM bars)
"""
PANEL_SQL = (
    BARS_SQL
    + """,
w1 AS (SELECT *, ac / lag(ac, 20) OVER w - 1 AS ret_20d, ac / lag(ac) OVER w - 1 AS r1,
  CASE WHEN count(ac) OVER w20 = 20 THEN ac / avg(ac) OVER w20 - 1 END AS ma_20_distance,
  CASE WHEN count(volume) OVER p20 = 20 THEN volume / avg(volume) OVER p20 END AS volume_ratio_20d,
  lead(ac, 5) OVER w / ac - 1 AS forward_return_5d, lead(ac, 20) OVER w / ac - 1 AS forward_return_20d
  FROM adj WINDOW w AS (PARTITION BY security_id ORDER BY date), w20 AS (PARTITION BY security_id ORDER BY date ROWS 19 PRECEDING),
p20 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
w2 AS (SELECT *, CASE WHEN count(r1) OVER w20 = 20 THEN stddev_samp(r1) OVER w20 END AS volatility_20d FROM w1 WINDOW w20 AS
(PARTITION BY security_id ORDER BY date ROWS 19 PRECEDING)),
mktf AS (SELECT date, adj_close / (CASE WHEN count(*) OVER m = 200 THEN avg(adj_close) OVER m END) - 1 AS spy_ma200_distance FROM
mkt WINDOW m AS (ORDER BY date ROWS 199 PRECEDING)),
panel AS (SELECT security_id, date, w2.close AS raw_close, ret_20d, ma_20_distance, volatility_20d, volume_ratio_20d,
forward_return_5d, forward_return_20d, vix.close AS vix_close, spy_ma200_distance
  FROM w2 LEFT JOIN vix USING (date) LEFT JOIN mktf USING (date))
"""
)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, panel: bool = False, digits: int = 6, bars: bool = True):
    """Register a function as a query; its doubles are rounded, and ``sql`` (after the shared tables) checks it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        name = fn.__name__.lstrip("_")
        _QUERIES[name] = lambda spark, d: rounded(fn(spark, d), digits)
        if sql is not None:
            head = f"WITH {PANEL_SQL if panel else BARS_SQL}" if bars else ""
            comma = "," if head and sql.lstrip().startswith("+") else ""
            _SQL[name] = f"{head}{comma} {sql.lstrip().lstrip('+')}"
        return fn

    return add


def _r(*columns: str, digits: int = 6) -> str:
    parts = [c.rsplit(" AS ", 1) if " AS " in c else [c, c] for c in columns]
    return ", ".join(f"round(({value}) + 3.14159265e-{digits + 3}::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}" for value, name in parts)


W = "(PARTITION BY security_id ORDER BY date)"

# ---- bars, adjustment, features, labels


@query(f"SELECT security_id, date, {_r('open', 'high', 'low', 'close', 'volume', 'adj_close', 'dividend', 'stock_split', digits=8)}, "
    f"ticker_at_time FROM bars", digits=8)
def bars(spark, d):
    """Daily bars of each security."""
    return _bars(spark, d)


@query(f"SELECT security_id, date, "
    f"{_r('ao AS adjusted_open', 'ah AS adjusted_high', 'al AS adjusted_low', 'ac AS adjusted_close', digits=8)} FROM adj", digits=8)
def adjusted_prices(spark, d):
    """Adjusted prices by the close's factor."""
    return features.add_adjusted(_bars(spark, d)).select("security_id", "date",
        *(f"adjusted_{c}" for c in ("open", "high", "low", "close")))


@query(f"SELECT security_id, date, {_r(*(f'ac / lag(ac, {n}) OVER w - 1 AS ret_{n}d' for n in features.RETURNS))} FROM adj WINDOW w "
    f"AS {W}")
def ret_windows(spark, d):
    """Returns over 1 to 60 bars."""
    b = features.add_adjusted(_bars(spark, d))
    return b.select("security_id", "date",
        *(change("adjusted_close", lag("adjusted_close", n)).alias(f"ret_{n}d") for n in features.RETURNS))


def _frames(ns) -> str:
    return ", ".join(f"w{n} AS (PARTITION BY security_id ORDER BY date ROWS {n - 1} PRECEDING)" for n in ns)


@query(f"SELECT security_id, date, "
    f"{_r(*(f'ac / (CASE WHEN count(ac) OVER w{n} = {n} THEN avg(ac) OVER w{n} END) - 1 AS ma_{n}_distance' for n in features.MEANS))} FROM adj WINDOW {_frames(features.MEANS)}")
def ma_distance(spark, d):
    """Distances from moving means."""
    return features.price_features(features.add_adjusted(_bars(spark, d))).select("security_id", "date",
        *(f"ma_{n}_distance" for n in features.MEANS))


@query(f"""+ m AS (SELECT security_id, date,
{', '.join(f'CASE WHEN count(ac) OVER w{n} = {n} THEN avg(ac) OVER w{n} END AS m{n}' for n in features.SLOPES)} FROM adj WINDOW
{_frames(features.SLOPES)})
SELECT security_id, date, {_r(*(f'm{n} / lag(m{n}, 5) OVER w - 1 AS ma_{n}_slope' for n in features.SLOPES))} FROM m WINDOW w AS {W}""")
def ma_slope(spark, d):
    """Slopes of moving means over five bars."""
    return features.price_features(features.add_adjusted(_bars(spark, d))).select("security_id", "date",
        *(f"ma_{n}_slope" for n in features.SLOPES))


@query(f"""+ r AS (SELECT security_id, date, ac / lag(ac) OVER w - 1 AS r FROM adj WINDOW w AS {W})
SELECT security_id, date,
{_r(*(f'CASE WHEN count(r) OVER w{n} = {n} THEN stddev_samp(r) OVER w{n} END AS volatility_{n}d' for n in features.SPREADS))} FROM r
WINDOW {_frames(features.SPREADS)}""")
def volatility(spark, d):
    """Deviation of returns."""
    return features.price_features(features.add_adjusted(_bars(spark, d))).select("security_id", "date",
        *(f"volatility_{n}d" for n in features.SPREADS))


@query(f"SELECT security_id, date, "
    f"{_r(*(f'CASE WHEN count(volume) OVER p{n} = {n} THEN volume / avg(volume) OVER p{n} END AS volume_ratio_{n}d' for n in features.VOLUMES))} FROM adj WINDOW {', '.join(f'p{n} AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)' for n in features.VOLUMES)}")
def volume_ratio(spark, d):
    """Volume against the mean before it."""
    return features.price_features(features.add_adjusted(_bars(spark, d))).select("security_id", "date",
        *(f"volume_ratio_{n}d" for n in features.VOLUMES))


@query(f"SELECT security_id, date, "
    f"{_r(*(f'ac / (CASE WHEN count({c}) OVER w{n} = {n} THEN {f}({c}) OVER w{n} END) - 1 AS distance_{s}_{n}d' for s, f, c in (('high', 'max', 'ah'), ('low', 'min', 'al')) for n in features.RANGES))} FROM adj WINDOW {_frames(features.RANGES)}")
def high_low_distance(spark, d):
    """Distances from rolling extremes."""
    return features.price_features(features.add_adjusted(_bars(spark, d))).select("security_id", "date",
        *(f"distance_{s}_{n}d" for s in ("high", "low") for n in features.RANGES))


@query(f"SELECT security_id, date, "
    f"{_r('ao / lag(ac) OVER w - 1 AS gap_return', 'ac / ao - 1 AS intraday_return', '(ah - al) / ac AS daily_range_pct', '(ah - greatest(ao, ac)) / ac AS upper_wick_pct', '(least(ao, ac) - al) / ac AS lower_wick_pct')} FROM adj WINDOW w AS {W}")
def candle_features(spark, d):
    """Gap, body, range and wicks."""
    return features.price_features(features.add_adjusted(_bars(spark, d))).select("security_id", "date", "gap_return",
        "intraday_return", "daily_range_pct", "upper_wick_pct", "lower_wick_pct")


RSI_SQL = f"""+ dl AS (SELECT security_id, date, ac - lag(ac) OVER w AS x, row_number() OVER w AS i FROM adj WINDOW w AS {W}),
seed AS (SELECT security_id, avg(greatest(x, 0)) AS g, avg(greatest(-x, 0)) AS l FROM dl WHERE i BETWEEN 2 AND 15 GROUP BY 1 HAVING
count(x) = 14),
rec AS (WITH RECURSIVE r AS (SELECT security_id, 15 AS i, g, l FROM seed UNION ALL SELECT r.security_id, r.i + 1, (r.g * 13 +
greatest(x, 0)) / 14, (r.l * 13 + greatest(-x, 0)) / 14 FROM r JOIN dl ON dl.security_id = r.security_id AND dl.i = r.i + 1) SELECT
* FROM r)
SELECT dl.security_id, dl.date,
{_r('CASE WHEN g IS NULL THEN NULL WHEN l = 0 THEN CASE WHEN g = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + g / l) END::DOUBLE AS rsi_14')} FROM dl LEFT JOIN rec USING (security_id, i)"""


@query(RSI_SQL)
def rsi14(spark, d):
    """Wilder's strength index over 14 bars."""
    return features.wilder_features(features.add_adjusted(_bars(spark, d))).select("security_id", "date", "rsi_14")


ATR_SQL = f"""+ t AS (SELECT security_id, date, ac, CASE WHEN lag(ac) OVER w IS NULL THEN ah - al ELSE greatest(ah - al, abs(ah -
lag(ac) OVER w), abs(al - lag(ac) OVER w)) END AS x, row_number() OVER w AS i FROM adj WINDOW w AS {W}),
seed AS (SELECT security_id, avg(x) AS a FROM t WHERE i <= 14 GROUP BY 1 HAVING count(x) = 14),
rec AS (WITH RECURSIVE r AS (SELECT security_id, 14 AS i, a FROM seed UNION ALL SELECT r.security_id, r.i + 1, (r.a * 13 + x) / 14
FROM r JOIN t ON t.security_id = r.security_id AND t.i = r.i + 1) SELECT * FROM r)
SELECT t.security_id, t.date, {_r('a AS atr_14', 'a / ac AS atr_pct_14')} FROM t LEFT JOIN rec USING (security_id, i)"""


@query(ATR_SQL)
def atr14(spark, d):
    """Wilder's mean true range over 14 bars."""
    return features.wilder_features(features.add_adjusted(_bars(spark, d))).select("security_id", "date", "atr_14", "atr_pct_14")


EMA_SQL = f"""+ x AS (SELECT security_id, date, ac, row_number() OVER w AS i FROM adj WINDOW w AS {W}),
rec AS (WITH RECURSIVE r AS (SELECT security_id, i, ac AS e12, ac AS e26 FROM x WHERE i = 1 UNION ALL SELECT x.security_id, x.i,
2.0::DOUBLE / 13 * ac + (1 - 2.0::DOUBLE / 13) * e12, 2.0::DOUBLE / 27 * ac + (1 - 2.0::DOUBLE / 27) * e26 FROM r JOIN x ON
x.security_id = r.security_id AND x.i = r.i + 1) SELECT * FROM r)
SELECT x.security_id, x.date,
{_r('CASE WHEN i >= 12 THEN e12 END AS ema_12', 'CASE WHEN i >= 26 THEN e26 END AS ema_26', 'CASE WHEN i >= 26 THEN e12 - e26 END AS macd')} FROM x JOIN rec USING (security_id, i)"""


@query(EMA_SQL)
def ind_macd_lines(spark, d):
    """Exponential means of 12 and 26 bars and their difference."""
    b = features.add_adjusted(_bars(spark, d))
    c = indicators.C
    got = kernels.per_security(b, lambda s: {"ema_12": kernels.ewm(s[c], 12), "ema_26": kernels.ewm(s[c], 26)}, [c],
        ["ema_12", "ema_26"])
    return got.select("security_id", "date", "ema_12", "ema_26", (F.col("ema_12") - F.col("ema_26")).alias("macd"))


@query(f"""+ m AS (SELECT date, adj_close / lag(adj_close, 20) OVER (ORDER BY date) - 1 AS b FROM mkt), r AS (SELECT security_id,
date, ac / lag(ac, 20) OVER w - 1 AS r FROM adj WINDOW w AS {W})
SELECT security_id, date, {_r('b AS spy_ret_20d', 'r - b AS rel_spy_20d')} FROM r LEFT JOIN m USING (date)""")
def relative_strength(spark, d):
    """Return against the market's on the same sessions."""
    b = features.add_adjusted(_bars(spark, d)).withColumn("r", change("adjusted_close", lag("adjusted_close", 20)))
    s = features.benchmark_features(fixture.benchmark(spark, d), "spy").select("date", "spy_ret_20d")
    return b.join(F.broadcast(s), "date", "left").select("security_id", "date", "spy_ret_20d", (F.col("r") - F.col("spy_ret_20d"))
        .alias("rel_spy_20d"))


@query(f"SELECT date, "
    f"{_r('close AS vix_close', 'close / lag(close, 5) OVER w - 1 AS vix_change_5d', 'close / lag(close, 20) OVER w - 1 AS vix_change_20d')} FROM vix WINDOW w AS (ORDER BY date)")
def vix_context(spark, d):
    """The volatility index and its changes."""
    return features.vix_features(fixture.vix(spark, d))


FORWARD = (f"SELECT security_id, date, "
    f"{_r(*(f'lead(ac, {h}) OVER w / ac - 1 AS forward_return_{h}d' for h in labels.HORIZONS))} FROM adj WINDOW w AS {W}")


@query(FORWARD)
def forward_returns(spark, d):
    """Forward returns over 1 to 20 bars."""
    return _labels(spark, d).select("security_id", "date", *(f"forward_return_{h}d" for h in labels.HORIZONS))


@query(f"""+ m AS (SELECT date,
{', '.join(f'lead(adj_close, {h}) OVER (ORDER BY date) / adj_close - 1 AS m{h}' for h in labels.HORIZONS)} FROM mkt),
f AS (SELECT security_id, date, {', '.join(f'lead(ac, {h}) OVER w / ac - 1 AS f{h}' for h in labels.HORIZONS)} FROM adj WINDOW w AS {W})
SELECT security_id, date, {_r(*(f'f{h} - m{h} AS forward_excess_spy_{h}d' for h in labels.HORIZONS))} FROM f LEFT JOIN m USING
(date)""")
def forward_excess(spark, d):
    """Forward returns over the market's on its own sessions."""
    return _labels(spark, d).select("security_id", "date", *(f"forward_excess_spy_{h}d" for h in labels.HORIZONS))


@query(f"SELECT security_id, date, "
    f"{_r(*(f'CASE WHEN count(ac) OVER n{h} = {h} THEN {f}(ac) OVER n{h} END / ac - 1 AS {n}_next_{h}d' for n, f in (('max_gain', 'max'), ('max_drawdown', 'min')) for h in labels.PATHS))} FROM adj WINDOW {', '.join(f'n{h} AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)' for h in labels.PATHS)}")
def path_stats(spark, d):
    """Best and worst closes ahead."""
    return _labels(spark, d).select("security_id", "date",
        *(f"{n}_next_{h}d" for n in ("max_gain", "max_drawdown") for h in labels.PATHS))


@query(f"+ f AS ({FORWARD}) SELECT * FROM (SELECT 1 AS horizon, max(date) FILTER (forward_return_1d IS NOT NULL) AS mature_until "
    f"FROM f UNION ALL SELECT 5, max(date) FILTER (forward_return_5d IS NOT NULL) FROM f UNION ALL SELECT 10, max(date) FILTER "
    f"(forward_return_10d IS NOT NULL) FROM f UNION ALL SELECT 20, max(date) FILTER (forward_return_20d IS NOT NULL) FROM f)")
def label_maturity(spark, d):
    """The last date with a known outcome, by horizon."""
    return labels.maturity(_labels(spark, d))


# ---- lake and catalogue


def _twice(spark, d):
    b = _bars(spark, d).select("security_id", "date", "close")
    first, again = b.withColumn("retrieved_at", F.lit("2002-01-01")
        .cast("timestamp")), b.filter(F.month("date") == 6).withColumn("close", F.col("close") + 1).withColumn("retrieved_at",
            F.lit("2002-01-02").cast("timestamp"))
    return first.unionByName(again)


@query(f"+ t AS (SELECT security_id, date, close, 1 AS v FROM bars UNION ALL SELECT security_id, date, close + 1, 2 FROM bars WHERE "
    f"month(date) = 6) SELECT security_id, date, {_r('arg_max(close, v) AS close', digits=8)} FROM t GROUP BY ALL", digits=8)
def lww_dedup(spark, d):
    """The last written row of each key."""
    return lake.last_write(_twice(spark, d), ["security_id", "date"], "retrieved_at").drop("retrieved_at")


@query("+ t AS (SELECT security_id, date FROM bars UNION ALL SELECT security_id, date FROM bars WHERE month(date) = 6) SELECT "
    "count(*) AS rows, count(DISTINCT security_id) AS securities, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS "
    "last, CAST(count(*) - count(DISTINCT (security_id, date)) AS BIGINT) AS duplicate_keys FROM t")
def dataset_snapshot(spark, d):
    """What a rewrite of a dataset must not change."""
    return lake.snapshot(_twice(spark, d), lake.DATASETS["prices_daily"])


@query("SELECT security_id, date AS effective_date, 'DIVIDEND' AS action_type, dividend AS value FROM bars WHERE dividend <> 0 UNION "
    "ALL SELECT security_id, date, 'SPLIT', stock_split FROM bars WHERE stock_split <> 0")
def corporate_actions_explode(spark, d):
    """Dividends and splits as rows."""
    return providers.corporate_actions(_bars(spark, d))


def _securities(spark, d):
    s, n, r = (fixture.table(spark, d, t) for t in ("supplier", "nation", "region"))
    keys = {c.lower(): c for c in n.columns}
    return s.join(n, s["s_nationkey"] == n[keys["n_nationkey"]]).select(
        F.format_string("S%06d", "s_suppkey").alias("security_id"), F.col("s_name")
            .alias("company_name"), F.when(F.col("s_nationkey") % 3 == 0, "NYSE").when(F.col("s_nationkey") % 3 == 1, "OTC")
                .alias("exchange"),
        F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("AB-P"), F.chr(F.lit(65) + F.col("s_suppkey") % 26)))
            .when(F.col("s_suppkey") % 7 == 1, F.concat(F.lit("QX"), F.chr(F.lit(65) + F.col("s_suppkey") % 26), F.lit("ZW")))
                .when(F.col("s_suppkey") % 7 == 2, F.concat(F.lit("K"), F.chr(F.lit(65) + F.col("s_suppkey") % 26), F.lit("-B")))
                    .otherwise(F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))).alias("primary_ticker"),
    )


SEC_SQL = """+ sec AS (SELECT printf('S%06d', s_suppkey) AS security_id, s_name AS company_name, CASE s_nationkey % 3 WHEN 0 THEN
'NYSE' WHEN 1 THEN 'OTC' END AS exchange,
 CASE s_suppkey % 7 WHEN 0 THEN 'AB-P' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) WHEN 1 THEN 'QX' || chr(CAST(65 + s_suppkey % 26
AS INTEGER)) || 'ZW' WHEN 2 THEN 'K' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || '-B' ELSE 'T' || CAST(s_suppkey AS VARCHAR) END
AS primary_ticker FROM supplier)"""


@query(SEC_SQL + " SELECT security_id FROM sec ORDER BY security_id IN ('S000003') DESC, sha256(security_id) LIMIT 20")
def universe_hash_topn(spark, d):
    """A stable sample by hash, with a pinned security."""
    return catalog.hash_order(_securities(spark, d).select("security_id"), 20, ["S000003"])


def _identifiers(spark, d):
    s = _securities(spark, d)
    old = s.select("security_id", F.lit("TICKER").alias("identifier_type"), F.col("primary_ticker")
        .alias("identifier_value"), F.lit("2000-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    moved = F.substring("security_id", 7, 1) == "5"
    new = s.select("security_id", F.lit("TICKER")
        .alias("identifier_type"), F.when(moved, F.concat(F.lit("N"), F.col("primary_ticker"))).otherwise(F.col("primary_ticker"))
            .alias("identifier_value"))
    return old, new


@query(SEC_SQL + """ SELECT security_id, 'TICKER' AS identifier_type, primary_ticker AS identifier_value, DATE '2000-01-01' AS
valid_from, CASE WHEN substr(security_id, 7, 1) = '5' THEN DATE '2002-01-01' END AS valid_to FROM sec
UNION ALL SELECT security_id, 'TICKER', 'N' || primary_ticker, DATE '2002-01-01', NULL FROM sec WHERE substr(security_id, 7, 1) =
'5'""")
def scd2_identifiers(spark, d):
    """Identifiers that changed close and open again."""
    return catalog.change_identifiers(*_identifiers(spark, d), "2002-01-01")


@query(SEC_SQL + """ SELECT DATE '2002-01-01' AS snapshot_date, security_id, CASE WHEN exchange = 'OTC' THEN 'new' ELSE 'old' END AS
note FROM sec""")
def snapshot_upsert(spark, d):
    """A day's snapshot written again for some securities."""
    s = _securities(spark, d)
    row = lambda df, note: df.select(F.lit("2002-01-01").cast("date").alias("snapshot_date"), "security_id", F.lit(note)
        .alias("note"))
    return catalog.upsert_snapshot(row(s, "old"), row(s.filter(F.col("exchange") == "OTC"), "new"))


@query(SEC_SQL + """ SELECT security_id, true AS prices, exchange = 'NYSE' AND exchange IS NOT NULL AS features, 'base' AS reason
FROM sec""")
def tracked_ensure(spark, d):
    """Tracked flags or-ed in, the reason kept."""
    s = _securities(spark, d)
    old = s.select("security_id", F.lit(True).alias("prices"), F.lit(False).alias("features"), F.lit("base").alias("reason"))
    new = s.filter(F.col("exchange") == "NYSE").select("security_id", F.lit(False).alias("prices"), F.lit(True)
        .alias("features"), F.lit("more").alias("reason"))
    return catalog.track(old, new, "ensure")


@query("+ l AS (SELECT security_id, max(date) AS last_date FROM bars GROUP BY 1) SELECT security_id, last_date, CASE WHEN last_date "
    ">= DATE '2001-10-25' THEN 'CURRENT' ELSE 'STALE' END AS status, CASE WHEN last_date < DATE '2001-10-25' THEN CAST(last_date - "
    "INTERVAL 3 DAY AS DATE) END AS fetch_from FROM l")
def freshness_status(spark, d):
    """How current each security's bars are."""
    b = _bars(spark, d)
    return catalog.freshness(b.select("security_id").distinct(), b, "2001-10-25")


@query("+ s AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)) SELECT a.date, b.date AS "
    "shifted FROM s a LEFT JOIN s b ON b.i = a.i + 5")
def calendar_shift(spark, d):
    """Five sessions ahead of each session."""
    c = calendar.sessions(_bars(spark, d))
    return calendar.shift(c, c, 5)


@query("+ s AS (SELECT DISTINCT date FROM bars), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT date, "
    "date IN (SELECT date FROM s) AS is_session, (SELECT max(s.date) FROM s WHERE s.date < o.date) AS previous, (SELECT min(s.date) "
    "FROM s WHERE s.date > o.date) AS next FROM o")
def calendar_neighbours(spark, d):
    """The sessions around each order date."""
    orders = fixture.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return calendar.neighbours(orders, calendar.sessions(_bars(spark, d)))


# ---- research


@query(f"""SELECT t AS target, y AS year, count(v) AS n,
{_r('avg(v) AS mean', 'median(v) AS median', 'stddev_samp(v) AS std', 'avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio', 'avg(v) / (stddev_samp(v) / sqrt(count(v))) AS t_stat', digits=5)}, count(DISTINCT date) AS n_dates,
CASE WHEN count(v) >= 1000 OR count(DISTINCT date) >= 100 THEN 'ok' ELSE 'insufficient' END AS status
FROM (SELECT unnest(['forward_return_5d', 'forward_return_20d']) AS t, unnest([forward_return_5d, forward_return_20d]) AS v, date,
year(date) AS y FROM panel) WHERE v IS NOT NULL GROUP BY GROUPING SETS ((t), (t, y))""", panel=True, digits=5)
def baseline_grouping_sets(spark, d):
    """Outcome statistics, all and by year."""
    return research.baseline(_light(spark, d), TARGETS)



NEAREST = "list_sort(list(v))[CAST(floor((count(v) - 1) * {q}::DOUBLE + 0.5) AS BIGINT) + 1]"


@query(f"""+ l AS (SELECT unnest({FEATURES}) AS feature, unnest([{', '.join(FEATURES)}]) AS v FROM panel), c AS (SELECT count(*) AS
total FROM panel)
SELECT feature, count(v) AS n, count(DISTINCT v) AS distinct,
{_r('min(v) AS min', 'max(v) AS max', *(NEAREST.format(q=q) + f' AS p{int(q * 100)}' for q in research.PROFILE), '1 - count(v)::DOUBLE / any_value(total) AS null_ratio')}, 1 - count(v)::DOUBLE / any_value(total) >= 0.3 AS high_null FROM l, c WHERE v IS NOT NULL GROUP BY feature""".replace("AS distinct", 'AS "distinct"'), panel=True)
def coverage_profile(spark, d):
    """Nulls, extremes and exact quantiles of features."""
    return research.coverage(_light(spark, d), FEATURES)


QUINTILES = """+ q AS (SELECT security_id, date, ret_20d AS v, forward_return_5d AS y, rank() OVER (PARTITION BY date ORDER BY
ret_20d) + (count(*) OVER (PARTITION BY date, ret_20d) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY date) AS n FROM panel
WHERE ret_20d IS NOT NULL),
qq AS (SELECT *, CAST(least(greatest(floor((rk - 1) / n * 5), 0), 4) + 1 AS INTEGER) AS quintile FROM q)"""


@query(QUINTILES + " SELECT security_id, date, quintile FROM qq", panel=True)
def cs_quintiles(spark, d):
    """Each day's quintiles of a feature."""
    p = _light(spark, d).filter(F.col("ret_20d").isNotNull())
    return p.select("security_id", "date", quintile("ret_20d", ["date"]).alias("quintile"))


@query(QUINTILES + f" SELECT quintile, count(y) AS n, {_r('avg(y) AS mean', 'median(y) AS median', digits=5)} FROM qq WHERE y IS NOT "
    f"NULL GROUP BY quintile", panel=True, digits=5)
def quintile_stats(spark, d):
    """Outcomes by quintile."""
    s = research.quintile_stats(_light(spark, d), ["ret_20d"], ["forward_return_5d"])
    return s.select("quintile", "n", "mean", "median")


SPREAD = (QUINTILES + ", ds AS (SELECT date, avg(y) FILTER (quintile = 5) - avg(y) FILTER (quintile = 1) AS spread FROM qq WHERE y "
    "IS NOT NULL GROUP BY date), sp AS (SELECT * FROM ds WHERE spread IS NOT NULL)")


@query(SPREAD + f" SELECT date, {_r('spread')} FROM sp", panel=True)
def overlap_spread_series(spark, d):
    """The daily spread of the outer quintiles."""
    return research.daily_spread(_light(spark, d), ["ret_20d"], "forward_return_5d").select("date", "spread")


@query(SPREAD + f""", m AS (SELECT avg(spread) AS mu, count(*) AS n FROM sp), e AS (SELECT spread - mu AS e, row_number() OVER
(ORDER BY date) AS i, n, mu FROM sp, m),
g AS (SELECT k, any_value(a.n) AS n, any_value(a.mu) AS mu, sum(a.e * b.e) / any_value(a.n) AS g FROM range(0, 6) AS t(k) JOIN e a
ON true JOIN e b ON b.i = a.i - k GROUP BY k)
SELECT 'ret_20d' AS feature, any_value(n) AS n,
{_r('any_value(mu) AS mean', 'any_value(mu) / sqrt(sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / 6.0::DOUBLE) * g END) / any_value(n)) AS nw_t', digits=5)} FROM g""", panel=True, digits=5)
def newey_west_t(spark, d):
    """Mean spread and its autocorrelation-robust t."""
    return research.newey_west(research.daily_spread(_light(spark, d), ["ret_20d"], "forward_return_5d"), "spread", 5, ["feature"])


@query(SPREAD + f", r AS (SELECT *, row_number() OVER (ORDER BY spread DESC, date) AS h, row_number() OVER (ORDER BY spread, date) "
    f"AS l FROM sp) SELECT 'ret_20d' AS feature, date, {_r('spread')}, CASE WHEN h <= 5 THEN CAST(h AS INTEGER) END AS high_rank, "
    f"CASE WHEN l <= 5 THEN CAST(l AS INTEGER) END AS low_rank FROM r WHERE h <= 5 OR l <= 5", panel=True)
def extreme_spread_dates(spark, d):
    """Dates of the largest and smallest spreads."""
    return research.extreme_dates(_light(spark, d), ["ret_20d"], "forward_return_5d")


IC = """+ x AS (SELECT date, ret_20d AS a, forward_return_5d AS b FROM panel WHERE ret_20d IS NOT NULL AND forward_return_5d IS NOT
NULL),
rk AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2.0::DOUBLE AS ra,
rank() OVER (PARTITION BY date ORDER BY b) + (count(*) OVER (PARTITION BY date, b) - 1) / 2.0::DOUBLE AS rb FROM x),
ic AS (SELECT date, count(*) AS n, CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 1e-15 THEN covar_pop(ra, rb) / (stddev_pop(ra) *
stddev_pop(rb)) END AS ic FROM rk GROUP BY date)"""


@query(IC + f" SELECT 'ret_20d' AS feature, date, {_r('ic')}, n FROM ic", panel=True)
def ic_by_date(spark, d):
    """Daily rank correlation of a feature with the outcome."""
    return research.ic_by_date(_light(spark, d), ["ret_20d"], "forward_return_5d").select("feature", "date", "ic", "n")


@query(IC + f" SELECT 'ret_20d' AS feature, count(ic) AS n_dates, "
    f"{_r('avg(ic) AS mean_ic', 'median(ic) AS median_ic', 'stddev_samp(ic) AS std_ic', 'avg(ic) / stddev_samp(ic) AS ic_ir', 'avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS positive_ratio', digits=5)} FROM ic WHERE ic IS NOT NULL", panel=True, digits=5)
def rank_ic(spark, d):
    """Summary of the daily rank correlations."""
    p = research.ic_by_date(_light(spark, d), ["ret_20d"], "forward_return_5d").filter(F.col("ic").isNotNull())
    x = F.col("ic")
    return p.groupBy("feature").agg(F.count(x).alias("n_dates"), F.avg(x).alias("mean_ic"), F.median(x)
        .alias("median_ic"), F.stddev_samp(x).alias("std_ic"), F.try_divide(F.avg(x), F.stddev_samp(x))
            .alias("ic_ir"), F.avg((x > 1e-12).cast("double")).alias("positive_ratio"))


@query(f"+ l AS (SELECT unnest(['forward_return_5d', 'forward_return_20d']) AS target, unnest([forward_return_5d, "
    f"forward_return_20d]) AS v FROM panel WHERE date BETWEEN DATE '{DEV_START}' AND DATE '{DEV_END}') SELECT target, "
    f"{_r(NEAREST.format(q=0.01) + ' AS p1', NEAREST.format(q=0.99) + ' AS p99')} FROM l WHERE v IS NOT NULL GROUP BY target",
    panel=True)
def winsor_cutoffs(spark, d):
    """Frozen 1 and 99 % bounds of the development window."""
    dev = research.in_split(_light(spark, d), "development", DEV_START, DEV_END)
    return nearest_quantiles(research.long(dev, TARGETS, "target", "value", []), "value", [0.01, 0.99],
        ["target"]).withColumnsRenamed({"q0": "p1", "q1": "p99"})


@query(f"+ v AS (SELECT vix_close AS v FROM panel WHERE vix_close IS NOT NULL AND date BETWEEN DATE '{DEV_START}' AND DATE "
    f"'{DEV_END}') SELECT {_r(NEAREST.format(q=1 / 3) + ' AS q0', NEAREST.format(q=2 / 3) + ' AS q1')} FROM v", panel=True)
def vix_terciles(spark, d):
    """Frozen terciles of the volatility index, by rows."""
    return nearest_quantiles(research.in_split(_light(spark, d), "development", DEV_START, DEV_END), "vix_close", [1 / 3, 2 / 3])


@query(f"""SELECT CASE WHEN raw_close < 1 THEN 'lt_1' WHEN raw_close < 5 THEN '1_to_5' WHEN raw_close < 20 THEN '5_to_20' ELSE
'ge_20' END AS bucket, count(y) AS n,
{_r('avg(y) AS mean', 'median(y) AS median', 'stddev_samp(y) AS std', 'avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio', 'avg(y) / (stddev_samp(y) / sqrt(count(y))) AS t_stat', 'avg(CASE WHEN abs(y) > 0.5 THEN 1.0 ELSE 0.0 END) AS extreme_share', digits=5)} FROM (SELECT *, forward_return_5d AS y FROM panel) WHERE y IS NOT NULL AND raw_close IS NOT NULL GROUP BY 1""", panel=True, digits=5)
def price_buckets(spark, d):
    """Outcomes by price bucket."""
    return research.price_sensitivity(_light(spark, d), "forward_return_5d")


@query("""+ p AS (SELECT security_id, date FROM bars), f AS (SELECT security_id, date FROM bars WHERE substr(security_id, 7, 1) <>
'1'), l AS (SELECT security_id, date FROM bars WHERE month(date) <> 12)
SELECT CASE WHEN f.date IS NOT NULL AND l.date IS NOT NULL THEN 'all_three' WHEN f.date IS NOT NULL THEN 'price_feature' WHEN l.date
IS NOT NULL THEN 'price_label' ELSE 'price_only' END AS bucket, count(*) AS n FROM p LEFT JOIN f USING (security_id, date) LEFT JOIN
l USING (security_id, date) GROUP BY 1""")
def reconcile_full_outer(spark, d):
    """Which tables have which rows."""
    b = _bars(spark, d).select("security_id", "date")
    return research.reconcile(b, b.filter(F.substring("security_id", 7, 1) != "1"), b.filter(F.month("date") != 12))


@query("SELECT security_id, date FROM bars WHERE substr(security_id, 7, 1) = '1'")
def missing_identity_anti(spark, d):
    """Bars without a feature row."""
    b = _bars(spark, d).select("security_id", "date")
    return research.missing_identity(b, b.filter(F.substring("security_id", 7, 1) != "1"))


@query("SELECT count(*) FILTER (substr(security_id, 7, 1) <> '1') AS matched, count(*) FILTER (substr(security_id, 7, 1) = '1' AND "
    "substr(security_id, 6, 1) = '0') AS expected_missing, count(*) FILTER (substr(security_id, 7, 1) = '1' AND substr(security_id, "
    "6, 1) <> '0') AS unexpected_missing FROM bars")
def price_feature_recon(spark, d):
    """Bars with and without features, by whether the security is tracked."""
    b = _bars(spark, d).select("security_id", "date")
    return research.price_feature_recon(b, b.filter(F.substring("security_id", 7, 1) != "1"),
        b.filter(F.substring("security_id", 6, 1) != "0"))


# ---- data quality


def _odd_bars(spark, d):
    """Bars with planted faults, by the date's day."""
    b, day = _bars(spark, d), F.dayofmonth("date")
    return b.withColumns({"open": F.when(day == 3, -F.col("open"))
        .otherwise(F.col("open")), "high": F.when(day == 5, F.col("low") - 1).when(day == 6, F.greatest("open", "close") - 0.0005)
            .otherwise(F.col("high")), "close": F.when(day == 9, None).otherwise(F.col("close")), "volume": F.when(day == 11, -1.0)
                .otherwise(F.col("volume"))})


ODD_SQL = """+ odd AS (SELECT security_id, date, CASE WHEN day(date) = 3 THEN -open ELSE open END AS open, CASE day(date) WHEN 5
THEN low - 1 WHEN 6 THEN greatest(open, close) - 0.0005::DOUBLE ELSE high END AS high, low, CASE WHEN day(date) = 9 THEN NULL ELSE
close END AS close, adj_close, CASE WHEN day(date) = 11 THEN -1.0::DOUBLE ELSE volume END AS volume, stock_split FROM bars)"""


@query(ODD_SQL + " SELECT security_id, date, 'NEGATIVE_PRICE' AS issue_type, 'critical' AS severity, 'open' AS details FROM odd "
    "WHERE open < 0 UNION ALL SELECT security_id, date, 'NEGATIVE_PRICE', 'critical', 'high' FROM odd WHERE high < 0 UNION ALL "
    "SELECT security_id, date, 'NEGATIVE_VOLUME', 'critical', 'volume' FROM odd WHERE volume < 0")
def dq_negative(spark, d):
    """Negative prices and volumes."""
    return quality.negative_prices(_odd_bars(spark, d))


_PAIRS = " UNION ALL ".join(f"SELECT security_id, date, '{a}<{b}' AS w, {a} AS a, {b} AS b FROM odd"
    for a, b in (("high", "open"), ("high", "close"), ("high", "low"), ("open", "low"), ("close", "low")))


@query(ODD_SQL + f", pr AS ({_PAIRS}), z AS (SELECT *, a + greatest(1e-3::DOUBLE, 1e-5::DOUBLE * greatest(abs(a), abs(b), 1)) >= b "
    f"AS near FROM pr WHERE a < b) SELECT security_id, date, CASE WHEN near THEN 'OHLC_ROUNDING_TOLERANCE' ELSE 'OHLC_INCONSISTENT' "
    f"END AS issue_type, CASE WHEN near THEN 'info' ELSE 'critical' END AS severity, w AS details FROM z")
def dq_ohlc(spark, d):
    """Prices of a bar that contradict each other."""
    return quality.ohlc_consistency(_odd_bars(spark, d))


@query("SELECT security_id, date, 'WEEKEND_DATE' AS issue_type, 'warning' AS severity, dayname(date) AS details FROM bars WHERE "
    "isodow(date) >= 6")
def dq_weekend(spark, d):
    """Bars on weekends."""
    return quality.weekend_dates(_bars(spark, d))


@query("SELECT security_id, date, 'INVALID_DATE' AS issue_type, 'critical' AS severity, '' AS details FROM bars WHERE date > DATE "
    "'2001-06-30' OR date < DATE '1990-01-01'")
def dq_invalid_date(spark, d):
    """Bars after a given day."""
    return quality.invalid_dates(_bars(spark, d), "2001-06-30")


@query(ODD_SQL + ", s AS (SELECT security_id, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM odd GROUP BY 1) "
    "SELECT security_id, CAST(NULL AS DATE) AS date, 'HIGH_NULL_RATIO' AS issue_type, 'warning' AS severity, printf('%.4f', share) "
    "AS details FROM s WHERE share > 0.03")
def dq_null_ratio(spark, d):
    """Securities with many missing closes."""
    return quality.high_null_ratio(_odd_bars(spark, d), 0.03)


@query(ODD_SQL + ", k AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM odd), z AS (SELECT *, abs(close / prev - 1) AS pct FROM k) SELECT "
    "security_id, date, CASE WHEN stock_split <> 0 AND pct >= 0.45 THEN 'SUSPECTED_SPLIT_ADJUSTMENT' ELSE 'SUDDEN_PRICE_CHANGE' END "
    "AS issue_type, CASE WHEN stock_split <> 0 AND pct >= 0.45 THEN 'info' ELSE 'warning' END AS severity FROM z WHERE (stock_split "
    "<> 0 AND pct >= 0.45) OR pct >= 0.8")
def dq_sudden_change(spark, d):
    """Sudden moves, and those that a split explains."""
    return quality.sudden_changes(_odd_bars(spark, d)).drop("details")


@query("+ t AS (SELECT security_id, date FROM bars UNION ALL SELECT security_id, date FROM bars WHERE day(date) = 4) SELECT "
    "security_id, date, 'DUPLICATE_KEY' AS issue_type, 'critical' AS severity, 'rows=' || CAST(count(*) AS VARCHAR) AS details FROM "
    "t GROUP BY security_id, date HAVING count(*) > 1")
def dq_duplicate_key(spark, d):
    """Keys that come more than once."""
    b = _bars(spark, d).select("security_id", "date")
    return quality.duplicate_keys(b.unionByName(b.filter(F.dayofmonth("date") == 4)), ["security_id", "date"])


def _issue_tables(spark, d):
    found = quality.negative_prices(_odd_bars(spark, d))
    empty = spark.createDataFrame([],
        "issue_id string, dataset string, security_id string, date date, issue_type string, severity string, details string, "
        "detected_at string, resolved boolean")
    first = quality.upsert_issues(empty, found.filter(F.year("date") < 1998), "prices_daily", "2002-01-01")
    return first, found


_OPEN = ("issue AS (SELECT security_id, date, 'NEGATIVE_PRICE' AS issue_type FROM odd WHERE open < 0 UNION SELECT security_id, date, "
    "'NEGATIVE_PRICE' FROM odd WHERE high < 0 UNION SELECT security_id, date, 'NEGATIVE_VOLUME' FROM odd WHERE volume < 0)")


@query(ODD_SQL + f", {_OPEN} SELECT substr(sha256('prices_daily|' || security_id || '|' || CAST(date AS VARCHAR) || '|' || "
    f"issue_type), 1, 32) AS issue_id, CASE WHEN year(date) < 1998 THEN '2002-01-01' ELSE '2002-02-01' END AS detected_at, false AS "
    f"resolved FROM issue")
def issue_upsert(spark, d):
    """Issues merged into stored ones under their ids."""
    first, found = _issue_tables(spark, d)
    return quality.upsert_issues(first, found, "prices_daily", "2002-02-01").select("issue_id", "detected_at", "resolved")


@query(ODD_SQL + f", {_OPEN} SELECT substr(sha256('prices_daily|' || security_id || '|' || CAST(date AS VARCHAR) || '|' || "
    f"issue_type), 1, 32) AS issue_id, year(date) < 1997 AS resolved FROM issue WHERE year(date) < 1998")
def issue_resolve(spark, d):
    """Stored issues that weren't found again."""
    first, found = _issue_tables(spark, d)
    return quality.resolve_missing(first, found.filter(F.year("date") >= 1997), "prices_daily", _bars(spark, d)).select("issue_id",
        "resolved")


# ---- indicators: each family by itself


def _family(id: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = indicators.compute(_bars(spark, d), ids=[id]).drop(*indicators.BASE[2:])
        return rounded(made, indicator_sql.digits(id))

    run.__doc__ = f"The {id} indicators."
    return run


for _spec in indicators.specs():
    _QUERIES[f"ind_{_spec.id}"] = _family(_spec.id)
_SQL |= {f"ind_{name}": text for name, text in indicator_sql.sql(BARS_SQL).items()}

# ---- mining: see mining_queries


@query("""SELECT pattern, p, round(min(x) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) +
3.14159265e-9::DOUBLE, 6) + 0.0::DOUBLE AS q FROM (SELECT pattern, p, r, least(p * count(*) OVER () / r, 1.0) AS x FROM (SELECT
CAST(n_nationkey AS VARCHAR) AS pattern, (n_nationkey * 7 % 25 + 1) / 30.0::DOUBLE AS p, row_number() OVER (ORDER BY n_nationkey * 7
% 25) AS r FROM nation))""".replace("pattern, p, round", "pattern, round(p + 3.14159265e-9::DOUBLE, 6) + 0.0::DOUBLE AS p, round"),
    bars=False)
def bh_fdr(spark, d):
    """Benjamini-Hochberg q values."""
    n = fixture.table(spark, d, "nation")
    k = next(c for c in n.columns if c.lower() == "n_nationkey")
    return mining.benjamini_hochberg(n.select(F.col(k).cast("string").alias("pattern"), ((F.col(k) * 7 % 25 + 1) / 30.0).alias("p")))


# ---- event bars


@query("SELECT event_type AS security_id, CAST(ts AS DATE) AS "
    "date, " + _r("arg_min(value, (ts, event_id)) AS open", "max(value) AS high", "min(value) AS low",
    "arg_max(value, (ts, event_id)) AS close") + ", CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2", bars=False)
def event_bars_daily(spark, d):
    """Daily bars of events, as the streaming plan makes them."""
    return event_bars.bars(fixture.table(spark, d, "events")).drop("retrieved_at")


@query(f"""+ m AS (SELECT date, adj_close / lag(adj_close, 20) OVER (ORDER BY date) - 1 AS b FROM mkt), z AS (SELECT *, lag(ac) OVER
w AS pc FROM adj WINDOW w AS {W}), r AS (SELECT *, ac / pc - 1 AS r1 FROM z)
SELECT security_id, date,
{_r('ac / (CASE WHEN count(ac) OVER w20 = 20 THEN avg(ac) OVER w20 END) - 1 AS ma_20_distance', 'CASE WHEN count(r1) OVER w20 = 20 THEN stddev_samp(r1) OVER w20 END AS volatility_20d', 'CASE WHEN count(volume) OVER p20 = 20 THEN volume / avg(volume) OVER p20 END AS volume_ratio_20d', 'ac / lag(ac, 20) OVER w - 1 - b AS rel_spy_20d')} FROM r LEFT JOIN m USING (date) WINDOW w AS {W}, w20 AS (PARTITION BY security_id ORDER BY date ROWS 19 PRECEDING), p20 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def flagship(spark, d):
    """Distance, volatility, volume and relative strength of every bar."""
    b = features.price_features(features.add_adjusted(_bars(spark, d)))
    s = features.benchmark_features(fixture.benchmark(spark, d), "spy").select("date", "spy_ret_20d")
    return b.join(F.broadcast(s), "date", "left").select("security_id", "date", "ma_20_distance", "volatility_20d",
        "volume_ratio_20d", (F.col("ret_20d") - F.col("spy_ret_20d")).alias("rel_spy_20d"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import mining_queries, panel_queries  # noqa: F401, PLC0415: they register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
