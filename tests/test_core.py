"""Hand-calculated values, causality, lake and catalogue behaviour, and the registered queries against SQL."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave import queries
from barweave.functions import kernels
from barweave.functions.windows import medians, nearest_quantiles, pearson
from barweave.operators import features, indicators, labels, mining, quality, research
from barweave.sources import catalog, lake, providers

DAY = dt.date(2024, 1, 2)


def prices(spark, closes, sid="S1", **over):
    rows = [(sid, "T", DAY + dt.timedelta(days=i), c, c + 1, c - 1, c, c, 1000.0, 0.0, 0.0) for i, c in enumerate(map(float, closes))]
    df = spark.createDataFrame(rows,
        "security_id string, ticker_at_time string, date date, open double, high double, low double, close double, adj_close double, "
        "volume double, dividend double, stock_split double")
    return df.withColumns(over)


def test_wilder_values():
    assert kernels.rsi(np.array([10.0, 12, 11, 13]), 2)[2:].round(2).tolist() == [66.67, 85.71]
    got = kernels.atr(np.array([11.0, 13, 12, 14]), np.array([9.0, 10, 10, 12]), np.array([10.0, 12, 11, 13]), 2)
    assert got[1:].tolist() == [2.5, 2.25, 2.625]
    assert np.isnan(kernels.rsi(np.array([1.0, np.nan, 2, 3, 4]), 2)).all()
    assert kernels.rsi(np.full(5, 3.0), 2)[-1] == 50


def test_path_and_forward_labels(spark):
    b = prices(spark, [100, 110, 90, 120, 80, 105])
    got = labels.compute(b, b).orderBy("date").first()
    assert got.max_gain_next_5d == pytest.approx(0.2) and got.max_drawdown_next_5d == pytest.approx(-0.2)
    assert got.forward_return_1d == pytest.approx(0.1) and got.forward_return_20d is None and got.forward_excess_spy_1d == pytest.approx(0)


def test_adjustment_and_masks(spark):
    b = prices(spark, [100, 100, 50], adj_close=F.lit(50.0))
    assert [r.adjusted_open for r in features.add_adjusted(b).orderBy("date").collect()] == [50, 50, 50]
    bad = features.add_adjusted(prices(spark, [10, 0, 10], adj_close=F.when(F.col("close") > 0, F.lit(float("nan"))).otherwise(1.0)))
    assert bad.filter("adjusted_close is not null").count() == 0
    mask = prices(spark, [10, 10], high=F.when(F.col("date") == F.lit(DAY), F.col("low") - 1).otherwise(F.col("high") - 1.0001))
    assert [r[0] for r in mask.orderBy("date").select(features.ohlc_valid()).collect()] == [False, True]


def test_features_look_back_only(spark):
    rng = np.random.default_rng(1)
    closes = (100 + rng.normal(size=260).cumsum()).tolist()
    vix = prices(spark, closes).select("date", "close")
    cut = DAY + dt.timedelta(days=220)
    rows = {}
    for name, tail in (("a", 1.0), ("b", 3.0)):
        b = prices(spark, [c if i <= 220 else c * tail for i, c in enumerate(closes)])
        f = features.compute(b, b, b, vix, calculated_at=F.lit("2024-01-01").cast("timestamp"))
        rows[name] = [tuple(r) for r in f.filter(F.col("date") <= F.lit(cut)).orderBy("date").collect()]
    assert rows["a"] == rows["b"] and len(features.VALUES) == 52
    assert labels.compute(b, b).columns[6:] == labels.VALUES and len(labels.VALUES) == 16


def test_indicator_bounds_and_causality(spark):
    assert len(indicators.specs()) == 64 and "visual_chikou" not in {s.id for s in indicators.specs(mining_only=True)}
    rng = np.random.default_rng(2)
    closes = (100 + rng.normal(size=300).cumsum()).tolist()
    base = prices(spark, closes)
    got = indicators.compute(base, ["momentum", "volatility", "ichimoku"]).toPandas()
    assert got.rsi_14.dropna().between(0,
        100).all() and (got.bb_20_2_upper.dropna() >= got.bb_20_2_lower.dropna()).all() and (got.cloud_top.dropna() >= got.cloud_bottom.dropna()).all()
    changed = indicators.compute(prices(spark, closes[:250] + [c * 2 for c in closes[250:]]), ["momentum", "volatility"]).toPandas()
    same = [c for c in changed.columns if c in got]
    a, b = (x.sort_values("date").head(250)[same].reset_index(drop=True) for x in (got, changed))
    assert a.equals(b)
    with pytest.raises(RuntimeError):
        indicators.refuse_to_persist()


def test_breakout_on_a_ramp(spark):
    got = indicators.compute(prices(spark, range(100, 130)), ["volatility"], ["donchian"]).orderBy("date").toPandas()
    assert not got.donchian_20_breakout_up.head(20).any() and got.donchian_20_lower.tail(1).item() == 109


def test_recursive_kernels_take_no_number_of_an_array_at_a_time():
    """That costs several times what a list's numbers do."""

    class Whole(np.ndarray):
        def __getitem__(self, at):
            assert not isinstance(at, (int, np.integer))
            return super().__getitem__(at)

    x = np.abs(np.random.default_rng(3).normal(0, 1, 80).cumsum()) + 50
    x[30] = np.nan
    whole = x.view(Whole)
    assert np.array_equal(kernels.wilder(whole, 5, 1), kernels.wilder(x, 5, 1), equal_nan=True)
    for kernel in (lambda c: kernels.supertrend(x + 1, x - 1, c, 10, 3), lambda c: [kernels.ewm(c, 12)]):
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(kernel(whole), kernel(x)))


def test_kernels():
    x = np.arange(1.0, 9)
    assert kernels.ewm(x, 3)[2] == 2.25 and np.isnan(kernels.ewm(x, 3)[:2]).all()
    assert kernels.ema_seeded(x, 3)[2:4].tolist() == [2, 3]
    assert kernels.cooldown(np.array([1, 1, 0, 1, 0, 0, 1.0]), 2).tolist() == [1, 0, 0, 1, 0, 0, 1]
    line, way = kernels.supertrend(x + 1, x - 1, x, 3, 2)
    assert set(way[np.isfinite(way)]) == {1.0}
    stop, way = kernels.parabolic(np.r_[x, x[::-1]] + 1, np.r_[x, x[::-1]] - 1)
    assert way[0] == 1 and way[-1] == -1 and stop[0] == 0


def test_nearest_quantiles_and_correlation(spark):
    rng = random.Random(4)
    values = [rng.choice([None, *range(50)]) for _ in range(300)]
    df = spark.createDataFrame([(i % 2, None if v is None else float(v)) for i, v in enumerate(values)], "g int, v double")
    qs = [0.0, 0.01, 0.2, 1 / 3, 0.5, 0.99, 1.0]
    for by in ([], ["g"]):
        for r in nearest_quantiles(df, "v", qs, by).collect():
            s = sorted(v for i, v in enumerate(values) if v is not None and (not by or i % 2 == r["g"]))
            assert [r[f"q{i}"] for i in range(len(qs))] == [s[int((len(s) - 1) * q + 0.5)] for q in qs]
    assert df.agg(pearson("v", F.lit(1.0))).first()[0] is None


def test_newey_west_and_fdr(spark):
    d = [0.3, -0.1, 0.4, 0.2, -0.2, 0.5]
    df = spark.createDataFrame([("f", DAY + dt.timedelta(days=i), v) for i, v in enumerate(d)], "feature string, date date, v double")
    x = np.array(d) - np.mean(d)
    n, lag = len(d), 2
    g = [float((x[k:] * x[: n - k]).sum() / n) for k in range(lag + 1)]
    v = g[0] + 2 * sum((1 - k / (lag + 1)) * g[k] for k in (1, 2))
    assert research.newey_west(df, "v", lag, ["feature"]).first().nw_t == pytest.approx(np.mean(d) / np.sqrt(v / n))
    assert research.newey_west(df.limit(2), "v", lag, ["feature"]).first().nw_t is None
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "pattern string, p double")
    assert {r.pattern: r.q for r in mining.benjamini_hochberg(p)
        .collect()} == {"a": pytest.approx(0.03), "b": pytest.approx(0.04), "c": pytest.approx(0.04), "d": None}
    assert mining.normal_p(1.96) == pytest.approx(0.05, abs=1e-3) and mining.normal_p(None) is None


def test_entries_and_reasons(spark):
    df = prices(spark, range(10)).withColumn("on", F.col("close").isin(1, 2, 4, 5, 9))
    got = mining.frequency(df, "on", 2).first()
    assert (got.flag_rows, got.entries, got.kept, got.episodes) == (5, 3, 3, 3)
    assert mining.frequency(df, "on AND missing", 2).first().flag_rows == 0
    assert mining.activate(df, "on", "entry", 4).count() == 2
    parts = mining.folds("2026-12-31", mining.yearly_folds(["2020-12-31", "2025-12-31"], "2018-01-02"))
    assert [(f["eval_start"], f["eval_end"]) for f in parts] == [("2021-01-01", "2021-12-31"), ("2026-01-01", "2026-09-20")]
    assert [f["fold"] for f in mining.folds("2026-05-01")] == [f[0]
        for f in mining.FOLDS] and mining.folds("2025-12-01")[-1]["fold"] == "fold5_eval_2025"


def test_lake_round_trip(spark, tmp_path):
    store, d = lake.Lake(spark, f"file://{tmp_path}/lake"), lake.DATASETS["prices_daily"]
    row = lambda v, at: spark.createDataFrame([("S1", DAY, v, at), ("S1", DAY + dt.timedelta(days=40), 7.0, at)],
        "security_id string, date date, close double, retrieved_at string").withColumn("retrieved_at",
        F.to_timestamp("retrieved_at"))
    assert not store.exists(d) and store.append(d, row(1.0, "2024-01-01 00:00:00").limit(0)) == 0
    store.append(d, row(10.0, "2024-03-01 00:00:00"))
    store.append(d, row(10.5, "2024-03-01 01:00:00"))
    assert store.view(d).count() == 2 and store.raw(d).count() == 4 and store.stats(d).first().duplicate_keys == 2
    assert {r.close for r in store.view(d, "2024-01-01", "2024-01-31").collect()} == {10.5}
    assert store.compact(d,
        dry_run=True)["partitions"] == 2 and store.compact(d)["rows_after"] == 2 and store.compact(d)["partitions"] == 0
    assert store.raw(d).count() == 2 and store.layout(d) == "month" and store.create_views() == ["prices_daily"]
    assert store.to_yearly(d) == {"rows": 2} and store.layout(d) == "year"
    assert store.raw(d).count() == 2 and not any(h["needs_compaction"] for h in store.health(d))


def test_cut_off_rewrites_recover(spark, tmp_path):
    store, d = lake.Lake(spark, f"file://{tmp_path}/lake"), lake.DATASETS["prices_daily"]
    rows = spark.createDataFrame([("S1", DAY, 1.0)], "security_id string, date date, close double")
    store.append(d, rows.withColumn("retrieved_at", F.current_timestamp()))
    base = tmp_path / "lake"
    (base / "_staging" / "x").mkdir(parents=True)
    (base / "_backup").mkdir()
    (base / "prices_daily" / "year=2024" / "month=1").rename(base / "_backup" / "prices_daily%2Fyear%3D2024%2Fmonth%3D1")
    (base / "_backup" / "prices_daily%2Fyear%3D2024").mkdir()
    assert not store.exists(d)
    assert store.recover() == {"restored": ["prices_daily/year=2024/month=1"], "dropped": ["prices_daily/year=2024"]}
    assert store.raw(d).count() == 1 and not (base / "_staging").exists()
    assert store.partition(d, year=2024, month=1).count() == 1 and store.health(d)[0]["rows"] == 1
    for call in (lambda: store.partition(d, year=2024), lambda: store.compact(d, month=1), lambda: store.append(d, rows.withColumn("date", F.lit(None).cast("date")))):
        with pytest.raises(Exception):
            call()


def test_flat_and_tied_bars(spark):
    """Bars without any move: extremes are met again, nothing has a direction, and flat bars void money flow."""
    flat = prices(spark, [100.0] * 300).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    got = indicators.compute(flat).orderBy("date").toPandas()
    last = got.iloc[-1]
    assert last.new_high_252 and last.new_low_252 and not last.prior_high_breakout_20 and last.price_position_252 == 1.0
    assert got.dx_14.isna().all() and got.adx_14.isna().all() and got.cmf_20.isna().all() and (got.ad_line == 0).all()
    assert last.rsi_14 == 50 and last.cmo_14 == 0 and last.sma_20_direction == 0 and pd.isna(last.linreg_r2_20) and last.linreg_slope_20 == 0
    assert got.volatility_percentile_60.notna().sum() == 300 - 59 and got.volume_percentile_60.notna().sum() == 241
    on = got.squeeze_on.notna()
    assert got.squeeze_release[on].notna().all() and not got.squeeze_release[on].iloc[0]


def test_families_without_recursion_have_no_python(spark):
    base = prices(spark, range(100, 140))
    for id, recursive in (("sma", False), ("bollinger", False), ("linreg", False), ("obv", False), ("macd", True), ("keltner", True)):
        plan = indicators.compute(base, ids=[id])._jdf.queryExecution().executedPlan().toString()
        assert ("FlatMapGroupsInArrow" in plan) == recursive, id


def test_lines_cost_the_same_for_any_length_and_keep_small_moves(spark):
    x = 1e8 + np.random.default_rng(5).normal(size=150)
    gap = {c: F.when(F.col("date") != DAY + dt.timedelta(days=10), F.col(c)) for c in ("close", "adj_close")}
    got = indicators.compute(prices(spark, x, **gap), ids=["linreg"])
    x[10] = np.nan
    assert "RowFrame, -119" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.orderBy("date").toPandas()
    for n in (20, 60, 120):
        for at in range(150):
            if at < n - 1 or np.isnan(x[at - n + 1 : at + 1]).any():
                assert pd.isna(rows[f"linreg_slope_{n}"][at]) and pd.isna(rows[f"corr_time_{n}"][at])
            else:
                t, y = np.arange(n) - (n - 1) / 2, x[at - n + 1 : at + 1] - 1e8
                slope, r = (t @ y) / (t @ t), np.corrcoef(t, y)[0, 1]
                assert rows[f"linreg_slope_{n}"][at] == pytest.approx(slope, rel=1e-6, abs=1e-7)
                assert rows[f"corr_time_{n}"][at] == pytest.approx(r, rel=1e-6, abs=1e-7)


def test_catalogue(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    schema = "security_id string, prices boolean, features boolean, reason string"
    old = c.read("tracked", schema)
    c.replace("tracked", catalog.track(old, spark.createDataFrame([("A", True, False, "x")], schema)))
    new = spark.createDataFrame([("A", False, True, "y"), ("B", True, True, "z")], schema)
    got = {m: {r.security_id: tuple(r)[1:] for r in catalog.track(c.read("tracked"), new, m).collect()}["A"]
        for m in ("ensure", "add", "if_absent")}
    assert got == {"ensure": (True, True, "x"), "add": (False, True, "y"), "if_absent": (True, False, "x")}
    for _ in range(7):
        c.replace("many", spark.range(1))
    assert c.version("many") == 7 and len(list((tmp_path / "cat" / "many").iterdir())) == c.kept
    assert c.attach() == ["many", "tracked"] and catalog.untrack(c.read("tracked"), ["A"]).first().prices is False
    assert catalog.job_key("j", a=1) == catalog.job_key("j", a=1) != catalog.job_key("j", a=2) and len(catalog.job_key("j")) == 18
    with pytest.raises(PermissionError):
        providers.license_guard("csv_prices", True)


def test_providers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,open,high,low,close,adj_close,volume,dividend,stock_split\n2024-01-02,1,2,0.5,,1.5,10,,\n2024-01-02,1,2,0.5,1.2,1.5,10,0.1,2\nbad,1,1,1,1,1,1,0,0\n")
    got = providers.normalise_prices(providers.read_price_csv(spark, f"file://{tmp_path}/p.csv"), "S1", "T", retrieved_at="2024-01-03")
    assert got.count() == 1 and got.first().close == 1.2 and providers.corporate_actions(got).count() == 2
    (tmp_path / "v.csv").write_text("DATE,OPEN,HIGH,LOW,CLOSE\n01/02/2024,13,14,12,13.5\n01/03/2024,,x,.,14\n")
    vix = providers.read_vix_csv(spark, f"file://{tmp_path}/v.csv").orderBy("date").collect()
    assert (vix[0].close, vix[1].open, vix[1].high) == (13.5, None, None) and vix[0].date == DAY
    (tmp_path / "m.json").write_text('{"fields":["cik","name","ticker","exchange"],"data":[["1","A","AA","NYSE"],["1","A","A.B",null],["2","B","bb","OTC"]]}')
    u = providers.normalise_universe(providers.read_security_master(spark, f"file://{tmp_path}/m.json"), "2024-01-02")
    assert {r.security_id for r in u["securities"].collect()} == {"CIK0000000001-AA", "CIK0000000001-AB",
        "CIK0000000002"} and u["identifiers"].count() == 6


def test_issues_reopen(spark):
    found = quality.negative_prices(prices(spark, [-1, 2]))
    empty = spark.createDataFrame([],
        "issue_id string, dataset string, security_id string, date date, issue_type string, severity string, details string, "
        "detected_at string, resolved boolean")
    one = quality.upsert_issues(empty, found, "p", "t1")
    done = quality.resolve_missing(one, found.limit(0), "p", prices(spark, [1]))
    assert {r.resolved for r in one.collect()} == {False} and {r.resolved for r in done.collect()} == {True}
    again = quality.upsert_issues(done, found, "p", "t2").collect()
    assert {(r.resolved, r.detected_at) for r in again} == {(False, "t1")} and all(len(r.issue_id) == 32 for r in again)


def test_stream_appends_once(spark, tmp_path, sf):
    from barweave.streaming import bars

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    store, d = lake.Lake(spark, f"file://{tmp_path}/lake"), lake.DATASETS["prices_daily"]
    stream = bars.bars(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    for _ in range(2):
        bars.append_to(stream, lambda df: store.append(d, df), f"{tmp_path}/ck").awaitTermination()
    whole = bars.bars(events)
    got = store.view(d).drop("year", "month")
    assert 0 < got.count() <= whole.count() and got.count() == store.raw(d).count()
    assert got.select("security_id", "date", "open", "high", "low", "close",
        "volume").subtract(whole.select("security_id", "date", "open", "high", "low", "close", "volume")).count() == 0


SAMPLE = ["bars", "adjusted_prices", "ma_slope", "rsi14", "atr14", "forward_excess", "path_stats", "lww_dedup", "scd2_identifiers",
    "classify_instruments", "calendar_neighbours", "cs_quintiles", "newey_west_t", "coverage_profile", "dq_ohlc", "issue_upsert",
    "cooldown", "pattern_scores", "event_bars_daily", "flagship"]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    cols = [c[0] for c in con.description]
    got = [tuple(r[c] for c in cols) for r in queries.queries()[name](spark, sf).collect()]
    plain = lambda rows: sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        for v in r) for r in rows)
    assert plain(got) == plain(want)


def test_null_ratio_shows_exact_halves_to_even(spark):
    rows = [("A", None if i < 1 else 1.0) for i in range(32)] + [("B", None if i < 3 else 1.0) for i in range(32)]
    rows += [("C", None if i < 667 else 1.0) for i in range(20000)]  # 0.03335 in binary is a little less
    got = quality.high_null_ratio(spark.createDataFrame(rows, "security_id string, close double"), 0.03)
    assert {r.security_id: r.details for r in got.collect()} == {"A": "%.4f" % (1 / 32), "B": "%.4f" % (3 / 32), "C": "%.4f" % 0.03335}


def test_symbols_that_several_securities_share(spark, tmp_path):
    import duckdb

    keys = "s_suppkey long, s_name string, s_nationkey int"
    spark.createDataFrame([(k, f"s{k}", 1) for k in (133, 315, 497, 140, 141)], keys).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, "r")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["resolve_symbols"]).fetchall()
    got = queries.queries()["resolve_symbols"](spark, str(tmp_path)).select("ticker", "security_id", "how").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ("NAB-PD", "S000133", "history") in want


def test_medians_of_large_groups_are_exact(spark):
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(size=30001), "b": np.r_[np.zeros(20000), rng.normal(size=12000)], "c": np.array([1.0, 4.0])}
    rows = [(k, float(v)) for k, values in x.items() for v in values] + [("a", None), ("d", None), (None, 7.0)]
    got = medians(spark.createDataFrame(rows, "k string, v double"), "v", ["k"])
    assert {r.k: r.median for r in got.collect()} == {k: pytest.approx(float(np.median(v))) for k, v in x.items()} | {None: 7.0}
    assert "median(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_one_family_is_all_that_a_state_needs(spark, sf):
    from barweave import mining_queries

    plan = mining_queries._stated(spark, sf, ["bb_above_upper"], False)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "Join" not in plan
    kept = indicators.pruned(indicators.merged([indicators.get("rsi"), indicators.get("sma")]), {"rsi14_le_30", "sma20_above_sma50"})
    assert list(kept.folds) == [("rsi_14",)] and set(kept.stages[0]) == {"rsi14_le_30", "sma_20", "sma_50"}
