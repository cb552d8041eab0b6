"""Scores of states and pairs from packed rows, against rows that are repeated a pattern."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave import mining_queries
from barweave.functions.windows import column_quantiles, nearest_quantiles
from barweave.operators import mining, research



def _random_frame(spark, n=3000):
    rng = np.random.default_rng(11)
    names = [s.name for s in mining.STATES]
    on = rng.random((n, len(names))) < rng.choice([0.02, 0.3, 0.7], len(names))
    y = np.where(rng.random(n) < 0.3, 0.25, rng.normal(size=n))
    rows = [(f"S{i % 40}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 40), None if i % 7 == 0 else float(y[i]),
        None if i % 5 == 0 else float(y[i] * 2 + 1), *map(bool, on[i])) for i in range(n)]
    schema = "security_id string, date date, forward_return_20d double, forward_excess_spy_20d double, "
    return spark.createDataFrame(rows, schema + ", ".join(f"{c} boolean" for c in names)).repartition(3)


def _no_rows_a_pattern(*_, **__):
    raise AssertionError("a row was repeated for every pattern that holds in it")


@pytest.mark.parametrize("target, excess", [("forward_return_20d", None), ("forward_return_20d", "forward_excess_spy_20d")])
def test_scores_are_those_of_repeated_rows(spark, monkeypatch, target, excess):
    """packed rows give what rows repeated a pattern give, and aren't repeated."""
    df = _random_frame(spark)
    states, bounds = mining.base_states(set(df.columns)), (-1.0, 1.5)
    assert len(states) == len(mining.STATES)
    found = mining.hits(df, states, target, excess)
    want = mining.pattern_stats(found, mining.daily_baseline(df, target), 20, research.clipped("y", bounds)).toPandas()
    monkeypatch.setattr(mining, "hits", _no_rows_a_pattern)
    got = mining.score(df, states, target, excess, bounds).toPandas()
    order = lambda x: x.sort_values("pattern").reset_index(drop=True)[["pattern", *mining.STATS]]
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-9, atol=1e-12)
    few = mining.score(df, states, target, excess, bounds, wanted=["hammer", "hammer AND bullish_engulfing"]).toPandas()
    assert set(few.pattern) <= {"hammer", "hammer AND bullish_engulfing"} and len(few)


def test_quantiles_of_columns_are_exact(spark, monkeypatch):
    """cutoffs and bounds come from brackets; no column's values are all shuffled."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=30011), np.r_[np.zeros(20000), rng.normal(size=9000), np.full(1000, np.nan), np.full(11, np.inf)]
    rows = [(float(x), float(y), None if i % 400 else i) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c int").withColumn("d", F.lit(None).cast("double"))
    at = [0.0, 0.01, 0.2, 0.5, 0.8, 0.99, 1.0]
    got = column_quantiles(df, ["a", "b", "c", "d"], at)
    for c in ("a", "b", "c"):
        known = df.select(F.col(c).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
        row = nearest_quantiles(known, "v", at).first()
        assert got[c] == (known.count(), [row[f"q{i}"] for i in range(len(at))]), c
    assert got["d"] == (0, [None] * len(at))

    def refused(*_, **__):
        raise AssertionError("all values were shuffled")

    monkeypatch.setattr(mining, "nearest_quantiles", refused)
    frozen = mining.freeze(df.withColumnsRenamed({"a": "natr_14", "b": "adx_14"}))
    assert frozen["natr_14"]["q20"] == got["a"][1][2] and frozen["adx_14"]["q80"] == got["b"][1][4]
    assert mining.bounds_of(df, "a") == (got["a"][1][1], got["a"][1][5])


def test_frame_holds_what_is_read(spark, sf):
    """of folds only what is read goes through the second shuffle, and of the frame only flags, cutoff columns and the outcome."""
    plan = mining_queries._flags(mining_queries._frame(spark, sf, priced=False), tuple(mining_queries.SOURCES))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\b(minus_di_14|dx_14|supertrend_10_3|raw_close)#", text)
    assert "adx_14" in text and [c for c, t in plan.dtypes if t == "double"] == [mining_queries.TARGET, *mining_queries.SOURCES]


@pytest.fixture(scope="module")
def discovered(spark):
    """A discovery over all states and pairs without any row repeated a pattern."""
    df = _random_frame(spark).withColumn("natr_14", F.rand(3)).localCheckpoint()
    support = mining.Support(rows=20, dates=5, securities=3)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mining, "hits", _no_rows_a_pattern)
        return df, mining.discover(df, "forward_excess_spy_20d", "2024-01-01", "2024-02-20", support), support


def test_summary_counts_every_pattern(discovered):
    """what was generated, supported and tested, by hand."""
    df, found, support = discovered
    rows = df.filter(F.col("date") <= F.lit("2024-02-20").cast("date")).toPandas()
    for c, cuts in found.frozen.items():
        rows[f"analysis_q_{c}_le_q20"], rows[f"analysis_q_{c}_ge_q80"] = rows[c] <= cuts["q20"], rows[c] >= cuts["q80"]
    known = rows.forward_excess_spy_20d.notna()

    def fits(on):
        inside = rows[on & known]
        return on.sum() >= support.rows and inside.date.nunique() >= support.dates and inside.security_id.nunique() >= support.securities

    ok = [s.name for s in found.states if fits(rows[s.name])]
    pairs = [(a, b) for a, b in mining.pairs_of(found.states) if a in ok and b in ok]
    both = [p for p in pairs if fits(rows[p[0]] & rows[p[1]])]
    got = mining.selection_summary(found, support)
    assert len(found.states) == len(mining.STATES) + 2 and 0 < len(both) < len(pairs)
    assert (got["n_generated_singles"], got["n_support_passed_singles"], got["n_generated_pairs"], got["n_support_passed_pairs"]) == (
        len(found.states), len(ok), len(pairs), len(both))
    assert got["n_statistical_tests"] == len(ok) + len(both)


def test_evaluation_repeats_no_row(discovered, monkeypatch):
    """every selected pattern on later days, medians and counts by hand."""
    df, found, _ = discovered
    chosen = [r for r in found.rows if r["sample_status"] == "ok"][::9]
    for r in chosen:
        r["selected"] = True
    monkeypatch.setattr(mining, "hits", _no_rows_a_pattern)
    got = mining.evaluate(df, found, "forward_excess_spy_20d", "2024-02-21").toPandas().set_index("pattern")
    rows = mining.apply_states(df, found.states).filter(F.col("date") >= F.lit("2024-02-21").cast("date")).toPandas()
    assert set(got.index) == set(found.selected) and len(got) >= len(chosen) > 10
    for p in got.index:
        on = rows[np.logical_and.reduce([rows[n].astype(bool) for n in p.split(mining.AND)])]
        y = on.forward_excess_spy_20d
        assert (got.kept[p] if len(on) else 0) == len(on)
        if y.notna().any():
            assert got["n"][p] == y.notna().sum() and got["median"][p] == pytest.approx(y.median())
