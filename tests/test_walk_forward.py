"""Discoveries on all folds in one pass, against one fold after the other."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave import mining_queries
from barweave.operators import fold_counts, mining, pattern_counts


def _weekly(spark, securities=40):
    """Bars a week from 1995 to 2001: the first state comes with higher outcomes, in 2001 with lower ones, the last is always on."""
    rng = np.random.default_rng(5)
    days = [dt.date(1995, 1, 2) + dt.timedelta(weeks=i) for i in range(357)]
    names = [s.name for s in mining.STATES]
    date, n = np.repeat(np.array(days, dtype=object), securities), len(days) * securities
    on = rng.random((n, len(names))) < rng.choice([0.02, 0.3, 0.7], len(names))
    on[:, 0], on[:, -1] = rng.random(n) < 0.5, True
    y = rng.normal(size=n) + np.where([d.year == 2001 for d in date], -1.0, 1.0) * (on[:, 0] - 0.5) + 0.1
    table = pd.DataFrame({"security_id": [f"S{i % securities}" for i in range(n)], "date": date, mining_queries.TARGET: np.where(
        rng.random(n) < 0.05, np.nan, y), "forward_return_20d": np.where(rng.random(n) < 0.05, np.nan, y + rng.normal(size=n))})
    table = pd.concat([table, pd.DataFrame(rng.random((n, 5)), columns=mining_queries.SOURCES), pd.DataFrame(on, columns=names)], axis=1)
    df = spark.createDataFrame(table).replace(float("nan"), None).repartition(3, "security_id")
    return df.sortWithinPartitions("security_id", "date").localCheckpoint()


@pytest.fixture(scope="module")
def weekly(spark):
    return _weekly(spark)


def test_discovery_walks_through_the_whole_table(spark, sf, weekly, monkeypatch):
    """every fold is walked, the open one of the table's last days too, where what was found before doesn't hold any more."""
    monkeypatch.setattr(mining_queries, "_frame", lambda *_, **__: weekly)
    rows = {r["fold"]: r for r in mining_queries.walk_forward_discovery(spark, sf).collect()}
    assert list(rows) == ["fold1_eval_1998", "fold2_eval_1999", "fold3_eval_2000", "fold4_eval_2001"]
    assert all(r["n_selected"] > 5 for r in rows.values())
    assert all(rows[f["fold"]]["n_same_direction"] > rows[f["fold"]]["n_selected"] * 0.8 for f in mining_queries.PARTS)
    assert rows["fold4_eval_2001"]["n_same_direction"] < rows["fold4_eval_2001"]["n_selected"] * 0.5
    mature = mining.latest_mature(weekly, mining_queries.TARGET)
    parts = mining.folds(mature, mining_queries.WALKED)
    spans = [fold_counts.Span(dt.date.fromisoformat(f[a]), dt.date.fromisoformat(f[b]), ()) for f in parts
        for a, b in (("start", "end"), ("eval_start", "eval_end"))]
    known = weekly.filter(F.col(mining_queries.TARGET).isNotNull())
    assert mature == "2001-10-29" and fold_counts.within(known, spans).count() == known.count()


@pytest.mark.parametrize("target", ["forward_excess_spy_20d", "forward_return_20d"])
def test_folds_at_once_are_folds_one_by_one(spark, weekly, monkeypatch, target):
    """all folds in one pass give what a discovery and an evaluation a fold give."""
    parts, support = mining.folds("2001-10-29", mining_queries.WALKED)[::3], mining.Support(rows=600, dates=60, securities=30)
    want = {}
    for f in parts:
        found = mining.discover(weekly, target, f["start"], f["end"], support)
        later = mining.evaluate(weekly, found, target, f["eval_start"], f["eval_end"]).filter("same_direction").count()
        want[f["fold"]] = {"n_selected": len(found.selected), "n_same_direction": later, "reasons": mining.reasons(found,
            list(mining.TRACKED)), "directions": {r["pattern"]: r["direction"] for r in found.rows if r["selected"]},
            "frozen": {c: {q: v for q, v in cuts.items() if q in ("q20", "q80")} for c, cuts in found.frozen.items()}
            } | mining.selection_summary(found, support)

    def refused(*_, **__):
        raise AssertionError("a fold was scored on its own")

    monkeypatch.setattr(mining, "score", refused)
    got = {r["fold"]: r.asDict() for r in mining.walk_forward_full(weekly, target, parts, support).collect()}
    assert list(got) == list(want)
    for name, row in got.items():
        assert row == {c: pytest.approx(want[name][c], rel=1e-6, abs=1e-300) if c.startswith("min_") else want[name][c]
            for c in row if c != "fold"} | {"fold": name}
        assert row["n_same_direction"] > 0
    first = got["fold1_eval_1998"]
    assert 0 < first["n_support_passed_pairs"] < first["n_generated_pairs"]
    for f, found, _ in mining._walked(weekly, target, parts, support):
        assert {r["pattern"]: r["direction"] for r in found.rows if r["selected"]} == want[f["fold"]]["directions"]
        assert found.frozen == want[f["fold"]]["frozen"]


def test_signs_of_medians(spark):
    """counts tell the median's sign; where it lies between a negative and a positive outcome, those two do."""
    values = {"a": [-1.0, 3.0], "b": [-3.0, 1.0, None], "c": [-2.0, 2.0], "d": [0.0, 1.0], "e": [-1.0, 0.0, 0.0], "f": [-1.0, -2.0, 5.0],
        "g": [None], "h": [-9.0, -1.0, 2.0, 3.0]}
    names = list(values)
    rows = [("S", dt.date(2024, 1, 2 + i), y, *(n == x for x in names)) for n in names for i, y in enumerate(values[n])]
    df = spark.createDataFrame(rows, "security_id string, date date, y double, " + ", ".join(f"{n} boolean" for n in names)).repartition(3)
    spans = [fold_counts.Span(dt.date(2024, 1, 1), dt.date(2024, 1, 9), tuple(range(len(names)))),
        fold_counts.Span(dt.date(2024, 1, 3), dt.date(2024, 1, 9), tuple(range(len(names))))]
    products = pattern_counts.Products([(n, i, i) for i, n in enumerate(names)], len(names))
    packed = pattern_counts.packed(df, [F.col(n) for n in names], F.col("y"), None)
    found = {(r["w"], r["p"]): r.asDict() for r in fold_counts.about(packed, products, spans, 20).collect()}
    got = mining._signs_of_medians(packed, products, spans, found)
    later = {n: v[1:] for n, v in values.items()}
    for w, held in enumerate((values, later)):
        for p, n in enumerate(names):
            known = [v for v in held[n] if v is not None]
            assert got.get((w, p), 0) == (np.sign(np.median(known)) if known else 0), (w, n)
    met = fold_counts.securities(packed, products, spans)
    assert all(met.get((0, p), 0) == any(v is not None for v in values[n]) for p, n in enumerate(names))


def test_quantiles_of_windows_are_exact(spark):
    """cutoffs of all windows at once are those of each window's rows, ties, infinities and empty windows too."""
    rng = np.random.default_rng(8)
    n = 5000
    date = np.array([dt.date(2024, 1, 1) + dt.timedelta(days=int(i)) for i in rng.integers(0, 40, n)], dtype=object)
    a, b = rng.normal(size=n), np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n))
    b[:9], a[:7] = np.inf, np.nan
    rows = [(d, float(x), None if i % 11 == 0 else float(y), None) for i, (d, x, y) in enumerate(zip(date, a, b))]
    df = spark.createDataFrame(rows, "date date, a double, b double, c double").repartition(3)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    spans = [fold_counts.Span(day(x), day(y)) for x, y in ((0, 9), (0, 19), (5, 30), (25, 30), (50, 60))]
    at = [0.0, 0.2, 0.5, 0.8, 1.0]
    got = fold_counts.quantiles(df, ["a", "b", "c"], spans, at)
    for s, found in zip(spans, got):
        for i, c in enumerate(("a", "b", "c")):
            known = sorted(r[i + 1] for r in rows if s.first <= r[0] <= s.last and r[i + 1] is not None and r[i + 1] == r[i + 1])
            want = [known[int(np.floor((len(known) - 1) * q + 0.5))] if known else None for q in at]
            assert found[c] == (len(known), want), (s, c)
