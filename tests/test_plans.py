"""The daily run, ingestion, status, command line, atomic files and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barweave import cli
from barweave.operators import labels, mining, quality
from barweave.plans import daily, ingest, status
from barweave.sources import catalog, store
from barweave.sources.lake import DATASETS

SYMBOLS = {"SPY": 1, "QQQ": 2, "AAA": 3, "BBB": 4}


def weekdays(n, start=dt.date(2024, 1, 2)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


DAYS = weekdays(60)


@pytest.fixture
def env(spark, tmp_path):
    """A base with provider files of four symbols over 60 sessions, the last five of them not out yet."""
    raw = tmp_path / "raw"
    for name in ("universe", "prices", "vix", "filings"):
        (raw / name).mkdir(parents=True)
    rows = [[c, s, s, "NYSE"] for s, c in SYMBOLS.items()]
    (raw / "universe" / "u.json").write_text(json.dumps({"fields": ["cik", "name", "ticker", "exchange"],
        "data": [[str(x) for x in r] for r in rows]}))
    head = "date,open,high,low,close,adj_close,volume,dividend,stock_split\n"
    for s, c in SYMBOLS.items():
        lines = [f"{d},{100 + i + c},{102 + i + c},{99 + i + c},{101 + i + c},{101 + i + c},{1000 + i},{0.5 if i == 20 else 0},0"
            for i, d in enumerate(DAYS)]
        (raw / "prices" / f"{s}.csv").write_text(head + "\n".join(lines) + "\n")
    (raw / "vix" / "v.csv").write_text("DATE,OPEN,HIGH,LOW,CLOSE\n" + "\n".join(f"{d:%m/%d/%Y},13,14,12,{13 + i % 5}"
        for i, d in enumerate(DAYS)) + "\n")
    (raw / "filings" / "3.json").write_text(json.dumps({"cik": "3",
        "filings": {"recent": {"accessionNumber": ["a-1", "a-1", "a-2"], "form": ["10-K", "10-K", "odd"],
        "filingDate": [str(DAYS[0])] * 3, "primaryDocument": ["x", "y", "z"]}}}))
    at = {"now": dt.datetime.combine(DAYS[54], dt.time(23), dt.UTC)}
    made = ingest.Env(spark, f"file://{tmp_path}/base", cli.readers(spark, f"file://{raw}"), ingest.Settings(batch=3),
        now=lambda: at["now"])
    made.at = at
    made.catalog.replace("calendar", spark.createDataFrame([(d, i + 1) for i, d in enumerate(DAYS)], "date date, session_idx int"))
    return made


def track_all(env):
    ids = env.securities().select("security_id", F.lit(True).alias("prices"), F.lit(True).alias("features"), F.lit("t").alias("reason"))
    env.catalog.replace("tracked_securities", catalog.track(env.tracked(), ids))


def files_below(tmp_path):
    return sorted(str(p) for p in (tmp_path / "base").rglob("*") if p.is_file())


def test_daily_run(env, tmp_path):
    ingest.sync_universe(env)
    track_all(env)
    before = files_below(tmp_path)
    planned = daily.run_daily(env, dry_run=True)
    assert files_below(tmp_path) == before and not any(s.failed for s in planned)
    assert "would fetch 4 symbols" in planned[1].result and "in 2 batches" in planned[1].result
    first = {s.name: s for s in daily.run_daily(env)}
    assert not any(s.failed for s in first.values()), first
    assert list(first)[-1] == "report" and first["macro"].result.startswith("SKIPPED")
    prices, made = DATASETS["prices_daily"], DATASETS["features_daily"]
    assert env.lake.view(prices).agg(F.max("date")).first()[0] == DAYS[54]
    assert env.lake.view(DATASETS["filings"]).count() == 1
    # Only the ten calendar days that a security without data asks for are there; the backfill brings the rest.
    done = ingest.backfill_prices(env, str(DAYS[0]))
    assert done.status == "DONE" and env.lake.view(prices).count() == 4 * 55
    again = {s.name: s.result for s in daily.run_daily(env)}
    assert again["prices"].startswith("SKIPPED: all 4") and again["features"].startswith(("SKIPPED", "DONE"))
    env.at["now"] = dt.datetime.combine(DAYS[59], dt.time(23), dt.UTC)
    later = {s.name: s.result for s in daily.run_daily(env)}
    assert later["prices"].startswith("DONE") and env.lake.view(prices).agg(F.max("date")).first()[0] == DAYS[59]
    assert env.lake.view(made).agg(F.max("date")).first()[0] == DAYS[59] and "DONE" in later["labels"]
    said = status.status(env)
    assert said["freshness"] == {"expected": str(DAYS[59]), "CURRENT": 4} and said["universe"]["tracked"] == 4
    assert all(ok for what, ok, _ in status.doctor(env) if not what.startswith("reader of macro"))
    assert {r["status"] for r in env.catalog.read("ingest_runs").collect()} == {"SUCCESS"}


def test_critical_issues_end_the_run(env):
    ingest.sync_universe(env)
    track_all(env)
    ingest.backfill_prices(env, str(DAYS[0]))
    mine = env.lake.view(DATASETS["prices_daily"]).filter("ticker_at_time = 'AAA'").limit(1)
    bad = mine.withColumn("high", F.col("low") - 5).withColumn("retrieved_at", F.current_timestamp() + F.expr("interval 1 hour"))
    env.lake.append(DATASETS["prices_daily"], bad.drop("year", "month"))
    members = env.securities().select(F.lit("u").alias("universe_name"), "security_id")
    env.catalog.replace("universe_memberships", members)
    steps = daily.run_daily(env)
    assert steps[-1].name == "price_validation" and steps[-1].abort and "critical" in steps[-1].result


def test_batches_resume(env):
    ingest.sync_universe(env)
    track_all(env)
    reader, calls = env.readers["prices"], []

    def flaky(symbols, start, end):
        calls.append(symbols)
        if "SPY" in symbols and len(calls) < 5:
            raise OSError("down")
        return reader(symbols, start, end)

    env.readers["prices"] = flaky
    naps = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(store.retried, "__defaults__", (3, 1.0, naps.append))
        first = ingest.backfill_prices(env, str(DAYS[0]))
        assert first.status == "PARTIAL" and naps == [1.0, 2.0]
        keys = [k for k, _ in env.jobs.all()]
        assert len(keys) == 1 and len(env.jobs.load(keys[0])["completed"]) == 3
        second = ingest.backfill_prices(env, str(DAYS[0]))
    assert second.status == "DONE" and [c for c in calls if "AAA" in c] == [["AAA", "BBB", "QQQ"]] and env.jobs.all() == []


def test_windows(spark):
    c = spark.createDataFrame([(d, i + 1) for i, d in enumerate(DAYS)], "date date, session_idx int")
    fresh = spark.createDataFrame([("a", DAYS[20], "STALE"), ("b", DAYS[30], "CURRENT")],
        "security_id string, last_date date, status string")
    assert catalog.fetch_window(fresh, c, str(DAYS[30])) == (str(DAYS[17]), str(DAYS[30]))
    none = fresh.unionByName(spark.createDataFrame([("c", None, "NO_DATA")], fresh.schema))
    assert catalog.fetch_window(none.filter("status != 'STALE'"), c, str(DAYS[30])) == (str(DAYS[30] - dt.timedelta(days=10)),
        str(DAYS[30]))
    assert catalog.fetch_window(fresh.filter("status = 'CURRENT'"), c, str(DAYS[30])) is None
    assert catalog.end_exclusive("2024-02-29") == "2024-03-01"


def test_atomic_files(spark, tmp_path):
    files = store.Files(spark, f"file://{tmp_path}/f")
    files.write("a.json", b"one")
    files.write("a.json", b"two")
    assert files.read("a.json") == b"two" and files.names() == ["a.json"] and files.read("b") is None

    def refuse(path):
        raise ValueError("bad")

    with pytest.raises(ValueError):
        files.write_via("a.json", lambda path: store.Files(spark, path.rsplit("/", 1)[0])
            .write(path.rsplit("/", 1)[1], b"three"), refuse)
    assert files.read("a.json") == b"two" and files.names() == ["a.json"]
    jobs = store.Checkpoints(spark, f"file://{tmp_path}/j")
    assert jobs.load("x") is None and jobs.all() == []
    jobs.save("x", {"n": 1})
    (tmp_path / "j" / "bad.json").write_text("{")
    assert jobs.load("x")["n"] == 1 and jobs.load("bad") is None and [k for k, _ in jobs.all()] == ["x"]
    jobs.clear("x")
    assert jobs.load("x") is None


def test_command_line(spark, tmp_path, env, capsys):
    base, raw = ["--base", env.base, "--raw", f"file://{tmp_path}/raw"], ["--now", f"{DAYS[54]}T23:00:00"]
    run = lambda *a: (cli.main([*base, *raw, *a], spark), capsys.readouterr().out)[1]
    assert "would sync" in run("sync-universe", "--dry-run")
    assert "4" in run("sync-universe") and "primary" in run("universe", "add", "AAA", "SPY", "QQQ", "BBB")
    assert "DONE" in run("backfill-prices", "--start", str(DAYS[0]))
    for c in ("compute-features", "compute-labels"):
        assert '"rows": 220' in run(c)
    assert json.loads(run("validate", "prices"))["issues"] == 0 and "all_three" in run("research", "reconcile")
    run("expand-universe", "--n", "4", "--name", "u")
    for a in ("baseline", "feature-coverage", "quantiles", "ic", "regimes"):
        assert "|" in run("research", a, "--universe", "u", "--target", "forward_return_5d", "--features", "ret_1d", "--start",
            "2024-01-01", "--end", "2024-12-31")
    assert "rows_checked" in run("audit", "prices") and "by_cause" in run("audit", "extreme-labels")
    assert '"partitions": 0' in run("compact",
        "prices") and "nothing to migrate" in run("migrate-partitions") and "needs_compaction" in run("storage-health", "prices")
    assert "tenkan" in run("indicators", "list", "--category", "ichimoku") and "rsi_14" in run("indicators", "show", "--symbol",
        "AAA", "--id", "rsi", "--limit", "3")
    assert "n_generated_singles" in run("mine", "run", "--universe", "u", "--target", "forward_return_5d", "--start", "2024-01-01",
        "--end", "2024-02-15", "--later", "2024-02-16", "--size", "1")
    assert '"expected"' in run("status") and "ok state folder" in run("doctor") and "report" in run("run-daily", "--dry-run")


def test_stream_state_equals_batch(spark, tmp_path):
    from barweave.functions import kernels
    from barweave.streaming import stateful

    import numpy as np

    rng = np.random.default_rng(3)
    closes = {s: (100 + rng.normal(size=60).cumsum()).tolist() for s in "AB"}
    rows = [(s, d, x) for s, xs in closes.items() for d, x in zip(DAYS, xs)]
    schema = "security_id string, date date, close double"
    for i, part in enumerate(([r for r in rows if r[1] < DAYS[25]], [r for r in rows if r[1] >= DAYS[20]])):  # five bars come twice
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for i in range(2):
        stream = stateful.running(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/{{{','.join(map(str, range(i + 1)))}}}"))
        writer = stream.writeStream.option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("security_id", "date").collect()
    assert len(got) == 120
    for s, xs in closes.items():
        mine = [r for r in got if r.security_id == s]
        for name, want in (("ema", kernels.ewm(np.array(xs), 12)), ("rsi", kernels.rsi(np.array(xs), 14))):
            assert [r[name] for r in mine] == [None if w != w else pytest.approx(w) for w in want]


def test_mining_freezes_and_prunes(spark):
    """Cutoffs come from the discover window alone; aliases stand in only for what is missing; pairs of one kin aren't tried."""
    rows = [(f"S{s:03d}", d, 25.0 if (s + i) % 7 == 0 else 55.0, float(i),
        0.02 if (s + i) % 7 == 0 else 0.001 * ((s * 7 + i * 3) % 11 - 5)) for i, d in enumerate(weekdays(120)) for s in range(40)]
    df = spark.createDataFrame(rows, "security_id string, date date, rsi_14 double, hist_vol_20 double, forward_excess_spy_20d double")
    end = str(weekdays(120)[59])
    found = mining.discover(df, "forward_excess_spy_20d", "2024-01-01", end, mining.Support(100, 20, 10))
    assert found.frozen["hist_vol_20"]["q80"] <= 59 and "rsi14_le_30" in found.selected
    later = mining.discover(df.withColumn("hist_vol_20", F.when(F.col("date") > end, 9e9).otherwise(F.col("hist_vol_20"))),
        "forward_excess_spy_20d", "2024-01-01", end, mining.Support(100, 20, 10))
    assert later.frozen == found.frozen and later.rows == found.rows
    assert [s.name for s in mining.base_states({"rsi_14"})] == ["rsi14_le_30", "rsi14_ge_70"]
    assert [s.name for s in mining.base_states({"ma_20_distance"})] == ["feat_close_above_ma20"]
    assert mining.pruned(mining.STATES[0], mining.STATES[1]) and not mining.pruned(mining.STATES[0], mining.STATES[2])
    why = mining.reasons(found,
        ["rsi14_le_30", "rsi14_ge_70", "rsi14_le_30 AND rsi14_ge_70", "nothing", "macd_positive AND rsi14_le_30"])
    assert why["rsi14_le_30"] == "SELECTED" and why["rsi14_ge_70"] == "INSUFFICIENT_SUPPORT" and why["nothing"] == "NOT_GENERATED"
    assert why["macd_positive AND rsi14_le_30"] == "NOT_GENERATED"
    after = mining.evaluate(df, found, "forward_excess_spy_20d", str(weekdays(120)[60])).filter("pattern = 'rsi14_le_30'").first()
    assert after.same_direction and after.effect_ratio == pytest.approx(1.0)
    held = df.withColumn("date", F.date_add("date", 1000))
    assert mining.evaluate(held, found, "forward_excess_spy_20d", "2026-09-21").filter("n > 0").count() == 0


def test_entries_of_all_patterns_at_once(spark):
    """Entries and cooldown over lists of patterns equal those of one pattern."""
    import random

    rng = random.Random(2)
    rows = [(f"S{s}", d, rng.random() < 0.6, rng.random() < 0.5, rng.random()) for s in range(5) for d in weekdays(80)]
    df = spark.createDataFrame(rows, "security_id string, date date, a boolean, b boolean, y double")
    made = [mining.State("a", "T", "x", "a"), mining.State("b", "T", "z", "b")]
    stated = mining.apply_states(df, made)
    for mode, wait in mining.MODES:
        got = {p: {(r.security_id, r.date) for r in mining.hits(df, made, "y", mode=mode, wait=wait).collect() if r.pattern == p}
            for p in ("a", "b", "a AND b")}
        for p in got:
            assert got[p] == {(r.security_id, r.date) for r in mining.activate(stated, p, mode, wait).collect()}, (p, mode, wait)


def test_extreme_label_causes(spark):
    day = DAYS[30]
    columns = ", ".join(f"{c} double" for c in labels.VALUES)
    value = lambda c: 2.5 if c == "forward_return_10d" else -2.1 if c == "forward_return_1d" else 0.1
    ids = ["stock", "artefact", "bad", "fund", "broken", "nobar"]
    rows = spark.createDataFrame([(i, day, *(value(c) for c in labels.VALUES)) for i in ids],
        f"security_id string, date date, {columns}")
    bars = [(i, d, 10.0, 5.0 if i == "broken" and d == day else 11.0, 9.0, 10.0,
        40.0 if i in ("artefact", "bad") and d == day else 10.0, 0.0) for i in ids if i != "nobar" for d in DAYS[25:31]]
    prices = spark.createDataFrame(bars,
        "security_id string, date date, open double, high double, low double, close double, adj_close double, stock_split double")
    actions = spark.createDataFrame([("artefact", day - dt.timedelta(days=5), "SPLIT"),
        ("bad", day - dt.timedelta(days=6), "SPLIT")], "security_id string, effective_date date, action_type string")
    classes = spark.createDataFrame([(i, "CLOSED_END_FUND" if i == "fund" else "COMMON_EQUITY") for i in ids],
        "security_id string, instrument_class string")
    members = spark.createDataFrame([("bad",), ("stock",)], "security_id string")
    audit = quality.extreme_label_audit(rows, prices, actions, classes, members)
    got = {(r.security_id, r.horizon): r.cause for r in audit.collect()}
    assert len(got) == 12
    want = {"stock": "A_EXTREME_MARKET", "artefact": "C_ADJUSTMENT_ARTIFACT", "bad": "D_PROVIDER_BAD_DATA",
        "fund": "B_NON_COMMON_INSTRUMENT", "broken": "D_PROVIDER_BAD_DATA", "nobar": "E_UNEXPLAINED"}
    assert {i: got[i, "forward_return_10d"] for i in ids} == want
    report = quality.extreme_label_report(audit)
    assert {r.security_id for r in report["research_unexplained"].collect()} == {"bad"} and report["largest_negative"].count() == 6
