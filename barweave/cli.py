"""Command line: ``python -m barweave.cli --base FOLDER COMMAND ...``.

Data lies in the base folder: lake, catalogue, job state. Provider files lie in ``--raw``: one
folder a provider (universe/*.json, prices/SYMBOL.csv, vix/*.csv, macro/*.json, filings/CIK.json).
``--dry-run`` reads no provider file and writes nothing.
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classify, indicators, labels, mining, quality, research
from .operators import features as feature_set
from .plans import daily, ingest, status
from .session import session
from .sources import catalog, providers, store
from .sources.lake import DATASETS

ALIASES = {"prices": "prices_daily", "features": "features_daily", "labels": "labels_forward_returns",
    "corporate-actions": "corporate_actions"}


def readers(spark: SparkSession, raw: str) -> dict[str, ingest.Read]:
    """Readers of provider files below a folder; a provider without a folder has none."""
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    files = lambda name: store.Files(spark, f"{raw}/{name}")

    def prices(symbols: list[str], start: str, end: str) -> DataFrame:
        there = set(files("prices").names())
        wanted = [s for s in symbols if f"{s}.csv" in there]
        if not wanted:
            raise FileNotFoundError(f"no price files of {', '.join(symbols)}")
        rows = union([providers.read_price_csv(spark, f"{raw}/prices/{s}.csv").withColumn("symbol", F.lit(s)) for s in wanted])
        day = providers.day("date")
        return rows.filter((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))

    def filings(ciks: list[int]) -> DataFrame:
        there = set(files("filings").names())
        parts = [providers.read_filings(spark, f"{raw}/filings/{c}.json") for c in ciks if f"{c}.json" in there]
        return union(parts) if parts else spark.createDataFrame([],
            "cik string, accession_number string, form_type string, filing_date string, url string")

    made = {
        "universe": lambda: providers.read_security_master(spark, f"{raw}/universe"), "prices": prices, "filings": filings,
        "vix": lambda: providers.read_vix_csv(spark, f"{raw}/vix"), "macro": lambda: providers.read_macro(spark, f"{raw}/macro"),
    }
    return {n: r for n, r in made.items() if files(n).names()}


def show(df: DataFrame, n: int = 30) -> None:
    df.show(n, truncate=False)


def _days(a: argparse.Namespace) -> tuple[str | None, str | None]:
    return a.start, a.end


def universe(env: ingest.Env, a: argparse.Namespace) -> None:
    """tracked, add TICKER..., remove TICKER..."""
    old = env.tracked()
    if a.action == "tracked":
        show(old.join(env.securities().select("security_id", "primary_ticker"), "security_id", "left")
            .orderBy("primary_ticker"), a.limit)
        return
    wanted = env.spark.createDataFrame([(t,) for t in a.tickers], "ticker string")
    history = env.catalog.read("security_identifiers",
        "security_id string, identifier_type string, identifier_value string, valid_to date")
    found = catalog.resolve_symbols(wanted, env.securities(), history)
    ids = [r["security_id"] for r in found.filter(F.col("security_id").isNotNull()).collect()]
    if a.action == "add":
        new = env.spark.createDataFrame([(i, True, True, "added") for i in ids], ingest.TRACKED)
        made = catalog.track(old, new, "ensure")
    else:
        made = catalog.untrack(old, ids)
    if not a.dry_run:
        env.catalog.replace("tracked_securities", made)
    show(found, a.limit)


def expand_universe(env: ingest.Env, a: argparse.Namespace) -> None:
    """A stable sample of securities, tracked and made a universe: by class, the pinned ones first."""
    known = classify.classify(env.securities())
    fit = known if a.kind == "scale" else known.filter(F.col("instrument_class") == "COMMON_EQUITY")
    chosen = catalog.hash_order(fit.select("security_id"), a.n, a.pinned)
    print(json.dumps(catalog.size_estimate(a.n, a.years)))
    if not a.dry_run:
        members = env.catalog.read("universe_memberships", "universe_name string, security_id string")
        env.catalog.replace("universe_memberships", catalog.set_members(members, a.name, chosen, replace=True))
        new = chosen.select("security_id", F.lit(True).alias("prices"), F.lit(True).alias("features"), F.lit(a.name).alias("reason"))
        env.catalog.replace("tracked_securities", catalog.track(env.tracked(), new, "ensure"))


def compute(env: ingest.Env, a: argparse.Namespace) -> None:
    spy = daily._market(env, "SPY")
    if a.command == "compute-features":
        done = daily.compute_features(env.lake, spy, daily._market(env, "QQQ"), daily._vix(env), env.calendar(), a.start, a.end,
            a.dry_run)
    else:
        done = daily.compute_labels(env.lake, spy, env.calendar(), a.start, a.end, a.dry_run)
    print(json.dumps(done, default=str))


def _panel(env: ingest.Env, universe_name: str) -> DataFrame:
    issues = daily._stored_issues(env)
    members = env.catalog.read("universe_memberships", "universe_name string, security_id string")
    view = lambda n: env.lake.view(DATASETS[n])
    return research.panel(view("features_daily"), view("labels_forward_returns"), members, classify.classify(env.securities()),
        view("prices_daily"), issues, universe_name)


def _reconcile(env: ingest.Env) -> DataFrame:
    return research.reconcile_securities(*(env.lake.view(DATASETS[n])
        for n in ("prices_daily", "features_daily", "labels_forward_returns")))


def researched(env: ingest.Env, a: argparse.Namespace) -> None:
    """reconcile, baseline, feature-coverage, quantiles, ic, regimes, report"""
    if a.action == "reconcile":
        show(_reconcile(env))
        return
    df, wanted = _panel(env, a.universe), a.features or feature_set.VALUES[:12]
    dev = research.in_split(df, a.split, a.start, a.end)
    frozen = research.in_split(df, "development", a.start, a.end)
    if a.action == "report":
        print(json.dumps(daily.research_report(df, wanted, [a.target], a.start, a.end, a.out,
            {"universe": a.universe, "target": a.target})))
        return
    tables = {
        "baseline": lambda: research.baseline(dev, [a.target]), "feature-coverage": lambda: research.coverage(dev, wanted),
        "quantiles": lambda: research.quintile_stats(dev, wanted, [a.target], research.cutoffs(frozen, [a.target])),
        "ic": lambda: research.rank_ic(dev, wanted, a.target),
        "regimes": lambda: research.regime_stats(research.with_regimes(dev, research.vix_terciles(frozen)), [a.target]),
    }
    show(tables[a.action](), a.limit)


def audit(env: ingest.Env, a: argparse.Namespace) -> None:
    members = env.catalog.read("universe_memberships", "universe_name string, security_id string")
    classes, prices = classify.classify(env.securities()), env.lake.view(DATASETS["prices_daily"])
    if a.action == "prices":
        show(quality.ohlc_audit(prices, classes, members))
        return
    actions = env.lake.view(DATASETS["corporate_actions"])
    report = quality.extreme_label_report(quality.extreme_label_audit(env.lake.view(DATASETS["labels_forward_returns"]), prices,
        actions, classes, members))
    for name in ("by_cause", "by_class", "by_horizon", "largest_positive", "largest_negative", "research_unexplained"):
        print(name)
        show(report[name], a.limit)


def maintain(env: ingest.Env, a: argparse.Namespace) -> None:
    """compact, migrate-partitions, storage-health of one dataset or all."""
    names = [ALIASES.get(a.dataset, a.dataset)] if a.dataset else [d for d in DATASETS if env.lake.exists(DATASETS[d])]
    for n in names:
        d = DATASETS[n]
        if a.command == "compact":
            done = env.lake.compact(d, a.year, a.month, a.dry_run)
        elif a.command == "migrate-partitions":
            done = env.lake.to_yearly(d, a.dry_run) if d.by == "year" and env.lake.layout(d) in ("month",
                "mixed") else "nothing to migrate"
        else:
            done = env.lake.health(d)
        print(n, json.dumps(done))


def listed(env: ingest.Env, a: argparse.Namespace) -> None:
    """indicators list, indicators show --symbol"""
    if a.action == "list":
        for s in indicators.specs(a.category, a.id):
            print(f"{s.id}\t{s.category}\t{'causal' if s.causal else 'looks ahead'}\t{', '.join(s.outputs)}")
        return
    bars = env.lake.view(DATASETS["prices_daily"]).filter(F.col("ticker_at_time") == a.symbol)
    ids = [s.id for s in indicators.specs(a.category, a.id)]
    made = indicators.compute(bars, ids=ids, start=a.start, end=a.end)
    show(made.orderBy(F.col("date").desc()).limit(a.limit).orderBy("date"), a.limit)


def mined(env: ingest.Env, a: argparse.Namespace) -> None:
    """mine run, mine walk-forward, mine inspect --pattern"""
    panel = _panel(env, a.universe).filter("data_quality_valid")
    bars = env.lake.view(DATASETS["prices_daily"]).join(panel.select("security_id").distinct(), "security_id", "left_semi")
    df = mining.frame(panel, indicators.compute(bars, ids=list(mining.FAMILIES)).drop(*indicators.BASE[2:]))
    if a.action == "walk-forward":
        parts = mining.folds(mining.latest_mature(df, a.target))
        walked = mining.walk_forward_full(df, a.target,
            parts) if a.full else mining.stability(mining.walk_forward(df, a.target, parts, mode=a.mode, wait=a.cooldown))
        show(walked, a.limit)
        return
    if a.action == "inspect":
        for name, table in mining.inspect(df, a.pattern, a.target, a.start, a.end, a.later).items():
            print(name)
            show(table, a.limit)
        return
    found = mining.discover(df, a.target, a.start, a.end, size=a.size, mode=a.mode, wait=a.cooldown)
    print(json.dumps(mining.selection_summary(found)))
    later = mining.evaluate(df, found, a.target, a.later, mining.latest_mature(df, a.target), a.mode, a.cooldown)
    show(mining.ranked(later, found), a.limit)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barweave", description="Daily-bar analytics on Spark.")
    p.add_argument("--base", required=True, help="folder of lake, catalogue and state")
    p.add_argument("--raw", help="folder of provider files")
    p.add_argument("--now", help="UTC time to take as now, YYYY-MM-DDTHH:MM:SS")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, fn, days: bool = False, actions: list[str] | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(fn=fn)
        c.add_argument("--dry-run", action="store_true")
        c.add_argument("--limit", type=int, default=30)
        if actions:
            c.add_argument("action", choices=actions)
        if days:
            c.add_argument("--start")
            c.add_argument("--end")
        return c

    said = lambda fn: lambda env, a: print(fn(env, dry_run=a.dry_run))
    command("init", lambda env, a: print(json.dumps(ingest.migrate(env))))
    for name, fn in (("sync-universe", ingest.sync_universe), ("sync-prices", ingest.sync_prices), ("sync-vix", ingest.sync_vix),
        ("sync-macro", ingest.sync_macro), ("sync-sec-filings", ingest.sync_filings)):
        command(name, said(fn))
    c = command("repair-prices", lambda env, a: print(ingest.repair_prices(env, a.sessions, a.dry_run)))
    c.add_argument("--sessions", type=int)
    c = command("backfill-prices", lambda env,
        a: print(ingest.backfill_prices(env, a.start, a.end, a.symbols, not a.restart, a.dry_run)), days=True)
    c.add_argument("--symbols", nargs="*")
    c.add_argument("--restart", action="store_true")
    for name in ("compute-features", "compute-labels"):
        command(name, compute, days=True)
    c = command("universe", universe, actions=["tracked", "add", "remove"])
    c.add_argument("tickers", nargs="*")
    c = command("expand-universe", expand_universe)
    c.add_argument("--kind", choices=["scale", "common-equity"], default="common-equity")
    c.add_argument("--name", default="research-common-equity-500")
    c.add_argument("--n", type=int, default=500)
    c.add_argument("--years", type=float, default=8)
    c.add_argument("--pinned", nargs="*", default=[])
    c = command("validate", lambda env, a: print(json.dumps(daily.validate(env, a.action, a.ids, a.dry_run))),
        actions=["prices", "features", "labels"])
    c.add_argument("--ids", nargs="*")
    command("audit", audit, actions=["prices", "extreme-labels"])
    c = command("research", researched, days=True,
        actions=["reconcile", "baseline", "feature-coverage", "quantiles", "ic", "regimes", "report"])
    c.add_argument("--universe", default="research-common-equity-500")
    c.add_argument("--target", default="forward_excess_spy_20d", choices=labels.VALUES)
    c.add_argument("--features", nargs="*")
    c.add_argument("--split", choices=["development", "validation"], default="development")
    c.add_argument("--out")
    c.set_defaults(start="2018-01-01", end="2023-12-31")
    for name in ("compact", "migrate-partitions", "storage-health"):
        c = command(name, maintain)
        c.add_argument("dataset", nargs="?")
        c.add_argument("--year", type=int)
        c.add_argument("--month", type=int)
    command("status", lambda env, a: print(json.dumps(status.status(env), indent=1, default=str)))
    command("doctor", lambda env, a: [print("ok" if ok else "FAIL", what, note) for what, ok, note in status.doctor(env)])
    c = command("indicators", listed, days=True, actions=["list", "show"])
    c.add_argument("--category", choices=indicators.categories())
    c.add_argument("--id")
    c.add_argument("--symbol")
    c = command("mine", mined, days=True, actions=["run", "walk-forward", "inspect"])
    c.add_argument("--universe", default="research-common-equity-500")
    c.add_argument("--target", default="forward_excess_spy_20d")
    c.add_argument("--pattern")
    c.add_argument("--later", default="2024-01-02")
    c.add_argument("--mode", choices=["state", "entry"], default="state")
    c.add_argument("--cooldown", type=int, default=0)
    c.add_argument("--size", type=int, choices=[1, 2], default=2)
    c.add_argument("--full", action="store_true")
    c.set_defaults(start="2018-01-02", end="2023-12-29")
    command("run-daily", lambda env, a: [print(s.name, "|", s.result) for s in daily.run_daily(env, a.dry_run)])
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or session("barweave")
    now = (lambda: datetime.fromisoformat(a.now).replace(tzinfo=UTC)) if a.now else (lambda: datetime.now(UTC))
    env = ingest.Env(spark, a.base, readers(spark, a.raw) if a.raw else {}, now=now)
    if not a.dry_run and a.command not in ("doctor", "indicators"):
        ingest.migrate(env)
    a.fn(env, a)


if __name__ == "__main__":
    main()
