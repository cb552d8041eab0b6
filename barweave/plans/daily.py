"""Batch plans: incremental compute, the daily run and the research report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, features, labels, quality, research
from ..sources.lake import DATASETS, Lake
from . import ingest
from .ingest import Env

LOOKBACK, LOOKAHEAD, OVERLAP, RECOMPUTE, BACKFILL = 300, 20, 5, 30, 10


@dataclass
class Report:
    steps: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def failed(self) -> list[str]:
        return [n for n, s, _ in self.steps if s == "FAILED"]


def incremental_start(calendar: DataFrame, last: str | None, sessions: int) -> str | None:
    """The date ``sessions`` sessions before the last computed one; None without one: everything."""
    if last is None:
        return None
    rows = calendar.filter(F.col("date") <= F.lit(last).cast("date")).orderBy(F.col("date").desc()).limit(sessions + 1)
    return str(rows.agg(F.min("date")).first()[0])


def compute_features(lake: Lake, spy: DataFrame, qqq: DataFrame, vix: DataFrame, calendar: DataFrame, start: str | None = None,
    end: str | None = None, dry_run: bool = False, only: DataFrame | None = None) -> dict[str, object]:
    """Features from ``start`` on, read with a lookback of sessions and appended.

    One job over all securities, or ``only`` those of a table of ids.
    """
    d = DATASETS["prices_daily"]
    read_from = incremental_start(calendar, start, LOOKBACK) if start else None
    plan = {"start": start, "end": end, "read_from": read_from}
    if dry_run:
        return plan
    bars = quality.scoped(lake.view(d, read_from, end), only)
    rows = features.compute(bars, spy, qqq, vix, start, end)
    return plan | {"rows": lake.append(DATASETS["features_daily"], rows)}


def compute_labels(lake: Lake, spy: DataFrame, calendar: DataFrame, start: str | None = None, end: str | None = None,
    dry_run: bool = False) -> dict[str, object]:
    """Labels from ``start`` on; what was immature is computed again over the last RECOMPUTE sessions."""
    start = incremental_start(calendar, start, RECOMPUTE) if start else None
    if dry_run:
        return {"start": start, "end": end}
    rows = labels.compute(lake.view(DATASETS["prices_daily"], start), spy, start, end)
    return {"start": start, "end": end, "rows": lake.append(DATASETS["labels_forward_returns"], rows)}


def run_steps(steps: list[tuple[str, Callable[[], object], bool]], skip: set[str] | None = None) -> Report:
    """Run named steps in order, each on its own: a failure is recorded, and one marked critical ends the run."""
    report, stopped = Report(), False
    for name, step, critical in steps:
        if stopped or name in (skip or set()):
            report.steps.append((name, "SKIPPED", ""))
            continue
        try:
            report.steps.append((name, "DONE", str(step())))
        except Exception as e:  # noqa: BLE001
            report.steps.append((name, "FAILED", str(e)[:200]))
            stopped = critical
    return report


def feature_start(env: Env, overlap: int = OVERLAP, backfill: int = BACKFILL) -> str | None:
    """Where daily features start: some sessions before the last bar, or earlier where tracked securities lack rows of the last few.

    Without any features: the first bar. Without bars: nothing.
    """
    prices, made = DATASETS["prices_daily"], DATASETS["features_daily"]
    if not env.lake.exists(prices):
        return None
    bars = env.lake.raw(prices).select("security_id", "date")
    first, last = bars.agg(F.min("date"), F.max("date")).first()
    if not env.lake.exists(made):
        return str(first)
    calendar = env.calendar()
    start, floor = (incremental_start(calendar, str(last), n) for n in (overlap, backfill))
    wanted = env.tracked().filter("features").select("security_id")
    recent = env.lake.view(prices, floor).select("security_id", "date").join(wanted, "security_id", "left_semi")
    missing = research.missing_identity(recent, env.lake.raw(made).select("security_id", "date")
        .distinct()).agg(F.min("date")).first()[0]
    return start if missing is None else min(start, str(missing))


def label_start(env: Env) -> str | None:
    """Where daily labels start: as many sessions before the last bar as stay immature."""
    prices = DATASETS["prices_daily"]
    if not env.lake.exists(prices):
        return None
    last = env.lake.raw(prices).agg(F.max("date")).first()[0]
    return incremental_start(env.calendar(), str(last), env.settings.recompute)


def _market(env: Env, ticker: str) -> DataFrame:
    """The bars of a benchmark, by its ticker."""
    return env.lake.view(DATASETS["prices_daily"]).filter(F.col("ticker_at_time") == ticker).select("date", "close", "adj_close")


def _vix(env: Env) -> DataFrame:
    d = DATASETS["volatility"]
    return env.lake.view(d) if env.lake.exists(d) else env.spark.createDataFrame([], "date date, close double")


def _stored_issues(env: Env) -> DataFrame:
    schema = ("issue_id string, dataset string, security_id string, date date, issue_type string, severity string, details string, "
        "detected_at string, resolved boolean")
    return env.catalog.read("data_quality_issues", schema)


def record_issues(env: Env, found: DataFrame, dataset: str, scope: DataFrame) -> dict[str, int]:
    """Found issues merged into the stored ones, those of the scope that are gone resolved; returns counts by severity."""
    found = found.persist()
    at = env.now().isoformat()
    merged = quality.upsert_issues(_stored_issues(env), found, dataset, at)
    env.catalog.replace("data_quality_issues",
        quality.resolve_out_of_scope(quality.resolve_missing(merged, found, dataset, scope), scope, dataset))
    counts = quality.severities(found).first().asDict()
    found.unpersist()
    return counts


def validate(env: Env, what: str, scope: DataFrame | list[str] | None = None, dry_run: bool = False) -> dict[str, int]:
    """The rules of prices, features or labels over the tracked securities, or a given scope; issues are stored unless it's a dry run."""
    name = {"prices": "prices_daily", "features": "features_daily", "labels": "labels_forward_returns"}[what]
    if not env.lake.exists(DATASETS[name]):
        return {"issues": 0, "critical": 0, "warning": 0, "info": 0}
    if scope is None:
        scope = env.tracked().filter(F.col("prices") if what == "prices" else F.col("features")).select("security_id")
    rows = quality.scoped(env.lake.view(DATASETS[name]), scope)
    today = str(env.now().date())
    rules = {"prices": lambda: quality.check_prices(rows, today), "features": lambda: quality.check_features(rows),
        "labels": lambda: quality.check_labels(rows)}
    found = rules[what]()
    if what == "prices" and isinstance(scope, DataFrame) and (expected := env.expected()) is not None:
        found = found.unionByName(quality.missing_recent(rows, scope, env.calendar(), expected))
    if dry_run:
        return quality.severities(found).first().asDict()
    return record_issues(env, found, name, scope if isinstance(scope, DataFrame) else rows.select("security_id").distinct())


def research_critical(env: Env) -> int:
    """Bars of the research universe's common equities that contradict themselves."""
    members = env.catalog.read("universe_memberships", "universe_name string, security_id string")
    classes = classify.classify(env.securities())
    return quality.ohlc_audit(env.lake.view(DATASETS["prices_daily"]), classes, members).first()["research_critical"]


@dataclass
class Step:
    name: str
    result: str
    failed: bool = False
    abort: bool = False


def run_daily(env: Env, dry_run: bool = False) -> list[Step]:
    """The daily run: universe, prices, vix, macro, filings, price validation, features, labels, validation of both, report.

    Each step stands alone: what fails is noted and the next one runs. Critical issues, or a
    validation that fails, end the run. A dry run asks no provider and writes nothing. Features
    and labels are skipped where prices had nothing new and both are as far as the bars.
    """
    steps: list[Step] = []

    def add(name: str, work: Callable[[], str], abort: bool = False) -> bool:
        try:
            steps.append(Step(name, work()))
        except Exception as e:  # noqa: BLE001
            critical = abort or isinstance(e, CriticalIssues)
            steps.append(Step(name, f"FAILED: {str(e)[:200]}", True, critical))
            return not critical
        return True

    fetched: dict[str, ingest.Result] = {}

    def sync(name: str, fn: Callable[..., ingest.Result]) -> None:
        def work() -> str:
            fetched[name] = fn(env, dry_run=dry_run)
            return f"{fetched[name].status}: {fetched[name].message}"

        add(name, work)

    for name, fn in (("universe", ingest.sync_universe), ("prices", ingest.sync_prices), ("vix", ingest.sync_vix),
        ("macro", ingest.sync_macro), ("filings", ingest.sync_filings)):
        sync(name, fn)

    def prices_checked() -> str:
        counts = validate(env, "prices", dry_run=dry_run)
        bad = 0 if dry_run or not env.lake.exists(DATASETS["prices_daily"]) else research_critical(env)
        if bad:
            raise CriticalIssues(f"{bad} critical issues in the research universe")
        return f"{counts['issues']} issues ({counts['critical']} critical)"

    if not add("price_validation", prices_checked, abort=True):
        return steps

    def up_to_date(name: str) -> bool:
        d = DATASETS[name]
        if name not in DATASETS or not env.lake.exists(d):
            return False
        last = lambda x: env.lake.raw(x).agg(F.max("date")).first()[0]
        return last(d) == last(DATASETS["prices_daily"])

    def unchanged() -> bool:
        return "prices" in fetched and fetched["prices"].status == "SKIPPED"

    def features_made() -> str:
        start = feature_start(env)
        if start is None:
            return "SKIPPED: no bars"
        if unchanged() and up_to_date("features_daily"):
            return "SKIPPED: no new sessions"
        if dry_run:
            return f"would compute from {start}"
        wanted = env.tracked().filter("features").select("security_id")
        done = compute_features(env.lake, _market(env, "SPY"), _market(env, "QQQ"), _vix(env), env.calendar(), start, only=wanted)
        return f"DONE: {done['rows']} rows from {start}"

    def labels_made() -> str:
        start = label_start(env)
        if start is None:
            return "SKIPPED: no bars"
        if unchanged() and up_to_date("labels_forward_returns"):
            return "SKIPPED: no new sessions"
        if dry_run:
            return f"would recompute from {start}"
        rows = labels.compute(env.lake.view(DATASETS["prices_daily"], start), _market(env, "SPY"), start)
        return f"DONE: {env.lake.append(DATASETS['labels_forward_returns'], rows)} rows from {start}"

    add("features", features_made)
    add("labels", labels_made)

    def both_checked() -> str:
        f, n = validate(env, "features", dry_run=dry_run), validate(env, "labels", dry_run=dry_run)
        if not dry_run and f["critical"] + n["critical"]:
            raise CriticalIssues(f"{f['critical']} critical feature and {n['critical']} critical label issues")
        return f"features {f['issues']} issues, labels {n['issues']} issues"

    if add("feature_label_validation", both_checked, abort=True):
        steps.append(Step("report", "status collected"))
    return steps


class CriticalIssues(RuntimeError):
    """Issues that must not be built upon."""


def research_report(panel: DataFrame, feature_list: list[str], targets: list[str], start: str, end: str, out: str,
    provenance: dict[str, str], horizon: int = 20) -> dict[str, int]:
    """Every research table of both windows, written as Parquet with provenance columns. Returns rows by table."""
    panel = panel.cache()
    dev, val = research.in_split(panel, "development", start, end), research.in_split(panel, "validation", start, end)
    bounds, terciles = research.cutoffs(dev, targets), research.vix_terciles(dev)
    main = targets[-1]
    tables: dict[str, DataFrame] = {"feature_coverage": research.coverage(panel, feature_list),
        "feature_rank_correlation": research.redundancy(panel, feature_list)}
    for split, df in (("development", dev), ("validation", val)):
        stats = research.quintile_stats(df, feature_list, targets, bounds)
        made = {
            "baseline": research.baseline(df, targets), "quantile_results": stats, "spread_results": research.spreads(stats),
            "overlapping_spread": research.overlapping_spread(df, feature_list, main, horizon),
            "overlapping_spread_dates": research.extreme_dates(df, feature_list, main),
            "ic_results": research.rank_ic(df, feature_list, main),
            "regime_results": research.regime_stats(research.with_regimes(df, terciles), targets),
            "price_sensitivity": research.price_sensitivity(df, main),
            "low_price_concentration": research.low_price_concentration(df, main),
            "robust_baseline": research.robust_baseline(df, targets, bounds),
            "robust_quantile_results": research.robust_quantiles(df, feature_list, targets, bounds),
            "robust_spread_results": research.robust_spreads(research.robust_quantiles(df, feature_list, targets, bounds)),
            "ic_by_date": research.ic_by_date(df, feature_list, main),
            **{f"overlay_{k}": t for k, t in research.overlay(df, feature_list, main).items()},
        }
        for name, t in made.items():
            t = t.withColumn("split", F.lit(split))
            tables[name] = t if name not in tables else tables[name].unionByName(t, allowMissingColumns=True)
    spark = panel.sparkSession
    tables["robust_cutoffs"] = spark.createDataFrame([(t, *b) for t, b in bounds.items()], "target string, p1 double, p99 double")
    tables["regime_cutoffs"] = spark.createDataFrame([terciles], "vix_low double, vix_high double")
    tables["feature_research_summary"] = research.feature_summary(panel, feature_list, main, start, end, horizon)
    rows = {}
    for name, t in tables.items():
        t.withColumns({k: F.lit(v) for k, v in provenance.items()}).write.mode("overwrite").parquet(f"{out}/{name}")
        rows[name] = spark.read.parquet(f"{out}/{name}").count()
    panel.unpersist()
    return rows
