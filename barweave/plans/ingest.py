"""Ingestion: provider data normalised and appended to the lake, with runs recorded, jobs resumed and dry runs that touch nothing.

A provider is a function that reads raw rows; it is called by the driver, what it returns is a
DataFrame, so the work is Spark's. Reads that fail are tried again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar as sessions_of
from ..sources import catalog, providers, store
from ..sources.lake import DATASETS, Lake

Read = Callable[..., DataFrame]
TRACKED = "security_id string, prices boolean, features boolean, reason string"
SECURITIES = "security_id string, cik long, company_name string, exchange string, primary_ticker string"


@dataclass
class Settings:
    """Limits of daily work, in sessions and securities."""

    batch: int = 25
    lookback: int = 3
    repair: int = 20
    recompute: int = 30
    provider: str = "csv_prices"
    commercial: bool = False


@dataclass
class Env:
    """Where everything is: session, lake, catalogue, job state, and readers of provider data by name.

    Readers: prices(symbols, start, end) with a column symbol; vix(); macro(); filings(ciks);
    universe(). One that is missing makes its step be skipped.
    """

    spark: SparkSession
    base: str
    readers: dict[str, Read] = field(default_factory=dict)
    settings: Settings = field(default_factory=Settings)
    now: Callable[[], datetime] = lambda: datetime.now(UTC)

    def __post_init__(self) -> None:
        self.lake = Lake(self.spark, f"{self.base}/lake")
        self.catalog = catalog.Catalog(self.spark, f"{self.base}/catalog")
        self.jobs = store.Checkpoints(self.spark, f"{self.base}/state/jobs")

    def tracked(self) -> DataFrame:
        return self.catalog.read("tracked_securities", TRACKED)

    def securities(self) -> DataFrame:
        return self.catalog.read("securities", SECURITIES)

    def calendar(self) -> DataFrame:
        """The sessions: of the catalogue's calendar, else those of the stored bars."""
        if self.catalog.version("calendar"):
            return self.catalog.read("calendar")
        return sessions_of.sessions(self.lake.raw(DATASETS["prices_daily"]))

    def expected(self) -> str | None:
        """The last session that is over by now."""
        at = F.lit(self.now().strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        found = sessions_of.latest_expected(self.calendar(), at).first()[0]
        return None if found is None else str(found)


@dataclass
class Result:
    """What a step did: rows written, what it asked for and skipped, and a line that says so."""

    status: str
    rows: int = 0
    requested: int = 0
    skipped: int = 0
    message: str = ""


def _recorded(env: Env, job: str, work: Callable[[str], Result]) -> Result:
    """Run ``work`` with its start and end in the run log; a failure is recorded and raised."""
    run_id, at = uuid.uuid4().hex, lambda: env.now().isoformat()
    env.catalog.replace("ingest_runs", catalog.start_run(env.catalog.read("ingest_runs", catalog.RUNS), run_id, job, at(), {}))
    try:
        done = work(run_id)
    except Exception:
        env.catalog.replace("ingest_runs", catalog.finish_run(env.catalog.read("ingest_runs"), run_id, at(), "FAILED", 0))
        raise
    env.catalog.replace("ingest_runs", catalog.finish_run(env.catalog.read("ingest_runs"), run_id, at(), "SUCCESS", done.rows))
    return done


def migrate(env: Env) -> dict[str, int]:
    """What any command does first, and again without effect: bars' securities become tracked, and tracked ones get features."""
    env.lake.recover()
    prices = DATASETS["prices_daily"]
    before = env.tracked()
    known = env.lake.raw(prices).select("security_id").distinct() if env.lake.exists(prices) else before.select("security_id").limit(0)
    new = known.join(before, "security_id", "left_anti").select("security_id", F.lit(True).alias("prices"), F.lit(True)
        .alias("features"), F.lit("has bars").alias("reason"))
    late = before.filter(F.col("prices") & ~F.col("features"))
    counts = {"tracked": new.count(), "featured": late.count()}
    if any(counts.values()):
        enabled = before.withColumn("features", F.col("features") | F.col("prices"))
        env.catalog.replace("tracked_securities", catalog.track(enabled, new, "if_absent"))
    return counts


def sync_universe(env: Env, dry_run: bool = False) -> Result:
    """Securities, identifiers and a day's snapshot from the master file."""
    if "universe" not in env.readers:
        return Result("SKIPPED", message="no reader")
    if dry_run:
        return Result("PLANNED", message=f"would sync the universe ({env.securities().count()} securities known)")

    def work(run_id: str) -> Result:
        day = str(env.now().date())
        made = providers.normalise_universe(store.retried(env.readers["universe"]), day)
        old = env.catalog.read("securities", SECURITIES + ", first_seen_at string, last_seen_at string")
        env.catalog.replace("securities", catalog.upsert_securities(old, made["securities"], day))
        schema = "security_id string, identifier_type string, identifier_value string, valid_from date, valid_to date"
        env.catalog.replace("security_identifiers",
            catalog.change_identifiers(env.catalog.read("security_identifiers", schema), made["identifiers"], day))
        snapshots = env.catalog.read("security_snapshots", SECURITIES + ", snapshot_date date")
        env.catalog.replace("security_snapshots", catalog.upsert_snapshot(snapshots, made["snapshots"]))
        n = made["securities"].count()
        return Result("DONE", n, message=f"synced {n} securities")

    return _recorded(env, "sync_universe", work)


def ingest_prices(env: Env, targets: DataFrame, start: str, end: str, job: str, resume: bool = False, dry_run: bool = False) -> Result:
    """Bars of targets (security_id, primary_ticker) from start to end, in batches of symbols.

    The batches that are done are kept under the job's key, so that a run that is resumed starts
    with the first one that isn't. A batch that fails is noted and the others go on.
    """
    symbols = [(r["primary_ticker"], r["security_id"]) for r in targets.select("security_id", "primary_ticker")
        .filter(F.col("primary_ticker").isNotNull()).orderBy("primary_ticker").collect()]
    size = env.settings.batch
    batches = [symbols[i : i + size] for i in range(0, len(symbols), size)]
    if dry_run:
        return Result("PLANNED", requested=len(symbols),
            message=f"would fetch {len(symbols)} symbols from {start} to {end} in {len(batches)} batches")
    providers.license_guard(env.settings.provider, env.settings.commercial)
    key = catalog.job_key(job, symbols=[s for s, _ in symbols], start=start, end=end, batch=size)
    state = (env.jobs.load(key) if resume else None) or {"completed": [], "failed": []}

    def work(run_id: str) -> Result:
        done, failed, rows = set(state["completed"]), [], 0
        for batch in batches:
            names = [s for s, _ in batch]
            if set(names) <= done:
                continue
            ids = env.spark.createDataFrame(batch, "symbol string, security_id string")
            try:
                raw = store.retried(lambda names=names: env.readers["prices"](names, start, catalog.end_exclusive(end)))
                bars = providers.normalise_prices(raw.join(F.broadcast(ids), "symbol"), F.col("security_id"), F.col("symbol"))
                rows += env.lake.append(DATASETS["prices_daily"], bars)
                actions = providers.corporate_actions(bars).withColumn("retrieved_at", F.current_timestamp())
                env.lake.append(DATASETS["corporate_actions"], actions)
                done |= set(names)
            except Exception as e:  # noqa: BLE001
                failed.append({"symbols": names, "error": str(e)[:200]})
            env.jobs.save(key, {"completed": sorted(done), "failed": failed})
        if failed and not done:
            raise RuntimeError(failed[0]["error"])
        if not failed:
            env.jobs.clear(key)
        return Result("PARTIAL" if failed else "DONE", rows, len(symbols),
            message=f"{rows} rows of {len(done)} symbols, {len(failed)} batches failed")

    return _recorded(env, job, work)


def _targets(env: Env) -> DataFrame:
    return env.securities().join(env.tracked().filter("prices")
        .select("security_id"), "security_id", "left_semi").select("security_id", "primary_ticker")


def sync_prices(env: Env, dry_run: bool = False) -> Result:
    """Bars of tracked securities that aren't current; nothing is asked for where all are."""
    targets, expected = _targets(env), env.expected()
    if expected is None or targets.limit(1).count() == 0:
        return Result("SKIPPED", message="nothing is tracked")
    d = DATASETS["prices_daily"]
    bars = env.lake.raw(d) if env.lake.exists(d) else env.spark.createDataFrame([], "security_id string, date date")
    fresh = catalog.freshness(targets, bars, expected).cache()
    current = fresh.filter(F.col("status") == "CURRENT").count()
    found = catalog.fetch_window(fresh, env.calendar(), expected, env.settings.lookback)
    if found is None:
        fresh.unpersist()
        return Result("SKIPPED", skipped=current, message=f"all {current} securities are current through {expected}")
    stale = targets.join(fresh.filter(F.col("status") != "CURRENT").select("security_id"), "security_id", "left_semi")
    out = ingest_prices(env, stale, *found, "sync_prices", dry_run=dry_run)
    fresh.unpersist()
    out.skipped = current
    return out


def repair_prices(env: Env, sessions: int | None = None, dry_run: bool = False) -> Result:
    """Bars of all tracked securities over the last sessions again, whatever is stored: late corrections win by time."""
    expected = env.expected()
    if expected is None:
        return Result("SKIPPED", message="no sessions")
    n = env.settings.repair if sessions is None else sessions
    last = env.calendar().filter(F.col("date") <= F.lit(expected).cast("date")).orderBy(F.col("date").desc()).limit(n + 1)
    return ingest_prices(env, _targets(env), str(last.agg(F.min("date")).first()[0]), expected, "repair_prices", dry_run=dry_run)


def backfill_prices(env: Env, start: str, end: str | None = None, symbols: list[str] | None = None, resume: bool = True,
    dry_run: bool = False) -> Result:
    """Bars of given symbols, or of all known securities, from a day on; resumed where it was cut off."""
    targets = env.securities().select("security_id", "primary_ticker")
    if symbols is not None:
        wanted = env.spark.createDataFrame([(s,) for s in symbols], "ticker string")
        schema = "security_id string, identifier_type string, identifier_value string, valid_to date"
        found = catalog.resolve_symbols(wanted, targets, env.catalog.read("security_identifiers", schema))
        targets = found.filter(F.col("security_id").isNotNull()).select("security_id", F.col("ticker").alias("primary_ticker"))
    return ingest_prices(env, targets, start, end or env.expected() or start, "backfill_prices", resume, dry_run)


def _appended(env: Env, name: str, dataset: str, make: Callable[[DataFrame], DataFrame], dry_run: bool, what: str) -> Result:
    if name not in env.readers:
        return Result("SKIPPED", message="no reader")
    if dry_run:
        return Result("PLANNED", message=f"would fetch {what}")

    def work(run_id: str) -> Result:
        rows = make(store.retried(env.readers[name])).withColumn("retrieved_at", F.current_timestamp())
        n = env.lake.append(DATASETS[dataset], rows)
        return Result("DONE", n, message=f"{n} rows")

    return _recorded(env, f"sync_{name}", work)


def sync_vix(env: Env, dry_run: bool = False) -> Result:
    return _appended(env, "vix", "volatility", providers.normalise_vix, dry_run, "the volatility index")


def sync_macro(env: Env, dry_run: bool = False) -> Result:
    return _appended(env, "macro", "macro", providers.normalise_macro, dry_run, "macro series")


def sync_filings(env: Env, dry_run: bool = False) -> Result:
    """Filings of tracked issuers, read once an issuer and kept for each of its securities."""
    if "filings" not in env.readers:
        return Result("SKIPPED", message="no reader")
    mine = env.securities().join(env.tracked().filter("prices")
        .select("security_id"), "security_id", "left_semi").filter(F.col("cik").isNotNull())
    ciks = [r["cik"] for r in mine.select("cik").distinct().orderBy("cik").collect()]  # tracked issuers
    if dry_run:
        return Result("PLANNED", requested=len(ciks), message=f"would check {len(ciks)} issuers")

    def work(run_id: str) -> Result:
        raw = store.retried(lambda: env.readers["filings"](ciks)).withColumn("cik", F.col("cik").cast("long"))
        joined = raw.join(F.broadcast(mine.select("cik", "security_id")), "cik")
        rows = providers.normalise_filings(joined, F.col("security_id")).withColumn("retrieved_at", F.current_timestamp())
        n = env.lake.append(DATASETS["filings"], rows)
        return Result("DONE", n, len(ciks), message=f"{n} rows of {len(ciks)} issuers")

    return _recorded(env, "sync_filings", work)
