"""What is stored and whether the place is fit to work in."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ..sources import catalog
from ..sources.lake import DATASETS
from .ingest import Env


def policies(env: Env) -> list[dict]:
    """Per dataset: the partitioning it should have, the one it has, and whether a migration is pending."""
    out = []
    for d in DATASETS.values():
        found = env.lake.layout(d)
        out.append({"dataset": d.name, "expected": d.by, "found": found, "migration_pending": found not in ("empty", d.by)})
    return out


def status(env: Env) -> dict[str, dict]:
    """Securities, bars by freshness, other datasets, open issues, the last runs and what compaction is due."""
    tracked, known = env.tracked(), env.securities()
    of = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0))
    t = tracked.agg(F.count("*").alias("tracked"), of("prices").alias("for_prices"), of("features")
        .alias("for_features")).first().asDict()
    out: dict[str, dict] = {"universe": {"securities": known.count()} | t}
    for d in DATASETS.values():
        if not env.lake.exists(d):
            continue
        df = env.lake.view(d)
        sid = F.countDistinct("security_id") if "security_id" in df.columns else F.lit(None)
        row = df.agg(F.count("*").alias("rows"), F.min(d.date).cast("string").alias("first"), F.max(d.date).cast("string")
            .alias("last"), sid.alias("securities"))
        parts = env.lake.health(d)
        due = sum(p["needs_compaction"] for p in parts)
        size = {"files": sum(p["files"] for p in parts), "bytes": sum(p["bytes"] for p in parts), "compaction_due": due}
        out[d.name] = row.first().asDict() | size
    prices = DATASETS["prices_daily"]
    if env.lake.exists(prices) and (expected := env.expected()) is not None:
        fresh = catalog.freshness(tracked.filter("prices"), env.lake.raw(prices), expected).groupBy("status").count()
        out["freshness"] = {"expected": expected} | {r["status"]: r["count"] for r in fresh.collect()}
    if env.catalog.version("data_quality_issues"):
        open_ = env.catalog.read("data_quality_issues").filter(~F.col("resolved")).groupBy("severity").count()
        out["open_issues"] = {r["severity"]: r["count"] for r in open_.collect()}
    if env.catalog.version("ingest_runs"):
        last = env.catalog.read("ingest_runs").groupBy("job").agg(F.max_by("status", "started_at")
            .alias("status"), F.max("started_at").alias("at"))
        out["runs"] = {r["job"]: f"{r['status']} {r['at']}" for r in last.collect()}
    out["migrations"] = {p["dataset"]: p["found"] for p in policies(env) if p["migration_pending"]}
    return out


def doctor(env: Env) -> list[tuple[str, bool, str]]:
    """(check, passed, note) of session, folders, catalogue and readers."""
    spark = env.spark
    checks = [("python", sys.version_info >= (3, 10), sys.version.split()[0]),
        ("spark", int(spark.version.split(".")[0]) >= 4, spark.version)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    checks.append(("session time zone", zone == "UTC", zone))
    checks.append(("adaptive execution", spark.conf.get("spark.sql.adaptive.enabled") == "true", ""))
    try:
        env.jobs.save("doctor", {"ok": True})
        passed = (env.jobs.load("doctor") or {}).get("ok") is True
        env.jobs.clear("doctor")
        checks.append(("state folder can be written", passed, env.base))
    except Exception as e:  # noqa: BLE001
        checks.append(("state folder can be written", False, str(e)[:200]))
    for d in DATASETS.values():
        if env.lake.exists(d):
            stats = env.lake.stats(d).first()
            checks.append((f"{d.name} can be read", True, f"{stats['rows']} rows, {stats['duplicate_keys']} written again"))
    pending = [p["dataset"] for p in policies(env) if p["migration_pending"]]
    checks.append(("partitions as expected", not pending, ", ".join(pending)))
    checks += [(f"reader of {n}", n in env.readers, "") for n in ("universe", "prices", "vix", "macro", "filings")]
    return checks
