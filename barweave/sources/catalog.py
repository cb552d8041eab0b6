"""Catalogue tables as versioned Parquet: upserts, slowly changing identifiers, snapshots, universes, run log.

A table is replaced by writing the next version beside the current one; the reader takes the
highest finished version, so readers never see a half-written table.
"""

from __future__ import annotations

import hashlib
import json
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    #: Versions of a table that stay.
    kept = 5

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def version(self, table: str) -> int:
        folder = self._path(f"{self.base}/{table}")
        if not self._fs.exists(folder):
            return 0
        done = [int(s.getPath().getName()[1:]) for s in self._fs.listStatus(folder)
            if self._fs.exists(self._path(s.getPath().toString() + "/_SUCCESS"))]
        return max(done, default=0)

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        v = self.version(table)
        if not v:
            if schema is None:
                raise FileNotFoundError(table)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.base}/{table}/v{v}")

    def replace(self, table: str, df: DataFrame) -> int:
        """Write the next version; the ones that a plan may still read stay, older ones go."""
        v = self.version(table) + 1
        df.write.mode("overwrite").parquet(f"{self.base}/{table}/v{v}")
        old = self._path(f"{self.base}/{table}/v{v - self.kept}")
        if v > self.kept and self._fs.exists(old):
            self._fs.delete(old, True)
        return v

    def attach(self) -> list[str]:
        """Temporary views of all tables."""
        if not self._fs.exists(self._path(self.base)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.base))]
        names = sorted(n for n in names if self.version(n))
        for n in names:
            self.read(n).createOrReplaceTempView(n)
        return names


def _merged(old: DataFrame, new: DataFrame, keys: list[str], pick: dict[str, Column]) -> DataFrame:
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    key = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    return o.join(n, on, "full_outer").select(*key, *(c.alias(k) for k, c in pick.items()))


def upsert_securities(old: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """New rows over old ones; first_seen_at stays, last_seen_at moves."""
    hit = F.col("n.security_id").isNotNull()
    pick = {c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in new.columns if c != "security_id"}
    pick |= {"first_seen_at": F.coalesce("o.first_seen_at", F.lit(at)), "last_seen_at": F.when(hit, F.lit(at))
        .otherwise(F.col("o.last_seen_at"))}
    return _merged(old, new, ["security_id"], pick)


def track(old: DataFrame, new: DataFrame, mode: str = "ensure") -> DataFrame:
    """Tracked securities (security_id, prices, features, reason).

    Ensure: flags are or-ed, the reason stays; add: replaced; if_absent: old rows stay.
    """
    hit, had = F.col("n.security_id").isNotNull(), F.col("o.security_id").isNotNull()
    either = lambda c: F.coalesce(f"o.{c}", F.lit(False)) | F.coalesce(f"n.{c}", F.lit(False))
    if mode == "ensure":
        pick = {"prices": either("prices"), "features": either("features"), "reason": F.coalesce("o.reason", "n.reason")}
    elif mode == "add":
        pick = {c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in ("prices", "features", "reason")}
    else:
        pick = {c: F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in ("prices", "features", "reason")}
    return _merged(old, new, ["security_id"], pick)


def untrack(tracked: DataFrame, ids: list[str]) -> DataFrame:
    """Soft delete: the flags go, the row stays."""
    gone = F.col("security_id").isin(ids)
    return tracked.withColumns({c: F.col(c) & ~gone for c in ("prices", "features")})


def change_identifiers(old: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Slowly changing identifiers: an open row whose value is no longer reported closes at ``at``; new values open.

    Both: (security_id, identifier_type, identifier_value, valid_from, valid_to).
    """
    keys = ["security_id", "identifier_type"]
    day = F.lit(at).cast("date")
    now = new.groupBy(*keys).agg(F.collect_set("identifier_value").alias("now"))
    joined = old.join(now, keys, "left")
    closes = F.col("valid_to").isNull() & F.col("now").isNotNull() & ~F.array_contains("now", F.col("identifier_value"))
    kept = joined.withColumn("valid_to", F.when(closes, day).otherwise(F.col("valid_to"))).select(*old.columns)
    open_ = old.filter(F.col("valid_to").isNull()).select(*keys, "identifier_value")
    fresh = new.select(*keys, "identifier_value").distinct().join(open_, [*keys, "identifier_value"], "left_anti")
    return kept.unionByName(fresh.withColumns({"valid_from": day, "valid_to": F.lit(None).cast("date")}).select(*old.columns))


def upsert_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """A day's snapshot replaces what the day had for the same securities."""
    return old.join(new.select("snapshot_date", "security_id"), ["snapshot_date", "security_id"], "left_anti").unionByName(new)


def set_members(old: DataFrame, name: str, ids: DataFrame, replace: bool = False) -> DataFrame:
    """Members of a universe added, or replaced altogether."""
    new = ids.select(F.lit(name).alias("universe_name"), "security_id").distinct()
    rest = old.filter(F.col("universe_name") != name) if replace else old.join(new, ["universe_name", "security_id"], "left_anti")
    return rest.select("universe_name", "security_id").unionByName(new)


def set_metadata(old: DataFrame, key: str, value: str) -> DataFrame:
    new = old.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return old.filter(F.col("key") != key).unionByName(new)


def hash_order(df: DataFrame, n: int, pinned: list[str] | None = None) -> DataFrame:
    """Pinned securities, then those of the smallest SHA-256 of their id, n in all: larger universes contain smaller ones."""
    first = F.col("security_id").isin(pinned or []).cast("int")
    return df.orderBy(first.desc(), F.sha2(F.col("security_id").cast("binary"), 256)).limit(n)


def size_estimate(n: int, years: float, bytes_per_row: float = 150.0, sessions: int = 252) -> dict[str, float]:
    """Rows and bytes that n securities over some years take."""
    rows = n * years * sessions
    return {"rows": rows, "bytes": rows * bytes_per_row}


def resolve_symbols(wanted: DataFrame, securities: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(ticker, security_id, how): by primary ticker, else by an open ticker in the identifier history, else unresolved."""
    t = wanted.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    a = securities.groupBy(F.col("primary_ticker").alias("ticker")).agg(F.min("security_id").alias("by_primary"))
    open_ = identifiers.filter((F.col("identifier_type") == "TICKER") & F.col("valid_to").isNull())
    b = open_.groupBy(F.col("identifier_value").alias("ticker")).agg(F.min("security_id").alias("by_history"))
    how = F.when(F.col("by_primary").isNotNull(), "primary").when(F.col("by_history").isNotNull(), "history").otherwise("unresolved")
    return t.join(a, "ticker", "left").join(b, "ticker", "left").select("ticker", F.coalesce("by_primary", "by_history")
        .alias("security_id"), how.alias("how"))


def freshness(tracked: DataFrame, prices: DataFrame, expected: str, overlap: int = 3) -> DataFrame:
    """(security_id, last_date, status, fetch_from): CURRENT, STALE or NO_DATA against the expected session."""
    last = prices.groupBy("security_id").agg(F.max("date").alias("last_date"))
    day = F.lit(expected).cast("date")
    status = F.when(F.col("last_date").isNull(), "NO_DATA").when(F.col("last_date") >= day, "CURRENT").otherwise("STALE")
    return tracked.select("security_id").join(last, "security_id", "left").select("security_id", "last_date", status.alias("status"),
        F.when(status == "STALE", F.date_sub("last_date", overlap)).alias("fetch_from"))


def job_key(name: str, **params: object) -> str:
    """A job's name with 16 hex digits of its parameters."""
    return f"{name}_{hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]}"


def fetch_window(fresh: DataFrame, calendar: DataFrame, expected: str, lookback: int = 3, no_data_days: int = 10) -> tuple[str,
    str] | None:
    """(start, end) of a daily fetch for stale securities and those without data; None where all are current.

    Stale ones start ``lookback`` sessions before their last one, those without data some
    calendar days before the expected session; the earliest start counts for all.
    """
    last = fresh.filter(F.col("status") == "STALE").agg(F.min("last_date").alias("d"))
    row = last.crossJoin(fresh.agg(F.count_if(F.col("status") == "NO_DATA").alias("n"))).first()
    starts = []
    if row["d"] is not None:
        before = calendar.filter(F.col("date") <= F.lit(row["d"])).orderBy(F.col("date").desc()).limit(lookback + 1)
        starts.append(str(before.agg(F.min("date")).first()[0]))
    if row["n"]:
        starts.append(str(date.fromisoformat(expected) - timedelta(days=no_data_days)))
    return (min(starts), expected) if starts else None


def end_exclusive(last: str) -> str:
    """The day after the last wanted session, for providers whose end isn't included."""
    return str(date.fromisoformat(last) + timedelta(days=1))


RUNS = "run_id string, job string, started_at string, finished_at string, status string, rows long, params_json string"


def start_run(runs: DataFrame, run_id: str, job: str, at: str, params: dict[str, object]) -> DataFrame:
    new = runs.sparkSession.createDataFrame([(run_id, job, at, None, "RUNNING", None,
        json.dumps(params, sort_keys=True, default=str))], RUNS)
    return runs.unionByName(new)


def finish_run(runs: DataFrame, run_id: str, at: str, status: str, rows: int) -> DataFrame:
    mine = F.col("run_id") == run_id
    return runs.withColumns({"finished_at": F.when(mine, F.lit(at))
        .otherwise(F.col("finished_at")), "status": F.when(mine, F.lit(status))
            .otherwise(F.col("status")), "rows": F.when(mine, F.lit(rows)).otherwise(F.col("rows"))})


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of raw files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256)
        .alias("sha256"))
