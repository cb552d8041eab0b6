"""The lake: append-only hive-partitioned Parquet datasets read last-write-wins, with compaction and health checks.

Paths go through Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    name: str
    date: str
    keys: tuple[str, ...]
    sort: tuple[str, ...]
    by: str = "month"
    tie: str = "retrieved_at"


DATASETS = {
    d.name: d
    for d in (
        Dataset("prices_daily", "date", ("security_id", "date"), ("security_id", "date")),
        Dataset("corporate_actions", "effective_date", ("security_id", "effective_date", "action_type"),
            ("security_id", "effective_date"), "year"),
        Dataset("macro", "date", ("series_id", "date"), ("series_id", "date")),
        Dataset("volatility", "date", ("date",), ("date",), "year"),
        Dataset("filings", "filing_date", ("security_id", "accession_number"), ("security_id", "filing_date")),
        Dataset("short_volume", "date", ("security_id", "date"), ("security_id", "date")),
        Dataset("features_daily", "date", ("security_id", "date", "feature_version"), ("security_id", "date"), tie="calculated_at"),
        Dataset("labels_forward_returns", "date", ("security_id", "date", "label_version"), ("security_id", "date"),
            tie="calculated_at"),
    )
}


def last_write(df: DataFrame, keys: list[str] | tuple[str, ...], tie: str) -> DataFrame:
    """The row of the latest ``tie`` of each key; equal ties are settled by the row's hash, so the choice is stable."""
    rest = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.col(tie).desc_nulls_last(), F.xxhash64(*rest), F.to_json(F.struct(*rest)))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


class Lake:
    """Datasets under one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.base).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, d: Dataset) -> str:
        return f"{self.base}/{d.name}"

    def exists(self, d: Dataset) -> bool:
        return bool(self.files(d))

    def files(self, d: Dataset) -> list[tuple[str, int]]:
        """(path, bytes) of the data files."""
        fs, root = self._fs(), self._path(self.path(d))
        if not fs.exists(root):
            return []
        out, it = [], fs.listFiles(root, True)
        while it.hasNext():
            f = it.next()
            name = f.getPath().toString()
            if name.endswith(".parquet") and "/_" not in name[len(self.base) :]:
                out.append((name, f.getLen()))
        return sorted(out)

    def partitions(self, d: Dataset) -> list[dict[str, int]]:
        """The distinct year (and month) keys, from the paths."""
        keys = {tuple((k, int(v)) for k, v in (x.split("=") for x in name.split("/") if x.startswith(("year=", "month="))))
            for name, _ in self.files(d)}
        return [dict(k) for k in sorted(keys)]

    def _parts(self, d: Dataset) -> list[str]:
        return ["year"] if d.by == "year" else ["year", "month"]

    def delete_on_exit(self) -> None:
        """The whole lake goes when the session's JVM ends: for lakes that are only used in passing."""
        self._fs().deleteOnExit(self._path(self.base))

    def rows_of(self, files: list[str]) -> int:
        """Rows of data files, from their footers: no data is read."""
        return self.spark.read.parquet(*files).count() if files else 0

    def append(self, d: Dataset, df: DataFrame) -> int:
        """Write rows as new files, one a partition, sorted. Returns the rows written, counted from the new files' footers.

        The plan runs once. No rows leave no files; an undated row is refused, as it would have
        no partition.
        """
        before = {f for f, _ in self.files(d)}
        day = F.col(d.date).cast("date")
        parts = self._parts(d)
        checked = F.when(day.isNull(), F.raise_error(F.lit(f"{d.name}: a row without {d.date}"))).otherwise(F.year(day))
        dated = df.withColumn(d.date, day).withColumns({"year": checked, "month": F.month(day)}).drop(*({"month"} - set(parts)))
        writer = dated.repartition(*parts).sortWithinPartitions(*parts, *d.sort).write.mode("append").partitionBy(*parts)
        writer.option("compression", "zstd").parquet(self.path(d))
        return self.rows_of([f for f, _ in self.files(d) if f not in before])

    def raw(self, d: Dataset) -> DataFrame:
        """All rows ever written; files of older schemas read with nulls."""
        return self.spark.read.option("mergeSchema", "true").option("basePath", self.path(d)).parquet(self.path(d))

    def view(self, d: Dataset, start: str | None = None, end: str | None = None) -> DataFrame:
        """Last-write-wins rows; a date range also prunes partitions."""
        df = self.raw(d)
        month = F.col("year") * 12 + F.col("month") if d.by == "month" else F.col("year") * 12 + 12
        if start:
            y, m = int(start[:4]), int(start[5:7])
            df = df.filter(F.col("year") >= y).filter(month >= y * 12 + m).filter(F.col(d.date) >= F.lit(start).cast("date"))
        if end:
            y, m = int(end[:4]), int(end[5:7])
            df = (df.filter(F.col("year") <= y).filter((F.lit(d.by == "year")) | (month <= y * 12 + m))
                .filter(F.col(d.date) <= F.lit(end).cast("date")))
        return last_write(df, d.keys, d.tie)

    def partition(self, d: Dataset, **keys: int) -> DataFrame:
        """Last-write-wins rows of one partition (year=, and month= where the dataset has months); only its files are read."""
        wanted = self._parts(d)
        if sorted(keys) != sorted(wanted):
            raise ValueError(f"{d.name} has partitions by {', '.join(wanted)}")
        df = self.raw(d)
        for k, v in keys.items():
            df = df.filter(F.col(k) == v)
        return last_write(df, d.keys, d.tie)

    def create_views(self) -> list[str]:
        """Temporary views of the datasets that have files."""
        made = []
        for d in DATASETS.values():
            if self.exists(d):
                self.view(d).createOrReplaceTempView(d.name)
                made.append(d.name)
        return made

    def stats(self, d: Dataset) -> DataFrame:
        """(rows, first, last, duplicate_keys) of what is stored."""
        return snapshot(self.raw(d), d)

    def compact(self, d: Dataset, year: int | None = None, month: int | None = None, dry_run: bool = False) -> dict[str, int]:
        """Rewrite a partition (or all) as its last-write-wins rows; staged and compared before the old files go.

        A partition of one file without duplicate keys is left alone. A month needs its year,
        and a dataset kept by year has no months.
        """
        if month is not None and (year is None or d.by == "year"):
            raise ValueError(f"{d.name}: a month needs a year and a dataset kept by month")
        out = {"partitions": 0, "files_before": 0, "rows_before": 0, "rows_after": 0}
        for part in self.partitions(d):
            if (year is not None and part["year"] != year) or (month is not None and part.get("month") != month):
                continue
            where = "/".join(f"{k}={v}" for k, v in part.items())
            folder = f"{self.path(d)}/{where}"
            files = [f for f, _ in self.files(d) if f"/{where}/" in f]
            df = self.spark.read.option("mergeSchema", "true").parquet(folder)
            rows, keys = df.count(), df.select(*d.keys).distinct().count()
            if len(files) == 1 and rows == keys:
                continue
            out["partitions"] += 1
            out["files_before"] += len(files)
            out["rows_before"] += rows
            out["rows_after"] += keys
            if not dry_run:
                staging = f"{self.base}/_staging/{uuid.uuid4().hex}"
                last_write(df, d.keys, d.tie).coalesce(1).sortWithinPartitions(*d.sort).write.option("compression",
                    "zstd").parquet(staging)
                self._verified_swap(d, self.spark.read.parquet(staging), last_write(df, d.keys, d.tie), staging, folder)
        return out

    def _verified_swap(self, d: Dataset, new: DataFrame, old: DataFrame, staging: str, folder: str) -> None:
        if snapshot(new, d).collect() != snapshot(old, d).collect():
            raise RuntimeError(f"{folder}: the rewritten rows differ")
        fs = self._fs()
        backup = f"{self.base}/_backup/{quote(folder[len(self.base) + 1 :], safe='')}"
        fs.mkdirs(self._path(f"{self.base}/_backup"))
        fs.rename(self._path(folder), self._path(backup))
        if not fs.rename(self._path(staging), self._path(folder)):
            fs.rename(self._path(backup), self._path(folder))
            raise RuntimeError(f"{folder}: the rewritten files couldn't be moved")
        fs.delete(self._path(backup), True)

    def recover(self) -> dict[str, list[str]]:
        """Undo what a rewrite that was cut off left: folders that were moved away come back, finished ones lose their backup, staged files go.

        A rewrite can then be started again.
        """
        fs, out = self._fs(), {"restored": [], "dropped": []}
        kept = self._path(f"{self.base}/_backup")
        for found in fs.listStatus(kept) if fs.exists(kept) else []:
            name = found.getPath().getName()
            target = self._path(f"{self.base}/{unquote(name)}")
            if fs.exists(target):
                fs.delete(found.getPath(), True)
                out["dropped"].append(unquote(name))
            else:
                fs.rename(found.getPath(), target)
                out["restored"].append(unquote(name))
        fs.delete(self._path(f"{self.base}/_staging"), True)
        return out

    def to_yearly(self, d: Dataset, dry_run: bool = False) -> dict[str, int]:
        """Rewrite a dataset kept by month as one kept by year, verified before the swap."""
        rows = last_write(self.raw(d).drop("year", "month"), d.keys, d.tie)
        n = rows.count()
        if not dry_run:
            staging = f"{self.base}/_staging/{uuid.uuid4().hex}"
            rows.withColumn("year",
                F.year(d.date)).repartition("year").sortWithinPartitions(*d.sort).write.partitionBy("year").option("compression",
                    "zstd").parquet(staging)
            self._verified_swap(d, self.spark.read.parquet(staging), rows, staging, self.path(d))
        return {"rows": n}

    def layout(self, d: Dataset) -> str:
        """month, year, mixed or empty: how the files lie."""
        kinds = {"month" if "/month=" in f else "year" for f, _ in self.files(d)}
        return "empty" if not kinds else kinds.pop() if len(kinds) == 1 else "mixed"

    def health(self, d: Dataset) -> list[dict[str, int | float | bool]]:
        """Per partition: files, rows (from footers), bytes, mean size, and whether compaction is due."""
        out = []
        listed = self.files(d)
        for part in self.partitions(d):
            where = "/".join(f"{k}={v}" for k, v in part.items())
            mine = [(f, n) for f, n in listed if f"/{where}/" in f]
            sizes = [n for _, n in mine]
            mean = sum(sizes) / len(sizes) / 2**20
            due = len(sizes) >= 25 or (len(sizes) > 1 and mean < 8) if d.by == "month" else len(sizes) >= 12 or (len(sizes) > 1
                and mean < 2)
            out.append({**part, "files": len(sizes), "rows": self.rows_of([f for f, _ in mine]), "bytes": sum(sizes),
                "mean_mb": mean, "needs_compaction": due})
        return out


def snapshot(df: DataFrame, d: Dataset) -> DataFrame:
    """(rows, securities, first, last, duplicate_keys): what a rewrite must not change."""
    sid = F.countDistinct("security_id") if "security_id" in df.columns else F.lit(0)
    again = df.groupBy(*d.keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"))
    return df.agg(F.count("*").alias("rows"), sid.alias("securities"), F.min(d.date).cast("string").alias("first"), F.max(d.date)
        .cast("string").alias("last")).crossJoin(again)
