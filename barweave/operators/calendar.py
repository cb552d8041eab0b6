"""A session calendar as a small table (date, session_idx), and what is asked of it by joins on the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(bars: DataFrame) -> DataFrame:
    """The dates any security traded on, numbered; one row a session."""
    return bars.select("date").distinct().withColumn("session_idx", F.row_number().over(Window.orderBy("date")))


def shift(dates: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """(date, shifted): n sessions ahead (back if negative) of each date that is a session."""
    there = calendar.select((F.col("session_idx") - n).alias("session_idx"), F.col("date").alias("shifted"))
    return dates.select("date").distinct().join(F.broadcast(calendar), "date").join(F.broadcast(there), "session_idx",
        "left").select("date", "shifted")


def neighbours(dates: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, is_session, previous, next) of any dates: the sessions just before and after."""
    c = calendar.select(F.col("date").alias("s"))
    d = dates.select("date").distinct()
    # Dates and sessions in one order: a running last and first tell the neighbours without a range join.
    both = d.withColumn("s", F.lit(None).cast("date")).unionByName(c.select(F.col("s").alias("date"), "s"))
    agg = both.groupBy("date").agg(F.max("s").alias("s"))
    w = Window.orderBy("date")
    out = agg.withColumn("previous", F.last("s", True)
        .over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.first("s", True)
            .over(w.rowsBetween(1, Window.unboundedFollowing)))
    return d.join(out, "date").select("date", F.col("s").isNotNull().alias("is_session"), "previous", "next")


def between(pairs: DataFrame, calendar: DataFrame) -> DataFrame:
    """(start, end, n): sessions from start to end, both counted; pairs of session dates."""
    a = calendar.select(F.col("date").alias("start"), F.col("session_idx").alias("i"))
    b = calendar.select(F.col("date").alias("end"), F.col("session_idx").alias("j"))
    return pairs.join(F.broadcast(a), "start").join(F.broadcast(b), "end").select("start", "end", (F.col("j") - F.col("i") + 1)
        .alias("n"))


def latest_expected(calendar: DataFrame, now_utc: Column, zone: str = "America/New_York", close_hour: int = 16,
    grace_minutes: int = 120) -> DataFrame:
    """The last session whose close and grace have passed at a UTC time."""
    local = F.from_utc_timestamp(now_utc, zone)
    done = F.to_date(local - F.make_dt_interval(F.lit(0), F.lit(close_hour), F.lit(grace_minutes)))
    return calendar.filter(F.col("date") <= done).agg(F.max("date").alias("expected"))
