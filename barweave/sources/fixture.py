"""Price-bar tables derived from a star schema of orders and line items.

Gives a deterministic panel to run the engine on where no market data is at hand: a
supplier is a security, its line items of a ship date are the trades of a bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.format_string("S%06d", "l_suppkey").alias("security_id"), F.col("l_shipdate").cast("date")
            .alias("date"), p.alias("p"), (p * (1 - F.col("l_discount"))).alias("q"),
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_tax").alias("tax"), F.col("l_quantity")
            .alias("size"), F.col("l_linestatus").alias("status"),
    )


def _bars(t: DataFrame, *keys: str) -> DataFrame:
    return t.groupBy(*keys).agg(
        F.min_by("p", F.struct("k", "n", "p")).alias("open"),
        (F.max("p") * (1 + F.max("tax"))).alias("high"),
        (F.min("q") * (1 - F.max("tax"))).alias("low"),
        F.max_by("q", F.struct("k", "n", "q")).alias("close"),
        F.sum("size").alias("volume"),
    )


def adjusted(df: DataFrame) -> DataFrame:
    """Adds adj_close by a fixed factor a year, dividend, split and ingestion columns."""
    year, month = F.year("date"), F.month("date")
    return df.withColumns(
        {
            "adj_close": F.col("close") * (1 - 0.02 * (2001 - year)),
            "dividend": F.when((month == 3) & (F.dayofmonth("date") <= 7), F.round(F.col("close") * 0.01, 2)).otherwise(0.0),
            "stock_split": F.when((F.dayofyear("date") == 100) & (year % 3 == 0), 2.0).otherwise(0.0),
            "ticker_at_time": F.concat(F.lit("T"), F.substring("security_id", 2, 6)),
        }
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(security_id, date) bars with open, high, low, close, volume, adj_close, dividend, stock_split, ticker_at_time."""
    # Trades are dealt by security once: bars and all windows over them need no other shuffle, and only one sort.
    return adjusted(_bars(trades(spark, sf_dir).repartition("security_id"), "security_id", "date"))


def benchmark(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """One bar a day over all trades, or over those of one status: the market series."""
    t = trades(spark, sf_dir)
    return adjusted(_bars(t if status is None else t.filter(F.col("status") == status), "date").withColumn("security_id", F.lit("MKT")))


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, close): a daily series from order totals; it ends before the bars do."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date")
        .alias("date")).agg((F.avg("o_totalprice") / 10000).alias("close"))
