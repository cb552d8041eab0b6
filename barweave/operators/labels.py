"""Forward-outcome labels: returns, excess over a benchmark, and extremes of the path ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import series, change, finite, lead

HORIZONS = (1, 3, 5, 10, 20)
PATHS = (5, 10, 20)
VALUES = [*(f"forward_return_{h}d" for h in HORIZONS), *(f"forward_excess_spy_{h}d" for h in HORIZONS),
    *(f"max_gain_next_{h}d" for h in PATHS), *(f"max_drawdown_next_{h}d" for h in PATHS)]
IDENTITY = ["security_id", "ticker_at_time", "date", "label_version", "calculated_at", "calculation_code_version"]


def compute(prices: DataFrame, spy: DataFrame, start: str | None = None, end: str | None = None, version: str = "v1",
    code_version: str = "1", calculated_at: Column | None = None) -> DataFrame:
    """Labels of each bar; null until the whole horizon is known. The benchmark moves on its own sessions."""
    c = "adj_close"
    df = prices.withColumns({f"forward_return_{h}d": change(lead(c, h), c) for h in HORIZONS})
    for h in PATHS:
        ahead = series().rowsBetween(1, h)
        full = F.count(c).over(ahead) == h
        df = df.withColumn(f"max_gain_next_{h}d",
            F.when(full, change(F.max(c).over(ahead), c))).withColumn(f"max_drawdown_next_{h}d",
                F.when(full, change(F.min(c).over(ahead), c)))
    dates = Window.orderBy("date")
    market = spy.select("date", *(change(F.lead(c, h).over(dates), c).alias(f"__spy{h}") for h in HORIZONS))
    df = df.join(F.broadcast(market), "date",
        "left").withColumns({f"forward_excess_spy_{h}d": F.col(f"forward_return_{h}d") - F.col(f"__spy{h}") for h in HORIZONS})
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    ids = {"label_version": F.lit(version), "calculation_code_version": F.lit(code_version),
        "calculated_at": F.current_timestamp() if calculated_at is None else calculated_at}
    return df.withColumns(ids).select(*IDENTITY, *(finite(x).alias(x) for x in VALUES))


def maturity(labels: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(horizon, mature_until): the last date whose label of a horizon is known; null if none is."""
    row = labels.agg(*(F.max(F.when(F.col(f"forward_return_{h}d").isNotNull(), F.col("date"))).alias(f"h{h}") for h in horizons))
    return row.select(F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("mature_until"))
        for h in horizons))).alias("x")).select("x.*")
