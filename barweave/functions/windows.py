"""Window helpers: gated rolling aggregates, average ranks, quintiles, nearest quantiles, safe correlation.

A gated aggregate is null until its frame holds as many non-null values as it is long.
Every division is ``try_divide``: a zero denominator gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def series() -> WindowSpec:
    """A security's bars by date. Made when used: windows need a session, and workers import this module without one."""
    return Window.partitionBy("security_id").orderBy("date")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trailing(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, this one included."""
    return (w or series()).rowsBetween(-(n - 1), 0)


def lag(c: str | Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(c), n).over(w or series())


def lead(c: str | Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(c), n).over(w or series())


def div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def change(a: str | Column, b: str | Column) -> Column:
    """a / b - 1."""
    return div(a, b) - 1


def gated(fn: Callable[[Column], Column], c: str | Column, n: int, frame: WindowSpec | None = None) -> Column:
    """fn over a frame of n rows, null unless all n are there."""
    frame = trailing(n) if frame is None else frame
    return F.when(F.count(col(c)).over(frame) == n, fn(col(c)).over(frame))


def mean(c: str | Column, n: int) -> Column:
    return gated(F.avg, c, n)


def std(c: str | Column, n: int) -> Column:
    return gated(F.stddev_samp, c, n)


def total(c: str | Column, n: int) -> Column:
    return gated(F.sum, c, n)


def highest(c: str | Column, n: int) -> Column:
    return gated(F.max, c, n)


def lowest(c: str | Column, n: int) -> Column:
    return gated(F.min, c, n)


def previous(fn: Callable[[Column], Column], c: str | Column, n: int) -> Column:
    """fn over the n rows before this one."""
    return gated(fn, c, n, series().rowsBetween(-n, -1))


def finite(c: str | Column) -> Column:
    """NaN and infinities become null."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def crosses_up(a: str | Column, b: str | Column) -> Column:
    return (col(a) > col(b)) & (lag(a) <= lag(b))


def crosses_down(a: str | Column, b: str | Column) -> Column:
    return (col(a) < col(b)) & (lag(a) >= lag(b))


def median_of(values: Column) -> Column:
    """Median of an array column of non-null numbers; a window median can't take a frame."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def average_rank(c: str, by: list[str]) -> Column:
    """1-based rank within ``by``, equal values sharing the mean of their ranks; null for null."""
    w = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())
    same = F.count(F.col(c)).over(Window.partitionBy(*by, c))
    return F.when(F.col(c).isNotNull(), F.rank().over(w) + (same - 1) / 2.0)


def quintile(c: str, by: list[str]) -> Column:
    """floor((average rank - 1) / n * 5) + 1 within 1 to 5: equal values share a bucket, and buckets may be empty."""
    n = F.count(F.col(c)).over(Window.partitionBy(*by))
    raw = F.floor(div(average_rank(c, by) - 1, n) * 5)
    return (F.least(F.greatest(raw, F.lit(0)), F.lit(4)) + 1).cast("int")


def nearest_quantiles(df: DataFrame, value: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles of non-null values by nearest rank, round((n - 1) * q), columns q0, q1, ...

    Counts by value are taken first, so what is ordered is the distinct values. Running counts
    are taken in two levels (ranges of group and value, then offsets of the ranges), so no task
    sees all values, nor all of a group.
    """
    by = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id())
    sums = ranged.groupBy(*by, "part").agg(F.sum("n").alias("s"))
    group = Window.partitionBy(*by)
    before = F.sum("s").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("s").over(group)).drop("s")
    local = Window.partitionBy(*by, "part").orderBy(value)
    placed = ranged.withColumn("in_part", F.sum("n").over(local)).join(F.broadcast(offsets), [*by, "part"])
    placed = placed.withColumn("upto", F.col("in_part") + F.col("before"))
    at = lambda q: F.floor((F.col("all") - 1) * F.lit(float(q)) + 0.5) + 1
    hit = lambda q: (F.col("upto") >= at(q)) & (F.col("upto") - F.col("n") < at(q))
    return placed.groupBy(*by).agg(*(F.max(F.when(hit(q), F.col(value))).alias(f"q{i}") for i, q in enumerate(quantiles)))


def column_quantiles(df: DataFrame, columns: list[str], quantiles: list[float]) -> dict[str, tuple[int, list[float | None]]]:
    """Exact nearest-rank quantiles of columns, nulls and NaN left out: each one's count and values.

    A sketch brackets each quantile, well beyond its own error; a second pass counts what lies below a bracket and the values
    in it, so few of the values are shuffled. Short columns are counted whole. A bracket that missed would be an error.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    around = sorted({min(1.0, max(0.0, q + m)) for q in quantiles for m in (-0.0005, 0.0005)})
    drawn = [F.percentile_approx(value[c], F.array(*map(F.lit, around)), F.lit(10000)).alias(f"q{i}") for i, c in enumerate(columns)]
    row = df.agg(*(F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)), *drawn).first()
    marks, below, rank = [], [], {}
    for i, c in enumerate(columns):
        for j, q in enumerate(quantiles):
            lo, hi = float("-inf"), float("inf")
            if row[f"n{i}"] > 10000:
                lo, hi = (row[f"q{i}"][around.index(min(1.0, max(0.0, q + m)))] for m in (-0.0005, 0.0005))
            rank[i, j] = math.floor((row[f"n{i}"] - 1) * q + 0.5)
            inside = (value[c] >= lo) & (value[c] <= hi)
            marks.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), value[c].alias("v"))))
            below.append(F.count_if(value[c] < lo).alias(f"b{i}_{j}"))
    less = df.agg(*below).first()
    near = df.select(F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    asked = df.sparkSession.createDataFrame([(i, j, r - less[f"b{i}_{j}"]) for (i, j), r in rank.items()], "i int, j int, r long")
    upto = F.sum("n").over(Window.partitionBy("i", "j").orderBy("v"))
    placed = near.select("x.*", "n").withColumn("upto", upto).join(F.broadcast(asked), ["i", "j"])
    hit = placed.filter((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("n") <= F.col("r")))
    found = {(r["i"], r["j"]): r["v"] for r in hit.select("i", "j", "v").collect()}  # a row a column and quantile
    out = {}
    for i, c in enumerate(columns):
        if row[f"n{i}"] and any((i, j) not in found for j in range(len(quantiles))):
            raise RuntimeError("a quantile lies outside of its bracket")
        out[c] = (row[f"n{i}"], [found.get((i, j)) for j in range(len(quantiles))])
    return out


def middle(value: str) -> Column:
    """A sketch of a column's middle as an aggregate, for ``medians``: ranks of 49.9 and 50.1 %, each within 0.01 %."""
    return F.percentile_approx(F.col(value), F.array(F.lit(0.499), F.lit(0.501)), F.lit(10000))


def medians(df: DataFrame, value: str, by: list[str], about: DataFrame | None = None) -> DataFrame:
    """(by..., median): exact medians of non-null values, for few groups of many rows.

    A sketch brackets each group's middle, well beyond its own error; a second pass counts what
    lies below the bracket and the values in it, so few of the distinct values are shuffled.
    Small groups are counted whole. A bracket that missed would be an error, not a result.
    ``about``: (by..., n, __q), where another aggregate of the same rows already has them.
    """
    known = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    if about is None:
        about = df.groupBy(*by).agg(F.count(value).alias("n"), middle(value).alias("__q"))
    few, inf = F.col("n") <= 10000, float("inf")
    about = about.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col("n").alias("__n"),
        F.when(few, F.lit(-inf)).otherwise(F.col("__q")[0]).alias("__lo"), F.when(few, F.lit(inf)).otherwise(F.col("__q")[1]).alias("__hi"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)))
    side = F.when(F.col("__v") < F.col("__lo"), 0).when(F.col("__v") <= F.col("__hi"), 1).otherwise(2)
    near = known.join(F.broadcast(about), same).withColumn("__side", side)
    counts = near.groupBy(*by, "__n", "__side", F.when(F.col("__side") == 1, F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy("__side", "__v"))
    placed = counts.withColumn("__upto", upto)
    at = lambda k: (F.col("__upto") > k) & (F.col("__upto") - F.col("__c") <= k)
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    value_at = lambda k: F.max(F.when(at(k), F.when(F.col("__side") == 1, F.col("__v"))
        .otherwise(F.raise_error(F.lit("a median lies outside of its bracket")).cast("double"))))
    return placed.groupBy(*by).agg((value_at(low) / 2 + value_at(high) / 2).alias("median"))


def top_rows(df: DataFrame, value: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows of the largest values, equal ones by ``ties``: by the k-th value, so only rows that tie with it are sorted."""
    known = df.filter(F.col(value).isNotNull())
    n = known.count()
    if k >= n:
        return known
    cut = nearest_quantiles(known, value, [(n - k) / max(1, n - 1)]).first()["q0"]
    above = known.filter(F.col(value) > cut)
    return above.unionByName(known.filter(F.col(value) == cut).orderBy(*ties).limit(k - above.count()))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation as an aggregate, null for a constant side (``corr`` raises there under ANSI)."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-15, F.try_divide(F.covar_pop(a, b), spread))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, for results that are compared across engines; -0.0 becomes 0.0.

    A thousandth of a step is added first, as engines differ on exact halves. Negative
    ``digits`` are significant ones.
    """
    nudge = 3.14159265 * 10.0 ** -(digits + 3)

    def shown(c: str) -> Column:
        if digits < 0:
            return F.format_string(f"%.{-digits - 1}e", c).cast("double")
        return F.round(F.col(c) + nudge, digits) + F.lit(0.0)

    return df.select(*(F.when(F.col(c).isNotNull(), shown(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
