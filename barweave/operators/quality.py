"""Data-quality rules and audits: each rule maps rows to issues and never changes them.

An issue is (security_id, date, issue_type, severity, details). Issues are stored under a
deterministic id, reopened when they come back and resolved when they no longer do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import change
from .features import VALUES as FEATURES
from .features import at_least, ohlc_valid
from .labels import VALUES as LABELS

CRITICAL, WARNING, INFO = "critical", "warning", "info"
ISSUE = ["security_id", "date", "issue_type", "severity", "details"]


def _issues(df: DataFrame, kind: str, severity: str | Column, details: Column | None = None,
    kind_of: Column | None = None) -> DataFrame:
    return df.select(
        F.col("security_id").cast("string").alias("security_id"), F.col("date"), (F.lit(kind) if kind_of is None else kind_of)
            .alias("issue_type"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit("") if details is None else details)
            .cast("string").alias("details"),
    )


def _where_columns(df: DataFrame, columns: list[str], bad, kind: str, severity: str, kind_of=None) -> DataFrame:
    """One issue a row and column that is bad: the columns become rows, so the table is read once."""
    found = F.filter(F.array(*(F.when(bad(F.col(c)), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    rows = df.withColumn("__c", F.explode(found))
    return _issues(rows, kind, severity, F.col("__c"), None if kind_of is None else kind_of(F.col("__c")))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def negative_prices(prices: DataFrame) -> DataFrame:
    """NEGATIVE_PRICE for each of five price columns, NEGATIVE_VOLUME for the volume."""
    columns = ["open", "high", "low", "close", "adj_close", "volume"]
    return _where_columns(prices, columns, lambda c: c < 0, "", CRITICAL, lambda c: F.when(c == "volume", "NEGATIVE_VOLUME")
        .otherwise("NEGATIVE_PRICE"))


def ohlc_consistency(prices: DataFrame) -> DataFrame:
    """OHLC_INCONSISTENT beyond tolerance, OHLC_ROUNDING_TOLERANCE within, for each of five comparisons."""
    pairs = (("high", "open"), ("high", "close"), ("high", "low"), ("open", "low"), ("close", "low"))
    found = F.array(*(F.when(F.col(a) < F.col(b), F.struct(F.lit(f"{a}<{b}").alias("what"), at_least(a, b).alias("near")))
        for a, b in pairs))
    rows = prices.withColumn("__x", F.explode(F.filter(found, lambda x: x.isNotNull())))
    near = F.col("__x.near")
    return _issues(rows, "", F.when(near, INFO).otherwise(CRITICAL), F.col("__x.what"), F.when(near, "OHLC_ROUNDING_TOLERANCE")
        .otherwise("OHLC_INCONSISTENT"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """DUPLICATE_KEY for keys that come more than once."""
    again = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return _issues(again, "DUPLICATE_KEY", CRITICAL, F.concat(F.lit("rows="), F.col("n")))


def weekend_dates(df: DataFrame) -> DataFrame:
    return _issues(df.filter(F.weekday("date") >= 5), "WEEKEND_DATE", WARNING, F.date_format("date", "EEEE"))


def invalid_dates(df: DataFrame, today: str, first: str = "1990-01-01") -> DataFrame:
    return _issues(df.filter((F.col("date") > F.lit(today).cast("date")) | (F.col("date") < F.lit(first).cast("date"))),
        "INVALID_DATE", CRITICAL)


def high_null_ratio(prices: DataFrame, limit: float = 0.05) -> DataFrame:
    """Securities with a larger share of missing closes; the share is shown by its exact binary value, halves to even as C does."""
    share = prices.groupBy("security_id").agg(F.avg(F.col("close").isNull().cast("double")).alias("share"))
    return _issues(share.filter(F.col("share") > limit)
        .withColumn("date", F.lit(None).cast("date")), "HIGH_NULL_RATIO", WARNING, F.expr("format_number(share, '0.0000')"))


def sudden_changes(prices: DataFrame, sudden: float = 0.8, split: float = 0.45) -> DataFrame:
    """SUDDEN_PRICE_CHANGE, or SUSPECTED_SPLIT_ADJUSTMENT on bars that report a split; against the last known close."""
    known = F.last("close", True).over(Window.partitionBy("security_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    df = prices.withColumn("__pct", F.abs(change("close", known)))
    by_split = (F.coalesce(F.col("stock_split"), F.lit(0.0)) != 0) & (F.col("__pct") >= split)
    rows = df.filter(by_split | (F.col("__pct") >= sudden))
    return _issues(rows, "", F.when(by_split, INFO)
        .otherwise(WARNING), F.format_string("%.4f", "__pct"), F.when(by_split, "SUSPECTED_SPLIT_ADJUSTMENT")
            .otherwise("SUDDEN_PRICE_CHANGE"))


def missing_recent(prices: DataFrame, targets: DataFrame, sessions: DataFrame, expected: str, grace: int = 5) -> DataFrame:
    """MISSING_RECENT_DATA for targets whose last bar is older than ``grace`` sessions before ``expected``, or that have none."""
    cut = sessions.filter(F.col("date") <= F.lit(expected).cast("date")).orderBy(F.col("date")
        .desc()).limit(grace + 1).agg(F.min("date").alias("cut"))
    last = prices.groupBy("security_id").agg(F.max("date").alias("last"))
    df = targets.select("security_id").join(last, "security_id", "left").join(F.broadcast(cut))
    return _issues(df.filter(F.col("last").isNull() | (F.col("last") < F.col("cut")))
        .withColumn("date", F.col("last")), "MISSING_RECENT_DATA", WARNING)


def rsi_bounds(features: DataFrame) -> DataFrame:
    return _issues(features.filter((F.col("rsi_14") < 0) | (F.col("rsi_14") > 100)), "RSI_OUT_OF_BOUNDS", CRITICAL)


def negative_features(features: DataFrame) -> DataFrame:
    kinds = {"atr_14": "NEGATIVE_ATR",
        "atr_pct_14": "NEGATIVE_ATR"} | {f"volume_ratio_{n}d": "NEGATIVE_VOLUME_RATIO"
        for n in (5, 20, 60)} | {f"volatility_{n}d": "NEGATIVE_VOLATILITY" for n in (10, 20, 60)}

    def kind(c: Column) -> Column:
        return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), kinds.items(), F.lit(None).cast("string"))

    return _where_columns(features, list(kinds), lambda c: c < 0, "", CRITICAL, kind)


def distance_above(features: DataFrame, tolerance: float = 0.01) -> DataFrame:
    return _where_columns(features, [f"distance_high_{n}d" for n in (20, 60, 252)], lambda c: c > tolerance,
        "DISTANCE_HIGH_ABOVE_TOLERANCE", WARNING)


def non_finite(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    bad = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return _where_columns(features, columns or FEATURES, bad, "NON_FINITE_FEATURE", CRITICAL)


def below_minus_one(labels: DataFrame) -> DataFrame:
    return _where_columns(labels, [c for c in LABELS if c.startswith("forward_return")], lambda c: c < -1,
        "FORWARD_RETURN_BELOW_MINUS_ONE", CRITICAL)


def extreme_labels(labels: DataFrame, limit: float = 2.0) -> DataFrame:
    return _where_columns(labels, LABELS, lambda c: F.abs(c) > limit, "EXTREME_LABEL", WARNING)


def invalid_adjustment(prices: DataFrame) -> DataFrame:
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))) | (F.col(c) == 0)
    return _issues(prices.filter(bad("close") | bad("adj_close")), "ADJUSTMENT_FACTOR_INVALID", WARNING)


def check_prices(prices: DataFrame, today: str) -> DataFrame:
    return union([negative_prices(prices), ohlc_consistency(prices), weekend_dates(prices), invalid_dates(prices, today),
        high_null_ratio(prices), sudden_changes(prices)])


def check_features(features: DataFrame) -> DataFrame:
    return union([rsi_bounds(features), negative_features(features), distance_above(features), non_finite(features),
        duplicate_keys(features, ["security_id", "date", "feature_version"])])


def check_labels(labels: DataFrame) -> DataFrame:
    return union([below_minus_one(labels), extreme_labels(labels), duplicate_keys(labels, ["security_id", "date", "label_version"])])


def issue_id(dataset: str) -> Column:
    """The first 32 hex digits of the SHA-256 of dataset, security, date and type."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat_ws("|", F.lit(dataset), text("security_id"), text("date"), text("issue_type"))
        .cast("binary"), 256), 1, 32)


def upsert_issues(stored: DataFrame, found: DataFrame, dataset: str, at: str) -> DataFrame:
    """Stored issues with ``found`` merged in: new ones open, known ones updated and reopened, others as they were."""
    new = found.withColumn("issue_id",
        issue_id(dataset)).groupBy("issue_id").agg(*(F.min(F.struct("details", "severity", "security_id", "date", "issue_type"))
            .getField(c).alias(c) for c in ISSUE))
    s, n = stored.alias("s"), new.alias("n")
    hit = F.col("n.issue_id").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return s.join(n, F.col("s.issue_id") == F.col("n.issue_id"), "full_outer").select(
        F.coalesce("s.issue_id", "n.issue_id").alias("issue_id"), F.coalesce("s.dataset", F.lit(dataset))
            .alias("dataset"), *(pick(c) for c in ISSUE),
        F.coalesce("s.detected_at", F.lit(at)).alias("detected_at"), F.when(hit, False).otherwise(F.col("s.resolved"))
            .alias("resolved"),
    )


def resolve_missing(stored: DataFrame, found: DataFrame, dataset: str, scope: DataFrame) -> DataFrame:
    """Open issues of the securities in ``scope`` that weren't found again become resolved."""
    again = found.select(issue_id(dataset).alias("issue_id")).distinct().withColumn("__again", F.lit(True))
    inside = scope.select("security_id").distinct().withColumn("__inside", F.lit(True))
    joined = stored.join(again, "issue_id", "left").join(inside, "security_id", "left")
    gone = F.col("__inside").isNotNull() & F.col("__again").isNull() & (F.col("dataset") == dataset) & ~F.col("resolved")
    return joined.withColumn("resolved", F.col("resolved") | gone).select(*stored.columns)


def resolve_out_of_scope(stored: DataFrame, scope: DataFrame, dataset: str, kind: str = "MISSING_RECENT_DATA") -> DataFrame:
    """Open issues of a kind become resolved for securities that are no longer in scope."""
    inside = scope.select("security_id").distinct().withColumn("__inside", F.lit(True))
    gone = (F.col("dataset") == dataset) & (F.col("issue_type") == kind) & F.col("__inside").isNull() & ~F.col("resolved")
    return stored.join(inside, "security_id", "left").withColumn("resolved", F.col("resolved") | gone).select(*stored.columns)


def scoped(df: DataFrame, scope: DataFrame | list[str] | None) -> DataFrame:
    """Rows of the securities in scope: a table of ids, a list, or None for all."""
    if scope is None:
        return df
    if isinstance(scope, list):
        return df.filter(F.col("security_id").isin(scope))
    return df.join(scope.select("security_id").distinct(), "security_id", "left_semi")


def severities(issues: DataFrame) -> DataFrame:
    """(issues, critical, warning, info): what a validation reports."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(F.count("*").alias("issues"), of(CRITICAL).alias("critical"), of(WARNING).alias("warning"), of(INFO)
        .alias("info"))


def _with_class(df: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """``df`` with the security's class (AMBIGUOUS without one) and whether it is a common equity of the research universe."""
    known = classes.select("security_id", "instrument_class")
    inside = members.select("security_id").distinct().withColumn("__member", F.lit(True))
    out = df.join(known, "security_id", "left").join(inside, "security_id", "left")
    out = out.withColumn("instrument_class", F.coalesce("instrument_class", F.lit("AMBIGUOUS")))
    return out.withColumn("in_research", F.col("__member")
        .isNotNull() & (F.col("instrument_class") == "COMMON_EQUITY")).drop("__member")


def ohlc_audit(prices: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(rows_checked, rounding_only, true_ohlc_violations, research_critical, non_common_critical, research_critical_securities).

    Contradictions within rounding are told from true ones, and those of the research universe's
    common equities from all others.
    """
    issues = _with_class(ohlc_consistency(prices), classes, members)
    true = F.col("severity") == CRITICAL
    counts = issues.agg(
        F.count_if(F.col("issue_type") == "OHLC_ROUNDING_TOLERANCE").alias("rounding_only"), F.count_if(true)
            .alias("true_ohlc_violations"),
        F.count_if(true & F.col("in_research")).alias("research_critical"), F.count_if(true & ~F.col("in_research"))
            .alias("non_common_critical"),
        F.countDistinct(F.when(true & F.col("in_research"), F.col("security_id"))).alias("research_critical_securities"),
    )
    return prices.agg(F.count("*").alias("rows_checked")).crossJoin(counts)


# Causes of extreme labels.
EXTREME_MARKET, NON_COMMON, ADJUSTMENT, BAD_DATA, UNEXPLAINED = (
    "A_EXTREME_MARKET", "B_NON_COMMON_INSTRUMENT", "C_ADJUSTMENT_ARTIFACT", "D_PROVIDER_BAD_DATA", "E_UNEXPLAINED",
)
NEAR_DAYS, ADJUSTED_JUMP, RAW_STABLE = 5, 2.0, 0.5


def extreme_label_audit(labels: DataFrame, prices: DataFrame, actions: DataFrame, classes: DataFrame, members: DataFrame,
    limit: float = 2.0) -> DataFrame:
    """One row an extreme label, of all label columns: (security_id, date, horizon, value, instrument_class, near_action, adjusted_jump, cause, in_research).

    The cause is the first that holds: not a common equity or fund; the adjusted close jumped
    while the raw one was stable (an artefact near an action or split, bad data elsewhere); a
    bar that contradicts itself; a real move; or unexplained without a bar. An action is near
    within NEAR_DAYS calendar days. Labels are few, so bars and actions are looked up for
    their securities and dates only.
    """
    columns = F.array(*(F.struct(F.lit(c).alias("horizon"), F.col(c).alias("value")) for c in LABELS))
    rows = labels.select("security_id", "date", F.explode(columns)
        .alias("x")).select("security_id", "date", "x.*").filter(F.abs("value") > limit)
    days = rows.select("security_id", "date").distinct()
    near = days.join(actions.select("security_id", "effective_date").distinct(), "security_id")
    near = near.filter(F.abs(F.datediff("date", "effective_date")) <= NEAR_DAYS).select("security_id",
        "date").distinct().withColumn("__near", F.lit(True))
    by = Window.partitionBy("security_id").orderBy("date")
    moved = {f"__{n}": change(c, F.lag(c).over(by)) for n, c in (("adj", "adj_close"), ("raw", "close"))}
    complete = F.lit(True)
    for c in ("open", "high", "low", "close"):
        complete = complete & F.col(c).isNotNull()
    of = prices.join(days.select("security_id").distinct(), "security_id", "left_semi").withColumns(moved)
    split = ~F.coalesce(F.col("stock_split"), F.lit(0.0)).isin(0.0, 1.0)
    of = of.select("security_id", "date", "__adj", "__raw", split.alias("__split"), (complete & ohlc_valid())
        .alias("__ok"), F.lit(True).alias("__bar"))
    found = rows.join(near, ["security_id", "date"], "left").join(of, ["security_id", "date"], "left")
    found = _with_class(found, classes, members)
    yes = lambda c: F.coalesce(c, F.lit(False))
    near_action, jump = yes(F.col("__near")) | yes(F.col("__split")), yes(F.abs("__adj") > ADJUSTED_JUMP)
    artefact = jump & yes(F.abs("__raw") < RAW_STABLE)
    cause = (
        F.when(~F.col("instrument_class").isin("COMMON_EQUITY", "ETF"), NON_COMMON)
        .when(artefact, F.when(near_action, ADJUSTMENT).otherwise(BAD_DATA))
        .when(F.col("__bar").isNotNull(), F.when(F.col("__ok"), EXTREME_MARKET).otherwise(BAD_DATA))
        .otherwise(UNEXPLAINED)
    )
    made = found.withColumns({"near_action": near_action, "adjusted_jump": jump, "cause": cause})
    return made.select("security_id", "date", "horizon", "value", "instrument_class", "near_action", "adjusted_jump", "cause",
        "in_research")


def extreme_label_report(audit: DataFrame, k: int = 30) -> dict[str, DataFrame]:
    """Counts by security, class, horizon, cause and date, the largest and smallest values, and rows of the research
    universe without a good cause.
    """
    count = lambda c: audit.groupBy(c).agg(F.count("*").alias("n"))
    suspect = F.col("in_research") & F.col("cause").isin(ADJUSTMENT, BAD_DATA, UNEXPLAINED)
    ends = ["security_id", "date", "horizon"]
    return {
        "by_security": count("security_id"), "by_class": count("instrument_class"), "by_horizon": count("horizon"),
        "by_cause": count("cause"),
        "by_date": count("date").orderBy(F.col("n").desc(), "date").limit(k), "research_unexplained": audit.filter(suspect),
        "largest_positive": audit.orderBy(F.col("value").desc(), *ends).limit(k),
        "largest_negative": audit.filter(F.col("value") < 0).orderBy("value", *ends).limit(k),
    }
