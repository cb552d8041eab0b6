"""Readers of raw provider files and the normalisers that turn them into typed, deduplicated rows.

Raw values that can't be read are null; prices are never filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMS = ("10-K", "10-Q", "8-K", "20-F", "6-K", "N-CSR", "N-1A", "N-2", "S-1")
NON_COMMERCIAL = ("csv_prices",)


def license_guard(provider: str, commercial: bool) -> None:
    """Refuse a provider whose data may not be used commercially."""
    if commercial and provider in NON_COMMERCIAL:
        raise PermissionError(f"{provider} may not be used in commercial mode")


def number(c: str | Column) -> Column:
    """A double, or null for blanks, dots and what isn't a number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.trim(c.cast("string")).isin("", "."), F.trim(c.cast("string")).try_cast("double"))


def day(c: str, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy")) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.col(c).cast("string"), F.lit(f)).cast("date") for f in formats))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that repeat a key the one that came last; rows that came at once are settled by their hash."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.xxhash64(*df.columns))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def _numbered(df: DataFrame) -> DataFrame:
    """Rows numbered as they are read: a provider's file is one partition's rows in order."""
    return df.withColumn("__seq", F.monotonically_increasing_id())


def _sequenced(df: DataFrame) -> DataFrame:
    return df if "__seq" in df.columns else _numbered(df)


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars, one header row; __seq tells which of repeated rows came last."""
    return _numbered(spark.read.option("header", "true").csv(path))


def normalise_prices(raw: DataFrame, security_id: str | Column, ticker: str | Column, currency: str = "USD",
    provider: str = "csv_prices", retrieved_at: str | None = None) -> DataFrame:
    """Price rows: missing prices stay null, missing dividends and splits are 0; of repeated dates the last row stays."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    df = _sequenced(raw).select(
        lit(security_id).alias("security_id"), lit(ticker).alias("ticker_at_time"), day("date").alias("date"),
        *(number(c).alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume")),
        *(F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("dividend", "stock_split")), F.lit(currency)
            .alias("currency"), F.lit(provider).alias("provider"),
        (F.current_timestamp() if retrieved_at is None else F.lit(retrieved_at).cast("timestamp")).alias("retrieved_at"), "__seq",
    )
    return keep_last(df.filter(F.col("date").isNotNull()), ["security_id", "date"], "__seq").drop("__seq")


def corporate_actions(prices: DataFrame) -> DataFrame:
    """DIVIDEND and SPLIT rows of bars that report one."""
    both = F.array(F.struct(F.lit("DIVIDEND").alias("t"), F.col("dividend").alias("v")),
        F.struct(F.lit("SPLIT").alias("t"), F.col("stock_split").alias("v")))
    rows = prices.withColumn("__x", F.explode(F.filter(both, lambda x: x["v"].isNotNull() & (x["v"] != 0))))
    return rows.select("security_id", F.col("date").alias("effective_date"), F.col("__x.t").alias("action_type"), F.col("__x.v")
        .alias("value"))


def read_security_master(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document {fields, data}: positional rows become (cik, name, ticker, exchange)."""
    doc = spark.read.schema("fields array<string>, data array<array<string>>").option("multiLine", "true").json(path)
    row = doc.select("fields", F.explode("data").alias("r"))
    at = lambda n: F.get(F.col("r"), (F.array_position("fields", n) - 1).cast("int"))
    return row.select(at("cik").try_cast("long").alias("cik"), at("name").alias("name"), at("ticker").alias("ticker"), at("exchange")
        .alias("exchange"))


def normalise_universe(master: DataFrame, day_: str) -> dict[str, DataFrame]:
    """securities, identifiers and snapshots; ids are CIK%010d, with the ticker where a CIK has several."""
    df = _sequenced(master).filter(F.col("cik").isNotNull() & F.col("ticker")
        .isNotNull()).withColumn("ticker", F.upper(F.trim("ticker")))
    df = keep_last(df, ["cik", "ticker"], "__seq")
    several = F.count("*").over(Window.partitionBy("cik")) > 1
    base = F.format_string("CIK%010d", "cik")
    df = df.withColumn("security_id", F.when(several, F.concat(base, F.lit("-"), F.regexp_replace("ticker", "[^A-Z0-9]", "")))
        .otherwise(base))
    securities = df.select("security_id", "cik", F.col("name").alias("company_name"), "exchange", F.col("ticker")
        .alias("primary_ticker"))
    kinds = F.explode(F.array(F.struct(F.lit("TICKER").alias("t"), F.col("ticker").alias("v")),
        F.struct(F.lit("CIK").alias("t"), F.col("cik").cast("string").alias("v"))))
    ids = df.select("security_id", kinds.alias("x")).select("security_id", F.col("x.t").alias("identifier_type"), F.col("x.v")
        .alias("identifier_value"), F.lit(day_).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return {"securities": securities, "identifiers": ids, "snapshots": securities.withColumn("snapshot_date", F.lit(day_).cast("date"))}


def seed_universe(seeds: DataFrame, known: DataFrame) -> DataFrame:
    """Seed tickers that no security has yet, with ids of their own."""
    return seeds.join(known.select(F.col("primary_ticker").alias("ticker")), "ticker",
        "left_anti").select(F.concat(F.lit("TCK"), F.regexp_replace("ticker", "[^A-Z0-9]", "")).alias("security_id"), F.col("ticker")
        .alias("primary_ticker"), F.col("name").alias("company_name"))


def provider_symbols(securities: DataFrame, overrides: DataFrame) -> DataFrame:
    """The symbol a provider knows a security by: an override, else the ticker with dots as dashes."""
    return securities.join(overrides.select("security_id", "provider_symbol"), "security_id", "left").select("security_id",
        "primary_ticker", F.coalesce("provider_symbol", F.replace(F.col("primary_ticker"), F.lit("."), F.lit("-"))).alias("symbol"))


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Columnar filing arrays as rows of the wanted forms, with their address."""
    doc = spark.read.schema("cik string, filings "
        "struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,primaryDocument:array<string>>>").option("multiLine", "true").json(path)
    r = F.col("filings.recent")
    rows = doc.select("cik",
        F.explode(F.arrays_zip(r["accessionNumber"].alias("a"), r["form"].alias("f"), r["filingDate"].alias("d"),
            r["primaryDocument"].alias("p"))).alias("x"))
    address = F.concat_ws("/", F.lit("Archives/edgar/data"), F.ltrim(F.col("cik"), F.lit("0")),
        F.replace(F.col("x.a"), F.lit("-"), F.lit("")), F.col("x.p"))
    return rows.filter(F.col("x.f").isin(*FORMS)).select("cik", F.col("x.a").alias("accession_number"), F.col("x.f")
        .alias("form_type"), F.col("x.d").alias("filing_date"), address.alias("url"))


def normalise_filings(raw: DataFrame, security_id: Column) -> DataFrame:
    """Typed filings; rows without accession number, form or date are skipped, accession numbers come once a security."""
    df = _sequenced(raw).select(security_id.alias("security_id"), "accession_number", "form_type", day("filing_date")
        .alias("filing_date"), "url", "__seq")
    known = df.dropna(subset=["accession_number", "form_type", "filing_date"])
    return keep_last(known, ["security_id", "accession_number"], "__seq").drop("__seq")


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """Observations of one series document: (series_id, date, value), dots and blanks as null."""
    doc = spark.read.schema("series_id string, observations array<struct<date:string,value:string>>").option("multiLine",
        "true").json(path)
    return doc.select("series_id", F.explode("observations").alias("o")).select("series_id", F.col("o.date")
        .alias("date"), F.col("o.value").alias("value"))


def normalise_macro(raw: DataFrame) -> DataFrame:
    """Typed observations; of a repeated date the last one stays."""
    df = _sequenced(raw).select("series_id", day("date").alias("date"), number("value").alias("value"), "__seq").filter(F.col("date")
        .isNotNull())
    return keep_last(df, ["series_id", "date"], "__seq").drop("__seq")


def read_vix_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily index levels: headers in any case, MM/DD/YYYY dates, unreadable values null."""
    df = spark.read.option("header", "true").csv(path)
    return normalise_vix(_numbered(df.toDF(*(c.strip().lower() for c in df.columns))))


def normalise_vix(raw: DataFrame) -> DataFrame:
    """Typed index levels; of a repeated date the last row stays."""
    prices = [number(c).alias(c) for c in ("open", "high", "low", "close")]
    df = _sequenced(raw).select(day("date", ("MM/dd/yyyy", "yyyy-MM-dd")).alias("date"), *prices, "__seq").filter(F.col("date")
        .isNotNull())
    return keep_last(df, ["date"], "__seq").drop("__seq")


SHORT_VOLUME = "security_id string, date date, short_volume double, total_volume double, retrieved_at timestamp"
