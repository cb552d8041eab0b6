"""Instrument classification: one ordered chain of tests, the first that holds decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seed tickers of funds traded on an exchange.
ETF_SEEDS = ("SPY", "QQQ", "IWM", "DIA", "XLK", "XLF", "XLE", "XLV", "XLI", "XLY", "XLP", "XLB", "XLRE", "XLU", "XLC", "SMH", "HYG",
    "LQD")
# Official titles by ticker: (ticker, title, class, reason).
OFFICIAL = (("KMPB", "5.875% Fixed-Rate Reset Junior Subordinated Debentures due 2062", "DEBT", "junior_subordinated_debenture"),)
# Forms that only investment companies file; of these, forms of closed and of open funds.
COMPANY_FORMS = ("N-CSR", "N-CSRS", "N-CEN", "N-PORT", "N-PORT/A", "N-2", "N-2/A", "N-1A", "N-1A/A", "485BPOS", "24F-2NT", "N-PX",
    "N-MFP", "N-MFP2")
CLOSED_FORMS = ("N-2", "N-2/A")
OPEN_FORMS = ("N-1A", "N-1A/A")
# Patterns of closed funds' names.
FUND_NAMES = (
    r"MUNICIPAL INCOME TRUST",
    r"MUNICIPAL BOND (FUND|TRUST)",
    r"MUNICIPAL OPPORTUNIT",
    r"CLOSED[-\s]END",
    r"INVESTMENT TRUST",
    r"REGISTERED INVESTMENT",
    r"INCOME TRUST\s*$",
    r"BOND TRUST\s*$",
)
# Patterns of debt titles.
DEBT_TITLES = (
    r"JUNIOR SUBORDINATED",
    r"DEBENTURE",
    r"NOTES DUE",
    r"SENIOR NOTES",
    r"SUBORDINATED NOTES",
    r"FIXED-RATE RESET",
)
# Ticker rules in their order: (name, pattern, class, confidence, reason).
SUFFIXES = (
    ("preferred_hyphen", r".*-P[A-Z]?$", "PREFERRED", "high", "preferred_share_suffix"),
    ("preferred_pr", r".*-PR[A-Z]?$", "PREFERRED", "high", "preferred_share_suffix"),
    ("warrant_hyphen_wt", r".*-WT[A-Z]?$", "WARRANT", "high", "warrant_suffix"),
    ("warrant_hyphen_ws", r".*-WS[A-Z]?$", "WARRANT", "high", "warrant_suffix"),
    ("warrant_hyphen_w", r".*-W$", "WARRANT", "high", "warrant_suffix"),
    ("right_hyphen_ri", r".*-RI$", "RIGHT", "high", "right_suffix"),
    ("right_hyphen_rt", r".*-RT$", "RIGHT", "high", "right_suffix"),
    ("right_hyphen_r", r".*-R$", "RIGHT", "high", "right_suffix"),
    ("unit_hyphen_un", r".*-UN$", "UNIT", "high", "unit_suffix"),
    ("unit_hyphen_u", r".*-U$", "UNIT", "high", "unit_suffix"),
    ("share_class_common", r"^[A-Z]{1,5}-[A-C]$", "COMMON_EQUITY", "medium", None),
    ("possible_warrant_fifth_w", r"^[A-Z]{4}W$", "AMBIGUOUS", "low", "possible_warrant_fifth_letter_w"),
    ("possible_unit_fifth_u", r"^[A-Z]{4}U$", "AMBIGUOUS", "low", "possible_unit_fifth_letter_u"),
    ("possible_right_fifth_r", r"^[A-Z]{4}R$", "AMBIGUOUS", "low", "possible_right_fifth_letter_r"),
)
SIMPLE = r"^[A-Z][A-Z0-9]{0,4}$"
# Exchanges on which a simple ticker is common equity, and entity types of investment companies.
EXCHANGES = ("NYSE", "Nasdaq", "CBOE", "NYSE American", "NYSEArca", "NYSE ARCA")
ENTITIES = ("investment company", "investment-company", "other")


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    """Does one of the patterns occur, in either case? Null doesn't match."""
    return F.coalesce(reduce(lambda a, b: a | b, (c.rlike(f"(?i){p}") for p in patterns)), F.lit(False))


def _found(kind: str | Column, source: str, confidence: str, reason: str | None) -> Column:
    text = F.lit(None).cast("string") if reason is None else F.lit(reason)
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("c"), F.lit(source).alias("s"), F.lit(confidence)
        .alias("k"), text.alias("r"))


def classify(securities: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """(security_id, ticker, instrument_class, source, confidence, exclusion_reason) of each security.

    ``securities``: security_id, primary_ticker, exchange, company_name, and where known
    security_title and entity_type. A security's forms are collected from ``filings``; the chain
    then is one expression, so all of it is one pass.
    """
    df = securities
    if filings is not None:
        df = df.join(filings.groupBy("security_id").agg(F.collect_set(F.upper("form_type")).alias("__forms")), "security_id", "left")
    else:
        df = df.withColumn("__forms", F.lit(None).cast("array<string>"))
    given = lambda c: F.col(c) if c in securities.columns else F.lit(None).cast("string")
    t = F.upper(F.trim(F.coalesce(F.col("primary_ticker"), F.lit(""))))
    has = lambda forms: F.coalesce(F.arrays_overlap("__forms", F.array(*map(F.lit, forms))), F.lit(False))
    fund = F.when(has(OPEN_FORMS) & ~has(CLOSED_FORMS), "FUND").otherwise("CLOSED_END_FUND")
    title, name, entity = given("security_title"), F.col("company_name"), F.lower(F.trim(given("entity_type")))
    registrant = "SEC_REGISTRANT_TYPE"
    chain: list[tuple[Column, Column]] = [(t == "", _found("AMBIGUOUS", "simple_us_ticker", "low", "missing_ticker"))]
    chain += [(t.isin(*ETF_SEEDS), _found("ETF", "etf_seed", "high", "benchmark_or_sector_etf"))]
    chain += [(t == ticker, _found(kind, "SEC_SECURITY_TITLE", "high", reason)) for ticker, _, kind, reason in OFFICIAL]
    chain += [(_any(title, DEBT_TITLES), _found("DEBT", "SEC_SECURITY_TITLE", "high", "debt_security_title"))]
    chain += [(has(COMPANY_FORMS), _found(fund, registrant, "high", "investment_company_sec_forms"))]
    closed = _found("CLOSED_END_FUND", registrant, "high", "sec_entity_type_investment_company")
    chain += [(F.coalesce(entity.isin(*ENTITIES), F.lit(False)) & _any(name, FUND_NAMES), closed)]
    chain += [(_any(name, FUND_NAMES), _found("CLOSED_END_FUND", registrant, "high", "registered_investment_company_registrant_name"))]
    chain += [(t.rlike(pattern), _found(kind, "ticker_suffix_heuristic", confidence, reason))
        for _, pattern, kind, confidence, reason in SUFFIXES]
    listed = F.col("exchange").isNull() | F.col("exchange").isin(*EXCHANGES)
    chain += [(t.rlike(SIMPLE) & listed, _found("COMMON_EQUITY", "simple_us_ticker", "medium", None))]
    picked = F.when(*chain[0])
    for test, result in chain[1:]:
        picked = picked.when(test, result)
    made = df.withColumn("__x", picked.otherwise(_found("AMBIGUOUS", "simple_us_ticker", "low", "unrecognized_ticker_pattern")))
    names = {"c": "instrument_class", "s": "source", "k": "confidence", "r": "exclusion_reason"}
    return made.select("security_id", t.alias("ticker"), *(F.col(f"__x.{k}").alias(v) for k, v in names.items()))
