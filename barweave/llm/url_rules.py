"""URL filters: explicit rules first, mined association rules for the rest.

FP-growth mines combinations of URL tokens together with the verdict of labelled URLs.
Rules "tokens -> block" that pass support and confidence, and don't merely repeat a
shorter rule, become the model; a URL is matched against it by an inverted index from
each rule's rarest token.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

#: The explicit rules, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
#: Longest antecedent: a parameter of the model.
MAX_TOKENS = 4
#: FP-growth builds the sets of all lengths of a row's tokens: up to so many it does.
MAX_GROWN = 12
BLOCK, ALLOW = "=block", "=allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = "page_id long, host string, path string, rule string, verdict string, mined string, confidence double"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest explicit rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """A URL's distinct tokens: scheme, host labels and the host's last two, path segments (numbers as #), extension, query keys."""
    parts = lambda text, pattern: F.filter(F.split(text, pattern, -1), lambda x: x != "")
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    whole = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(whole, r"(?s)\?([^#]*)", 1)
    segments = F.transform(parts(path, "/"), lambda s: F.regexp_replace(s, r"[0-9]+", "#"))
    return F.array_distinct(
        F.concat(
            tagged("scheme:", F.filter(F.array(F.regexp_extract(whole, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)), lambda x: x != "")),
            tagged("label:", parts(host, r"\.")),
            tagged("site:", F.filter(F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)\z", 1)), lambda x: x != "")),
            tagged("segment:", segments),
            tagged("key:", F.transform(parts(query, "&"), lambda kv: F.substring_index(kv, "=", 1))),
        )
    )


def _useful(labelled: DataFrame, least: float) -> DataFrame:
    """(token, alone) of the tokens that a rule can have: those of enough blocked rows; ``alone``: it blocks by itself, always.

    A rule's tokens are all in its blocked rows, so none is lost. A token that blocks always
    is a rule, and any longer one with it would only repeat it.
    """
    counts = labelled.select(F.explode("tokens").alias("token"), (F.col("verdict") == "block").cast("int").alias("hit"))
    counts = counts.groupBy("token").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).filter(F.col("hits") >= least)
    return counts.select("token", (F.col("hits") == F.col("n")).alias("alone"))


def _grown(rows: DataFrame, least: float) -> DataFrame:
    """(tokens, freq, hits) of the token sets of up to MAX_TOKENS with enough blocked rows, by Spark's FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    total = rows.count()
    items = rows.select(F.array_union("tokens", F.array(F.when(F.col("hit") == 1, BLOCK).otherwise(ALLOW))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least - 0.5, 0.5) / total), minConfidence=1.0).fit(items).freqItemsets
    sets = sets.filter((F.size("items") <= MAX_TOKENS + 1) & ~F.array_contains("items", ALLOW))
    hits = sets.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCK))
        .alias("tokens"), F.col("freq").alias("hits"))
    plain = sets.filter(~F.array_contains("items", BLOCK)).select(F.array_sort("items").alias("tokens"), "freq")
    return hits.join(plain, "tokens").filter(F.col("hits") >= least)


def _levelled(rows: DataFrame, least: float) -> DataFrame:
    """The same sets, one length after the other: a row's sets of a length are its shorter frequent ones, each with a later token."""
    at = rows.select(F.monotonically_increasing_id().alias("row"), F.array_sort("tokens").alias("all"), "hit")
    at = stored(at)
    found = None
    now = at.select("row", "all", "hit", F.explode("all").alias("t")).select("row", "all", "hit", F.array("t").alias("tokens"))
    for size in range(1, MAX_TOKENS + 1):
        counted = stored(now.groupBy("tokens").agg(F.count("*").alias("freq"), F.sum("hit").alias("hits"))
            .filter(F.col("hits") >= least))
        found = counted if found is None else found.unionByName(counted)
        if size < MAX_TOKENS:
            kept = stored(now.join(counted.select("tokens"), "tokens", "left_semi"))
            later = F.explode(F.filter("all", lambda t: t > F.element_at("tokens", -1)))
            now = kept.select("row", "all", "hit", "tokens", later.alias("t")).select("row", "all", "hit",
                F.concat("tokens", F.array("t")).alias("tokens"))
    return found


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE) -> list[tuple[tuple[str, ...], float, float]]:
    """Rules (tokens, confidence, support) for blocking from rows (tokens, verdict), by Spark's FP-growth.

    Rules have up to MAX_TOKENS tokens. One is left out if a shorter one within it is as
    confident. Tokens that no rule can have are cut first; where a row still has more than
    MAX_GROWN, whose sets of all lengths FP-growth would build, the sets are counted length by
    length instead, with the same result. No rows, or no blocked rows, give no rules. What
    comes to the driver is the model: rules that don't repeat each other, each in
    ``min_support`` of the rows.
    """
    total = labelled.count()
    least = max(1.0, min_support * total)
    useful = stored(_useful(labelled, least))
    if not useful.limit(1).count():
        return []
    tokens = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", (F.col("verdict") == "block").cast("int")
        .alias("hit"))
    told = tokens.select("row", "hit", F.explode("tokens").alias("token")).join(useful, "token")
    single = told.filter("alone").groupBy(F.array("token").alias("tokens")).agg(F.count("*").alias("freq"), F.sum("hit").alias("hits"))
    rows = stored(told.filter(~F.col("alone")).groupBy("row", "hit").agg(F.collect_set("token").alias("tokens"))
        .select("tokens", "hit"))
    widest = rows.agg(F.max(F.size("tokens"))).first()[0] or 0
    sets = single
    if widest:
        made = _grown(rows, least) if widest <= MAX_GROWN else _levelled(rows, least)
        sets = single.unionByName(made.select("tokens", "freq", "hits"))
    rules = stored(sets.withColumn("confidence", F.col("hits") / F.col("freq")).filter(F.col("confidence") >= min_confidence)
        .select("tokens", "hits", "confidence"))
    # A rule's proper subsets, by the bits of a mask over its tokens.
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("tokens")) - 2).cast("int"))
    inner = F.transform(masks, lambda m: F.filter(F.col("tokens"), lambda t, i: F.getbit(m, i) == 1))
    parts = rules.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode(inner).alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("known"))
    repeats = parts.join(shorter, "part").filter(F.col("known") >= F.col("confidence")).select("tokens").distinct()
    kept = rules.join(repeats, "tokens", "left_anti").collect()
    return sorted(((tuple(r["tokens"]), float(r["confidence"]), r["hits"] / total) for r in kept), key=lambda r: (len(r[0]), r[0]))


class RuleIndex:
    """Inverted index of mined rules: each is filed under the token that the fewest rules have."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float, float]]):
        uses: dict[str, int] = defaultdict(int)
        for tokens, _, _ in rules:
            for t in tokens:
                uses[t] += 1
        self.filed: dict[str, list[tuple[frozenset[str], float, float, str]]] = defaultdict(list)
        for tokens, confidence, support in rules:
            self.filed[min(tokens, key=lambda t: (uses[t], t))].append((frozenset(tokens), confidence, support, " ".join(tokens)))

    def best(self, tokens: list[str]) -> tuple[float, str] | None:
        """The matching rule of the highest confidence, then support, then smallest text."""
        have = set(tokens)
        found = [(-confidence, -support, text) for t in have for need, confidence, support, text in self.filed.get(t, ())
            if need <= have]
        if not found:
            return None
        confidence, _, text = min(found)
        return -confidence, text


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per page: host, path, explicit rule and verdict; without a rule, block if a mined rule matches, else allow.

    The labels that are mined are the verdicts of the pages that have an explicit rule. A
    null url, or one without ``://``, has an empty host and path and is allowed; a null
    page_id stays null; repeated rows stay repeated; other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    name, verdict = _rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", name).withColumn("said", verdict).withColumn("tokens",
        tokens_of(F.col("url"), F.col("host"), F.col("path")))
    mined = mine(parsed.filter(F.col("rule").isNotNull()).select("tokens", F.col("said").alias("verdict")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(mined)
        for batch in batches:
            said, tokens = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            hits = [None if s else index.best(t) for s, t in zip(said, tokens)]
            columns = [
                pa.array([s or ("block" if h else "allow") for s, h in zip(said, hits)], pa.string()),
                pa.array([h and h[1] for h in hits], pa.string()),
                pa.array([h and h[0] for h in hits], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=[x.split()[0] for x in _ROW.split(", ")])

    return map_batches(parsed.select("page_id", "host", "path", "rule", "said", "tokens"), run, _ROW)
