"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media, mixing, ngram_join, oracles, pieces, quality, secret_scan, token_counts, topk, url_rules, wrapper
from .common import read_table

#: Vocabulary files of public tokenizers; a parameter, never copied.
TOKENIZERS = "/opt/tokenizers"
#: Of a query set: rows whose id this divides.
QUERY_EVERY = 50


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learnt from labels of rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrapper.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return pieces.encode(read_table(spark, sf_dir, "documents"), pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of each query vector."""
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, 5)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"),
        token_counts.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike."""
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked secret spans of every document."""
    return secret_scan.report(read_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image, read back and described."""
    return media.media_features(read_table(spark, sf_dir, "documents"))


#: Target weights of the mixing query.
MIX = mixing.Plan(domains={"d0": 3, "d1": 2, "d2": 1}, langs={"en": 4, "de": 2, "fr": 2, "es": 1}, share=0.6, max_epochs=2, seed=11)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, by epoch, that meet the target weights of MIX."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), MIX, columns=["doc_id", "lang", "source"])


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_rules.judge(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_html, op3_pieces, op4_topk, op5_token_counts, op6_ngram_join, op7_secrets,
        op8_media, op9_mixing, op10_url_rules)}


#: Integer inner products of every query with every other row.
OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM e GROUP BY vec_id) q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _fill_sql(name: str, parent: list[str], child: str, above: str | None, weights: dict[str, int]) -> str:
    """CTEs that share a budget among the children of each parent, as ``mixing`` does."""
    keys = ", ".join([*parent, child])
    weight = f"CASE {child} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in sorted(weights.items())) + " ELSE 1 END" if weights else "1"
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    source = f"JOIN {above} USING ({', '.join(parent)})" if above else "CROSS JOIN (SELECT total AS budget FROM total)"
    return f"""
{name}_c AS (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap, CAST(any_value({weight}) AS BIGINT) AS w FROM leaves GROUP BY {keys}),
{name}_b AS (SELECT {name}_c.*, budget AS budget_in FROM {name}_c {source} WHERE w > 0),
{name}_f AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap::DOUBLE / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1
PRECEDING), 0)::DOUBLE
    + cap::DOUBLE / w * (sum(w) OVER ({by} ORDER BY cap::DOUBLE / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED
FOLLOWING))::DOUBLE <= budget_in AS is_full FROM {name}_b),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN cap::DOUBLE ELSE w * (budget_in - coalesce(sum(cap) FILTER (is_full) OVER ({by}),
0)::DOUBLE)
    / (sum(w) FILTER (NOT is_full) OVER ({by}))::DOUBLE END AS budget FROM {name}_f)"""


def _mix_sql(plan: mixing.Plan) -> str:
    levels = ",".join([
        _fill_sql("dom", [], "domain", None, plan.domains),
        _fill_sql("lng", ["domain"], "lang", "dom", plan.langs),
        _fill_sql("src", ["domain", "lang"], "source", "lng", plan.sources),
    ])
    return rf"""
WITH s AS (SELECT doc_id, text, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, lang AS lang_in, source AS
source_in FROM documents),
d AS (SELECT doc_id, lang, source, lang_in, source_in, 'd' || CAST(CAST('0x' || substr(md5(source), 1, 4) AS INTEGER) % 3 AS
VARCHAR) AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^	-
 ]+')) AS BIGINT) AS tokens FROM s),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {plan.max_epochs} AS BIGINT) AS
cap FROM d GROUP BY ALL),
total AS (SELECT coalesce(sum(tokens), 0)::DOUBLE * {plan.share}::DOUBLE AS total FROM leaves),{levels},
b AS (SELECT domain, lang, source, tokens AS n, least(CAST(floor(budget + 1e-6::DOUBLE) AS BIGINT), cap) AS whole FROM src JOIN
leaves USING (domain, lang, source)),
r AS (SELECT *, CASE WHEN n > 0 THEN whole // n ELSE 0 END AS full_epochs FROM b),
k AS (SELECT d.*, full_epochs, whole - full_epochs * n AS rest,
  sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{plan.seed}:' || CAST(full_epochs AS VARCHAR) || ':' ||
coalesce(CAST(doc_id AS VARCHAR), '')) RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN r USING (domain, lang, source)),
e AS (SELECT *, full_epochs + CASE WHEN full_epochs < {plan.max_epochs} AND rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS epochs
FROM k)
SELECT doc_id, lang_in AS lang, source_in AS source, domain, CAST(g.epoch AS INTEGER) AS epoch, tokens FROM e,
range({plan.max_epochs}) AS g(epoch) WHERE g.epoch < epochs
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query; that of the token counts needs the vocabulary's file."""
    made = {"op4_topk": OP4_SQL, "op6_ngram_join": oracles.OP6, "op7_secrets": oracles.OP7, "op8_media": oracles.op8(), "op9_mixing": _mix_sql(MIX),
        "op10_url_rules": oracles.OP10}
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    if os.path.exists(model):
        made["op5_token_counts"] = oracles.op5(token_counts.load_pieces(model), token_counts.WORD_START)
    return made
