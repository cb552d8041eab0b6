"""A corpus pipeline: quality, near duplicates, secrets, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import mixing, ngram_join, pieces, quality, secret_scan
from barweave.llm.common import new_folder, read_table, scratch, stored

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Domains, languages and sources weigh the same; nine tenths of the tokens stay, each document once.
PLAN = mixing.Plan(share=0.9, max_epochs=1, seed=7)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from ``labels``, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id; of rows that repeat an id, one.

    Rows without an id stay.
    """
    found = stored(ngram_join.join(docs))
    rows = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c"))
    again = stored(rows.filter((F.col("n") > 1) | (F.col("c") < F.col("doc_id"))))
    dropped = again.filter(F.col("c") < F.col("doc_id")).select("doc_id")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = again.filter((F.col("n") > 1) & (F.col("c") == F.col("doc_id"))).select("doc_id")
    if repeated.limit(1).count():
        once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return kept


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets found in its text masked."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that PLAN's budgets take."""
    return mixing.take(docs, PLAN).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    return pieces.encode(docs, pieces.load(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifier is learnt, so SQL can't express the pipeline; it is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        kept = new_folder(spark)
        with scratch(spark):  # what a stage stores on its way goes when its result is written
            made = stage(spark, docs, sf_dir)
            made.write.parquet(kept)
        docs = spark.read.schema(made.schema).parquet(kept)
    return docs
