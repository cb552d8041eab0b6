"""The pipeline against its stages done by hand."""

import sys
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from barweave.llm import pieces, queries, secret_scan
from test_set_operators import brute_join, brute_mix
from test_text_operators import base_spans


def masked(text):
    at, out = 0, ""
    for start, _, end in base_spans(text):
        if start >= at:
            out += text[at:start] + secret_scan.MASK
        at = max(at, end)
    return out + text[at:]


def test_pipeline(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in queries.op1_quality(spark, sf).collect() if r.predicted}
    rows = [r for r in docs.itertuples() if r.doc_id in good]
    assert 0 < len(rows) < len(docs)
    stay = {i for i, _, c, _ in brute_join([(r.doc_id, r.text) for r in rows]) if i == c}
    rows = [(r.doc_id, masked(r.text), r.lang, r.source) for r in rows if r.doc_id in stay]
    domain = lambda s: "d" + str(int(__import__("hashlib").md5(s.encode()).hexdigest()[:4], 16) % 3)
    taken = {i for i, _ in brute_mix(rows, corpus_pipeline.PLAN, domain)}
    encoder = pieces.Encoder(pieces.load(corpus_pipeline.TOKENIZER))
    want = {i: encoder.encode(t).tolist() for i, t, _, _ in rows if i in taken}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).selectExpr("*", "1 as epoch", "'x' as spans", "'d' as domain",
        "'t' as tokens")
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "q", 0)],
        "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    assert [s for s, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for at in (docs, docs.filter("false"), docs.unionByName(docs)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, at, sf)
            assert got.columns == at.columns and got.count() <= at.count()
        assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() == at.count()
    ids = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs), sf).collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))
