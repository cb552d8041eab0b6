"""Top-k search, n-gram join, components and mixing."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barweave.llm import components, mixing, ngram_join, queries, topk


def brute_top_k(rows, k, every=50):
    """Every row is a candidate; of rows that repeat a query's id the smallest vector asks."""
    clean = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean.append((i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]))
    asks = {}
    for i, v in clean:
        if i % every == 0 and v:
            asks[i] = min(v, asks.get(i, v))
    out = []
    for q, u in sorted(asks.items()):
        scores = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in clean if i != q and len(v) == len(u))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(topk, "BINS", 8)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    rows = [(int(i), [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(0, 260, 1 + seed)]
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(30)]  # ties
    rows += [(2000, None), (2050, [1.0, None, 2.0]), (2100, [float("nan"), 1.0, 1.0]), (2150, [float("inf"), 1.0, 1.0]), (2200, []),
        (None, [1.0, 2.0, 3.0]), (2250, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    rows += rows[:7] + [(100, [9.0, 9.0, 9.0])]  # repeated rows, and a query of two vectors
    df = df.unionByName(df.limit(7)).unionByName(df.sparkSession.createDataFrame(rows[-1:], "vec_id long, embedding array<float>"),
        allowMissingColumns=True)
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == brute_top_k(rows, 5)


def test_top_k_edges(spark):
    df = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, -1.0]), (50, [3.0, 4.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == brute_top_k([tuple(r) for r in df.collect()], 5)
    assert topk.search(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.limit(1), F.col("vec_id") % 50 == 0).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def brute_join(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, len(s), None if k is None else least[find(i)], n) for i, ((k, _), s, n) in enumerate(zip(rows, sets, links))),
        key=str)


def near_copies(rng, base, n, most):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(most + 1)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice((0, 1, 1))] = [rng.choice("pqrstuv") * rng.randrange(1, 9)]
        yield " ".join(words)


@pytest.mark.parametrize("seed", range(4))
def test_join_loses_no_link(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2 if seed % 2 else 32)
    monkeypatch.setattr(ngram_join, "BUCKET", 500)
    monkeypatch.setattr(ngram_join, "TILE", (5, 8))
    monkeypatch.setattr(ngram_join, "CELLS", 200)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    passage = [word() for _ in range(25)]
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    for size, n, most in ((120, 30, 6), (40, 12, 2), (9, 8, 1), (25, 10, 2)):
        base = passage if size == 25 else [word() for _ in range(size)]
        texts += near_copies(rng, base, n, most)
    texts += [" ".join([word() for _ in range(10)] + passage) for _ in range(15)]
    texts += ["a b c d", "A b\tc d", "a b c", "", None, " \n", texts[3].upper(), texts[3], texts[50], texts[50]]
    rows = list(enumerate(texts)) + [(None, texts[3]), (7, "another text of row seven that repeats its id"), (50, texts[50])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_shingles int, component_id string")
    got = sorted((tuple(r) for r in ngram_join.join(df).collect()), key=str)
    assert got == brute_join(rows)


def test_keys_shared_by_chance_chain_no_sets(spark):
    """Each set has a passage in common with the next, and none links; the two copies at the end do."""
    rng = np.random.default_rng(5)
    part = [rng.integers(0, 2**64, 40, dtype=np.uint64) for _ in range(41)]
    sets = [np.unique(np.r_[part[i], part[i + 1], rng.integers(0, 2**64, 100, dtype=np.uint64)]) for i in range(40)]
    sets.append(np.r_[sets[-1][1:], sets[-1][-1:] + np.uint64(1)])
    df = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "d long, n long, tokens binary")
    assert sorted(tuple(r) for r in ngram_join._clusters(df, np.zeros(0, np.uint64)).collect()) == [(39, 39), (40, 39)]


def test_parities_never_show_too_many_differences():
    rng = np.random.default_rng(6)
    for n in (1, 60, 64, 65, 700, 3000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: n * 5 // 6], rng.integers(0, 2**64, n // 3 + 1, dtype=np.uint64)])
        x, y = ngram_join.parities(a), ngram_join.parities(b)
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_multiplicities_never_count_too_little():
    """Classes with several shingles on one place, met in several rows."""
    rng = np.random.default_rng(4)
    marks, places, rows = rng.integers(0, 6, 400), rng.integers(0, 9, 400), rng.integers(0, 5, 400)
    found, counts = ngram_join._multiplicities(marks, places, rows)
    for m, n in zip(found, counts):
        assert n == sum(max(((marks == m) & (places == p) & (rows == r)).sum() for r in range(5)) for p in range(9))
    assert len(ngram_join._multiplicities(marks[:0], places[:0], rows[:0])[0]) == 0


def test_join_of_nothing(spark):
    df = spark.createDataFrame([(1, "one text without a partner here"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.join(df).collect()) == [(1, 2, 1, 0), (2, 0, 2, 0)]
    assert ngram_join.join(df.filter("false")).count() == 0


@pytest.mark.parametrize("piece", [1, 20, 1 << 16])
def test_texts_hashed_together_are_hashed_alone(piece, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    texts = ["left out", "", None, "a b c", "d e f g h i", " ", "Ab  cd\x0bef gh ij kl", "\ta b c d", "x" * 64 + " " + "y" * 65 + " a b c",
        "a b c d e a b c d e", "É", "a b c d e"]
    got = ngram_join.shingle_sets(pa.array(texts)[1:])
    assert [len(x) for x in got] == [len(shingle_set(t)) for t in texts[1:]]
    assert all((x == ngram_join.shingles(t)).all() for x, t in zip(got, texts[1:]))
    for (x, s), (y, t) in itertools.combinations(list(zip(got, texts[1:])), 2):
        assert len(np.intersect1d(x, y)) == len(shingle_set(s) & shingle_set(t))


def test_shingles_are_exact():
    for text in ["Ab  cd\x0bef gh ij kl", "É é a b c d", "a\xa0b c d e f", "x" * 1000 + " y z w v u"]:
        assert len(ngram_join.shingles(text)) == len(shingle_set(text))
    assert (ngram_join.shingles("A b c d e f") == ngram_join.shingles("a\tb\nc d e F ")).all()
    assert len(set(ngram_join.shingles("a b c d e")) & set(ngram_join.shingles("a b c d"))) == 0


@pytest.mark.parametrize("links",
    [[(i, i + 1) for i in range(40)], [(5, 1), (1, 5), (2, 2), (9, 8), (8, 5)], [(0, i) for i in range(1, 50)], []])
def test_components(spark, links):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    parent = {}
    for a, b in links:
        parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {k: v for k, v in parent.items() if any(k in x and x[0] != x[1] for x in links)}


def brute_fill(budget, kids):
    """kids: name -> (capacity, weight); exact by repeated sharing."""
    out, left = {}, {k: v for k, v in kids.items() if v[1] > 0}
    while left:
        total = sum(w for _, w in left.values())
        full = [k for k, (c, w) in left.items() if c * total <= budget * w + 1e-9]
        if not full:
            out |= {k: budget * w / total for k, (_, w) in left.items()}
            break
        for k in full:
            out[k] = left.pop(k)[0]
            budget -= out[k]
    return out


def brute_mix(rows, plan, domain):
    import hashlib

    tokens = [len((t or "").encode().split()) for _, t, _, _ in rows]
    leaf = [(domain(s), "(none)" if lang is None else lang, "(none)" if s is None else s) for _, _, lang, s in rows]
    size = {x: sum(n for n, y in zip(tokens, leaf) if y == x) for x in set(leaf)}
    cap = lambda pre: sum(n * plan.max_epochs for x, n in size.items() if x[: len(pre)] == pre)
    budgets = {(): sum(tokens) * plan.share}
    for depth, weights in enumerate((plan.domains, plan.langs, plan.sources)):
        nxt = {}
        for pre, b in budgets.items():
            kids = {x[depth] for x in size if x[:depth] == pre}
            nxt |= {(*pre, k): v for k, v in brute_fill(b, {k: (cap((*pre, k)), weights.get(k, 1)) for k in kids}).items()}
        budgets = nxt
    out = []
    for x, b in budgets.items():
        whole = min(int(b + 1e-6), size[x] * plan.max_epochs)
        full, rest = divmod(whole, size[x]) if size[x] else (0, 0)
        inside = [i for i, y in enumerate(leaf) if y == x]
        out += [(rows[i][0], e) for i in inside for e in range(full)]
        if rest and full < plan.max_epochs:
            key = lambda i: hashlib.md5(f"{plan.seed}:{full}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()
            upto = 0
            for _, same in itertools.groupby(sorted(inside, key=key), key=key):
                same = list(same)
                upto += sum(tokens[i] for i in same)
                if upto > rest:
                    break
                out += [(rows[i][0], full) for i in same]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0 if seed % 2 else 20_000)
    plan = mixing.Plan(domains={"x": 3, "y": 1, "z": 0 if seed == 2 else 1}, langs={"en": 5}, sources={"x1": 4},
        share=(0.6, 1.5, 0.3, 0.05)[seed], max_epochs=(2, 3, 1, 2)[seed], seed=seed)
    sources = [None, "x1", "x2", "y1", "y2", "z1"]
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None]),
        rng.choice(sources + ["x1"] * 6)) for i in range(160)]
    rows += [(None, "a b c", "en", "x1"), (None, "d e", "en", "x1"), (3, "again a b", rows[3][2], rows[3][3]),
        (900, None, "en", "x2"), (901, "  ", "fr", "q")]
    domain = lambda s: "(none)" if s is None else s[0]
    named = "doc_id long, text string, lang string, source string, domain string, epoch int, __epoch int, _id string, __salt int"
    df = spark.createDataFrame([(*r, "old", 5, 6, "i", 7) for r in rows], named)
    got = mixing.mix(df, plan, F.substring("source", 1, 1))
    assert sorted(got.columns) == sorted([*df.columns, "tokens"])
    assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=str) == brute_mix(rows, plan, domain)
    assert mixing.mix(df.filter("false"), plan).count() == 0
    whole = mixing.take(df, plan, F.substring("source", 1, 1))
    assert whole.columns == df.columns and {(r["__epoch"], r["_id"], r["__salt"], r.epoch) for r in whole.collect()} == {(6, "i", 7, 5)}


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a", "a ", "\x0ba\x0cb\t", "a\xa0b", "a\n\nb  c", "é ü", "a\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.n_words(F.col("t"))).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        rows = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
        assert rows(got) == rows(want), name
