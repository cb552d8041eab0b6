"""Exact top-k search by distributed histogram selection.

Vectors become integers, so scores are exact. Queries are taken in blocks of bounded
size; each block is scored against all rows. A score is never shipped: every task counts
the scores of a block by bin, the counts are added up by (query, bin), and the bin that
holds the k-th highest score is split again until it is one score wide. One more pass
keeps what lies above that score, and of its ties the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, new_folder, stored

#: Factor from components to integers.
SCALE = 256
#: Queries of one block; with BLOCK_BYTES it bounds what is broadcast.
BLOCK_QUERIES = 4096
BLOCK_BYTES = 32 << 20
#: Bins each interval is split into.
BINS = 1024
#: Candidate rows scored at once in a task.
CHUNK = 1024
RESULT = "query_id long, rank int, vec_id long, score long"


def quantise(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component x as double, as integers.

    Vectors that are null or hold null, NaN or infinite components are left out, as are
    rows without a vec_id. Repeated rows stay repeated.
    """
    x = F.col("embedding")
    clean = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & clean).select(F.col("vec_id").cast("long")
        .alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors laid end to end, and each one's length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


class _Block:
    """Queries of one dimension, ready to be scored against chunks of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.top = int(np.abs(vectors).max(initial=0))

    def scores(self, candidates: np.ndarray) -> np.ndarray:
        """Exact integer products, queries by candidates: by floats where all sums fit 53 bits, else by integers."""
        bound = self.top * int(np.abs(candidates).max(initial=0)) * max(1, candidates.shape[1])
        if bound < 1 << 24:
            return (self.vectors.astype(np.float32) @ candidates.T.astype(np.float32)).astype(np.int64)
        if bound < 1 << 53:
            return (self.vectors.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
        return self.vectors @ candidates.T


def _scored(block: _Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores, own) of each chunk; own marks a query's own row."""
    width = block.vectors.shape[1]
    for batch in batches:
        flat, lengths = _matrix(batch.column(1))
        if not (lengths == width).any():
            continue
        ids = batch.column(0).to_numpy()[lengths == width]
        rows = flat[np.repeat(lengths == width, lengths)].reshape(-1, width)
        for at in range(0, len(ids), CHUNK):
            some = ids[at : at + CHUNK]
            yield some, block.scores(rows[at : at + CHUNK]), block.ids[:, None] == some[None, :]


def _histogram(vectors: DataFrame, block: _Block, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(q, bin, n): how many candidates of query number q fall in each of its bins, high bins first.

    A task's bins below the one that holds its own k-th score can't hold the global one, so it
    sends at most k bins a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(block.ids), BINS + 1), dtype=np.int64)
        offsets = np.arange(len(block.ids))[:, None] * (BINS + 1)
        for _, scores, own in _scored(block, batches):
            # The last column takes what lies below the interval; scores above it count in the highest bin.
            bins = np.where(own | (scores < low[:, None]), BINS, np.minimum((scores - low[:, None]) // width[:, None], BINS - 1))
            held += np.bincount((bins + offsets).ravel(), minlength=held.size).reshape(held.shape)
        held = held[:, BINS - 1 :: -1]
        keep = (held > 0) & (held.cumsum(1) - held < k)
        q, b = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array((BINS - 1 - b).astype(np.int32)),
            pa.array(held[q, b])], names=["q", "bin", "n"])

    return map_batches(vectors, run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_scores(vectors: DataFrame, block: _Block, top: int, k: int) -> np.ndarray:
    """Each query's k-th highest score; where there are fewer candidates, a score below all."""
    n = len(block.ids)
    reach = np.ceil(block.norms * top).astype(np.int64) + 1
    low, width = -reach, (2 * reach) // BINS + 1
    above = np.zeros(n, dtype=np.int64)
    found = np.zeros(n, dtype=bool)
    open_ = np.ones(n, dtype=bool)
    while open_.any():
        counts = _histogram(vectors, block, low, width, k)
        # Counted from above; those above the interval are already in its highest bin.
        order = Window.partitionBy("q").orderBy(F.col("bin").desc())
        hit = counts.withColumn("sum", F.sum("n")
            .over(order)).filter((F.col("sum") >= k) & (F.col("sum") - F.col("n") < k)).select("q", "bin")
        places = hit.toArrow()  # one row a query of the block at most
        q, b = places.column("q").to_numpy(), places.column("bin").to_numpy().astype(np.int64)
        seen = np.zeros(n, dtype=bool)
        seen[q] = True
        found |= seen
        new_low, new_width = low.copy(), width.copy()
        new_low[q] = low[q] + b * width[q]
        done = ~seen | (width == 1)
        new_width[q] = np.where(width[q] == 1, 1, -(-width[q] // BINS))
        low, width, open_ = new_low, new_width, ~done
        above[seen] = low[seen]
        if open_.any():
            # A closed query's interval stays one score wide, so another pass finds the same place.
            width = np.where(open_, width, 1)
    return np.where(found, above, np.iinfo(np.int64).min)


def _blocks(queries: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Queries with the number of their block, and how many blocks there are; each but the last has exactly ``size`` queries.

    Ranges of ids are numbered first, then the rows of each from where the ranges before it
    end, so no task sorts all queries.
    """
    ranged = stored(queries.repartitionByRange("vec_id").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("vec_id")) - 1
    made = ranged.withColumn("place", place).join(F.broadcast(offsets), "part")
    numbered = stored(made.select("vec_id", "v", F.floor((F.col("before") + F.col("place")) / size).cast("int").alias("number")))
    return numbered, -(-numbered.count() // size)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest integer inner products of each query over all rows but its own, ties to smaller ids.

    ``vectors`` and ``queries``: (vec_id long, v array<long>), as ``quantise`` gives them.
    Candidates of another dimension than the query take no part; a query with fewer than k
    candidates gets them all, one without candidates no row. Rows with the query's own id are
    its own; other rows that repeat are candidates each. Of query rows that repeat an id, the
    smallest vector asks. Empty inputs give an empty result. Blocks of queries, of bounded
    size, go to the tasks; the driver holds one threshold a query of the block, never scores.
    Each block's result is appended to one table, so the plan doesn't grow with their number.
    """
    spark = vectors.sparkSession
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    sized = once.withColumn("d", F.size("v")).filter(F.col("d") > 0)
    dims = [r["d"] for r in sized.select("d").distinct().collect()]
    if not dims:
        return spark.createDataFrame([], RESULT)
    out = new_folder(spark)
    for d in sorted(dims):
        these = vectors.filter(F.size("v") == d)
        top = these.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0.0
        of, n_blocks = _blocks(sized.filter(F.col("d") == d).select("vec_id", "v"), max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * d))))
        for number in range(n_blocks):
            held = of.filter(F.col("number") == number).select("vec_id", "v").toArrow()
            flat, _ = _matrix(held.column("v"))
            block = _Block(held.column("vec_id").to_numpy(), flat.reshape(-1, d))
            _select(these, block, _kth_scores(these, block, int(top**0.5) + 1, k), k).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)


def _select(vectors: DataFrame, block: _Block, kth: np.ndarray, k: int) -> DataFrame:
    """What scores above the k-th score, and the smallest ids of those that tie with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)]
        for ids, scores, own in _scored(block, batches):
            q, c = np.nonzero(~own & (scores >= kth[:, None]))
            kept.append(np.stack([q, ids[c], scores[q, c]], axis=1))
            kept = [_best(np.concatenate(kept), k)]
        rows = _best(np.concatenate(kept), k)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[rows[:, 0]]), pa.array(rows[:, 1]), pa.array(rows[:, 2])],
            names=["query_id", "vec_id", "score"])

    found = map_batches(vectors, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank")
        .cast("int").alias("rank"), "vec_id", "score")


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """The k best of each query: high scores, then small ids."""
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
    start = np.r_[0, np.nonzero(np.diff(rows[:, 0]))[0] + 1] if len(rows) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    return rows[rank < k]


def search(embeddings: DataFrame, is_query, k: int = 5, scale: int = SCALE) -> DataFrame:
    """Top-k search over an ``embeddings`` table (vec_id, embedding); ``is_query``: which rows ask, a Column over vec_id."""
    vectors = stored(quantise(embeddings, scale))
    return top_k(vectors, vectors.filter(is_query), k)
