"""Connected components over link tables.

Links are contracted inside each task first, to one star a component that the task sees.
What is left is joined up by alternating large-star and small-star steps, each link moving
to the smallest neighbour of its ends, and contracted again. Every step is written to the
shared folder, so lineage stays short, and no link or component reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

#: Rounds after which something must be wrong: they grow with the logarithm of the longest chain.
MAX_ROUNDS = 60
#: Links that a task contracts at once; bounds its memory.
CHUNK = 4_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node of the links between ``a`` and ``b``."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:  # labels of labels, until they stand
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, of the same components, each task's as stars; links to itself go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def stars() -> pa.RecordBatch:
            nodes, roots = least_labels(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            far = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[far], pa.int64()), pa.array(roots[far], pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CHUNK:
                yield stars()
                held, size = [], 0
        if held:
            yield stars()

    return map_batches(links, run, "a long, b long")


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step over links (a, b), a > b: large-star moves larger neighbours, small-star smaller ones, to the least neighbour."""
    seen = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        seen = seen.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stored(seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    moved = seen.join(least, "u").filter(F.col("v") != F.col("m"))
    moved = moved if small else moved.filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("a"), F.col("m")
        .alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root): of every node with a link to another, the smallest node of its component.

    ``links``: two columns of longs, in any order, repeated or pointing at themselves.
    """
    x, y = links.columns
    now = stored(_contracted(links.select(F.col(x).alias("a"), F.col(y).alias("b"))))
    for _ in range(MAX_ROUNDS):
        now = stored(_contracted(now))  # files of one task's reading are contracted together
        # Stars only: no node hangs on two others, or both hangs on one and is hung on.
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("on"), F.lit(0)
            .alias("of")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("on"), F.lit(1).alias("of")))
        loose = ends.groupBy("n").agg(F.sum("on").alias("on"), F.max("of").alias("of")).filter(F.col("on") + F.col("of") > 1)
        if not loose.limit(1).count():
            break
        now = stored(_contracted(_star(stored(_contracted(_star(now, small=False))), small=True)))
    else:
        raise RuntimeError("components did not settle")
    return stored(now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
