"""Connected components by alternating star contractions.

Links are contracted to stars in chunks first, so that a dense group sends
about one link for each of its members to the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, staged

#: Links that a task contracts at once.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the least one that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[moved], nodes[root[moved]]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Stars (u, v), u > v, of each chunk of links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= CHUNK:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, stars(*map(np.concatenate, zip(*held))))), names=["u", "v"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, stars(*map(np.concatenate, zip(*held))))), names=["u", "v"])

    return edges.coalesce(max(1, -(-edges.count() // CHUNK))).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node it reaches.

    edges has columns a and b. Each round lets every node point its larger,
    then its smaller neighbours to the least one, until all is stars.
    """
    with batches_of(edges.sparkSession, CHUNK):
        now = staged(contracted(staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))))
    for _ in range(rounds):
        # roots above which there are others; a hub is one row of these
        least = now.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        above = staged(now.select("v").distinct().join(least.select(F.col("u").alias("v"), "m"), "v"))
        moves = not above.isEmpty()
        if not moves and least.filter("n > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        # only larger neighbours move in the first step, and they are the rows as they stand
        large = now.join(above, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct() if moves else now
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = staged(small.filter("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
