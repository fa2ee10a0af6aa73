"""Exact verification of the parts that candidate links hold together.

A part's members are held against each other, texts by their sets of shingle
hashes, in blocks of a bounded number of members and size, one block a task:

1. each block gives a forest of its links;
2. the heads of the trees are dealt out in blocks again, which joins trees of
   different blocks, until they fit into one or hardly any are joined;
3. trees that are still apart are compared whole: each pair of blocks of
   different trees is a group of rows of its own. A part of near copies is one
   large tree and a few texts, so these are about as many pairs as blocks.

After that any two members of a part have met in some block or are in one
tree, so the components are those of all pairs, and no task holds more than
two blocks. What must be sorted out in step 3 grows with the product of the trees' sizes.

Defined cases: texts without words have empty sets, are in no link and no
task's memory; repeated rows of a node count once; no rows give no links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components


def hashes_of(text: str | None, width: int) -> np.ndarray:
    """The hashes of the text's different shingles, sorted."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    count = max(1, len(words) - width + 1)
    shingles = (b" ".join(words[i : i + width]) for i in range(count))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64, count))


#: What gives the positions of links that keep the components of members, each an array.
Forest = Callable[[list[np.ndarray]], tuple]


def exact_forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Positions of links that keep the components of sets of a Jaccard similarity of 0.8 or more."""
    sizes = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)]
    rest, parents, children = np.ones(len(sets), bool), [], []
    for root in range(len(sets)):
        front = [root] if rest[root] else []
        rest[root] = False
        while front and rest.any():
            x = front.pop()
            has = np.zeros(number.max() + 1, np.int64)
            has[number[starts[x] : starts[x + 1]]] = 1
            both = np.add.reduceat(has[number], starts[:-1])
            hit = np.flatnonzero(rest & (9 * both >= 4 * (sizes + sizes[x])))
            parents += [x] * len(hit)
            children += hit.tolist()
            front += hit.tolist()
            rest[hit] = False
    return parents, children


def block_links(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """Rows (group, block, node, hashes) sorted by these -> links (a, b) within each block of a group."""
    now, nodes, sets = None, [], []

    def found() -> pa.RecordBatch:
        a, b = forest(sets) if len(sets) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x in a], pa.int64()), pa.array([nodes[x] for x in b], pa.int64())], names=["a", "b"])

    for batch in batches:
        for group, block, node, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if (group, block) != now:
                yield found()
                now, nodes, sets = (group, block), [], []
            if hashes and not (nodes and nodes[-1] == node):  # no repeated row
                nodes.append(node)
                sets.append(np.frombuffer(hashes, np.uint64))
    yield found()


def within(rows: DataFrame, group: str, block: Column, forest: Forest) -> DataFrame:
    """Links within the blocks of rows (node, hashes)."""
    dealt = rows.select(F.col(group).alias("group"), block.alias("block"), "node", "hashes")
    return dealt.repartition("group", "block").sortWithinPartitions("group", "block", "node").mapInArrow(partial(block_links, forest=forest), "a long, b long")


def in_blocks(rows: DataFrame, members: int, weight: int) -> DataFrame:
    """Rows (part, node, size, ...) with the number of blocks of their part."""
    return counted(rows, ["part"], members, weight, "blocks")


def counted(rows: DataFrame, by: list[str], members: int, weight: int, name: str) -> DataFrame:
    many = F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum("size") / weight)).cast("long")
    several = rows.groupBy(*by).agg(many.alias(name)).filter(F.col(name) > 1)
    return rows.join(several, by, "left").withColumn(name, F.coalesce(name, F.lit(1).cast("long")))


def dealt_by(blocks: str, *key) -> Column:
    return F.pmod(F.xxhash64(*key), F.col(blocks))


def verified_links(sets: DataFrame, members: int, weight: int, forest: Forest = exact_forest) -> DataFrame:
    """Links (a, b) that keep the components of rows (part, node, size, blocks, hashes), which are read more than once."""
    found = staged(within(sets, "part", dealt_by("blocks", "node"), forest))
    many = sets.filter("blocks > 1")
    if many.isEmpty():
        return found
    heads, turn = many, 0
    while True:  # heads of trees, in blocks anew
        below = components(found).filter("node <> root").select("node")
        fewer = counted(heads.drop("blocks").join(below, "node", "left_anti"), ["part"], members, weight, "blocks")
        heads, turn = staged(fewer), turn + 1
        more = staged(within(heads, "part", dealt_by("blocks", "node", F.lit(turn)), forest))
        found = found.unionByName(more)
        if heads.filter("blocks > 1").isEmpty() or more.count() < 0.1 * heads.count():  # the rest is left to step 3
            break
    found = staged(found)
    return found.unionByName(across(many, found, members, weight, forest))


def across(many: DataFrame, found: DataFrame, members: int, weight: int, forest: Forest) -> DataFrame:
    """Links between the trees of a part; ``found`` are those within the trees."""
    trees = components(found)
    rows = many.select("part", "node", "size").join(trees, "node", "left").withColumn("tree", F.coalesce("root", "node")).drop("root")
    apart = rows.groupBy("part").agg(F.countDistinct("tree").alias("trees")).filter("trees > 1").select("part")
    rows = staged(counted(rows.join(apart, "part", "left_semi"), ["part", "tree"], members, weight, "own"))
    if rows.isEmpty():
        return found.limit(0)
    # a tree of several blocks has them for itself, others share blocks
    large = rows.filter("own > 1").select("part", "node", "tree", dealt_by("own", "node").alias("no"))
    small = counted(rows.filter("own = 1").drop("own"), ["part"], members, weight, "shared")
    small = small.select("part", "node", F.lit(None).cast("long").alias("tree"), dealt_by("shared", "tree").alias("no"))
    block = F.xxhash64("part", F.coalesce("tree", F.lit(0).cast("long")), F.col("tree").isNull(), "no").alias("block")
    placed = staged(large.unionByName(small).select("part", "tree", "node", block))
    blocks = placed.select("part", "tree", "block").distinct()
    other = blocks.select("part", F.col("tree").alias("tree2"), F.col("block").alias("block2"))
    differ = (F.col("block") < F.col("block2")) & ~F.coalesce(F.col("tree") == F.col("tree2"), F.lit(False))
    pairs = blocks.join(other, "part").filter(differ | ((F.col("block") == F.col("block2")) & F.col("tree").isNull()))
    sides = pairs.select(F.xxhash64("part", "block", "block2").alias("pair"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    met = placed.select("node", "block").join(sides, "block").join(many.select("node", "hashes"), "node")
    return within(met, "pair", F.lit(0).cast("long"), forest)
