"""Graphs over declarations.

Reachability doubles its reach each round, so a path of n steps takes about
log2(n) rounds; each round is a join and an aggregation and ends in a
checkpoint. Cycles are harmless: a pair that is known isn't new. Tasks grow in
number with the pairs, and a node that many reach is dealt out over several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import staged

ROUNDS = 40
TASK = 1_000_000  #: rows that a task should get at most
SHARES = 1_000  #: a key with more than this part of all rows, and than a tenth of a task's, is dealt out


def tasks(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int) -> DataFrame:
    """The inner join on key, in which left rows of a key that many have are dealt out by a hash of ``by``.

    rows: about how many left has. The right rows of such a key are repeated for each of its shares, so there
    are no more of them than of the result; the keys themselves are fewer than SHARES.
    """
    spark, limit = left.sparkSession, max(TASK // 10, rows // SHARES)
    often = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).filter(F.col(key).isNotNull()) if rows > limit else None
    found = often.select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__shares")).collect() if often is not None else []
    on = [key]
    if found:
        shares = F.broadcast(spark.createDataFrame(found, f"{key} {left.schema[key].dataType.simpleString()}, __shares int"))
        left = left.join(shares, key, "left").withColumn("__share", F.pmod(F.xxhash64(by), F.coalesce("__shares", F.lit(1))).cast("int")).drop("__shares")
        right = right.join(shares, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))).drop("__shares")
        on = [key, "__share"]
    if rows > TASK:
        n = tasks(spark, rows)
        left, right = left.repartition(n, *on), right.repartition(n, *on)
    return left.join(right, on).drop("__share")


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(root, node, depth) of all nodes that a root reaches in one step or more; depth is the least number of steps.

    Each round joins the pairs that the last one has found or shortened with all known ones, on either side.
    """
    known = staged(edges.select(F.col(src).alias("root"), F.col(dst).alias("node")).distinct().select("root", "node", F.lit(1).alias("depth"), F.lit(True).alias("fresh")))
    for _ in range(ROUNDS):
        fresh = known.filter("fresh")
        if fresh.isEmpty():
            return known.drop("fresh")
        rows = known.count()
        on = lambda df: df.select(F.col("root").alias("node"), F.col("node").alias("next"), F.col("depth").alias("more"))
        longer = spread_join(fresh, on(known), "node", "root", rows).unionByName(spread_join(known.filter("NOT fresh"), on(fresh), "node", "root", rows))
        found = longer.select("root", F.col("next").alias("node"), (F.col("depth") + F.col("more")).alias("depth"), F.lit(None).cast("int").alias("was"))
        both = known.select("root", "node", "depth", F.col("depth").alias("was")).unionByName(found)
        both = (both.repartition(tasks(known.sparkSession, 3 * rows), "root", "node") if rows > TASK else both).groupBy("root", "node").agg(F.min("depth").alias("depth"), F.min("was").alias("was"))
        known = staged(both.select("root", "node", "depth", (F.col("was").isNull() | (F.col("depth") < F.col("was"))).alias("fresh")))
    raise RuntimeError(f"the closure did not settle in {ROUNDS} rounds")


def chase(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Follow a functional table to its end: (node, target, steps).

    An edge to itself, or a node without edge, ends a chain. Nodes that run
    into a cycle have no end; they come with a null target.
    """
    step = staged(edges.filter(F.col(src) != F.col(dst)).select(F.col(src).alias("node"), F.col(dst).alias("target"), F.lit(1).cast("long").alias("steps")))
    open_before = None
    for _ in range(ROUNDS):
        on = step.select(F.col("node").alias("__at"), F.col("target").alias("__next"), F.col("steps").alias("__more"))
        step = staged(
            step.join(on, F.col("target") == F.col("__at"), "left").select(
                "node", F.coalesce("__next", "target").alias("target"), (F.col("steps") + F.coalesce("__more", F.lit(0))).alias("steps")
            )
        )
        still = step.join(step.select(F.col("node").alias("__at")), F.col("target") == F.col("__at"), "left_semi")
        count = still.count()
        if not count:
            return step
        if count == open_before:  # none has come to an end: what is left runs in cycles
            stuck = still.select("node").withColumn("__stuck", F.lit(True))
            return step.join(stuck, "node", "left").select("node", F.when(F.col("__stuck").isNull(), F.col("target")).alias("target"), F.when(F.col("__stuck").isNull(), F.col("steps")).alias("steps"))
        open_before = count
    raise RuntimeError(f"the chase did not settle in {ROUNDS} rounds")


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(cycle_key, members) of the cycles of a functional table; the key is the least member.

    Each round every node knows the least node among twice as many steps. After
    that, the nodes that others end on lie on cycles.
    """
    walk = staged(edges.select(F.col(src).alias("node"), F.col(dst).alias("target"), F.least(src, dst).alias("least")))
    n, reach = walk.count(), 1
    while reach < n:
        on = walk.select(F.col("node").alias("__at"), F.col("target").alias("__next"), F.col("least").alias("__least"))
        walk = staged(walk.join(on, F.col("target") == F.col("__at")).select("node", F.col("__next").alias("target"), F.least("least", "__least").alias("least")))
        reach *= 2
    on_cycle = walk.select(F.col("target").alias("node")).distinct()
    return walk.join(on_cycle, "node", "left_semi").groupBy(F.col("least").alias("cycle_key")).agg(F.count(F.lit(1)).alias("members"))


def with_paths(nodes: DataFrame, key: str, parent: str, label: Column | None = None) -> DataFrame:
    """nodes with ``path``, the labels from the root down, which sorts them in pre-order, and ``depth``.

    A node whose parent isn't there is a root. Each round puts the path of the node above a path's top before it, so
    a tree of n levels takes about log2(n) rounds. Nodes in a cycle, or below one, have no path and are left out.
    """
    there = nodes.select(F.col(key).alias("__above")).distinct()
    own = nodes.join(there, nodes[parent] == there["__above"], "left").select(nodes[key].alias("__node"), F.array(label if label is not None else F.col(key)).alias("path"), F.col("__above").alias("__up"))
    walk, left = staged(own), None
    for _ in range(ROUNDS):
        count = walk.filter("__up IS NOT NULL").count()
        if not count or count == left:  # those that are left run in cycles
            paths = walk.filter("__up IS NULL").select("__node", "path")
            return nodes.join(paths, nodes[key] == paths["__node"]).drop("__node").withColumn("depth", F.size("path") - 1)
        left = count
        on = walk.select(F.col("__node").alias("__at"), F.col("path").alias("__before"), F.col("__up").alias("__next"))
        longer = F.when(F.col("__before").isNotNull(), F.concat("__before", "path")).otherwise(F.col("path"))
        walk = staged(walk.join(on, F.col("__up") == F.col("__at"), "left").select("__node", longer.alias("path"), F.col("__next").alias("__up")))
    raise RuntimeError(f"the tree did not settle in {ROUNDS} rounds")


def nearest_by_name(reached: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Of the rows (root, node, depth, name) the nearest for each root and name; ties by order."""
    row = F.min_by(F.struct(*reached.columns), F.struct("depth", *order)).alias("row")
    return reached.groupBy("root", name).agg(row).select("row.*")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)
