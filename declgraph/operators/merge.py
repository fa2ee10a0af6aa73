"""Merging layered declarations.

Rows of one key are ordered by ``order``, columns that together rank all
declarations of a key. Everything here is an aggregation by key (with partial
aggregation before the shuffle) unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank(order: Sequence[str]) -> Column:
    return F.struct(*order)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """left joined with right on keys of which null is a value like any other; the keys stand once.

    Other columns of right must not be in left.
    """
    named = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys), F.lit(True).alias("__met"))
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"__r_{k}"])
    joined = left.join(named, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    both = [F.when(F.col("__met").isNotNull(), F.col(f"__r_{k}")).otherwise(left[k]).alias(k) for k in keys] if how == "full_outer" else [left[k] for k in keys]
    return joined.select(*both, *(left[c] for c in left.columns if c not in keys), *(named[c] for c in right.columns if c not in keys))


def merge_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last whole row of each key."""
    row = F.max_by(F.struct(*df.columns), rank(order)).alias("row")
    return df.groupBy(*keys).agg(row).select("row.*")


def merge_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole row of each key; ``declared`` counts its declarations."""
    row = F.min_by(F.struct(*df.columns), rank(order)).alias("row")
    return df.groupBy(*keys).agg(row, F.count(F.lit(1)).alias("declared")).select("row.*", "declared")


def merge_attr(df: DataFrame, keys: Sequence[str], attrs: dict[str, Column] | Sequence[str], order: Sequence[str], source: str | None = None) -> DataFrame:
    """Each attribute's last stated value.

    A null is "not stated" and never overrides. ``first_<o>`` is the place of
    the first declaration, ``source`` that of the last.
    """
    stated = attrs if isinstance(attrs, dict) else {a: F.col(a) for a in attrs}
    merged = [F.max_by(c, F.when(c.isNotNull(), rank(order))).alias(name) for name, c in stated.items()]
    merged += [F.min_by(F.struct(*order), rank(order)).alias("first")]
    if source:
        merged.append(F.max_by(source, rank(order)).alias(source))
    out = df.groupBy(*keys).agg(*merged)
    names = [*keys, *stated, *(F.col(f"first.{o}").alias(f"first_{o}") for o in order), *([source] if source else [])]
    return out.select(*names)


def tombstones(df: DataFrame, keys: Sequence[str], deleted: Column, order: Sequence[str]) -> DataFrame:
    """The rows after the last deletion of their key; later ones start anew.

    The last deletion of each key is joined back, so that a hot key is not
    one task's window.
    """
    last = df.filter(deleted).groupBy(*keys).agg(F.max(rank(order)).alias("__last"))
    joined = null_safe(df, last, keys, "left")
    return joined.filter(F.col("__last").isNull() | (rank(order) > F.col("__last"))).select(*df.columns)


def layer_replace(df: DataFrame, keys: Sequence[str], layer: str) -> DataFrame:
    """All rows of each key's highest layer; lower layers are replaced as a whole."""
    top = df.groupBy(*keys).agg(F.max(layer).alias("__top"))
    return null_safe(df, top, keys, "inner").filter(F.col(layer) == F.col("__top")).select(*df.columns)


def ordered_union(df: DataFrame, keys: Sequence[str], item: str, order: Sequence[str]) -> DataFrame:
    """Distinct items of each key by first appearance: keys, items (array)."""
    first = df.groupBy(*keys, item).agg(F.min(rank(order)).alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", item))), lambda x: x[item]).alias("items"))


def area_overlay(base: DataFrame, overlay: DataFrame, areas: DataFrame, keys: Sequence[str], order: Sequence[str], area: str = "area") -> DataFrame:
    """Every area's merged rows: the global ones, overridden by the area's own.

    areas is a table of few rows, by nature of the model.
    """
    spread = base.select(*(c for c in base.columns if c != area)).crossJoin(F.broadcast(areas.select(area))).withColumn("__layer", F.lit(0))
    own = overlay.withColumn("__layer", F.lit(1)).select(*spread.columns)
    return merge_last(spread.unionByName(own), [area, *keys], ["__layer", *order]).drop("__layer")


def area_deltas(merged: DataFrame, globally: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The merged rows that differ from the global ones in some value."""
    other = globally.select(*keys, *(F.col(v).alias(f"global_{v}") for v in values))
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"global_{v}"))
    return null_safe(merged, other, keys, "left").filter(differs)


def deep_merge(nodes: DataFrame, keys: Sequence[str], layer: str, order: Sequence[str]) -> DataFrame:
    """Nested arguments, flattened: a row for each node with ``path`` (array), ``kind`` and ``value``.

    Within the highest layer that declares a key, the last declaration of a
    path wins, but a node whose kind changes drops what was declared below it
    before. Lower layers are replaced. The position is that of the first
    declaration since the last change of kind.
    """
    top = layer_replace(nodes, keys, layer)
    at = Window.partitionBy(*keys, "path").orderBy(*order)
    kinds = top.withColumn("__was", F.lag("kind").over(at))
    changes = kinds.filter(F.col("__was").isNotNull() & ~F.col("kind").eqNullSafe(F.col("__was"))).groupBy(*keys, "path").agg(F.max(rank(order)).alias("__reset"))
    # a node falls if one of its own or outer paths was reset after it
    outer = top.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("__outer"))
    resets = changes.select(*keys, F.col("path").alias("__outer"), "__reset")
    met = null_safe(outer, resets, [*keys, "__outer"], "left")
    live = met.groupBy(*keys, "path", *(c for c in top.columns if c not in (*keys, "path"))).agg(F.max("__reset").alias("__reset")).filter(F.col("__reset").isNull() | (rank(order) >= F.col("__reset")))
    row = F.max_by(F.struct("kind", "value"), rank(order)).alias("row")
    return live.groupBy(*keys, "path").agg(row, F.min(rank(order)).alias("position")).select(*keys, "path", "row.kind", "row.value", "position")
