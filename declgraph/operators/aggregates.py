"""Aggregations of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_pivot(df: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """A count for each value, by conditional aggregation: one pass, whatever the values are."""
    counts = [F.count(F.when(F.col(status) == v, 1)).alias(f"n_{v}") for v in values]
    return df.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("n_all"))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of each key's latest row, with the order's last column as the tie-break."""
    row = F.max_by(F.struct(*columns), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*")


def ordered_list(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, separator: str, name: str) -> DataFrame:
    """Items of each key in order, joined. The result holds them all, so a group is one value by nature."""
    rows = F.array_sort(F.collect_list(F.struct(*order, item.alias("__item"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["__item"]), separator).alias(name))


def digest_of_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], digest: Column, name: str) -> DataFrame:
    """SHA-256 over the digests of a group's rows in order."""
    listed = ordered_list(df, keys, order, digest, "", "__all")
    return listed.select(*keys, F.sha2("__all", 256).alias(name))


def limit_truncated(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows and whether there are more: n + 1 rows are read."""
    some = df.orderBy(*order).limit(n + 1)
    place = F.row_number().over(Window.orderBy(*order))
    more = F.count(F.lit(1)).over(Window.partitionBy()) > n
    return some.withColumn("place", place).withColumn("truncated", more).filter(F.col("place") <= n)
