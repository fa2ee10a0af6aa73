"""Lints: each is a DataFrame of findings; all are united, made distinct and sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finding(rows: DataFrame, lint: str, severity: str, subject: Column, *more: Column) -> DataFrame:
    return rows.select(F.lit(lint).alias("lint"), F.lit(severity).alias("severity"), subject.alias("subject"), *more)


def findings(*found: DataFrame) -> DataFrame:
    """Distinct findings, errors first."""
    united = reduce(DataFrame.unionByName, found).distinct()
    return united.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), *united.columns)
