"""Classes and the files that autoloading finds for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import prefixes


def class_files(names: DataFrame, psr4: DataFrame, files: DataFrame) -> DataFrame:
    """class and path: of the longest prefix under which the file is there; null if none is.

    names: class; psr4: prefix (with its last backslash), folder; files: path.
    """
    tried = names.select("class").distinct().select("class", F.posexplode(prefixes(F.col("class"), "\\")).alias("at", "base"))
    rules = psr4.select(F.rtrim("prefix", F.lit("\\")).alias("base"), "folder")
    below = F.replace(F.expr("substring(class, length(base) + 2)"), F.lit("\\"), F.lit("/"))
    candidates = tried.join(rules, "base").select("class", "at", F.concat(F.rtrim("folder", F.lit("/")), F.lit("/"), below, F.lit(".php")).alias("path"))
    found = candidates.join(files.select("path"), "path", "left_semi")
    best = found.groupBy("class").agg(F.min_by("path", F.struct("at", "path")).alias("path"))
    return names.join(best, "class", "left")


def class_names(psr4: DataFrame, files: DataFrame) -> DataFrame:
    """class: every name that a file under a prefix stands for."""
    rules = psr4.select("prefix", F.rtrim("folder", F.lit("/")).alias("folder"))
    tried = files.filter(F.col("path").endswith(".php")).select("path", F.explode(prefixes(F.col("path"), "/")).alias("folder"))
    below = F.expr("substring(path, length(folder) + 2, length(path) - length(folder) - 5)")
    return tried.join(rules, "folder").select(F.concat("prefix", F.replace(below, F.lit("/"), F.lit("\\"))).alias("class")).distinct().orderBy("class")


def case_collisions(paths: DataFrame) -> DataFrame:
    """lower, paths: outputs that a file system without case would take for one."""
    return paths.groupBy(F.lower("path").alias("lower")).agg(F.array_sort(F.collect_set("path")).alias("paths")).filter(F.size("paths") > 1)
