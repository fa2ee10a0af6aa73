"""Questions across the merged tables: who depends on whom, and what a class is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .installation import OVERLAID, Installation


def dependencies(shop: Installation, packages: DataFrame | None = None) -> DataFrame:
    """module, other, direction (needs or needed by), sequence, package: by module sequences and package requirements.

    packages: (module, requires), names of modules.
    """
    edges = shop.declared("module_sequence").filter("of IS NOT NULL").select(F.col("of").alias("src"), F.col("after").alias("dst"), F.lit("sequence").alias("by"))
    if packages is not None:
        edges = edges.unionByName(packages.select(F.col("module").alias("src"), F.col("requires").alias("dst"), F.lit("package").alias("by")))
    needs = edges.select(F.col("src").alias("module"), F.col("dst").alias("other"), F.lit("needs").alias("direction"), "by")
    needed = edges.select(F.col("dst").alias("module"), F.col("src").alias("other"), F.lit("needed by").alias("direction"), "by")
    flags = [F.bool_or(F.col("by") == b).alias(b) for b in ("sequence", "package")]
    return needs.unionByName(needed).groupBy("module", "other", "direction").agg(*flags)


def ancestors(tree: DataFrame, key: str, parent: str, of: str) -> DataFrame:
    """The nodes above one of a tree with ``depth``, from the root down."""
    edges = tree.filter(F.col(parent).isNotNull()).select(F.col(key).alias("src"), F.col(parent).alias("dst"))
    above = graph.closure(edges).filter(F.col("root") == of).select(F.col("node").alias(key), F.col("depth").alias("steps"))
    return tree.join(above, key).orderBy(F.desc("steps")).drop("steps")


def interception(shop: Installation) -> DataFrame:
    """class, intercepted: whether some plugin runs on it in any area."""
    found = reduce(DataFrame.unionByName, (shop.plugins_on(a).select("class") for a in ("global", *OVERLAID))).distinct()
    return shop.classes.select("class").join(found.withColumn("intercepted", F.lit(True)), "class", "left").select("class", F.coalesce("intercepted", F.lit(False)).alias("intercepted"))


def unregistered_plugins(shop: Installation) -> DataFrame:
    """class, path: classes with intercepting methods that no plugin declaration, virtual type or descendant names."""
    named = shop.plugins.select("class").unionByName(shop.virtual_types.select(F.col("type").alias("class"))).filter("class IS NOT NULL").distinct()
    bases = shop.hierarchy.filter("depth > 0").select(F.col("node").alias("class")).distinct()
    return shop.classes.filter("size(steps) > 0 AND kind = 'class'").join(named.unionByName(bases), "class", "left_anti").select("class", "path")


def whatis(shop: Installation, name: str) -> DataFrame:
    """what, detail, path, line: every place in the model in which a class has a part."""
    none = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")]

    def rows(df: DataFrame, what: str, detail: str, *place) -> DataFrame:
        return df.select(F.lit(what).alias("what"), F.col(detail).cast("string").alias("detail"), *(place or none))

    here = [F.col("path"), F.col("line")]
    is_it = lambda c: F.ltrim(c, F.lit("\\")) == name
    out = [
        rows(shop.classes.filter(F.col("class") == name), "declared as", "kind", *here),
        rows(shop.hierarchy.filter((F.col("root") == name) & (F.col("depth") > 0)), "is a", "node"),
        rows(shop.hierarchy.filter((F.col("node") == name) & (F.col("depth") > 0)), "extended by", "root"),
        rows(shop.uses(name).withColumn("detail", F.concat_ws(" ", "how", "by")), "used as", "detail", *here),
        rows(shop.declared("observers").filter(is_it("instance")), "observes", "event", *here),
        rows(shop.declared("cron_jobs").filter(is_it("instance")), "runs as job", "name", *here),
        rows(shop.declared("webapi_services").filter(is_it("class")), "serves", "url", *here),
        rows(shop.declared("topic_handlers").filter(is_it("type")), "handles topic", "topic", *here),
    ]
    return reduce(DataFrame.unionByName, out).distinct().orderBy("what", "detail", "path", "line")


def theme_chain(themes: DataFrame, of: str) -> DataFrame:
    """theme, steps: a theme and what it inherits from, nearest first. themes: theme, parent."""
    edges = themes.filter("parent IS NOT NULL").select(F.col("theme").alias("src"), F.col("parent").alias("dst"))
    own = themes.filter(F.col("theme") == of).select("theme", F.lit(0).alias("steps"))
    above = graph.closure(edges).filter((F.col("root") == of) & (F.col("node") != of)).select(F.col("node").alias("theme"), F.col("depth").alias("steps"))
    return own.unionByName(above).orderBy("steps")
