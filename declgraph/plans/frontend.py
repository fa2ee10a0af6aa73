"""Layouts, templates and UI components of an installation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge
from ..sources import pieces
from ..sources.xml import xml_nodes
from .installation import Installation

#: Elements of a layout file that contribute something.
OPERATIONS = ("block", "container", "referenceBlock", "referenceContainer", "move", "remove", "uiComponent", "update", "attribute", "css", "script", "link", "meta")


def view_files(shop: Installation) -> DataFrame:
    """path, content (and its piece), module, area, part, rest, rank, load_order: below a module's or a theme's view folders; modules come first."""
    enabled = shop.modules.filter("state = 'enabled'").select(F.col("name").alias("module"), "root", "load_order")
    pattern = r"^(.*?)/view/([^/]+)/([^/]+)/(.*)$"
    kept = ["path", "content", *pieces.of(shop.files)]
    own = shop.files.filter(F.col("path").rlike(pattern)).select(*kept, *(F.regexp_extract("path", pattern, k).alias(n) for k, n in ((1, "root"), (2, "area"), (3, "part"), (4, "rest"))))
    of_modules = own.join(enabled, "root").select(*kept, "module", "area", "part", "rest", F.lit(0).alias("rank"), "load_order")
    pattern = r"^app/design/([^/]+)/([^/]+/[^/]+)/([A-Z][A-Za-z0-9]*_[A-Za-z0-9]+)/([^/]+)/(.*)$"
    theme = shop.files.filter(F.col("path").rlike(pattern)).select(*kept, *(F.regexp_extract("path", pattern, k).alias(n) for k, n in ((3, "module"), (1, "area"), (4, "part"), (5, "rest"))), F.lit(1).alias("rank"), F.lit(0).alias("load_order"))
    return of_modules.unionByName(theme)


def layouts(shop: Installation) -> DataFrame:
    """area, handle, op, name, parent, template, module, path, line, seq, rank, load_order."""
    nodes = xml_nodes(view_files(shop).filter("part IN ('layout', 'page_layout') AND rest LIKE '%.xml'")).filter(F.col("tag").isin(*OPERATIONS))
    around = F.filter("trail", lambda t: t["attrs"].getItem("name").isNotNull())
    get = lambda c, k: F.try_element_at(c, F.lit(k))
    return nodes.select(
        "area", F.regexp_extract("rest", r"([^/]+)\.xml$", 1).alias("handle"), F.col("tag").alias("op"), F.coalesce(get("attrs", "name"), get("attrs", "handle")).alias("name"),
        F.when(F.size(around) > 0, F.element_at(around, -1)["attrs"].getItem("name")).alias("parent"), get("attrs", "template").alias("template"), "module", "path", "line", "seq", "rank", "load_order",
    )


def handles(shop: Installation, area: str) -> DataFrame:
    """handle, contributions, of an area and of what all areas share."""
    return layouts(shop).filter(F.col("area").isin(area, "base")).groupBy("handle").agg(F.count(F.lit(1)).alias("contributions")).orderBy("handle")


def layout(shop: Installation, handle: str, area: str) -> dict[str, DataFrame]:
    """A handle's contributions in order, the handles it includes and those that include it, one step each."""
    every = layouts(shop).filter(F.col("area").isin(area, "base"))
    updates = every.filter("op = 'update'")
    return {
        "contributions": every.filter(F.col("handle") == handle).orderBy("rank", "load_order", "path", "seq"),
        "includes": updates.filter(F.col("handle") == handle).select(F.col("name").alias("handle")).distinct(),
        "included_by": updates.filter(F.col("name") == handle).select("handle").distinct(),
    }


def templates(shop: Installation) -> DataFrame:
    """area, reference, files (modules first), usages (path:line): what is there and what is used; either may be empty."""
    files = view_files(shop).filter("part = 'templates'").select("area", F.concat("module", F.lit("::"), "rest").alias("reference"), F.struct("rank", "load_order", "path").alias("file"), F.lit(None).cast("string").alias("usage"))
    short = F.when(F.contains("template", F.lit("::")), F.col("template")).otherwise(F.concat("module", F.lit("::"), "template"))
    used = layouts(shop).filter("template IS NOT NULL").select("area", short.alias("reference"), F.lit(None).cast(files.schema["file"].dataType).alias("file"), F.concat_ws(":", "path", "line").alias("usage"))
    both = files.unionByName(used).groupBy("area", "reference").agg(F.array_sort(F.collect_list("file")).alias("files"), F.array_sort(F.collect_list("usage")).alias("usages"))
    return both.withColumn("files", F.transform("files", lambda f: f["path"]))


def missing_templates(shop: Installation) -> DataFrame:
    """Used templates without any file, in their area or the base."""
    every = templates(shop)
    there = every.filter("size(files) > 0").select("reference").distinct()
    return every.filter("size(usages) > 0 AND size(files) = 0 AND reference LIKE '%.phtml'").join(there, "reference", "left_anti")


def ui_components(shop: Installation) -> DataFrame:
    """area, name, kind (of the first declaring file), contributions."""
    nodes = xml_nodes(view_files(shop).filter("part = 'ui_component' AND rest LIKE '%.xml'")).filter("size(trail) = 0")
    named = nodes.withColumn("name", F.regexp_extract("rest", r"([^/]+)\.xml$", 1))
    first = merge.merge_first(named.select("area", "name", F.col("tag").alias("kind"), "rank", "load_order", "path"), ["area", "name"], ["rank", "load_order", "path"])
    return first.select("area", "name", "kind", F.col("declared").alias("contributions"))


def static_package(entries: DataFrame) -> DataFrame:
    """path, content, position: a later layer's content at the earliest layer's place. entries: path, content, layer, position."""
    at = F.struct("layer", "position")
    return entries.groupBy("path").agg(F.max_by("content", at).alias("content"), F.min(at).alias("position"))
