"""Files, modules and where a file belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import php, pieces
from .xml import xml_nodes

#: Areas in their order; the first is the base of the others.
AREAS = ("global", "frontend", "adminhtml", "webapi_rest", "webapi_soap", "graphql", "crontab")


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below root), content (text) of all files; Spark lists and reads them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() else c for c in root.rstrip("/").rpartition(":")[2]) + "/", "")
    return files.select(below.alias("path"), F.decode("content", "UTF-8").alias("content"))


def overlaid(files: DataFrame, buffers: DataFrame) -> DataFrame:
    """Buffers (path, content) take the place of files and add new ones."""
    other = buffers.select("path", "content")
    rest = files.join(other.filter("content IS NOT NULL"), "path", "left_anti")
    return rest.unionByName(other.join(rest, "path", "left_anti"), allowMissingColumns=True)


def root_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/(?:etc|view|i18n|registration\.php$)", 1)


def modules(files: DataFrame) -> DataFrame:
    """name, enabled, load_order, root, source, state: config order joined to what is on disk; both sides stay.

    Load order is the order of the keys in config.php, whatever the modules' sequences say.
    """
    config = files.filter("path = 'app/etc/config.php'").select(F.posexplode(php.array_leaves("content")).alias("at", "leaf"))
    listed = config.filter(F.col("leaf.path")[0] == "modules").select(F.col("leaf.path")[1].alias("name"), (F.col("leaf.value") == "1").alias("enabled"), F.col("at").alias("load_order"))
    declared = xml_nodes(files.filter(F.col("path").endswith("/etc/module.xml"))).filter("tag = 'module' AND size(trail) = 1")
    source = F.when(F.startswith("path", F.lit("app/code/")), "app").otherwise("vendor")
    disk = declared.select(F.col("attrs")["name"].alias("name"), root_of(F.col("path")).alias("root"), source.alias("source"))
    first = disk.groupBy("name").agg(F.min(F.struct("source", "root")).alias("r"), F.count(F.lit(1)).alias("places")).select("name", "r.root", "r.source", "places")
    joined = listed.join(first, "name", "full_outer")
    state = F.when(F.col("root").isNull(), "missing on disk").when(F.col("enabled").isNull(), "not registered").when(F.col("enabled"), "enabled").otherwise("disabled")
    return joined.select("name", F.coalesce("enabled", F.lit(False)).alias("enabled"), "load_order", "root", "source", "places", state.alias("state"))


def located(files: DataFrame, known: DataFrame) -> DataFrame:
    """Declaration files of enabled modules, and the primary ones: with module, area, file, layer and load_order."""
    etc = files.filter(F.col("path").rlike(r"(^|/)etc/.*\.xml$"))
    tail = F.regexp_extract("path", r"/etc/(.*)$", 1)
    area = F.when(F.contains(tail, F.lit("/")), F.substring_index(tail, "/", 1)).otherwise("global")
    name = F.substring_index("path", "/", -1)
    primary = etc.filter(F.startswith("path", F.lit("app/etc/")) & F.col("path").endswith("di.xml")).select(
        "path", "content", *pieces.of(files), F.lit(None).cast("string").alias("module"), F.lit("global").alias("area"), F.lit("di.xml").alias("file"), F.lit(0).alias("layer"), F.lit(-1).alias("load_order")
    )
    own = etc.filter(~F.startswith("path", F.lit("app/etc/"))).withColumn("root", root_of(F.col("path")))
    enabled = known.filter("state = 'enabled'").select(F.col("name").alias("module"), "root", "load_order")
    return primary.unionByName(own.join(enabled, "root").select("path", "content", *pieces.of(files), "module", area.alias("area"), name.alias("file"), F.when(area == "global", 1).otherwise(2).alias("layer"), "load_order"))


def classes(files: DataFrame) -> DataFrame:
    """class, kind, parents, path, line of the PHP files."""
    found = files.filter(F.col("path").endswith(".php")).select("path", php.class_of("content").alias("c"), php.plugin_methods("content").alias("steps"))
    return found.filter("c IS NOT NULL").select(F.col("c.name").alias("class"), "c.kind", "c.abstract", "c.parents", "path", "c.line", "steps")
