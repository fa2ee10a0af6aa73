"""Lints over an installation: dangling references and broken structure.

A class is known if a file declares it, or if no autoload prefix covers it:
what can't be checked isn't reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import specs
from .installation import Installation, flag
from .lints import finding, findings

SUFFIXES = ("Factory", "\\Proxy", "\\Interceptor", "InterfaceFactory", "ExtensionInterface", "Extension")


def missing(rows: DataFrame, column: str, shop: Installation, prefixes: list[str]) -> DataFrame:
    """Rows whose class lies under a known prefix and isn't declared, generated or virtual."""
    known = shop.classes.select(F.lower("class").alias("__known")).unionByName(shop.virtual_types.select(F.lower("name").alias("__known"))).distinct()
    name = F.ltrim(column, F.lit("\\"))
    covered, generated = F.lit(False), F.lit(False)
    for p in prefixes:
        covered = covered | F.startswith(name, F.lit(p))
    for s in SUFFIXES:
        generated = generated | F.endswith(name, F.lit(s))
    return rows.filter(F.col(column).isNotNull() & covered & ~generated).join(known, F.lower(name) == F.col("__known"), "left_anti")


def doctor(shop: Installation, prefixes: list[str]) -> DataFrame:
    """lint, severity, subject, path, line."""
    place = [F.col("path"), F.col("line")]
    nowhere = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")]
    out = [
        finding(shop.modules.filter("state = 'missing on disk'"), "ModuleMissingOnDisk", "error", F.col("name"), *nowhere),
        finding(shop.modules.filter("state = 'not registered'"), "ModuleNotRegistered", "warn", F.col("name"), *nowhere),
    ]
    references = (
        ("PreferenceTargetMissing", shop.declared("preferences"), "type"), ("VirtualTypeBaseMissing", shop.declared("virtual_types"), "type"),
        ("PluginClassMissing", shop.declared("plugins").filter(~F.coalesce(flag("disabled"), F.lit(False))), "class"), ("ObserverClassMissing", shop.declared("observers"), "instance"),
        ("CronInstanceMissing", shop.declared("cron_jobs"), "instance"), ("WebapiServiceMissing", shop.declared("webapi_services"), "class"),
        ("MqHandlerMissing", shop.declared("topic_handlers"), "type"),
        ("DiArgumentClassMissing", specs.argument_nodes(shop.nodes).filter("kind = 'object'").select("value", F.col("source_path").alias("path"), "line"), "value"),
    )
    for lint, rows, column in references:
        out.append(finding(missing(rows, column, shop, prefixes), lint, "error", F.col(column), *place))
    resources = shop.declared("webapi_resources").filter(~F.col("ref").isin("anonymous", "self"))
    unknown = resources.join(shop.acl.select(F.col("id").alias("__id")), F.col("ref") == F.col("__id"), "left_anti")
    out.append(finding(unknown, "AclResourceUnknown", "error", F.col("ref"), *place))
    edges = shop.declared("module_sequence").select(F.col("of").alias("src"), F.col("after").alias("dst")).filter("src IS NOT NULL")
    reached = graph.closure(edges)
    cyclic = reached.filter("root = node").select("root")
    members = reached.join(cyclic.withColumnRenamed("root", "node"), "node", "left_semi").join(cyclic, "root", "left_semi")
    back = reached.select(F.col("root").alias("node"), F.col("node").alias("root"))
    both = members.join(back, ["root", "node"], "left_semi").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("node")), " > ").alias("cycle"))
    out.append(finding(both.select("cycle").distinct(), "SequenceCycle", "error", F.col("cycle"), *nowhere))
    preferences = shop.preferences.filter("area = 'global' AND `for` <> type").select(F.col("for").alias("src"), F.col("type").alias("dst"))
    stuck = graph.chase(preferences).filter("target IS NULL")
    out.append(finding(stuck, "PreferenceCycle", "error", F.col("node"), *nowhere))
    return findings(*out)


def suggestions(found: DataFrame, shop: Installation, most: int = 2) -> DataFrame:
    """Findings with the nearest known class of the same name's spelling, if it is at most so many edits away."""
    from ..operators.joins import similarity_join

    names = found.select(F.col("subject").alias("n")).unionByName(shop.classes.select(F.col("class").alias("n")))
    pairs = similarity_join(names, "n", most)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    near = both.join(shop.classes.select(F.col("class").alias("b")), "b", "left_semi")
    best = near.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("s")).select(F.col("a").alias("subject"), F.col("s.b").alias("suggestion"), F.col("s.distance").alias("distance"))
    return found.join(best, "subject", "left")
