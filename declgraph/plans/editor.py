"""Answers for an editor: what stands where, and what a name means."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import catalogues, doctor, frontend, relations
from .catalogues import Catalogues, plain

NOWHERE = {"path": "string", "line": "int"}


def entity_at(path: str, text: str, offset: int) -> tuple[str, str] | None:
    """(kind, name) at a place of a text: template, class, event, table or other quoted name."""
    left = max((text.rfind(q, 0, offset) for q in "\"'<>=\n ,;()|&"), default=-1) + 1
    ends = [i for i in (text.find(q, offset) for q in "\"'<>=\n ,;()|&") if i >= 0]
    word = text[left : min(ends, default=len(text))].strip()
    if not word:
        return None
    before = text[max(0, left - 200) : left]
    attribute = re.search(r"(\w+)\s*=\s*[\"']$", before)
    if "::" in word and re.match(r"[A-Z]\w*_\w+::", word):
        return "template" if word.endswith((".phtml", ".html")) else "reference", word
    if attribute and attribute.group(1) == "template":
        return "template", word
    if "\\" in word or (path.endswith(".php") and re.fullmatch(r"[A-Z]\w*", word)):
        return "class", word.lstrip("\\").partition("::")[0]
    tag = re.search(r"<(\w+)[^<>]*$", before)
    if attribute and tag:
        return {"event": "event", "table": "table", "resource": "resource", "topic": "topic", "job": "job"}.get(tag.group(1), tag.group(1)), word
    return None


def symbols(shop: Catalogues, query: str, limit: int = 100) -> DataFrame:
    """name, kind, path, line: what is declared under names that hold the query; shorter names first."""
    none = [F.lit(None).cast(t).alias(c) for c, t in NOWHERE.items()]
    parts = [
        shop.classes.select(F.col("class").alias("name"), "kind", "path", "line"),
        shop.declared("virtual_types").select(plain("name").alias("name"), F.lit("virtual type").alias("kind"), "path", "line"),
        shop.declared("observers").select(F.col("event").alias("name"), F.lit("event").alias("kind"), "path", "line"),
        shop.declared("tables").select("name", F.lit("table").alias("kind"), "path", "line"),
        shop.declared("topics").select("name", F.lit("topic").alias("kind"), "path", "line"),
        shop.acl.select(F.col("id").alias("name"), F.lit("resource").alias("kind"), *none),
        shop.modules.select("name", F.lit("module").alias("kind"), F.col("root").alias("path"), F.lit(1).alias("line")),
    ]
    found = reduce(DataFrame.unionByName, parts).filter(scalars.icontains(F.col("name"), query)).distinct()
    return found.orderBy(F.length("name"), "name", "kind", "path", "line").limit(limit)


def document_symbols(shop: Catalogues, path: str) -> DataFrame:
    """name, kind, line, depth: the named elements of a declaration file, or the classes and their intercepting methods of a source."""
    name = F.coalesce(*(F.try_element_at("attrs", F.lit(a)) for a in ("name", "id", "for", "code", "url", "topic")))
    xml = shop.nodes.filter(F.col("path") == path).select(name.alias("name"), F.col("tag").alias("kind"), "line", F.size("trail").alias("depth")).filter("name IS NOT NULL")
    source = shop.classes.filter(F.col("path") == path).select(F.col("class").alias("name"), "kind", "line", F.lit(0).alias("depth"))
    return xml.unionByName(source).orderBy("line", "depth", "name")


def definition(shop: Catalogues, kind: str, name: str) -> DataFrame:
    """path, line: where a name is declared."""
    if kind == "template":
        files = frontend.templates(shop).filter(F.col("reference") == name)
        return files.select(F.explode("files").alias("path"), F.lit(1).alias("line")).distinct().orderBy("path")
    where = {"event": ("observers", "event"), "table": ("tables", "name"), "topic": ("topics", "name"), "job": ("cron_jobs", "name"), "resource": ("acl", "id")}
    if kind in where:
        rows, column = where[kind]
        return shop.declared(rows).filter(F.col(column) == name).select("path", "line").distinct().orderBy("path", "line")
    own = shop.classes.filter(F.lower("class") == name.lower()).select("path", "line")
    return own.union(shop.declared("virtual_types").filter(plain("name") == name).select("path", "line")).distinct().orderBy("path", "line")


def references(shop: Catalogues, name: str) -> DataFrame:
    """how, path, line: every declaration that names a class."""
    is_it = lambda c: F.lower(plain(c)) == name.lower()
    rows = [shop.uses(name).select("how", "path", "line")]
    for how, kind, column in (("observer", "observers", "instance"), ("job", "cron_jobs", "instance"), ("service", "webapi_services", "class"), ("handler", "topic_handlers", "type"), ("indexer", "indexers", "class"), ("extended", "extension_attributes", "for")):
        rows.append(shop.declared(kind).filter(is_it(column)).select(F.lit(how).alias("how"), "path", "line"))
    below = shop.classes.filter(F.exists("parents", lambda p: F.lower(p) == name.lower())).select(F.lit("extended by").alias("how"), "path", "line")
    return reduce(DataFrame.unionByName, [*rows, below]).distinct().orderBy("path", "line", "how")


def hover(shop: Catalogues, name: str, area: str = "global") -> DataFrame:
    """what, detail: a class in a few lines."""
    ends = shop.preference_of(area).filter(F.col("node") == name).select(F.lit("resolves to").alias("what"), F.col("target").alias("detail"))
    running = shop.plugins_on(area).filter(F.col("class") == name).select(F.lit("plugin").alias("what"), F.concat_ws(" ", "name", "plugin").alias("detail"))
    known = relations.whatis(shop, name).select("what", "detail")
    return ends.unionByName(running).unionByName(known).distinct().orderBy("what", "detail")


def completions(shop: Catalogues, prefix: str, limit: int = 50) -> DataFrame:
    """name, kind: classes and virtual types that begin with a prefix, or whose last part does."""
    names = shop.classes.select(F.col("class").alias("name"), "kind").union(shop.virtual_types.select("name", F.lit("virtual type")))
    low = prefix.lower().lstrip("\\")
    whole, last = F.startswith(F.lower("name"), F.lit(low)), F.startswith(F.lower(F.substring_index("name", "\\", -1)), F.lit(low))
    return names.distinct().filter(whole | last).orderBy(~whole, "name", "kind").limit(limit)


def lenses(shop: Catalogues, path: str) -> DataFrame:
    """class, line, plugins, preferences, observers: how much hangs on the classes of a file."""
    own = shop.classes.filter(F.col("path") == path).select("class", "line")
    plugins = shop.plugins_everywhere().groupBy("class").agg(F.count(F.lit(1)).alias("plugins"))
    preferred = shop.preferences.filter("area = 'global'").groupBy(F.col("type").alias("class")).agg(F.count(F.lit(1)).alias("preferences"))
    observing = shop.observers.groupBy(plain("instance").alias("class")).agg(F.countDistinct("event", "name").alias("observers"))
    return own.join(plugins, "class", "left").join(preferred, "class", "left").join(observing, "class", "left").na.fill(0, ["plugins", "preferences", "observers"]).orderBy("line")


def hints(shop: Catalogues, path: str, area: str = "global") -> DataFrame:
    """line, hint: beside a declared preference or plugin, what comes of it in the merged model."""
    ends = shop.preference_of(area).select(F.col("node").alias("for"), "target")
    chosen = shop.declared("preferences").filter(F.col("path") == path).withColumn("for", plain("for")).join(ends, "for").filter(plain("type") != F.col("target")).select("line", F.concat(F.lit("overridden by "), "target").alias("hint"))
    merged = shop.plugins.filter(F.col("area") == area).select("target", "name", "disabled", "source")
    off = shop.declared("plugins").filter(F.col("path") == path).select(plain("target").alias("target"), "name", "line").join(merged, ["target", "name"]).filter("disabled").select("line", F.concat(F.lit("disabled by "), "source.module").alias("hint"))
    return chosen.unionByName(off).distinct().orderBy("line", "hint")


def quick_fixes(shop: Catalogues, prefixes: list[str], path: str | None = None) -> DataFrame:
    """lint, subject, path, line, suggestion: findings with the nearest known name."""
    found = doctor.doctor(shop, prefixes)
    found = found.filter(F.col("path") == path) if path else found
    return doctor.suggestions(found, shop).filter("suggestion IS NOT NULL").select("lint", "subject", "path", "line", "suggestion").orderBy("path", "line", "subject")


def rename(shop: Catalogues, name: str, new: str) -> DataFrame:
    """path, line, text: the lines that hold a name as a whole, with the new one in its place."""
    quoted = re.escape(name)
    pattern = rf"(?<![\w\\]){quoted}(?![\w\\])"
    candidates = shop.files.filter(F.contains("content", F.lit(name)))
    lines = candidates.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).filter(F.col("text").rlike(pattern))
    return lines.select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("text", pattern, new.replace("\\", "\\\\").replace("$", "\\$")).alias("text")).orderBy("path", "line")


def diagnostics_by_file(shop: Catalogues, prefixes: list[str]) -> DataFrame:
    """path, findings (line, severity, message, sorted): what there is to say about each file."""
    lints = doctor.doctor(shop, prefixes).unionByName(catalogues.lints(shop, shop.classes.select("class"))).filter("path IS NOT NULL")
    rows = lints.select("path", F.coalesce("line", F.lit(1)).alias("line"), "severity", F.concat_ws(": ", "lint", "subject").alias("message"))
    rows = rows.unionByName(shop.diagnostics().select("path", F.lit(1).alias("line"), "severity", "message"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("line", "severity", "message"))).alias("findings")).orderBy("path")
