"""What a static deployment consists of: packages, their files, bundles, scripts and texts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, merge
from .catalogues import Catalogues

#: Fixed by the formats.
BASE = "base"
JS_PATTERNS = (r"""\$t\(\s*'((?:\\.|[^'\\])*)'""", r"""\$t\(\s*"((?:\\.|[^"\\])*)\"""", r"""mage\.__\(\s*'((?:\\.|[^'\\])*)'""", r"""mage\.__\(\s*"((?:\\.|[^"\\])*)\"""", r"""i18n:\s*'((?:\\.|[^'\\])*)'""")


def plan(themes: DataFrame, locales: DataFrame, areas: Sequence[str] = ("frontend", "adminhtml"), only: Sequence[str] = ()) -> DataFrame:
    """area, theme, locale: what to deploy. themes: theme, area; locales: area (null: any), locale."""
    wanted = themes.filter(F.col("area").isin(*areas))
    if only:
        wanted = wanted.filter(F.col("theme").isin(*only))
    spread = locales.select("locale", F.explode(F.when(F.col("area").isNull(), F.array(*map(F.lit, areas))).otherwise(F.array("area"))).alias("area"))
    return wanted.select("area", "theme").join(spread, "area").distinct().orderBy("area", "theme", "locale")


def chains(themes: DataFrame) -> DataFrame:
    """area, theme, layer, of: a theme's chain, the farthest ancestor first (layer 0)."""
    key = F.concat_ws("|", "area", "theme")
    edges = themes.filter("parent IS NOT NULL").select(key.alias("src"), F.concat_ws("|", "area", "parent").alias("dst"))
    every = themes.select(key.alias("root"), key.alias("node"), F.lit(0).alias("depth")).unionByName(graph.closure(edges))
    known = every.join(themes.select(key.alias("node")), "node", "left_semi")
    most = known.groupBy("root").agg(F.max("depth").alias("most"))
    split = lambda c, n: F.element_at(F.split(c, r"\|"), n)
    return known.join(most, "root").select(split("root", 1).alias("area"), split("root", 2).alias("theme"), (F.col("most") - F.col("depth")).alias("layer"), split("node", 2).alias("of"))


def web_files(shop: Catalogues) -> DataFrame:
    """area, theme, locale, out, path, content, rank, load_order: files of modules (no theme), libraries and themes, and where each goes.

    Ranks: 0 library, 1 module in all areas, 2 module in its area, 3 theme; locale folders come after the others of the same.
    """
    enabled = shop.modules.filter("state = 'enabled'").select(F.col("name").alias("module"), "root", "load_order")
    lib = shop.files.filter(F.startswith("path", F.lit("lib/web/"))).select(F.lit(BASE).alias("area"), F.lit(None).cast("string").alias("theme"), F.expr("substring(path, 9)").alias("rest"), F.lit(None).cast("string").alias("module"), "path", "content", F.lit(0).alias("rank"), F.lit(0).alias("load_order"))
    pattern = r"^(.*?)/view/([^/]+)/web/(.*)$"
    own = shop.files.filter(F.col("path").rlike(pattern)).select("path", "content", F.regexp_extract("path", pattern, 1).alias("root"), F.regexp_extract("path", pattern, 2).alias("area"), F.regexp_extract("path", pattern, 3).alias("rest"))
    modules = own.join(enabled, "root").select("area", F.lit(None).cast("string").alias("theme"), "rest", "module", "path", "content", F.when(F.col("area") == BASE, 1).otherwise(2).alias("rank"), "load_order")
    pattern = r"^app/design/([^/]+)/([^/]+/[^/]+)/(?:([A-Z][A-Za-z0-9]*_[A-Za-z0-9]+)/)?web/(.*)$"
    themed = shop.files.filter(F.col("path").rlike(pattern)).select("path", "content", *(F.regexp_extract("path", pattern, k).alias(n) for k, n in ((1, "area"), (2, "theme"), (3, "m"), (4, "rest"))))
    themed = themed.select("area", "theme", "rest", F.nullif("m", F.lit("")).alias("module"), "path", "content", F.lit(3).alias("rank"), F.lit(0).alias("load_order"))
    every = lib.unionByName(modules).unionByName(themed)
    locale = F.nullif(F.regexp_extract("rest", r"^i18n/([a-z]{2,3}_[A-Za-z_]+)/", 1), F.lit(""))
    rest = F.when(locale.isNotNull(), F.regexp_replace("rest", r"^i18n/[^/]+/", "")).otherwise(F.col("rest"))
    return every.select("area", "theme", locale.alias("locale"), F.concat_ws("/", "module", rest).alias("out"), "path", "content", "rank", "load_order")


def package(shop: Catalogues, area: str, theme: str, locale: str) -> DataFrame:
    """out, path, content, position: the files of a package; later layers replace, at the place of the first."""
    chain = chains(shop.themes).filter((F.col("area") == area) & (F.col("theme") == theme)).select(F.col("of").alias("theme"), F.col("layer").alias("theme_layer"))
    files = web_files(shop).filter(F.col("area").isin(BASE, area) & (F.col("locale").isNull() | (F.col("locale") == locale)))
    own = files.filter("rank < 3").withColumn("theme_layer", F.lit(-1)).unionByName(files.filter("rank = 3").join(F.broadcast(chain), "theme").select(*files.columns, "theme_layer"))  # a chain is a few themes
    at = F.struct("rank", "theme_layer", "load_order", F.col("locale").isNotNull().alias("localized"), "path")
    return own.groupBy("out").agg(F.max_by(F.struct("path", "content"), at).alias("f"), F.min(at).alias("position")).select("out", "f.path", "f.content", "position").orderBy("position", "out")


def without(entries: DataFrame, prefixes: Sequence[str], column: str = "out") -> DataFrame:
    """Entries that lie under none of the prefixes."""
    kept = entries
    for p in prefixes:
        kept = kept.filter(~scalars.under(F.col(column), p.rstrip("/")))
    return kept


def glob_order(paths: DataFrame, path: str = "path") -> DataFrame:
    """In each folder the files come before the folders, each by name."""
    parts = F.split(path, "/")
    key = F.transform(parts, lambda x, i: F.struct((i < F.size(parts) - 1).alias("folder"), x.alias("name")))
    return paths.orderBy(key)


def bundles(entries: DataFrame, most: int, by: Sequence[str] = ("package", "pool"), order: Sequence[str] = ("path",)) -> DataFrame:
    """by, path, bundle: files in order fill bundles of less than ``most`` characters; one that doesn't fit opens the next.

    entries: by, order, path, size. A group's sizes are handled in one task, the contents stay where they are.
    """

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order), kind="stable")
        number, free, out = 0, most, []
        for size in group["size"]:
            if free > size:
                free -= size
            else:
                number, free = number + 1, most - size
            out.append(number)
        return group[[*by, "path"]].assign(bundle=out)

    kinds = dict(entries.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "path")) + ", bundle int"
    return entries.select(*dict.fromkeys([*by, *order, "path", "size"])).groupBy(*by).applyInPandas(fill, schema)


def require_sources(shop: Catalogues, area: str, theme: str) -> DataFrame:
    """path, content, position: requirejs-config.js files in order: modules in all areas, in the area, then the themes of the chain."""
    enabled = shop.modules.filter("state = 'enabled'").select("root", "load_order")
    pattern = r"^(.*?)/view/([^/]+)/requirejs-config\.js$"
    own = shop.files.filter(F.col("path").rlike(pattern)).select("path", "content", F.regexp_extract("path", pattern, 1).alias("root"), F.regexp_extract("path", pattern, 2).alias("of")).filter(F.col("of").isin(BASE, area))
    modules = own.join(enabled, "root").select("path", "content", F.struct(F.when(F.col("of") == BASE, 0).otherwise(1).alias("rank"), F.col("load_order").alias("at"), "path").alias("position"))
    chain = chains(shop.themes).filter((F.col("area") == area) & (F.col("theme") == theme)).select(F.col("of").alias("theme"), "layer")
    pattern = r"^app/design/([^/]+)/([^/]+/[^/]+)/(?:[A-Z]\w*/)?requirejs-config\.js$"
    themed = shop.files.filter(F.col("path").rlike(pattern) & (F.regexp_extract("path", pattern, 1) == area)).select("path", "content", F.regexp_extract("path", pattern, 2).alias("theme")).join(F.broadcast(chain), "theme")  # a few themes
    return modules.unionByName(themed.select("path", "content", F.struct(F.lit(2).alias("rank"), F.col("layer").alias("at"), "path").alias("position"))).orderBy("position")


def require_config(sources: DataFrame) -> DataFrame:
    """One row: the sources, each in a function of its own, in order. One file by nature."""
    one = F.concat(F.lit("(function() {\n"), "content", F.lit("\nrequire.config(config);\n})();\n"))
    listed = F.array_sort(F.collect_list(F.struct("position", one.alias("text"))))
    body = F.array_join(F.transform(listed, lambda x: x["text"]), "")
    return sources.agg(F.concat(F.lit("(function(require){\n"), body, F.lit("\n})(require);")).alias("content"))


def phrases(scripts: DataFrame, content: str = "content") -> DataFrame:
    """phrase: literals that scripts and templates hand to a translating call; literals joined by a plus are one."""
    glued = F.regexp_replace(F.regexp_replace(content, r"'\s*\+\s*'", ""), r'"\s*\+\s*"', "")
    every = F.flatten(F.array(*(F.regexp_extract_all(glued, F.lit(p), F.lit(1)) for p in JS_PATTERNS)))
    plain = F.regexp_replace(F.col("p"), r"\\(['\"\\])", "$1")
    return scripts.select(F.explode(every).alias("p")).select(plain.alias("phrase")).filter("phrase <> ''").distinct()


def script_dictionary(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """key, value of the phrases with another translation. dictionary: key, value."""
    return found.join(dictionary, F.col("phrase") == F.col("key")).filter("key <> value").select("key", "value").orderBy("key")


def sri_list(entries: DataFrame) -> DataFrame:
    """out, integrity of scripts and styles."""
    return entries.filter(F.col("out").rlike(r"\.(js|css)$")).select("out", scalars.integrity(F.col("content")).alias("integrity")).orderBy("out")


def bucket_of(path: Column) -> Column:
    """area/vendor/theme/locale of a deployed file; the first part of others."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) > 4) & F.element_at(parts, 1).isin("frontend", "adminhtml", BASE), F.array_join(F.slice(parts, 1, 4), "/")).otherwise(F.element_at(parts, 1))


def verified(reference: DataFrame, output: DataFrame, strict: bool = False, full: bool = False) -> DataFrame:
    """bucket, missing, extra, changed, equivalent, identical: deployed trees (path, content) held against each other.

    Buckets that weren't deployed at all are left out unless ``full``; styles that differ in blanks alone are equivalent unless ``strict``.
    """
    there = output.select(bucket_of(F.col("path")).alias("bucket")).distinct()
    wanted = reference.withColumn("bucket", bucket_of(F.col("path")))
    wanted = wanted if full else wanted.join(there, "bucket", "left_semi")
    squeeze = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r" ?([{};:,>]) ?", "$1")
    a = wanted.select("path", F.md5("content").alias("a"), F.md5(squeeze("content")).alias("as"))
    b = output.select("path", F.md5("content").alias("b"), F.md5(squeeze("content")).alias("bs"))
    loose = F.col("path").endswith(".css") & (F.col("as") == F.col("bs")) & F.lit(not strict)
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "identical").when(loose, "equivalent").otherwise("changed")
    rows = a.join(b, "path", "full_outer").select(bucket_of(F.col("path")).alias("bucket"), state.alias("state"))
    return rows.groupBy("bucket").agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("missing", "extra", "changed", "equivalent", "identical"))).orderBy("bucket")


def totals(report: DataFrame) -> DataFrame:
    return report.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in report.columns if c != "bucket"))


def less_entries(entries: DataFrame) -> DataFrame:
    """Style sources that are compiled by themselves: not partial ones, whose names begin with an underscore."""
    return entries.filter(F.col("out").rlike(r"(^|/)[^_/][^/]*\.less$")).select("out")


def variable_notation(css: Column, area: str, theme: str, locale: str) -> Column:
    """{{base_url_path}} stands for the package's folder; urls of assets go through it."""
    return F.replace(css, F.lit("{{base_url_path}}"), F.lit(f"{area}/{theme}/{locale}/"))


def module_notation(css: Column, depth: Column) -> Column:
    """url(Module_Name::path) to a path from a style that lies ``depth`` folders down."""
    up = F.repeat(F.lit("../"), depth)
    marked = F.regexp_replace(css, r"""url\(\s*(['"]?)([A-Z][A-Za-z0-9]*_[A-Za-z0-9]+)::([^'")]+)\1\s*\)""", "url($1\u0001$2/$3$1)")
    return F.replace(marked, F.lit("\u0001"), up)


def placed(entries: DataFrame) -> DataFrame:
    """kind, files, bytes: what a package holds, by the files' extensions."""
    kind = F.lower(F.regexp_extract("out", r"\.([^./]+)$", 1))
    return entries.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes")).orderBy("kind")


def dictionary_of(shop: Catalogues, locale: str) -> DataFrame:
    """key, value: all texts of a locale, the last of modules, packs and themes."""
    return merge.merge_last(shop.translations("", locale), ["key"], ["layer", "load_order", "path", "line"]).select("key", "value")
