"""The compile side as relations: constructors, methods, what is intercepted and what is generated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, graph
from ..sources import php, specs
from ..sources.files import AREAS
from .catalogues import Catalogues, plain
from .installation import ORDER
from .storage import staged

#: What a generated name ends in, and of what kind it is; the first that fits counts.
SUFFIXES = (("\\Interceptor", "interceptor"), ("\\Proxy", "proxy"), ("ExtensionInterfaceFactory", "extension factory"), ("ExtensionInterface", "extension interface"), ("SearchResults", "search results"), ("Factory", "factory"), ("Extension", "extension"), ("Mapper", "mapper"))
#: Kinds of differences between two compiled trees, by their paths, in this order.
DIFFERENCES = (
    ("interceptor", r"/Interceptor\.php$"), ("proxy", r"/Proxy\.php$"), ("factory", r"Factory\.php$"), ("extension", r"Extension(Interface)?\.php$"), ("area configuration", r"^metadata/(global|frontend|adminhtml|webapi_rest|webapi_soap|graphql|crontab)\.php$"),
    ("plugin list", r"plugin-list\.php$"), ("action list", r"app_action_list\.php$"), ("other metadata", r"^metadata/"),
)


def definitions(shop: Catalogues) -> DataFrame:
    """class, path, methods: one file for each class, the one whose path spells it, else the first."""
    found = shop.files.filter(F.col("path").endswith(".php")).select("path", php.methods_of("content").alias("m")).filter("m IS NOT NULL").select("path", "m.class", "m.methods")
    spelled = F.col("path").endswith(F.concat(F.replace(F.substring_index("class", "\\", -2), F.lit("\\"), F.lit("/")), F.lit(".php")))
    return found.groupBy("class").agg(F.min_by(F.struct("path", "methods"), F.struct((~spelled).alias("off"), "path")).alias("r")).select("class", "r.path", "r.methods")


def canonical(shop: Catalogues, names: DataFrame, column: str) -> DataFrame:
    """names with ``canonical``, the declared spelling of a class name in any case."""
    known = shop.classes.groupBy(F.lower("class").alias("__low")).agg(F.min("class").alias("canonical"))
    return names.join(known, F.lower(plain(column)) == F.col("__low"), "left").drop("__low")


def nearest_methods(shop: Catalogues, own: DataFrame) -> DataFrame:
    """root, depth, node and a method's columns: of each name the nearest declaration in a class's ancestry. own: node, method, m."""
    reached = shop.hierarchy.join(own, "node")
    row = F.min_by(F.struct("depth", "node", "m"), F.struct("depth", "node")).alias("r")
    return reached.groupBy("root", "method").agg(row).select("root", "method", "r.*")


def methods(shop: Catalogues) -> DataFrame:
    rows = definitions(shop).select(F.col("class").alias("node"), F.explode("methods").alias("m"))
    return rows.select("node", F.col("m.name").alias("method"), "m")


def constructors(shop: Catalogues) -> DataFrame:
    """class, declared_on, params: a class's constructor, its own or the nearest above."""
    own = methods(shop).filter("lower(method) = '__construct'").withColumn("method", F.lit("__construct"))
    return nearest_methods(shop, own).select(F.col("root").alias("class"), F.col("node").alias("declared_on"), F.col("m.params").alias("params"))


def public_methods(shop: Catalogues) -> DataFrame:
    """class, method, declared_on, m: those a plugin may run on: public, neither static nor final nor magic, the nearest of each name."""
    nearest = nearest_methods(shop, methods(shop))
    kept = nearest.filter("m.visibility = 'public' AND NOT m.static AND NOT m.final AND NOT startswith(method, '__')")
    return kept.select(F.col("root").alias("class"), "method", F.col("node").alias("declared_on"), "m")


def plugin_chains(shop: Catalogues) -> DataFrame:
    """area, class, method, steps (step, name, plugin in running order), of all areas."""
    return reduce(DataFrame.unionByName, (shop.chains(a).withColumn("area", F.lit(a)) for a in AREAS))


def plugin_lists(shop: Catalogues, area: str) -> dict[str, DataFrame]:
    """What an area's plugin list holds: the declared, the inherited ones of each class, and the chains of methods."""
    declared = shop.plugins.filter(F.col("area") == area).select("target", "name", F.col("class").alias("instance"), F.coalesce("sort_order", F.lit(0)).alias("sort_order"), F.coalesce("disabled", F.lit(False)).alias("disabled"), *(f"first_{o}" for o in (*ORDER, "line")))
    return {
        "declared": declared.orderBy("first_layer", "first_load_order", "first_line", "first_seq").select("target", "name", "instance", "sort_order", "disabled"),
        "inherited": shop.plugins_on(area).select("class", "name", "plugin", "sort_order"),
        "processed": shop.chains(area),
    }


def interception_plan(shop: Catalogues) -> DataFrame:
    """class, methods: concrete classes with plugins in some area and the public methods that these run on."""
    hooked = plugin_chains(shop).select("class", "method").distinct()
    concrete = shop.classes.filter("kind = 'class' AND NOT abstract").select("class")
    met = public_methods(shop).join(hooked, ["class", "method"]).join(concrete, "class", "left_semi")
    return met.groupBy("class").agg(F.array_sort(F.collect_set("method")).alias("methods")).orderBy("class")


def referenced(shop: Catalogues) -> DataFrame:
    """class: names in constructors, wiring and arguments, declared or not."""
    types = constructors(shop).select(F.explode("params").alias("p")).select(F.explode(F.split(F.regexp_replace("p.type", r"[?() ]", ""), r"[|&]")).alias("class"))
    wired = shop.declared("preferences").select(F.col("type").alias("class")).union(shop.declared("virtual_types").select("type")).union(shop.declared("plugins").select("class"))
    given = specs.argument_nodes(shop.nodes).filter("kind = 'object'").select(F.col("value").alias("class"))
    return types.union(wired).union(given).select(plain("class").alias("class")).filter("class IS NOT NULL AND class <> ''").distinct()


def generated(shop: Catalogues) -> DataFrame:
    """class, kind, source: referenced names that aren't declared and are made from a class; what they're made from may be made, too."""
    kind, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, name in reversed(SUFFIXES):
        fits = F.endswith("class", F.lit(suffix)) & (F.length("class") > len(suffix))
        kind = F.when(fits, F.lit(name)).otherwise(kind)
        source = F.when(fits, F.expr(f"substring(class, 1, length(class) - {len(suffix)})")).otherwise(source)
    known = shop.classes.select(F.lower("class").alias("__known")).union(shop.virtual_types.select(F.lower("name"))).distinct()
    absent = lambda names: names.join(known, F.lower("class") == F.col("__known"), "left_anti")
    made = staged(absent(referenced(shop)).withColumn("kind", kind).withColumn("source", source).filter("kind IS NOT NULL"))
    while True:  # of names with several suffixes, the ones below
        below = absent(made.select(F.col("source").alias("class")).distinct()).join(made.select("class"), "class", "left_anti").withColumn("kind", kind).withColumn("source", source).filter("kind IS NOT NULL")
        below = staged(below)
        if below.isEmpty():
            break
        made = staged(made.unionByName(below))
    intercepted = interception_plan(shop).select(F.concat("class", F.lit("\\Interceptor")).alias("class"), F.lit("interceptor").alias("kind"), F.col("class").alias("source"))
    # a source is declared or made, whatever depth it is at
    ends = made.select("class", "kind", "source").union(absent(intercepted))
    there = known.union(made.select(F.lower("class")))
    return ends.distinct().join(there.distinct(), F.lower("source") == F.col("__known"), "left_semi").orderBy("class")


def factories(rows: DataFrame) -> DataFrame:
    """class, content: the source of factories. rows: class, source."""
    space, name = F.expr("substring(class, 1, length(class) - length(substring_index(class, '\\\\', -1)) - 1)"), F.substring_index("class", "\\", -1)
    body = "{\n    protected $_objectManager = null;\n    protected $_instanceName = null;\n\n    public function __construct(\\Magento\\Framework\\ObjectManagerInterface $objectManager, $instanceName = '\\\\"
    tail = "')\n    {\n        $this->_objectManager = $objectManager;\n        $this->_instanceName = $instanceName;\n    }\n\n    public function create(array $data = [])\n    {\n        return $this->_objectManager->create($this->_instanceName, $data);\n    }\n}\n"
    escaped = F.replace("source", F.lit("\\"), F.lit("\\\\"))
    return rows.select("class", F.concat(F.lit("<?php\nnamespace "), space, F.lit(";\n\nclass "), name, F.lit("\n" + body), escaped, F.lit(tail)).alias("content"))


def constructor_arguments(shop: Catalogues, area: str) -> DataFrame:
    """class, position, parameter, type, default, configured (path=value of the wiring, sorted): what a class is made with."""
    params = constructors(shop).select("class", F.posexplode("params").alias("position", "p")).select("class", "position", F.col("p.name").alias("parameter"), "p.type", "p.default")
    given = shop.inherited_arguments(area).groupBy("class", "argument").agg(F.array_sort(F.collect_list(F.concat_ws("=", F.array_join("path", "/"), "value"))).alias("configured"))
    joined = params.join(given.withColumnRenamed("argument", "parameter"), ["class", "parameter"], "left")
    return joined.withColumn("configured", F.coalesce("configured", F.array().cast("array<string>"))).orderBy("class", "position")


def area_section(shop: Catalogues, area: str) -> DataFrame:
    """type, instance: preferences of an area followed to their ends; what is intercepted is replaced by its interceptor."""
    ends = shop.preference_of(area).select(F.col("node").alias("type"), "target").filter("target IS NOT NULL")
    plans = staged(interception_plan(shop).select(F.col("class").alias("__c")))
    own = ends.unionByName(plans.select(F.col("__c").alias("type"), F.col("__c").alias("target")).join(ends.select("type"), "type", "left_anti"))
    joined = own.join(plans, F.col("target") == F.col("__c"), "left")
    return joined.select("type", F.when(F.col("__c").isNotNull(), F.concat("target", F.lit("\\Interceptor"))).otherwise(F.col("target")).alias("instance")).orderBy("type")


def action_list(shop: Catalogues) -> DataFrame:
    """key, class: every controller class by its name in lower case."""
    found = shop.classes.filter("kind = 'class' AND contains(class, '\\\\Controller\\\\')").select("class")
    return found.select(F.lower("class").alias("key"), "class").orderBy("key")


def input_digest(shop: Catalogues) -> DataFrame:
    """digest of everything that a compilation reads: declaration files, sources and the module list, by path."""
    read = shop.files.filter(F.col("path").rlike(r"(^|/)etc/.*\.xml$|\.php$|^composer\.json$|^vendor/composer/installed\.json$"))
    return aggregates.digest_of_groups(read.withColumn("all", F.lit(1)), ["all"], ["path"], F.sha2(F.concat_ws("|", "path", F.sha2(F.coalesce("content", F.lit("")), 256)), 256), "digest").select("digest")


def classified(report: DataFrame) -> DataFrame:
    """path, state, kind: differences of two compiled trees by what they're about; ``unknown`` is left to look at. report: path, state."""
    kind = F.lit("unknown")
    for name, pattern in reversed(DIFFERENCES):
        kind = F.when(F.col("path").rlike(pattern), F.lit(name)).otherwise(kind)
    return report.filter("state <> 'identical'").withColumn("kind", kind)


def residual(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, side, line: lines that one of two versions of a file has more often than the other. Both: path, content."""
    lines = lambda df, n: df.select("path", F.explode(F.split("content", "\n")).alias("line")).select("path", F.trim("line").alias("line")).filter("line <> ''").groupBy("path", "line").agg(F.count(F.lit(1)).alias(n))
    both = lines(left, "a").join(lines(right, "b"), ["path", "line"], "full_outer").na.fill(0, ["a", "b"]).filter("a <> b")
    return both.select("path", F.when(F.col("a") > F.col("b"), "left").otherwise("right").alias("side"), "line").orderBy("path", "side", "line")


def evaluated(rows: DataFrame, expression: str, constants: dict | None = None) -> DataFrame:
    """rows with ``value``, the text of a PHP constant expression's value; null if it can't be evaluated."""

    def run(text):
        try:
            return None if text is None else php.as_text(php.evaluate(text, constants))
        except ValueError:
            return None

    return rows.withColumn("value", F.udf(run, "string", useArrow=True)(F.col(expression)))


def generated_kind(name):
    return scalars.without_suffix(name, *(s for s, _ in SUFFIXES))
