"""The merged model of one installation, as DataFrames.

An Installation holds the files and gives named tables, each built when it is
first asked for: silver tables are declarations as they stand in the files,
gold tables are merged over the load order. ``order`` is the total order of
declarations: layer, load order, file, place in the file. Long files may come
in pieces (sources/pieces.py).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, joins, merge
from ..sources import files as sources
from ..sources import php, specs
from ..sources.xml import xml_errors, xml_nodes

ORDER = ("layer", "load_order", "path", "seq")
OVERLAID = tuple(a for a in sources.AREAS if a != "global")


def stated(column: str):
    """An empty attribute says nothing."""
    return F.nullif(F.col(column), F.lit(""))


def flag(column: str):
    return F.when(F.lower(column).isin("true", "1"), True).when(F.lower(column).isin("false", "0"), False)


class Installation:
    def __init__(self, files: DataFrame, buffers: DataFrame | None = None):
        self.files = sources.overlaid(files, buffers) if buffers is not None else files
        self.spark = files.sparkSession

    # silver

    @cached_property
    def modules(self) -> DataFrame:
        return sources.modules(self.files).cache()

    @cached_property
    def nodes(self) -> DataFrame:
        return xml_nodes(sources.located(self.files, self.modules)).cache()

    @cached_property
    def classes(self) -> DataFrame:
        return sources.classes(self.files).cache()

    def declared(self, kind: str) -> DataFrame:
        return specs.declarations(self.nodes, kind)

    def diagnostics(self) -> DataFrame:
        twice = self.modules.filter("places > 1").select(F.col("root").alias("path"), F.lit("warn").alias("severity"), F.concat(F.lit("module found twice: "), "name").alias("message"))
        same = self.declared("plugins").groupBy("path", "target", "name").count().filter("count > 1")
        plugins = same.select("path", F.lit("warn").alias("severity"), F.concat(F.lit("plugin declared twice: "), "name").alias("message"))
        return xml_errors(sources.located(self.files, self.modules)).unionByName(twice).unionByName(plugins)

    # areas

    def per_area(self, declared: DataFrame, inherit: bool = True) -> DataFrame:
        """Declarations as each area sees them: the global ones and its own. Without inheritance, its own alone."""
        if not inherit:
            return declared
        areas = self.spark.createDataFrame([(a,) for a in sources.AREAS], "__area string")
        spread = declared.filter("area = 'global'").crossJoin(F.broadcast(areas))
        own = declared.filter("area <> 'global'").withColumn("__area", F.col("area"))
        seen = spread.unionByName(own)
        return seen.withColumn("area", F.col("__area")).drop("__area")

    def merged(self, kind: str, keys: list[str], attrs: dict | None = None, inherit: bool = True) -> DataFrame:
        """Attributes by their last stated value; ``source`` is the last declaration's module and line."""
        declared = self.declared(kind).withColumn("source", F.struct("module", "path", "line"))
        names = [c for c in specs.SPECS[kind].columns if c not in keys]
        attrs = attrs or {c: stated(c) for c in names}
        return merge.merge_attr(self.per_area(declared, inherit), ["area", *keys], attrs, ORDER, source="source")

    # dependency injection

    @cached_property
    def preferences(self) -> DataFrame:
        declared = self.declared("preferences").select(F.ltrim("for", F.lit("\\")).alias("for"), F.ltrim("type", F.lit("\\")).alias("type"), "module", "area", "path", "line", "seq", "layer", "load_order")
        return merge.merge_last(self.per_area(declared), ["area", "for"], ORDER)

    @cached_property
    def plugins(self) -> DataFrame:
        """A later declaration overrides only what it states; the order is that of the first, the source the last's."""
        declared = self.declared("plugins").withColumn("target", F.ltrim("target", F.lit("\\"))).withColumn("class", F.ltrim("class", F.lit("\\")))
        declared = declared.withColumn("source", F.struct("module", "path", "line"))
        attrs = {"class": stated("class"), "sort_order": F.expr("try_cast(sort_order AS int)"), "disabled": flag("disabled")}
        return merge.merge_attr(self.per_area(declared), ["area", "target", "name"], attrs, (*ORDER, "line"), source="source")

    @cached_property
    def virtual_types(self) -> DataFrame:
        declared = self.declared("virtual_types").withColumn("name", F.ltrim("name", F.lit("\\"))).withColumn("type", F.ltrim("type", F.lit("\\")))
        return merge.merge_attr(self.per_area(declared), ["area", "name"], {"type": stated("type"), "shared": flag("shared")}, ORDER)

    @cached_property
    def arguments(self) -> DataFrame:
        """Within a layer, items merge; a higher layer that declares the argument replaces it."""
        nodes = specs.argument_nodes(self.nodes).withColumn("owner", F.ltrim("owner", F.lit("\\")))
        return merge.deep_merge(self.per_area(nodes).withColumnRenamed("source_path", "file"), ["area", "owner", "argument"], "layer", ("load_order", "file", "seq"))

    @cached_property
    def hierarchy(self) -> DataFrame:
        """(root, node, depth): a class and what it extends or implements, in any number of steps; itself at 0."""
        edges = self.classes.select(F.col("class").alias("src"), F.explode("parents").alias("dst"))
        own = self.classes.select(F.col("class").alias("root"), F.col("class").alias("node"), F.lit(0).alias("depth"))
        return own.unionByName(graph.closure(edges)).cache()

    def preference_of(self, area: str) -> DataFrame:
        """node, target, steps: what a type ends at in an area."""
        return graph.chase(self.preferences.filter(F.col("area") == area).select(F.col("for").alias("src"), F.col("type").alias("dst")))

    def plugins_on(self, area: str) -> DataFrame:
        """class, name, plugin, sort_order, ...: for each class or virtual type, in running order.

        Of a name, the declaration of the nearest type counts, even if it
        states no plugin class and so yields none.
        """
        virtual = graph.chase(self.virtual_types.filter((F.col("area") == area) & F.col("type").isNotNull()).select(F.col("name").alias("src"), F.col("type").alias("dst")))
        bases = virtual.select(F.col("node").alias("root"), F.col("target").alias("base"))
        inherited = bases.join(self.hierarchy.withColumnRenamed("root", "base"), "base").select("root", "node", (F.col("depth") + 1).alias("depth"))
        itself = bases.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
        external = self.plugins.filter(F.col("area") == area).select(F.col("target").alias("root"), F.col("target").alias("node"), F.lit(0).alias("depth"))
        reached = self.hierarchy.select("root", "node", "depth").unionByName(inherited).unionByName(itself).unionByName(external).distinct()
        found = reached.join(self.plugins.filter(F.col("area") == area), F.col("node") == F.col("target"))
        nearest = graph.nearest_by_name(found, "name", ["target"])
        running = nearest.filter(F.col("class").isNotNull() & ~F.coalesce("disabled", F.lit(False)))
        place = F.struct(F.coalesce("sort_order", F.lit(0)), *(F.col(f"first_{o}") for o in ("layer", "load_order", "line", "seq")))
        return running.select(F.col("root").alias("class"), "name", F.col("class").alias("plugin"), F.col("target").alias("declared_on"), "sort_order", place.alias("place"), "source").orderBy("class", "place", "name")

    def chains(self, area: str) -> DataFrame:
        """class, method, steps: befores in order, then arounds, then afters."""
        steps = self.plugins_on(area).join(self.classes.select(F.col("class").alias("plugin"), F.explode("steps").alias("s")), "plugin")
        rank = F.when(F.col("s.step") == "before", 0).when(F.col("s.step") == "around", 1).otherwise(2)
        ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "place", "name", F.col("s.step").alias("step"), "plugin")))
        return steps.groupBy("class", F.col("s.method").alias("method")).agg(F.transform(ordered, lambda x: F.struct(x["step"], x["name"], x["plugin"])).alias("steps"))

    def uses(self, name: str) -> DataFrame:
        """Where a class is named: how, by what, in which area and file."""
        kinds = (("preference for", "preferences", "for", "type"), ("preference", "preferences", "type", "for"), ("plugin", "plugins", "class", "target"), ("plugin on", "plugins", "target", "class"), ("virtual type of", "virtual_types", "type", "name"))
        found = None
        for how, kind, column, by in kinds:
            rows = self.declared(kind).filter(F.ltrim(column, F.lit("\\")) == name).select(F.lit(how).alias("how"), F.col(by).alias("by"), "area", "path", "line")
            found = rows if found is None else found.unionByName(rows)
        given = specs.argument_nodes(self.nodes).filter((F.col("kind") == "object") & (F.ltrim("value", F.lit("\\")) == name))
        return found.unionByName(given.select(F.lit("argument").alias("how"), F.col("owner").alias("by"), "area", F.col("source_path").alias("path"), "line"))

    def resolve(self, area: str) -> DataFrame:
        """class, target, plugins: what each known type ends at and the plugins that run on that."""
        names = self.classes.select("class").unionByName(self.preferences.filter(F.col("area") == area).select(F.col("for").alias("class"))).distinct()
        ends = names.join(self.preference_of(area).select(F.col("node").alias("class"), "target"), "class", "left").select("class", F.coalesce("target", "class").alias("target"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
        running = self.plugins_on(area).groupBy(F.col("class").alias("target")).agg(listed.alias("plugins"))
        return ends.join(running, "target", "left").select("class", "target", F.coalesce("plugins", F.array().cast("array<string>")).alias("plugins"))

    def resolve_all(self) -> DataFrame:
        """area, class, target, plugins, of the areas whose resolution differs from the global one."""
        base = self.resolve("global")
        out = None
        for area in OVERLAID:
            rows = merge.area_deltas(self.resolve(area).withColumn("area", F.lit(area)), base, ["class"], ["target", "plugins"])
            out = rows if out is None else out.unionByName(rows)
        return out.select("area", "class", "target", "plugins")

    # entry points and configuration

    @cached_property
    def observers(self) -> DataFrame:
        declared = self.declared("observers")
        own = self.per_area(declared).withColumn("source", F.struct("module", "path", "line"))
        attrs = {"disabled": flag("disabled"), "shared": flag("shared"), "instance": F.struct("instance")}  # replaced even by none
        return merge.merge_attr(own, ["area", "event", "name"], attrs, ORDER, source="source").withColumn("instance", F.col("instance.instance"))

    @cached_property
    def routes(self) -> DataFrame:
        """Per area, without the global ones; modules in order of their first mention."""
        front = self.merged("routes", ["router", "id"], inherit=False).select("area", "router", "id", "front_name")
        listed = merge.ordered_union(self.declared("route_modules"), ["area", "router", "id"], "name", ORDER).withColumnRenamed("items", "modules")
        return front.join(listed, ["area", "router", "id"], "left").filter(F.col("area").isin("frontend", "adminhtml", "webapi_rest", "webapi_soap", "graphql"))

    @cached_property
    def cron_jobs(self) -> DataFrame:
        jobs = merge.merge_last(self.declared("cron_jobs"), ["group", "name"], ORDER)
        times = merge.merge_last(self.declared("cron_schedules"), ["group", "name"], ORDER).select("group", "name", "schedule")
        return jobs.join(times, ["group", "name"], "left")

    @cached_property
    def webapi(self) -> DataFrame:
        routes = merge.merge_last(self.declared("webapi"), ["method", "url"], ORDER).select("url", F.col("method").alias("http_method"), "module", "path", "line")
        services = merge.merge_last(self.declared("webapi_services"), ["http_method", "url"], ORDER).select("url", "http_method", "class", "method")
        refs = merge.ordered_union(self.declared("webapi_resources"), ["http_method", "url"], "ref", ORDER).withColumnRenamed("items", "resources")
        return routes.join(services, ["url", "http_method"], "left").join(refs, ["url", "http_method"], "left")

    @cached_property
    def tables(self) -> DataFrame:
        """A disabled declaration deletes what there was; a later one makes the table anew."""
        declared = self.declared("tables").withColumn("gone", F.coalesce(flag("disabled"), F.lit(False)))
        live = merge.tombstones(declared, ["name"], F.col("gone"), ORDER)
        return merge.merge_attr(live, ["name"], {c: stated(c) for c in ("resource", "engine", "comment")}, ORDER)

    def parts_of_tables(self, kind: str, name: str) -> DataFrame:
        """Columns, constraints or indexes: replaced as a whole, deleted by themselves or with their table."""
        gone = self.declared("tables").filter(flag("disabled")).groupBy(F.col("name").alias("table")).agg(F.max(F.struct(*ORDER)).alias("__gone"))
        live = self.declared(kind).join(gone, "table", "left").filter(F.col("__gone").isNull() | (F.struct(*ORDER) > F.col("__gone"))).drop("__gone")
        live = live.withColumn("gone", F.coalesce(flag("disabled"), F.lit(False)))
        kept = merge.tombstones(live, ["table", name], F.col("gone"), ORDER)
        return merge.merge_last(kept, ["table", name], ORDER).drop("gone", "disabled").join(self.tables.select(F.col("name").alias("table")), "table", "left_semi")

    @cached_property
    def acl(self) -> DataFrame:
        """Resources as a tree in pre-order; a resource that was disabled once stays so."""
        declared = self.declared("acl")
        merged = merge.merge_attr(declared, ["id"], {c: stated(c) for c in ("title", "sort_order", "parent")}, ORDER)
        off = declared.groupBy("id").agg(F.coalesce(F.bool_or(flag("disabled")), F.lit(False)).alias("disabled"))
        label = F.struct(F.coalesce(F.expr("try_cast(sort_order AS int)"), F.lit(0)).alias("sort"), F.col("id").alias("id"))
        return graph.with_paths(merged.join(off, "id"), "id", "parent", label)

    @cached_property
    def menu(self) -> DataFrame:
        """Added and updated items, less the removed; children of a removed item become roots."""
        changed = self.declared("menu_add").unionByName(self.declared("menu_update")).withColumn("gone", F.lit(False))
        removed = self.declared("menu_remove").withColumn("gone", F.lit(True))
        live = merge.tombstones(changed.unionByName(removed, allowMissingColumns=True), ["id"], F.col("gone"), ORDER).filter("NOT gone")
        merged = merge.merge_attr(live, ["id"], {c: stated(c) for c in ("title", "parent", "action", "resource", "sort_order")}, ORDER)
        label = F.struct(F.coalesce(F.expr("try_cast(sort_order AS int)"), F.lit(0)).alias("sort"), F.col("id").alias("id"))
        return graph.with_paths(merged, "id", "parent", label)

    def config_values(self, stored: DataFrame | None = None, environment: dict[str, str] | None = None) -> DataFrame:
        """scope, path, value, source: module defaults, then the database, config.php, env.php and variables.

        stored: (scope, path, value), scopes like default or stores/en. Variables
        are named CONFIG__<SCOPE>__<PATH>, two underscores for a slash.
        """
        nodes = self.nodes.filter("file = 'config.xml' AND size(trail) >= 1")
        chain = F.concat(F.transform("trail", lambda t: t["tag"]), F.array("tag"))
        scope_parts = F.when(F.element_at(chain, 2) == "default", 1).otherwise(2)
        leaf = nodes.filter("text <> ''").select(F.slice(chain, 2, F.size(chain)).alias("chain"), F.lit(0).alias("rank"), *ORDER, F.col("text").alias("value"), scope_parts.alias("n"), F.concat(F.lit("module "), "module").alias("source"))
        own = leaf.filter(F.size("chain") > F.col("n")).select(F.expr("array_join(slice(chain, 1, n), '/')").alias("scope"), F.expr("array_join(slice(chain, n + 1, size(chain)), '/')").alias("path"), "value", "rank", F.struct(*ORDER).alias("at"), "source")
        empty = F.struct(*(F.lit(x).alias(o) for o, x in zip(ORDER, (9, 0, "", F.lit(0).cast("long")))))
        layers = [own]
        if stored is not None:
            layers.append(stored.select("scope", "path", "value", F.lit(1).alias("rank"), empty.alias("at"), F.lit("database").alias("source")))
        for rank, name in ((2, "config.php"), (3, "env.php")):
            found = self.files.filter(F.col("path") == f"app/etc/{name}").select(F.explode(php.array_leaves("content")).alias("leaf")).filter(F.col("leaf.path")[0] == "system")
            n = F.when(F.col("leaf.path")[1] == "default", 1).otherwise(2)
            split = found.select("leaf.path", "leaf.value", n.alias("n"))
            layers.append(split.select(F.expr("array_join(slice(path, 2, n), '/')").alias("scope"), F.expr("array_join(slice(path, n + 2, size(path)), '/')").alias("path"), "value", F.lit(rank).alias("rank"), empty.alias("at"), F.lit(name).alias("source")))
        rows = []
        for name, value in (environment or {}).items():
            head, *parts = name.split("__")
            if head == "CONFIG" and parts:
                n = 1 if parts[0] == "DEFAULT" else 2
                rows.append(("/".join(parts[:n]).lower(), "/".join(parts[n:]).lower(), value))
        if rows:
            given = self.spark.createDataFrame(rows, "scope string, path string, value string")
            layers.append(given.select("scope", "path", "value", F.lit(4).alias("rank"), empty.alias("at"), F.lit("environment").alias("source")))
        union = layers[0]
        for more in layers[1:]:
            union = union.unionByName(more)
        return merge.merge_last(union, ["scope", "path"], ("rank", "at")).select("scope", "path", "value", "source")

    def config_in(self, values: DataFrame, scope: str, websites: dict[str, str]) -> DataFrame:
        """path, value as a scope sees them: its own, its website's, the default. websites: store -> website."""
        kind, _, code = scope.partition("/")
        order = [scope] + ([f"websites/{websites[code]}"] if kind == "stores" and code in websites else []) + ["default"]
        ranks = self.spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(order))], "scope string, rank int")
        return values.join(F.broadcast(ranks), "scope").groupBy("path").agg(F.min_by(F.struct("value", "scope", "source"), "rank").alias("v")).select("path", "v.*")

    def queue_routes(self) -> DataFrame:
        """topic, queue, via, consumer: by the publisher's own queue or by a binding whose pattern fits."""
        topics = self.merged("topics", ["name"]).filter("area = 'global'").select(F.col("name").alias("topic"))
        direct = self.merged("publishers", ["topic"]).filter("area = 'global' AND queue IS NOT NULL").select("topic", "queue", F.lit("publisher").alias("via"))
        bound = self.merged("bindings", ["exchange", "id"], {c: stated(c) for c in ("topic", "destination", "disabled")}).filter("area = 'global' AND topic IS NOT NULL AND coalesce(disabled, 'false') <> 'true'")
        wild = F.col("topic").rlike(r"[*#]")
        same = topics.join(bound.filter(~wild).select("topic", F.col("destination").alias("queue")), "topic").select("topic", "queue", F.lit("binding").alias("via"))
        patterns = [r[0] for r in bound.filter(wild).select("topic").distinct().collect()]  # as many as bindings with wildcards are declared
        met = joins.pattern_join(topics, "topic", patterns) if patterns else topics.withColumn("pattern", F.lit(None).cast("string")).limit(0)
        fits = met.join(bound.filter(wild).select(F.col("topic").alias("pattern"), F.col("destination").alias("queue")), "pattern").select("topic", "queue", F.lit("binding").alias("via"))
        by_pattern = same.unionByName(fits)
        consumers = self.merged("consumers", ["name"]).filter("area = 'global'").select("queue", F.col("name").alias("consumer"))
        return topics.join(direct.unionByName(by_pattern), "topic", "left").join(consumers, "queue", "left").select("topic", "queue", "via", "consumer").distinct()
