"""The other merged catalogues of an installation, and the questions to them.

``Catalogues`` is an Installation with all of them; each is built when it is
first asked for. Lists answer in the order of their names.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, merge
from ..sources import files as sources
from ..sources import php, pieces, specs, texts
from .installation import ORDER, OVERLAID, Installation, flag, stated

#: Fixed by the framework: where commands are registered.
COMMAND_LIST = "Magento\\Framework\\Console\\CommandListInterface"


def has(columns: list[str], needle: str | None) -> Column:
    """Whether one of the columns holds the needle, whatever its case; all rows without a needle."""
    if not needle:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.coalesce(scalars.icontains(F.col(c), needle), F.lit(False)) for c in columns))


def plain(column: str) -> Column:
    return F.ltrim(column, F.lit("\\"))


class Catalogues(Installation):
    # wiring

    @cached_property
    def custom_areas(self) -> DataFrame:
        """area: folders of etc/ that declare wiring and aren't known areas."""
        return self.nodes.filter((F.col("file") == "di.xml") & ~F.col("area").isin(*sources.AREAS)).select("area").distinct()

    def in_custom_area(self, kind: str, area: str) -> DataFrame:
        """Declarations as a custom area sees them: the global ones and its own."""
        return self.declared(kind).filter(F.col("area").isin("global", area)).withColumn("area", F.lit(area))

    def export(self, area: str, overlay: bool = False) -> dict[str, DataFrame]:
        """Preferences, plugins, virtual types and arguments of an area, known or not; with overlay, what it declares itself."""

        def seen(kind: str) -> DataFrame:
            rows = self.declared(kind)
            return rows.filter(F.col("area") == area) if overlay else rows.filter(F.col("area").isin("global", area)).withColumn("area", F.lit(area))

        preferences = merge.merge_last(seen("preferences").select(plain("for").alias("for"), plain("type").alias("type"), "area", *ORDER), ["for"], ORDER)
        plugins = seen("plugins").withColumn("target", plain("target")).withColumn("class", plain("class"))
        attrs = {"class": stated("class"), "sort_order": F.expr("try_cast(sort_order AS int)"), "disabled": flag("disabled")}
        virtual = seen("virtual_types").withColumn("name", plain("name")).withColumn("type", plain("type"))
        nodes = specs.argument_nodes(self.nodes).withColumn("owner", plain("owner"))
        nodes = nodes.filter(F.col("area") == area) if overlay else nodes.filter(F.col("area").isin("global", area))
        return {
            "preferences": preferences.select("for", "type").orderBy("for"),
            "plugins": merge.merge_attr(plugins, ["target", "name"], attrs, (*ORDER, "line")).orderBy("target", "name"),
            "virtual_types": merge.merge_attr(virtual, ["name"], {"type": stated("type"), "shared": flag("shared")}, ORDER).orderBy("name"),
            "arguments": merge.deep_merge(nodes.withColumnRenamed("source_path", "file"), ["owner", "argument"], "layer", ("load_order", "file", "seq")).orderBy("owner", "argument", "path"),
        }

    def summary(self, area: str) -> DataFrame:
        """One row: how much of each kind of wiring an area has, and targets with an enabled plugin."""
        found = self.export(area)
        enabled = found["plugins"].filter("class IS NOT NULL AND NOT coalesce(disabled, false)")
        parts = [
            found["preferences"].agg(F.count(F.lit(1)).alias("preferences")), found["virtual_types"].agg(F.count(F.lit(1)).alias("virtual_types")),
            found["plugins"].agg(F.count(F.lit(1)).alias("plugins")), enabled.agg(F.countDistinct("target").alias("targets")),
            found["arguments"].agg(F.countDistinct("owner").alias("configured_types")),
        ]
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each

    def plugins_everywhere(self) -> DataFrame:
        """class, name, plugin, areas: the plugins of all areas, each name by its lowest area, with the areas that declare it."""
        rank = F.create_map(*(F.lit(x) for i, a in enumerate(sources.AREAS) for x in (a, i)))
        every = reduce(DataFrame.unionByName, (self.plugins_on(a).withColumn("area", F.lit(a)) for a in sources.AREAS))
        ranked = every.withColumn("rank", F.try_element_at(rank, F.col("area")))
        row = F.min_by(F.struct("plugin", "declared_on", "sort_order", "place", "source"), F.struct("rank")).alias("r")
        areas = F.array_sort(F.collect_set("area")).alias("areas")
        return ranked.groupBy("class", "name").agg(row, areas).select("class", "name", "r.*", "areas").orderBy("class", "place", "name")

    def chains_everywhere(self) -> DataFrame:
        """As ``chains``, of the plugins of all areas."""
        steps = self.plugins_everywhere().join(self.classes.select(F.col("class").alias("plugin"), F.explode("steps").alias("s")), "plugin")
        rank = F.when(F.col("s.step") == "before", 0).when(F.col("s.step") == "around", 1).otherwise(2)
        ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "place", "name", F.col("s.step").alias("step"), "plugin")))
        return steps.groupBy("class", F.col("s.method").alias("method")).agg(F.transform(ordered, lambda x: F.struct(x["step"], x["name"], x["plugin"])).alias("steps"))

    def targets_of(self, name: str) -> DataFrame:
        """target, name, disabled, area: what a class intercepts; each (target, name) by the first area that has it."""
        rank = F.create_map(*(F.lit(x) for i, a in enumerate(sources.AREAS) for x in (a, i)))
        rows = self.plugins.filter(F.col("class") == name).withColumn("rank", F.try_element_at(rank, F.col("area")))
        first = F.min_by(F.struct("disabled", "area", "source"), "rank").alias("r")
        return rows.groupBy("target", "name").agg(first).select("target", "name", F.coalesce("r.disabled", F.lit(False)).alias("disabled"), "r.area", "r.source").orderBy("target", "name")

    def inherited_arguments(self, area: str) -> DataFrame:
        """class, argument, path, kind, value, declared_on: the arguments of classes and virtual types with those they inherit.

        A type inherits from its virtual base and that one's class, and a class from what it extends or
        implements. The nearest that declares an argument counts, whole.
        """
        bases = self.virtual_types.filter((F.col("area") == area) & F.col("type").isNotNull()).select(F.col("name").alias("src"), F.col("type").alias("dst"))
        edges = bases.unionByName(self.classes.select(F.col("class").alias("src"), F.explode("parents").alias("dst")))
        names = edges.select("src").union(edges.select("dst")).union(self.arguments.select("owner")).distinct().select(F.col("src").alias("root"))
        reached = names.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).unionByName(graph.closure(edges))
        own = self.arguments.filter(F.col("area") == area).select("owner", "argument", "path", "kind", "value")
        nearest = reached.join(own.select(F.col("owner").alias("node"), "argument").distinct(), "node").groupBy("root", "argument").agg(F.min(F.struct("depth", "node")).alias("n"))
        nearest = nearest.select(F.col("root").alias("class"), "argument", F.col("n.node").alias("owner"))
        return nearest.join(own, ["owner", "argument"]).select("class", "argument", "path", "kind", "value", F.col("owner").alias("declared_on"))

    def console_commands(self, needle: str | None = None) -> DataFrame:
        """key, class, name, description: the items of the command list, by their names; unnamed ones come last."""
        ends = self.preference_of("global").filter(F.col("node") == COMMAND_LIST).select("target")
        owners = ends.unionByName(self.spark.createDataFrame([(COMMAND_LIST,)], "target string")).select(F.col("target").alias("owner")).distinct()
        items = self.arguments.filter("area = 'global' AND argument = 'commands' AND size(path) = 2 AND kind = 'object'").join(owners, "owner", "left_semi")
        info = self.files.filter(F.col("path").endswith(".php") & F.contains("content", F.lit("setName")) | F.contains("content", F.lit("defaultName"))).select(php.command_of("content").alias("c")).filter("c IS NOT NULL")
        named = info.select(F.col("c.class").alias("class"), "c.name", "c.description").dropDuplicates(["class"])
        found = items.select(F.col("path")[1].alias("key"), plain("value").alias("class")).join(named, "class", "left")
        return found.filter(has(["name", "class", "key"], needle)).orderBy(F.col("name").asc_nulls_last(), "class")

    # entry points

    def events(self, area: str) -> DataFrame:
        """event, observers: how many observe each."""
        return self.observers.filter(F.col("area") == area).groupBy("event").agg(F.count(F.lit(1)).alias("observers")).orderBy("event")

    def actions(self, area: str, needle: str | None = None) -> DataFrame:
        """url, class: the controller classes under the modules of an area's routes, each class once, by its least url.

        In the administration the folder is Controller/Adminhtml. Abstract classes are no actions.
        """
        routes = self.routes.filter(F.col("area") == area).select("front_name", F.explode("modules").alias("module")).filter("front_name IS NOT NULL")
        below = "Controller\\Adminhtml\\" if area == "adminhtml" else "Controller\\"
        classes = self.classes.filter("kind = 'class' AND NOT abstract").select("class", F.locate("\\Controller\\", "class").alias("at")).filter("at > 0")
        owned = classes.select("class", F.replace(F.expr("substring(class, 1, at - 1)"), F.lit("\\"), F.lit("_")).alias("module"), F.expr("substring(class, at + 1)").alias("rest"))
        own = owned.filter(F.startswith("rest", F.lit(below)) & (F.lit(area == "adminhtml") | ~F.startswith("rest", F.lit("Controller\\Adminhtml\\"))))
        parts = F.split(F.expr(f"substring(rest, {len(below) + 1})"), r"\\")
        folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")
        url = F.concat_ws("/", "front_name", F.lower(F.when(folder == "", "index").otherwise(folder)), F.lower(F.element_at(parts, -1)))
        found = own.join(routes, "module").groupBy("class").agg(F.min(url).alias("url"))
        return found.filter(has(["url"], needle)).select("url", "class").orderBy("url", "class")

    # catalogues of declarations

    @cached_property
    def indexers(self) -> DataFrame:
        """id, view_id, class, title, dependencies, subscriptions (table:column of the view, by table)."""
        merged = self.merged("indexers", ["id"]).filter("area = 'global'").select("id", "view_id", "class", "source")
        titles = merge.merge_attr(self.declared("indexer_titles"), ["id"], {"title": stated("value")}, ORDER).select("id", "title")
        needs = merge.ordered_union(self.declared("indexer_dependencies"), ["id"], "on", ORDER).withColumnRenamed("items", "dependencies")
        tables = merge.merge_last(self.declared("mview_tables"), ["id", "table"], ORDER)
        subscribed = tables.groupBy(F.col("id").alias("view_id")).agg(F.array_sort(F.collect_list(F.concat_ws(":", "table", "entity_column"))).alias("subscriptions"))
        joined = merged.join(titles, "id", "left").join(needs, "id", "left").join(subscribed, "view_id", "left")
        empty = F.array().cast("array<string>")
        return joined.select("id", "view_id", "class", "title", F.coalesce("dependencies", empty).alias("dependencies"), F.coalesce("subscriptions", empty).alias("subscriptions"), "source").orderBy("id")

    @cached_property
    def extension_attributes(self) -> DataFrame:
        """for, code, type, resources, reference_table, reference_field, join_on_field, fields: the last declaration of each, whole."""
        key = ["for", "code"]
        last = merge.merge_last(self.declared("extension_attributes").withColumn("for", plain("for")), key, ORDER)
        place = [*key, *ORDER]

        def below(kind: str, value: str, name: str) -> DataFrame:
            """What the last declaration holds: children lie between its place and the next attribute's, so by path and line they're its own."""
            rows = self.declared(kind).withColumn("for", plain("for")).join(last.select(*key, "path", F.col("seq").alias("__from")), [*key, "path"])
            nexts = self.declared("extension_attributes").select("path", F.col("seq").alias("__next"))
            bounds = last.select("path", F.col("seq").alias("__from")).join(nexts, "path").filter("__next > __from").groupBy("path", "__from").agg(F.min("__next").alias("__to"))
            rows = rows.join(bounds, ["path", "__from"], "left").filter("seq > __from AND (__to IS NULL OR seq < __to)")
            return rows.groupBy(*key).agg(F.array_sort(F.collect_set(value)).alias(name))

        joins = merge.merge_last(self.declared("extension_joins").withColumn("for", plain("for")), key, ORDER).select(*key, "reference_table", "reference_field", "join_on_field")
        found = last.select(*place, "type", "module", "line").join(below("extension_resources", "ref", "resources"), key, "left").join(joins, key, "left").join(below("extension_fields", "field", "fields"), key, "left")
        return found.select(*key, "type", "resources", "reference_table", "reference_field", "join_on_field", "fields", "module", "path", "line").orderBy(*key)

    @cached_property
    def graphql(self) -> DataFrame:
        """name, kind, interfaces, members, fields: types of all modules' schemas; a field's last definition stands at its first place."""
        enabled = self.modules.filter("state = 'enabled'").select(F.col("name").alias("module"), "root", "load_order")
        own = self.files.filter(F.col("path").endswith("/etc/schema.graphqls")).withColumn("root", sources.root_of(F.col("path"))).join(enabled, "root")
        types = texts.schemas(own.select("path", "content", "module", "load_order"))
        at = ["load_order", "path", "line"]
        first = merge.merge_first(types.select("name", "kind", *at), ["name"], at).select("name", "kind")

        def union_of(column: str) -> DataFrame:
            rows = types.select("name", *at, F.posexplode(column).alias("seq", "item"))
            return merge.ordered_union(rows, ["name"], "item", [*at, "seq"]).withColumnRenamed("items", column)

        fields = types.select(F.col("name").alias("of"), *at, F.posexplode("fields").alias("seq", "f"))
        each = fields.groupBy("of", F.col("f.name").alias("field")).agg(F.max_by("f", F.struct(*at, "seq")).alias("f"), F.min(F.struct(*at, "seq")).alias("at"))
        listed = each.groupBy(F.col("of").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "f"))), lambda x: x["f"]).alias("fields"))
        return first.join(union_of("interfaces"), "name", "left").join(union_of("members"), "name", "left").join(listed, "name", "left").orderBy("name")

    @cached_property
    def system_fields(self) -> DataFrame:
        """path, label, type, tab, section, group, scopes: attributes by their last non-empty value on each level."""
        section, group, field = ["section"], ["section", "group"], ["section", "group", "id"]

        def said(kind: str, keys: list[str], name: str, value: str = "value") -> DataFrame:
            return merge.merge_attr(self.declared(kind), keys, {value: stated(value)}, ORDER).select(*keys, F.col(value).alias(name))

        fields = merge.merge_attr(self.declared("system_fields"), field, {a: stated(a) for a in ("type", "in_default", "in_website", "in_store")}, ORDER)
        joined = fields
        for kind, keys, name in (
            ("system_field_labels", field, "label"), ("system_config_paths", field, "config_path"), ("system_source_models", field, "source_model"), ("system_backend_models", field, "backend_model"),
            ("system_group_labels", group, "group_label"), ("system_section_labels", section, "section_label"), ("system_section_tabs", section, "tab_id"),
        ):
            joined = joined.join(said(kind, keys, name), keys, "left")
        joined = joined.join(said("system_tab_labels", ["tab_id"], "tab"), "tab_id", "left")
        shown = lambda c, n: F.when(F.col(c).isin("1", "true"), F.lit(n))
        scopes = F.array_compact(F.array(shown("in_default", "default"), shown("in_website", "website"), shown("in_store", "store")))
        path = F.coalesce("config_path", F.concat_ws("/", "section", "group", "id"))
        return joined.select(path.alias("path"), "label", "type", "tab", F.col("section_label").alias("section"), F.col("group_label").alias("group"), scopes.alias("scopes"), "source_model", "backend_model").orderBy("path")

    @cached_property
    def fieldsets(self) -> DataFrame:
        """scope, fieldset, field, module (of the first declaration), aspects (name=target, the last of each)."""
        key = ["scope", "fieldset", "field"]
        first = merge.merge_first(self.declared("fieldsets"), key, ORDER).select(*key, "module")
        last = merge.merge_last(self.declared("fieldset_aspects"), [*key, "aspect"], ORDER)
        listed = last.groupBy(*key).agg(F.array_sort(F.collect_list(F.concat_ws("=", "aspect", F.coalesce(stated("target"), F.lit("*"))))).alias("aspects"))
        return first.join(listed, key, "left").withColumn("aspects", F.coalesce("aspects", F.array().cast("array<string>"))).orderBy(*key)

    def fieldset(self, name: str) -> DataFrame:
        """The fieldset of that name in its first scope."""
        rows = self.fieldsets.filter(F.col("fieldset") == name)
        return rows.join(F.broadcast(rows.agg(F.min("scope").alias("scope"))), "scope")  # one row

    def fieldset_fields(self, name: str) -> DataFrame:
        """Fields of that name, or, if there's none, those that hold it."""
        rank = F.when(F.col("field") == name, 0).when(scalars.icontains(F.col("field"), name), 1)
        found = self.fieldsets.withColumn("__rank", rank).filter("__rank IS NOT NULL")
        return found.join(F.broadcast(found.agg(F.min("__rank").alias("__rank"))), "__rank").drop("__rank")  # one row

    @cached_property
    def catalog_attributes(self) -> DataFrame:
        """group, attributes in order of their first mention."""
        return merge.ordered_union(self.declared("catalog_attributes"), ["group"], "name", ORDER).withColumnRenamed("items", "attributes").orderBy("group")

    @cached_property
    def email_templates(self) -> DataFrame:
        """id, label, file, type, of, for_area (last declaration, whole) and overrides, the themes' files in their order."""
        last = merge.merge_last(self.declared("email_templates"), ["id"], ORDER)
        pattern = r"^app/design/([^/]+)/([^/]+/[^/]+)/([A-Z][A-Za-z0-9]*_[A-Za-z0-9]+)/email/(.+)$"
        over = self.files.filter(F.col("path").rlike(pattern)).select(F.col("path").alias("__path"), *(F.regexp_extract("path", pattern, k).alias(n) for k, n in ((1, "for_area"), (3, "of"), (4, "file"))))
        found = over.groupBy("for_area", "of", "file").agg(F.array_sort(F.collect_list("__path")).alias("overrides"))
        joined = last.select("id", "label", "file", "type", "of", "for_area", "module", "path", "line").join(found, ["for_area", "of", "file"], "left")
        return joined.withColumn("overrides", F.coalesce("overrides", F.array().cast("array<string>"))).orderBy("id")

    @cached_property
    def widgets(self) -> DataFrame:
        """id, class, label, description, parameters (name:type, in order)."""
        merged = merge.merge_attr(self.declared("widgets").withColumn("class", plain("class")), ["id"], {"class": stated("class")}, ORDER, source="module")
        said = [merge.merge_attr(self.declared(f"widget_{n}s"), ["id"], {n: stated("value")}, ORDER).select("id", n) for n in ("label", "description")]
        last = merge.merge_attr(self.declared("widget_parameters"), ["widget", "name"], {a: stated(a) for a in ("type", "required", "sort_order")}, ORDER)
        at = F.struct(F.coalesce(F.expr("try_cast(sort_order AS int)"), F.lit(0)).alias("sort"), *(F.col(f"first_{o}").alias(o) for o in ORDER), F.concat_ws(":", "name", "type").alias("text"))
        listed = last.groupBy(F.col("widget").alias("id")).agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["text"]).alias("parameters"))
        return merged.select("id", "class", "module").join(said[0], "id", "left").join(said[1], "id", "left").join(listed, "id", "left").orderBy("id")

    # message queue

    @cached_property
    def topology(self) -> dict[str, DataFrame]:
        """Topics, handlers, consumers, exchanges and publishers; no connection is ``amqp``."""
        amqp = lambda df: df.withColumn("connection", F.coalesce(F.nullif("connection", F.lit("")), F.lit("amqp")))
        handlers = merge.merge_attr(self.declared("topic_handlers"), ["topic", "name"], {c: stated(c) for c in ("type", "method", "disabled")}, ORDER)
        return {
            "topics": merge.merge_attr(self.declared("topics"), ["name"], {c: stated(c) for c in ("request", "response", "is_synchronous")}, ORDER, source="module").orderBy("name"),
            "handlers": handlers.filter("coalesce(disabled, 'false') <> 'true'").orderBy("topic", "name"),
            "consumers": merge.merge_last(amqp(self.declared("consumers")), ["name"], ORDER).orderBy("name"),
            "exchanges": merge.merge_last(amqp(self.declared("exchanges")), ["connection", "name"], ORDER).orderBy("connection", "name"),
            "publishers": merge.merge_last(self.declared("publishers"), ["topic"], ORDER).orderBy("topic"),
        }

    # themes, language packs, texts

    @cached_property
    def themes(self) -> DataFrame:
        """theme, area, path, parent: folders with a theme.xml below app/design or vendor."""
        found = self.files.filter(F.col("path").endswith("/theme.xml"))
        parent = F.regexp_extract("content", r"<parent>\s*([^<]*?)\s*</parent>", 1)
        pattern = r"^app/design/([^/]+)/([^/]+/[^/]+)/theme\.xml$"
        registered = self.files.filter(F.col("path").endswith("/registration.php")).select(F.regexp_replace("path", r"/registration\.php$", "").alias("root"), F.regexp_extract("content", r"THEME\s*,\s*'([^/']+)/([^']+)'", 1).alias("__area"), F.regexp_extract("content", r"THEME\s*,\s*'([^/']+)/([^']+)'", 2).alias("__theme"))
        joined = found.withColumn("root", F.regexp_replace("path", r"/theme\.xml$", "")).join(registered, "root", "left")
        theme = F.coalesce(F.nullif("__theme", F.lit("")), F.nullif(F.regexp_extract("path", pattern, 2), F.lit("")))
        area = F.coalesce(F.nullif("__area", F.lit("")), F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")))
        return joined.select(theme.alias("theme"), area.alias("area"), F.col("root").alias("path"), F.nullif(F.regexp_replace(parent, "^[^/]+/(?=[^/]+/)", ""), F.lit("")).alias("parent")).filter("theme IS NOT NULL").orderBy("area", "theme")

    @cached_property
    def languages(self) -> DataFrame:
        """code, vendor, package, sort_order, uses (vendor/package), root: language packs on disk."""
        text = lambda tag: F.nullif(F.regexp_extract("content", rf"<{tag}>\s*([^<]*?)\s*</{tag}>", 1), F.lit(""))
        uses = F.transform(F.regexp_extract_all("content", F.lit(r"<use\s+([^>]*)>"), 1), lambda a: F.concat_ws("/", F.regexp_extract(a, r'vendor="([^"]*)"', 1), F.regexp_extract(a, r'package="([^"]*)"', 1)))
        found = self.files.filter(F.col("path").endswith("/language.xml"))
        return found.select(text("code").alias("code"), text("vendor").alias("vendor"), text("package").alias("package"), F.coalesce(F.expr("try_cast(regexp_extract(content, '<sort_order>\\\\s*([0-9]+)', 1) AS int)"), F.lit(0)).alias("sort_order"), uses.alias("uses"), F.regexp_replace("path", r"/language\.xml$", "").alias("root")).orderBy("vendor", "package")

    def inherited_languages(self) -> DataFrame:
        """pack, uses, level: a pack and what it uses, in any number of steps, each by the least."""
        packs = self.languages.select(F.concat_ws("/", "vendor", "package").alias("pack"), "uses")
        edges = packs.select(F.col("pack").alias("src"), F.explode("uses").alias("dst"))
        above = graph.closure(edges).filter("root <> node").select(F.col("root").alias("pack"), F.col("node").alias("uses"), F.col("depth").alias("level"))
        return packs.select("pack", F.col("pack").alias("uses"), F.lit(0).alias("level")).unionByName(above.join(packs.select(F.col("pack").alias("uses")), "uses", "left_semi").select("pack", "uses", "level"))

    def translations(self, needle: str, locale: str | None = None, stored: DataFrame | None = None) -> DataFrame:
        """locale, layer, key, value, path, line: modules first, then packs, themes and the database; later ones win."""
        pattern = r"^(.*)/i18n/([a-z]{2,3}_(?:[A-Za-z]+_)?[A-Z]{2})\.csv$"
        found = self.files.filter(F.col("path").rlike(pattern)).select("path", "content", *pieces.of(self.files), F.regexp_extract("path", pattern, 1).alias("root"), F.regexp_extract("path", pattern, 2).alias("locale"))
        enabled = self.modules.filter("state = 'enabled'").select("root", "load_order")
        layer = F.when(F.startswith("path", F.lit("app/design/")), 3).otherwise(1)
        rows = texts.translations(found.join(enabled, "root", "left").withColumn("layer", layer)).filter(F.col("load_order").isNotNull() | (F.col("layer") == 3))
        kept = rows.filter("NOT reset").select("locale", "layer", F.coalesce("load_order", F.lit(0)).alias("load_order"), "key", "value", "path", "line")
        if stored is not None:
            kept = kept.unionByName(stored.select("locale", F.lit(4).alias("layer"), F.lit(0).alias("load_order"), "key", "value", F.lit("database").alias("path"), F.lit(0).alias("line")))
        kept = kept.filter(has(["key"], needle))
        return (kept.filter(F.col("locale") == locale) if locale else kept).orderBy("locale", "layer", "load_order", "path", "line")

    # deployment configuration

    @cached_property
    def env(self) -> DataFrame:
        """path, value: the leaves of env.php, paths joined by slashes."""
        leaves = self.files.filter("path = 'app/etc/env.php'").select(F.explode(php.array_leaves("content")).alias("l"))
        return leaves.select(F.array_join("l.path", "/").alias("path"), "l.value")

    def env_section(self, *prefixes: str) -> DataFrame:
        """What env.php has at or below the prefixes."""
        hit = reduce(lambda a, b: a | b, (scalars.under(F.col("path"), p) for p in prefixes))
        return self.env.filter(hit).orderBy("path")

    def db_config(self) -> DataFrame:
        return self.env_section("db/connection", "db/table_prefix")

    def redis_config(self) -> DataFrame:
        """What names a Redis server: sessions and cache back ends."""
        return self.env_section("session/redis", "cache/frontend", "cache/page_cache").filter(F.lower("path").rlike("redis|server|port|database|backend"))

    def session_config(self) -> DataFrame:
        return self.env_section("session")

    def cache_config(self) -> DataFrame:
        return self.env_section("cache", "cache_types")

    def lock_config(self) -> DataFrame:
        return self.env_section("lock")

    def queue_config(self) -> DataFrame:
        return self.env_section("queue")

    def config_section(self, values: DataFrame, scope: str, prefix: str, websites: dict[str, str]) -> DataFrame:
        """The paths at or below a prefix as a scope sees them."""
        return self.config_in(values, scope, websites).filter(scalars.under(F.col("path"), prefix)).orderBy("path")

    def scopes_setting(self, values: DataFrame, path: str) -> DataFrame:
        return values.filter(F.col("path") == path).orderBy("scope")

    # whole installation

    def module_counts(self) -> DataFrame:
        """source, state, modules."""
        return self.modules.groupBy("source", "state").agg(F.count(F.lit(1)).alias("modules")).orderBy("source", "state")

    def info(self) -> DataFrame:
        """topic, value: what an installation is, in a few lines."""
        mode = self.env.filter("path = 'MAGE_MODE'").select(F.lit("mode").alias("topic"), "value")
        front = self.env.filter("path = 'backend/frontName'").select(F.lit("admin path").alias("topic"), "value")
        counts = self.modules.groupBy("state").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit("modules "), "state").alias("topic"), "value")
        sessions = self.env.filter("path = 'session/save'").select(F.lit("sessions").alias("topic"), "value")
        return reduce(DataFrame.unionByName, (mode, front, counts, sessions)).orderBy("topic")

    def files_containing(self, needle: str) -> DataFrame:
        return self.files.filter(F.contains("content", F.lit(needle))).select("path").distinct().orderBy("path")

    def source_text(self, path: str) -> DataFrame:
        return self.files.filter(F.col("path") == path).select("path", "content")

    def template_usages(self, reference: str) -> DataFrame:
        """path, line: where PHP code names a template, whole or without its module."""
        short = reference.partition("::")[2] or reference
        code = self.files.filter(F.col("path").endswith(".php") & (F.contains("content", F.lit(f"'{reference}'")) | F.contains("content", F.lit(f"'{short}'")) | F.contains("content", F.lit(f'"{reference}"'))))
        lines = code.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
        hit = F.contains("text", F.lit(f"'{reference}'")) | F.contains("text", F.lit(f"'{short}'")) | F.contains("text", F.lit(f'"{reference}"'))
        return lines.filter(hit).select("path", (F.col("at") + 1).alias("line")).orderBy("path", "line")

    def eav_setups(self, code: str | None = None) -> DataFrame:
        """entity, attribute, method, path, line: setup calls with literal arguments."""
        found = self.files.filter(F.col("path").endswith(".php") & F.contains("content", F.lit("Attribute("))).select("path", F.inline(php.setup_calls("content")))
        return (found.filter(F.col("attribute") == code) if code else found).select("entity", "attribute", "method", "path", "line").orderBy("attribute", "path", "line")

    def whitelist(self) -> DataFrame:
        """table, column: the union of the modules' schema whitelists; column is null for the table itself."""
        found = self.files.filter(F.col("path").endswith("/etc/db_schema_whitelist.json"))
        tables = found.select(F.explode(F.from_json("content", "map<string, struct<column: map<string, boolean>>>")).alias("table", "t"))
        columns = tables.select("table", F.explode(F.map_keys(F.coalesce("t.column", F.create_map().cast("map<string,boolean>")))).alias("column"))
        return tables.select("table", F.lit(None).cast("string").alias("column")).unionByName(columns).distinct().orderBy("table", "column")

    def packages(self) -> DataFrame:
        """package, type, folder, psr4 (prefix=folder), requires: what composer has installed."""
        shape = "struct<packages: array<struct<name: string, type: string, `install-path`: string, autoload: struct<`psr-4`: map<string, string>>, `require`: map<string, string>>>>"
        found = self.files.filter("path = 'vendor/composer/installed.json'").select(F.inline(F.from_json("content", shape)["packages"]))
        folder = F.regexp_replace(F.coalesce("install-path", F.concat(F.lit("../"), "name")), r"^\.\./", "vendor/")
        rules = F.transform(F.map_entries(F.coalesce("autoload.psr-4", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return found.select(F.col("name").alias("package"), "type", folder.alias("folder"), F.array_sort(rules).alias("psr4"), F.array_sort(F.map_keys(F.coalesce("require", F.create_map().cast("map<string,string>")))).alias("requires")).orderBy("package")

    def psr4(self) -> DataFrame:
        """prefix, folder: autoload rules of the root and of the packages."""
        shape = "struct<autoload: struct<`psr-4`: map<string, string>>>"
        root = self.files.filter("path = 'composer.json'").select(F.explode(F.from_json("content", shape)["autoload"]["psr-4"]).alias("prefix", "folder"))
        split = self.packages().select("folder", F.explode("psr4").alias("rule"))
        own = split.select(F.substring_index("rule", "=", 1).alias("prefix"), F.concat_ws("/", "folder", F.nullif(F.rtrim(F.substring_index("rule", "=", -1), F.lit("/")), F.lit(""))).alias("folder"))
        return root.select("prefix", F.rtrim("folder", F.lit("/")).alias("folder")).unionByName(own).distinct().orderBy("prefix", "folder")

    def package_dependencies(self) -> DataFrame:
        """module, requires: modules whose packages require each other's; as ``relations.dependencies`` takes them."""
        packages = self.packages()
        owned = self.modules.filter("root IS NOT NULL").join(packages.select("package", "folder"), F.startswith("root", F.col("folder"))).select("package", F.col("name").alias("module"))
        needs = packages.select("package", F.explode("requires").alias("needed"))
        return owned.join(needs, "package").join(owned.select(F.col("package").alias("needed"), F.col("module").alias("requires")), "needed").select("module", "requires").distinct()


def lints(shop: Catalogues, known: DataFrame) -> DataFrame:
    """lint, severity, subject, path, line: those of ``doctor`` that need these catalogues. known: class, of all that is declared."""
    from . import frontend
    from .lints import finding, findings

    nowhere = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")]
    names = known.select(F.lower("class").alias("__known")).distinct()
    absent = lambda rows, column: rows.filter(F.col(column).isNotNull()).join(names, F.lower(plain(column)) == F.col("__known"), "left_anti")
    virtual = shop.virtual_types.filter("area = 'global' AND type IS NOT NULL").select(F.col("name").alias("src"), F.col("type").alias("dst"))
    out = [finding(graph.chase(virtual).filter("target IS NULL"), "VirtualTypeCycle", "error", F.col("node"), *nowhere)]
    out.append(finding(absent(shop.console_commands(), "class"), "CommandClassMissing", "error", F.col("class"), *nowhere))
    routes = shop.queue_routes()
    out.append(finding(routes.filter("queue IS NOT NULL AND consumer IS NULL"), "QueueNoConsumer", "warn", F.col("queue"), *nowhere))
    resolvers = shop.graphql.select(F.explode("fields").alias("f")).select("f.resolver", "f.line")
    out.append(finding(absent(resolvers, "resolver"), "GraphqlResolverMissing", "error", F.col("resolver"), *nowhere))
    handlers = shop.declared("consumers")
    out += [finding(absent(handlers.withColumn("c", F.substring_index(F.nullif(F.col(c), F.lit("")), "::", 1)), "c"), "MqHandlerMissing", "error", F.col("c"), F.col("path"), F.col("line")) for c in ("handler", "instance")]
    commands = shop.console_commands().select("class")
    registered = commands.unionByName(shop.virtual_types.select(F.col("type").alias("class"))).filter("class IS NOT NULL").distinct()
    bases = shop.hierarchy.filter("depth > 0").select(F.col("node").alias("class")).distinct()
    of = lambda base: shop.hierarchy.filter((F.col("depth") > 0) & (F.col("node") == base)).select(F.col("root").alias("class"))
    concrete = shop.classes.filter("kind = 'class' AND NOT abstract").select("class", "path", "line")
    loose = concrete.join(of("Symfony\\Component\\Console\\Command\\Command"), "class", "left_semi").join(registered.unionByName(bases), "class", "left_anti")
    out.append(finding(loose, "CommandUnregistered", "warn", F.col("class"), F.col("path"), F.col("line")))
    observed = shop.observers.select(plain("instance").alias("class")).filter("class IS NOT NULL").distinct()
    loose = concrete.join(of("Magento\\Framework\\Event\\ObserverInterface"), "class", "left_semi").join(observed.unionByName(bases).unionByName(registered), "class", "left_anti")
    out.append(finding(loose, "ObserverUnregistered", "warn", F.col("class"), F.col("path"), F.col("line")))
    missing = frontend.missing_templates(shop).select("reference", F.explode("usages").alias("u"))
    place = [F.substring_index("u", ":", 1).alias("path"), F.expr("try_cast(substring_index(u, ':', -1) AS int)").alias("line")]
    out.append(finding(missing, "TemplateFileMissing", "error", F.col("reference"), *place))
    return findings(*out)


__all__ = ["OVERLAID", "Catalogues", "lints"]
