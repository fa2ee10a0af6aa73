"""What each kind of declaration file declares.

A spec names the file, the path of tags from the root's child on, and the columns: of the
element itself, of an element around it (``tag.attribute``), its text
(``text()``) or whether an element is there. Values are attribute names of the
file formats, fixed by them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    file: str  #: below etc/ or etc/<area>/
    tags: tuple[str, ...]  #: from the outermost that counts to the element itself
    columns: dict[str, str] = field(default_factory=dict)


SPECS: dict[str, Spec] = {
    "preferences": Spec("di.xml", ("preference",), {"for": "for", "type": "type"}),
    "plugins": Spec("di.xml", ("type", "plugin"), {"target": "type.name", "name": "name", "class": "type", "sort_order": "sortOrder", "disabled": "disabled"}),
    "virtual_types": Spec("di.xml", ("virtualType",), {"name": "name", "type": "type", "shared": "shared"}),
    "types": Spec("di.xml", ("type",), {"name": "name", "shared": "shared"}),
    "observers": Spec("events.xml", ("event", "observer"), {"event": "event.name", "name": "name", "instance": "instance", "disabled": "disabled", "shared": "shared"}),
    "cron_jobs": Spec("crontab.xml", ("group", "job"), {"group": "group.id", "name": "name", "instance": "instance", "method": "method"}),
    "cron_schedules": Spec("crontab.xml", ("group", "job", "schedule"), {"group": "group.id", "name": "job.name", "schedule": "text()"}),
    "routes": Spec("routes.xml", ("router", "route"), {"router": "router.id", "id": "id", "front_name": "frontName"}),
    "route_modules": Spec("routes.xml", ("router", "route", "module"), {"router": "router.id", "id": "route.id", "name": "name", "before": "before", "after": "after"}),
    "webapi": Spec("webapi.xml", ("route",), {"url": "url", "method": "method"}),
    "webapi_services": Spec("webapi.xml", ("route", "service"), {"url": "route.url", "http_method": "route.method", "class": "class", "method": "method"}),
    "webapi_resources": Spec("webapi.xml", ("route", "resources", "resource"), {"url": "route.url", "http_method": "route.method", "ref": "ref"}),
    "tables": Spec("db_schema.xml", ("table",), {"name": "name", "resource": "resource", "engine": "engine", "comment": "comment", "disabled": "disabled"}),
    "columns": Spec("db_schema.xml", ("table", "column"), {"table": "table.name", "name": "name", "type": "type", "length": "length", "nullable": "nullable", "identity": "identity", "default": "default", "disabled": "disabled"}),
    "constraints": Spec("db_schema.xml", ("table", "constraint"), {"table": "table.name", "reference_id": "referenceId", "type": "type", "reference_table": "referenceTable", "reference_column": "referenceColumn", "disabled": "disabled"}),
    "indexes": Spec("db_schema.xml", ("table", "index"), {"table": "table.name", "reference_id": "referenceId", "type": "indexType", "disabled": "disabled"}),
    "acl": Spec("acl.xml", ("resource",), {"id": "id", "title": "title", "sort_order": "sortOrder", "disabled": "disabled", "parent": "resource.id"}),
    "menu_add": Spec("menu.xml", ("add",), {"id": "id", "title": "title", "parent": "parent", "action": "action", "resource": "resource", "sort_order": "sortOrder"}),
    "menu_update": Spec("menu.xml", ("update",), {"id": "id", "title": "title", "parent": "parent", "action": "action", "resource": "resource", "sort_order": "sortOrder"}),
    "menu_remove": Spec("menu.xml", ("remove",), {"id": "id"}),
    "extension_attributes": Spec("extension_attributes.xml", ("extension_attributes", "attribute"), {"for": "extension_attributes.for", "code": "code", "type": "type"}),
    "indexers": Spec("indexer.xml", ("indexer",), {"id": "id", "view_id": "view_id", "class": "class"}),
    "indexer_dependencies": Spec("indexer.xml", ("indexer", "dependencies", "indexer"), {"id": "indexer.id", "on": "id"}),
    "mviews": Spec("mview.xml", ("view",), {"id": "id", "class": "class", "group": "group"}),
    "mview_tables": Spec("mview.xml", ("view", "subscriptions", "table"), {"id": "view.id", "table": "name", "entity_column": "entity_column"}),
    "topics": Spec("communication.xml", ("topic",), {"name": "name", "request": "request", "response": "response", "is_synchronous": "is_synchronous"}),
    "topic_handlers": Spec("communication.xml", ("topic", "handler"), {"topic": "topic.name", "name": "name", "type": "type", "method": "method", "disabled": "disabled"}),
    "consumers": Spec("queue_consumer.xml", ("consumer",), {"name": "name", "queue": "queue", "connection": "connection", "handler": "handler", "instance": "consumerInstance"}),
    "exchanges": Spec("queue_topology.xml", ("exchange",), {"name": "name", "type": "type", "connection": "connection"}),
    "bindings": Spec("queue_topology.xml", ("exchange", "binding"), {"exchange": "exchange.name", "connection": "exchange.connection", "id": "id", "topic": "topic", "destination": "destination", "disabled": "disabled"}),
    "publishers": Spec("queue_publisher.xml", ("publisher",), {"topic": "topic", "queue": "queue", "disabled": "disabled"}),
    "publisher_connections": Spec("queue_publisher.xml", ("publisher", "connection"), {"topic": "publisher.topic", "name": "name", "exchange": "exchange", "disabled": "disabled"}),
    "system_tabs": Spec("system.xml", ("system", "tab"), {"id": "id", "sort_order": "sortOrder"}),
    "system_fields": Spec("system.xml", ("section", "group", "field"), {"section": "section.id", "group": "group.id", "id": "id", "type": "type", "in_default": "showInDefault", "in_website": "showInWebsite", "in_store": "showInStore"}),
    "catalog_attributes": Spec("catalog_attributes.xml", ("group", "attribute"), {"group": "group.name", "name": "name"}),
    "email_templates": Spec("email_templates.xml", ("template",), {"id": "id", "label": "label", "file": "file", "type": "type", "of": "module", "for_area": "area"}),
    "widgets": Spec("widget.xml", ("widget",), {"id": "id", "class": "class"}),
    "widget_parameters": Spec("widget.xml", ("widget", "parameters", "parameter"), {"widget": "widget.id", "name": "name", "type": "type", "required": "required", "sort_order": "sort_order"}),
    "fieldsets": Spec("fieldset.xml", ("scope", "fieldset", "field"), {"scope": "scope.id", "fieldset": "fieldset.id", "field": "name"}),
    "fieldset_aspects": Spec("fieldset.xml", ("scope", "fieldset", "field", "aspect"), {"scope": "scope.id", "fieldset": "fieldset.id", "field": "field.name", "aspect": "name", "target": "targetField"}),
    "indexer_titles": Spec("indexer.xml", ("indexer", "title"), {"id": "indexer.id", "value": "text()"}),
    "extension_resources": Spec("extension_attributes.xml", ("extension_attributes", "attribute", "resources", "resource"), {"for": "extension_attributes.for", "code": "attribute.code", "ref": "ref"}),
    "extension_joins": Spec("extension_attributes.xml", ("extension_attributes", "attribute", "join"), {"for": "extension_attributes.for", "code": "attribute.code", "reference_table": "reference_table", "reference_field": "reference_field", "join_on_field": "join_on_field"}),
    "extension_fields": Spec("extension_attributes.xml", ("extension_attributes", "attribute", "join", "field"), {"for": "extension_attributes.for", "code": "attribute.code", "field": "text()"}),
    "system_tab_labels": Spec("system.xml", ("tab", "label"), {"tab_id": "tab.id", "value": "text()"}),
    "system_section_labels": Spec("system.xml", ("section", "label"), {"section": "section.id", "value": "text()"}),
    "system_section_tabs": Spec("system.xml", ("section", "tab"), {"section": "section.id", "value": "text()"}),
    "system_group_labels": Spec("system.xml", ("section", "group", "label"), {"section": "section.id", "group": "group.id", "value": "text()"}),
    "system_field_labels": Spec("system.xml", ("section", "group", "field", "label"), {"section": "section.id", "group": "group.id", "id": "field.id", "value": "text()"}),
    "system_config_paths": Spec("system.xml", ("section", "group", "field", "config_path"), {"section": "section.id", "group": "group.id", "id": "field.id", "value": "text()"}),
    "system_source_models": Spec("system.xml", ("section", "group", "field", "source_model"), {"section": "section.id", "group": "group.id", "id": "field.id", "value": "text()"}),
    "system_backend_models": Spec("system.xml", ("section", "group", "field", "backend_model"), {"section": "section.id", "group": "group.id", "id": "field.id", "value": "text()"}),
    "widget_labels": Spec("widget.xml", ("widget", "label"), {"id": "widget.id", "value": "text()"}),
    "widget_descriptions": Spec("widget.xml", ("widget", "description"), {"id": "widget.id", "value": "text()"}),
    "module": Spec("module.xml", ("module",), {"name": "name", "setup_version": "setup_version"}),
    "module_sequence": Spec("module.xml", ("module", "sequence", "module"), {"of": "module.name", "after": "name"}),
}


def place(tags: tuple[str, ...]) -> Column:
    """Whether a node's chain of tags ends in these."""
    chain = F.concat(F.transform("trail", lambda t: t["tag"]), F.array("tag"))
    n = len(tags)
    return (F.col("tag") == tags[-1]) & (F.size(chain) >= n) & (F.slice(chain, -n, n) == F.array(*map(F.lit, tags)))


def value(source: str) -> Column:
    if source == "text()":
        return F.nullif(F.col("text"), F.lit(""))
    tag, _, attribute = source.rpartition(".")
    if not tag:
        return F.try_element_at("attrs", F.lit(attribute))
    around = F.filter("trail", lambda t: t["tag"] == tag)
    return F.when(F.size(around) > 0, F.try_element_at(F.element_at(around, -1)["attrs"], F.lit(attribute)))


def declarations(nodes: DataFrame, kind: str) -> DataFrame:
    """The rows of a kind: its columns, and module, area, path, line, seq, layer, load_order."""
    spec = SPECS[kind]
    own = nodes.filter((F.col("file") == spec.file) & place(spec.tags))
    if len(spec.tags) == 1:  # an element of that name deeper inside is another thing, but for trees
        own = own.filter(F.size("trail") >= 1) if kind == "acl" else own.filter(~F.exists("trail", lambda t: t["tag"] == spec.tags[0]))
    return own.select(*(value(source).alias(name) for name, source in spec.columns.items()), "module", "area", "path", "line", "seq", "layer", "load_order")


def argument_nodes(nodes: DataFrame) -> DataFrame:
    """Constructor arguments, flattened: owner, argument, path (array), kind, value and the order columns."""
    chain = F.filter(F.concat("trail", F.array(F.struct(F.col("tag").alias("tag"), F.col("attrs").alias("attrs")))), lambda t: t["tag"].isin("argument", "item"))
    names = F.transform(chain, lambda t: F.try_element_at(t["attrs"], F.lit("name")))
    owner = F.filter("trail", lambda t: t["tag"].isin("type", "virtualType"))
    own = nodes.filter((F.col("file") == "di.xml") & F.col("tag").isin("argument", "item") & (F.size(owner) > 0))
    return own.select(
        F.try_element_at(F.element_at(owner, 1)["attrs"], F.lit("name")).alias("owner"), names[0].alias("argument"), names.alias("path"),
        F.try_element_at("attrs", F.lit("type")).alias("kind"), F.nullif(F.col("text"), F.lit("")).alias("value"), "module", "area", F.col("path").alias("source_path"), "line", "seq", "layer", "load_order",
    )
