"""Command line: python -m declgraph ROOT COMMAND [ARGUMENT] [--area AREA] [--store FOLDER] [--limit N] [--now TIME] [--json]

ROOT holds an installation's files. Commands on operational tables read them
from --store, a folder of Parquet snapshots named after the tables. Without
an argument a command lists everything, with one it shows what the argument names.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .plans import autoload, catalogues, doctor, frontend, relations
from .plans.cards import Cards
from .plans.catalogues import Catalogues
from .plans.lints import findings
from .plans.live import schema_drift
from .sources.files import AREAS, read_files


@dataclass
class Call:
    spark: SparkSession
    given: argparse.Namespace

    @cached_property
    def shop(self) -> Catalogues:
        return Catalogues(read_files(self.spark, self.given.root))

    @cached_property
    def live(self) -> Cards:
        def read(name: str) -> DataFrame | None:
            if not self.given.store:
                return None
            try:
                return self.spark.read.parquet(f"{self.given.store}/{name}.parquet")
            except AnalysisException:
                return None

        return Cards(self.spark, read)

    @property
    def x(self) -> str | None:
        return self.given.argument

    @property
    def area(self) -> str:
        return self.given.area

    @property
    def now(self) -> Column:
        return F.lit(self.given.now).cast("timestamp") if self.given.now else F.current_timestamp()

    def key(self, column: str, kind: str = "string") -> DataFrame:
        """The argument as a table of keys; without one, all keys of nothing."""
        return self.spark.createDataFrame([(self.x,)], f"{column} string").select(F.col(column).cast(kind))

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """The rows that hold the argument in a column; all without one."""
        return rows.filter(catalogues.has(list(columns), self.x)) if self.x else rows

    def at(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.filter(F.col(column) == self.x) if self.x else rows

    def card_or_list(self, card: Callable[[DataFrame], DataFrame], column: str, kind: str, search: Callable[[str, int], DataFrame]) -> DataFrame:
        """The card of the argument if it's a number, else what a search finds."""
        return card(self.key(column, kind)) if (self.x or "").isdigit() else search(self.x or "", self.given.limit)

    def store_value(self, path: str) -> DataFrame:
        return self.live.table("core_config_data").filter(F.col("path") == path).select("scope", "scope_id", "path", "value").orderBy("scope", "scope_id")

    def doctor(self) -> DataFrame:
        known = self.shop.classes.select("class")
        return findings(doctor.doctor(self.shop, [self.x] if self.x else []), catalogues.lints(self.shop, known))

    def patches(self) -> DataFrame:
        declared = self.shop.classes.filter(F.exists("parents", lambda p: p.rlike(r"(Data|Schema)PatchInterface$"))).select(F.col("class").alias("patch"))
        return self.named(self.live.patches(declared), "patch")

    def drift(self) -> DataFrame:
        stored = self.live.table("information_schema_columns").select(F.col("TABLE_NAME").alias("table")) if self.live.read("information_schema_columns") is not None else self.spark.createDataFrame([], "table string")
        return schema_drift(self.shop.tables.select(F.col("name").alias("table")), stored, self.shop.whitelist().select("table")).orderBy("table")

    def document(self, kind: str) -> DataFrame:
        found = self.live.document_cards(kind, self.key("increment_id")) if self.x else None
        return found if found is not None and not found.isEmpty() else self.live.documents_like(kind, self.x or "", self.given.limit)


def ordered(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in columns))


COMMANDS: dict[str, Callable[[Call], DataFrame]] = {
    # installation
    "info": lambda c: c.shop.info(),
    "base-url": lambda c: c.store_value("web/unsecure/base_url").unionByName(c.store_value("web/secure/base_url")),
    "admin-url": lambda c: c.shop.env_section("backend/frontName"),
    "mode": lambda c: c.shop.env_section("MAGE_MODE"),
    "maintenance": lambda c: c.shop.files.agg((F.count(F.when(F.col("path") == "var/.maintenance.flag", 1)) > 0).alias("on")),
    "modules": lambda c: ordered(c.named(c.shop.modules, "name"), "load_order", "name"),
    "module-counts": lambda c: c.shop.module_counts(),
    "deps": lambda c: ordered(c.at(relations.dependencies(c.shop, c.shop.package_dependencies()), "module"), "module", "direction", "other"),
    "diagnostics": lambda c: c.shop.diagnostics(),
    "doctor": lambda c: c.doctor(),
    "whatis": lambda c: relations.whatis(c.shop, c.x or ""),
    "patches": lambda c: ordered(c.patches(), "patch"),
    "packages": lambda c: c.named(c.shop.packages(), "package"),
    "files": lambda c: c.shop.files_containing(c.x or ""),
    "source": lambda c: c.shop.source_text(c.x or ""),
    "classes": lambda c: c.named(autoload.class_names(c.shop.psr4(), c.shop.files), "class"),
    # wiring
    "preference": lambda c: c.shop.preference_of(c.area).filter(F.col("node") == c.x),
    "plugins": lambda c: c.shop.plugins_on(c.area).filter(F.col("class") == c.x),
    "all-plugins": lambda c: c.shop.plugins_everywhere().filter(F.col("class") == c.x),
    "targets": lambda c: c.shop.targets_of(c.x or ""),
    "chains": lambda c: c.shop.chains(c.area).filter(F.col("class") == c.x),
    "all-chains": lambda c: c.shop.chains_everywhere().filter(F.col("class") == c.x),
    "di": lambda c: c.shop.resolve(c.area).filter(F.col("class") == c.x) if c.x else c.shop.summary(c.area),
    "arguments": lambda c: c.at(c.shop.inherited_arguments(c.area), "class"),
    "uses": lambda c: c.shop.uses(c.x or ""),
    "ancestors": lambda c: c.at(c.shop.hierarchy.filter("depth > 0"), "root").orderBy("root", "depth", "node"),
    "virtual-types": lambda c: c.named(c.shop.virtual_types, "name").select("name").distinct().orderBy("name"),
    "custom-areas": lambda c: c.shop.custom_areas,
    "commands": lambda c: c.shop.console_commands(c.x),
    # entry points
    "events": lambda c: c.shop.observers.filter((F.col("area") == c.area) & (F.col("event") == c.x)).orderBy("name") if c.x else c.shop.events(c.area),
    "observers": lambda c: c.shop.observers.filter(F.col("area") == c.area).orderBy("event", "name"),
    "cron": lambda c: ordered(c.at(c.shop.cron_jobs, "group"), "group", "name"),
    "cron-live": lambda c: ordered(c.live.cron(c.now), "job_code"),
    "cron-history": lambda c: c.live.cron_history(c.x or "", c.given.limit),
    "routes": lambda c: c.shop.routes.filter(F.col("area") == c.area).orderBy("router", "id"),
    "webapi": lambda c: ordered(c.shop.webapi.filter(F.contains("url", F.lit(c.x))) if c.x else c.shop.webapi, "url", "http_method"),
    "actions": lambda c: c.shop.actions(c.area, c.x),
    "graphql": lambda c: c.named(c.shop.graphql, "name"),
    # declared catalogues
    "schema": lambda c: ordered(c.named(c.shop.tables, "name"), "name"),
    "tables": lambda c: ordered(c.named(c.shop.tables, "name"), "name"),
    "columns": lambda c: ordered(c.at(c.shop.parts_of_tables("columns", "name"), "table"), "table", "name"),
    "drift": lambda c: c.drift(),
    "whitelist": lambda c: c.at(c.shop.whitelist(), "table"),
    "indexers": lambda c: c.named(c.shop.indexers, "id", "title"),
    "indexers-live": lambda c: ordered(c.live.indexers(c.shop.indexers.select("id", "view_id")), "id"),
    "extension-attributes": lambda c: c.named(c.shop.extension_attributes, "for"),
    "catalog-attributes": lambda c: c.at(c.shop.catalog_attributes, "group"),
    "fieldset": lambda c: c.shop.fieldset(c.x) if c.x else c.shop.fieldsets,
    "fieldset-field": lambda c: c.shop.fieldset_fields(c.x or ""),
    "widgets": lambda c: c.named(c.shop.widgets, "id", "label"),
    "email-templates": lambda c: c.named(c.shop.email_templates, "id", "label"),
    "system-config": lambda c: c.named(c.shop.system_fields, "path", "label"),
    "acl": lambda c: c.named(c.shop.acl, "id", "title").orderBy("path"),
    "acl-ancestors": lambda c: relations.ancestors(c.shop.acl, "id", "parent", c.x or ""),
    "acl-children": lambda c: c.at(c.shop.acl, "parent").orderBy("path"),
    "menu": lambda c: c.named(c.shop.menu, "id", "title").orderBy("path"),
    "menu-ancestors": lambda c: relations.ancestors(c.shop.menu, "id", "parent", c.x or ""),
    "menu-children": lambda c: c.at(c.shop.menu, "parent").orderBy("path"),
    "layout": lambda c: frontend.layout(c.shop, c.x, c.area)["contributions"] if c.x else frontend.handles(c.shop, c.area),
    "layouts": lambda c: frontend.handles(c.shop, c.area),
    "templates": lambda c: c.named(frontend.templates(c.shop).filter(F.col("area").isin(c.area, "base")), "reference").orderBy("reference"),
    "template-usages": lambda c: c.shop.template_usages(c.x or ""),
    "ui-components": lambda c: c.at(frontend.ui_components(c.shop).filter(F.col("area").isin(c.area, "base")), "name").orderBy("name"),
    "components": lambda c: frontend.ui_components(c.shop).filter(F.col("area").isin(c.area, "base")).orderBy("name"),
    "themes": lambda c: c.shop.themes,
    "languages": lambda c: c.shop.languages,
    "translations": lambda c: c.shop.translations(c.x or "", None),
    "eav-setup": lambda c: c.shop.eav_setups(c.x),
    # deployment configuration
    "config": lambda c: ordered(c.shop.config_values().filter(scalars.under(F.col("path"), c.x)) if c.x else c.shop.config_values(), "scope", "path"),
    "config-scopes": lambda c: c.shop.scopes_setting(c.shop.config_values(), c.x or ""),
    "db": lambda c: c.shop.db_config(),
    "redis": lambda c: c.shop.redis_config(),
    "session": lambda c: c.shop.session_config(),
    "cache": lambda c: c.shop.cache_config(),
    "lock": lambda c: c.shop.lock_config(),
    "queue": lambda c: c.shop.queue_config(),
    "queue-topology": lambda c: ordered(c.at(c.shop.queue_routes(), "topic"), "topic", "queue", "consumer"),
    "queues": lambda c: ordered(c.shop.queue_routes(), "topic", "queue"),
    "queue-backlog": lambda c: ordered(c.live.queue_backlog(c.shop.topology["consumers"].select("queue").distinct(), c.now), "queue"),
    # the store's entities
    "product": lambda c: c.live.product_cards(c.key("sku")) if c.x else c.live.products_like("", c.given.limit),
    "products": lambda c: c.live.products_like(c.x or "", c.given.limit),
    "price": lambda c: c.live.price_cards(c.live.of("catalog_product_entity", c.key("sku"), "sku").select("entity_id")),
    "product-links": lambda c: c.live.product_links(c.live.of("catalog_product_entity", c.key("sku"), "sku").select("entity_id")).orderBy("kind", "position", "sku"),
    "category": lambda c: c.card_or_list(c.live.category_cards, "entity_id", "int", c.live.categories_like) if c.x else c.live.category_list(),
    "order": lambda c: c.live.order_cards(c.key("increment_id")) if c.x else c.live.orders_like("", c.given.limit),
    "orders": lambda c: c.live.orders_like(c.x or "", c.given.limit),
    "customer": lambda c: c.live.customer_cards(c.key("email"), c.now) if "@" in (c.x or "") else c.card_or_list(lambda k: c.live.customer_cards(k, c.now), "entity_id", "int", c.live.customers_like),
    "customer-groups": lambda c: ordered(c.live.customer_groups(), "customer_group_id"),
    "quote": lambda c: c.card_or_list(lambda k: c.live.quote_cards(k, c.now), "entity_id", "long", c.live.quotes_like),
    "invoice": lambda c: c.document("invoice"),
    "shipment": lambda c: c.document("shipment"),
    "creditmemo": lambda c: c.document("creditmemo"),
    "order-statuses": lambda c: c.live.order_statuses(),
    "sequences": lambda c: ordered(c.live.sequences(), "entity_type", "store_id"),
    "sales-rule": lambda c: c.card_or_list(lambda k: c.live.sales_rule_cards(k, F.to_date(c.now)), "rule_id", "int", c.live.sales_rules_like),
    "coupon": lambda c: c.live.sales_rule_cards(c.live.rules_of_coupons(c.key("code")).select("rule_id"), F.to_date(c.now)),
    "catalog-rule": lambda c: c.card_or_list(lambda k: c.live.catalog_rule_cards(k, F.to_date(c.now)), "rule_id", "int", c.live.catalog_rules_like),
    "tax": lambda c: c.live.tax_rules(),
    "tax-rates": lambda c: c.live.tax_rates(),
    "cms-page": lambda c: c.live.cms_cards("page", c.key("identifier")) if c.x else c.live.cms_like("page", "", c.given.limit),
    "cms-block": lambda c: c.live.cms_cards("block", c.key("identifier")) if c.x else c.live.cms_like("block", "", c.given.limit),
    "admin-users": lambda c: ordered(c.live.admin_users(c.now), "username"),
    "admin-roles": lambda c: c.live.admin_roles(),
    "integrations": lambda c: c.live.integrations(),
    "eav": lambda c: c.live.attribute_cards(c.x) if c.x else c.live.entity_types(),
    "url-rewrites": lambda c: c.live.url_rewrites(c.x, limit=c.given.limit),
    "stores": lambda c: c.live.store_tree(),
    "currencies": lambda c: c.live.currency_rates(),
}


def text_of(row) -> str:
    """Values, and at the end where they come from."""
    values = row.asDict(recursive=True)
    source = values.pop("source", None)
    source = source if isinstance(source, dict) else None
    path, line = (source or values).get("path"), (source or values).get("line")
    plain = " ".join(f"{k}={v}" for k, v in values.items() if v is not None and k not in ("path", "line", "place", "seq", "layer", "load_order"))
    return plain + (f"  # {path}:{line}" if isinstance(path, str) and line else "")


def run(spark: SparkSession, arguments: list[str]) -> tuple[DataFrame, bool]:
    parser = argparse.ArgumentParser(prog="declgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("root")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--area", choices=AREAS, default="global")
    parser.add_argument("--store", help="folder of Parquet snapshots of the store's tables")
    parser.add_argument("--limit", type=int, default=50)
    parser.add_argument("--now", help="the time that ages are counted to; the session's by default")
    parser.add_argument("--json", action="store_true")
    given = parser.parse_args(arguments)
    return COMMANDS[given.command](Call(spark, given)), given.json


def main() -> int:
    spark = SparkSession.builder.appName("declgraph").getOrCreate()
    found, as_json = run(spark, sys.argv[1:])
    if as_json:
        for row in found.toJSON().toLocalIterator():
            print(row)
    else:
        for row in found.toLocalIterator():
            print(text_of(row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
