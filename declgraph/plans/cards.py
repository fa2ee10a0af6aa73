"""Cards of a store's entities: everything that the operational tables hold about one, for many at once.

A card is a row; what belongs to it in other tables is a column with an
array of structs, in a stated order. Each table is filtered by the wanted
keys, aggregated by key and joined once, so a card of one entity and of a
million are the same plan. Amounts and times come as they are stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, graph
from .live import Live

#: Attributes that the category and the price cards show. Fixed values of the tables.
CATEGORY_ATTRIBUTES = ("name", "is_active", "include_in_menu", "is_anchor", "url_key", "url_path", "display_mode", "available_sort_by", "default_sort_by", "landing_page")
PRICE_ATTRIBUTES = ("price", "special_price", "special_from_date", "special_to_date", "cost", "msrp", "minimal_price")
#: Kinds of product links.
LINKS = {"related": 1, "grouped": 3, "up_sell": 4, "cross_sell": 5}
DOCUMENTS = ("invoice", "shipment", "creditmemo")
TOTALS = ("subtotal", "shipping_amount", "tax_amount", "discount_amount", "grand_total", "total_paid", "total_refunded", "total_due")


def listed(cards: DataFrame, key: str, rows: DataFrame, on: str, name: str, show: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """cards with ``name``: the rows of each key as structs of ``show``, by ``order``, or by what is shown. Empty without rows.

    A window sorts the rows by key once, and the join takes them in that order; an
    aggregation into lists sorts them before and after the shuffle, and the join its lists.
    """
    row = F.struct(*show)
    item = F.struct(F.struct(*order).alias("at"), row.alias("row")) if order else row
    every = Window.partitionBy("__on").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    until = Window.partitionBy("__on").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # without an order of its own, so that sorted rows aren't sorted again
    each = rows.filter(F.col(on).isNotNull()).select(F.col(on).alias("__on"), item.alias("__item"))
    found = each.select("__on", F.collect_list("__item").over(every).alias("__items"), F.count(F.lit(1)).over(until).alias("__at")).filter("__at = 1")
    items = F.array_sort("__items")
    found = found.select("__on", (F.transform(items, lambda x: x["row"]) if order else items).alias(name))
    kind = found.schema[name].dataType
    return cards.join(found, F.col(key) == F.col("__on"), "left").drop("__on").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def one(cards: DataFrame, key: str, rows: DataFrame, on: str, show: Sequence[str]) -> DataFrame:
    """cards with columns of the one row of each key, the least if there are more."""
    found = rows.groupBy(F.col(on).alias("__on")).agg(F.min(F.struct(*show)).alias("__row")).select("__on", *(F.col(f"__row.{c}").alias(c) for c in show))
    return cards.join(found, F.col(key) == F.col("__on"), "left").drop("__on")


class Cards(Live):
    def of(self, name: str, keys: DataFrame | None, column: str, key: str | None = None) -> DataFrame:
        """Rows of a table whose column is among the keys; all without keys."""
        rows = self.table(name)
        if keys is None:
            return rows
        wanted = keys.select(F.col(key or column).alias("__wanted")).distinct()
        return rows.join(wanted, rows[column] == F.col("__wanted"), "left_semi")

    def store_codes(self) -> DataFrame:
        return self.table("store").select(F.col("store_id").alias("__store"), F.col("code").alias("store"))

    def with_store(self, rows: DataFrame, fallback: bool = True) -> DataFrame:
        """rows with ``store``, its code; store/<id> for one that isn't there."""
        joined = rows.join(self.store_codes(), F.col("store_id") == F.col("__store"), "left").drop("__store")
        named = F.coalesce("store", F.concat(F.lit("store/"), F.col("store_id").cast("string"))) if fallback else F.col("store")
        return joined.withColumn("store", named)

    # products

    def product_values(self, entity: str, table: str, keys: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
        """entity_id, attribute, store, value of the entities; options by their labels where there are some."""
        attributes = self.attributes(entity).select("attribute_id", "attribute_code", "backend_type")
        if codes:
            attributes = attributes.filter(F.col("attribute_code").isin(*codes))
        kinds = ("varchar", "int", "decimal", "text", "datetime")
        parts = [self.of(f"{table}_{k}", keys, "entity_id").join(attributes.filter(F.col("backend_type") == k), "attribute_id").select("entity_id", "attribute_id", "attribute_code", "store_id", F.col("value").cast("string").alias("value")) for k in kinds]
        rows = self.with_store(reduce(DataFrame.unionByName, parts))
        labels = self.option_labels().select(F.col("attribute_id").alias("__a"), F.col("option_id").cast("string").alias("__o"), "label")
        # options are lists of ids for multiselects
        each = rows.withColumn("__one", F.explode_outer(F.split("value", ",")))
        shown = each.join(labels, (F.col("attribute_id") == F.col("__a")) & (F.trim("__one") == F.col("__o")), "left")
        names = F.array_join(F.array_sort(F.collect_set("label")), ", ")
        return shown.groupBy("entity_id", "attribute_code", "store_id", "store", "value").agg(F.nullif(names, F.lit("")).alias("label")).withColumnRenamed("attribute_code", "attribute")

    def option_labels(self) -> DataFrame:
        options = self.table("eav_attribute_option").select("option_id", "attribute_id", "sort_order")
        return options.join(self.table("eav_attribute_option_value").filter("store_id = 0").select("option_id", F.col("value").alias("label")), "option_id")

    def names_of(self, entity: str, table: str, code: str, kind: str) -> DataFrame:
        """entity_id, value of one attribute in store 0."""
        attribute = self.attributes(entity).filter(F.col("attribute_code") == code).select("attribute_id")
        return self.table(f"{table}_{kind}").filter("store_id = 0").join(attribute, "attribute_id", "left_semi").select("entity_id", "value")

    def skus(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with the sku and type of the product in a column; inner."""
        product = self.table("catalog_product_entity").select(F.col("entity_id").alias("__p"), "sku", "type_id")
        return rows.join(product, F.col(column) == F.col("__p")).drop("__p")

    def product_cards(self, keys: DataFrame) -> DataFrame:
        """One row per product of keys (entity_id or sku)."""
        column = "entity_id" if "entity_id" in keys.columns else "sku"
        sets = self.table("eav_attribute_set").select("attribute_set_id", F.col("attribute_set_name").alias("attribute_set"))
        base = self.of("catalog_product_entity", keys, column).join(sets, "attribute_set_id", "left").select("entity_id", "sku", "type_id", "attribute_set", "created_at", "updated_at")
        ids = base.select("entity_id")
        sites = self.table("store_website").select("website_id", F.col("code").alias("website"))
        cards = listed(base, "entity_id", self.of("catalog_product_website", ids, "product_id", "entity_id").join(sites, "website_id"), "product_id", "websites", ["website"])
        cards = listed(cards, "entity_id", self.product_values("catalog_product", "catalog_product_entity", ids), "entity_id", "attributes", ["attribute", "store", "value", "label"], ["attribute", "store_id"])
        cards = one(cards, "entity_id", self.of("cataloginventory_stock_item", ids, "product_id", "entity_id"), "product_id", ["qty", "is_in_stock", "manage_stock"])
        cards = listed(cards, "sku", self.of("inventory_source_item", base, "sku").select(F.col("sku").alias("of_sku"), "source_code", "quantity", "status"), "of_sku", "sources", ["source_code", "quantity", "status"])
        cards = listed(cards, "entity_id", self.category_paths(self.of("catalog_category_product", ids, "product_id", "entity_id")), "product_id", "categories", ["category_id", "names"])
        cards = listed(cards, "entity_id", self.rewrites("product", ids), "entity_id", "urls", ["store", "request_path", "redirect_type"], ["store_id", "request_path"])
        parents = self.skus(self.of("catalog_product_super_link", ids, "product_id", "entity_id"), "parent_id")
        cards = listed(cards, "entity_id", parents, "product_id", "parents", ["sku"])
        cards = listed(cards, "entity_id", self.children(ids), "parent_id", "children", ["kind", "sku", "qty", "status", "is_in_stock", "options"], ["kind", "place", "sku"])
        cards = listed(cards, "entity_id", self.bundle_options(ids), "parent_id", "bundle", ["title", "type", "required", "selections"], ["position", "option_id"])
        return listed(cards, "entity_id", self.media(ids), "entity_id", "media", ["file", "media_type", "label", "disabled"], ["position", "value_id"])

    def category_paths(self, placed: DataFrame) -> DataFrame:
        """placed with the names of the categories from the root down, without the tree's own root."""
        names = self.names_of("catalog_category", "catalog_category_entity", "name", "varchar")
        paths = self.table("catalog_category_entity").select(F.col("entity_id").alias("category_id"), F.posexplode(F.split("path", "/")).alias("at", "step")).filter("step <> '1'")
        named = paths.join(names, F.col("step") == names["entity_id"].cast("string"), "left")
        chain = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", F.concat(F.lit("(category "), "step", F.lit(")"))).alias("name")))), lambda x: x["name"])
        return placed.join(named.groupBy("category_id").agg(F.array_join(chain, " > ").alias("names")), "category_id", "left")

    def rewrites(self, entity: str, ids: DataFrame) -> DataFrame:
        return self.with_store(self.of("url_rewrite", ids, "entity_id").filter(F.col("entity_type") == entity).select("entity_id", "store_id", "request_path", "redirect_type"))

    def children(self, ids: DataFrame) -> DataFrame:
        """parent_id, kind, sku, qty, status, is_in_stock, options, place: configurable and grouped."""
        variants = self.of("catalog_product_super_link", ids, "parent_id", "entity_id").select("parent_id", "product_id", F.lit("configurable").alias("kind"), F.lit(None).cast("string").alias("qty"))
        qty = self.table("catalog_product_link_attribute").filter("link_type_id = 3 AND product_link_attribute_code = 'qty'").select("product_link_attribute_id")
        amounts = self.table("catalog_product_link_attribute_decimal").join(qty, "product_link_attribute_id", "left_semi").select("link_id", F.col("value").cast("string").alias("qty"))
        grouped = self.of("catalog_product_link", ids, "product_id", "entity_id").filter("link_type_id = 3").join(amounts, "link_id", "left")
        grouped = grouped.select(F.col("product_id").alias("parent_id"), F.col("linked_product_id").alias("product_id"), F.lit("grouped").alias("kind"), "qty")
        rows = self.skus(variants.unionByName(grouped), "product_id")
        status = self.names_of("catalog_product", "catalog_product_entity", "status", "int").select(F.col("entity_id").alias("__s"), F.col("value").alias("status"))
        stock = self.table("cataloginventory_stock_item").select(F.col("product_id").alias("__k"), "is_in_stock")
        rows = rows.join(status, F.col("product_id") == F.col("__s"), "left").join(stock, F.col("product_id") == F.col("__k"), "left").drop("__s", "__k")
        axes = self.of("catalog_product_super_attribute", ids, "product_id", "entity_id").select(F.col("product_id").alias("parent_id"), "attribute_id", "position")
        chosen = rows.filter("kind = 'configurable'").select("parent_id", "product_id").join(axes, "parent_id")
        own = self.table("catalog_product_entity_int").filter("store_id = 0").select(F.col("entity_id").alias("product_id"), "attribute_id", "value")
        codes = self.table("eav_attribute").select("attribute_id", "attribute_code")
        options = chosen.join(own, ["product_id", "attribute_id"]).join(codes, "attribute_id").join(self.option_labels().select(F.col("option_id").alias("value"), "label"), "value", "left")
        text = F.concat("attribute_code", F.lit("="), F.coalesce("label", F.col("value").cast("string")))
        said = F.transform(F.array_sort(F.collect_list(F.struct("position", text.alias("text")))), lambda x: x["text"])
        options = options.groupBy("parent_id", "product_id").agg(F.array_join(said, ", ").alias("options"))
        return rows.join(options, ["parent_id", "product_id"], "left").withColumn("place", F.lit(0))

    def bundle_options(self, ids: DataFrame) -> DataFrame:
        options = self.of("catalog_product_bundle_option", ids, "parent_id", "entity_id")
        titles = self.table("catalog_product_bundle_option_value").filter("store_id = 0").select("option_id", "title")
        picked = self.skus(self.of("catalog_product_bundle_selection", ids, "parent_product_id", "entity_id").select("option_id", "product_id", "selection_qty", "is_default", "selection_price_type", "selection_price_value", F.col("position").alias("place")), "product_id")
        return listed(options.join(titles, "option_id", "left"), "option_id", picked.withColumnRenamed("option_id", "of_option"), "of_option", "selections", ["sku", "selection_qty", "is_default", "selection_price_type", "selection_price_value"], ["place", "sku"])

    def media(self, ids: DataFrame) -> DataFrame:
        own = self.of("catalog_product_entity_media_gallery_value_to_entity", ids, "entity_id").select("value_id", "entity_id")
        shown = self.table("catalog_product_entity_media_gallery_value").filter("store_id = 0").select("value_id", "label", "position", F.col("disabled").alias("__off"))
        files = self.table("catalog_product_entity_media_gallery").select("value_id", F.col("value").alias("file"), "media_type", F.col("disabled").alias("__gone"))
        off = (F.coalesce("__gone", F.lit(0)) != 0) | (F.coalesce("__off", F.lit(0)) != 0)
        return own.join(files, "value_id").join(shown, "value_id", "left").withColumn("disabled", off)

    def skus_of(self, ids: DataFrame) -> DataFrame:
        return self.of("catalog_product_entity", ids, "entity_id").select("entity_id", "sku", "type_id")

    def products_like(self, needle: str, limit: int) -> DataFrame:
        """Products by sku, with name and status, in order of skus."""
        found = self.table("catalog_product_entity").filter(scalars.icontains(F.col("sku"), needle)).select("entity_id", "sku", "type_id")
        for name, kind in (("name", "varchar"), ("status", "int")):
            found = found.join(self.names_of("catalog_product", "catalog_product_entity", name, kind).withColumnRenamed("value", name), "entity_id", "left")
        return aggregates.limit_truncated(found, [F.asc("sku"), F.asc("entity_id")], limit)

    def product_links(self, ids: DataFrame, reverse: bool = False) -> DataFrame:
        """entity_id, kind, linked, sku, name, status, visibility, in_stock, position; reverse: who links to it."""
        mine, other = ("linked_product_id", "product_id") if reverse else ("product_id", "linked_product_id")
        kind = F.create_map(*(F.lit(x) for k, v in LINKS.items() for x in (v, k)))
        places = self.table("catalog_product_link_attribute").filter("product_link_attribute_code = 'position'").select("product_link_attribute_id", "link_type_id")
        at = self.table("catalog_product_link_attribute_int").join(places, "product_link_attribute_id").select("link_id", "link_type_id", F.col("value").alias("position"))
        rows = self.of("catalog_product_link", ids, mine, "entity_id").filter(F.col("link_type_id").isin(*LINKS.values()))
        rows = rows.join(at, ["link_id", "link_type_id"], "left").select(F.col(mine).alias("of"), F.col(other).alias("linked"), F.try_element_at(kind, F.col("link_type_id")).alias("kind"), "position")
        rows = self.skus(rows, "linked")
        for name, table in (("name", "varchar"), ("status", "int"), ("visibility", "int")):
            values = self.names_of("catalog_product", "catalog_product_entity", name, table)
            rows = rows.join(values.select(F.col("entity_id").alias("linked"), F.col("value").alias(name)), "linked", "left")
        stock = self.table("cataloginventory_stock_item").select(F.col("product_id").alias("linked"), (F.col("is_in_stock") == 1).alias("in_stock"))
        return rows.join(stock, "linked", "left").withColumnRenamed("of", "entity_id")

    def price_cards(self, ids: DataFrame) -> DataFrame:
        """Prices of products: by store, tier, rule and index, and those of what they consist of."""
        base = self.skus_of(ids)
        scope = self.table("core_config_data").filter("path = 'catalog/price/scope' AND scope = 'default'").agg(F.max("value").alias("scope"))
        sites = self.table("store_website").select("website_id", F.col("code").alias("website"))
        groups = self.table("customer_group").select("customer_group_id", F.col("customer_group_code").alias("group"))

        def named(rows: DataFrame) -> DataFrame:
            site = F.coalesce("website", F.when(F.col("website_id") == 0, "all").otherwise(F.concat(F.lit("website/"), F.col("website_id").cast("string"))))
            return rows.join(sites, "website_id", "left").join(groups, "customer_group_id", "left").withColumn("website", site).withColumn("group", F.coalesce("group", F.concat(F.lit("group/"), F.col("customer_group_id").cast("string"))))

        key = base.select("entity_id")
        cards = listed(base, "entity_id", self.product_values("catalog_product", "catalog_product_entity", key, PRICE_ATTRIBUTES), "entity_id", "values", ["attribute", "store", "value"], ["attribute", "store_id"])
        tiers = named(self.of("catalog_product_entity_tier_price", key, "entity_id")).withColumn("group", F.when(F.col("all_groups") == 1, "all groups").otherwise(F.col("group")))
        cards = listed(cards, "entity_id", tiers, "entity_id", "tiers", ["website", "group", "qty", "value", "percentage_value"], ["website_id", "customer_group_id", "qty"])
        rules = named(self.of("catalogrule_product_price", key, "product_id", "entity_id"))
        cards = listed(cards, "entity_id", rules, "product_id", "rules", ["rule_date", "website", "group", "rule_price"], ["rule_date", "website_id", "customer_group_id"])
        index = named(self.of("catalog_product_index_price", key, "entity_id"))
        cards = listed(cards, "entity_id", index, "entity_id", "index", ["website", "group", "price", "final_price", "min_price", "max_price", "tier_price"], ["website_id", "customer_group_id"])
        cards = listed(cards, "entity_id", self.component_prices(key), "parent_id", "components", ["sku", "price", "special_price", "least", "most"], ["sku"])
        dynamic = self.names_of("catalog_product", "catalog_product_entity", "price_type", "int").select(F.col("entity_id").alias("__t"), F.col("value").alias("price_type"))
        return cards.join(dynamic, F.col("entity_id") == F.col("__t"), "left").drop("__t").crossJoin(F.broadcast(scope))  # one row

    def component_prices(self, ids: DataFrame) -> DataFrame:
        parts = self.of("catalog_product_super_link", ids, "parent_id", "entity_id").select("parent_id", "product_id")
        grouped = self.of("catalog_product_link", ids, "product_id", "entity_id").filter("link_type_id = 3").select(F.col("product_id").alias("parent_id"), F.col("linked_product_id").alias("product_id"))
        bundled = self.of("catalog_product_bundle_selection", ids, "parent_product_id", "entity_id").select(F.col("parent_product_id").alias("parent_id"), "product_id")
        rows = self.skus(parts.unionByName(grouped).unionByName(bundled).distinct(), "product_id")
        for code in ("price", "special_price"):
            values = self.names_of("catalog_product", "catalog_product_entity", code, "decimal")
            rows = rows.join(values.select(F.col("entity_id").alias("product_id"), F.col("value").alias(code)), "product_id", "left")
        index = self.of("catalog_product_index_price", rows, "entity_id", "product_id").groupBy(F.col("entity_id").alias("product_id")).agg(F.min("final_price").alias("least"), F.max("final_price").alias("most"))
        return rows.join(index, "product_id", "left")

    # categories

    def category_list(self) -> DataFrame:
        """Categories in pre-order with name, whether they are active, products, and the stores that have them as root."""
        tree = self.category_tree().filter("entity_id <> 1")
        counts = self.table("catalog_category_product").groupBy(F.col("category_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("products"))
        roots = self.table("store_group").filter("group_id > 0").groupBy(F.col("root_category_id").alias("entity_id")).agg(F.array_sort(F.collect_set("name")).alias("root_of"))
        return tree.join(counts, "entity_id", "left").join(roots, "entity_id", "left").withColumn("products", F.coalesce("products", F.lit(0))).orderBy("path")

    def categories_like(self, needle: str, limit: int) -> DataFrame:
        rows = self.names_of("catalog_category", "catalog_category_entity", "name", "varchar").select("entity_id", F.col("value").alias("name"))
        return self.search(rows, needle, ["name"], [F.asc("name"), F.asc("entity_id")], limit)

    def category_cards(self, ids: DataFrame) -> DataFrame:
        base = self.of("catalog_category_entity", ids, "entity_id").select("entity_id", "path", "level", "position", "parent_id", "children_count")
        key = base.select("entity_id")
        names = self.category_paths(base.select(F.col("entity_id").alias("category_id"))).select(F.col("category_id").alias("__c"), F.col("names").alias("breadcrumb"))
        cards = base.join(names, F.col("entity_id") == F.col("__c"), "left").drop("__c")
        cards = listed(cards, "entity_id", self.product_values("catalog_category", "catalog_category_entity", key, CATEGORY_ATTRIBUTES), "entity_id", "attributes", ["attribute", "store", "value", "label"], ["attribute", "store_id"])
        cards = listed(cards, "entity_id", self.inactive_scopes(base), "entity_id", "inactive", ["scope"], ["store_id"])
        cards = listed(cards, "entity_id", self.rewrites("category", key), "entity_id", "urls", ["store", "request_path", "redirect_type"], ["store_id", "request_path"])
        cards = listed(cards, "entity_id", self.of("store_group", key, "root_category_id", "entity_id").filter("group_id > 0"), "root_category_id", "root_of", ["name"])
        return listed(cards, "entity_id", self.category_products(key), "category_id", "products", ["sku", "name", "position"], ["position", "sku"]).withColumn("assigned", F.size("products"))

    def inactive_scopes(self, base: DataFrame) -> DataFrame:
        """entity_id, store_id, scope: where a category is hidden, by itself or by one above it.

        A store sees its own value, else the default's; without a default row a category is active there.
        """
        steps = base.select("entity_id", F.explode(F.split("path", "/")).alias("step")).filter("step <> '1'").select("entity_id", F.col("step").cast("long").alias("above"))
        codes = self.attributes("catalog_category").filter("attribute_code = 'is_active'").select("attribute_id")
        values = self.table("catalog_category_entity_int").join(codes, "attribute_id", "left_semi").select(F.col("entity_id").alias("above"), "store_id", "value")
        own = steps.join(values, "above")
        stores = self.table("store").filter("store_id > 0").select("store_id").unionByName(self.spark.createDataFrame([(0,)], "store_id int"))
        default = own.filter("store_id = 0").select("entity_id", "above", F.col("value").alias("fallback"))
        seen = steps.crossJoin(F.broadcast(stores)).join(own, ["entity_id", "above", "store_id"], "left").join(default, ["entity_id", "above"], "left")  # a model's stores are few
        hidden = seen.filter(F.coalesce("value", "fallback", F.lit(1)) == 0).select("entity_id", "store_id").distinct()
        scope = F.when(F.col("store_id") == 0, "default").otherwise(F.concat(F.lit("stores/"), "store"))
        return self.with_store(hidden).withColumn("scope", scope)

    def category_products(self, ids: DataFrame) -> DataFrame:
        rows = self.skus(self.of("catalog_category_product", ids, "category_id", "entity_id").select("category_id", "product_id", "position"), "product_id")
        names = self.names_of("catalog_product", "catalog_product_entity", "name", "varchar")
        return rows.join(names.select(F.col("entity_id").alias("product_id"), F.col("value").alias("name")), "product_id", "left")

    def indexed_products(self, ids: DataFrame, store: int) -> DataFrame:
        """category_id, product_id, sku, position, is_parent, visibility, as a store's index has them."""
        rows = self.of(f"catalog_category_product_index_store{store}", ids, "category_id", "entity_id").filter(F.col("store_id") == store)
        return self.skus(rows.select("category_id", "product_id", "position", "is_parent", "visibility"), "product_id")

    # content, integrations, taxes, rules

    def cms_cards(self, kind: str, keys: DataFrame) -> DataFrame:
        """Pages or blocks by id or identifier, with their stores."""
        id_col = {"page": "page_id", "block": "block_id"}[kind]
        column = id_col if id_col in keys.columns else "identifier"
        rows = self.of(f"cms_{kind}", keys, column)
        shown = ["identifier", "title", F.col("is_active") == 1, "creation_time", "update_time", "content"]
        layout = (F.coalesce("layout_update_xml", F.lit("")) != "") | (F.coalesce("custom_layout_update_xml", F.lit("")) != "") if kind == "page" else F.lit(False)
        cards = rows.select(F.col(id_col).alias("id"), *shown[:2], shown[2].alias("active"), *shown[3:], layout.alias("own_layout"))
        stores = self.table(f"cms_{kind}_store").select(F.col(id_col).alias("__id"), "store_id")
        named = self.with_store(stores).withColumn("store", F.when(F.col("store_id") == 0, "all stores").otherwise(F.col("store")))
        return listed(cards, "id", named, "__id", "stores", ["store"], ["store_id"])

    def integrations(self) -> DataFrame:
        """Integrations with the state of their access token and the resources they may use."""
        base = self.table("integration")
        tokens = self.table("oauth_token").filter("type = 'access'").groupBy(F.col("consumer_id").alias("__c")).agg(F.max("revoked").alias("__r"))
        token = F.when(F.col("__c").isNull(), "none").when(F.col("__r") != 0, "revoked").otherwise("active")
        cards = base.join(tokens, F.col("consumer_id") == F.col("__c"), "left").select("integration_id", "name", "email", "endpoint", (F.col("status") == 1).alias("active"), "created_at", "updated_at", token.alias("token"))
        roles = self.table("authorization_role").filter("user_type = '1'").select("role_id", F.col("user_id").alias("of"))
        allowed = self.table("authorization_rule").filter("permission = 'allow'").join(roles, "role_id")
        return listed(cards, "integration_id", allowed, "of", "resources", ["resource_id"]).withColumn("everything", F.exists("resources", lambda r: F.endswith(r["resource_id"], F.lit("::all")))).orderBy("name")

    def credentials(self, ids: DataFrame) -> DataFrame:
        """Consumer and access token of integrations; secrets as they are stored."""
        tokens = self.table("oauth_token").filter("type = 'access'").select(F.col("consumer_id").alias("__t"), "token", F.col("secret").alias("token_secret"), "revoked")
        consumers = self.table("oauth_consumer").select(F.col("entity_id").alias("__c"), "key", "secret")
        return self.of("integration", ids, "integration_id").join(consumers, F.col("consumer_id") == F.col("__c")).join(tokens, F.col("consumer_id") == F.col("__t"), "left").select("integration_id", "key", "secret", "token", "token_secret", "revoked")

    def tax_rates(self) -> DataFrame:
        region = self.table("directory_country_region").select("region_id", F.col("code").alias("region"))
        rows = self.table("tax_calculation_rate").join(region, F.col("tax_region_id") == F.col("region_id"), "left")
        postcode = F.when(F.col("zip_is_range") == 1, F.concat_ws("-", F.col("zip_from").cast("string"), F.col("zip_to").cast("string"))).otherwise(F.col("tax_postcode"))
        return rows.select("tax_calculation_rate_id", "code", F.col("tax_country_id").alias("country"), "region", postcode.alias("postcode"), "rate").orderBy("country", "code")

    def tax_rules(self) -> DataFrame:
        """Rules with their rates and the customer and product classes, each sorted and distinct."""
        names = self.table("tax_class").select("class_id", "class_name")
        parts = self.table("tax_calculation")
        cards = self.table("tax_calculation_rule").select("tax_calculation_rule_id", "code", "priority", "position", "calculate_subtotal")
        rates = self.table("tax_calculation_rate").select("tax_calculation_rate_id", F.col("code").alias("rate"))
        cards = listed(cards, "tax_calculation_rule_id", parts.join(rates, "tax_calculation_rate_id").select(F.col("tax_calculation_rule_id").alias("of"), "rate").distinct(), "of", "rates", ["rate"])
        for side in ("customer", "product"):
            rows = parts.join(names, F.col(f"{side}_tax_class_id") == F.col("class_id")).select(F.col("tax_calculation_rule_id").alias("of"), "class_name").distinct()
            cards = listed(cards, "tax_calculation_rule_id", rows, "of", f"{side}_classes", ["class_name"])
        return cards.orderBy("priority", "position", "tax_calculation_rule_id")

    def rule_scopes(self, cards: DataFrame, table: str) -> DataFrame:
        sites = self.table(f"{table}_website").join(self.table("store_website").select("website_id", F.col("code").alias("website")), "website_id").withColumnRenamed("rule_id", "of")
        groups = self.table(f"{table}_customer_group").join(self.table("customer_group").select("customer_group_id", F.col("customer_group_code").alias("group")), "customer_group_id").withColumnRenamed("rule_id", "of")
        return listed(listed(cards, "rule_id", sites, "of", "websites", ["website"]), "rule_id", groups, "of", "groups", ["group"], ["customer_group_id"])

    def in_date(self, today: Column) -> Column:
        return F.coalesce(F.col("from_date") <= today, F.lit(True)) & F.coalesce(F.col("to_date") >= today, F.lit(True))

    def catalog_rule_cards(self, ids: DataFrame, today: Column) -> DataFrame:
        rows = self.of("catalogrule", ids, "rule_id").withColumn("in_date", self.in_date(today)).withColumn("active", F.col("is_active") == 1)
        counts = self.table("catalogrule_product").groupBy(F.col("rule_id").alias("__r")).agg(F.countDistinct("product_id").alias("products"))
        cards = rows.join(counts, F.col("rule_id") == F.col("__r"), "left").drop("__r", "is_active").withColumn("products", F.coalesce("products", F.lit(0)))
        return self.rule_scopes(cards, "catalogrule")

    def catalog_rules_like(self, needle: str, limit: int) -> DataFrame:
        """Rules by name or description with their numbers of distinct products, 0 kept."""
        hit = scalars.icontains(F.col("name"), needle) | F.coalesce(scalars.icontains(F.col("description"), needle), F.lit(False))
        counts = self.table("catalogrule_product").groupBy("rule_id").agg(F.countDistinct("product_id").alias("products"))
        rows = self.table("catalogrule").filter(hit).select("rule_id", "name", "is_active", "from_date", "to_date").join(counts, "rule_id", "left")
        return aggregates.limit_truncated(rows.withColumn("products", F.coalesce("products", F.lit(0))), [F.asc("rule_id")], limit)

    def sales_rule_cards(self, ids: DataFrame, today: Column, coupons: int = 10) -> DataFrame:
        """Cart rules with their first coupons by id and the number of all."""
        rows = self.of("salesrule", ids, "rule_id").withColumn("in_date", self.in_date(today)).withColumn("active", F.col("is_active") == 1).drop("is_active")
        codes = self.of("salesrule_coupon", ids, "rule_id").withColumn("expired", F.coalesce(F.col("expiration_date") < today.cast("timestamp"), F.lit(False))).withColumnRenamed("rule_id", "of")
        first = graph.rank_within(codes, ["of"], [F.asc("coupon_id")], coupons).withColumnRenamed("times_used", "used")
        cards = listed(rows, "rule_id", first, "of", "coupons", ["code", "used", "usage_limit", "expired"], ["coupon_id"])
        counts = codes.groupBy(F.col("of").alias("__o")).agg(F.count(F.lit(1)).alias("coupon_count"))
        cards = cards.join(counts, F.col("rule_id") == F.col("__o"), "left").drop("__o").withColumn("coupon_count", F.coalesce("coupon_count", F.lit(0)))
        return self.rule_scopes(cards, "salesrule")

    def rules_of_coupons(self, codes: DataFrame) -> DataFrame:
        """code, rule_id."""
        return self.of("salesrule_coupon", codes, "code").select("code", "rule_id")

    # sales

    def document_cards(self, kind: str, keys: DataFrame) -> DataFrame:
        """Invoices, shipments or credit memos by their numbers, with order, totals, items and tracks."""
        rows = self.of(f"sales_{kind}", keys, "increment_id")
        names = ["entity_id", "increment_id", "order_id", "created_at"]
        amounts = ["total_qty"] if kind == "shipment" else ["state", "order_currency_code", "subtotal", "tax_amount", "shipping_amount", "grand_total"]
        amounts += {"invoice": ["transaction_id"], "creditmemo": ["adjustment_positive", "adjustment_negative"]}.get(kind, [])
        orders = self.table("sales_order").select(F.col("entity_id").alias("__o"), F.col("increment_id").alias("order_increment"), F.col("status").alias("order_status"))
        cards = rows.select(*names, *amounts).join(orders, F.col("order_id") == F.col("__o"), "left").drop("__o")
        shown = ["sku", "name", "qty"] + ([] if kind == "shipment" else ["price", "row_total"])
        key = cards.select("entity_id")
        items = self.of(f"sales_{kind}_item", key, "parent_id", "entity_id").withColumn("qty", F.coalesce("qty", F.lit(0))).withColumnRenamed("entity_id", "item_id")
        cards = listed(cards, "entity_id", items, "parent_id", "items", shown, ["item_id"])
        if kind == "shipment":
            tracks = self.of("sales_shipment_track", key, "parent_id", "entity_id").withColumnRenamed("entity_id", "track_id")
            cards = listed(cards, "entity_id", tracks, "parent_id", "tracks", ["carrier_code", "title", "track_number"], ["track_id"])
        return cards

    def documents_like(self, kind: str, needle: str, limit: int) -> DataFrame:
        amount = "total_qty" if kind == "shipment" else "grand_total"
        orders = self.table("sales_order").select(F.col("entity_id").alias("__o"), F.col("increment_id").alias("order_increment"))
        rows = self.table(f"sales_{kind}").filter(scalars.icontains(F.col("increment_id"), needle)).join(orders, F.col("order_id") == F.col("__o"), "left")
        return aggregates.limit_truncated(rows.select("entity_id", "increment_id", "order_increment", "created_at", F.col(amount).alias("amount")), [F.desc("entity_id")], limit)

    def quote_cards(self, ids: DataFrame, now: Column) -> DataFrame:
        base = self.of("quote", ids, "entity_id")
        shown = ["entity_id", "store_id", "created_at", "updated_at", "converted_at", "customer_id", "customer_email", "checkout_method", "quote_currency_code", "items_qty", "coupon_code", "reserved_order_id", "subtotal", "grand_total"]
        flags = [(F.coalesce(c, F.lit(0)) != 0).alias(n) for c, n in (("is_active", "active"), ("customer_is_guest", "guest"), ("is_virtual", "virtual"))]
        cards = self.with_store(base.select(*shown, *flags, F.timestamp_diff("SECOND", F.col("updated_at"), now).alias("updated_seconds"), F.concat_ws(" ", "customer_firstname", "customer_lastname").alias("customer")), fallback=False).drop("store_id")
        key = cards.select("entity_id")
        orders = self.of("sales_order", key, "quote_id", "entity_id").select("quote_id", F.col("increment_id").alias("order_increment"))
        cards = one(cards, "entity_id", orders, "quote_id", ["order_increment"])
        items = self.of("quote_item", key, "quote_id", "entity_id").withColumn("child", F.col("parent_item_id").isNotNull()).withColumn("qty", F.coalesce("qty", F.lit(0)))
        cards = listed(cards, "entity_id", items, "quote_id", "items", ["sku", "name", "product_type", "child", "qty", "price", "row_total", "discount_amount"], ["item_id"])
        addresses = self.of("quote_address", key, "quote_id", "entity_id")
        cards = listed(cards, "entity_id", addresses, "quote_id", "addresses", ["address_type", "firstname", "lastname", "street", "postcode", "city", "country_id", "shipping_method"], ["address_type", "address_id"])
        shipping = addresses.filter("address_type = 'shipping'")
        cards = one(cards, "entity_id", shipping, "quote_id", ["shipping_amount", "tax_amount", "discount_amount"])
        paid = self.of("quote_payment", key, "quote_id", "entity_id").select("quote_id", F.col("method").alias("payment_method"))
        return one(cards, "entity_id", paid, "quote_id", ["payment_method"])

    def quotes_like(self, needle: str, limit: int) -> DataFrame:
        rows = self.table("quote").select("entity_id", (F.col("is_active") != 0).alias("active"), "customer_email", "items_qty", "grand_total", "quote_currency_code", "updated_at")
        return self.search(rows, needle, ["customer_email"], [F.desc("entity_id")], limit)

    def customer_cards(self, keys: DataFrame, now: Column) -> DataFrame:
        """Customers by id or mail, with addresses, newsletters, attributes and their orders."""
        column = "entity_id" if "entity_id" in keys.columns else "email"
        groups = self.table("customer_group").select("customer_group_id", F.col("customer_group_code").alias("group"))
        sites = self.table("store_website").select(F.col("website_id").alias("__w"), F.col("code").alias("website"))
        rows = self.of("customer_entity", keys, column).join(groups, F.col("group_id") == F.col("customer_group_id"), "left").join(sites, F.col("website_id") == F.col("__w"), "left")
        locked = F.coalesce(F.col("lock_expires") > now, F.lit(False)).alias("locked")
        cards = rows.select("entity_id", "email", F.concat_ws(" ", "firstname", "lastname").alias("name"), "group", "website", "created_in", "created_at", (F.col("is_active") == 1).alias("active"), F.col("confirmation").isNull().alias("confirmed"), locked, "failures_num", "default_billing", "default_shipping")
        key = cards.select("entity_id")
        homes = self.of("customer_address_entity", key, "parent_id", "entity_id").withColumnRenamed("entity_id", "address_id")
        cards = listed(cards, "entity_id", homes, "parent_id", "addresses", ["address_id", "firstname", "lastname", "street", "postcode", "city", "country_id", "telephone"], ["address_id"])
        tagged = F.transform("addresses", lambda a: a.withField("billing", a["address_id"].eqNullSafe(F.col("default_billing"))).withField("shipping", a["address_id"].eqNullSafe(F.col("default_shipping"))))
        cards = cards.withColumn("addresses", tagged).drop("default_billing", "default_shipping")
        cards = one(cards, "entity_id", self.of("customer_log", key, "customer_id", "entity_id"), "customer_id", ["last_login_at", "last_logout_at"])
        by_id = self.of("newsletter_subscriber", key, "customer_id", "entity_id").select("subscriber_id", F.col("customer_id").alias("of"), "store_id", "subscriber_status")
        mails = cards.select(F.col("email").alias("subscriber_email"), F.col("entity_id").alias("of"))
        by_mail = self.table("newsletter_subscriber").join(mails, "subscriber_email").select("subscriber_id", "of", "store_id", "subscriber_status")
        cards = listed(cards, "entity_id", self.with_store(by_id.unionByName(by_mail).distinct()), "of", "newsletter", ["store", "subscriber_status"], ["store_id", "subscriber_id"])
        kinds = [self.of(f"customer_entity_{k}", key, "entity_id").select("entity_id", "attribute_id", F.col("value").cast("string").alias("value")) for k in ("varchar", "int", "decimal", "datetime", "text")]
        codes = self.table("eav_attribute").select("attribute_id", F.col("attribute_code").alias("attribute"))
        cards = listed(cards, "entity_id", reduce(DataFrame.unionByName, kinds).join(codes, "attribute_id").withColumnRenamed("entity_id", "of"), "of", "attributes", ["attribute", "value"])
        return self.order_stats(cards)

    def order_stats(self, cards: DataFrame) -> DataFrame:
        """cards (entity_id, email) with orders, spent, first_order, last_order, last_increment, last_status and guest_orders."""
        orders = self.table("sales_order")
        latest = F.max_by(F.struct("increment_id", "status"), "entity_id")
        stats = orders.join(cards.select(F.col("entity_id").alias("customer_id")), "customer_id", "left_semi").groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("base_grand_total").alias("spent"), F.min("created_at").alias("first_order"), F.max("created_at").alias("last_order"), latest.alias("__l")
        )
        mine = cards.select(F.col("entity_id").alias("__id"), F.col("email").alias("customer_email"))
        guests = orders.join(mine, "customer_email").filter(F.col("customer_id").isNull() | (F.col("customer_id") != F.col("__id"))).groupBy("__id").agg(F.count(F.lit(1)).alias("guest_orders"))
        joined = cards.join(stats, F.col("entity_id") == F.col("customer_id"), "left").drop("customer_id").join(guests, F.col("entity_id") == F.col("__id"), "left").drop("__id")
        filled = joined.withColumn("orders", F.coalesce("orders", F.lit(0))).withColumn("guest_orders", F.coalesce("guest_orders", F.lit(0)))
        return filled.withColumn("last_increment", F.col("__l.increment_id")).withColumn("last_status", F.col("__l.status")).drop("__l")

    def order_cards(self, keys: DataFrame) -> DataFrame:
        """Orders by id or number, with everything that was done with them."""
        column = "entity_id" if "entity_id" in keys.columns else "increment_id"
        labels = self.table("sales_order_status").select(F.col("status").alias("__s"), F.col("label").alias("status_label"))
        rows = self.of("sales_order", keys, column).join(labels, F.col("status") == F.col("__s"), "left").drop("__s")
        names = ["entity_id", "increment_id", "state", "status", "status_label", "store_id", "created_at", "updated_at", "customer_id", "customer_email", "base_currency_code", "order_currency_code", "coupon_code", "shipping_method", "total_qty_ordered", "quote_id"]
        totals = F.array(*(F.struct(F.lit(t).alias("total"), F.col(t).alias("amount"), F.col(f"base_{t}").alias("base")) for t in TOTALS))
        guest = (F.coalesce("customer_is_guest", F.lit(0)) != 0).alias("guest")
        amounts = [f"{p}{t}" for t in TOTALS for p in ("", "base_")]  # plain until the last join: an array of structs is twice as long
        cards = self.with_store(rows.select(*names, F.concat_ws(" ", "customer_firstname", "customer_lastname").alias("customer"), guest, *amounts), fallback=False).drop("store_id")
        key = keys if column == "entity_id" else cards.select("entity_id")  # the joins drop what has no order
        zero = [F.coalesce(f"qty_{q}", F.lit(0)).alias(f"qty_{q}") for q in ("ordered", "invoiced", "shipped", "refunded", "canceled")]
        items = self.of("sales_order_item", key, "order_id", "entity_id").select("order_id", "item_id", "sku", "name", "product_type", F.col("parent_item_id").isNotNull().alias("child"), *zero, "price", "row_total")
        cards = listed(cards, "entity_id", items, "order_id", "items", [c for c in items.columns if c not in ("order_id", "item_id")], ["item_id"])
        homes = self.of("sales_order_address", key, "parent_id", "entity_id").withColumnRenamed("entity_id", "address_id")
        cards = listed(cards, "entity_id", homes, "parent_id", "addresses", ["address_type", "firstname", "lastname", "street", "postcode", "city", "country_id", "telephone"], ["address_type", "address_id"])
        paid = self.of("sales_order_payment", key, "parent_id", "entity_id").select("parent_id", F.col("method").alias("payment_method"), "last_trans_id", "additional_information")
        cards = one(cards, "entity_id", paid, "parent_id", ["payment_method", "last_trans_id", "additional_information"])
        moved = self.of("sales_payment_transaction", key, "order_id", "entity_id").withColumn("closed", F.col("is_closed") != 0)
        cards = listed(cards, "entity_id", moved, "order_id", "transactions", ["txn_id", "txn_type", "closed", "created_at"], ["transaction_id"])
        for kind in DOCUMENTS:
            shown = ["increment_id", "total_qty", "created_at"] if kind == "shipment" else ["increment_id", "state", "grand_total", "created_at"]
            papers = self.of(f"sales_{kind}", key, "order_id", "entity_id").withColumnRenamed("entity_id", "document_id")
            cards = listed(cards, "entity_id", papers, "order_id", f"{kind}s", shown, ["document_id"])
        tracks = self.of("sales_shipment_track", key, "order_id", "entity_id").withColumnRenamed("entity_id", "track_id")
        cards = listed(cards, "entity_id", tracks, "order_id", "tracks", ["carrier_code", "title", "track_number"], ["track_id"])
        said = self.of("sales_order_status_history", key, "parent_id", "entity_id").withColumnRenamed("entity_id", "history_id").withColumn("notified", F.coalesce("is_customer_notified", F.lit(0)) != 0)
        cards = listed(cards, "entity_id", said.select("parent_id", "history_id", "status", "comment", "created_at", "notified"), "parent_id", "history", ["status", "comment", "created_at", "notified"], ["history_id"])
        grid = self.of("sales_order_grid", key, "entity_id").select(F.col("entity_id").alias("__g")).distinct()
        return cards.join(grid, F.col("entity_id") == F.col("__g"), "left").withColumn("in_grid", F.col("__g").isNotNull()).withColumn("totals", totals).drop("__g", *amounts)

    # attributes, scopes and what else one row says

    def attribute_cards(self, entity: str) -> DataFrame:
        """Attributes with their catalogue flags, the sets and groups they are in, and their options in order."""
        flags = ["is_global", "is_searchable", "is_filterable", "is_comparable", "used_in_product_listing", "used_for_sort_by", "is_visible_on_front"]
        more = self.table("catalog_eav_attribute").select("attribute_id", *flags)
        cards = self.attributes(entity).join(more, "attribute_id", "left")
        sets = self.table("eav_entity_attribute").join(self.table("eav_attribute_set").select("attribute_set_id", "attribute_set_name"), "attribute_set_id").join(self.table("eav_attribute_group").select("attribute_group_id", "attribute_group_name"), "attribute_group_id")
        cards = listed(cards, "attribute_id", sets.withColumnRenamed("attribute_id", "of"), "of", "sets", ["attribute_set_name", "attribute_group_name"])
        return listed(cards, "attribute_id", self.option_labels().withColumnRenamed("attribute_id", "of"), "of", "options", ["label"], ["sort_order", "label"])

    def set_count(self, entity: str) -> DataFrame:
        kinds = self.table("eav_entity_type").filter(F.col("entity_type_code") == entity)
        return self.table("eav_attribute_set").join(kinds, "entity_type_id", "left_semi").agg(F.count(F.lit(1)).alias("sets"))

    def scope_counts(self) -> DataFrame:
        """websites, groups, stores, without the administration's."""
        counts = [self.table(t).filter(F.col(c) > 0).agg(F.count(F.lit(1)).alias(n)) for t, c, n in (("store_website", "website_id", "websites"), ("store_group", "group_id", "groups"), ("store", "store_id", "stores"))]
        return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each

    def last_success(self, now: Column) -> DataFrame:
        """seconds since a job last ended well; null if none did."""
        return self.table("cron_schedule").filter("status = 'success'").agg(F.timestamp_diff("SECOND", F.max("finished_at"), now).alias("seconds"))

    def themes(self) -> DataFrame:
        parents = self.table("theme").select(F.col("theme_id").alias("__p"), F.col("theme_path").alias("parent"))
        return self.table("theme").join(parents, F.col("parent_id") == F.col("__p"), "left").select("theme_id", "area", F.col("theme_path").alias("theme"), "parent")

    def translations_like(self, locale: str, needle: str) -> DataFrame:
        rows = self.table("translation").filter((F.col("locale") == locale) & scalars.icontains(F.col("string"), needle))
        return self.with_store(rows.select("string", "translate", "store_id"))

    def currency_rates(self) -> DataFrame:
        return self.table("directory_currency_rate").select("currency_from", "currency_to", "rate").orderBy("currency_from", "currency_to")
