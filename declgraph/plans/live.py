"""Queries over a store's operational tables.

Tables come from a function of their name: Parquet snapshots or JDBC. A table
that isn't there is an empty one with the columns that are read. Time is a
parameter, never the clock of the machine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, graph

#: Columns that are read, in the tables' own names.
COLUMNS = {
    "store": "store_id int, code string, name string, website_id int, group_id int, is_active int",
    "store_group": "group_id int, name string, website_id int, root_category_id int",
    "store_website": "website_id int, code string, name string, is_default int",
    "customer_group": "customer_group_id int, customer_group_code string, tax_class_id int",
    "tax_class": "class_id int, class_name string",
    "customer_entity": "entity_id int, email string, firstname string, lastname string, group_id int, website_id int, created_in string, created_at timestamp, is_active int, confirmation string, lock_expires timestamp, failures_num int, default_billing int, default_shipping int",
    "sales_order": "entity_id long, increment_id string, status string, state string, store_id int, created_at timestamp, updated_at timestamp, customer_id int, customer_email string, customer_firstname string, customer_lastname string, customer_is_guest int, base_currency_code string, order_currency_code string, coupon_code string, shipping_method string, total_qty_ordered decimal(12,4), quote_id long, "
    + ", ".join(f"{p}{t} decimal(20,4)" for t in ("subtotal", "shipping_amount", "tax_amount", "discount_amount", "grand_total", "total_paid", "total_refunded", "total_due") for p in ("", "base_")),
    "sales_order_payment": "parent_id long, method string, last_trans_id string, po_number string, additional_information string",
    "sales_payment_transaction": "transaction_id long, order_id long, txn_id string, txn_type string, is_closed int, created_at timestamp",
    "sales_order_status": "status string, label string",
    "sales_order_status_state": "status string, state string, is_default int, visible_on_front int",
    "sales_sequence_meta": "meta_id int, entity_type string, store_id int, sequence_table string",
    "sales_sequence_profile": "meta_id int, prefix string, suffix string, start_value long, step long, max_value long, warning_value long, is_active int",
    "url_rewrite": "url_rewrite_id long, entity_type string, entity_id long, request_path string, target_path string, redirect_type int, store_id int, description string, is_autogenerated int",
    "cron_schedule": "schedule_id long, job_code string, status string, messages string, scheduled_at timestamp, executed_at timestamp, finished_at timestamp",
    "queue": "id int, name string",
    "queue_message_status": "id long, queue_id int, status int, updated_at timestamp",
    "indexer_state": "indexer_id string, status string, updated timestamp",
    "mview_state": "view_id string, mode string, status string, version_id long",
    "admin_user": "user_id int, username string, email string, is_active int, created timestamp, logdate timestamp, lock_expires timestamp",
    "authorization_role": "role_id int, parent_id int, role_type string, user_type string, user_id int, role_name string",
    "authorization_rule": "role_id int, resource_id string, permission string",
    "eav_entity_type": "entity_type_id int, entity_type_code string",
    "eav_attribute": "attribute_id int, entity_type_id int, attribute_code string, backend_type string, frontend_input string, frontend_label string, is_required int",
    "catalog_category_entity": "entity_id int, parent_id int, path string, level int, position int, children_count int",
    "catalog_product_entity": "entity_id int, sku string, type_id string, attribute_set_id int, created_at timestamp, updated_at timestamp",
    "cms_page": "page_id int, identifier string, title string, is_active int, creation_time timestamp, update_time timestamp, layout_update_xml string, custom_layout_update_xml string, content string",
    "cms_block": "block_id int, identifier string, title string, is_active int, creation_time timestamp, update_time timestamp, content string",
    "salesrule": "rule_id int, name string, description string, is_active int, from_date date, to_date date, sort_order int",
    "salesrule_coupon": "coupon_id int, rule_id int, code string, times_used int, usage_limit int, expiration_date timestamp",
    "core_config_data": "scope string, scope_id int, path string, value string",
    "catalog_product_website": "product_id int, website_id int",
    "catalog_product_super_link": "link_id int, product_id int, parent_id int",
    "catalog_product_super_attribute": "product_id int, attribute_id int, position int",
    "catalog_product_link": "link_id int, product_id int, linked_product_id int, link_type_id int",
    "catalog_product_link_attribute": "product_link_attribute_id int, link_type_id int, product_link_attribute_code string",
    "catalog_product_link_attribute_int": "product_link_attribute_id int, link_id int, value int",
    "catalog_product_link_attribute_decimal": "product_link_attribute_id int, link_id int, value decimal(20,4)",
    "catalog_product_bundle_option": "option_id int, parent_id int, required int, position int, type string",
    "catalog_product_bundle_option_value": "option_id int, store_id int, title string",
    "catalog_product_bundle_selection": "option_id int, parent_product_id int, product_id int, position int, is_default int, selection_price_type int, selection_price_value decimal(20,4), selection_qty decimal(20,4)",
    "catalog_product_entity_media_gallery": "value_id int, value string, media_type string, disabled int",
    "catalog_product_entity_media_gallery_value": "value_id int, store_id int, label string, position int, disabled int",
    "catalog_product_entity_media_gallery_value_to_entity": "value_id int, entity_id int",
    "catalog_product_entity_tier_price": "entity_id int, website_id int, all_groups int, customer_group_id int, qty decimal(20,4), value decimal(20,4), percentage_value decimal(20,4)",
    "catalog_product_index_price": "entity_id int, customer_group_id int, website_id int, price decimal(20,4), final_price decimal(20,4), min_price decimal(20,4), max_price decimal(20,4), tier_price decimal(20,4)",
    "catalogrule_product_price": "product_id int, rule_date date, customer_group_id int, website_id int, rule_price decimal(20,4)",
    "catalog_category_product": "category_id int, product_id int, position int",
    "cataloginventory_stock_item": "product_id int, qty decimal(20,4), is_in_stock int, manage_stock int",
    "inventory_source_item": "sku string, source_code string, quantity decimal(20,4), status int",
    "eav_attribute_set": "attribute_set_id int, entity_type_id int, attribute_set_name string",
    "eav_attribute_group": "attribute_group_id int, attribute_group_name string",
    "eav_entity_attribute": "attribute_id int, attribute_set_id int, attribute_group_id int",
    "eav_attribute_option": "option_id int, attribute_id int, sort_order int",
    "eav_attribute_option_value": "option_id int, store_id int, value string",
    "catalog_eav_attribute": "attribute_id int, is_global int, is_searchable int, is_filterable int, is_comparable int, used_in_product_listing int, used_for_sort_by int, is_visible_on_front int",
    "cms_page_store": "page_id int, store_id int",
    "cms_block_store": "block_id int, store_id int",
    "integration": "integration_id int, name string, email string, endpoint string, status int, consumer_id int, created_at timestamp, updated_at timestamp",
    "oauth_consumer": "entity_id int, key string, secret string",
    "oauth_token": "consumer_id int, type string, token string, secret string, revoked int",
    "directory_country_region": "region_id int, code string",
    "directory_currency_rate": "currency_from string, currency_to string, rate decimal(24,12)",
    "tax_calculation_rate": "tax_calculation_rate_id int, code string, tax_country_id string, tax_region_id int, tax_postcode string, zip_is_range int, zip_from int, zip_to int, rate decimal(12,4)",
    "tax_calculation_rule": "tax_calculation_rule_id int, code string, priority int, position int, calculate_subtotal int",
    "tax_calculation": "tax_calculation_rule_id int, tax_calculation_rate_id int, customer_tax_class_id int, product_tax_class_id int",
    "catalogrule": "rule_id int, name string, description string, is_active int, from_date date, to_date date, simple_action string, discount_amount decimal(20,4), sort_order int, stop_rules_processing int, conditions_serialized string",
    "catalogrule_website": "rule_id int, website_id int",
    "catalogrule_customer_group": "rule_id int, customer_group_id int",
    "catalogrule_product": "rule_id int, product_id int",
    "salesrule_website": "rule_id int, website_id int",
    "salesrule_customer_group": "rule_id int, customer_group_id int",
    "sales_order_item": "item_id long, order_id long, parent_item_id long, sku string, name string, product_type string, qty_ordered decimal(12,4), qty_invoiced decimal(12,4), qty_shipped decimal(12,4), qty_refunded decimal(12,4), qty_canceled decimal(12,4), price decimal(20,4), row_total decimal(20,4)",
    "sales_order_address": "entity_id long, parent_id long, address_type string, firstname string, lastname string, street string, postcode string, city string, country_id string, telephone string",
    "sales_order_status_history": "entity_id long, parent_id long, status string, comment string, created_at timestamp, is_customer_notified int",
    "sales_order_grid": "entity_id long",
    "sales_invoice": "entity_id long, increment_id string, order_id long, state int, order_currency_code string, transaction_id string, subtotal decimal(20,4), tax_amount decimal(20,4), shipping_amount decimal(20,4), grand_total decimal(20,4), created_at timestamp",
    "sales_creditmemo": "entity_id long, increment_id string, order_id long, state int, order_currency_code string, subtotal decimal(20,4), tax_amount decimal(20,4), shipping_amount decimal(20,4), grand_total decimal(20,4), adjustment_positive decimal(20,4), adjustment_negative decimal(20,4), created_at timestamp",
    "sales_shipment": "entity_id long, increment_id string, order_id long, total_qty decimal(12,4), created_at timestamp",
    "sales_invoice_item": "entity_id long, parent_id long, sku string, name string, qty decimal(12,4), price decimal(20,4), row_total decimal(20,4)",
    "sales_creditmemo_item": "entity_id long, parent_id long, sku string, name string, qty decimal(12,4), price decimal(20,4), row_total decimal(20,4)",
    "sales_shipment_item": "entity_id long, parent_id long, sku string, name string, qty decimal(12,4)",
    "sales_shipment_track": "entity_id long, parent_id long, order_id long, carrier_code string, title string, track_number string",
    "quote": "entity_id long, is_active int, store_id int, created_at timestamp, updated_at timestamp, converted_at timestamp, customer_id int, customer_email string, customer_firstname string, customer_lastname string, customer_is_guest int, checkout_method string, quote_currency_code string, items_qty decimal(12,4), is_virtual int, coupon_code string, reserved_order_id string, subtotal decimal(20,4), grand_total decimal(20,4)",
    "quote_item": "item_id long, quote_id long, parent_item_id long, sku string, name string, product_type string, qty decimal(12,4), price decimal(20,4), row_total decimal(20,4), discount_amount decimal(20,4)",
    "quote_address": "address_id long, quote_id long, address_type string, firstname string, lastname string, street string, postcode string, city string, country_id string, shipping_method string, shipping_amount decimal(20,4), tax_amount decimal(20,4), discount_amount decimal(20,4)",
    "quote_payment": "quote_id long, method string",
    "customer_address_entity": "entity_id int, parent_id int, firstname string, lastname string, street string, postcode string, city string, country_id string, telephone string",
    "customer_log": "customer_id int, last_login_at timestamp, last_logout_at timestamp",
    "newsletter_subscriber": "subscriber_id int, customer_id int, subscriber_email string, store_id int, subscriber_status int",
    "theme": "theme_id int, parent_id int, theme_path string, area string",
    "translation": "string string, translate string, store_id int, locale string",
    "setup_module": "module string, schema_version string, data_version string",
    "patch_list": "patch_name string",
}
EAV_TYPES = ("varchar", "int", "decimal", "text", "datetime")


class Live:
    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame | None]):
        self.spark, self.read = spark, read

    def table(self, name: str) -> DataFrame:
        found = self.read(name)
        if found is not None:
            return found
        columns = COLUMNS.get(name) or ("entity_id int, attribute_id int, store_id int, value string" if name.rpartition("_")[2] in EAV_TYPES else "entity_id long, version_id long")
        return self.spark.createDataFrame([], columns)

    def search(self, df: DataFrame, needle: str, columns: list[str], order: list[Column], limit: int) -> DataFrame:
        """Rows with the needle in one of the columns, whatever its case, and whether there are more."""
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(scalars.icontains(F.col(c), needle), F.lit(False))
        return aggregates.limit_truncated(df.filter(hit), order, limit)

    # stores

    def store_tree(self) -> DataFrame:
        """Websites with their groups and these with their stores; what is empty stays."""
        site = self.table("store_website").select("website_id", F.col("code").alias("website"), "is_default")
        group = self.table("store_group").select("group_id", F.col("name").alias("group"), F.col("website_id").alias("__w"), "root_category_id")
        store = self.table("store").select("store_id", F.col("code").alias("store"), F.col("group_id").alias("__g"), "is_active")
        joined = site.join(group, F.col("website_id") == F.col("__w"), "left").join(store, F.col("group_id") == F.col("__g"), "left")
        return joined.drop("__w", "__g").orderBy("website_id", F.col("group_id").asc_nulls_last(), F.col("store_id").asc_nulls_last())

    def customer_groups(self) -> DataFrame:
        members = self.table("customer_entity").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
        groups = self.table("customer_group").join(self.table("tax_class"), F.col("tax_class_id") == F.col("class_id"), "left")
        joined = groups.join(members, F.col("customer_group_id") == F.col("group_id"), "left")
        return joined.select("customer_group_id", "customer_group_code", "class_name", F.coalesce("n", F.lit(0)).alias("customers"))

    def sequences(self, last: Callable[[str], DataFrame] | None = None) -> DataFrame:
        """Number ranges with the number that comes next."""
        rows = self.table("sales_sequence_meta").join(self.table("sales_sequence_profile").filter("is_active = 1"), "meta_id")
        used = None
        for name in sorted(r[0] for r in rows.select("sequence_table").distinct().collect()):  # a few tables, by nature of the model
            found = (last or self.read)(name)
            if found is not None:
                one = found.agg(F.max("sequence_value").alias("used")).withColumn("sequence_table", F.lit(name))
                used = one if used is None else used.unionByName(one)
        if used is None:
            used = self.spark.createDataFrame([], "used long, sequence_table string")
        following = F.coalesce(F.col("used") + F.col("step"), F.col("start_value"))
        number = scalars.sequence_number(F.coalesce("prefix", F.lit("")), following, F.coalesce("suffix", F.lit("")))
        return rows.join(used, "sequence_table", "left").select("entity_type", "store_id", number.alias("next"), (following >= F.col("warning_value")).alias("warns"))

    # operations

    def cron(self, now: Column) -> DataFrame:
        """Counts by status of each job, its last run and the seconds since; ties go to the later schedule."""
        runs = self.table("cron_schedule")
        counts = aggregates.status_pivot(runs, ["job_code"], "status", ("pending", "running", "success", "missed", "error"))
        last = aggregates.latest_by(runs.filter("executed_at IS NOT NULL"), ["job_code"], ["executed_at", "schedule_id"], ["schedule_id", "status", "messages", "executed_at"])
        age = F.timestamp_diff("SECOND", F.col("executed_at"), now)
        return counts.join(last.withColumnRenamed("status", "last_status"), "job_code", "left").withColumn("seconds_ago", age)

    def cron_history(self, job: str, limit: int) -> DataFrame:
        """The job's runs, less those that wait, the latest first: by their run or else their plan."""
        runs = self.table("cron_schedule").filter((F.col("job_code") == job) & (F.col("status") != "pending"))
        return runs.orderBy(F.desc(F.coalesce("executed_at", "scheduled_at")), F.desc("schedule_id")).limit(limit)

    def last_errors(self) -> DataFrame:
        return self.table("cron_schedule").filter("status = 'error'").groupBy("job_code").agg(F.max_by("messages", "schedule_id").alias("last_error"))

    def next_runs(self) -> DataFrame:
        return self.table("cron_schedule").filter("status = 'pending'").groupBy("job_code").agg(F.min("scheduled_at").alias("next_run"))

    def queue_backlog(self, known: DataFrame, now: Column) -> DataFrame:
        """Messages of each queue by state; queues that only one side knows stay. known: queue."""
        states = {2: "new", 3: "in_progress", 4: "complete", 5: "retry", 6: "error", 7: "to_be_deleted"}
        messages = self.table("queue_message_status")
        counts = messages.groupBy("queue_id").agg(*(F.count(F.when(F.col("status") == k, 1)).alias(v) for k, v in states.items()), F.min(F.when(F.col("status").isin(2, 5), F.col("updated_at"))).alias("oldest"))
        live = self.table("queue").select("id", F.col("name").alias("queue")).join(counts, F.col("id") == F.col("queue_id"), "left")
        joined = known.select("queue", F.lit(True).alias("declared")).distinct().join(live.withColumn("stored", F.lit(True)), "queue", "full_outer")
        zero = [F.coalesce(v, F.lit(0)).alias(v) for v in states.values()]
        return joined.select("queue", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("stored", F.lit(False)).alias("stored"), *zero, F.timestamp_diff("SECOND", F.col("oldest"), now).alias("oldest_seconds"))

    def indexers(self, views: DataFrame) -> DataFrame:
        """State and backlog of indexers. views: id, view_id, the declared ones.

        A view's changelog is the table <view>_cl; its backlog are distinct entities beyond the applied version.
        """
        state = views.join(self.table("indexer_state"), F.col("id") == F.col("indexer_id"), "left").join(self.table("mview_state").withColumnRenamed("status", "view_status"), "view_id", "left")
        counted = None
        for r in views.select("view_id").filter("view_id IS NOT NULL").distinct().collect():  # as many as declared views
            changes = self.read(f"{r[0]}_cl")
            if changes is not None:
                applied = self.table("mview_state").filter(F.col("view_id") == r[0]).select("version_id").withColumnRenamed("version_id", "__applied")
                beyond = changes.join(F.broadcast(applied), F.col("version_id") > F.col("__applied")).agg(F.countDistinct("entity_id").alias("backlog")).withColumn("view_id", F.lit(r[0]))
                counted = beyond if counted is None else counted.unionByName(beyond)
        if counted is None:
            counted = self.spark.createDataFrame([], "backlog long, view_id string")
        return state.join(counted, "view_id", "left").select("id", "status", "updated", "view_id", "mode", "view_status", "backlog")

    def url_rewrites(self, path: str | None = None, store: str | None = None, redirects: bool = False, limit: int = 50) -> DataFrame:
        rows = self.table("url_rewrite").join(self.table("store").select("store_id", F.col("code").alias("store")), "store_id", "left")
        if path:
            rows = rows.filter(scalars.icontains(F.col("request_path"), path) | scalars.icontains(F.col("target_path"), path))
        if store:
            rows = rows.filter(F.col("store") == store)
        if redirects:
            rows = rows.filter("redirect_type > 0")
        return aggregates.limit_truncated(rows.select("request_path", "target_path", "redirect_type", "entity_type", "entity_id", "store", "url_rewrite_id"), [F.asc("request_path"), F.asc("store"), F.asc("url_rewrite_id")], limit)

    # administration

    def admin_users(self, now: Column) -> DataFrame:
        role = self.table("authorization_role")
        own = role.filter("role_type = 'U' AND user_type = '2'").select(F.col("user_id").alias("__u"), F.col("parent_id").alias("__r"))
        named = role.filter("role_type = 'G'").select(F.col("role_id").alias("__g"), "role_name")
        joined = self.table("admin_user").join(own, F.col("user_id") == F.col("__u"), "left").join(named, F.col("__r") == F.col("__g"), "left")
        return joined.select("user_id", "username", "email", (F.col("is_active") == 1).alias("active"), "role_name", F.timestamp_diff("SECOND", F.col("logdate"), now).alias("seconds_since_login"), F.coalesce(F.col("lock_expires") > now, F.lit(False)).alias("locked"))

    def admin_roles(self) -> DataFrame:
        """Roles with their users and allowed resources, each sorted; a role without either stays."""
        role = self.table("authorization_role")
        groups = role.filter("role_type = 'G'").select("role_id", "role_name")
        users = role.filter("role_type = 'U' AND user_type = '2'").join(self.table("admin_user").select("user_id", "username"), "user_id").groupBy(F.col("parent_id").alias("role_id")).agg(F.array_sort(F.collect_set("username")).alias("users"))
        allowed = self.table("authorization_rule").filter("permission = 'allow'").groupBy("role_id").agg(F.array_sort(F.collect_set("resource_id")).alias("resources"))
        return groups.join(users, "role_id", "left").join(allowed, "role_id", "left").orderBy("role_name")

    # catalogue

    def attributes(self, entity: str) -> DataFrame:
        kinds = self.table("eav_entity_type").filter(F.col("entity_type_code") == entity)
        return self.table("eav_attribute").join(F.broadcast(kinds), "entity_type_id").drop("entity_type_id")

    def entity_types(self) -> DataFrame:
        counts = self.table("eav_attribute").groupBy("entity_type_id").agg(F.count(F.lit(1)).alias("attributes"))
        return self.table("eav_entity_type").join(counts, "entity_type_id", "left").select("entity_type_code", F.coalesce("attributes", F.lit(0)).alias("attributes"))

    def values(self, entity: str, table: str) -> DataFrame:
        """entity_id, attribute_code, store_id, value (as text) of all typed value tables."""
        attributes = self.attributes(entity).select("attribute_id", "attribute_code", "backend_type")
        out = None
        for kind in EAV_TYPES:
            rows = self.table(f"{table}_{kind}").select("entity_id", "attribute_id", "store_id", F.col("value").cast("string").alias("value"))
            typed = rows.join(F.broadcast(attributes.filter(F.col("backend_type") == kind)), "attribute_id").select("entity_id", "attribute_code", "store_id", "value")
            out = typed if out is None else out.unionByName(typed)
        return out

    def values_in(self, values: DataFrame, store: int) -> DataFrame:
        """What a store sees: its own value, else that of store 0."""
        own = values.filter(F.col("store_id").isin(0, store) & F.col("value").isNotNull())
        return own.groupBy("entity_id", "attribute_code").agg(F.max_by("value", "store_id").alias("value"))

    def products(self, ids: DataFrame, store: int) -> DataFrame:
        """entity_id, sku, type_id, attributes (sorted name=value) of the products in ids."""
        entity = self.table("catalog_product_entity").join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
        seen = self.values_in(self.values("catalog_product", "catalog_product_entity").join(ids.select("entity_id").distinct(), "entity_id", "left_semi"), store)
        listed = seen.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "attribute_code", "value"))).alias("attributes"))
        return entity.join(listed, "entity_id", "left")

    def category_tree(self, store: int = 0) -> DataFrame:
        """Categories in pre-order, with name, and whether they and all above them are active."""
        named = self.values_in(self.values("catalog_category", "catalog_category_entity").filter(F.col("attribute_code").isin("name", "is_active")), store)
        wide = named.groupBy("entity_id").agg(F.max(F.when(F.col("attribute_code") == "name", F.col("value"))).alias("name"), F.max(F.when(F.col("attribute_code") == "is_active", F.col("value"))).alias("is_active"))
        rows = self.table("catalog_category_entity").drop("path").join(wide, "entity_id", "left")
        off = F.when(F.coalesce("is_active", F.lit("1")) == "0", 1).otherwise(0)
        label = F.struct(F.coalesce("position", F.lit(0)).alias("position"), F.col("entity_id").alias("id"), off.alias("off"))
        tree = graph.with_paths(rows, "entity_id", "parent_id", label)
        return tree.withColumn("visible", ~F.exists("path", lambda p: p["off"] == 1)).orderBy("path")

    # sales and customers

    def order_statuses(self) -> DataFrame:
        state = self.table("sales_order_status_state")
        joined = self.table("sales_order_status").join(state, "status", "left")
        return joined.orderBy(F.col("state").asc_nulls_last(), F.desc("is_default"), "status")

    def orders_like(self, needle: str, limit: int) -> DataFrame:
        """Orders by number, mail, payment or transaction."""
        paid = self.table("sales_order_payment").select(F.col("parent_id").alias("__p"), "last_trans_id", "po_number")
        moved = self.table("sales_payment_transaction").select(F.col("order_id").alias("__t"), "txn_id")
        rows = self.table("sales_order").join(paid, F.col("entity_id") == F.col("__p"), "left").join(moved, F.col("entity_id") == F.col("__t"), "left")
        hit = F.lit(False)
        for c in ("increment_id", "customer_email", "last_trans_id", "po_number", "txn_id"):
            hit = hit | F.coalesce(scalars.icontains(F.col(c), needle), F.lit(False))
        found = rows.filter(hit).select("entity_id", "increment_id", "status", "customer_email", "grand_total", "created_at").distinct()
        return aggregates.limit_truncated(found, [F.desc("created_at"), F.desc("entity_id")], limit)

    def customers(self, ids: DataFrame) -> DataFrame:
        """Customers with count, sum and last of their orders; zero without."""
        own = self.table("customer_entity").join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
        stats = self.table("sales_order").groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"), F.sum("grand_total").alias("spent"), F.max("created_at").alias("last_order"))
        return own.join(stats, F.col("entity_id") == F.col("customer_id"), "left").drop("customer_id").withColumn("orders", F.coalesce("orders", F.lit(0)))

    def customers_like(self, needle: str, limit: int) -> DataFrame:
        rows = self.table("customer_entity").withColumn("name", F.concat_ws(" ", "firstname", "lastname"))
        return self.search(rows.select("entity_id", "email", "name"), needle, ["email", "name"], [F.asc("email"), F.asc("entity_id")], limit)

    def cms_like(self, kind: str, needle: str, limit: int) -> DataFrame:
        key = {"page": "page_id", "block": "block_id"}[kind]
        rows = self.table(f"cms_{kind}").select(F.col(key).alias("id"), "identifier", "title", "is_active")
        return self.search(rows, needle, ["identifier", "title"], [F.asc("identifier"), F.asc("id")], limit)

    def sales_rules_like(self, needle: str, limit: int) -> DataFrame:
        """Rules by name or one of their coupons, the latest first."""
        coupons = self.table("salesrule_coupon").filter(scalars.icontains(F.col("code"), needle)).select("rule_id").distinct().withColumn("__c", F.lit(True))
        rows = self.table("salesrule").join(coupons, "rule_id", "left").filter(F.col("__c") | scalars.icontains(F.col("name"), needle)).drop("__c")
        return aggregates.limit_truncated(rows, [F.desc("rule_id")], limit)

    # drift between declared and stored

    def patches(self, declared: DataFrame) -> DataFrame:
        """patch and state: applied, pending or orphaned. declared: patch."""
        a = declared.select("patch", F.lit(True).alias("__d")).distinct()
        b = self.table("patch_list").select(F.col("patch_name").alias("patch"), F.lit(True).alias("__a")).distinct()
        state = F.when(F.col("__a").isNull(), "pending").when(F.col("__d").isNull(), "orphaned").otherwise("applied")
        return a.join(b, "patch", "full_outer").select("patch", state.alias("state"))


def schema_drift(declared: DataFrame, live: DataFrame, whitelist: DataFrame) -> DataFrame:
    """table and class: missing, would drop, undeclared or skipped; ``unlisted`` if it is declared and not on the whitelist.

    Each frame has a column ``table``. Tables that are made at run time win over the whitelist.
    """
    a, b, w = (df.select("table").distinct().withColumn(f"__{x}", F.lit(True)) for df, x in ((declared, "a"), (live, "b"), (whitelist, "w")))
    runtime = F.col("table").rlike(r"(_cl|_replica|_tmp|_idx)$|^(sequence_|catalog_category_product_index_store)")
    kind = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNotNull(), "present").when(runtime, "skipped").when(F.col("__w").isNotNull(), "would drop").otherwise("undeclared")
    both = a.join(b, "table", "full_outer").join(w, "table", "left")
    return both.select("table", kind.alias("class"), (F.col("__a").isNotNull() & F.col("__w").isNull()).alias("unlisted"))
