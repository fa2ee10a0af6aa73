"""Driver queries over a store's operational tables.

The store is a snapshot: each of its tables is a query over the supplied ones,
in SQL that both sides understand, so that the library's plans and the
plain SQL of each card read the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cards import Cards
from .catalogue import ORACLES, QUERIES, table

SUPPLIED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
AMOUNT = "CAST({} AS decimal(20,4))"
TOTALS = ", ".join(f"{AMOUNT.format(f'o_totalprice * {k}')} AS {p}{t}" for k, t in enumerate(("subtotal", "shipping_amount", "tax_amount", "discount_amount", "grand_total", "total_paid", "total_refunded", "total_due"), 1) for p in ("", "base_"))
TIME = "CAST({} AS timestamp)"

#: The store's tables over the supplied ones, which stand in braces.
SNAPSHOT = {
    "store_website": "SELECT CAST(r_regionkey AS int) AS website_id, lower(r_name) AS code, r_name AS name, CASE WHEN r_regionkey = 1 THEN 1 ELSE 0 END AS is_default FROM {region}",
    "store_group": "SELECT CAST(r_regionkey AS int) AS group_id, concat('group ', r_name) AS name, CAST(r_regionkey AS int) AS website_id, CAST(2 + r_regionkey % 2 AS int) AS root_category_id FROM {region}",
    "store": "SELECT CAST(n_nationkey AS int) AS store_id, lower(n_name) AS code, n_name AS name, CAST(n_regionkey AS int) AS website_id, CAST(n_regionkey AS int) AS group_id, 1 AS is_active FROM {nation}",
    "customer_group": "SELECT CAST(r_regionkey AS int) AS customer_group_id, concat('G', r_name) AS customer_group_code, CAST(r_regionkey % 3 AS int) AS tax_class_id FROM {region}",
    "tax_class": "SELECT CAST(n_nationkey AS int) AS class_id, concat('class ', n_name) AS class_name FROM {nation} WHERE n_nationkey < 6",
    "customer_entity": "SELECT CAST(c_custkey AS int) AS entity_id, concat('c', CAST(c_custkey AS varchar(20)), '@x.y') AS email, c_name AS firstname, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS lastname, CAST(c_nationkey % 6 AS int) AS group_id, CAST(c_nationkey % 7 AS int) AS website_id, 'x' AS created_in, "
    "CAST('2024-01-01 00:00:00' AS timestamp) AS created_at, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS is_active, CASE WHEN c_custkey % 11 = 0 THEN 'k' END AS confirmation, CAST(CASE WHEN c_custkey % 13 = 0 THEN '2030-01-01 00:00:00' WHEN c_custkey % 13 = 1 THEN '2020-01-01 00:00:00' END AS timestamp) AS lock_expires, "
    "CAST(c_custkey % 4 AS int) AS failures_num, CAST(c_custkey * 2 AS int) AS default_billing, CAST(c_custkey * 2 + 1 AS int) AS default_shipping FROM {customer}",
    "customer_address_entity": "SELECT CAST(c_custkey * 2 + k AS int) AS entity_id, CAST(c_custkey AS int) AS parent_id, c_name AS firstname, 'L' AS lastname, 'S' AS street, '0' AS postcode, c_mktsegment AS city, 'X' AS country_id, '1' AS telephone FROM {customer}, (SELECT 0 AS k UNION ALL SELECT 1) t WHERE c_custkey % 2 = 0 OR k = 0",
    "customer_log": "SELECT CAST(c_custkey AS int) AS customer_id, CAST('2024-02-01 00:00:00' AS timestamp) AS last_login_at, CAST(NULL AS timestamp) AS last_logout_at FROM {customer} WHERE c_custkey % 2 = 1",
    "newsletter_subscriber": "SELECT CAST(c_custkey AS int) AS subscriber_id, CAST(CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE 0 END AS int) AS customer_id, concat('c', CAST(c_custkey AS varchar(20)), '@x.y') AS subscriber_email, CAST(c_nationkey + 3 AS int) AS store_id, CAST(1 + c_custkey % 3 AS int) AS subscriber_status FROM {customer} WHERE c_custkey % 2 = 0",
    "customer_entity_int": "SELECT CAST(c_custkey AS int) AS entity_id, 5 AS attribute_id, CAST(c_nationkey AS int) AS value FROM {customer} WHERE c_custkey % 3 = 0",
    "eav_entity_type": "SELECT CAST(r_regionkey AS int) AS entity_type_id, CASE r_regionkey WHEN 0 THEN 'customer' WHEN 3 THEN 'catalog_category' WHEN 4 THEN 'catalog_product' ELSE 'other' END AS entity_type_code FROM {region}",
    "eav_attribute": "SELECT CAST(n_nationkey AS int) AS attribute_id, CASE WHEN n_nationkey IN (1, 2, 3) THEN 3 WHEN n_nationkey = 5 THEN 0 ELSE 4 END AS entity_type_id, CASE n_nationkey WHEN 1 THEN 'name' WHEN 2 THEN 'is_active' WHEN 3 THEN 'url_key' WHEN 5 THEN 'vat' WHEN 10 THEN 'name' WHEN 11 THEN 'status' WHEN 12 THEN 'visibility' WHEN 13 THEN 'price' "
    "WHEN 14 THEN 'special_price' WHEN 15 THEN 'price_type' WHEN 16 THEN 'color' ELSE concat('a', CAST(n_nationkey AS varchar(20))) END AS attribute_code, CASE WHEN n_nationkey IN (2, 5, 11, 12, 15, 16) THEN 'int' WHEN n_nationkey IN (13, 14) THEN 'decimal' ELSE 'varchar' END AS backend_type, 'text' AS frontend_input, n_name AS frontend_label, 0 AS is_required FROM {nation}",
    "eav_attribute_option": "SELECT CAST(n_nationkey AS int) AS option_id, 16 AS attribute_id, CAST(n_nationkey % 4 AS int) AS sort_order FROM {nation} WHERE n_nationkey < 9",
    "eav_attribute_option_value": "SELECT CAST(n_nationkey AS int) AS option_id, 0 AS store_id, concat('color ', n_name) AS value FROM {nation} WHERE n_nationkey < 8",
    "eav_attribute_set": "SELECT CAST(r_regionkey AS int) AS attribute_set_id, 4 AS entity_type_id, concat('set ', r_name) AS attribute_set_name FROM {region}",
    "eav_attribute_group": "SELECT CAST(r_regionkey AS int) AS attribute_group_id, concat('tab ', r_name) AS attribute_group_name FROM {region}",
    "eav_entity_attribute": "SELECT CAST(n_nationkey AS int) AS attribute_id, CAST(n_regionkey AS int) AS attribute_set_id, CAST((n_regionkey + n_nationkey) % 5 AS int) AS attribute_group_id FROM {nation}",
    "catalog_eav_attribute": "SELECT CAST(n_nationkey AS int) AS attribute_id, 1 AS is_global, CAST(n_nationkey % 2 AS int) AS is_searchable, 0 AS is_filterable, 0 AS is_comparable, 0 AS used_in_product_listing, 0 AS used_for_sort_by, 1 AS is_visible_on_front FROM {nation} WHERE n_nationkey >= 10",
    "catalog_product_entity": "SELECT CAST(p_partkey AS int) AS entity_id, concat('sku-', CAST(p_partkey AS varchar(20))) AS sku, CASE WHEN p_partkey % 10 = 0 THEN 'configurable' WHEN p_partkey % 10 = 5 THEN 'grouped' ELSE 'simple' END AS type_id, CAST(p_size % 6 AS int) AS attribute_set_id, CAST('2024-01-01 00:00:00' AS timestamp) AS created_at, CAST('2024-01-02 00:00:00' AS timestamp) AS updated_at FROM {part}",
    "catalog_product_entity_varchar": "SELECT CAST(p_partkey AS int) AS entity_id, 10 AS attribute_id, k AS store_id, CASE WHEN k = 0 THEN p_name ELSE p_brand END AS value FROM {part}, (SELECT 0 AS k UNION ALL SELECT 3) t WHERE k = 0 OR p_partkey % 4 = 0",
    "catalog_product_entity_int": "SELECT CAST(p_partkey AS int) AS entity_id, a AS attribute_id, 0 AS store_id, CAST(CASE a WHEN 11 THEN 1 + p_size % 2 WHEN 12 THEN 4 WHEN 15 THEN p_size % 2 ELSE p_size % 10 END AS int) AS value FROM {part}, (SELECT 11 AS a UNION ALL SELECT 12 UNION ALL SELECT 15 UNION ALL SELECT 16) t WHERE a <> 15 OR p_partkey % 3 = 0",
    "catalog_product_entity_decimal": "SELECT CAST(p_partkey AS int) AS entity_id, a AS attribute_id, 0 AS store_id, CAST(CASE a WHEN 13 THEN p_retailprice ELSE p_retailprice / 2 END AS decimal(20,4)) AS value FROM {part}, (SELECT 13 AS a UNION ALL SELECT 14) t WHERE a = 13 OR p_partkey % 5 = 0",
    "catalog_product_website": "SELECT CAST(p_partkey AS int) AS product_id, CAST((p_size + k) % 7 AS int) AS website_id FROM {part}, (SELECT 0 AS k UNION ALL SELECT 1) t",
    "cataloginventory_stock_item": "SELECT CAST(p_partkey AS int) AS product_id, CAST(p_size AS decimal(20,4)) AS qty, CASE WHEN p_size > 10 THEN 1 ELSE 0 END AS is_in_stock, 1 AS manage_stock FROM {part} WHERE p_partkey % 9 <> 0",
    "inventory_source_item": "SELECT concat('sku-', CAST(p_partkey AS varchar(20))) AS sku, concat('src', CAST(k AS varchar(20))) AS source_code, CAST(p_size + k AS decimal(20,4)) AS quantity, 1 AS status FROM {part}, (SELECT 0 AS k UNION ALL SELECT 1) t WHERE p_partkey % 3 <> k",
    "catalog_product_super_link": "SELECT CAST(p_partkey AS int) AS link_id, CAST(p_partkey AS int) AS product_id, CAST(p_partkey - p_partkey % 10 AS int) AS parent_id FROM {part} WHERE p_partkey % 10 IN (1, 2, 3)",
    "catalog_product_super_attribute": "SELECT CAST(p_partkey AS int) AS product_id, 16 AS attribute_id, 0 AS position FROM {part} WHERE p_partkey % 10 = 0",
    "catalog_product_link": "SELECT CAST(p_partkey * 4 + k AS int) AS link_id, CAST(p_partkey AS int) AS product_id, CAST((p_partkey * 7 + k) % 150 AS int) AS linked_product_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END AS link_type_id FROM {part}, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t WHERE k <> 1 OR p_partkey % 10 = 5",
    "catalog_product_link_attribute": "SELECT CAST(r_regionkey AS int) AS product_link_attribute_id, CASE r_regionkey WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 3 END AS link_type_id, CASE WHEN r_regionkey = 4 THEN 'qty' ELSE 'position' END AS product_link_attribute_code FROM {region} WHERE r_regionkey > 0",
    "catalog_product_link_attribute_int": "SELECT 1 AS product_link_attribute_id, CAST(p_partkey * 4 AS int) AS link_id, CAST(p_size AS int) AS value FROM {part} WHERE p_partkey % 2 = 0",
    "catalog_product_link_attribute_decimal": "SELECT 4 AS product_link_attribute_id, CAST(p_partkey * 4 + 1 AS int) AS link_id, CAST(p_size AS decimal(20,4)) AS value FROM {part} WHERE p_partkey % 20 = 5",
    "catalog_product_entity_tier_price": "SELECT CAST(p_partkey AS int) AS entity_id, CAST(p_size % 6 AS int) AS website_id, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS all_groups, CAST(p_size % 5 AS int) AS customer_group_id, CAST(k AS decimal(20,4)) AS qty, CAST(p_size AS decimal(20,4)) AS value, CAST(NULL AS decimal(20,4)) AS percentage_value FROM {part}, (SELECT 2 AS k UNION ALL SELECT 10) t WHERE p_partkey % 6 = 0",
    "catalog_product_index_price": "SELECT CAST(p_partkey AS int) AS entity_id, CAST(r_regionkey AS int) AS customer_group_id, 1 AS website_id, CAST(p_size AS decimal(20,4)) AS price, CAST(p_size + r_regionkey AS decimal(20,4)) AS final_price, CAST(p_size AS decimal(20,4)) AS min_price, CAST(p_size AS decimal(20,4)) AS max_price, CAST(NULL AS decimal(20,4)) AS tier_price FROM {part}, {region} WHERE p_partkey % 8 < 4",
    "catalogrule_product_price": "SELECT CAST(p_partkey AS int) AS product_id, CAST('2024-03-01' AS date) AS rule_date, CAST(p_size % 5 AS int) AS customer_group_id, 2 AS website_id, CAST(p_size AS decimal(20,4)) AS rule_price FROM {part} WHERE p_partkey % 7 = 0",
    "core_config_data": "SELECT 'default' AS scope, 0 AS scope_id, 'catalog/price/scope' AS path, '1' AS value FROM {region} WHERE r_regionkey = 0",
    "catalog_category_entity": "SELECT CAST(n_nationkey + 1 AS int) AS entity_id, CAST(CASE WHEN n_nationkey = 0 THEN 0 WHEN n_nationkey < 3 THEN 1 ELSE 2 + n_nationkey % 2 END AS int) AS parent_id, CASE WHEN n_nationkey = 0 THEN '1' WHEN n_nationkey < 3 THEN concat('1/', CAST(n_nationkey + 1 AS varchar(20))) ELSE concat('1/', CAST(2 + n_nationkey % 2 AS varchar(20)), '/', CAST(n_nationkey + 1 AS varchar(20))) END AS path, "
    "CASE WHEN n_nationkey = 0 THEN 0 WHEN n_nationkey < 3 THEN 1 ELSE 2 END AS level, CAST(n_nationkey % 5 AS int) AS position, 0 AS children_count FROM {nation}",
    "catalog_category_entity_varchar": "SELECT CAST(n_nationkey + 1 AS int) AS entity_id, 1 AS attribute_id, 0 AS store_id, n_name AS value FROM {nation} WHERE n_nationkey <> 7",
    "catalog_category_entity_int": "SELECT CAST(n_nationkey + 1 AS int) AS entity_id, 2 AS attribute_id, k AS store_id, CASE WHEN (n_nationkey + k) % 4 = 0 THEN 0 ELSE 1 END AS value FROM {nation}, (SELECT 0 AS k UNION ALL SELECT 2 UNION ALL SELECT 5) t WHERE n_nationkey % 3 <> 0 OR k > 0",
    "catalog_category_product": "SELECT CAST(1 + p_partkey % 25 AS int) AS category_id, CAST(p_partkey AS int) AS product_id, CAST(p_size AS int) AS position FROM {part} WHERE p_partkey % 3 > 0",
    "catalog_category_product_index_store2": "SELECT CAST(1 + p_partkey % 25 AS int) AS category_id, CAST(p_partkey AS int) AS product_id, CAST(p_size AS int) AS position, 1 AS is_parent, 4 AS visibility, CAST(1 + p_partkey % 2 AS int) AS store_id FROM {part}",
    "url_rewrite": "SELECT CAST(p_partkey AS bigint) AS url_rewrite_id, CASE WHEN p_partkey < 25 THEN 'category' ELSE 'product' END AS entity_type, CAST(p_partkey AS bigint) AS entity_id, concat('p/', p_name) AS request_path, 't' AS target_path, CASE WHEN p_size % 7 = 0 THEN 301 ELSE 0 END AS redirect_type, CAST(p_size % 30 AS int) AS store_id, CAST(NULL AS varchar(10)) AS description, 1 AS is_autogenerated FROM {part}",
    "sales_order": f"SELECT CAST(o_orderkey AS bigint) AS entity_id, lpad(CAST(o_orderkey AS varchar(20)), 9, '0') AS increment_id, CASE o_orderstatus WHEN 'O' THEN 'new' ELSE 'complete' END AS state, o_orderstatus AS status, CAST(o_custkey % 30 AS int) AS store_id, {TIME.format('o_orderdate')} AS created_at, {TIME.format('o_orderdate')} AS updated_at, "
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS int) END AS customer_id, concat('c', CAST(o_custkey AS varchar(20)), '@x.y') AS customer_email, 'F' AS customer_firstname, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'L' END AS customer_lastname, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS customer_is_guest, 'EUR' AS base_currency_code, 'USD' AS order_currency_code, "
    f"CASE WHEN o_orderkey % 6 = 0 THEN 'c6' END AS coupon_code, o_orderpriority AS shipping_method, CAST(o_orderkey % 9 AS decimal(12,4)) AS total_qty_ordered, CAST(o_orderkey + 1 AS bigint) AS quote_id, {TOTALS} FROM {{orders}}",
    "sales_order_status": "SELECT 'O' AS status, 'Open' AS label FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'F', 'Finished' FROM {region} WHERE r_regionkey = 0",
    "sales_order_item": "SELECT CAST(l_orderkey * 10 + l_linenumber AS bigint) AS item_id, CAST(l_orderkey AS bigint) AS order_id, CAST(CASE WHEN l_linenumber = 2 THEN l_orderkey END AS bigint) AS parent_item_id, concat('sku-', CAST(l_partkey AS varchar(20))) AS sku, l_returnflag AS name, l_linestatus AS product_type, CAST(l_quantity AS decimal(12,4)) AS qty_ordered, CAST(NULL AS decimal(12,4)) AS qty_invoiced, "
    "CAST(l_linenumber AS decimal(12,4)) AS qty_shipped, CAST(0 AS decimal(12,4)) AS qty_refunded, CAST(NULL AS decimal(12,4)) AS qty_canceled, CAST(l_extendedprice AS decimal(20,4)) AS price, CAST(l_extendedprice AS decimal(20,4)) AS row_total FROM {lineitem}",
    "sales_order_address": "SELECT CAST(o_orderkey * 2 + k AS bigint) AS entity_id, CAST(o_orderkey AS bigint) AS parent_id, CASE k WHEN 0 THEN 'shipping' ELSE 'billing' END AS address_type, 'F' AS firstname, 'L' AS lastname, 'S' AS street, '0' AS postcode, o_orderpriority AS city, 'X' AS country_id, '1' AS telephone FROM {orders}, (SELECT 0 AS k UNION ALL SELECT 1) t WHERE k = 1 OR o_orderkey % 5 <> 0",
    "sales_order_payment": "SELECT CAST(o_orderkey AS bigint) AS parent_id, o_orderpriority AS method, concat('T', CAST(o_custkey AS varchar(20))) AS last_trans_id, CAST(NULL AS varchar(10)) AS po_number, '{{}}' AS additional_information FROM {orders} WHERE o_orderkey % 8 <> 0",
    "sales_payment_transaction": "SELECT CAST(o_orderkey AS bigint) AS transaction_id, CAST(o_orderkey AS bigint) AS order_id, concat('T', CAST(o_orderkey AS varchar(20))) AS txn_id, 'capture' AS txn_type, CAST(o_orderkey % 2 AS int) AS is_closed, CAST('2024-01-01 00:00:00' AS timestamp) AS created_at FROM {orders} WHERE o_orderkey % 3 = 0",
    "sales_order_status_history": "SELECT CAST(o_orderkey AS bigint) AS entity_id, CAST(o_orderkey - o_orderkey % 5 AS bigint) AS parent_id, o_orderstatus AS status, o_orderpriority AS comment, CAST('2024-01-01 00:00:00' AS timestamp) AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS is_customer_notified FROM {orders}",
    "sales_order_grid": "SELECT CAST(o_orderkey AS bigint) AS entity_id FROM {orders} WHERE o_orderkey % 10 <> 3",
    "quote": f"SELECT CAST(o_orderkey AS bigint) AS entity_id, CAST(o_orderkey % 2 AS int) AS is_active, CAST(o_custkey % 30 AS int) AS store_id, {TIME.format('o_orderdate')} AS created_at, {TIME.format('o_orderdate')} AS updated_at, CAST(NULL AS timestamp) AS converted_at, CAST(o_custkey AS int) AS customer_id, concat('c', CAST(o_custkey AS varchar(20)), '@x.y') AS customer_email, 'F' AS customer_firstname, "
    f"'L' AS customer_lastname, 0 AS customer_is_guest, 'm' AS checkout_method, 'EUR' AS quote_currency_code, CAST(o_orderkey % 5 AS decimal(12,4)) AS items_qty, 0 AS is_virtual, CAST(NULL AS varchar(10)) AS coupon_code, CAST(NULL AS varchar(10)) AS reserved_order_id, {AMOUNT.format('o_totalprice')} AS subtotal, {AMOUNT.format('o_totalprice')} AS grand_total FROM {{orders}}",
    "quote_item": "SELECT CAST(l_orderkey * 10 + l_linenumber AS bigint) AS item_id, CAST(l_orderkey AS bigint) AS quote_id, CAST(NULL AS bigint) AS parent_item_id, concat('sku-', CAST(l_partkey AS varchar(20))) AS sku, l_returnflag AS name, 'simple' AS product_type, CAST(l_quantity AS decimal(12,4)) AS qty, CAST(l_extendedprice AS decimal(20,4)) AS price, CAST(l_extendedprice AS decimal(20,4)) AS row_total, CAST(0 AS decimal(20,4)) AS discount_amount FROM {lineitem}",
    "quote_address": "SELECT CAST(o_orderkey * 2 + k AS bigint) AS address_id, CAST(o_orderkey AS bigint) AS quote_id, CASE k WHEN 0 THEN 'shipping' ELSE 'billing' END AS address_type, 'F' AS firstname, 'L' AS lastname, 'S' AS street, '0' AS postcode, o_orderpriority AS city, 'X' AS country_id, 'flat' AS shipping_method, CAST(o_custkey AS decimal(20,4)) AS shipping_amount, CAST(k AS decimal(20,4)) AS tax_amount, CAST(0 AS decimal(20,4)) AS discount_amount FROM {orders}, (SELECT 0 AS k UNION ALL SELECT 1) t WHERE o_orderkey % 5 <> 1",
    "quote_payment": "SELECT CAST(o_orderkey AS bigint) AS quote_id, o_orderpriority AS method FROM {orders} WHERE o_orderkey % 2 = 0",
    "cms_page": "SELECT CAST(n_nationkey AS int) AS page_id, lower(n_name) AS identifier, n_name AS title, CAST(n_nationkey % 2 AS int) AS is_active, CAST('2024-01-01 00:00:00' AS timestamp) AS creation_time, CAST('2024-01-02 00:00:00' AS timestamp) AS update_time, CASE WHEN n_nationkey % 3 = 0 THEN '<x/>' END AS layout_update_xml, CASE WHEN n_nationkey % 5 = 0 THEN '' END AS custom_layout_update_xml, 'c' AS content FROM {nation}",
    "cms_page_store": "SELECT CAST(n_nationkey AS int) AS page_id, CAST((n_nationkey + k) % 26 AS int) AS store_id FROM {nation}, (SELECT 0 AS k UNION ALL SELECT 2) t WHERE n_nationkey % 4 <> 1",
    "integration": "SELECT CAST(r_regionkey AS int) AS integration_id, r_name AS name, 'm' AS email, 'e' AS endpoint, CAST(r_regionkey % 2 AS int) AS status, CAST(r_regionkey + 10 AS int) AS consumer_id, CAST('2024-01-01 00:00:00' AS timestamp) AS created_at, CAST('2024-01-01 00:00:00' AS timestamp) AS updated_at FROM {region}",
    "oauth_consumer": "SELECT CAST(r_regionkey + 10 AS int) AS entity_id, concat('k', r_name) AS key, concat('s', r_name) AS secret FROM {region} WHERE r_regionkey < 4",
    "oauth_token": "SELECT CAST(r_regionkey + 10 AS int) AS consumer_id, CASE WHEN r_regionkey = 3 THEN 'request' ELSE 'access' END AS type, concat('t', r_name) AS token, concat('x', r_name) AS secret, CAST(r_regionkey % 2 AS int) AS revoked FROM {region} WHERE r_regionkey > 0",
    "authorization_role": "SELECT CAST(r_regionkey AS int) AS role_id, 0 AS parent_id, 'G' AS role_type, '2' AS user_type, 0 AS user_id, concat('role ', r_name) AS role_name FROM {region} UNION ALL SELECT CAST(100 + n_nationkey AS int), CAST(n_nationkey % 4 AS int), 'U', '2', CAST(n_nationkey AS int), n_name FROM {nation} UNION ALL SELECT CAST(200 + r_regionkey AS int), 0, 'U', '1', CAST(r_regionkey AS int), r_name FROM {region} WHERE r_regionkey <> 2",
    "authorization_rule": "SELECT CAST(n_regionkey AS int) AS role_id, concat('R::', n_name) AS resource_id, CASE WHEN n_nationkey % 3 = 0 THEN 'deny' ELSE 'allow' END AS permission FROM {nation} UNION ALL SELECT CAST(200 + n_regionkey AS int), CASE WHEN n_nationkey = 1 THEN 'R::all' ELSE concat('R::', n_name) END, 'allow' FROM {nation} WHERE n_nationkey < 9",
    "admin_user": "SELECT CAST(n_nationkey AS int) AS user_id, lower(n_name) AS username, 'm' AS email, CAST(n_nationkey % 2 AS int) AS is_active, CAST('2024-01-01 00:00:00' AS timestamp) AS created, CAST(CASE WHEN n_nationkey % 4 > 0 THEN '2024-06-01 00:00:00' END AS timestamp) AS logdate, CAST(CASE WHEN n_nationkey % 6 = 0 THEN '2030-01-01 00:00:00' END AS timestamp) AS lock_expires FROM {nation}",
    "directory_country_region": "SELECT CAST(r_regionkey AS int) AS region_id, r_name AS code FROM {region}",
    "directory_currency_rate": "SELECT n_name AS currency_from, 'EUR' AS currency_to, CAST(n_nationkey AS decimal(24,12)) AS rate FROM {nation}",
    "tax_calculation_rate": "SELECT CAST(n_nationkey AS int) AS tax_calculation_rate_id, n_name AS code, 'X' AS tax_country_id, CAST(n_regionkey + 1 AS int) AS tax_region_id, '1*' AS tax_postcode, CAST(n_nationkey % 2 AS int) AS zip_is_range, CAST(n_nationkey AS int) AS zip_from, CAST(n_nationkey + 5 AS int) AS zip_to, CAST(n_nationkey AS decimal(12,4)) AS rate FROM {nation}",
    "tax_calculation_rule": "SELECT CAST(r_regionkey AS int) AS tax_calculation_rule_id, r_name AS code, CAST(r_regionkey % 2 AS int) AS priority, 0 AS position, 0 AS calculate_subtotal FROM {region}",
    "tax_calculation": "SELECT CAST(n_regionkey AS int) AS tax_calculation_rule_id, CAST(n_nationkey - n_nationkey % 2 AS int) AS tax_calculation_rate_id, CAST(n_nationkey % 3 AS int) AS customer_tax_class_id, CAST(3 + n_nationkey % 4 AS int) AS product_tax_class_id FROM {nation} WHERE n_regionkey < 4",
    "catalogrule": "SELECT CAST(s_suppkey AS int) AS rule_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'about 7' END AS description, CAST(s_suppkey % 2 AS int) AS is_active, CAST(CASE WHEN s_suppkey % 4 = 1 THEN '2024-01-01' WHEN s_suppkey % 4 = 2 THEN '2026-01-01' END AS date) AS from_date, CAST(CASE WHEN s_suppkey % 5 = 1 THEN '2024-02-01' END AS date) AS to_date, 'by_percent' AS simple_action, CAST(s_suppkey AS decimal(20,4)) AS discount_amount, 0 AS sort_order, 0 AS stop_rules_processing, '{{}}' AS conditions_serialized FROM {supplier}",
    "catalogrule_website": "SELECT CAST(s_suppkey AS int) AS rule_id, CAST((s_suppkey + k) % 6 AS int) AS website_id FROM {supplier}, (SELECT 0 AS k UNION ALL SELECT 2) t",
    "catalogrule_customer_group": "SELECT CAST(s_suppkey AS int) AS rule_id, CAST((s_suppkey + k) % 7 AS int) AS customer_group_id FROM {supplier}, (SELECT 0 AS k UNION ALL SELECT 3) t",
    "catalogrule_product": "SELECT CAST(p_size AS int) AS rule_id, CAST(p_partkey % 50 AS int) AS product_id FROM {part}",
    "salesrule": "SELECT CAST(s_suppkey AS int) AS rule_id, s_name AS name, 'd' AS description, CAST(s_suppkey % 2 AS int) AS is_active, CAST(NULL AS date) AS from_date, CAST(CASE WHEN s_suppkey % 3 = 1 THEN '2024-02-01' END AS date) AS to_date, CAST(s_suppkey % 4 AS int) AS sort_order FROM {supplier}",
    "salesrule_coupon": "SELECT CAST(c_custkey AS int) AS coupon_id, CAST(c_custkey % 9 AS int) AS rule_id, concat('C', CAST(c_custkey AS varchar(20))) AS code, CAST(c_nationkey AS int) AS times_used, CAST(NULL AS int) AS usage_limit, CAST(CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01 00:00:00' END AS timestamp) AS expiration_date FROM {customer}",
    "salesrule_website": "SELECT CAST(s_suppkey AS int) AS rule_id, CAST(s_suppkey % 6 AS int) AS website_id FROM {supplier}",
    "salesrule_customer_group": "SELECT CAST(s_suppkey AS int) AS rule_id, CAST((s_suppkey + k) % 7 AS int) AS customer_group_id FROM {supplier}, (SELECT 0 AS k UNION ALL SELECT 3) t",
    "theme": "SELECT CAST(r_regionkey AS int) AS theme_id, CAST(CASE WHEN r_regionkey > 0 THEN r_regionkey - 1 END AS int) AS parent_id, concat('V/', r_name) AS theme_path, 'frontend' AS area FROM {region}",
    "translation": "SELECT n_name AS string, concat('t ', n_name) AS translate, CAST(n_nationkey + 5 AS int) AS store_id, CASE WHEN n_nationkey % 2 = 0 THEN 'de_DE' ELSE 'fr_FR' END AS locale FROM {nation}",
    "cron_schedule": "SELECT CAST(event_id AS bigint) AS schedule_id, concat(event_type, CAST(user_id % 3 AS varchar(20))) AS job_code, CASE user_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'success' WHEN 3 THEN 'missed' ELSE 'error' END AS status, props AS messages, CAST(ts AS timestamp) AS scheduled_at, CAST(CASE WHEN user_id % 5 IN (1, 2, 4) THEN ts END AS timestamp) AS executed_at, CAST(CASE WHEN user_id % 5 = 2 THEN ts END AS timestamp) AS finished_at FROM {events}",
    "queue": "SELECT CAST(r_regionkey AS int) AS id, r_name AS name FROM {region}",
    "queue_message_status": "SELECT CAST(event_id AS bigint) AS id, CAST(user_id % 4 AS int) AS queue_id, CAST(2 + event_id % 6 AS int) AS status, CAST(ts AS timestamp) AS updated_at FROM {events}",
    "indexer_state": "SELECT concat('i', CAST(r_regionkey AS varchar(20))) AS indexer_id, CASE WHEN r_regionkey = 1 THEN 'invalid' ELSE 'valid' END AS status, CAST('2024-01-01 00:00:00' AS timestamp) AS updated FROM {region} WHERE r_regionkey < 4",
    "mview_state": "SELECT concat('v', CAST(r_regionkey AS varchar(20))) AS view_id, 'enabled' AS mode, 'idle' AS status, CAST(100 * r_regionkey AS bigint) AS version_id FROM {region} WHERE r_regionkey < 3",
    "v1_cl": "SELECT CAST(user_id AS bigint) AS entity_id, CAST(event_id AS bigint) AS version_id FROM {events}",
    "v2_cl": "SELECT CAST(user_id % 10 AS bigint) AS entity_id, CAST(event_id AS bigint) AS version_id FROM {events}",
}
for kind, every in (("invoice", 2), ("shipment", 3), ("creditmemo", 7)):
    more = {
        "invoice": "concat('T', CAST(o_custkey AS varchar(20))) AS transaction_id", "shipment": "CAST(o_orderkey % 9 AS decimal(12,4)) AS total_qty",
        "creditmemo": "CAST(1 AS decimal(20,4)) AS adjustment_positive, CAST(2 AS decimal(20,4)) AS adjustment_negative",
    }[kind]
    if kind != "shipment":
        more += f", CAST(o_orderkey % 4 AS int) AS state, 'EUR' AS order_currency_code, {AMOUNT.format('o_totalprice')} AS subtotal, {AMOUNT.format('o_totalprice')} AS tax_amount, {AMOUNT.format('o_totalprice')} AS shipping_amount, {AMOUNT.format('o_totalprice')} AS grand_total"
    SNAPSHOT[f"sales_{kind}"] = f"SELECT CAST(o_orderkey AS bigint) AS entity_id, lpad(CAST(o_orderkey AS varchar(20)), 9, '0') AS increment_id, CAST(o_orderkey + 1 AS bigint) AS order_id, {TIME.format('o_orderdate')} AS created_at, {more} FROM {{orders}} WHERE o_orderkey % {every} = 0"
    price = "" if kind == "shipment" else ", CAST(l_extendedprice AS decimal(20,4)) AS price, CAST(l_extendedprice AS decimal(20,4)) AS row_total"
    SNAPSHOT[f"sales_{kind}_item"] = f"SELECT CAST(l_orderkey * 10 + l_linenumber AS bigint) AS entity_id, CAST(l_orderkey AS bigint) AS parent_id, concat('sku-', CAST(l_partkey AS varchar(20))) AS sku, l_returnflag AS name, CAST(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS decimal(12,4)) AS qty{price} FROM {{lineitem}}"
SNAPSHOT["sales_shipment_track"] = "SELECT CAST(o_orderkey AS bigint) AS entity_id, CAST(o_orderkey AS bigint) AS parent_id, CAST(o_orderkey + 1 AS bigint) AS order_id, o_orderpriority AS carrier_code, 'T' AS title, CAST(o_custkey AS varchar(20)) AS track_number FROM {orders} WHERE o_orderkey % 6 = 0"


def cards(spark: SparkSession, sf_dir: str) -> Cards:
    """The snapshot's store. Tables that no query names aren't read."""

    def read(name: str) -> DataFrame | None:
        if name not in SNAPSHOT:
            return None
        used = {t: table(spark, sf_dir, t) for t in SUPPLIED if f"{{{t}}}" in SNAPSHOT[name]}
        found = spark.sql(SNAPSHOT[name].replace("varchar(20)", "string").replace("varchar(10)", "string"), **used)
        return found

    return Cards(spark, read)


def over_snapshot(sql: str) -> str:
    """A query on the store's tables as one on the supplied ones."""
    names = [n for n in SNAPSHOT if re.search(rf"\b{n}\b", sql)]
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text).replace("{{}}", "{}")
    tables = ", ".join(f"{n} AS ({plain(SNAPSHOT[n])})" for n in names)
    return f"WITH {tables}{',' if sql.lstrip().startswith('WITH') else ''} {sql.lstrip().removeprefix('WITH')}"


def query(sql: str) -> Callable:
    def register(function: Callable[[Cards], DataFrame]) -> Callable:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(cards(spark, sf_dir))
        ORACLES[function.__name__] = over_snapshot(sql)
        return function

    return register


def text(column: str, *fields: str):
    """An array of structs as one text: fields by colons (null: -), items by commas."""
    one = lambda x: F.concat_ws(":", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields))
    return F.array_join(F.transform(column, one), ",").alias(column)


def said(fields: str, order: str, more: str = "") -> str:
    """The same in SQL, as an aggregation."""
    one = " || ':' || ".join(f"coalesce(({f.strip()})::VARCHAR, '-')" for f in fields.split(";"))
    return f"coalesce(string_agg({one}, ',' ORDER BY {order}){more}, '')"


def when(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query(f"""WITH i AS (SELECT order_id, {said("sku; qty_ordered; qty_invoiced_; child", "item_id, sku, name, product_type, child, qty_ordered, qty_shipped, price")} AS items FROM
      (SELECT *, coalesce(qty_invoiced, 0) AS qty_invoiced_, parent_item_id IS NOT NULL AS child FROM sales_order_item) GROUP BY 1),
a AS (SELECT parent_id, {said("address_type; city", "address_type, entity_id")} AS addresses FROM sales_order_address GROUP BY 1),
t AS (SELECT order_id, {said("txn_id; is_closed <> 0", "transaction_id")} AS transactions FROM sales_payment_transaction GROUP BY 1),
v AS (SELECT order_id, {said("increment_id; state; grand_total", "entity_id")} AS invoices FROM sales_invoice GROUP BY 1),
s AS (SELECT order_id, {said("increment_id; total_qty", "entity_id")} AS shipments FROM sales_shipment GROUP BY 1),
m AS (SELECT order_id, {said("increment_id; state", "entity_id")} AS creditmemos FROM sales_creditmemo GROUP BY 1),
k AS (SELECT order_id, {said("carrier_code; track_number", "entity_id")} AS tracks FROM sales_shipment_track GROUP BY 1),
h AS (SELECT parent_id, {said("status; comment; coalesce(is_customer_notified, 0) <> 0", "entity_id")} AS history FROM sales_order_status_history GROUP BY 1)
SELECT o.entity_id, o.increment_id, o.status, l.label AS status_label, coalesce(w.code, NULL) AS store, strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, o.customer_is_guest <> 0 AS guest, concat_ws(' ', customer_firstname, customer_lastname) AS customer,
  o.grand_total, p.method AS payment_method, coalesce(items, '') AS items, coalesce(addresses, '') AS addresses, coalesce(transactions, '') AS transactions, coalesce(invoices, '') AS invoices, coalesce(shipments, '') AS shipments, coalesce(creditmemos, '') AS creditmemos,
  coalesce(tracks, '') AS tracks, coalesce(history, '') AS history, g.entity_id IS NOT NULL AS in_grid
FROM sales_order o LEFT JOIN sales_order_status l USING (status) LEFT JOIN store w USING (store_id) LEFT JOIN sales_order_payment p ON p.parent_id = o.entity_id LEFT JOIN i ON i.order_id = o.entity_id LEFT JOIN a ON a.parent_id = o.entity_id
LEFT JOIN t ON t.order_id = o.entity_id LEFT JOIN v ON v.order_id = o.entity_id LEFT JOIN s ON s.order_id = o.entity_id LEFT JOIN m ON m.order_id = o.entity_id LEFT JOIN k ON k.order_id = o.entity_id LEFT JOIN h ON h.parent_id = o.entity_id LEFT JOIN sales_order_grid g ON g.entity_id = o.entity_id""")
def card_orders(shop):
    found = shop.order_cards(shop.table("sales_order").select("entity_id"))
    amount = F.filter("totals", lambda t: t["total"] == "grand_total")[0]["amount"].alias("grand_total")
    return found.select(
        "entity_id", "increment_id", "status", "status_label", "store", when("created_at"), "guest", "customer", amount, "payment_method", text("items", "sku", "qty_ordered", "qty_invoiced", "child"), text("addresses", "address_type", "city"),
        text("transactions", "txn_id", "closed"), text("invoices", "increment_id", "state", "grand_total"), text("shipments", "increment_id", "total_qty"), text("creditmemos", "increment_id", "state"), text("tracks", "carrier_code", "track_number"), text("history", "status", "comment", "notified"), "in_grid",
    )


@query("""SELECT DISTINCT o.entity_id, o.increment_id, status, customer_email, grand_total, strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM sales_order o LEFT JOIN sales_order_payment p ON p.parent_id = o.entity_id LEFT JOIN sales_payment_transaction t ON t.order_id = o.entity_id
WHERE o.increment_id LIKE '%77%' OR customer_email LIKE '%77%' OR p.last_trans_id LIKE '%77%' OR t.txn_id LIKE '%77%' ORDER BY o.created_at DESC, o.entity_id DESC LIMIT 50""")
def search_orders(shop):
    return shop.orders_like("77", 50).select("entity_id", "increment_id", "status", "customer_email", "grand_total", when("created_at"))


@query(f"""WITH a AS (SELECT parent_id, {said("x.entity_id; city; x.entity_id = e.default_billing; x.entity_id = e.default_shipping", "x.entity_id")} AS addresses FROM customer_address_entity x JOIN customer_entity e ON e.entity_id = parent_id GROUP BY 1),
n AS (SELECT e.entity_id, {said("coalesce(s.code, 'store/' || n.store_id); subscriber_status", "n.store_id, subscriber_id")} AS newsletter FROM customer_entity e JOIN newsletter_subscriber n ON n.customer_id = e.entity_id OR n.subscriber_email = e.email LEFT JOIN store s USING (store_id) GROUP BY 1),
v AS (SELECT entity_id, {said("attribute_code; value", "attribute_code")} AS attributes FROM customer_entity_int JOIN eav_attribute USING (attribute_id) GROUP BY 1),
o AS (SELECT customer_id, count(*) AS orders, sum(base_grand_total) AS spent, strftime(min(created_at), '%Y-%m-%d') AS first_order, arg_max(increment_id, entity_id) AS last_increment, arg_max(status, entity_id) AS last_status FROM sales_order WHERE customer_id IS NOT NULL GROUP BY 1),
u AS (SELECT e.entity_id, count(*) AS guest_orders FROM customer_entity e JOIN sales_order o ON o.customer_email = e.email AND (o.customer_id IS NULL OR o.customer_id <> e.entity_id) GROUP BY 1)
SELECT e.entity_id, e.email, concat_ws(' ', firstname, lastname) AS name, g.customer_group_code AS "group", w.code AS website, is_active = 1 AS active, confirmation IS NULL AS confirmed, coalesce(lock_expires > TIMESTAMP '2025-01-01', false) AS locked, strftime(last_login_at, '%Y-%m-%d %H:%M:%S') AS last_login_at,
  coalesce(addresses, '') AS addresses, coalesce(newsletter, '') AS newsletter, coalesce(attributes, '') AS attributes, coalesce(orders, 0) AS orders, spent, first_order, last_increment, last_status, coalesce(guest_orders, 0) AS guest_orders
FROM customer_entity e LEFT JOIN customer_group g ON g.customer_group_id = e.group_id LEFT JOIN store_website w ON w.website_id = e.website_id LEFT JOIN customer_log l ON l.customer_id = e.entity_id LEFT JOIN a ON a.parent_id = e.entity_id LEFT JOIN n ON n.entity_id = e.entity_id
LEFT JOIN v ON v.entity_id = e.entity_id LEFT JOIN o ON o.customer_id = e.entity_id LEFT JOIN u ON u.entity_id = e.entity_id""")
def card_customers(shop):
    found = shop.customer_cards(shop.table("customer_entity").select("email"), F.lit("2025-01-01").cast("timestamp"))
    return found.select(
        "entity_id", "email", "name", "group", "website", "active", "confirmed", "locked", when("last_login_at"), text("addresses", "address_id", "city", "billing", "shipping"), text("newsletter", "store", "subscriber_status"), text("attributes", "attribute", "value"),
        "orders", F.col("spent").cast("decimal(38,4)").alias("spent"), F.date_format("first_order", "yyyy-MM-dd").alias("first_order"), "last_increment", "last_status", "guest_orders",
    )


@query(f"""WITH i AS (SELECT quote_id, {said("sku; qty", "item_id, sku, name, qty, price")} AS items FROM quote_item GROUP BY 1),
a AS (SELECT quote_id, {said("address_type; city", "address_type, address_id")} AS addresses, min(CASE WHEN address_type = 'shipping' THEN shipping_amount END) AS shipping_amount FROM quote_address GROUP BY 1),
o AS (SELECT quote_id, min(increment_id) AS order_increment FROM sales_order GROUP BY 1)
SELECT q.entity_id, q.is_active <> 0 AS active, s.code AS store, customer_email, grand_total, date_sub('second', updated_at, TIMESTAMP '2025-01-01') AS updated_seconds, order_increment, coalesce(items, '') AS items, coalesce(addresses, '') AS addresses, shipping_amount, p.method AS payment_method
FROM quote q LEFT JOIN store s USING (store_id) LEFT JOIN i ON i.quote_id = q.entity_id LEFT JOIN a ON a.quote_id = q.entity_id LEFT JOIN o ON o.quote_id = q.entity_id LEFT JOIN quote_payment p ON p.quote_id = q.entity_id""")
def card_quotes(shop):
    found = shop.quote_cards(shop.table("quote").select("entity_id"), F.lit("2025-01-01").cast("timestamp"))
    return found.select("entity_id", "active", "store", "customer_email", "grand_total", "updated_seconds", "order_increment", text("items", "sku", "qty"), text("addresses", "address_type", "city"), "shipping_amount", "payment_method")


@query("SELECT entity_id, is_active <> 0 AS active, customer_email, items_qty FROM quote WHERE customer_email LIKE '%12%' ORDER BY entity_id DESC LIMIT 50")
def search_quotes(shop):
    return shop.quotes_like("12", 50).select("entity_id", "active", "customer_email", "items_qty")


def document_sql(kind: str) -> str:
    fields = "sku; coalesce(qty, 0)" + ("" if kind == "shipment" else "; row_total")
    order = "entity_id, sku, name, coalesce(qty, 0)" + ("" if kind == "shipment" else ", price, row_total")
    track = f"LEFT JOIN (SELECT parent_id, {said('carrier_code; track_number', 'entity_id')} AS tracks FROM sales_shipment_track GROUP BY 1) t ON t.parent_id = d.entity_id" if kind == "shipment" else ""
    shown = {"invoice": "d.grand_total, transaction_id", "shipment": "total_qty, coalesce(tracks, '') AS tracks", "creditmemo": "d.grand_total, adjustment_negative"}[kind]
    return f"""SELECT d.entity_id, d.increment_id, o.increment_id AS order_increment, o.status AS order_status, {shown}, coalesce(items, '') AS items FROM sales_{kind} d LEFT JOIN sales_order o ON o.entity_id = d.order_id
LEFT JOIN (SELECT parent_id, {said(fields, order)} AS items FROM sales_{kind}_item GROUP BY 1) i ON i.parent_id = d.entity_id {track}"""


def documents(shop: Cards, kind: str, *shown) -> DataFrame:
    found = shop.document_cards(kind, shop.table(f"sales_{kind}").select("increment_id"))
    return found.select("entity_id", "increment_id", "order_increment", "order_status", *shown, text("items", "sku", "qty", *([] if kind == "shipment" else ["row_total"])))


@query(document_sql("invoice"))
def card_invoices(shop):
    return documents(shop, "invoice", "grand_total", "transaction_id")


@query(document_sql("shipment"))
def card_shipments(shop):
    return documents(shop, "shipment", "total_qty", text("tracks", "carrier_code", "track_number"))


@query(document_sql("creditmemo"))
def card_creditmemos(shop):
    return documents(shop, "creditmemo", "grand_total", "adjustment_negative")


@query("SELECT d.entity_id, d.increment_id, o.increment_id AS order_increment, d.grand_total AS amount FROM sales_invoice d LEFT JOIN sales_order o ON o.entity_id = d.order_id WHERE d.increment_id LIKE '%42%' ORDER BY d.entity_id DESC LIMIT 50")
def search_invoices(shop):
    return shop.documents_like("invoice", "42", 50).select("entity_id", "increment_id", "order_increment", "amount")


@query(f"""WITH v AS (SELECT entity_id, attribute_id, store_id, value::VARCHAR AS value FROM catalog_product_entity_varchar UNION ALL SELECT entity_id, attribute_id, store_id, value::VARCHAR FROM catalog_product_entity_int UNION ALL SELECT entity_id, attribute_id, store_id, value::VARCHAR FROM catalog_product_entity_decimal),
w AS (SELECT product_id, {said("code", "code")} AS websites FROM catalog_product_website JOIN store_website USING (website_id) GROUP BY 1),
lab AS (SELECT o.attribute_id, o.option_id, x.value AS label FROM eav_attribute_option o JOIN eav_attribute_option_value x ON x.option_id = o.option_id AND x.store_id = 0),
a AS (SELECT entity_id, {said("attribute_code; coalesce(s.code, 'store/' || v.store_id); v.value; label", "attribute_code, v.store_id")} AS attributes FROM v JOIN eav_attribute e USING (attribute_id) LEFT JOIN store s USING (store_id) LEFT JOIN lab ON lab.attribute_id = e.attribute_id AND lab.option_id::VARCHAR = v.value GROUP BY 1),
src AS (SELECT sku, {said("source_code; quantity", "source_code")} AS sources FROM inventory_source_item GROUP BY 1),
step AS (SELECT entity_id AS category_id, unnest(string_split(path, '/')) AS step, generate_subscripts(string_split(path, '/'), 1) AS pos FROM catalog_category_entity),
bread AS (SELECT category_id, string_agg(coalesce(n.value, '(category ' || step || ')'), ' > ' ORDER BY pos) AS names FROM step LEFT JOIN catalog_category_entity_varchar n ON n.entity_id::VARCHAR = step WHERE step <> '1' GROUP BY 1),
c AS (SELECT product_id, {said("category_id; names", "category_id")} AS categories FROM catalog_category_product LEFT JOIN bread USING (category_id) GROUP BY 1),
u AS (SELECT entity_id, {said("coalesce(s.code, 'store/' || r.store_id); request_path; redirect_type", "r.store_id, request_path")} AS urls FROM url_rewrite r LEFT JOIN store s USING (store_id) WHERE entity_type = 'product' GROUP BY 1),
par AS (SELECT l.product_id, {said("e.sku", "e.sku")} AS parents FROM catalog_product_super_link l JOIN catalog_product_entity e ON e.entity_id = l.parent_id GROUP BY 1),
kid AS (SELECT parent_id, product_id, 'configurable' AS kind, NULL::VARCHAR AS qty FROM catalog_product_super_link
  UNION ALL SELECT product_id, linked_product_id, 'grouped', d.value::VARCHAR FROM catalog_product_link l LEFT JOIN catalog_product_link_attribute_decimal d ON d.link_id = l.link_id AND d.product_link_attribute_id = 4 WHERE link_type_id = 3),
ch AS (SELECT parent_id, {said("kind; e.sku; kid.qty; st.value; k.is_in_stock; CASE WHEN kind = 'configurable' AND p.entity_id IS NOT NULL AND col.value IS NOT NULL THEN 'color=' || coalesce(lab.label, col.value::VARCHAR) END", "kind, e.sku")} AS children
  FROM kid JOIN catalog_product_entity e ON e.entity_id = kid.product_id LEFT JOIN catalog_product_entity_int st ON st.entity_id = e.entity_id AND st.attribute_id = 11 LEFT JOIN cataloginventory_stock_item k ON k.product_id = e.entity_id
  LEFT JOIN catalog_product_entity_int col ON col.entity_id = e.entity_id AND col.attribute_id = 16 LEFT JOIN lab ON lab.option_id = col.value LEFT JOIN catalog_product_entity p ON p.entity_id = kid.parent_id GROUP BY 1)
SELECT e.entity_id, e.sku, type_id, attribute_set_name AS attribute_set, coalesce(websites, '') AS websites, coalesce(attributes, '') AS attributes, k.qty, k.is_in_stock, coalesce(sources, '') AS sources, coalesce(categories, '') AS categories, coalesce(urls, '') AS urls, coalesce(parents, '') AS parents, coalesce(children, '') AS children
FROM catalog_product_entity e LEFT JOIN eav_attribute_set USING (attribute_set_id) LEFT JOIN w ON w.product_id = e.entity_id LEFT JOIN a ON a.entity_id = e.entity_id LEFT JOIN cataloginventory_stock_item k ON k.product_id = e.entity_id LEFT JOIN src ON src.sku = e.sku
LEFT JOIN c ON c.product_id = e.entity_id LEFT JOIN u ON u.entity_id = e.entity_id LEFT JOIN par ON par.product_id = e.entity_id LEFT JOIN ch ON ch.parent_id = e.entity_id""")
def card_products(shop):
    found = shop.product_cards(shop.table("catalog_product_entity").select("sku"))
    return found.select(
        "entity_id", "sku", "type_id", "attribute_set", text("websites", "website"), text("attributes", "attribute", "store", "value", "label"), "qty", "is_in_stock", text("sources", "source_code", "quantity"), text("categories", "category_id", "names"),
        text("urls", "store", "request_path", "redirect_type"), text("parents", "sku"), text("children", "kind", "sku", "qty", "status", "is_in_stock", "options"),
    )


@query("""SELECT e.entity_id, e.sku, e.type_id, n.value AS name, s.value AS status FROM catalog_product_entity e LEFT JOIN catalog_product_entity_varchar n ON n.entity_id = e.entity_id AND n.store_id = 0 AND n.attribute_id = 10
LEFT JOIN catalog_product_entity_int s ON s.entity_id = e.entity_id AND s.attribute_id = 11 WHERE e.sku LIKE '%-1%' ORDER BY e.sku, e.entity_id LIMIT 50""")
def search_products(shop):
    return shop.products_like("-1", 50).select("entity_id", "sku", "type_id", "name", "status")


def links_sql(mine: str, other: str) -> str:
    return f"""SELECT l.{mine} AS entity_id, CASE link_type_id WHEN 1 THEN 'related' WHEN 3 THEN 'grouped' WHEN 4 THEN 'up_sell' ELSE 'cross_sell' END AS kind, e.sku, n.value AS name, s.value AS status, v.value AS visibility, k.is_in_stock = 1 AS in_stock, i.value AS position
FROM catalog_product_link l JOIN catalog_product_entity e ON e.entity_id = l.{other} LEFT JOIN catalog_product_link_attribute_int i ON i.link_id = l.link_id AND l.link_type_id = 1 LEFT JOIN catalog_product_entity_varchar n ON n.entity_id = e.entity_id AND n.store_id = 0
LEFT JOIN catalog_product_entity_int s ON s.entity_id = e.entity_id AND s.attribute_id = 11 LEFT JOIN catalog_product_entity_int v ON v.entity_id = e.entity_id AND v.attribute_id = 12 LEFT JOIN cataloginventory_stock_item k ON k.product_id = e.entity_id WHERE l.{mine} IN (SELECT entity_id FROM catalog_product_entity)"""


def linked(shop: Cards, reverse: bool) -> DataFrame:
    return shop.product_links(shop.table("catalog_product_entity"), reverse).select("entity_id", "kind", "sku", "name", "status", "visibility", "in_stock", "position")


@query(links_sql("product_id", "linked_product_id"))
def product_links(shop):
    return linked(shop, False)


@query(links_sql("linked_product_id", "product_id"))
def product_links_reverse(shop):
    return linked(shop, True)


@query(f"""WITH site AS (SELECT website_id, code FROM store_website),
v AS (SELECT entity_id, {said("attribute_code; s.code; value", "attribute_code, d.store_id")} AS "values" FROM catalog_product_entity_decimal d JOIN eav_attribute USING (attribute_id) LEFT JOIN store s USING (store_id) GROUP BY 1),
t AS (SELECT entity_id, {said("coalesce(code, 'website/' || t.website_id); CASE WHEN all_groups = 1 THEN 'all groups' ELSE customer_group_code END; qty; value", "t.website_id, t.customer_group_id, qty")} AS tiers FROM catalog_product_entity_tier_price t LEFT JOIN site USING (website_id) LEFT JOIN customer_group USING (customer_group_id) GROUP BY 1),
r AS (SELECT product_id, {said("rule_date; code; customer_group_code; rule_price", "rule_date, p.website_id, p.customer_group_id")} AS rules FROM catalogrule_product_price p LEFT JOIN site USING (website_id) LEFT JOIN customer_group USING (customer_group_id) GROUP BY 1),
x AS (SELECT entity_id, {said("code; customer_group_code; final_price", "x.website_id, x.customer_group_id")} AS index_ FROM catalog_product_index_price x LEFT JOIN site USING (website_id) LEFT JOIN customer_group USING (customer_group_id) GROUP BY 1),
m AS (SELECT entity_id, min(final_price) AS least, max(final_price) AS most FROM catalog_product_index_price GROUP BY 1),
kid AS (SELECT parent_id, product_id FROM catalog_product_super_link UNION SELECT product_id, linked_product_id FROM catalog_product_link WHERE link_type_id = 3),
c AS (SELECT parent_id, {said("e.sku; p.value; sp.value; least; most", "e.sku")} AS components FROM kid JOIN catalog_product_entity e ON e.entity_id = kid.product_id LEFT JOIN catalog_product_entity_decimal p ON p.entity_id = e.entity_id AND p.attribute_id = 13
  LEFT JOIN catalog_product_entity_decimal sp ON sp.entity_id = e.entity_id AND sp.attribute_id = 14 LEFT JOIN m ON m.entity_id = e.entity_id GROUP BY 1)
SELECT e.entity_id, e.sku, coalesce("values", '') AS "values", coalesce(tiers, '') AS tiers, coalesce(rules, '') AS rules, coalesce(index_, '') AS "index", coalesce(components, '') AS components, pt.value AS price_type, (SELECT max(value) FROM core_config_data WHERE path = 'catalog/price/scope' AND scope = 'default') AS scope
FROM catalog_product_entity e LEFT JOIN v ON v.entity_id = e.entity_id LEFT JOIN t ON t.entity_id = e.entity_id LEFT JOIN r ON r.product_id = e.entity_id LEFT JOIN x ON x.entity_id = e.entity_id LEFT JOIN c ON c.parent_id = e.entity_id LEFT JOIN catalog_product_entity_int pt ON pt.entity_id = e.entity_id AND pt.attribute_id = 15""")
def card_prices(shop):
    found = shop.price_cards(shop.table("catalog_product_entity"))
    return found.select("entity_id", "sku", text("values", "attribute", "store", "value"), text("tiers", "website", "group", "qty", "value"), text("rules", "rule_date", "website", "group", "rule_price"), text("index", "website", "group", "final_price"), text("components", "sku", "price", "special_price", "least", "most"), "price_type", "scope")


@query(f"""WITH step AS (SELECT entity_id, unnest(string_split(path, '/')) AS step, generate_subscripts(string_split(path, '/'), 1) AS pos FROM catalog_category_entity),
bread AS (SELECT step.entity_id, string_agg(coalesce(n.value, '(category ' || step || ')'), ' > ' ORDER BY pos) AS breadcrumb FROM step LEFT JOIN catalog_category_entity_varchar n ON n.entity_id::VARCHAR = step WHERE step <> '1' GROUP BY 1),
scope AS (SELECT store_id FROM store WHERE store_id > 0 UNION ALL SELECT 0),
own AS (SELECT DISTINCT s.entity_id, scope.store_id FROM step s, scope LEFT JOIN catalog_category_entity_int v ON v.entity_id::VARCHAR = s.step AND v.store_id = scope.store_id LEFT JOIN catalog_category_entity_int d ON d.entity_id::VARCHAR = s.step AND d.store_id = 0 WHERE s.step <> '1' AND coalesce(v.value, d.value, 1) = 0),
i AS (SELECT entity_id, {said("CASE WHEN own.store_id = 0 THEN 'default' ELSE 'stores/' || code END", "own.store_id")} AS inactive FROM own LEFT JOIN store USING (store_id) GROUP BY 1),
u AS (SELECT entity_id, {said("coalesce(s.code, 'store/' || r.store_id); request_path", "r.store_id, request_path, redirect_type")} AS urls FROM url_rewrite r LEFT JOIN store s USING (store_id) WHERE entity_type = 'category' GROUP BY 1),
g AS (SELECT root_category_id, {said("name", "name")} AS root_of FROM store_group WHERE group_id > 0 GROUP BY 1),
p AS (SELECT category_id, {said("e.sku; n.value; position", "position, e.sku")} AS products, count(*) AS assigned FROM catalog_category_product c JOIN catalog_product_entity e ON e.entity_id = c.product_id LEFT JOIN catalog_product_entity_varchar n ON n.entity_id = e.entity_id AND n.store_id = 0 GROUP BY 1)
SELECT c.entity_id, level, breadcrumb, coalesce(inactive, '') AS inactive, coalesce(urls, '') AS urls, coalesce(root_of, '') AS root_of, coalesce(products, '') AS products, coalesce(assigned, 0)::INT AS assigned
FROM catalog_category_entity c LEFT JOIN bread ON bread.entity_id = c.entity_id LEFT JOIN i ON i.entity_id = c.entity_id LEFT JOIN u ON u.entity_id = c.entity_id LEFT JOIN g ON g.root_category_id = c.entity_id LEFT JOIN p ON p.category_id = c.entity_id""")
def card_categories(shop):
    found = shop.category_cards(shop.table("catalog_category_entity"))
    return found.select("entity_id", "level", "breadcrumb", text("inactive", "scope"), text("urls", "store", "request_path"), text("root_of", "name"), text("products", "sku", "name", "position"), "assigned")


@query("SELECT i.category_id, i.product_id, e.sku, i.position, i.visibility FROM catalog_category_product_index_store2 i JOIN catalog_product_entity e ON e.entity_id = i.product_id WHERE i.store_id = 2")
def category_index(shop):
    return shop.indexed_products(shop.table("catalog_category_entity"), 2).select("category_id", "product_id", "sku", "position", "visibility")


@query(f"""WITH lab AS (SELECT attribute_id, {said("x.value", "sort_order, x.value")} AS options FROM eav_attribute_option o JOIN eav_attribute_option_value x ON x.option_id = o.option_id AND x.store_id = 0 GROUP BY 1),
st AS (SELECT attribute_id, {said("attribute_set_name; attribute_group_name", "attribute_set_name, attribute_group_name")} AS sets FROM eav_entity_attribute JOIN eav_attribute_set USING (attribute_set_id) JOIN eav_attribute_group USING (attribute_group_id) GROUP BY 1)
SELECT a.attribute_id, a.attribute_code, is_searchable, coalesce(sets, '') AS sets, coalesce(options, '') AS options FROM eav_attribute a JOIN eav_entity_type t USING (entity_type_id) LEFT JOIN catalog_eav_attribute c USING (attribute_id) LEFT JOIN st USING (attribute_id) LEFT JOIN lab USING (attribute_id) WHERE entity_type_code = 'catalog_product'""")
def card_attributes(shop):
    return shop.attribute_cards("catalog_product").select("attribute_id", "attribute_code", "is_searchable", text("sets", "attribute_set_name", "attribute_group_name"), text("options", "label"))


@query("SELECT (SELECT count(*) FROM store_website WHERE website_id > 0) AS websites, (SELECT count(*) FROM store_group WHERE group_id > 0) AS \"groups\", (SELECT count(*) FROM store WHERE store_id > 0) AS stores")
def scope_counts(shop):
    return shop.scope_counts()


@query("SELECT g.customer_group_id, g.customer_group_code, t.class_name, (SELECT count(*) FROM customer_entity e WHERE e.group_id = g.customer_group_id) AS customers FROM customer_group g LEFT JOIN tax_class t ON t.class_id = g.tax_class_id")
def customer_groups(shop):
    return shop.customer_groups()


@query("SELECT w.website_id, w.code AS website, g.group_id, g.name AS \"group\", s.store_id, s.code AS store FROM store_website w LEFT JOIN store_group g USING (website_id) LEFT JOIN store s ON s.group_id = g.group_id")
def store_tree(shop):
    return shop.store_tree().select("website_id", "website", "group_id", "group", "store_id", "store")


NOW = "2025-01-01"


def now():
    return F.lit(NOW).cast("timestamp")


@query(f"""WITH s AS (SELECT page_id, {said("CASE WHEN c.store_id = 0 THEN 'all stores' ELSE coalesce(code, 'store/' || c.store_id) END", "c.store_id")} AS stores FROM cms_page_store c LEFT JOIN store USING (store_id) GROUP BY 1)
SELECT page_id AS id, identifier, title, is_active = 1 AS active, coalesce(layout_update_xml, '') <> '' OR coalesce(custom_layout_update_xml, '') <> '' AS own_layout, coalesce(stores, '') AS stores FROM cms_page LEFT JOIN s USING (page_id)""")
def card_pages(shop):
    return shop.cms_cards("page", shop.table("cms_page").select("identifier")).select("id", "identifier", "title", "active", "own_layout", text("stores", "store"))


@query("SELECT page_id AS id, identifier, title, is_active FROM cms_page WHERE identifier LIKE '%1%' OR title LIKE '%1%' ORDER BY identifier, page_id LIMIT 5")
def search_pages(shop):
    return shop.cms_like("page", "1", 5).select("id", "identifier", "title", "is_active")


@query(f"""WITH t AS (SELECT consumer_id, max(revoked) AS r FROM oauth_token WHERE type = 'access' GROUP BY 1),
a AS (SELECT r.user_id, {said("resource_id", "resource_id")} AS resources, bool_or(resource_id LIKE '%::all') AS everything FROM authorization_role r JOIN authorization_rule l USING (role_id) WHERE r.user_type = '1' AND permission = 'allow' GROUP BY 1)
SELECT i.integration_id, i.name, status = 1 AS active, CASE WHEN t.consumer_id IS NULL THEN 'none' WHEN r <> 0 THEN 'revoked' ELSE 'active' END AS token, coalesce(resources, '') AS resources, coalesce(everything, false) AS everything
FROM integration i LEFT JOIN t USING (consumer_id) LEFT JOIN a ON a.user_id = i.integration_id""")
def integrations(shop):
    return shop.integrations().select("integration_id", "name", "active", "token", text("resources", "resource_id"), "everything")


@query("""SELECT i.integration_id, c.key, c.secret, t.token, t.secret AS token_secret, t.revoked FROM integration i JOIN oauth_consumer c ON c.entity_id = i.consumer_id LEFT JOIN oauth_token t ON t.consumer_id = i.consumer_id AND t.type = 'access'""")
def integration_credentials(shop):
    return shop.credentials(shop.table("integration"))


@query("""SELECT tax_calculation_rate_id, r.code, tax_country_id AS country, g.code AS region, CASE WHEN zip_is_range = 1 THEN zip_from || '-' || zip_to ELSE tax_postcode END AS postcode, rate FROM tax_calculation_rate r LEFT JOIN directory_country_region g ON g.region_id = r.tax_region_id""")
def tax_rates(shop):
    return shop.tax_rates()


@query("""SELECT r.tax_calculation_rule_id, r.code, priority,
  (SELECT coalesce(string_agg(DISTINCT t.code, ',' ORDER BY t.code), '') FROM tax_calculation c JOIN tax_calculation_rate t USING (tax_calculation_rate_id) WHERE c.tax_calculation_rule_id = r.tax_calculation_rule_id) AS rates,
  (SELECT coalesce(string_agg(DISTINCT class_name, ',' ORDER BY class_name), '') FROM tax_calculation c JOIN tax_class ON class_id = customer_tax_class_id WHERE c.tax_calculation_rule_id = r.tax_calculation_rule_id) AS customer_classes,
  (SELECT coalesce(string_agg(DISTINCT class_name, ',' ORDER BY class_name), '') FROM tax_calculation c JOIN tax_class ON class_id = product_tax_class_id WHERE c.tax_calculation_rule_id = r.tax_calculation_rule_id) AS product_classes
FROM tax_calculation_rule r""")
def tax_rules(shop):
    return shop.tax_rules().select("tax_calculation_rule_id", "code", "priority", text("rates", "rate"), text("customer_classes", "class_name"), text("product_classes", "class_name"))


def scopes_sql(table: str) -> str:
    return f"""(SELECT coalesce(string_agg(s.code, ',' ORDER BY s.code), '') FROM {table}_website w JOIN store_website s USING (website_id) WHERE w.rule_id = r.rule_id) AS websites,
  (SELECT coalesce(string_agg(customer_group_code, ',' ORDER BY customer_group_id), '') FROM {table}_customer_group g JOIN customer_group USING (customer_group_id) WHERE g.rule_id = r.rule_id) AS "groups\""""


IN_DATE = f"(from_date IS NULL OR from_date <= DATE '{NOW}') AND (to_date IS NULL OR to_date >= DATE '{NOW}') AS in_date"


@query(f"SELECT rule_id, name, is_active = 1 AS active, {IN_DATE}, discount_amount, (SELECT count(DISTINCT product_id) FROM catalogrule_product p WHERE p.rule_id = r.rule_id) AS products, {scopes_sql('catalogrule')} FROM catalogrule r")
def card_catalog_rules(shop):
    found = shop.catalog_rule_cards(shop.table("catalogrule"), F.lit(NOW).cast("date"))
    return found.select("rule_id", "name", "active", "in_date", "discount_amount", "products", text("websites", "website"), text("groups", "group"))


@query("""SELECT r.rule_id, r.name, r.is_active, count(DISTINCT p.product_id) AS products FROM catalogrule r LEFT JOIN catalogrule_product p ON p.rule_id = r.rule_id WHERE r.name LIKE '%7%' OR r.description LIKE '%7%' GROUP BY ALL ORDER BY r.rule_id LIMIT 20""")
def search_catalog_rules(shop):
    return shop.catalog_rules_like("7", 20).select("rule_id", "name", "is_active", "products")


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY coupon_id) AS place FROM salesrule_coupon),
f AS (SELECT rule_id, {said("code; times_used; coalesce(expiration_date < TIMESTAMP '2025-01-01', false)", "coupon_id")} AS coupons FROM c WHERE place <= 3 GROUP BY 1)
SELECT r.rule_id, name, is_active = 1 AS active, {IN_DATE}, coalesce(coupons, '') AS coupons, (SELECT count(*) FROM salesrule_coupon c WHERE c.rule_id = r.rule_id) AS coupon_count, {scopes_sql('salesrule')} FROM salesrule r LEFT JOIN f USING (rule_id)""")
def card_sales_rules(shop):
    found = shop.sales_rule_cards(shop.table("salesrule"), F.lit(NOW).cast("date"), 3)
    return found.select("rule_id", "name", "active", "in_date", text("coupons", "code", "used", "expired"), "coupon_count", text("websites", "website"), text("groups", "group"))


@query("SELECT code, rule_id FROM salesrule_coupon WHERE code IN (SELECT 'C' || c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def rules_of_coupons(shop):
    return shop.rules_of_coupons(shop.table("salesrule_coupon").filter("coupon_id % 3 = 0").select("code"))


@query("SELECT rule_id, name FROM salesrule r WHERE name LIKE '%5%' OR EXISTS (SELECT 1 FROM salesrule_coupon c WHERE c.rule_id = r.rule_id AND c.code LIKE '%5%') ORDER BY rule_id DESC LIMIT 8")
def search_sales_rules(shop):
    return shop.sales_rules_like("5", 8).select("rule_id", "name")


@query("SELECT t.theme_id, t.area, t.theme_path AS theme, p.theme_path AS parent FROM theme t LEFT JOIN theme p ON p.theme_id = t.parent_id")
def themes(shop):
    return shop.themes()


@query("SELECT string, translate, store_id, coalesce(code, 'store/' || store_id) AS store FROM translation LEFT JOIN store USING (store_id) WHERE locale = 'de_DE' AND lower(string) LIKE '%1%'")
def search_translations(shop):
    return shop.translations_like("de_DE", "1")


@query("SELECT currency_from, currency_to, rate FROM directory_currency_rate")
def currency_rates(shop):
    return shop.currency_rates()


@query(f"SELECT date_sub('second', max(finished_at), TIMESTAMP '{NOW}') AS seconds FROM cron_schedule WHERE status = 'success'")
def cron_last_success(shop):
    return shop.last_success(now())


@query(f"""WITH c AS (SELECT job_code, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'missed') AS missed, count(*) FILTER (status = 'error') AS error FROM cron_schedule GROUP BY 1),
l AS (SELECT job_code, arg_max(status, (executed_at, schedule_id)) AS last_status, date_sub('second', max(executed_at), TIMESTAMP '{NOW}') AS seconds_ago FROM cron_schedule WHERE executed_at IS NOT NULL GROUP BY 1)
SELECT c.*, last_status, seconds_ago FROM c LEFT JOIN l USING (job_code)""")
def cron_jobs_live(shop):
    return shop.cron(now()).select("job_code", *(F.col(f"n_{s}").alias(s) for s in ("pending", "running", "success", "missed", "error")), "last_status", "seconds_ago")


@query("SELECT schedule_id, status, messages FROM cron_schedule WHERE job_code = 'click1' AND status <> 'pending' ORDER BY coalesce(executed_at, scheduled_at) DESC, schedule_id DESC LIMIT 30")
def cron_history(shop):
    return shop.cron_history("click1", 30).select("schedule_id", "status", "messages")


@query("SELECT job_code, arg_max(messages, schedule_id) AS last_error FROM cron_schedule WHERE status = 'error' GROUP BY 1")
def cron_last_errors(shop):
    return shop.last_errors()


@query("SELECT job_code, strftime(min(scheduled_at), '%Y-%m-%d %H:%M:%S') AS next_run FROM cron_schedule WHERE status = 'pending' GROUP BY 1")
def cron_next_runs(shop):
    return shop.next_runs().select("job_code", when("next_run"))


@query(f"""WITH k AS (SELECT name AS queue, true AS declared FROM queue WHERE id < 3 UNION ALL SELECT 'gone', true),
m AS (SELECT queue_id, count(*) FILTER (status = 2) AS new, count(*) FILTER (status = 6) AS error, min(updated_at) FILTER (status IN (2, 5)) AS oldest FROM queue_message_status GROUP BY 1),
l AS (SELECT name AS queue, true AS stored, new, error, oldest FROM queue q LEFT JOIN m ON m.queue_id = q.id)
SELECT queue, coalesce(declared, false) AS declared, coalesce(stored, false) AS stored, coalesce(new, 0) AS new, coalesce(error, 0) AS error, date_sub('second', oldest, TIMESTAMP '{NOW}') AS oldest_seconds FROM k FULL JOIN l USING (queue)""")
def queue_backlog(shop):
    known = shop.table("queue").filter("id < 3").select(F.col("name").alias("queue")).unionByName(shop.spark.createDataFrame([("gone",)], "queue string"))
    return shop.queue_backlog(known, now()).select("queue", "declared", "stored", "new", "error", "oldest_seconds")


@query("""WITH v AS (SELECT 'i' || r_regionkey AS id, CASE WHEN r_regionkey < 4 THEN 'v' || r_regionkey END AS view_id FROM region)
SELECT v.id, i.status, v.view_id, m.mode, CASE v.view_id WHEN 'v1' THEN (SELECT count(DISTINCT entity_id) FROM v1_cl WHERE version_id > 100) WHEN 'v2' THEN (SELECT count(DISTINCT entity_id) FROM v2_cl WHERE version_id > 200) END AS backlog
FROM v LEFT JOIN indexer_state i ON i.indexer_id = v.id LEFT JOIN mview_state m USING (view_id)""")
def indexer_states(shop):
    views = shop.spark.createDataFrame([(f"i{i}", f"v{i}" if i < 4 else None) for i in range(5)], "id string, view_id string")
    return shop.indexers(views).select("id", "status", "view_id", "mode", "backlog")


@query(f"""SELECT u.user_id, u.username, u.is_active = 1 AS active, r.role_name, date_sub('second', logdate, TIMESTAMP '{NOW}') AS seconds_since_login, coalesce(lock_expires > TIMESTAMP '{NOW}', false) AS locked FROM admin_user u
LEFT JOIN authorization_role x ON x.role_type = 'U' AND x.user_type = '2' AND x.user_id = u.user_id LEFT JOIN authorization_role r ON r.role_id = x.parent_id""")
def admin_users(shop):
    return shop.admin_users(now()).select("user_id", "username", "active", "role_name", "seconds_since_login", "locked")


@query("""SELECT role_id, role_name, (SELECT coalesce(string_agg(u.username, ',' ORDER BY u.username), '') FROM authorization_role x JOIN admin_user u USING (user_id) WHERE x.role_type = 'U' AND x.user_type = '2' AND x.parent_id = r.role_id) AS users,
  (SELECT coalesce(string_agg(resource_id, ',' ORDER BY resource_id), '') FROM authorization_rule l WHERE l.role_id = r.role_id AND permission = 'allow') AS resources FROM authorization_role r WHERE role_type = 'G'""")
def admin_roles(shop):
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c)
    return shop.admin_roles().select("role_id", "role_name", joined("users"), joined("resources"))


@query("SELECT entity_type_code, count(attribute_id) AS attributes FROM (SELECT entity_type_id, entity_type_code FROM eav_entity_type) LEFT JOIN eav_attribute USING (entity_type_id) GROUP BY entity_type_id, entity_type_code")
def entity_types(shop):
    return shop.entity_types()


@query("SELECT count(*) AS sets FROM eav_attribute_set WHERE entity_type_id = 4")
def attribute_sets(shop):
    return shop.set_count("catalog_product")


@query("""SELECT request_path, target_path, redirect_type, entity_type, entity_id, code AS store FROM url_rewrite u LEFT JOIN store s USING (store_id) WHERE request_path LIKE '%ring%' AND redirect_type > 0 ORDER BY request_path, store NULLS FIRST, url_rewrite_id LIMIT 40""")
def url_rewrites(shop):
    return shop.url_rewrites("ring", None, True, 40).select("request_path", "target_path", "redirect_type", "entity_type", "entity_id", "store")


@query("""WITH n AS (SELECT c.entity_id, CASE WHEN c.parent_id IN (SELECT entity_id FROM catalog_category_entity) THEN c.parent_id END AS parent, level, position, coalesce(a.value, 1) = 0 AS off, v.value AS name FROM catalog_category_entity c LEFT JOIN catalog_category_entity_int a ON a.entity_id = c.entity_id AND a.store_id = 0 LEFT JOIN catalog_category_entity_varchar v ON v.entity_id = c.entity_id)
SELECT n.entity_id, n.name, n.level, NOT (n.off OR coalesce(p.off, false) OR coalesce(g.off, false)) AS visible, (SELECT count(*) FROM catalog_category_product x WHERE x.category_id = n.entity_id) AS products,
  (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM store_group s WHERE s.root_category_id = n.entity_id AND s.group_id > 0) AS root_of
FROM n LEFT JOIN n p ON p.entity_id = n.parent LEFT JOIN n g ON g.entity_id = p.parent WHERE n.entity_id <> 1""")
def category_list(shop):
    root = F.array_join(F.coalesce("root_of", F.array().cast("array<string>")), ",").alias("root_of")
    return shop.category_list().select("entity_id", "name", "level", "visible", "products", root)


@query("SELECT entity_id, value AS name FROM catalog_category_entity_varchar WHERE value LIKE '%1%' ORDER BY value, entity_id LIMIT 6")
def search_categories(shop):
    return shop.categories_like("1", 6).select("entity_id", "name")


@query("SELECT entity_id, sku, type_id FROM catalog_product_entity WHERE entity_id % 7 = 0")
def skus_of_ids(shop):
    return shop.skus_of(shop.table("catalog_product_entity").filter("entity_id % 7 = 0"))


@query("SELECT e.entity_id, e.email, concat_ws(' ', firstname, lastname) AS name FROM customer_entity e WHERE email LIKE '%9%' OR concat_ws(' ', firstname, lastname) LIKE '%9%' ORDER BY email, entity_id LIMIT 25")
def search_customers(shop):
    return shop.customers_like("9", 25).select("entity_id", "email", "name")
