"""Live queries over small snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from declgraph.plans.live import COLUMNS, Live, schema_drift

T = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
ROWS = {
    "store_website": [(1, "base", "Main", 1), (2, "empty", "E", 0)],
    "store_group": [(1, "g", 1, 2)],
    "store": [(1, "en", "English", 1, 1, 1), (2, "de", "German", 1, 1, 0)],
    "customer_group": [(0, "NOT LOGGED IN", 3), (1, "General", 3)],
    "tax_class": [(3, "Retail")],
    "customer_entity": [(1, "a@x", "Ann", "Lee", 1, 1, T(0)), (2, "b@x", "Bo", None, 1, 1, T(0))],
    "sales_order": [(10, "000000010", "complete", "complete", 1, "a@x", 1, 5.5, 0, T(5)), (11, "000000011", "new", "new", 1, "a@x", 1, 4.5, 0, T(9))],
    "sales_order_payment": [(10, "card", "TX-1", None), (10, "card", "tx-12", None)],
    "sales_order_status": [("new", "New"), ("odd", "Odd")],
    "sales_order_status_state": [("new", "new", 1, 1)],
    "sales_sequence_meta": [(1, "order", 1, "sequence_order_1"), (2, "invoice", 1, "sequence_invoice_1")],
    "sales_sequence_profile": [(1, "A", "", 1, 2, 100, 6, 1), (2, None, None, 7, 1, 100, 90, 1)],
    "url_rewrite": [(1, "product", 5, "a.html", "catalog/5", 0, 1, None, 1), (2, "custom", 0, "Old", "a.html", 301, 1, None, 0)],
    "cron_schedule": [(1, "j", "success", None, T(0), T(1), T(2)), (2, "j", "error", "x", T(0), T(1), T(2)), (3, "j", "pending", None, T(9), None, None)],
    "queue": [(1, "q")],
    "queue_message_status": [(1, 1, 2, T(0)), (2, 1, 6, T(3))],
    "indexer_state": [("price", "valid", T(0))],
    "mview_state": [("price_view", "enabled", "idle", 3)],
    "admin_user": [(1, "root", "r@x", 1, T(0), T(40), None), (2, "locked", "l@x", 0, T(0), None, T(900))],
    "authorization_role": [(1, 0, "G", "2", 0, "Admins"), (2, 1, "U", "2", 1, "root"), (3, 0, "G", "2", 0, "Nobody"), (4, 3, "U", "1", 2, "an integration")],
    "authorization_rule": [(1, "all", "allow"), (1, "some", "deny")],
    "eav_entity_type": [(3, "catalog_category"), (4, "catalog_product")],
    "eav_attribute": [(1, 3, "name", "varchar", "text", "Name", 1), (2, 3, "is_active", "int", "select", "On", 0), (5, 4, "name", "varchar", "text", "Name", 1), (6, 4, "price", "decimal", "price", "Price", 0)],
    "catalog_category_entity": [(1, 0, 0, 0), (2, 1, 1, 1), (3, 2, 2, 2), (4, 2, 2, 1), (5, 3, 3, 1)],
    "catalog_product_entity": [(5, "sku5", "simple"), (6, "sku6", "simple")],
    "salesrule": [(1, "Summer", 1, 0), (2, "Winter", 1, 0)],
    "salesrule_coupon": [(1, 1, "WARM", 0)],
    "cms_page": [(1, "home", "Home", 1), (2, "about", "At home", 1), (3, "x", "X", 1)],
    "patch_list": [("P1",), ("Old",)],
}
#: Columns of the rows above where the tables have more.
SHAPES = {
    "customer_entity": "entity_id int, email string, firstname string, lastname string, group_id int, website_id int, created_at timestamp",
    "sales_order": "entity_id long, increment_id string, status string, state string, customer_id int, customer_email string, store_id int, grand_total decimal(20,4), total_refunded decimal(20,4), created_at timestamp",
    "sales_order_payment": "parent_id long, method string, last_trans_id string, po_number string",
    "authorization_role": "role_id int, parent_id int, role_type string, user_type string, user_id int, role_name string",
    "catalog_category_entity": "entity_id int, parent_id int, level int, position int",
    "catalog_product_entity": "entity_id int, sku string, type_id string",
    "cms_page": "page_id int, identifier string, title string, is_active int",
    "salesrule": "rule_id int, name string, is_active int, sort_order int",
    "salesrule_coupon": "coupon_id int, rule_id int, code string, times_used int",
}
VALUES = {
    "catalog_category_entity_varchar": [(1, 1, 0, "Root"), (3, 1, 0, "Off"), (3, 1, 2, "Aus"), (4, 1, 0, "First")],
    "catalog_category_entity_int": [(3, 2, 0, "0")],
    "catalog_product_entity_varchar": [(5, 5, 0, "Five"), (5, 5, 1, "Cinq"), (6, 5, 0, "Six")],
    "catalog_product_entity_decimal": [(5, 6, 0, "9.5")],
}


@pytest.fixture(scope="module")
def live(spark):
    def read(name):
        if name in ROWS:
            columns = SHAPES.get(name, COLUMNS[name])
            kinds = [c.split()[1] for c in columns.split(", ")]
            plain = ", ".join(c if "decimal" not in c else f"{c.split()[0]} double" for c in columns.replace("decimal(20,4)", "decimal").split(", "))
            rows = [tuple(float(v) if k.startswith("decimal") and v is not None else v for v, k in zip(r, kinds)) for r in ROWS[name]]
            return spark.createDataFrame(rows, plain)
        if name in VALUES:
            return spark.createDataFrame(VALUES[name], "entity_id int, attribute_id int, store_id int, value string")
        if name == "price_view_cl":
            return spark.createDataFrame([(1, 2), (1, 4), (1, 5), (2, 6)], "entity_id long, version_id long")
        if name == "sequence_order_1":
            return spark.createDataFrame([(3,), (5,)], "sequence_value long")

    return Live(spark, read)


def now():
    return F.lit(T(100)).cast("timestamp")


def test_stores_and_groups(live):
    assert [(r.website, r.group, r.store) for r in live.store_tree().collect()] == [("base", "g", "en"), ("base", "g", "de"), ("empty", None, None)]
    assert {(r.customer_group_code, r.class_name, r.customers) for r in live.customer_groups().collect()} == {("NOT LOGGED IN", "Retail", 0), ("General", "Retail", 2)}


def test_sequences(live):
    assert {(r.entity_type, r.next, r.warns) for r in live.sequences().collect()} == {("order", "A000000007", True), ("invoice", "000000007", False)}


def test_operations(live, spark):
    (r,) = live.cron(now()).collect()
    assert (r.n_success, r.n_error, r.n_pending, r.n_all, r.schedule_id, r.last_status, r.seconds_ago) == (1, 1, 1, 3, 2, "error", 99)
    assert [r.schedule_id for r in live.cron_history("j", 2).collect()] == [2, 1]  # what waits is no run
    found = {r.queue: (r.declared, r.stored, r.new, r.error, r.oldest_seconds) for r in live.queue_backlog(spark.createDataFrame([("d",)], "queue string"), now()).collect()}
    assert found == {"q": (False, True, 1, 1, 100), "d": (True, False, 0, 0, None)}
    views = spark.createDataFrame([("price", "price_view"), ("none", None)], "id string, view_id string")
    assert {(r.id, r.status, r.backlog) for r in live.indexers(views).collect()} == {("price", "valid", 2), ("none", None, None)}
    rewrites = live.url_rewrites("A.HTML", limit=1).collect()
    assert [(r.request_path, r.truncated) for r in rewrites] == [("Old", True)]
    assert live.url_rewrites(redirects=True, store="en").count() == 1


def test_administration(live):
    assert {(r.username, r.role_name, r.locked, r.seconds_since_login) for r in live.admin_users(now()).collect()} == {("root", "Admins", False, 60), ("locked", None, True, None)}
    assert [(r.role_name, r.users, r.resources) for r in live.admin_roles().collect()] == [("Admins", ["root"], ["all"]), ("Nobody", None, None)]


def test_catalogue(live, spark):
    assert {(r.entity_type_code, r.attributes) for r in live.entity_types().collect()} == {("catalog_category", 2), ("catalog_product", 2)}
    ids = spark.createDataFrame([(5,), (5,), (6,)], "entity_id int")
    assert {(r.sku, tuple(r.attributes)) for r in live.products(ids, 1).collect()} == {("sku5", ("name=Cinq", "price=9.5")), ("sku6", ("name=Six",))}
    assert [(r.entity_id, r.name, r.visible, r.depth) for r in live.category_tree(2).collect()] == [(1, "Root", True, 0), (2, None, True, 1), (4, "First", True, 2), (3, "Aus", False, 2), (5, None, False, 3)]


def test_sales_and_customers(live, spark):
    assert [(r.status, r.state) for r in live.order_statuses().collect()] == [("new", "new"), ("odd", None)]
    assert [(r.increment_id, r.truncated) for r in live.orders_like("tx-1", 5).collect()] == [("000000010", False)]
    assert [(r.increment_id, r.truncated) for r in live.orders_like("A@X", 1).collect()] == [("000000011", True)]
    ids = spark.createDataFrame([(1,), (2,)], "entity_id int")
    assert {(r.entity_id, r.orders, r.spent) for r in live.customers(ids).collect()} == {(1, 2, 10.0), (2, 0, None)}
    assert [r.email for r in live.customers_like("ann lee", 5).collect()] == ["a@x"]
    assert [r.id for r in live.cms_like("page", "HOME", 5).collect()] == [2, 1]
    assert [r.rule_id for r in live.sales_rules_like("w", 5).collect()] == [2, 1]


def test_drift(live, spark):
    declared = spark.createDataFrame([("P1",), ("P2",)], "patch string")
    assert {tuple(r) for r in live.patches(declared).collect()} == {("P1", "applied"), ("P2", "pending"), ("Old", "orphaned")}
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "table string")
    found = {r.table: (r["class"], r.unlisted) for r in schema_drift(frame("a", "b"), frame("b", "c", "d", "x_cl"), frame("b", "c", "x_cl")).collect()}
    assert found == {"a": ("missing", True), "b": ("present", False), "c": ("would drop", False), "d": ("undeclared", False), "x_cl": ("skipped", False)}


def test_missing_tables_are_empty(spark):
    empty = Live(spark, lambda name: None)
    assert empty.store_tree().count() == 0 and empty.orders_like("x", 3).count() == 0 and empty.category_tree().count() == 0 and empty.sequences().count() == 0
