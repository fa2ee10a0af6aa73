"""Each command answers, over a small tree and snapshots of a store's tables."""

import pytest

from declgraph.__main__ import COMMANDS, run, text_of
from declgraph.queries import store
from helpers import DATA
from test_catalogues import TREE

ARGUMENTS = {
    "preference": "T\\A\\I", "plugins": "T\\A\\M", "whatis": "T\\A\\M", "uses": "T\\A\\M", "price": "sku-10", "product": "sku-10", "product-links": "sku-10", "category": "5", "order": "000000007",
    "customer": "c7@x.y", "quote": "7", "invoice": "000000008", "shipment": "000000009", "creditmemo": "14", "sales-rule": "3", "coupon": "C3", "catalog-rule": "3", "cms-page": "nation_3", "eav": "catalog_product", "cron-history": "click1",
    "targets": "T\\A\\Plugin", "fieldset-field": "name", "files": "Servus", "source": "composer.json", "template-usages": "T_A::used.phtml", "products": "-1", "orders": "77", "url-rewrites": "ring", "all-plugins": "T\\A\\M", "chains": "T\\A\\M", "all-chains": "T\\A\\M",
}
#: Commands for which this tree and this store hold nothing.
EMPTY = {"base-url", "drift", "patches", "diagnostics", "config", "config-scopes", "acl", "acl-ancestors", "acl-children", "menu", "menu-ancestors", "menu-children", "schema", "tables", "columns", "webapi", "cron", "ui-components", "components", "cms-block", "sequences", "deps", "classes", "creditmemo", "routes", "layout", "layouts", "templates", "actions"}


@pytest.fixture(scope="module")
def places(tmp_path_factory, spark):
    root, tables = tmp_path_factory.mktemp("root"), tmp_path_factory.mktemp("store")
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    shop = store.cards(spark, DATA)
    for name in store.SNAPSHOT:
        shop.read(name).coalesce(1).write.parquet(str(tables / f"{name}.parquet"))
    return str(root), str(tables)


@pytest.mark.parametrize("command", sorted(COMMANDS))
def test_command(spark, places, command):
    root, tables = places
    given = [ARGUMENTS[command]] if command in ARGUMENTS else []
    found, as_json = run(spark, [root, command, *given, "--store", tables, "--now", "2025-01-01 00:00:00", "--json"])
    rows = found.collect()
    assert as_json and (rows or command in EMPTY)
    assert all(isinstance(text_of(r), str) for r in rows)


def test_areas_and_places(spark, places):
    root, tables = places
    shown = [text_of(r) for r in run(spark, [root, "events", "e", "--area", "global"])[0].collect()]
    assert len(shown) == 2 and all("# app/code/T/A/etc/events.xml:1" in x for x in shown)
    assert run(spark, [root, "actions", "--area", "frontend"])[0].count() == 1
    with pytest.raises(SystemExit):
        run(spark, [root, "nothing"])
