"""A small installation of two modules and a disabled one."""

import pytest

from declgraph.plans.doctor import doctor, suggestions
from declgraph.plans.installation import Installation
from declgraph.sources import files, php
from declgraph.sources.xml import nodes_of

A, B = "app/code/T/A", "app/code/T/B"
TREE = {
    "app/etc/config.php": "<?php return ['modules' => ['T_A' => 1, 'T_B' => 1, 'T_Off' => 0, 'T_Gone' => 1], 'system' => ['default' => ['x' => ['y' => ['z' => 'config']]]]];",
    "app/etc/env.php": "<?php return array('system' => array('default' => array('x' => array('y' => array('z' => 'env', 'w' => true)))));",
    "app/etc/di.xml": r'<config><type name="T\A\Pool"><arguments><argument name="operations" xsi:type="array"><item name="default" xsi:type="string">d</item></argument></arguments></type></config>',
    f"{A}/etc/module.xml": '<config><module name="T_A"><sequence><module name="T_B"/></sequence></module></config>',
    f"{B}/etc/module.xml": '<config><module name="T_B"><sequence><module name="T_A"/></sequence></module></config>',
    "app/code/T/Off/etc/module.xml": '<config><module name="T_Off"/></config>',
    "app/code/T/Off/etc/di.xml": r'<config><preference for="T\A\Api\I" type="T\Off\X"/></config>',
    "vendor/t/new/etc/module.xml": '<config><module name="T_New"/></config>',
    f"{A}/etc/di.xml": r"""<config>
<preference for="\T\A\Api\I" type="T\A\Model\M"/>
<preference for="T\A\Api\J" type="T\A\Model\Moo"/>
<type name="T\A\Api\I"><plugin name="p" type="T\A\Plugin\P" sortOrder="20"/></type>
<type name="T\A\Model\Base"><plugin name="late" type="T\A\Plugin\L" sortOrder="5"/><plugin name="q" type="T\A\Plugin\Q"/></type>
</config>""",
    f"{B}/etc/di.xml": r"""<config>
<type name="T\A\Api\I"><plugin name="p" disabled="true"/></type>
<type name="T\A\Pool"><arguments><argument name="operations" xsi:type="array"><item name="b" xsi:type="object">T\A\Model\M</item></argument></arguments></type>
<virtualType name="virt" type="T\A\Model\M"/>
</config>""",
    f"{B}/etc/frontend/di.xml": r'<config><type name="T\A\Model\M"><plugin name="q"/></type><type name="T\A\Api\I"><plugin name="p" disabled="false"/></type></config>',
    f"{A}/Model/M.php": "<?php\nnamespace T\\A\\Model;\nuse T\\A\\Api\\{I as Face};\n/* class No {} */\nclass M extends Base implements Face, \\Other\\K { }",
    f"{A}/Model/Base.php": "<?php namespace T\\A\\Model; abstract class Base {}",
    f"{A}/Api/I.php": "<?php namespace T\\A\\Api; interface I {}",
    f"{A}/Plugin/P.php": "<?php namespace T\\A\\Plugin; class P { public function beforeSave($x) {} public function afterSave($x, $y) {} private function aroundHidden() {} }",
    f"{A}/Plugin/L.php": "<?php namespace T\\A\\Plugin; class L { public function aroundSave($x, $y) {} }",
    f"{A}/Plugin/Q.php": "<?php namespace T\\A\\Plugin; class Q {}",
    f"{A}/etc/events.xml": r'<config><event name="e"><observer name="o" instance="T\A\Plugin\P" shared="false"/></event></config>',
    f"{B}/etc/frontend/events.xml": r'<config><event name="e"><observer name="o" instance="T\A\Plugin\P" disabled="true"/></event></config>',
    f"{A}/etc/frontend/routes.xml": '<config><router id="standard"><route id="r" frontName="shop"><module name="T_A"/></route></router></config>',
    f"{B}/etc/frontend/routes.xml": '<config><router id="standard"><route id="r" frontName=""><module name="T_B"/><module name="T_A"/></route></router></config>',
    f"{A}/etc/db_schema.xml": '<schema><table name="t" comment="one"><column name="c1" xsi:type="int"/><column name="c2" xsi:type="int"/></table><table name="u"><column name="d" xsi:type="int"/><column name="e" xsi:type="int"/></table></schema>',
    f"{B}/etc/db_schema.xml": '<schema><table name="t" disabled="true"/><table name="t" engine="innodb"><column name="c3" xsi:type="text"/></table><table name="u"><column name="d" disabled="true"/></table></schema>',
    f"{A}/etc/acl.xml": '<config><acl><resources><resource id="root"><resource id="b" title="B" sortOrder="2"><resource id="b1"/></resource><resource id="a" title="A" sortOrder="10"/></resource></resources></acl></config>',
    f"{B}/etc/acl.xml": '<config><acl><resources><resource id="root"><resource id="b" sortOrder="20" disabled="true"/></resource></resources></acl></config>',
    f"{A}/etc/adminhtml/menu.xml": '<config><menu><add id="m" title="M" sortOrder="1"/><add id="n" title="N" parent="m" resource="a"/></menu></config>',
    f"{B}/etc/adminhtml/menu.xml": '<config><menu><remove id="m"/><update id="n" title="N2"/></menu></config>',
    f"{A}/etc/webapi.xml": r'<routes><route url="/V1/x" method="GET"><service class="T\A\Api\I" method="get"/><resources><resource ref="self"/><resource ref="nope"/></resources></route></routes>',
    f"{A}/etc/config.xml": "<config><default><x><y><z>module</z><v>only</v></y></x></default><websites><w1><x><y><v>site</v></y></x></w1></websites></config>",
    f"{A}/etc/communication.xml": r'<config><topic name="a.b" request="string"><handler name="h" type="T\A\Plugin\Gone" method="run"/></topic><topic name="z"/></config>',
    f"{A}/etc/queue_publisher.xml": '<config><publisher topic="a.b" queue="direct"/></config>',
    f"{A}/etc/queue_topology.xml": '<config><exchange name="x"><binding id="i" topic="a.#" destination="fan"/></exchange></config>',
    f"{A}/etc/queue_consumer.xml": '<config><consumer name="eater" queue="fan"/></config>',
    f"{A}/etc/broken.xml": "<config><a></config>",
}


@pytest.fixture(scope="module")
def shop(spark):
    return Installation(spark.createDataFrame(sorted(TREE.items()), "path string, content string").repartition(5))


def test_modules(shop):
    assert {r.name: (r.state, r.load_order) for r in shop.modules.collect()} == {"T_A": ("enabled", 0), "T_B": ("enabled", 1), "T_Off": ("disabled", 2), "T_Gone": ("missing on disk", 3), "T_New": ("not registered", None)}


def test_preferences(shop):
    found = {r.node: r.target for r in shop.preference_of("global").collect()}
    assert found["T\\A\\Api\\I"] == "T\\A\\Model\\M"


def test_plugins(shop):
    globally = {(r["class"], r.name) for r in shop.plugins_on("global").collect()}
    assert ("T\\A\\Model\\M", "q") in globally and ("T\\A\\Model\\M", "p") not in globally and ("virt", "late") in globally
    front = [(r.name, r.plugin) for r in shop.plugins_on("frontend").collect() if r["class"] == "T\\A\\Model\\M"]
    assert front == [("late", "T\\A\\Plugin\\L"), ("p", "T\\A\\Plugin\\P")]  # q is claimed by a nearer type without class
    merged = shop.plugins.filter("area = 'global' AND name = 'p'").first()
    assert merged.disabled and merged.sort_order == 20 and merged.first_load_order == 0 and merged.source.module == "T_B"


def test_chains(shop):
    found = {(r["class"], r.method): [tuple(s) for s in r.steps] for r in shop.chains("frontend").collect()}
    p, late = "T\\A\\Plugin\\P", "T\\A\\Plugin\\L"
    assert found["T\\A\\Model\\M", "save"] == [("before", "p", p), ("around", "late", late), ("after", "p", p)]


def test_arguments(shop):
    found = {tuple(r.path): (r.kind, r.value) for r in shop.arguments.filter("area = 'global'").collect()}
    assert found == {("operations",): ("array", None), ("operations", "b"): ("object", "T\\A\\Model\\M")}


def test_resolution_of_all_areas(shop):
    rows = {(r.area, r["class"]): (r.target, r.plugins) for r in shop.resolve_all().collect()}
    assert rows["frontend", "T\\A\\Api\\I"] == ("T\\A\\Model\\M", ["late", "p"])
    assert {a for a, _ in rows} == {"frontend"}


def test_uses(shop):
    assert {(r.how, r.by) for r in shop.uses("T\\A\\Model\\M").collect()} == {("preference", "\\T\\A\\Api\\I"), ("virtual type of", "virt"), ("argument", "T\\A\\Pool"), ("plugin on", None)}


def test_events_and_routes(shop):
    found = {r.area: (r.disabled, r.shared, r.instance) for r in shop.observers.collect()}
    assert found["global"] == (None, False, "T\\A\\Plugin\\P") and found["frontend"] == (True, False, "T\\A\\Plugin\\P")
    (route,) = shop.routes.collect()
    assert (route.area, route.front_name, route.modules) == ("frontend", "shop", ["T_A", "T_B"])


def test_schema(shop):
    assert {r.name: (r.engine, r.comment) for r in shop.tables.collect()} == {"t": ("innodb", None), "u": (None, None)}
    assert {(r.table, r.name) for r in shop.parts_of_tables("columns", "name").collect()} == {("t", "c3"), ("u", "e")}


def test_trees(shop):
    assert [(r.id, r.depth, r.disabled) for r in shop.acl.orderBy("path").collect()] == [("root", 0, False), ("a", 1, False), ("b", 1, True), ("b1", 2, False)]
    assert [(r.id, r.title, r.depth) for r in shop.menu.collect()] == [("n", "N2", 0)]


def test_configuration(shop, spark):
    stored = spark.createDataFrame([("default", "x/y/z", "db"), ("stores/s1", "x/y/q", "store")], "scope string, path string, value string")
    values = shop.config_values(stored, {"CONFIG__STORES__S2__X__Y__Z": "variable", "HOME": "/"})
    found = {(r.scope, r.path): (r.value, r.source) for r in values.collect()}
    assert found["default", "x/y/z"] == ("env", "env.php") and found["stores/s2", "x/y/z"] == ("variable", "environment") and found["default", "x/y/w"] == ("1", "env.php")
    seen = {r.path: r.value for r in shop.config_in(values, "stores/s1", {"s1": "w1"}).collect()}
    assert seen == {"x/y/z": "env", "x/y/v": "site", "x/y/q": "store", "x/y/w": "1"}
    assert {r.path: r.value for r in shop.config_in(values, "stores/s9", {"s1": "w1"}).collect()}["x/y/v"] == "only"


def test_queues(shop):
    found = {(r.topic, r.queue, r.via, r.consumer) for r in shop.queue_routes().collect()}
    assert found == {("a.b", "direct", "publisher", None), ("a.b", "fan", "binding", "eater"), ("z", None, None, None)}


def test_doctor(shop):
    found = doctor(shop, ["T\\"])
    rows = {(r.lint, r.subject) for r in found.collect()}
    assert rows == {
        ("ModuleMissingOnDisk", "T_Gone"), ("ModuleNotRegistered", "T_New"), ("PreferenceTargetMissing", "T\\A\\Model\\Moo"), ("MqHandlerMissing", "T\\A\\Plugin\\Gone"),
        ("AclResourceUnknown", "nope"), ("SequenceCycle", "T_A > T_B"),
    }
    near = {r.subject: (r.suggestion, r.distance) for r in suggestions(found, shop).collect()}
    assert near["T\\A\\Model\\Moo"] == ("T\\A\\Model\\M", 2) and near["T_Gone"] == (None, None)


def test_diagnostics_and_buffers(shop, spark):
    assert [r.path for r in shop.diagnostics().collect()] == [f"{A}/etc/broken.xml"]
    buffers = spark.createDataFrame([(f"{A}/etc/di.xml", r'<config><preference for="T\A\Api\I" type="T\A\Model\Base"/></config>')], "path string, content string")
    found = {r.node: r.target for r in Installation(shop.files, buffers).preference_of("global").collect()}
    assert found == {"T\\A\\Api\\I": "T\\A\\Model\\Base"}


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "app" / "etc").mkdir(parents=True)
    (tmp_path / "app" / "etc" / "config.php").write_text("<?php return [];")
    assert [tuple(r) for r in files.read_files(spark, str(tmp_path)).collect()] == [("app/etc/config.php", "<?php return [];")]


def test_php_literals():
    assert php.array_literal("<?php return ['a' => [1, 2.5, 'k' => \"x\\\"y\"], // no\n 'b' => null, 7 => true, false];") == [("a", [(0, 1), (1, 2.5), ("k", 'x"y')]), ("b", None), (7, True), (8, False)]
    with pytest.raises(ValueError):
        php.array_literal("return [1, 2")
    assert php.class_header("<?php // class X {\n$x = 'class Y {';") is None


def test_lines_of_nodes():
    nodes, error = nodes_of("<a>\n<b k='1'>t</b>\n</a>")
    assert [(n[1], n[2], n[3], n[4]) for n in nodes] == [(1, "a", {}, ""), (2, "b", {"k": "1"}, "t")] and error is None


def test_relations(shop, spark):
    from declgraph.plans import relations

    packages = spark.createDataFrame([("T_A", "T_B")], "module string, requires string")
    found = {(r.module, r.other, r.direction): (r.sequence, r.package) for r in relations.dependencies(shop, packages).collect()}
    assert found["T_A", "T_B", "needs"] == (True, True) and found["T_A", "T_B", "needed by"] == (True, False) and len(found) == 4
    assert [r.id for r in relations.ancestors(shop.acl, "id", "parent", "b1").collect()] == ["root", "b"]
    plugged = {r["class"] for r in relations.interception(shop).filter("intercepted").collect()}
    assert {"T\\A\\Model\\M", "T\\A\\Model\\Base", "T\\A\\Api\\I"} <= plugged and "T\\A\\Plugin\\Q" not in plugged
    assert relations.unregistered_plugins(shop).count() == 0
    facts = {(r.what, r.detail) for r in relations.whatis(shop, "T\\A\\Model\\M").collect()}
    assert {("declared as", "class"), ("is a", "T\\A\\Api\\I"), ("is a", "Other\\K"), ("used as", "virtual type of virt"), ("used as", "argument T\\A\\Pool")} <= facts
    themes = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "a")], "theme string, parent string")
    assert [r.theme for r in relations.theme_chain(themes, "c").collect()] == ["c", "b", "a"]
