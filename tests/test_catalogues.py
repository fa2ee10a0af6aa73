"""The catalogues beyond wiring, over a small tree of two modules."""

import pytest

from declgraph.plans.catalogues import Catalogues, lints
from declgraph.sources import php

A, B = "app/code/T/A", "app/code/T/B"
LIST = "Magento\\Framework\\Console\\CommandListInterface"
TREE = {
    "app/etc/config.php": "<?php return ['modules' => ['T_A' => 1, 'T_B' => 1]];",
    "app/etc/env.php": "<?php return ['MAGE_MODE' => 'production', 'backend' => ['frontName' => 'adm'], 'session' => ['save' => 'redis', 'redis' => ['host' => 'h', 'port' => '6379']], "
    "'cache' => ['frontend' => ['default' => ['backend' => 'X', 'backend_options' => ['server' => 's']]]], 'lock' => ['provider' => 'db'], 'queue' => ['amqp' => ['host' => 'q']], 'db' => ['table_prefix' => 'p_', 'connection' => ['default' => ['host' => 'd']]]];",
    f"{A}/etc/module.xml": '<config><module name="T_A"/></config>',
    f"{B}/etc/module.xml": '<config><module name="T_B"/></config>',
    f"{A}/etc/di.xml": rf"""<config><preference for="{LIST}" type="T\A\Commands"/><preference for="T\A\I" type="T\A\M"/>
<type name="{LIST}"><arguments><argument name="commands" xsi:type="array"><item name="one" xsi:type="object">T\A\Command\One</item><item name="gone" xsi:type="object">T\A\Command\Gone</item></argument></arguments></type>
<type name="T\A\Base"><arguments><argument name="x" xsi:type="string">base</argument><argument name="y" xsi:type="string">base</argument></arguments><plugin name="p" type="T\A\Plugin" sortOrder="3"/></type>
<type name="T\A\M"><arguments><argument name="y" xsi:type="string">own</argument></arguments></type>
<virtualType name="v" type="T\A\M"><arguments><argument name="z" xsi:type="string">v</argument></arguments></virtualType>
<virtualType name="c1" type="c2"/><virtualType name="c2" type="c1"/></config>""",
    f"{B}/etc/frontend/di.xml": r'<config><type name="T\A\Base"><plugin name="p" sortOrder="1"/><plugin name="f" type="T\A\Plugin"/></type></config>',
    f"{B}/etc/pos/di.xml": r'<config><preference for="T\A\I" type="T\B\Pos"/></config>',
    f"{A}/M.php": "<?php namespace T\\A; class M extends Base {}",
    f"{A}/Base.php": "<?php namespace T\\A; abstract class Base {}",
    f"{A}/Plugin.php": "<?php namespace T\\A; class Plugin { public function beforeSave() {} }",
    f"{A}/Command/One.php": "<?php namespace T\\A\\Command;\nuse Symfony\\Component\\Console\\Command\\Command;\nclass One extends Command { const N = 'a:one'; function configure() { /* setName('no') */ $this->setName(self::N)->setDescription('does'); } }",
    f"{A}/Command/Two.php": "<?php namespace T\\A\\Command; use Symfony\\Component\\Console\\Command\\Command; class Two extends Command { protected static $defaultName = 'a:two'; }",
    f"{A}/Observer/Lost.php": "<?php namespace T\\A\\Observer; class Lost implements \\Magento\\Framework\\Event\\ObserverInterface {}",
    f"{A}/Controller/Cart/Add.php": "<?php namespace T\\A\\Controller\\Cart; class Add {}",
    f"{A}/Controller/Adminhtml/X/Edit.php": "<?php namespace T\\A\\Controller\\Adminhtml\\X; class Edit {}",
    f"{A}/Setup/Patch.php": "<?php namespace T\\A\\Setup; class Patch { function apply() {\n $s->addAttribute(\\Some\\Product::ENTITY, 'color', []);\n // $s->addAttribute('x', 'no');\n $s->removeAttribute('customer', \"vat\"); new Block('T_A::used.phtml'); } }",
    f"{A}/etc/frontend/routes.xml": '<config><router id="standard"><route id="r" frontName="shop"><module name="T_A"/></route></router></config>',
    f"{A}/etc/adminhtml/routes.xml": '<config><router id="admin"><route id="r" frontName="back"><module name="T_A"/></route></router></config>',
    f"{A}/etc/events.xml": r'<config><event name="e"><observer name="o" instance="T\A\Plugin"/><observer name="p" instance="T\A\Plugin"/></event><event name="d"><observer name="o" instance="T\A\Plugin"/></event></config>',
    f"{A}/etc/indexer.xml": r'<config><indexer id="i" view_id="v" class="T\A\M"><title>One</title><dependencies><indexer id="j"/></dependencies></indexer><indexer id="j" view_id="w" class="T\A\M"/></config>',
    f"{B}/etc/indexer.xml": '<config><indexer id="i"><title>Two</title><dependencies><indexer id="k"/><indexer id="j"/></dependencies></indexer></config>',
    f"{A}/etc/mview.xml": '<config><view id="v"><subscriptions><table name="t" entity_column="a"/><table name="s" entity_column="b"/></subscriptions></view></config>',
    f"{B}/etc/mview.xml": '<config><view id="v"><subscriptions><table name="t" entity_column="c"/></subscriptions></view></config>',
    f"{A}/etc/extension_attributes.xml": r'<config><extension_attributes for="T\A\I"><attribute code="a" type="string"><resources><resource ref="old"/></resources></attribute><attribute code="b" type="int"/></extension_attributes></config>',
    f"{B}/etc/extension_attributes.xml": r'<config><extension_attributes for="T\A\I"><attribute code="a" type="float"><resources><resource ref="r2"/><resource ref="r1"/></resources><join reference_table="q" reference_field="f" join_on_field="o"><field>f1</field></join></attribute></extension_attributes></config>',
    f"{A}/etc/schema.graphqls": 'type Q implements X { a: Int @resolver(class: "T\\\\A\\\\M") b: String }\nenum E { ONE }\nunion U = Q | R',
    f"{B}/etc/schema.graphqls": 'extend type Q implements Y & X { c: Int b: Int @resolver(class: "T\\\\B\\\\Gone") }\nenum E { TWO ONE }',
    f"{A}/etc/adminhtml/system.xml": '<config><system><tab id="t"><label>Tab</label></tab><section id="s"><label>Sec</label><tab>t</tab><group id="g"><label>Grp</label><field id="f" type="text" showInDefault="1" showInStore="1"><label>F</label></field><field id="h" type="text"><config_path>x/y/z</config_path></field></group></section></system></config>',
    f"{B}/etc/adminhtml/system.xml": '<config><system><section id="s"><group id="g"><label/><field id="f" type="" showInWebsite="1"><label>F2</label><source_model>T\\B\\S</source_model></field></group></section></system></config>',
    f"{A}/etc/fieldset.xml": '<config><scope id="global"><fieldset id="q"><field name="name"><aspect name="to" /></field><field name="other"/></fieldset></scope><scope id="admin"><fieldset id="q"><field name="n"/></fieldset></scope></config>',
    f"{B}/etc/fieldset.xml": '<config><scope id="global"><fieldset id="q"><field name="name"><aspect name="to" targetField="x"/><aspect name="by"/></field></fieldset></scope></config>',
    f"{A}/etc/catalog_attributes.xml": '<config><group name="g"><attribute name="b"/><attribute name="a"/></group></config>',
    f"{B}/etc/catalog_attributes.xml": '<config><group name="g"><attribute name="a"/><attribute name="c"/></group></config>',
    f"{A}/etc/email_templates.xml": '<config><template id="m" label="M" file="m.html" type="html" module="T_A" area="frontend"/></config>',
    "app/design/frontend/V/one/T_A/email/m.html": "x",
    "app/design/frontend/V/one/theme.xml": "<theme><title>1</title></theme>",
    "app/design/frontend/V/two/theme.xml": "<theme><parent>V/one</parent></theme>",
    f"{A}/etc/widget.xml": r'<widgets><widget id="w" class="T\A\M"><label>W</label><parameters><parameter name="b" type="text" sort_order="2"/><parameter name="a" type="select" sort_order="9"/></parameters></widget></widgets>',
    f"{B}/etc/widget.xml": '<widgets><widget id="w"><description>D</description><parameters><parameter name="a" sort_order="1"/></parameters></widget></widgets>',
    f"{A}/etc/communication.xml": r'<config><topic name="t.x" request="string"><handler name="h" type="T\A\M" method="run"/></topic></config>',
    f"{A}/etc/queue_publisher.xml": '<config><publisher topic="t.x" queue="direct"/></config>',
    f"{A}/etc/queue_topology.xml": '<config><exchange name="x"/><exchange name="x" connection="db"/></config>',
    f"{A}/etc/queue_consumer.xml": r'<config><consumer name="eater" queue="fan" handler="T\A\Nowhere::run"/></config>',
    f"{A}/etc/db_schema_whitelist.json": '{"t": {"column": {"a": true}, "index": {}}, "u": {}}',
    f"{B}/etc/db_schema_whitelist.json": '{"t": {"column": {"a": true, "b": true}}}',
    f"{A}/i18n/de_DE.csv": "Hello,Hallo\nSame,Same\n",
    "app/design/frontend/V/one/i18n/de_DE.csv": "Hello,Servus\n",
    "app/i18n/v/de/language.xml": "<language><code>de_DE</code><vendor>v</vendor><package>de</package><sort_order>5</sort_order><use vendor=\"v\" package=\"en\"/></language>",
    "app/i18n/v/en/language.xml": "<language><code>en_US</code><vendor>v</vendor><package>en</package></language>",
    "composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/"}}}',
    "vendor/composer/installed.json": '{"packages": [{"name": "v/a", "type": "module", "install-path": "../v/a", "autoload": {"psr-4": {"V\\\\A\\\\": ""}}, "require": {"v/b": "*", "php": "8"}}, {"name": "v/b", "type": "module", "install-path": "../v/b"}]}',
    "vendor/v/a/etc/module.xml": '<config><module name="V_A"/></config>',
    "vendor/v/b/etc/module.xml": '<config><module name="V_B"/></config>',
    f"{A}/view/frontend/layout/x.xml": '<page><block name="b" template="T_A::gone.phtml"/></page>',
}


@pytest.fixture(scope="module")
def shop(spark):
    return Catalogues(spark.createDataFrame(sorted(TREE.items()), "path string, content string").repartition(4))


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_exports(shop):
    assert rows(shop.custom_areas, "area") == [("pos",)]
    pos = shop.export("pos")
    assert dict(rows(pos["preferences"], "for", "type"))["T\\A\\I"] == "T\\B\\Pos" and rows(shop.export("pos", True)["preferences"], "for") == [("T\\A\\I",)]
    assert dict(rows(shop.export("frontend")["preferences"], "for", "type"))["T\\A\\I"] == "T\\A\\M"
    front = {r.name: (r["class"], r.sort_order) for r in shop.export("frontend")["plugins"].collect()}
    assert front == {"p": ("T\\A\\Plugin", 1), "f": ("T\\A\\Plugin", None)}
    assert tuple(shop.summary("global").first()) == (2, 3, 1, 1, 4)


def test_plugins_of_all_areas(shop):
    found = {(r["class"], r.name): (r.sort_order, tuple(r.areas)) for r in shop.plugins_everywhere().collect()}
    assert found["T\\A\\M", "p"][0] == 3 and found["T\\A\\M", "f"] == (None, ("frontend",)) and "graphql" in found["T\\A\\M", "p"][1]
    assert rows(shop.targets_of("T\\A\\Plugin"), "target", "name", "area") == [("T\\A\\Base", "f", "frontend"), ("T\\A\\Base", "p", "global")]
    chain = {(r["class"], r.method): [s[1] for s in r.steps] for r in shop.chains_everywhere().collect()}
    assert chain["T\\A\\M", "save"] == ["f", "p"]


def test_inherited_arguments(shop):
    found = {(r["class"], r.argument): (r.value, r.declared_on) for r in shop.inherited_arguments("global").collect()}
    assert found["v", "z"] == ("v", "v") and found["v", "y"] == ("own", "T\\A\\M") and found["v", "x"] == ("base", "T\\A\\Base")
    assert found["T\\A\\M", "x"] == ("base", "T\\A\\Base") and ("T\\A\\Base", "z") not in found


def test_commands(shop):
    assert rows(shop.console_commands(), "key", "name", "description") == [("one", "a:one", "does"), ("gone", None, None)]
    assert php.command("<?php #[AsCommand(name: 'x:y', description: \"d\")] class C {}") == {"class": "C", "name": "x:y", "description": "d"}
    assert rows(shop.eav_setups(), "entity", "attribute", "method", "line") == [("catalog_product", "color", "addAttribute", 2), ("customer", "vat", "removeAttribute", 4)]


def test_entry_points(shop):
    assert rows(shop.events("global"), "event", "observers") == [("d", 1), ("e", 2)]
    assert rows(shop.actions("frontend"), "url", "class") == [("shop/cart/add", "T\\A\\Controller\\Cart\\Add")]
    assert rows(shop.actions("adminhtml"), "url") == [("back/x/edit",)] and rows(shop.actions("frontend", "nothing"), "url") == []


def test_declared_catalogues(shop):
    assert rows(shop.indexers, "id", "title", "dependencies", "subscriptions") == [("i", "Two", ["j", "k"], ["s:b", "t:c"]), ("j", None, [], [])]
    found = rows(shop.extension_attributes, "code", "type", "resources", "reference_table", "fields")
    assert found == [("a", "float", ["r1", "r2"], "q", ["f1"]), ("b", "int", None, None, None)]
    types = {r.name: r for r in shop.graphql.collect()}
    assert types["Q"].interfaces == ["X", "Y"] and [(f.name, f.type) for f in types["Q"].fields] == [("a", "Int"), ("b", "Int"), ("c", "Int")]
    assert types["E"].members == ["ONE", "TWO"] and types["U"].members == ["Q", "R"]
    assert rows(shop.system_fields, "path", "label", "type", "tab", "section", "group", "scopes", "source_model") == [
        ("s/g/f", "F2", "text", "Tab", "Sec", "Grp", ["default", "website", "store"], "T\\B\\S"), ("x/y/z", None, "text", "Tab", "Sec", "Grp", [], None),
    ]
    assert rows(shop.fieldset("q"), "scope", "field") == [("admin", "n")] and rows(shop.fieldset_fields("na"), "field") == [("name",)] and rows(shop.fieldset_fields("other"), "field") == [("other",)]
    assert rows(shop.fieldsets.filter("field = 'name'"), "module", "aspects") == [("T_A", ["by=*", "to=x"])]
    assert rows(shop.catalog_attributes, "group", "attributes") == [("g", ["b", "a", "c"])]
    assert rows(shop.email_templates, "id", "overrides") == [("m", ["app/design/frontend/V/one/T_A/email/m.html"])]
    assert rows(shop.widgets, "id", "label", "description", "parameters") == [("w", "W", "D", ["a:select", "b:text"])]
    assert rows(shop.whitelist(), "table", "column") == [("t", None), ("t", "a"), ("t", "b"), ("u", None)]
    assert rows(shop.topology["exchanges"], "connection", "name") == [("amqp", "x"), ("db", "x")]


def test_themes_and_texts(shop):
    assert rows(shop.themes, "theme", "area", "parent") == [("V/one", "frontend", None), ("V/two", "frontend", "V/one")]
    assert sorted(rows(shop.inherited_languages(), "pack", "uses", "level")) == [("v/de", "v/de", 0), ("v/de", "v/en", 1), ("v/en", "v/en", 0)]
    assert rows(shop.translations("hell", "de_DE"), "layer", "value") == [(1, "Hallo"), (3, "Servus")]
    assert rows(shop.template_usages("T_A::used.phtml"), "path", "line") == [(f"{A}/Setup/Patch.php", 4)]


def test_deployment(shop):
    assert rows(shop.db_config(), "path", "value") == [("db/connection/default/host", "d"), ("db/table_prefix", "p_")]
    assert ("session/redis/host", "h") in rows(shop.redis_config(), "path", "value") and rows(shop.lock_config(), "value") == [("db",)]
    assert rows(shop.queue_config(), "path") == [("queue/amqp/host",)] and len(rows(shop.session_config(), "path")) == 3 and len(rows(shop.cache_config(), "path")) == 2
    assert ("mode", "production") in rows(shop.info(), "topic", "value")
    assert rows(shop.module_counts(), "source", "state", "modules") == [("app", "enabled", 2), ("vendor", "not registered", 2)]
    assert rows(shop.files_containing("Servus"), "path") == [("app/design/frontend/V/one/i18n/de_DE.csv",)] and shop.source_text("composer.json").count() == 1
    assert rows(shop.packages(), "package", "folder", "requires") == [("v/a", "vendor/v/a", ["php", "v/b"]), ("v/b", "vendor/v/b", [])]
    assert rows(shop.psr4(), "prefix", "folder") == [("App\\", "src"), ("V\\A\\", "vendor/v/a")]
    assert rows(shop.package_dependencies(), "module", "requires") == [("V_A", "V_B")]


def test_lints(shop):
    found = {(r.lint, r.subject) for r in lints(shop, shop.classes.select("class")).collect()}
    assert found == {
        ("VirtualTypeCycle", "c1"), ("VirtualTypeCycle", "c2"), ("CommandClassMissing", "T\\A\\Command\\Gone"), ("QueueNoConsumer", "direct"), ("GraphqlResolverMissing", "T\\B\\Gone"),
        ("MqHandlerMissing", "T\\A\\Nowhere"), ("CommandUnregistered", "T\\A\\Command\\Two"), ("ObserverUnregistered", "T\\A\\Observer\\Lost"), ("TemplateFileMissing", "T_A::gone.phtml"),
    }
