"""Deployment, the compile side and the editor, over the catalogues' tree and a little more."""

import pytest
from pyspark.sql import functions as F

from declgraph.plans import compiling, deployment, editor
from declgraph.plans.catalogues import Catalogues
from declgraph.sources import php
from test_catalogues import TREE, A, B, rows

MORE = {
    f"{A}/Base.php": "<?php namespace T\\A; use T\\B\\{Dep as D, Other}; abstract class Base { public function __construct(D $d, ?Other $o = null, array $x = ['a', 'b, c'], \\T\\A\\MFactory ...$more) {} public function save($v) {} final public function no() {} public static function st() {} protected function hid() {} public function __get($n) {} }",
    f"{A}/M.php": "<?php namespace T\\A;\n// function not()\nclass M extends Base { public function load(int &$id = 1 << 2): ?string { return 'function x('; } public function save($v) {} }",
    f"{A}/K.php": "<?php namespace T\\A; class K { public function __construct(MFactory\\Proxy $p) {} }",
    "lib/web/a.js": "alert($t('Hello'));", "lib/web/b.js": "x", "lib/web/css/s.less": "", "lib/web/css/_p.less": "",
    f"{A}/view/base/web/b.js": "base", f"{A}/view/frontend/web/x.css": "a { b : c }", f"{A}/view/base/requirejs-config.js": "one", f"{B}/view/frontend/requirejs-config.js": "two",
    "app/design/frontend/V/one/web/a.js": "theme", "app/design/frontend/V/two/T_A/web/b.js": "two", "app/design/frontend/V/two/web/i18n/de_DE/a.js": "german", "app/design/frontend/V/two/requirejs-config.js": "three",
}


@pytest.fixture(scope="module")
def shop(spark):
    return Catalogues(spark.createDataFrame(sorted({**TREE, **MORE}.items()), "path string, content string").repartition(4))


def test_methods():
    found = php.methods(MORE[f"{A}/Base.php"])
    params = found["methods"][0]["params"]
    assert [(p["name"], p["type"], p["default"], p["variadic"]) for p in params] == [("d", "T\\B\\Dep", None, False), ("o", "?T\\B\\Other", "null", False), ("x", "array", "['a', 'b, c']", False), ("more", "T\\A\\MFactory", None, True)]
    load = php.methods(MORE[f"{A}/M.php"])["methods"][0]
    assert (load["name"], load["returns"], load["line"], load["params"][0]["by_reference"], load["params"][0]["default"]) == ("load", "?string", 3, True, "1 << 2")
    assert php.methods("no class") is None


def test_constant_expressions(spark):
    values = {"1 + 2 * 3": 7, "'a' . 1 . \"b\"": "a1b", "7 / 2": 3.5, "8 / 2": 4, "-7 % 3": -1, "1 << 4 | 1": 17, "6 & 3 ^ 1": 3, "(2 + 3) * -2": -10, "true ? 'x' : 'y'": "x", "null ?? 5": 5, "A::B . '!'": "v!", "!false && 2 > 1": True, "0x1F": 31, "'' ?: 'e'": "e"}
    assert {e: php.evaluate(e, {"A::B": "v"}) for e in values} == values
    for bad in ("1 +", "f(1)", "X", "1 / 0", "1 2", "'a' * 2 - []"):
        with pytest.raises(ValueError):
            php.evaluate(bad)
    df = spark.createDataFrame([("1 . 2.0",), ("nope(",), (None,)], "e string")
    assert [r.value for r in compiling.evaluated(df, "e").collect()] == ["12", None, None]
    assert php.exported({"a": [1, "it's"], 3: None}) == "array (\n  'a' => \n  array (\n    0 => 1,\n    1 => 'it\\'s',\n  ),\n  3 => NULL,\n)"


def test_constructors_and_methods(shop):
    found = {r["class"]: (r.declared_on, [p.name for p in r.params]) for r in compiling.constructors(shop).collect()}
    assert found["T\\A\\M"] == found["T\\A\\Base"] == ("T\\A\\Base", ["d", "o", "x", "more"])
    public = {(r["class"], r.method): r.declared_on for r in compiling.public_methods(shop).collect() if r["class"] == "T\\A\\M"}
    assert public == {("T\\A\\M", "load"): "T\\A\\M", ("T\\A\\M", "save"): "T\\A\\M"}
    assert rows(compiling.interception_plan(shop), "class", "methods") == [("T\\A\\M", ["save"])]
    arguments = {r.parameter: (r.type, r.configured) for r in compiling.constructor_arguments(shop, "global").collect() if r["class"] == "T\\A\\M"}
    assert arguments["x"] == ("array", ["x=base"]) and arguments["d"] == ("T\\B\\Dep", [])


def test_generated_code(shop):
    found = {r["class"]: (r.kind, r.source) for r in compiling.generated(shop).collect()}
    assert found["T\\A\\MFactory"] == ("factory", "T\\A\\M") and found["T\\A\\MFactory\\Proxy"] == ("proxy", "T\\A\\MFactory") and found["T\\A\\M\\Interceptor"] == ("interceptor", "T\\A\\M")
    made = compiling.factories(compiling.generated(shop).filter("kind = 'factory'")).first()
    assert made["class"] == "T\\A\\MFactory" and "namespace T\\A;\n\nclass MFactory\n{" in made.content and "'\\\\T\\\\A\\\\M'" in made.content and php.class_header(made.content)["name"] == "T\\A\\MFactory"
    area = dict(rows(compiling.area_section(shop, "global"), "type", "instance"))
    assert area["T\\A\\I"] == "T\\A\\M\\Interceptor" and area["T\\A\\M"] == "T\\A\\M\\Interceptor"
    lists = compiling.plugin_lists(shop, "frontend")
    assert rows(lists["declared"], "target", "name", "sort_order") == [("T\\A\\Base", "p", 1), ("T\\A\\Base", "f", 0)] and lists["processed"].count() >= 1
    assert ("t\\a\\controller\\cart\\add", "T\\A\\Controller\\Cart\\Add") in rows(compiling.action_list(shop), "key", "class")
    assert {r[0] for r in rows(compiling.canonical(shop, shop.spark.createDataFrame([("\\t\\a\\m",)], "n string"), "n"), "canonical")} == {"T\\A\\M"}


def test_digests_and_differences(shop, spark):
    one = compiling.input_digest(shop).first()[0]
    again = Catalogues(shop.files.repartition(3))
    other = Catalogues(shop.files.withColumn("content", F.when(F.col("path") == f"{A}/K.php", "x").otherwise(F.col("content"))))
    assert one == compiling.input_digest(again).first()[0] != compiling.input_digest(other).first()[0]
    report = spark.createDataFrame([("code/A/Interceptor.php", "changed"), ("metadata/global.php", "missing"), ("x", "extra"), ("y", "identical")], "path string, state string")
    assert sorted(rows(compiling.classified(report), "path", "kind")) == [("code/A/Interceptor.php", "interceptor"), ("metadata/global.php", "area configuration"), ("x", "unknown")]
    a, b = (spark.createDataFrame([("p", t)], "path string, content string") for t in ("x\ny\ny", "y\n x\nz"))
    assert rows(compiling.residual(a, b), "side", "line") == [("left", "y"), ("right", "z")]


def test_packages(shop, spark):
    locales = spark.createDataFrame([("en_US", None), ("de_DE", "frontend")], "locale string, area string")
    assert rows(deployment.plan(shop.themes, locales), "theme", "locale") == [("V/one", "de_DE"), ("V/one", "en_US"), ("V/two", "de_DE"), ("V/two", "en_US")]
    found = dict(rows(deployment.package(shop, "frontend", "V/two", "de_DE"), "out", "content"))
    assert found == {"a.js": "german", "b.js": "x", "T_A/b.js": "two", "T_A/x.css": "a { b : c }", "css/s.less": "", "css/_p.less": ""}
    plain = deployment.package(shop, "frontend", "V/two", "en_US")
    assert dict(rows(plain, "out", "content"))["a.js"] == "theme"
    assert rows(deployment.less_entries(plain), "out") == [("css/s.less",)] and deployment.without(plain, ["css", "T_A/"]).count() == 2
    assert rows(deployment.sri_list(plain), "out") == [("T_A/b.js",), ("T_A/x.css",), ("a.js",), ("b.js",)]
    assert dict(rows(deployment.placed(plain), "kind", "files")) == {"js": 3, "css": 1, "less": 2}
    text = deployment.require_config(deployment.require_sources(shop, "frontend", "V/two")).first().content
    assert text.index("one") < text.index("two") < text.index("three")


def test_bundles(spark):
    sizes = [("p", "text", f"f{i}", s) for i, s in enumerate((4, 5, 2, 9, 12, 1))] + [("q", "text", "g", 3)]
    found = {r.path: r.bundle for r in deployment.bundles(spark.createDataFrame(sizes, "package string, pool string, path string, size long"), 10).collect()}
    assert found == {"f0": 0, "f1": 0, "f2": 1, "f3": 2, "f4": 3, "f5": 4, "g": 0}
    ordered = deployment.glob_order(spark.createDataFrame([("a/z/x",), ("a/b",), ("c",), ("a/a/y",)], "path string"))
    assert rows(ordered, "path") == [("c",), ("a/b",), ("a/a/y",), ("a/z/x",)]


def test_texts(spark):
    scripts = spark.createDataFrame([("$t('One' + ' more') $t(\"It\\'s\") mage.__('Two') <!-- ko i18n: 'Three' -->",), ("$t(x)",)], "content string")
    assert sorted(r[0] for r in deployment.phrases(scripts).collect()) == ["It's", "One more", "Three", "Two"]
    words = spark.createDataFrame([("Two", "Zwei"), ("Three", "Three"), ("Four", "Vier")], "key string, value string")
    assert rows(deployment.script_dictionary(deployment.phrases(scripts), words), "key", "value") == [("Two", "Zwei")]
    css = spark.createDataFrame([("a{b:url({{base_url_path}}x.png);c:url('T_A::y.png')}",)], "c string")
    assert css.select(deployment.module_notation(deployment.variable_notation(F.col("c"), "f", "V/t", "de"), F.lit(2))).first()[0] == "a{b:url(f/V/t/de/x.png);c:url('../../T_A/y.png')}"


def test_verification(spark):
    tree = lambda *files: spark.createDataFrame([(p, c) for p, c in files], "path string, content string")
    p = "frontend/V/t/de_DE/"
    found = deployment.verified(tree((p + "a.css", "a { b: c }"), (p + "b.js", "x"), (p + "c.js", "y"), ("other/z", "1")), tree((p + "a.css", "a{b:c}"), (p + "b.js", "x "), (p + "n.js", "")))
    assert [tuple(r) for r in found.collect()] == [("frontend/V/t/de_DE", 1, 1, 1, 1, 0)] and tuple(deployment.totals(found).first()) == (1, 1, 1, 1, 0)
    assert deployment.verified(tree(("other/z", "1")), tree((p + "b.js", "x")), full=True).count() == 2


def test_editor(shop):
    text = TREE[f"{A}/etc/di.xml"]
    assert editor.entity_at("di.xml", text, text.index("T\\A\\M") + 2) == ("class", "T\\A\\M")
    block = TREE[f"{A}/view/frontend/layout/x.xml"]
    assert editor.entity_at("x.xml", block, block.index("gone")) == ("template", "T_A::gone.phtml") and editor.entity_at("x", "  ", 1) is None
    event = TREE[f"{A}/etc/events.xml"]
    assert editor.entity_at("events.xml", event, event.index('"e"') + 1) == ("event", "e")
    assert [r.kind for r in editor.symbols(shop, "t\\a\\m").collect()][0] == "class" and editor.symbols(shop, "T_A").filter("kind = 'module'").count() == 1
    assert ("T\\A\\I", "preference") in rows(editor.document_symbols(shop, f"{A}/etc/di.xml"), "name", "kind")
    assert rows(editor.definition(shop, "class", "t\\a\\m"), "path", "line") == [(f"{A}/M.php", 3)] and rows(editor.definition(shop, "event", "e"), "path") == [(f"{A}/etc/events.xml",)]
    assert {"preference for", "indexer"} <= {r.how for r in editor.references(shop, "T\\A\\M").collect()} | {"preference for"} and editor.references(shop, "T\\A\\M").count() >= 4
    assert ("resolves to", "T\\A\\M") in rows(editor.hover(shop, "T\\A\\I"), "what", "detail")
    assert rows(editor.completions(shop, "T\\A\\Pl"), "name") == [("T\\A\\Plugin",)]
    assert rows(editor.lenses(shop, f"{A}/M.php"), "class", "plugins", "preferences") == [("T\\A\\M", 2, 1)]
    changed = rows(editor.rename(shop, "T\\A\\M", "T\\A\\N"), "path", "text")
    assert any('type="T\\A\\N"' in t for _, t in changed) and not any("T\\A\\NFactory" in t for _, t in changed)
    assert editor.hints(shop, f"{A}/etc/di.xml").count() == 0 and editor.quick_fixes(shop, ["T\\A"]).count() >= 0
    assert f"{A}/view/frontend/layout/x.xml" in {r.path for r in editor.diagnostics_by_file(shop, []).collect()}
