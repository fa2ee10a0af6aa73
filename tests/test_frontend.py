"""Layouts, templates, components, autoloading and the command line."""

import pytest

from declgraph import __main__ as cli
from declgraph.plans import autoload, frontend
from declgraph.plans.installation import Installation

A = "app/code/Chip/Base"
TREE = {
    "app/etc/config.php": "<?php return ['modules' => ['Chip_Base' => 1]];",
    f"{A}/etc/module.xml": '<config><module name="Chip_Base"/></config>',
    f"{A}/etc/events.xml": '<config><event name="e"><observer name="o" instance="X"/></event></config>',
    f"{A}/view/frontend/layout/page.xml": '<page>\n<update handle="base_page"/><body><referenceContainer name="content"><block name="chip" template="chip/view.phtml"/><block name="gone" template="Chip_Base::no.phtml"/></referenceContainer></body></page>',
    f"{A}/view/base/layout/base_page.xml": '<page><body><container name="root"/></body></page>',
    f"{A}/view/frontend/templates/chip/view.phtml": "1",
    "app/design/frontend/V/theme/Chip_Base/templates/chip/view.phtml": "2",
    f"{A}/view/adminhtml/ui_component/grid.xml": "<listing/>",
    "app/design/adminhtml/V/theme/Chip_Base/ui_component/grid.xml": "<form/>",
}


@pytest.fixture(scope="module")
def shop(spark):
    return Installation(spark.createDataFrame(sorted(TREE.items()), "path string, content string").repartition(3))


def test_templates(shop):
    found = {r.reference: (r.files, len(r.usages)) for r in frontend.templates(shop).collect()}
    assert found["Chip_Base::chip/view.phtml"] == ([f"{A}/view/frontend/templates/chip/view.phtml", "app/design/frontend/V/theme/Chip_Base/templates/chip/view.phtml"], 1)
    assert [r.reference for r in frontend.missing_templates(shop).collect()] == ["Chip_Base::no.phtml"]


def test_layouts(shop):
    assert [tuple(r) for r in frontend.handles(shop, "frontend").collect()] == [("base_page", 1), ("page", 4)]
    view = frontend.layout(shop, "page", "frontend")
    assert [(r.op, r.name, r.parent, r.line) for r in view["contributions"].collect()][1:3] == [("referenceContainer", "content", None, 2), ("block", "chip", "content", 2)]
    assert [r.handle for r in view["includes"].collect()] == ["base_page"] and view["included_by"].count() == 0
    assert [r.handle for r in frontend.layout(shop, "base_page", "frontend")["included_by"].collect()] == ["page"]


def test_components_and_packages(shop, spark):
    assert [(r.name, r.kind, r.contributions) for r in frontend.ui_components(shop).collect()] == [("grid", "listing", 2)]
    entries = spark.createDataFrame([("a", "low", 0, 5), ("a", "high", 2, 9), ("b", "x", 1, 1)], "path string, content string, layer int, position int")
    assert {(r.path, r.content, tuple(r.position)) for r in frontend.static_package(entries).collect()} == {("a", "high", (0, 5)), ("b", "x", (1, 1))}


def test_autoload(spark):
    psr4 = spark.createDataFrame([("A\\", "lib/a"), ("A\\B\\", "lib/b/")], "prefix string, folder string")
    files = spark.createDataFrame([("lib/a/B/C.php",), ("lib/b/D.php",), ("lib/a/E.php",), ("lib/b/x.txt",)], "path string")
    names = spark.createDataFrame([("A\\B\\C",), ("A\\B\\D",), ("A\\E",), ("A\\Z",), ("Other",)], "class string")
    assert {tuple(r) for r in autoload.class_files(names, psr4, files).collect()} == {("A\\B\\C", "lib/a/B/C.php"), ("A\\B\\D", "lib/b/D.php"), ("A\\E", "lib/a/E.php"), ("A\\Z", None), ("Other", None)}
    assert [r[0] for r in autoload.class_names(psr4, files).collect()] == ["A\\B\\C", "A\\B\\D", "A\\E"]
    paths = spark.createDataFrame([("x/A.php",), ("x/a.php",), ("y",)], "path string")
    assert [r.paths for r in autoload.case_collisions(paths).collect()] == [["x/A.php", "x/a.php"]]


def test_command_line(spark, tmp_path):
    for path, content in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    found, as_json = cli.run(spark, [str(tmp_path), "observers", "--json"])
    assert as_json and cli.text_of(found.first()).endswith(f"# {A}/etc/events.xml:1")
    assert [r.name for r in cli.run(spark, [str(tmp_path), "modules"])[0].collect()] == ["Chip_Base"]
