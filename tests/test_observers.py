"""Observers without a name are merged like others."""

from declgraph.plans.installation import Installation


def test_an_observer_without_name_is_kept(spark):
    """Before, a join on the name dropped it."""
    files = spark.createDataFrame(
        [
            ("app/etc/config.php", "<?php return ['modules' => ['T_A' => 1]];"),
            ("app/code/T/A/etc/module.xml", '<config><module name="T_A"/></config>'),
            ("app/code/T/A/etc/events.xml", '<config><event name="e"><observer instance="X"/><observer name="n" instance="Y"/><observer name="n"/></event></config>'),
        ],
        "path string, content string",
    )
    found = Installation(files).observers.filter("area = 'global'").select("event", "name", "instance").collect()
    assert sorted(map(tuple, found), key=str) == [("e", "n", None), ("e", None, "X")]
