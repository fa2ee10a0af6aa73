"""What cards gather of other tables."""

from declgraph.plans.cards import listed


def test_listed_rows_are_sorted_once(spark):
    """Before, rows were aggregated into lists, which sorts (and spills) them again on both sides of the shuffle and in the join."""
    cards = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string")
    rows = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (1, 2, "w"), (None, 1, "z"), (7, 1, "v")], "of long, at int, what string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = listed(listed(cards, "id", rows, "of", "ordered", ["what"], ["at"]), "id", rows, "of", "plain", ["what", "at"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Sort [") == 3  # the cards, and the rows of each list
        got = {r.name: ([x.what for x in r.ordered], [tuple(x) for x in r.plain]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"a": (["w", "y", "x"], [("w", 2), ("x", 3), ("y", 2)]), "b": ([], []), "c": ([], [])}
