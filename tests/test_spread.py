"""Graph steps over keys that many rows have."""

from pyspark.sql import functions as F

from declgraph.operators import graph


def test_a_node_that_many_reach_is_dealt_out(spark, monkeypatch):
    """Before, all pairs that end on a node were one task's."""
    monkeypatch.setattr(graph, "TASK", 1_000)
    edges = [(i, i // 2) for i in range(1, 400)] + [(7, 224)]
    wanted = {(r.root, r.node): r.depth for r in graph.closure(spark.createDataFrame(edges[:-1], "src long, dst long")).collect()}
    for root in range(1, 400):
        node, depth = root // 2, 1
        while True:
            assert wanted.pop((root, node)) == depth
            if not node:
                break
            node, depth = node // 2, depth + 1
    assert not wanted
    assert graph.closure(spark.createDataFrame(edges, "src long, dst long")).filter("root = 7 AND node = 7").first().depth == 6  # 224, 112, 56, 28, 14, 7


def test_shares_of_a_frequent_key(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK", 1_000)
    left = spark.range(5_000).selectExpr("id AS root", "CAST(if(id % 10 < 9, 0, id) AS string) AS node")
    right = spark.createDataFrame([("0", 1), ("0", 2), ("9", 3), (None, 4)], "node string, more int")
    met = graph.spread_join(left, right, "node", "root", 5_000)
    assert met.columns == ["node", "root", "more"] and met.count() == 9_001
    assert met.filter("node = '0'").select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 6_000  # before, 9,000
