"""Files that come in pieces, and nodes that leave the parser before the file ends."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from declgraph.plans.installation import Installation
from declgraph.queries import tree
from declgraph.sources import files as sources
from declgraph.sources import xml


def test_nodes_leave_the_parser_before_the_file_ends(spark):
    text = "<config>" + "\n<a n='1'><b>t</b></a>" * 20_000 + "\n</config>"
    sizes = [len(n) for n in xml.closed(text, [])]
    assert sum(sizes) == 40_001 and max(sizes) < 2 * xml.ROWS  # before, all nodes of a file were one value
    nodes = xml.xml_nodes(spark.createDataFrame([("p", text), ("q", "<a><b>x<c/>y</a>")], "path string, content string"))
    assert nodes.count() == 40_004
    last = nodes.filter("path = 'p' AND tag = 'b'").orderBy(F.desc("seq")).first()
    assert (last.seq, last.line, last.text, [t.tag for t in last.trail]) == (40_000, 20_001, "t", ["config", "a"])
    assert [(r.seq, r.tag, r.text) for r in nodes.filter("path = 'q'").orderBy("seq").collect()] == [(0, "a", ""), (1, "b", "xy"), (2, "c", "")]


def test_pieces_are_read_as_the_whole_file(spark, tmp_path):
    """Places, lines and results are those of files in one piece."""
    spark.range(700_000).filter("id % 7 < 3").selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(25).selectExpr("CAST(id AS int) AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    cut = tree.files(spark, str(tmp_path), ["job"])
    assert cut.filter("path LIKE '%/N3/etc/crontab.xml'").agg(F.max(F.length("content")), F.count("*")).first()[1] == 7
    body = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "content"))), lambda p: p["content"]), "\n"), "\n</config>\n<config>", "")
    whole = cut.groupBy("path").agg(body.alias("content"))
    kept = ["area", "path", "line", "place", "group", "name", "instance"]
    rows = []
    for files in (cut, whole):
        jobs = Installation(files).declared("cron_jobs").withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("seq"))).select(kept)
        rows.append(jobs)
    assert rows[0].count() == rows[1].count() > 100_000
    assert rows[0].exceptAll(rows[1]).isEmpty() and rows[1].exceptAll(rows[0]).isEmpty()


def test_pieces_of_a_file_give_way_to_a_buffer(spark):
    files = spark.createDataFrame([("a", "1", 0, 0), ("a", "2", 1, 5), ("b", "3", 0, 0)], "path string, content string, piece long, before long")
    buffers = spark.createDataFrame([("a", "new"), ("c", "more")], "path string, content string")
    assert sorted(map(tuple, sources.overlaid(files, buffers).select("path", "content").collect())) == [("a", "new"), ("b", "3"), ("c", "more")]
