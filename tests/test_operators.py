"""Truth tables of merges, graphs, joins, texts and windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from declgraph.functions import scalars
from declgraph.operators import graph, joins, merge
from declgraph.sources import texts
from declgraph.streaming import events


def test_attribute_merge(spark):
    rows = [(1, "P", 10, None), (2, None, None, True), (3, "Q", None, None), (4, None, 0, False)]
    for n, wanted in ((1, ("P", 10, None)), (2, ("P", 10, True)), (3, ("Q", 10, True)), (4, ("Q", 0, False))):
        df = spark.createDataFrame([("k", *r) for r in rows[:n]], "k string, seq int, type string, sort int, off boolean").repartition(3)
        r = merge.merge_attr(df, ["k"], ["type", "sort", "off"], ["seq"], source="seq").first()
        assert (r.type, r.sort, r.off) == wanted and r.first_seq == 1 and r.seq == n


def node(layer, seq, path, kind, value=None):
    return "o", layer, seq, path.split("/"), kind, value


@pytest.mark.parametrize(
    "rows,wanted",
    [
        ([node(1, 1, "a", "array"), node(1, 2, "a/k1", "s", "1"), node(1, 3, "a/k2", "s", "2"), node(1, 4, "a", "array"), node(1, 5, "a/k2", "s", "9"), node(1, 6, "a/k3", "s", "3")], {"a": None, "a/k1": "1", "a/k2": "9", "a/k3": "3"}),
        ([node(1, 1, "a", "array"), node(1, 2, "a/k1", "s", "1"), node(1, 3, "a", "object", "X"), node(1, 4, "a", "array"), node(1, 5, "a/k2", "s", "2")], {"a": None, "a/k2": "2"}),
        ([node(0, 1, "a", "array"), node(0, 2, "a/k1", "s", "1"), node(1, 3, "a", "array"), node(1, 4, "a/k2", "s", "2")], {"a": None, "a/k2": "2"}),
    ],
)
def test_deep_merge(spark, rows, wanted):
    df = spark.createDataFrame(rows, "owner string, layer int, seq int, path array<string>, kind string, value string").repartition(3)
    assert {"/".join(r.path): r.value for r in merge.deep_merge(df, ["owner"], "layer", ["seq"]).collect()} == wanted


def test_tombstones_and_layers(spark):
    df = spark.createDataFrame([("t", 1, False), ("t", 2, True), ("t", 3, False), ("u", 1, False), ("v", 5, True)], "k string, seq int, off boolean")
    assert {(r.k, r.seq) for r in merge.tombstones(df, ["k"], F.col("off"), ["seq"]).collect()} == {("t", 3), ("u", 1)}
    assert {(r.k, r.seq) for r in merge.layer_replace(df, ["k"], "seq").collect()} == {("t", 3), ("u", 1), ("v", 5)}


def test_chase(spark):
    edges = [(1, 2), (2, 3), (5, 5), (6, 7), (7, 6), (8, 6)] + [(i, i + 1) for i in range(100, 300)]
    found = {r.node: (r.target, r.steps) for r in graph.chase(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert found[1] == (3, 2) and found[2] == (3, 1) and found[100] == (300, 200) and 5 not in found
    assert found[6] == found[7] == found[8] == (None, None)


def test_closure_with_cycles(spark):
    random.seed(1)
    edges = {(random.randrange(25), random.randrange(25)) for _ in range(40)}
    wanted = {}
    for root in range(25):
        front, depth = {root}, 0
        while front:
            depth += 1
            front = {b for a, b in edges if a in front and (root, b) not in wanted}
            wanted.update({(root, b): depth for b in front})
    assert {(r.root, r.node): r.depth for r in graph.closure(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()} == wanted


def test_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 4)], "src int, dst int")
    assert {tuple(r) for r in graph.cycles(df).collect()} == {(1, 3), (5, 1)}


@pytest.mark.parametrize(
    "pattern,topic,fits",
    [("a.b.c", "a.b.c", True), ("a.b.c", "a.b.d", False), ("a.*.c", "a.b.c", True), ("a.*.c", "a.b.b.c", False), ("#", "anything.x", True), ("a.#", "a", True), ("a.#", "a.b.c", True),
     ("a.#", "b.a", False), ("#.c", "a.b.c", True), ("#.c", "c", True), ("a.#.c", "a.c", True), ("#.#", "x", True), ("a.*", "a.b-c", True), ("a", "b", False), ("*.b", "axb", False)],
)
def test_topics(spark, pattern, topic, fits):
    import re

    assert bool(re.match(joins.topic_regex(pattern), topic)) == fits


def test_prefix_and_similarity(spark):
    df = spark.createDataFrame([("a.b.c",), ("a.bc",), (None,), ("x",)], "t string")
    table = spark.createDataFrame([("a",), ("a.b",)], "p string")
    assert {(r.t, r.p) for r in joins.prefix_join(df, "t", table, "p").collect()} == {("a.b.c", "a.b"), ("a.bc", "a"), (None, None), ("x", None)}
    random.seed(3)
    names = sorted({"".join(random.choice("abc") for _ in range(random.randrange(6))) for _ in range(60)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for most in (1, 2):
        found = {tuple(r) for r in joins.similarity_join(spark.createDataFrame([(n,) for n in names], "n string"), "n", most).collect()}
        assert found == {(a, b, edits(a, b)) for a in names for b in names if a < b and edits(a, b) <= most}


def test_diffs(spark):
    a = spark.createDataFrame([(1, "x\ny"), (2, "s"), (3, "p"), (5, None)], "k int, c string")
    b = spark.createDataFrame([(1, "y\nx"), (2, "s"), (4, "q"), (5, "z")], "k int, c string")
    assert {tuple(r) for r in joins.tree_diff(a, b, "k", "c").collect()} == {(1, "reordered"), (2, "identical"), (3, "missing"), (4, "extra"), (5, "changed")}
    assert {(r.k, r.action) for r in events.changes(a, b, "k", "c").collect()} == {(1, "write"), (3, "delete"), (4, "write"), (5, "write")}


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.under(F.lit("a/b"), "a").alias("u"), scalars.under(F.lit("ab"), "a").alias("v"), scalars.sequence_number(F.lit("X"), F.lit(12345678901)).alias("n"),
        scalars.snake_case(F.lit("someThing Else-2")).alias("s"), scalars.class_name(F.lit("\\A\\B")).alias("c"),
    ).first()
    assert (r.u, r.v, r.n, r.s, r.c) == (True, False, "X12345678901", "some_thing_else_2", "A\\B")


def test_dictionaries(spark):
    text = '"a ""q""",b\n"two\nlines","v"\none\nk,k,module,x\n'
    assert texts.csv_rows(text) == [{"key": 'a "q"', "value": "b", "line": 1}, {"key": "two\nlines", "value": "v", "line": 2}, {"key": "k", "value": "k", "line": 5}]
    files = spark.createDataFrame([("1.csv", "k,old\nm,n\n"), ("2.csv", "k,k\nm,o\n")], "path string, content string")
    assert {tuple(r) for r in texts.dictionary(texts.translations(files), ["path", "line"]).collect()} == {("m", "o")}


def test_graphql(spark):
    text = '''# type No { a: B }
"""type No2 { }"""
type Query implements A & B @doc(description: "x") {
  one(id: Int = 3 @doc(description: "p"), n: [String!]!): [One!]! @resolver(class: "\\\\V\\\\One") @doc(description: "y")
  two: Int
}
enum E { X @doc(description: "z") Y
 Z }
union U = A | B
extend type Query { three: String }
'''
    files = spark.createDataFrame([("s.graphqls", text)], "path string, content string")
    rows = texts.schemas(files).collect()
    assert [(r.kind, r.name, r.line, r.interfaces) for r in rows][:1] == [("type", "Query", 3, ["A", "B"])]
    assert [(f.name, f.type, f.line, f.resolver) for f in rows[0].fields] == [("one", "[One!]!", 4, "V\\One"), ("two", "Int", 5, None)]
    assert {r.name: r.members for r in rows}["U"] == ["A", "B"] and rows[-1].fields[0].name == "three"


def test_stream_equals_batch(spark, tmp_path):
    """Tumbling windows over a stream of files give what the batch gives."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), f"t{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string")
    for k in range(4):
        df.filter(F.col("id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(source)
    stream = events.tumbling(events.watermarked(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), "400 days"), "1 hour", "kind")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", out).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.tumbling(df, "1 hour", "kind").collect()))
    paths = spark.createDataFrame([("a/b.php",), ("a/etc/di.xml",)], "path string")
    assert events.coarsest(paths).first()[0] == 2 and events.coarsest(paths.limit(0)).first()[0] == 0


def test_stream_of_deltas(spark, tmp_path):
    """Each micro-batch hands on what differs from the state that the batches before have left."""
    source, seen, state = str(tmp_path / "in"), [], {}
    for k, rows in enumerate([[("b", "1", 2), ("a", "1", 1), ("b", "0", 1)], [("a", "1", 3), ("b", "2", 5), ("b", "9", 4), ("c", "3", 1)], [("a", None, 9), ("c", "4", 2), ("c", None, 1)]]):
        spark.createDataFrame(rows, "path string, content string, version int").repartition(2).write.mode("append").parquet(f"{source}/k={k}")

    def current():
        return spark.createDataFrame(sorted(state.items()), "path string, content string")

    def apply(changes, number):
        rows = sorted((r.path, r.content, r.action) for r in changes.collect())
        seen.append(rows)
        state.update({p: c for p, c, a in rows if a == "write"})
        for p, _, a in rows:
            if a == "delete":
                del state[p]

    for k in (0, 1, 2):
        stream = spark.readStream.schema("path string, content string, version int").parquet(f"{source}/k={k}")
        events.write_deltas(stream, current, apply, str(tmp_path / f"out{k}"), "path", "content", "version").processAllAvailable()
    for query in spark.streams.active:
        query.stop()
    assert seen == [[("a", "1", "write"), ("b", "1", "write")], [("b", "2", "write"), ("c", "3", "write")], [("a", None, "delete"), ("c", "4", "write")]]


def test_null_is_a_key(spark):
    """Merges and diffs take a missing key for a key like any other."""
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 1, "c")], "k int, layer int, v string")
    rows = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert rows(merge.layer_replace(df, ["k"], "layer")) == rows(df.filter("v <> 'a'"))
    assert rows(merge.tombstones(df, ["k"], F.col("v") == "a", ["layer"])) == rows(df.filter("v <> 'a'"))
    other = spark.createDataFrame([(None, "a"), (2, "c")], "k int, v string")
    one = df.filter("layer = 1").select("k", "v")
    assert rows(joins.presence_diff(one, other, ["k"])) == ["(1, 'missing')", "(2, 'extra')", "(None, 'both')"]
    assert rows(joins.tree_diff(one, other, "k", "v")) == ["(1, 'missing')", "(2, 'extra')", "(None, 'identical')"]
    assert merge.area_deltas(one, other, ["k"], ["v"]).count() == 1


def test_more_scalars(spark):
    r = spark.range(1).select(
        scalars.lower_first(F.lit("ABc")).alias("a"), scalars.int_or(F.lit(" 12 ")).alias("b"), scalars.int_or(F.lit("x"), 7).alias("c"),
        scalars.humanized(F.lit(59)).alias("d"), scalars.humanized(F.lit(7300)).alias("e"), scalars.humanized(F.lit(200000)).alias("f"),
        scalars.without_suffix(F.lit("A\\BFactory"), "\\Proxy", "Factory").alias("g"), scalars.without_suffix(F.lit("A"), "B").alias("h"),
        scalars.class_path(F.lit("\\A\\B_C")).alias("i"), scalars.line_of(F.lit("a\nb\nc"), F.lit(4)).alias("j"),
        scalars.method_parts(F.lit("A::b")).alias("k"), scalars.method_parts(F.lit("A")).alias("l"),
        scalars.normalized_path(F.lit("/a/./b//../c")).alias("m"), scalars.normalized_path(F.lit("../../a/../b")).alias("n"),
        scalars.environment_path(F.lit("CONFIG__DEFAULT__A__B")).alias("o"), scalars.environment_path(F.lit("CONFIG__STORES__EN__A__B")).alias("p"),
        scalars.distance_within(F.lit("abcd"), F.lit("abxy"), 2).alias("q"), scalars.distance_within(F.lit("abcd"), F.lit("wxyz"), 2).alias("r"),
        scalars.named_or(F.lit(None).cast("string"), "store", F.lit(3)).alias("s"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("aBc", 12, 7, "59s", "2h", "2d")
    assert (r.g, r.h, r.i, r.j, tuple(r.k), tuple(r.l)) == ("A\\B", "A", "A/B/C.php", 3, ("A", "b"), ("A", None))
    assert (r.m, r.n, tuple(r.o), tuple(r.p)) == ("/a/c", "../../b", ("default", "a/b"), ("stores/en", "a/b"))
    assert (r.q, r.r, r.s) == (2, None, "store/3")
