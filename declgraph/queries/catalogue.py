"""Driver queries by name, each with the SQL it has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, graph, joins, merge
from ..plans import lints
from ..streaming import events as windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    return F.col(column).cast("decimal(18,2)")


# A: scans, filters, projections


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_modules(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def filter_icontains(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(scalars.icontains(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query("""
WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_name = 'old ring' THEN 0 ELSE 1 END AS rank FROM part WHERE contains(p_name, 'ring'))
SELECT p_partkey, p_name FROM r WHERE rank = (SELECT min(rank) FROM r)""")
def filter_exact_else_partial(spark, sf_dir):
    rank = F.when(F.col("p_name") == "old ring", 0).otherwise(1)
    found = table(spark, sf_dir, "part").filter(F.contains("p_name", F.lit("ring"))).select("p_partkey", "p_name", rank.alias("rank"))
    best = found.agg(F.min("rank").alias("rank"))  # one row
    return found.join(F.broadcast(best), "rank").select("p_partkey", "p_name")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM p WHERE path = '/en' OR starts_with(path, '/en/')""")
def path_prefix_boundary(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    return paths.filter(scalars.under(F.col("path"), "/en"))


@query("SELECT doc_id, CASE WHEN contains(source, '::') THEN source ELSE 'base::' || ltrim(source, '\\') END AS ref FROM documents")
def normalize_ref(spark, sf_dir):
    ref = F.when(F.contains("source", F.lit("::")), F.col("source")).otherwise(F.concat(F.lit("base::"), scalars.class_name(F.col("source"))))
    return table(spark, sf_dir, "documents").select("doc_id", ref.alias("ref"))


# B: merges


@query("SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def merge_last_wins(spark, sf_dir):
    return merge.merge_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""
SELECT user_id,
  arg_max(value, (ts, event_id)) FILTER (WHERE value > 100) AS big_value,
  arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS last_type,
  min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY user_id""")
def merge_attr(spark, sf_dir):
    attrs = {"big_value": F.when(F.col("value") > 100, F.col("value")), "last_type": F.when(F.col("event_type") != "view", F.col("event_type"))}
    return merge.merge_attr(table(spark, sf_dir, "events"), ["user_id"], attrs, ["ts", "event_id"], source="event_id")


@query("""
SELECT event_id, ts, user_id, event_type, declared FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS declared FROM events)
WHERE r = 1""")
def merge_first_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return merge.merge_first(events, ["user_id", "event_type"], ["ts", "event_id"])


@query("""
WITH l AS (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_id, user_id, event_type FROM events LEFT JOIN l USING (user_id) WHERE last IS NULL OR (ts, event_id) > last""")
def tombstone_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return merge.tombstones(events, ["user_id"], F.col("event_type") == "error", ["ts", "event_id"]).drop("ts")


@query("""
SELECT o_orderkey, o_custkey, layer FROM
  (SELECT o_orderkey, o_custkey, -substr(o_orderpriority, 1, 1)::INT AS layer, max(-substr(o_orderpriority, 1, 1)::INT) OVER (PARTITION BY o_custkey) AS top FROM orders)
WHERE layer = top""")
def layer_replace(spark, sf_dir):
    layered = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (-F.substring("o_orderpriority", 1, 1).cast("int")).alias("layer"))
    return merge.layer_replace(layered, ["o_custkey"], "layer")


@query("""
SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY first_ship, l_suppkey) AS suppliers
FROM (SELECT l_orderkey, l_suppkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def ordered_union(spark, sf_dir):
    united = merge.ordered_union(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", ["l_shipdate"])
    return united.select("l_orderkey", F.array_join("items", ",").alias("suppliers"))


@query("""
WITH base AS (SELECT r_name AS area, n_nationkey AS key, n_name AS value, 0 AS layer, 0 AS place FROM nation, region),
own AS (SELECT r_name AS area, n_nationkey AS key, c_name AS value, 1 AS layer, c_custkey AS place
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000)
SELECT area, key, arg_max(value, (layer, place)) AS value FROM (SELECT * FROM base UNION ALL SELECT * FROM own) GROUP BY 1, 2""")
def area_overlay(spark, sf_dir):
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    base = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), F.lit(0).cast("long").alias("at"))
    rich = customer.filter("c_acctbal > 9000").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = rich.select(F.col("r_name").alias("area"), F.col("n_nationkey").alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("at"))
    areas = region.select(F.col("r_name").alias("area"))
    return merge.area_overlay(base, own, areas, ["key"], ["at"]).select("area", "key", "value")


@query("""
WITH m AS (SELECT o_orderstatus AS area, o_orderpriority AS key, max(o_orderkey) AS last_key, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2),
g AS (SELECT o_orderpriority AS key, max(o_orderkey) AS global_last_key, min(o_orderkey) AS global_first_key FROM orders GROUP BY 1)
SELECT area, key, last_key, first_key, global_last_key, global_first_key FROM m LEFT JOIN g USING (key)
WHERE last_key IS DISTINCT FROM global_last_key OR first_key IS DISTINCT FROM global_first_key""")
def area_deltas(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ends = [F.max("o_orderkey").alias("last_key"), F.min("o_orderkey").alias("first_key")]
    merged = orders.groupBy(F.col("o_orderstatus").alias("area"), F.col("o_orderpriority").alias("key")).agg(*ends)
    return merge.area_deltas(merged, orders.groupBy(F.col("o_orderpriority").alias("key")).agg(*ends), ["key"], ["last_key", "first_key"])


@query("SELECT user_id, min(ts) AS first_ts, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def first_position_last_value(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


# C: aggregates

TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in TYPES) + ", count(*) AS n_all FROM events GROUP BY 1")
def status_pivot(spark, sf_dir):
    return aggregates.status_pivot(table(spark, sf_dir, "events"), ["user_id"], "event_type", TYPES)


@query("""
SELECT c_custkey, c_name, o_orderkey, o_orderdate FROM customer JOIN
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ON c_custkey = o_custkey WHERE r = 1""")
def arg_max_join(spark, sf_dir):
    latest = aggregates.latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customer.join(latest, customer.c_custkey == latest.o_custkey).select("c_custkey", "c_name", "o_orderkey", "o_orderdate")


@query("SELECT s_suppkey, count(DISTINCT l_partkey) AS parts FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 45 GROUP BY 1")
def count_distinct_after_left_join(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    return supplier.join(parts, supplier.s_suppkey == parts.l_suppkey, "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("parts"))


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500) AS members FROM nation")
def correlated_count(spark, sf_dir):
    members = table(spark, sf_dir, "customer").filter("c_acctbal > 9500").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    return nation.join(members, nation.n_nationkey == members.c_nationkey, "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("members"))


@query("""
SELECT c_mktsegment, count(*) AS orders, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS revenue, min(o_totalprice::DECIMAL(18,2)) AS least, max(o_totalprice::DECIMAL(18,2)) AS most
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def order_stats(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price = money("o_totalprice")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum(price).cast("decimal(28,2)").alias("revenue"), F.min(price).alias("least"), F.max(price).alias("most"))


@query("SELECT event_type, date_sub('minute', min(ts), TIMESTAMP '2024-02-01 00:00:30') AS minutes FROM events GROUP BY 1")
def oldest_age(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:30").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("ts")).select("event_type", scalars.minutes_between(F.col("ts"), now).alias("minutes"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE event_id > 500 GROUP BY 1")
def backlog_after_version(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_id > 500").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS trail FROM events GROUP BY 1")
def ordered_collect(spark, sf_dir):
    return aggregates.ordered_list(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"), ">", "trail")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# D: graphs


def halves(spark, sf_dir) -> DataFrame:
    """Each part refers to the part of half its key."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


CLOSURE = """
WITH RECURSIVE c(root, node, depth) AS (
  SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 0
  UNION ALL SELECT root, node // 2, depth + 1 FROM c WHERE node > 0)"""


@query(CLOSURE + " SELECT root, node, depth FROM c")
def closure(spark, sf_dir):
    return graph.closure(halves(spark, sf_dir).filter("src > 0"))


@query(CLOSURE + " SELECT root AS node, node AS target, depth::BIGINT AS steps FROM c WHERE node = 0")
def chase_fixpoint(spark, sf_dir):
    return graph.chase(halves(spark, sf_dir))


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier),
w(start, node, least, steps) AS (
  SELECT s_suppkey, (s_suppkey * 7 + 3) % n, least(s_suppkey, (s_suppkey * 7 + 3) % n), 1 FROM supplier, n
  UNION ALL SELECT start, (node * 7 + 3) % n, least(least, (node * 7 + 3) % n), steps + 1 FROM w, n WHERE node <> start AND steps <= n)
SELECT least AS cycle_key, count(*) AS members FROM w WHERE node = start GROUP BY 1""")
def cycles(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = F.broadcast(supplier.agg(F.count(F.lit(1)).alias("n")))
    return graph.cycles(supplier.crossJoin(n).select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 3) % F.col("n")).alias("dst")))


@query("""
SELECT 'r' || r_regionkey AS key, r_name AS path, 0 AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def preorder(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    tree = graph.with_paths(regions.unionByName(nations), "key", "parent", F.col("name"))
    return tree.orderBy("path").select("key", F.array_join("path", "/").alias("path"), "depth")


@query(CLOSURE + """
SELECT root, p_brand, arg_min(node, (depth, node)) AS node, min(depth) AS depth FROM c JOIN part ON node = p_partkey GROUP BY 1, 2""")
def nearest_by_name(spark, sf_dir):
    reached = graph.closure(halves(spark, sf_dir).filter("src > 0"))
    rows = reached.count()
    named = graph.spread_join(reached, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_brand"), "node", "root", rows)
    if rows > graph.TASK:
        named = named.repartition(graph.tasks(spark, rows), "root")
    return graph.nearest_by_name(named, "p_brand", ["node"]).select("root", "p_brand", "node", "depth")


@query(CLOSURE + """
SELECT p.p_partkey, coalesce(bool_or(a.p_size > 45), false) AS hidden
FROM part p LEFT JOIN c ON c.root = p.p_partkey LEFT JOIN part a ON a.p_partkey = c.node GROUP BY 1""")
def visibility_over_ancestors(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    flagged = part.filter("p_size > 45").select(F.col("p_partkey").alias("node"))
    reached = graph.closure(halves(spark, sf_dir).filter("src > 0"))
    hidden = graph.spread_join(reached, flagged.distinct(), "node", "root", reached.count()).select(F.col("root").alias("p_partkey")).distinct()
    return part.select("p_partkey").join(hidden.withColumn("hidden", F.lit(True)), "p_partkey", "left").select("p_partkey", F.coalesce("hidden", F.lit(False)).alias("hidden"))


# E: joins


@query("""
WITH a AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'extra' ELSE 'both' END AS presence FROM a FULL JOIN b ON a.key = b.key""")
def presence_diff(spark, sf_dir):
    left = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    right = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return joins.presence_diff(left, right, ["key"])


@query("""
WITH a AS (SELECT doc_id, text FROM documents WHERE source <> 'src1'),
b AS (SELECT doc_id, CASE lang WHEN 'de' THEN upper(text) WHEN 'fr' THEN array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) ELSE text END AS text FROM documents WHERE source <> 'src2')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
  CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' WHEN a.text = b.text THEN 'identical'
       WHEN list_sort(string_split(a.text, chr(10))) = list_sort(string_split(b.text, chr(10))) THEN 'reordered' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def tree_diff(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    turned = F.array_join(F.reverse(F.split("text", "\n")), "\n")
    other = F.when(F.col("lang") == "de", F.upper("text")).when(F.col("lang") == "fr", turned).otherwise(F.col("text"))
    return joins.tree_diff(documents.filter("source <> 'src1'"), documents.filter("source <> 'src2'").select("doc_id", other.alias("text")), "doc_id", "text")


@query("""
WITH l AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.09)
SELECT coalesce(s_suppkey, l_suppkey) AS suppkey, s_suppkey IS NULL AS unknown, l_suppkey IS NULL AS unused FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN l ON s_suppkey = l_suppkey""")
def full_outer_orphans(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    used = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 AND l_discount > 0.09").select("l_suppkey").distinct()
    joined = known.join(used, known.s_suppkey == used.l_suppkey, "full_outer")
    return joined.select(F.coalesce("s_suppkey", "l_suppkey").alias("suppkey"), F.col("s_suppkey").isNull().alias("unknown"), F.col("l_suppkey").isNull().alias("unused"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_lint(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return joins.anti(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), pending, {"c_custkey": "o_custkey"})


PATTERNS = ("old.*", "*.ring", "old.ring", "#.ring", "old.#", "*", "#")


@query("WITH t AS (SELECT p_partkey, replace(p_name, ' ', '.') AS topic FROM part) " + " UNION ALL ".join(f"SELECT p_partkey, topic, '{p}' AS pattern FROM t WHERE {c}" for p, c in (("old.*", "regexp_full_match(topic, 'old\\.[^.]+')"), ("*.ring", "regexp_full_match(topic, '[^.]+\\.ring')"), ("old.ring", "topic = 'old.ring'"), ("#.ring", "topic = 'ring' OR suffix(topic, '.ring')"), ("old.#", "topic = 'old' OR prefix(topic, 'old.')"), ("*", "NOT contains(topic, '.')"), ("#", "true"))))
def pattern_join(spark, sf_dir):
    topics = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("topic"))
    return joins.pattern_join(topics, "topic", PATTERNS)


PREFIXES = ("com", "com.example", "net.example", "org", "org.example.m")


@query(r"""
WITH p AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.') AS domain FROM pages),
t(prefix) AS (VALUES """ + ", ".join(f"('{p}')" for p in PREFIXES) + """)
SELECT page_id, domain, (SELECT arg_max(prefix, length(prefix)) FROM t WHERE domain = prefix OR starts_with(domain, prefix || '.')) AS prefix FROM p""")
def prefix_join(spark, sf_dir):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    domains = table(spark, sf_dir, "pages").select("page_id", F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("domain"))
    return joins.prefix_join(domains, "domain", spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"), "prefix")


@query("""
WITH n AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INT AS distance FROM n a JOIN n b ON a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 2""")
def similarity_join(spark, sf_dir):
    return joins.similarity_join(table(spark, sf_dir, "part"), "p_name", 2)


@query("""
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY 1""")
def nested_left(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    counted = nation.join(poor, nation.n_nationkey == poor.c_nationkey, "left").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.sum(F.coalesce("n", F.lit(0))).alias("customers"))
    joined = region.join(counted, region.r_regionkey == counted.n_regionkey, "left")
    return joined.select("r_name", F.coalesce("nations", F.lit(0)).alias("nations"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT event_id, user_id FROM events WHERE (props->>'$.k')::BIGINT = 7")
def reverse_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(scalars.json_number(F.col("props"), "k") == 7).select("event_id", "user_id")


# F: configuration values, limits, ranks, findings


@query("""
WITH s AS (SELECT s_nationkey, min(s_name) AS store FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
w AS (SELECT n_regionkey, min(s_name) AS website FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 GROUP BY 1)
SELECT n_nationkey, coalesce(store, website, 'default') AS value FROM nation LEFT JOIN s ON s_nationkey = n_nationkey LEFT JOIN w ON w.n_regionkey = nation.n_regionkey""")
def scope_fallback(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    stores = supplier.filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_name").alias("store"))
    sites = supplier.filter("s_acctbal > 9000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.min("s_name").alias("website"))
    joined = nation.join(stores, nation.n_nationkey == stores.s_nationkey, "left").join(sites, F.col("n_regionkey") == F.col("region"), "left")
    return joined.select("n_nationkey", scalars.scope_fallback(F.col("store"), F.col("website"), F.lit("default")).alias("value"))


@query("""
SELECT o_orderkey, o_totalprice, place, (SELECT count(*) FROM orders) > 50 AS truncated
FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders) WHERE place <= 50""")
def limit_truncated(spark, sf_dir):
    return aggregates.limit_truncated(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


@query("SELECT p_name, levenshtein(p_name, 'old rung')::INT AS distance FROM (SELECT DISTINCT p_name FROM part) ORDER BY distance, p_name LIMIT 3")
def top3_by_distance(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.withColumn("distance", F.levenshtein("p_name", F.lit("old rung"))).orderBy("distance", "p_name").limit(3)


@query("SELECT doc_id, source, quality, rank() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def nulls_last_sort_rank(spark, sf_dir):
    """Ranks from counts of the few values, so that a large source is no task of its own."""
    from pyspark.sql import Window

    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    counts = joined.groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy(F.col("quality").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(F.col("source").alias("s"), F.col("quality").alias("q"), (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("place"))
    return joined.join(places, F.expr("source <=> s AND quality <=> q")).select("doc_id", "source", "quality", "place")


@query("""
SELECT DISTINCT lint, severity, subject FROM (
  SELECT 'NoPendingOrder' AS lint, 'warn' AS severity, c_name AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT 'NegativeBalance', 'error', c_name FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'DuplicateName', 'warn', p_name FROM part GROUP BY p_name HAVING count(*) > 1)""")
def union_findings(spark, sf_dir):
    customer, orders, part = (table(spark, sf_dir, t) for t in ("customer", "orders", "part"))
    pending = orders.filter("o_orderstatus = 'P'")
    return lints.findings(
        lints.finding(joins.anti(customer, pending, {"c_custkey": "o_custkey"}), "NoPendingOrder", "warn", F.col("c_name")),
        lints.finding(customer.filter("c_acctbal < 0"), "NegativeBalance", "error", F.col("c_name")),
        lints.finding(part.groupBy("p_name").count().filter("count > 1"), "DuplicateName", "warn", F.col("p_name")),
    )


# G: scalar functions


@query("SELECT o_orderkey, printf('ORD%09d', o_orderkey) AS number FROM orders")
def sequence_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.sequence_number(F.lit("ORD"), F.col("o_orderkey")).alias("number"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label FROM labels")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))


@query("SELECT event_id, list_count(parts) AS n, upper(substr(parts[1], 1, 1)) || substr(parts[1], 2) AS first_label FROM (SELECT event_id, string_split(event_type, 'e') AS parts FROM events)")
def split_labels(spark, sf_dir):
    parts = F.split("event_type", "e")
    first = parts[0]
    return table(spark, sf_dir, "events").select("event_id", F.size(parts).cast("long").alias("n"), F.concat(F.upper(F.substring(first, 1, 1)), F.expr("substring(split(event_type, 'e')[0], 2)")).alias("first_label"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.json_number(F.col("props"), "k").alias("k"))


@query("SELECT source, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def content_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("one"))
    return aggregates.digest_of_groups(rows, ["source"], ["doc_id"], F.col("one"), "digest")


@query("SELECT doc_id, 'sha256-' || to_base64(unhex(sha256(text))) AS integrity FROM documents")
def sri_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.integrity(F.col("text")).alias("integrity"))


@query(r"SELECT p_partkey, lower(regexp_replace(regexp_replace(p_type || 'Kind', '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')) AS name FROM part")
def snake_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.snake_case(F.concat("p_type", F.lit("Kind"))).alias("name"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def split_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(scalars.split_words(F.col("text"))).cast("long").alias("words"))


# H: event windows, as batches


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "1 day", "event_type")


@query("""
SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS start FROM events, range(4) AS s(k)) GROUP BY 1, 2""")
def sliding_counts(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"), "1 day", "6 hours", "event_type")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) AS last_ts, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "2 hours", "user_id")


# more scalar functions and set operations


@query("SELECT c_custkey, concat_ws(' ', c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_name END) AS name FROM customer")
def full_name(spark, sf_dir):
    name = scalars.full_name(F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))


@query("SELECT p_partkey, coalesce(try_cast(trim(split_part(p_brand, '#', 2)) AS BIGINT), -1) AS number FROM part")
def parse_int_default(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.int_or(F.split_part("p_brand", F.lit("#"), F.lit(2)), -1).alias("number"))


@query("""
SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age
FROM (SELECT event_id, date_sub('second', ts, TIMESTAMP '2024-02-01 00:00:00') AS s FROM events)""")
def humanize_seconds(spark, sf_dir):
    seconds = F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", scalars.humanized(seconds).alias("age"))


@query("SELECT p_partkey, lower(substr(p_type, 1, 1)) || substr(p_type, 2) AS name FROM part")
def lower_first(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.lower_first(F.col("p_type")).alias("name"))


@query("SELECT doc_id, length(regexp_replace(substr(text, 1, (n_chars // 2)::INT), '[^\\n]', '', 'g')) + 1 AS line FROM documents")
def line_of_offset(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.line_of(F.col("text"), F.expr("CAST(n_chars div 2 AS int)")).cast("long").alias("line"))


@query("SELECT DISTINCT p_name, CASE WHEN levenshtein(p_name, 'old ring') <= 3 THEN levenshtein(p_name, 'old ring')::INT END AS distance FROM part")
def capped_distance(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", scalars.distance_within(F.col("p_name"), F.lit("old ring"), 3).alias("distance"))


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey > 10 THEN n_name END, 'nation/' || n_nationkey) AS label FROM nation")
def default_label(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.named_or(F.when(F.col("n_nationkey") > 10, F.col("n_name")), "nation", F.col("n_nationkey")).alias("label"))


@query("SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_union(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return poor.union(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return joins.anti(poor, table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), {"key": "o_custkey"}).distinct()


@query("SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_membership(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return poor.join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")).distinct(), "key", "left_semi").distinct()
