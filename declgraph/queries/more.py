"""Driver queries of the compile side, deployments and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, merge
from ..plans import compiling, deployment, editor, frontend
from ..sources import php, texts
from .catalogue import query, table
from .tree import query as over_tree


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
w AS (SELECT source, doc_id, rn, CASE WHEN 20000 > size THEN 0 ELSE 1 END AS bundle, 20000 - size AS free FROM d WHERE rn = 1
  UNION ALL SELECT d.source, d.doc_id, d.rn, CASE WHEN w.free > size THEN bundle ELSE bundle + 1 END, CASE WHEN w.free > size THEN w.free - size ELSE 20000 - size END FROM w JOIN d ON d.source = w.source AND d.rn = w.rn + 1)
SELECT source AS package, doc_id AS path, bundle::INT AS bundle FROM w""")
def deployment_bundles(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    return deployment.bundles(entries, 20_000, ["package"], ["path"])


@query("""WITH a AS (SELECT 'frontend/V/' || source || '/x/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.css' ELSE '.js' END AS path, text FROM documents WHERE doc_id % 7 <> 1),
b AS (SELECT 'frontend/V/' || source || '/x/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.css' ELSE '.js' END AS path, CASE WHEN doc_id % 5 = 0 THEN text || ' {' WHEN doc_id % 3 = 0 THEN ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 11 <> 2),
j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.text = b.text THEN 'identical' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path))
SELECT regexp_extract(path, '^([^/]+/[^/]+/[^/]+/[^/]+)', 1) AS bucket, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'extra') AS extra, count(*) FILTER (state = 'changed') AS changed, 0::BIGINT AS equivalent, count(*) FILTER (state = 'identical') AS identical FROM j GROUP BY 1""")
def deployment_verified(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("frontend/V/"), "source", F.lit("/x/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".css").otherwise(".js")).alias("path")
    other = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" {"))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    return deployment.verified(docs.filter("doc_id % 7 <> 1").select(path, F.col("text").alias("content")), docs.filter("doc_id % 11 <> 2").select(path, other.alias("content")), strict=True)


@query("""SELECT 'p' || doc_id % 50 AS path, max_by(md5(text), (doc_id % 5, doc_id)) AS digest, (min((doc_id % 5, doc_id))).element_2 AS first FROM (SELECT doc_id, text FROM documents) GROUP BY 1""".replace("(min((doc_id % 5, doc_id))).element_2", "min_by(doc_id, (doc_id % 5, doc_id))"))
def static_package(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (F.col("doc_id") % 50).cast("string")).alias("path"), F.col("text").alias("content"), (F.col("doc_id") % 5).alias("layer"), F.col("doc_id").alias("position"))
    return frontend.static_package(entries).select("path", F.md5("content").alias("digest"), F.col("position.position").alias("first"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), a AS (SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL),
r AS (SELECT doc_id, trim(unnest(string_split(CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || 'more' ELSE text END, chr(10)))) AS line FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, line, count(*) AS n FROM r WHERE line <> '' GROUP BY ALL)
SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'left' ELSE 'right' END AS side, count(*) AS lines FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.line = b.line WHERE coalesce(a.n, 0) <> coalesce(b.n, 0) GROUP BY ALL""")
def compile_residual(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    other = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    left, right = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), docs.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("path"), other.alias("content"))
    return compiling.residual(left, right).groupBy("path", "side").agg(F.count(F.lit(1)).alias("lines"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE ((p_size + p_partkey * 2) % 7 - (p_partkey << 1))::VARCHAR || p_brand END AS value FROM part""")
def constant_expressions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    whole = F.concat(F.lit("(("), size, F.lit(" + "), key, F.lit(" * 2) % 7 - ("), key, F.lit(" << 1)) . '"), "p_brand", F.lit("'"))
    return compiling.evaluated(part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.lit("oops(")).otherwise(whole).alias("e")), "e").select("p_partkey", "value")


@query("""SELECT DISTINCT p_name AS phrase FROM part""")
def script_phrases(spark, sf_dir):
    name = F.split("p_name", " ")
    script = F.concat(F.lit("x($t('"), name[0], F.lit(" ' + '"), name[1], F.lit("'), 1)"))
    return deployment.phrases(table(spark, sf_dir, "part").select(script.alias("content")))


@query("""WITH r AS (SELECT 'k' || c_custkey % 40 AS key, CASE WHEN c_custkey % 6 = 0 THEN 'k' || c_custkey % 40 ELSE c_name END AS value, c_custkey FROM customer)
SELECT key, max_by(value, c_custkey) AS value FROM r GROUP BY 1 HAVING max_by(value, c_custkey) <> key""")
def dictionary_with_resets(spark, sf_dir):
    key = F.concat(F.lit("k"), (F.col("c_custkey") % 40).cast("string"))
    rows = table(spark, sf_dir, "customer").select(key.alias("key"), F.when(F.col("c_custkey") % 6 == 0, key).otherwise(F.col("c_name")).alias("value"), "c_custkey")
    return texts.dictionary(rows.withColumn("reset", F.col("key") == F.col("value")), ["c_custkey"])


@query("""SELECT o_custkey % 10 AS key, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY nullif(o_custkey % 10, 3) ORDER BY o_shippriority DESC) AS r FROM (SELECT *, o_orderkey % 3 AS o_shippriority FROM orders)) WHERE r = 1 GROUP BY 1""")
def layer_replace_with_null_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey") % 10, (F.col("o_orderkey") % 3).alias("layer")).toDF("k", "layer").withColumn("nk", F.nullif("k", F.lit(3)))
    return merge.layer_replace(orders, ["nk"], "layer").groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT DISTINCT nullif(c_custkey % 20, 3) AS k FROM customer WHERE c_custkey % 20 < 15), b AS (SELECT DISTINCT nullif(c_custkey % 20, 3) AS k FROM customer WHERE c_custkey % 20 IN (3, 4, 16, 17))
SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.p IS NULL THEN 'missing' WHEN a.p IS NULL THEN 'extra' ELSE 'both' END AS presence FROM (SELECT k, 1 AS p FROM a) a FULL JOIN (SELECT k, 1 AS p FROM b) b ON a.k IS NOT DISTINCT FROM b.k""")
def presence_diff_with_null_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20).alias("m"), F.nullif(F.col("c_custkey") % 20, F.lit(3)).alias("key"))
    return joins.presence_diff(keys.filter("m < 15"), keys.filter("m IN (3, 4, 16, 17)"), ["key"])


@query("""SELECT p_partkey, p_size + 1 AS methods, 'm' || p_size AS last FROM part WHERE p_size < 20""")
def php_methods(spark, sf_dir):
    each = F.transform(F.sequence(F.lit(0), "p_size"), lambda i: F.concat(F.lit(" /* function no() */ public function m"), i.cast("string"), F.lit("(array $a = ['x(', 1], ?B $b = null) { return 'function f('; }")))
    source = F.concat(F.lit("<?php namespace N; class C {"), F.array_join(each, "\n"), F.lit("}"))
    rows = table(spark, sf_dir, "part").filter("p_size < 20").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # a small file of few row groups, with long work on each row
    found = rows.select("p_partkey", php.methods_of(source).alias("m"))
    return found.select("p_partkey", F.size("m.methods").alias("methods"), F.element_at("m.methods", -1)["name"].alias("last"))


@over_tree("""SELECT 'C' || name AS name, 'class' AS kind FROM class WHERE name LIKE '1%'""", "class")
def tree_completions(shop):
    return editor.completions(shop, "c1", 1000).select("name", "kind")


@over_tree("""WITH t AS (SELECT target, max_by(cls, (module, seq)) AS cls FROM preference WHERE area = 'global' GROUP BY 1) SELECT target AS type, cls AS instance FROM t""", "preference")
def tree_area_section(shop):
    return compiling.area_section(shop, "global")


@over_tree("""WITH m AS (SELECT target, name, max_by(cls, (module, seq)) FILTER (cls IS NOT NULL) AS cls, max_by(place, (module, seq)) FILTER (place IS NOT NULL)::INT AS place, max_by(off, (module, seq)) FILTER (off IS NOT NULL) = 'true' AS off FROM plugin WHERE area = 'global' GROUP BY ALL)
SELECT target, name, cls AS instance, coalesce(place, 0) AS sort_order, coalesce(off, false) AS disabled FROM m""", "plugin")
def tree_plugin_list(shop):
    return compiling.plugin_lists(shop, "global")["declared"]
