"""Driver queries over an installation's declaration files.

The files are written from the supplied tables, one declaration a row: 25
modules, of which some are disabled, missing or not registered. The library
reads, parses and merges them; the SQL states the result over the rows that
the declarations came from.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import doctor, frontend, relations
from ..plans.catalogues import Catalogues
from .catalogue import ORACLES, QUERIES, table

SUPPLIED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
TEXT = "CAST({} AS varchar(20))"

#: Kind: file, what stands around all, a declaration (``{column}``, or ``{?attribute:column}`` if it isn't null), and the rows:
#: module, seq (its place) and columns, over the supplied tables in braces. With a column area, the file lies in that folder.
KINDS = {
    "preference": ("di.xml", "config", '<preference for="{target}" type="{cls}"/>',
        "SELECT p_partkey % 25 AS module, p_partkey AS seq, concat('I', CAST(p_size AS varchar(20))) AS target, concat('C', CAST(p_partkey % 60 AS varchar(20))) AS cls, CASE WHEN p_partkey % 6 = 1 THEN 'frontend' ELSE 'global' END AS area FROM {part}"),
    "plugin": ("di.xml", "config", '<type name="{target}"><plugin{?name:name}{?type:cls}{?sortOrder:place}{?disabled:off}/></type>',
        "SELECT c_custkey % 25 AS module, 100000 + c_custkey AS seq, concat('T', CAST(c_nationkey % 10 AS varchar(20))) AS target, concat('p', CAST(c_custkey % 7 AS varchar(20))) AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('Plug', CAST(c_custkey % 11 AS varchar(20))) END AS cls, "
        "CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 50 AS varchar(20)) END AS place, CASE WHEN c_custkey % 5 = 0 THEN 'true' WHEN c_custkey % 5 = 1 THEN 'false' END AS off, CASE WHEN c_custkey % 6 = 0 THEN 'frontend' ELSE 'global' END AS area FROM {customer}"),
    "virtual": ("di.xml", "config", '<virtualType name="{name}"{?type:base}/>',
        "SELECT s_suppkey % 25 AS module, 300000 + s_suppkey AS seq, concat('V', CAST(s_suppkey % 40 AS varchar(20))) AS name, CASE WHEN s_suppkey % 3 > 0 THEN concat('C', CAST(s_suppkey % 9 AS varchar(20))) END AS base, 'global' AS area FROM {supplier}"),
    "argument": ("di.xml", "config", '<type name="{owner}"><arguments><argument name="a" xsi:type="array"><item name="{item}" xsi:type="{kind}">{value}</item></argument></arguments></type>',
        "SELECT p_partkey % 25 AS module, 500000 + p_partkey AS seq, concat('O', CAST(p_size AS varchar(20))) AS owner, concat('k', CAST(p_partkey % 5 AS varchar(20))) AS item, CASE WHEN p_partkey % 4 = 0 THEN 'object' ELSE 'string' END AS kind, p_name AS value, 'global' AS area FROM {part}"),
    "observer": ("events.xml", "config", '<event name="{event}"><observer name="{name}"{?instance:instance}{?disabled:off}{?shared:shared}/></event>',
        "SELECT event_id % 25 AS module, event_id AS seq, event_type AS event, concat('o', CAST(user_id % 20 AS varchar(20))) AS name, CASE WHEN event_id % 7 > 0 THEN concat('Obs', CAST(event_id AS varchar(20))) END AS instance, CASE WHEN event_id % 9 = 0 THEN 'true' END AS off, CASE WHEN event_id % 8 = 0 THEN 'false' END AS shared, "
        "CASE WHEN event_id % 10 = 0 THEN 'adminhtml' ELSE 'global' END AS area FROM {events}"),
    "job": ("crontab.xml", "config", '<group id="{grp}"><job name="{name}" instance="{instance}" method="run"><schedule>{plan}</schedule></job></group>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, concat('g', CAST(s_suppkey % 2 AS varchar(20))) AS grp, concat('j', CAST(s_suppkey % 30 AS varchar(20))) AS name, concat('Job', CAST(s_suppkey AS varchar(20))) AS instance, concat(CAST(s_suppkey % 60 AS varchar(20)), ' * * * *') AS plan FROM {supplier}"),
    "route": ("routes.xml", "config", '<router id="standard"><route id="{id}"{?frontName:front}><module name="{mod}"/></route></router>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, concat('r', CAST(s_suppkey % 6 AS varchar(20))) AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('front', CAST(s_suppkey % 9 AS varchar(20))) END AS front, concat('M_N', CAST(s_suppkey % 4 AS varchar(20))) AS mod, 'frontend' AS area FROM {supplier}"),
    "webapi": ("webapi.xml", "routes", '<route url="{url}" method="{method}"><service class="{cls}" method="go"/><resources><resource ref="{ref}"/></resources></route>',
        "SELECT p_partkey % 25 AS module, p_partkey AS seq, concat('/V1/', CAST(p_size AS varchar(20))) AS url, CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('S', CAST(p_partkey AS varchar(20))) AS cls, concat('a', CAST(p_partkey % 35 AS varchar(20))) AS ref FROM {part}"),
    "table": ("db_schema.xml", "schema", '<table name="{name}"{?engine:engine}{?comment:comment}{?disabled:off}/>',
        "SELECT c_custkey % 25 AS module, 2 * c_custkey AS seq, concat('t', CAST(c_custkey % 40 AS varchar(20))) AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS engine, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS comment, CASE WHEN c_custkey % 9 = 0 THEN 'true' END AS off FROM {customer}"),
    "column": ("db_schema.xml", "schema", '<table name="{tab}"><column name="{name}" xsi:type="{kind}"{?disabled:off}/></table>',
        "SELECT p_partkey % 25 AS module, 2 * p_partkey + 1 AS seq, concat('t', CAST(p_partkey % 40 AS varchar(20))) AS tab, concat('c', CAST(p_size % 8 AS varchar(20))) AS name, p_type AS kind, CASE WHEN p_partkey % 13 = 0 THEN 'true' END AS off FROM {part}"),
    "acl": ("acl.xml", "config", '<resource id="{parent}"><resource id="{id}"{?title:title}{?sortOrder:place}{?disabled:off}/></resource>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, concat('g', CAST(s_suppkey % 30 % 4 AS varchar(20))) AS parent, concat('a', CAST(s_suppkey % 30 AS varchar(20))) AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS title, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 17 AS varchar(20)) END AS place, CASE WHEN s_suppkey % 20 = 0 THEN 'true' END AS off FROM {supplier}"),
    "menu": ("menu.xml", "config", '<menu><add id="{id}"{?title:title}{?parent:parent}{?sortOrder:place}/></menu>',
        "SELECT s_suppkey % 25 AS module, 2 * s_suppkey AS seq, concat('m', CAST(s_suppkey % 30 AS varchar(20))) AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS title, CASE WHEN s_suppkey % 30 >= 5 THEN concat('m', CAST(s_suppkey % 5 AS varchar(20))) END AS parent, CAST(s_suppkey % 4 AS varchar(20)) AS place, 'adminhtml' AS area FROM {supplier}"),
    "unmenu": ("menu.xml", "config", '<menu><remove id="{id}"/></menu>',
        "SELECT s_suppkey % 25 AS module, 2 * s_suppkey + 1 AS seq, concat('m', CAST(s_suppkey * 7 % 30 AS varchar(20))) AS id, 'adminhtml' AS area FROM {supplier} WHERE s_suppkey % 11 = 3"),
    "setting": ("config.xml", "config", "<{scope}><x><g{grp}><f{field}>{value}</f{field}></g{grp}></x></{scope}>",
        "SELECT c_custkey % 25 AS module, c_custkey AS seq, 'default' AS scope, CAST(c_nationkey AS varchar(20)) AS grp, CAST(c_custkey % 10 AS varchar(20)) AS field, c_mktsegment AS value FROM {customer}"),
    "indexer": ("indexer.xml", "config", '<indexer id="{id}"{?view_id:view}{?class:cls}><dependencies><indexer id="{needs}"/></dependencies></indexer>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, concat('i', CAST(s_suppkey % 12 AS varchar(20))) AS id, CASE WHEN s_suppkey % 3 = 0 THEN concat('v', CAST(s_suppkey % 12 AS varchar(20))) END AS view, CASE WHEN s_suppkey % 2 = 0 THEN concat('Ix', CAST(s_suppkey AS varchar(20))) END AS cls, concat('i', CAST(s_suppkey % 5 AS varchar(20))) AS needs FROM {supplier}"),
    "view": ("mview.xml", "config", '<view id="{id}"><subscriptions><table name="{tab}" entity_column="{col}"/></subscriptions></view>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, concat('v', CAST(s_suppkey % 12 AS varchar(20))) AS id, concat('t', CAST(s_suppkey % 3 AS varchar(20))) AS tab, concat('e', CAST(s_suppkey AS varchar(20))) AS col FROM {supplier}"),
    "extension": ("extension_attributes.xml", "config", '<extension_attributes for="{target}"><attribute code="{code}" type="{kind}"/></extension_attributes>',
        "SELECT p_partkey % 25 AS module, p_partkey AS seq, concat('I', CAST(p_size AS varchar(20))) AS target, concat('e', CAST(p_partkey % 4 AS varchar(20))) AS code, p_type AS kind FROM {part}"),
    "catalogue": ("catalog_attributes.xml", "config", '<group name="{grp}"><attribute name="{name}"/></group>',
        "SELECT p_partkey % 25 AS module, p_partkey AS seq, concat('g', CAST(p_partkey % 6 AS varchar(20))) AS grp, concat('n', CAST(p_size % 15 AS varchar(20))) AS name FROM {part}"),
    "widget": ("widget.xml", "widgets", '<widget id="{id}"{?class:cls}><parameters><parameter name="{param}" type="{kind}"/></parameters></widget>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, concat('w', CAST(s_suppkey % 8 AS varchar(20))) AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('W', CAST(s_suppkey AS varchar(20))) END AS cls, concat('q', CAST(s_suppkey % 3 AS varchar(20))) AS param, CASE WHEN s_suppkey % 4 > 1 THEN 'text' ELSE 'select' END AS kind FROM {supplier}"),
    "fieldset": ("fieldset.xml", "config", '<scope id="global"><fieldset id="{id}"><field name="{name}"><aspect name="{aspect}"{?targetField:target}/></field></fieldset></scope>',
        "SELECT p_partkey % 25 AS module, p_partkey AS seq, concat('s', CAST(p_partkey % 4 AS varchar(20))) AS id, concat('f', CAST(p_size % 6 AS varchar(20))) AS name, concat('to', CAST(p_partkey % 2 AS varchar(20))) AS aspect, CASE WHEN p_partkey % 3 = 0 THEN concat('x', CAST(p_partkey AS varchar(20))) END AS target FROM {part}"),
    "topic": ("communication.xml", "config", '<topic name="a.{name}"{?request:request}/>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, CAST(s_suppkey % 14 AS varchar(20)) AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('q', CAST(s_suppkey AS varchar(20))) END AS request FROM {supplier}"),
    "publisher": ("queue_publisher.xml", "config", '<publisher topic="a.{name}" queue="d{queue}"/>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, CAST(s_suppkey % 20 AS varchar(20)) AS name, CAST(s_suppkey AS varchar(20)) AS queue FROM {supplier} WHERE s_suppkey % 3 = 0"),
    "consumer": ("queue_consumer.xml", "config", '<consumer name="k{name}" queue="{queue}"{?connection:conn}/>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, CAST(s_suppkey % 9 AS varchar(20)) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'fan' ELSE concat('d', CAST(s_suppkey AS varchar(20))) END AS queue, CASE WHEN s_suppkey % 4 = 0 THEN 'db' END AS conn FROM {supplier}"),
    "binding": ("queue_topology.xml", "config", '<exchange name="x"><binding id="b{id}" topic="{pattern}" destination="fan"/></exchange>',
        "SELECT n_nationkey AS module, n_nationkey AS seq, CAST(n_nationkey AS varchar(20)) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'a.#' ELSE concat('a.', CAST(n_nationkey AS varchar(20))) END AS pattern FROM {nation} WHERE n_nationkey IN (1, 3, 8)"),
    "sequence": ("module.xml", "config", '<module name="M_N{module}"><sequence><module name="M_N{after}"/></sequence></module>',
        "SELECT n_nationkey AS module, n_nationkey AS seq, CAST(n_nationkey * 3 % 25 AS varchar(20)) AS after FROM {nation} WHERE n_nationkey % 7 <> 6"),
    "field": ("system.xml", "config", '<system><section id="s{sec}"><group id="g{grp}"><field id="f{field}"{?type:kind}{?showInDefault:d}{?showInStore:st}/></group></section></system>',
        "SELECT c_custkey % 25 AS module, c_custkey AS seq, CAST(c_custkey % 3 AS varchar(20)) AS sec, CAST(c_custkey % 4 AS varchar(20)) AS grp, CAST(c_custkey % 10 AS varchar(20)) AS field, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS kind, CASE WHEN c_custkey % 5 = 0 THEN '1' WHEN c_custkey % 5 = 1 THEN '0' END AS d, CASE WHEN c_custkey % 7 = 0 THEN '1' END AS st, 'adminhtml' AS area FROM {customer}"),
    "class": ("", "", "<?php\nabstract class C{name} extends C{parent} implements I{face} {}",
        "SELECT p_partkey AS module, p_partkey AS seq, CAST(p_partkey AS varchar(20)) AS name, CAST(p_partkey - p_partkey % 4 - 1 AS varchar(20)) AS parent, CAST(p_size AS varchar(20)) AS face FROM {part} WHERE p_partkey BETWEEN 4 AND 60"),
    "text": ("i18n", "", '"{key}","{value}"',
        "SELECT c_custkey % 25 AS module, c_custkey AS seq, concat('key, ', CAST(c_custkey % 50 AS varchar(20))) AS key, concat('v', CAST(c_custkey AS varchar(20))) AS value FROM {customer}"),
    "block": ("layout", "page", '<block name="b{name}" template="{template}"/>',
        "SELECT s_suppkey % 25 AS module, s_suppkey AS seq, CAST(s_suppkey AS varchar(20)) AS name, concat('M_N', CAST(s_suppkey % 25 AS varchar(20)), '::t', CAST(s_suppkey % 6 AS varchar(20)), '.phtml') AS template FROM {supplier}"),
    "template": ("phtml", "", "x",
        "SELECT n_nationkey AS module, n_nationkey AS seq, CAST(n_nationkey % 4 AS varchar(20)) AS name FROM {nation}"),
}
#: Rows of a module whose keys lie within so many make a piece of its file: 4,000 of a kind, as the modules are 25.
PIECE = 100_000
ENABLED = "module % 5 <> 4 AND module % 7 <> 6"  # in the configuration, and on disk


def rendered(pattern: str) -> Column:
    """The pattern with a row's columns."""
    out = []
    for part in re.split(r"(\{[^{}]*\})", pattern):
        if m := re.fullmatch(r"\{\?(\w+):(\w+)\}", part):
            out.append(F.when(F.col(m[2]).isNotNull(), F.concat(F.lit(f' {m[1]}="'), F.col(m[2]).cast("string"), F.lit('"'))).otherwise(""))
        elif m := re.fullmatch(r"\{(\w+)\}", part):
            out.append(F.coalesce(F.col(m[1]).cast("string"), F.lit("")))
        elif part:
            out.append(F.lit(part))
    return F.concat(*out)


def declared(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    sql = KINDS[kind][3]
    used = {t: table(spark, sf_dir, t) for t in SUPPLIED if f"{{{t}}}" in sql}
    return spark.sql(sql.replace("varchar(20)", "string"), **used)


def files(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    """path, content, piece, before: the files that declare these kinds, in pieces, and what makes the modules."""
    kinds = list(dict.fromkeys(["sequence", *kinds]))
    parts, others = [], []
    root = F.concat(F.lit("app/code/M/N"), F.col("module").cast("string"))
    for kind in kinds:
        name, around, pattern, _ = KINDS[kind]
        rows = declared(spark, sf_dir, kind)
        if kind == "class":
            others.append(rows.select(F.concat(F.lit("app/code/M/C"), "name", F.lit(".php")).alias("path"), rendered(pattern).alias("content")))
            continue
        if kind == "template":
            others.append(rows.select(F.concat(root, F.lit("/view/frontend/templates/t"), "name", F.lit(".phtml")).alias("path"), F.lit(pattern).alias("content")))
            continue
        area = F.when(F.col("area") == "global", "").otherwise(F.concat("area", F.lit("/"))) if "area" in rows.columns else F.lit("")
        place = {"i18n": F.lit("/i18n/de_DE.csv"), "layout": F.lit("/view/frontend/layout/page.xml")}.get(name, F.concat(F.lit("/etc/"), area, F.lit(name)))
        parts.append(rows.select(F.concat(root, place).alias("path"), F.lit(around).alias("around"), "seq", rendered(pattern).alias("text")))
    lines = reduce(DataFrame.unionByName, parts).withColumn("piece", F.expr(f"seq div {PIECE}"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    written = lines.groupBy("path", "piece").agg(F.first("around").alias("around"), body.alias("body"))
    long = lines.groupBy("path", "piece").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = written.join(long.select("path", "piece", before.alias("before")), ["path", "piece"])
    tagged = F.when(F.col("around") == "", F.col("body")).otherwise(F.concat(F.lit("<"), "around", F.lit(">\n"), "body", F.lit("\n</"), "around", F.lit(">")))
    listed = ", ".join(f"'M_N{k}' => {int(k % 5 != 4)}" for k in range(25))
    config = spark.createDataFrame([("app/etc/config.php", f"<?php return ['modules' => [{listed}]];"), ("app/code/M/Extra/etc/module.xml", '<config><module name="M_Extra"/></config>')], "path string, content string")
    single = [df.select("path", "content", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("before")) for df in (config, *others)]
    return reduce(DataFrame.unionByName, [whole.select("path", tagged.alias("content"), "piece", "before"), *single])


def over_rows(sql: str, kinds: list[str]) -> str:
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    tables = ", ".join(f'"{k}" AS (SELECT * FROM ({plain(KINDS[k][3])}) WHERE {ENABLED if k not in ("class", "template") else "true"})' for k in kinds)
    own = sql.lstrip()
    recursive = "RECURSIVE " * own.startswith("WITH RECURSIVE")
    return f"WITH {recursive}{tables}{',' if own.startswith('WITH') else ''} {own.removeprefix('WITH').removeprefix(' RECURSIVE')}"


def query(sql: str, *kinds: str) -> Callable:
    def register(function: Callable[[Catalogues], DataFrame]) -> Callable:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Catalogues(files(spark, sf_dir, list(kinds))))
        ORACLES[function.__name__] = over_rows(sql, list(kinds)) if kinds else sql
        return function

    return register


def joined(column: str, separator: str = ",") -> Column:
    return F.array_join(F.coalesce(column, F.array().cast("array<string>")), separator).alias(column)


LAST = "max_by({0}, (module, seq)) FILTER ({0} IS NOT NULL) AS {0}"
#: Rows as an area sees them: layer 1 the global ones, 2 its own.
SEEN = "(SELECT 'global' AS seen, 1 AS layer, * FROM {0} WHERE area = 'global' UNION ALL SELECT '{1}', 1, * FROM {0} WHERE area = 'global' UNION ALL SELECT '{1}', 2, * FROM {0} WHERE area = '{1}')"


@query("""SELECT 'M_N' || n_nationkey AS name, n_nationkey % 5 <> 4 AS enabled, n_nationkey::INT AS load_order, CASE WHEN n_nationkey % 7 = 6 THEN 'missing on disk' WHEN n_nationkey % 5 = 4 THEN 'disabled' ELSE 'enabled' END AS state FROM nation
UNION ALL SELECT 'M_Extra', false, NULL, 'not registered'""")
def tree_modules(shop):
    return shop.modules.select("name", "enabled", F.col("load_order").cast("int").alias("load_order"), "state")


@query(f"SELECT seen AS area, target AS \"for\", max_by(cls, (layer, module, seq)) AS type FROM {SEEN.format('preference', 'frontend')} GROUP BY 1, 2", "preference")
def tree_preferences(shop):
    return shop.preferences.filter("area IN ('global', 'frontend')").select("area", "for", "type")


@query("""WITH last AS (SELECT target AS node, max_by(cls, (module, seq)) AS next FROM preference WHERE area = 'global' GROUP BY 1)
SELECT node, next AS target, 1::BIGINT AS steps FROM last""", "preference")
def tree_concrete_types(shop):
    return shop.preference_of("global").select("node", "target", "steps")


@query(f"""SELECT seen AS area, target, name, max_by(cls, (layer, module, seq)) FILTER (cls IS NOT NULL) AS class, max_by(place, (layer, module, seq)) FILTER (place IS NOT NULL)::INT AS sort_order, max_by(off, (layer, module, seq)) FILTER (off IS NOT NULL) = 'true' AS disabled,
  'M_N' || max_by(module, (layer, module, seq)) AS module FROM {SEEN.format('plugin', 'frontend')} GROUP BY ALL""", "plugin")
def tree_plugins(shop):
    return shop.plugins.filter("area IN ('global', 'frontend')").select("area", "target", "name", "class", "sort_order", "disabled", F.col("source.module").alias("module"))


@query("""WITH m AS (SELECT target, name, max_by(cls, (module, seq)) FILTER (cls IS NOT NULL) AS cls, coalesce(max_by(off, (module, seq)) FILTER (off IS NOT NULL) = 'true', false) AS off FROM plugin WHERE area = 'global' GROUP BY ALL)
SELECT target AS class, name, cls AS plugin FROM m WHERE cls IS NOT NULL AND NOT off""", "plugin")
def tree_running_plugins(shop):
    return shop.plugins_on("global").select("class", "name", "plugin")


@query("""WITH m AS (SELECT target, name, max_by(cls, (module, seq)) FILTER (cls IS NOT NULL) AS cls, coalesce(max_by(off, (module, seq)) FILTER (off IS NOT NULL) = 'true', false) AS off FROM plugin WHERE area = 'global' GROUP BY ALL)
SELECT target, name, off AS disabled, 'global' AS area FROM m WHERE cls = 'Plug3'
UNION ALL SELECT target, name, disabled, 'frontend' FROM (SELECT target, name, max_by(cls, (l, module, seq)) FILTER (cls IS NOT NULL) AS cls, coalesce(max_by(off, (l, module, seq)) FILTER (off IS NOT NULL) = 'true', false) AS disabled
  FROM (SELECT CASE WHEN area = 'global' THEN 1 ELSE 2 END AS l, * FROM plugin) GROUP BY ALL) WHERE cls = 'Plug3' AND (target, name) NOT IN (SELECT (target, name) FROM m WHERE cls = 'Plug3')""", "plugin")
def tree_plugin_targets(shop):
    return shop.targets_of("Plug3").select("target", "name", "disabled", "area")


@query("""WITH v AS (SELECT name, max_by(base, (module, seq)) FILTER (base IS NOT NULL) AS base FROM virtual GROUP BY 1) SELECT name, base AS type FROM v""", "virtual")
def tree_virtual_types(shop):
    return shop.virtual_types.filter("area = 'global'").select("name", "type")


@query("""WITH r AS (SELECT *, lag(kind) OVER (PARTITION BY owner, item ORDER BY module, seq) AS was FROM argument),
c AS (SELECT owner, item, max((module, seq)) FILTER (was IS NOT NULL AND was <> kind) AS reset FROM r GROUP BY ALL)
SELECT r.owner, r.item, max_by(r.kind, (module, seq)) AS kind, max_by(value, (module, seq)) AS value FROM r JOIN c ON c.owner = r.owner AND c.item = r.item WHERE reset IS NULL OR (module, seq) >= reset GROUP BY ALL""", "argument")
def tree_arguments(shop):
    return shop.arguments.filter("area = 'global' AND size(path) = 2").select("owner", F.col("path")[1].alias("item"), "kind", "value")


@query("""SELECT (SELECT count(DISTINCT target) FROM preference WHERE area = 'global') AS preferences, (SELECT count(DISTINCT name) FROM virtual) AS virtual_types, (SELECT count(DISTINCT (target, name)) FROM plugin WHERE area = 'global') AS plugins,
  (SELECT count(DISTINCT target) FROM (SELECT target, name, max_by(cls, (module, seq)) FILTER (cls IS NOT NULL) AS cls, max_by(off, (module, seq)) FILTER (off IS NOT NULL) AS off FROM plugin WHERE area = 'global' GROUP BY ALL) WHERE cls IS NOT NULL AND coalesce(off, 'false') <> 'true') AS targets,
  (SELECT count(DISTINCT owner) FROM argument) AS configured_types""", "preference", "plugin", "virtual", "argument")
def tree_summary(shop):
    return shop.summary("global")


@query("""SELECT how, "by", path FROM (SELECT 'preference for' AS how, cls AS "by", * FROM preference WHERE target = 'I7' UNION ALL SELECT 'preference', target, * FROM preference WHERE cls = 'I7'), LATERAL (SELECT 'app/code/M/N' || module || '/etc/' || CASE area WHEN 'global' THEN '' ELSE area || '/' END || 'di.xml' AS path)""", "preference")
def tree_uses(shop):
    return shop.uses("I7").select("how", "by", "path")


@query(f"""SELECT seen AS area, event, name, max_by(coalesce(instance, ''), (layer, module, seq)) AS instance, max_by(off, (layer, module, seq)) FILTER (off IS NOT NULL) = 'true' AS disabled, max_by(shared, (layer, module, seq)) FILTER (shared IS NOT NULL) = 'true' AS shared FROM {SEEN.format('observer', 'adminhtml')} GROUP BY ALL""", "observer")
def tree_observers(shop):
    return shop.observers.filter("area IN ('global', 'adminhtml')").select("area", "event", "name", F.coalesce("instance", F.lit("")).alias("instance"), "disabled", "shared")


@query("SELECT event, count(DISTINCT name) AS observers FROM observer WHERE area = 'global' GROUP BY 1", "observer")
def tree_events(shop):
    return shop.events("global")


@query('SELECT grp AS "group", name, max_by(instance, (module, seq)) AS instance, max_by(plan, (module, seq)) AS schedule FROM job GROUP BY ALL', "job")
def tree_cron_jobs(shop):
    return shop.cron_jobs.select("group", "name", "instance", "schedule")


@query("""WITH f AS (SELECT id, mod, min((module, seq)) AS pos FROM route GROUP BY ALL), l AS (SELECT id, string_agg(mod, ',' ORDER BY pos) AS modules FROM f GROUP BY 1)
SELECT id, max_by(front, (module, seq)) FILTER (front IS NOT NULL) AS front_name, any_value(modules) AS modules FROM route JOIN l USING (id) GROUP BY 1""", "route")
def tree_routes(shop):
    return shop.routes.filter("area = 'frontend'").select("id", "front_name", joined("modules"))


@query("""WITH f AS (SELECT url, method, ref, min((module, seq)) AS pos FROM webapi GROUP BY ALL), l AS (SELECT url, method, string_agg(ref, ',' ORDER BY pos) AS resources FROM f GROUP BY ALL)
SELECT url, method AS http_method, max_by(cls, (module, seq)) AS class, any_value(resources) AS resources FROM webapi JOIN l USING (url, method) GROUP BY ALL""", "webapi")
def tree_webapi(shop):
    return shop.webapi.select("url", "http_method", "class", joined("resources"))


GONE = """WITH gone AS (SELECT name, max((module, seq)) AS at FROM "table" WHERE off = 'true' GROUP BY 1), live AS (SELECT t.* FROM "table" t LEFT JOIN gone g USING (name) WHERE g.at IS NULL OR (t.module, t.seq) > g.at)"""


@query(f"{GONE} SELECT name, {LAST.format('engine')}, {LAST.format('comment')} FROM live GROUP BY 1", "table")
def tree_tables(shop):
    return shop.tables.select("name", "engine", "comment")


@query(f"""{GONE}, own AS (SELECT c.* FROM "column" c LEFT JOIN gone g ON g.name = c.tab WHERE g.at IS NULL OR (c.module, c.seq) > g.at),
implied AS (SELECT name FROM live UNION SELECT tab FROM own),
cut AS (SELECT tab, name, max((module, seq)) AS at FROM own WHERE off = 'true' GROUP BY ALL)
SELECT o.tab AS "table", o.name, max_by(kind, (module, seq)) AS type FROM own o LEFT JOIN cut USING (tab, name) WHERE (cut.at IS NULL OR (module, seq) > cut.at) AND o.tab IN (SELECT name FROM implied) GROUP BY ALL""", "table", "column")
def tree_columns(shop):
    return shop.parts_of_tables("columns", "name").select("table", "name", "type")


@query(f"""WITH own AS (SELECT parent, id, title, place, off, module, seq FROM acl), every AS (SELECT id, {LAST.format('title')}, {LAST.format('place')}, {LAST.format('parent')}, bool_or(off IS NOT NULL) AS disabled FROM own GROUP BY 1
  UNION ALL SELECT DISTINCT parent, NULL, NULL, NULL, false FROM own)
SELECT e.id, e.title, e.parent, e.disabled, row_number() OVER (ORDER BY coalesce(p.place::INT, e.place::INT, 0) * 0, CASE WHEN e.parent IS NULL THEN e.id ELSE e.parent END, e.parent IS NOT NULL, coalesce(e.place::INT, 0), e.id)::INT AS position FROM every e LEFT JOIN every p ON p.id = e.parent""", "acl")
def tree_acl(shop):
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("path"))  # of a tree of a hundred resources
    return shop.acl.select("id", "title", "parent", "disabled", place.alias("position"))


@query("""WITH c AS (SELECT id, module, seq, title, parent, place, false AS gone FROM menu UNION ALL SELECT id, module, seq, NULL, NULL, NULL, true FROM unmenu),
g AS (SELECT id, max((module, seq)) AS at FROM c WHERE gone GROUP BY 1), l AS (SELECT c.* FROM c LEFT JOIN g USING (id) WHERE NOT gone AND (g.at IS NULL OR (module, seq) > g.at)),
m AS (SELECT id, max_by(title, (module, seq)) FILTER (title IS NOT NULL) AS title, max_by(parent, (module, seq)) FILTER (parent IS NOT NULL) AS parent FROM l GROUP BY 1)
SELECT id, title, parent, CASE WHEN parent IN (SELECT id FROM m) THEN 1 ELSE 0 END AS depth FROM m""", "menu", "unmenu")
def tree_menu(shop):
    return shop.menu.select("id", "title", "parent", "depth")


@query("SELECT 'default' AS scope, 'x/g' || grp || '/f' || field AS path, max_by(value, (module, seq)) AS value FROM setting GROUP BY ALL", "setting")
def tree_settings(shop):
    return shop.config_values().select("scope", "path", "value")


@query("SELECT 'x/g' || grp || '/f' || field AS path, max_by(value, (module, seq)) AS value FROM setting WHERE grp = '3' GROUP BY ALL", "setting")
def tree_config_section(shop):
    return shop.config_section(shop.config_values(), "stores/en", "x/g3", {"en": "base"}).select("path", "value")


@query("""WITH n AS (SELECT id, needs, min((module, seq)) AS pos FROM indexer GROUP BY ALL), d AS (SELECT id, string_agg(needs, ',' ORDER BY pos) AS dependencies FROM n GROUP BY 1),
s AS (SELECT id AS view_id, tab, max_by(col, (module, seq)) AS col FROM "view" GROUP BY ALL), t AS (SELECT view_id, string_agg(tab || ':' || col, ',' ORDER BY tab || ':' || col) AS subscriptions FROM s GROUP BY 1),
i AS (SELECT id, max_by("view", (module, seq)) FILTER ("view" IS NOT NULL) AS view_id, max_by(cls, (module, seq)) FILTER (cls IS NOT NULL) AS class FROM indexer GROUP BY 1)
SELECT id, view_id, class, dependencies, coalesce(subscriptions, '') AS subscriptions FROM i JOIN d USING (id) LEFT JOIN t USING (view_id)""", "indexer", "view")
def tree_indexers(shop):
    return shop.indexers.select("id", "view_id", "class", joined("dependencies"), joined("subscriptions"))


@query('SELECT target AS "for", code, max_by(kind, (module, seq)) AS type FROM extension GROUP BY ALL', "extension")
def tree_extension_attributes(shop):
    return shop.extension_attributes.select("for", "code", "type")


@query("""WITH f AS (SELECT grp, name, min((module, seq)) AS pos FROM catalogue GROUP BY ALL) SELECT grp AS "group", string_agg(name, ',' ORDER BY pos) AS attributes FROM f GROUP BY 1""", "catalogue")
def tree_catalog_attributes(shop):
    return shop.catalog_attributes.select("group", joined("attributes"))


@query("""WITH p AS (SELECT id, param, max_by(kind, (module, seq)) AS kind, min((module, seq)) AS pos FROM widget GROUP BY ALL), l AS (SELECT id, string_agg(param || ':' || kind, ',' ORDER BY pos) AS parameters FROM p GROUP BY 1)
SELECT id, max_by(cls, (module, seq)) FILTER (cls IS NOT NULL) AS class, any_value(parameters) AS parameters FROM widget JOIN l USING (id) GROUP BY 1""", "widget")
def tree_widgets(shop):
    return shop.widgets.select("id", "class", joined("parameters"))


@query("""WITH a AS (SELECT id, name, aspect, max_by(coalesce(target, '*'), (module, seq)) AS target FROM fieldset GROUP BY ALL), l AS (SELECT id, name, string_agg(aspect || '=' || target, ',' ORDER BY aspect || '=' || target) AS aspects FROM a GROUP BY ALL)
SELECT id AS fieldset, name AS field, 'M_N' || min(module) AS module, any_value(aspects) AS aspects FROM fieldset JOIN l USING (id, name) GROUP BY ALL""", "fieldset")
def tree_fieldsets(shop):
    return shop.fieldsets.select("fieldset", "field", "module", joined("aspects"))


@query("""SELECT 's' || sec || '/g' || grp || '/f' || field AS path, max_by(kind, (module, seq)) FILTER (kind IS NOT NULL) AS type,
  concat_ws(',', CASE WHEN max_by(d, (module, seq)) FILTER (d IS NOT NULL) = '1' THEN 'default' END, CASE WHEN max_by(st, (module, seq)) FILTER (st IS NOT NULL) = '1' THEN 'store' END) AS scopes FROM field GROUP BY sec, grp, field""", "field")
def tree_system_fields(shop):
    return shop.system_fields.select("path", "type", joined("scopes"))


@query("""SELECT 'a.' || name AS name, max_by(request, (module, seq)) FILTER (request IS NOT NULL) AS request FROM topic GROUP BY 1""", "topic")
def tree_topics(shop):
    return shop.topology["topics"].select("name", "request")


@query("""WITH t AS (SELECT DISTINCT 'a.' || name AS topic FROM topic), d AS (SELECT 'a.' || name AS topic, 'd' || max_by(queue, (module, seq)) AS queue, 'publisher' AS via FROM publisher GROUP BY 1),
b AS (SELECT topic, 'fan' AS queue, 'binding' AS via FROM t WHERE EXISTS (SELECT 1 FROM binding WHERE pattern = 'a.#' OR pattern = topic)),
c AS (SELECT 'k' || name AS consumer, max_by(queue, (module, seq)) AS queue FROM consumer GROUP BY 1)
SELECT DISTINCT t.topic, r.queue, r.via, c.consumer FROM t LEFT JOIN (SELECT * FROM d UNION ALL SELECT * FROM b) r USING (topic) LEFT JOIN c ON c.queue = r.queue""", "topic", "publisher", "binding", "consumer")
def tree_queue_routes(shop):
    return shop.queue_routes()


@query("""SELECT 'k' || name AS name, max_by(queue, (module, seq)) AS queue, max_by(coalesce(conn, 'amqp'), (module, seq)) AS connection FROM consumer GROUP BY 1""", "consumer")
def tree_consumers(shop):
    return shop.topology["consumers"].select("name", "queue", "connection")


@query("""WITH e AS (SELECT 'M_N' || module AS a, 'M_N' || after AS b FROM sequence) SELECT a AS module, b AS other, 'needs' AS direction FROM e UNION SELECT b, a, 'needed by' FROM e""", "sequence")
def tree_dependencies(shop):
    return relations.dependencies(shop).select("module", "other", "direction")


@query("""WITH RECURSIVE e AS (SELECT 'C' || name AS src, 'C' || parent AS dst FROM class UNION SELECT 'C' || name, 'I' || face FROM class),
w(root, node, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT root, dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 60)
SELECT root, node, min(depth)::INT AS depth FROM w GROUP BY ALL""", "class")
def tree_ancestors(shop):
    return shop.hierarchy.filter("depth > 0").select("root", "node", F.col("depth").cast("int").alias("depth"))


@query("""WITH own AS (SELECT target, max_by(cls, (module, seq)) AS cls FROM preference WHERE area = 'global' GROUP BY 1)
SELECT 'PreferenceTargetMissing' AS lint, cls AS subject, count(*) AS n FROM preference WHERE substr(cls, 2)::INT NOT IN (SELECT name::INT FROM class) GROUP BY ALL""", "preference", "class")
def tree_missing_classes(shop):
    rows = doctor.missing(shop.declared("preferences"), "type", shop, ["C"])
    return rows.groupBy(F.col("type").alias("subject")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("PreferenceTargetMissing").alias("lint"), "subject", "n")


@query("""SELECT DISTINCT ref AS subject FROM webapi WHERE ref NOT IN (SELECT id FROM acl UNION SELECT parent FROM acl)""", "webapi", "acl")
def tree_unknown_resources(shop):
    return doctor.doctor(shop, []).filter("lint = 'AclResourceUnknown'").select("subject").distinct()


@query("""SELECT 'M_N' || module AS module, key, value FROM text""", "text")
def tree_translations(shop):
    return shop.translations("key", "de_DE").select(F.regexp_replace("path", "^app/code/M/(N[0-9]+)/.*$", "M_$1").alias("module"), "key", "value")


@query("""WITH f AS (SELECT 'M_N' || module || '::t' || name || '.phtml' AS reference, count(*) AS files FROM template WHERE module % 5 <> 4 AND module % 7 <> 6 GROUP BY 1), u AS (SELECT template AS reference, count(*) AS usages FROM block GROUP BY 1)
SELECT reference, coalesce(files, 0) AS files, coalesce(usages, 0) AS usages FROM f FULL JOIN u USING (reference)""", "block", "template")
def tree_templates(shop):
    return frontend.templates(shop).select("reference", F.size("files").cast("long").alias("files"), F.size("usages").cast("long").alias("usages"))


@query("SELECT 'page' AS handle, count(*) AS contributions FROM block", "block")
def tree_layout_handles(shop):
    return frontend.handles(shop, "frontend")


@query("""SELECT DISTINCT template AS reference FROM block WHERE template NOT IN (SELECT 'M_N' || module || '::t' || name || '.phtml' FROM template WHERE module % 5 <> 4 AND module % 7 <> 6)""", "block", "template")
def tree_missing_templates(shop):
    return frontend.missing_templates(shop).select("reference")
