"""The queries of the ten operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, licenses, media, mixing, quality_rules, sharding, simhash, urls, warc
from .common import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scores(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, most=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op8_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents"))


def op9_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_byte_bpe, op3_simhash, op4_warc, op5_url_filter, op6_mix_sources, op7_license_scan, op8_shard_table, op9_media_avi, op10_quality_rules)
}

WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
       CASE WHEN q.payload_bytes >= 1000 AND q.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN q.payload_bytes >= 1000 AND q.page_id < g.top THEN g.top END AS refers_to
FROM q LEFT JOIN g USING (payload_digest)
"""

HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"

#: Targets by rounds of resharing come to the level that fills all; here it is found over the sorted ratios, and all quotients are ranked.
MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
t AS (SELECT sum(source_size)::BIGINT AS total FROM s),
r AS (SELECT w.*, total,
        total - 3 * coalesce(sum(source_size) OVER o, 0)::BIGINT AS room,
        (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS rest
      FROM w, t WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT room, rest FROM r WHERE 3 * source_size * rest > room * weight ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
target AS (SELECT r.source, r.source_size, total,
        CASE WHEN 3 * source_size * r.rest <= r.room * weight OR level.rest IS NULL THEN (3 * source_size)::DOUBLE
             ELSE (level.room * weight)::DOUBLE / level.rest::DOUBLE END AS target
      FROM r LEFT JOIN level ON true),
seats AS (SELECT source, target, round(total / 64)::BIGINT AS n, unnest(range(0, (target / 64 + 2)::BIGINT * 2)) AS k FROM target),
won AS (SELECT source, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS pick FROM seats WHERE target > 0) WHERE pick <= n GROUP BY 1),
q AS (SELECT target.*, coalesce(blocks, 0) AS blocks, greatest(ceil(source_size / 100000), 1)::BIGINT AS shards FROM target LEFT JOIN won ON target.source IS NOT DISTINCT FROM won.source),
p AS (SELECT d.doc_id, d.source, d.size, source_size, target, blocks, {HASH.format("'mix|shard|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size::VARCHAR")} % shards AS shard, md5('mix|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size::VARCHAR) AS place
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, max(blocks) AS blocks, max(source_size) AS of FROM p GROUP BY 1, 2),
shard_seats AS (SELECT source, shard, shard_size, blocks, unnest(range(0, ((shard_size * blocks / greatest(of, 1))::BIGINT + 4) * 2)) AS k FROM h WHERE shard_size > 0),
shard_won AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard) AS pick FROM shard_seats) WHERE pick <= blocks GROUP BY 1, 2),
g AS (SELECT h.source, h.shard, shard_size, greatest(round(shard_size / 64)::BIGINT, 1) AS m, coalesce(quota, 0) AS quota
      FROM h LEFT JOIN shard_won z ON h.source IS NOT DISTINCT FROM z.source AND h.shard = z.shard),
e AS (SELECT g.source, g.shard, shard_size, m, least(quota, 3 * m) AS quota, {HASH.format("'mix|start|' || coalesce(g.source, '') || '|' || g.shard::VARCHAR")} % m AS k FROM g),
l AS (SELECT p.*, shard_size, quota // m AS whole, k * shard_size // m AS low, least(k + quota % m, m) * shard_size // m AS high, greatest(k + quota % m - m, 0) * shard_size // m AS wrap,
        sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop
      FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source AND p.shard = e.shard)
SELECT doc_id, size, source_size, target, source,
       (whole * size + greatest(least(stop, high) - greatest(stop - size, low), 0) + greatest(least(stop, wrap) - (stop - size), 0))::BIGINT AS taken
FROM l
"""

RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i,
        count(*) OVER a = 3 AS f3, md5(string_agg(word, ' ') OVER a) AS g3,
        count(*) OVER b = 10 AS f10, md5(string_agg(word, ' ') OVER b) AS g10,
        count(*) OVER c = 51 AS f51, md5(string_agg(word, ' ') OVER c) AS g51
      FROM u WINDOW a AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
        b AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING),
        c AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)),
r AS (SELECT rid, i,
        (f3 AND count(*) OVER (PARTITION BY rid, f3, g3) > 1)::INT AS r3,
        (f10 AND count(*) OVER (PARTITION BY rid, f10, g10) > 1)::INT AS r10,
        (f51 AND count(*) OVER (PARTITION BY rid, f51, g51) > 1)::INT AS r51 FROM g),
c AS (SELECT rid, r51,
        max(r3) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
        max(r10) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM r),
x AS (SELECT rid, sum(c3)::BIGINT AS n_repeat_words, sum(c10)::BIGINT AS n_covered, max(r51) AS too_long FROM c GROUP BY 1),
n AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, coalesce(too_long, 0) AS too_long
      FROM w LEFT JOIN x USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_covered <= 0.45 * n_words AND too_long = 0 AS kept, n_covered
FROM f
"""


def license_sql() -> str:
    def canonical(text: str) -> str:
        out = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{licenses.HOLDER}', ' ', 'g'), '{licenses.RESERVED}', ' ', 'g')"
        out = f"' ' || regexp_replace({out}, '{licenses.SEPARATORS}', ' ', 'g') || ' '"
        for one, other in licenses.SPELLINGS:
            out = f"replace({out}, '{one}', '{other}')"
        return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g'), ' '))"

    def rows(pairs) -> str:
        quote = lambda x: "'" + x.replace("'", "''") + "'"
        return ", ".join(f"({quote(n)}, {quote(t)})" for n, t in pairs)

    lines = licenses.known_lines()
    return f"""
WITH known AS (SELECT digest, min(name) AS license FROM (
        SELECT name, {canonical("body")} AS digest FROM (VALUES {rows([*licenses.variants(licenses.TEXTS), *lines])}) v(name, body)
        UNION ALL SELECT name, digest FROM (VALUES {rows((n, d) for d, n in licenses.DIGESTS.items())}) w(name, digest)) GROUP BY 1),
notice AS (SELECT name, {canonical("line")} AS digest FROM (VALUES {rows(lines)}) v(name, line)),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
n AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM l JOIN notice ON {canonical("l.line")} = notice.digest WHERE regexp_matches(lower(l.line), 'licen[cs]') GROUP BY 1),
c AS (SELECT rid, doc_id, {canonical("text")} AS digest FROM d)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM c LEFT JOIN known USING (digest) LEFT JOIN n USING (rid)
"""


#: Where a slot's n-th visitor comes from, the first turn wins, and in a turn the first shard: this is whom the slot belongs to.
#: A shard's turn is the number of slots that it claimed before, which makes the walk a recursion over claims.
SHARD_SQL = f"""
WITH RECURSIVE s AS (SELECT i::BIGINT AS i, {HASH.format("printf('shard-%04d', i) || '|offset'")} % 6571 AS start, {HASH.format("printf('shard-%04d', i) || '|skip'")} % 6570 + 1 AS skip FROM range(61) r(i)),
walk AS (
  SELECT 0::BIGINT AS claim, [NULL::INT FOR x IN range(6571)] AS owner, [0::BIGINT FOR x IN range(61)] AS turn
  UNION ALL
  SELECT claim + 1, list_concat(owner[:slot], [i::INT], owner[slot + 2:]), list_concat(turn[:i], [free + 1], turn[i + 2:])
  FROM (SELECT claim, owner, turn, i, free, (start + free * skip) % 6571 AS slot FROM (
    SELECT claim, owner, turn, i, start, skip, list_filter(range(turn[i + 1], 6571), lambda k: owner[(start + k * skip) % 6571 + 1] IS NULL)[1] AS free
    FROM walk JOIN s ON i = claim % 61 WHERE claim < 6571))
),
d AS (SELECT doc_id, ({HASH.format("coalesce(doc_id::VARCHAR, '')")} % 6571)::INT AS slot, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
o AS (SELECT unnest(owner) AS shard, unnest(range(6571)) AS place FROM walk WHERE claim = 6571)
SELECT doc_id, slot, o.shard, n_bytes FROM d JOIN o ON slot = place
"""

ORACLES: dict[str, str] = {
    "op4_warc": WARC_SQL,
    "op6_mix_sources": MIX_SQL,
    "op7_license_scan": license_sql(),
    "op8_shard_table": SHARD_SQL,
    "op10_quality_rules": RULES_SQL,
}
