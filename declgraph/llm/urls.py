"""URL filters: a rule list and mined association rules.

The rule list decides the urls that it fits. From these, FP-growth mines the
combinations of URL tokens (scheme, host labels and suffixes, path segments,
query keys, extension) that go with a block; rules under the support or
confidence bound are pruned, as are those that a more general rule of no
less confidence covers. One labelled url in five, by its hash, is
held out: a rule stays if it fits some of these and blocks them with the same
confidence. The rules match the other urls through an inverted index from a
rule's rarest token to its combination; a url that some rule fits is blocked.

All tokens of a url count, wherever they stand. A rule needs a share of the
labelled urls and a number of them, so rare tokens and rules of a few urls
fall out, and the number of rules has a bound that doesn't grow with the
table: at most 2^tokens / min_support, of the tokens that are neither certain
nor alike. They are one literal of the plan.

Defined cases: a null url, or one without ://, has an empty host and path, no
rule, and is judged by the tokens it has (none: allow); repeated rows are
judged alike; without labelled urls, or with fewer than a rule needs, no rule is mined; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's list: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Settings:
    min_support: float = 0.01  #: of the labelled urls that rules are mined from
    min_confidence: float = 0.9
    min_urls: int = 20  #: that go into a rule, whatever their share
    held_out: int = 5  #: one in so many labelled urls is for testing rules; 0: none is


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def listed(rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, or null."""
    out = None
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; numbers of a path are one token, so that ids don't count.

    Scheme, host, its first label, all labels and suffixes, the first and the second
    path segment, all segments at any place, extension, and all query keys.
    """
    number = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    own = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(number(path), "/"), lambda x: x != "")
    query = F.regexp_extract(own, r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))
    tagged = lambda tag, c: F.transform(c, lambda x: F.concat(F.lit(tag), x))
    one = lambda tag, c: tagged(tag, F.filter(F.array(c), lambda x: x != ""))
    every = F.concat(
        one("scheme:", F.lower(F.regexp_extract(own, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        one("host:", host),
        tagged("sub:", F.slice(labels, 1, 1)),
        tagged("label:", labels),
        tagged("suffix:", suffixes),
        tagged("seg:", F.slice(parts, 1, 1)),
        tagged("leaf:", F.slice(parts, 2, 1)),
        tagged("part:", parts),
        one("ext:", F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))),
        tagged("key:", keys),
    )
    return F.array_distinct(every)


def telling(labelled: DataFrame, settings: Settings) -> tuple[list[tuple[list[str], float, float]], dict[str, list[str]]]:
    """Rules of one token with confidence 1, and the classes of other tokens that can be in a rule.

    A token that too few blocked urls have is in no rule; one whose urls are all blocked covers all
    its combinations. Tokens of the same urls are one class, named by its least token:
    a combination of two of them is covered by that of one.
    """
    blocked = F.count_if(F.col("verdict") == "block")
    rows = labelled.count()
    least = max(settings.min_support * rows, settings.min_urls)
    row = labelled.select(F.xxhash64(F.array_sort("tokens")).alias("row"), "verdict", F.explode("tokens").alias("token"))
    same = [F.expr(f"sum(cast(xxhash64(row, {k}) % 1000000007 as decimal(30, 0)))").alias(f"same{k}") for k in (1, 2)]
    counted = row.groupBy("token").agg(F.count(F.lit(1)).alias("n"), blocked.alias("blocked"), *same).filter(F.col("blocked") >= least)
    certain, classes = [], defaultdict(list)
    for r in counted.collect():
        if r.n == r.blocked:
            certain.append(([r.token], 1.0, r.blocked / rows))
        else:
            classes[r.n, r.blocked, r.same1, r.same2].append(r.token)
    return certain, {min(c): sorted(c) for c in classes.values()}


def mine(labelled: DataFrame, settings: Settings) -> list[tuple[list[str], float, float]]:
    """(combination, confidence, support) of the rules for a block. labelled: tokens, verdict."""
    from pyspark.ml.fpm import FPGrowth

    labelled = labelled.filter(F.size("tokens") > 0)
    if labelled.isEmpty():
        return []
    certain, classes = telling(labelled, settings)
    rows = labelled.count()
    least = max(settings.min_support, settings.min_urls / rows)
    names = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>")
    shown = F.array_intersect("tokens", names)
    marked = labelled.select(F.when(F.col("verdict") == "block", F.array_append(shown, F.lit("=block"))).otherwise(shown).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(least, 1.0), minConfidence=settings.min_confidence).fit(marked)
    found = model.associationRules.filter(F.col("consequent")[0] == "=block").select("antecedent", "confidence", "support").collect() if classes else []
    found = [r for r in found if r[2] * rows >= settings.min_urls - 0.5]
    order = lambda r: (len(r[0]), -r[1], r[0])
    kept: list[tuple[list[str], float, float]] = []
    for items, confidence, support in sorted(((sorted(r[0]), r[1], r[2]) for r in found), key=order):
        if not any(set(k[0]) <= set(items) and k[1] >= confidence for k in kept):
            kept.append((items, confidence, support))
    alike = [(sorted(items), c, s) for names, c, s in kept for items in product(*(classes[x] for x in names))]
    return sorted([r for r in certain if r[1] >= settings.min_confidence] + alike, key=order)


def fitting(rules: list[tuple[list[str], float, float]]) -> Column:
    """Positions of the rules whose combination is among the tokens."""
    every = F.array(*(F.array(*map(F.lit, items)) for items, _, _ in rules))
    return F.array_compact(F.transform(every, lambda items, i: F.when(F.size(F.array_except(items, F.col("tokens"))) == 0, i)))


def proven(rules: list[tuple[list[str], float, float]], held: DataFrame, settings: Settings) -> list[tuple[list[str], float, float, int, int]]:
    """The rules, with the held out urls that each fits and blocks of them, that keep their confidence there."""
    if not rules:
        return []
    hits = held.select(F.explode(fitting(rules)).alias("rule"), "verdict").groupBy("rule").agg(F.count(F.lit(1)).alias("fits"), F.count_if(F.col("verdict") == "block").alias("blocks"))
    seen = {r.rule: (r.fits, r.blocks) for r in hits.collect()}  # a row for each rule at most
    return [(*rule, *seen[i]) for i, rule in enumerate(rules) if i in seen and seen[i][1] >= settings.min_confidence * seen[i][0]]


def learned(labelled: DataFrame, settings: Settings) -> list[tuple[list[str], float, float, int, int]]:
    """(combination, confidence, support, held out urls that it fits, of them blocked) of the rules that are used."""
    if not settings.held_out:
        return [(*r, 0, 0) for r in mine(labelled, settings)]
    draw = F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(settings.held_out))
    return proven(mine(labelled.filter(draw != 0), settings), labelled.filter((draw == 0) & (F.size("tokens") > 0)), settings)


def matches(rules: list[tuple]) -> Column:
    """Whether some rule's combination is among the tokens, by an inverted index."""
    if not rules:
        return F.lit(False)
    rarity: dict[str, int] = defaultdict(int)
    for items, *_ in rules:
        for x in items:
            rarity[x] += 1
    index: dict[str, list[list[str]]] = defaultdict(list)
    for items, *_ in rules:
        index[min(items, key=lambda x: (rarity[x], x))].append(items)
    entries = [x for token in sorted(index) for x in (F.lit(token), F.array(*(F.array(*map(F.lit, items)) for items in index[token])))]
    postings = F.create_map(*entries)
    return F.exists("tokens", lambda t: F.coalesce(F.exists(F.try_element_at(postings, t), lambda items: F.size(F.array_except(items, F.col("tokens"))) == 0), F.lit(False)))


def read(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, listed, tokens."""
    url = F.col("url")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    split = own.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    return split.withColumn("listed", listed(rules)).withColumn("tokens", tokens(url, F.col("host"), F.col("path")))


def labels_of(judged: DataFrame) -> DataFrame:
    return judged.filter("listed IS NOT NULL").select("url", "tokens", F.col("listed.verdict").alias("verdict"))


def judge(pages: DataFrame, rules=RULES, settings: Settings = Settings(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, by ('list' or 'mined')."""
    judged = read(pages, rules, id_col, url_col)
    mined = F.when(matches(learned(labels_of(judged), settings)), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce(F.col("listed.verdict"), mined).alias("verdict"),
        F.when(F.col("listed").isNull(), "mined").otherwise("list").alias("by"),
    )
