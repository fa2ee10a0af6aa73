"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in order of their names share all words by weight; a
target stops at ``most`` times its source's size, and the excess is shared
again by weight among the others (solved at once, by the level that fills all).

Words are dealt in blocks of about ``block`` words. Sainte-Laguë gives the
blocks to the sources by their targets, highest quotient first: the whole
part is given at once and only the last few seats are contested. A source's
blocks are apportioned likewise to its shards, hashed groups of about
``shard`` words, by their sizes. Within a shard the documents lie in a seeded
order on one line of equal blocks; its quota takes all blocks as often as
they go into it, and the rest from a seeded block on, cyclically.

Only DataFrame operations. What is dealt out are ids and sizes, never texts;
a large source is many shards. The sums per source and per shard are
pre-aggregated.

Defined cases: a null or empty text has size 0 and takes 0; a null source is
a source, the last; all sizes 0 give targets 0; repeated rows and equal ids
are separate documents, those of equal size of equal place in the order; documents
without doc_id are dealt out by their sizes; an empty table gives an empty
result; other columns are ignored in ``mix`` and kept in ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Parts of a document are counted in units of a PARTS-th; those of about SETTLED shards are settled together.
PARTS, SETTLED = 1 << 20, 200
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (1, 2, 3)  #: of the sources in order, repeating
    most: int = 3  #: times its size that a source or document may be taken
    block: int = 64  #: words
    shard: int = 100_000  #: words
    seed: str = "mix"


def word_count(text: str) -> Column:
    """Words of a text; a separator for each, so no array is built."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORDS, "\u0001")
    return F.length(F.translate(spaced, " \t\n\x0b\x0c\r", "")).cast("long")


def hashed(*parts) -> Column:
    """The first 60 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def own(doc_id: str, size: str) -> list[Column]:
    """What tells a document from others in a hash."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(size).cast("string")]


def targets(sizes: DataFrame, settings: Settings) -> DataFrame:
    """source, source_size -> also weight and target; a row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(settings.weights)
    weight = F.element_at(F.array(*map(F.lit, settings.weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    ranked = sizes.select("*", weight.cast("long").alias("weight")).withColumn("ratio", F.col("source_size") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    most = settings.most
    filled = (
        ranked.withColumn("full", F.coalesce(F.sum("source_size").over(fill), F.lit(0)) * most)
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        # up to this source all below are full: is it, too?
        .withColumn("capped", F.col("source_size") * most * F.col("open") <= (F.col("total") - F.col("full")) * F.col("weight"))
        .withColumn("left", F.min(F.when(~F.col("capped"), F.struct("ratio", F.col("total") - F.col("full"), "open"))).over(everything))
    )
    level = (F.col("left.col2") * F.col("weight")).cast("double") / F.col("left.open").cast("double")
    target = F.when(F.col("capped") | F.col("left").isNull(), (F.col("source_size") * most).cast("double")).otherwise(level)
    return filled.select("source", "source_size", "weight", target.alias("target"))


def seats(votes: DataFrame, of: list[str], by: str, number: Column, name: str) -> DataFrame:
    """Sainte-Laguë: number seats within each group ``of``, by the column ``by``.

    With S contenders, v votes of V and N seats, everyone has at least the seats
    of the divisor V/(N - S/2), at most one more than those of V/(N + S/2). Only
    the quotients v/(2k + 1) between are compared: about three for a contender.
    """
    group = Window.partitionBy(*of)
    known = votes.columns
    own = F.col(by).cast("double")
    at = lambda n: F.ceil(own * n / F.col("__all") - 0.5).cast("long")
    half = F.col("__n") / 2
    first = (
        votes.withColumn("__seats", number)
        .withColumn("__all", F.sum(own).over(group))
        .withColumn("__n", F.count(F.when(own > 0, 1)).over(group))
        .withColumn("__sure", F.when((own > 0) & (F.col("__seats") > half), F.greatest(at(F.col("__seats") - half) - 1, F.lit(0))).otherwise(0).cast("long"))
        .withColumn("__open", F.col("__seats") - F.sum("__sure").over(group))
    )
    more = (F.greatest(at(F.col("__seats") + half), F.lit(0)) + 1 - F.col("__sure")).cast("int")
    tried = first.filter(own > 0).select("*", F.explode(F.sequence(F.lit(0), more)).alias("__k"))
    quotient = F.col(by).cast("double") / (2 * (F.col("__sure") + F.col("__k")) + 1)
    best = Window.partitionBy(*of).orderBy(F.desc("__q"), *(F.col(c).asc_nulls_last() for c in known))
    won = tried.withColumn("__q", quotient).withColumn("__r", F.row_number().over(best)).filter("__r <= __open")
    gained = won.groupBy(*known, "__sure").agg(F.count(F.lit(1)).alias("__more"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in known]
    matched = first.alias("a").join(gained.alias("b"), same, "left")
    return matched.select(*(F.col(f"a.{c}") for c in known), (F.col("a.__sure") + F.coalesce("b.__more", F.lit(0))).alias(name))


def mix(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: a row per document."""
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), settings)
    total = F.sum("source_size").over(Window.partitionBy())
    blocks = F.round(total / settings.block).cast("long")
    quotas = seats(sources.withColumn("__total", blocks), [], "target", F.col("__total"), "blocks").drop("__total", "weight")
    quotas = staged(quotas.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / settings.shard), F.lit(1)).cast("long")))
    placed = sized.alias("d").join(quotas.alias("q"), F.expr("d.source <=> q.source")).select(
        "d.doc_id", "d.source", "d.size", "q.source_size", "q.target", "q.blocks", F.pmod(hashed(F.lit(settings.seed), F.lit("shard"), *own("d.doc_id", "d.size")), "q.shards").alias("shard")
    )
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"))
    shards = seats(shards, ["source"], "shard_size", F.col("blocks"), "quota").drop("blocks")
    last = Window.partitionBy("source", "shard").orderBy("__at", "doc_id", "size")
    laid = placed.withColumn("__at", F.md5(F.concat_ws("|", F.lit(settings.seed), *own("doc_id", "size"))))
    laid = laid.withColumn("stop", F.sum("size").over(last.rowsBetween(Window.unboundedPreceding, 0)))
    both = laid.alias("d").join(shards.alias("s"), F.expr("d.source <=> s.source AND d.shard = s.shard"))
    # the shard's line of m equal blocks; from block k on, the quota's rest
    m = F.greatest(F.round(F.col("shard_size") / settings.block).cast("long"), F.lit(1))
    row = both.select("d.*", "s.shard_size", F.least(F.col("s.quota"), m * settings.most).alias("quota"), m.alias("m")).withColumn("start", F.col("stop") - F.col("size"))
    row = row.withColumn("k", F.pmod(hashed(F.lit(settings.seed), F.lit("start"), F.coalesce("source", F.lit("")), F.col("shard").cast("string")), "m"))
    row = row.withColumn("rest", F.col("quota") % F.col("m")).withColumn("end", F.col("k") + F.col("rest"))
    row = (
        row.withColumn("low", F.expr("k * shard_size div m"))
        .withColumn("high", F.expr("least(end, m) * shard_size div m"))
        .withColumn("wrap", F.expr("greatest(end - m, 0) * shard_size div m"))
    )
    inside = F.greatest(F.least("stop", "high") - F.greatest("start", "low"), F.lit(0)) + F.greatest(F.least("stop", "wrap") - F.col("start"), F.lit(0))
    taken = F.expr("quota div m") * F.col("size") + inside
    return row.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def mixed(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, with all columns: each as often as its taken words go into its size.

    Selected blocks are contiguous, so only a document at the edge of a shard's
    selection is taken in part. Such parts are settled among those of some hundred
    shards, by size: a document is kept whenever the sum of the parts so far passes the middle
    between two whole numbers, so a source's kept documents come near its
    target however long they are. Documents of equal id and size share their counts.
    """
    plan = mix(docs, settings, id_col, text_col, source_col).filter("taken > 0").groupBy("doc_id", "source", "size")
    plan = plan.agg(F.sum("taken").alias("taken"), F.sum("size").alias("all"), F.max("source_size").alias("source_size"))
    plan = plan.select("*", F.expr("taken div all").alias("whole"), F.expr(f"(taken % all) * {PARTS} div all").alias("part"))
    groups = F.greatest(F.ceil(F.col("source_size") / (SETTLED * settings.shard)), F.lit(1)).cast("long")
    edges = plan.filter("part > 0").withColumn("group", F.pmod(hashed(F.lit(settings.seed), F.lit("group"), *own("doc_id", "size")), groups))
    order = Window.partitionBy("source", "group").orderBy(F.desc("size"), F.md5(F.concat_ws("|", F.lit(settings.seed), F.lit("part"), *own("doc_id", "size"))), "doc_id")
    edges = edges.withColumn("end", F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, 0)) + PARTS // 2)
    edges = edges.withColumn("times", F.expr(f"whole + end div {PARTS} - (end - part) div {PARTS}"))
    plan = plan.filter("part = 0").withColumn("times", F.col("whole")).select("doc_id", "source", "size", "times").unionByName(edges.select("doc_id", "source", "size", "times"))
    plan = plan.filter("times > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("times").cast("int").alias("__times"))
    sized = docs.withColumn("__words", word_count(text_col))
    joined = sized.join(plan, sized[id_col].eqNullSafe(F.col("__id")) & sized[source_col].eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*(docs[c] for c in docs.columns))
