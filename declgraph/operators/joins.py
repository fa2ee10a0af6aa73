"""Joins with the engine's own conditions, as equality joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import null_safe


def presence_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and ``presence``: missing (left alone), extra (right alone) or both."""
    a = left.select(*keys).withColumn("__a", F.lit(True)).withColumn("__b", F.lit(False))
    b = right.select(*keys).withColumn("__a", F.lit(False)).withColumn("__b", F.lit(True))
    sides = a.unionByName(b).groupBy(*keys).agg(F.bool_or("__a").alias("__a"), F.bool_or("__b").alias("__b"))  # null is a key, too
    presence = F.when(~F.col("__b"), "missing").when(~F.col("__a"), "extra").otherwise("both")
    return sides.select(*keys, presence.alias("presence"))


def tree_diff(left: DataFrame, right: DataFrame, key: str, content: str) -> DataFrame:
    """key and ``state``: missing, extra, identical, reordered (equal lines in another order) or changed.

    Digests are compared, so that contents don't cross the network.
    """
    def digests(df: DataFrame, tag: str) -> DataFrame:
        lines = F.array_join(F.array_sort(F.split(F.coalesce(content, F.lit("")), "\n")), "\n")
        return df.select(key, F.md5(F.coalesce(content, F.lit(""))).alias(f"__{tag}"), F.md5(lines).alias(f"__{tag}s"))

    state = (
        F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a") == F.col("__b"), "identical")
        .when(F.col("__as") == F.col("__bs"), "reordered").otherwise("changed")
    )
    return null_safe(digests(left, "a"), digests(right, "b"), [key], "full_outer").select(key, state.alias("state"))


def topic_regex(pattern: str) -> str:
    """AMQP pattern -> regular expression: * is one word, # any number of words."""
    every = pattern.split(".")
    words = [w for k, w in enumerate(every) if not (w == "#" and k and every[k - 1] == "#")]
    if words == ["#"]:
        return "^.*$"
    out = ""
    for k, word in enumerate(words):
        one = r"[^.]+" if word == "*" else "".join("\\" + c if not c.isalnum() else c for c in word)
        if word == "#":
            out += r"(?:\.[^.]+)*" if k else r"(?:[^.]+\.)*"
        elif k and not (k == 1 and words[0] == "#"):
            out += r"\." + one
        else:
            out += one
    return f"^{out}$"


def pattern_join(topics: DataFrame, topic: str, patterns: Sequence[str]) -> DataFrame:
    """Each row with each pattern that its topic fits. Patterns are a short list: one expression, no join."""
    fits = F.array(*(F.when(F.col(topic).rlike(topic_regex(p)), F.lit(p)) for p in patterns))
    return topics.withColumn("pattern", F.explode(F.filter(fits, lambda p: p.isNotNull())))


def prefixes(text: Column, separator: str) -> Column:
    """All prefixes that end before a separator, and the text itself, longest first."""
    parts = F.split(text, "\\" + separator)
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def prefix_join(df: DataFrame, text: str, table: DataFrame, prefix: str, separator: str = ".") -> DataFrame:
    """Each row with the row of the table whose prefix is the longest of its text; null if there's none.

    Prefixes are exploded and joined by equality; the longest wins in an
    aggregation on a row's text, so rows of equal text are decided once.
    """
    texts = df.select(text).distinct()
    tried = texts.select(text, F.posexplode(prefixes(F.col(text), separator)).alias("__at", "__prefix"))
    hits = tried.join(table, F.col("__prefix") == F.col(prefix))
    best = hits.groupBy(text).agg(F.min_by(F.struct(*table.columns), "__at").alias("__row")).select(F.col(text).alias("__text"), "__row.*")
    return df.join(best, F.col(text).eqNullSafe(F.col("__text")), "left").drop("__text")


def one_removed(text: Column) -> Column:
    """The text and what remains when one character is taken out."""
    n = F.length(text)
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n))), text))


def similarity_join(names: DataFrame, name: str, most: int = 2) -> DataFrame:
    """Pairs (a, b, distance) of different names, a < b, of at most ``most`` (1 or 2) edits.

    Names that differ in so few edits share a form with at most that many
    characters taken out; the forms are joined by equality and the pairs verified.
    """
    if most not in (1, 2):
        raise ValueError("most is 1 or 2")
    forms = names.select(F.col(name).alias("a")).filter("a IS NOT NULL").distinct().select("a", F.explode(one_removed(F.col("a"))).alias("form"))
    if most == 2:
        forms = forms.select("a", F.explode(one_removed(F.col("form"))).alias("form")).distinct()
    pairs = forms.join(forms.withColumnRenamed("a", "b"), "form").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= most)


def anti(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of left without partner: dangling references."""
    keys = right.select(*(F.col(r).alias(f"__{r}") for r in on.values())).distinct()
    condition = None
    for a, b in on.items():
        one = F.col(a) == F.col(f"__{b}")
        condition = one if condition is None else condition & one
    return left.join(keys, condition, "left_anti")
