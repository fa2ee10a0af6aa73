"""Scalar functions, all as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def icontains(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def under(path: Column, prefix: str) -> Column:
    """The path itself or something below it; a prefix ends at a slash."""
    return (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def class_name(raw: Column) -> Column:
    """Without leading backslashes."""
    return F.ltrim(raw, F.lit("\\"))


def sequence_number(prefix: Column, number: Column, suffix: Column | None = None) -> Column:
    """Prefix and at least nine digits; longer numbers stay whole."""
    return F.concat(prefix, F.format_string("%09d", number), suffix if suffix is not None else F.lit(""))


def snake_case(text: Column) -> Column:
    """CamelCase and spaces to lower case with underscores."""
    parted = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(parted, r"[^A-Za-z0-9]+", "_"))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def minutes_between(earlier: Column, later: Column) -> Column:
    """Whole minutes passed, truncated; not the boundaries crossed."""
    return F.timestamp_diff("MINUTE", earlier, later)


def integrity(text: Column) -> Column:
    """Subresource integrity: sha256-<base64>."""
    return F.concat(F.lit("sha256-"), F.base64(F.unhex(F.sha2(text, 256))))


def json_number(props: Column, field: str) -> Column:
    return F.get_json_object(props, f"$.{field}").cast("long")


def scope_fallback(*narrow_to_wide: Column) -> Column:
    """The narrowest scope that states a value."""
    return F.coalesce(*narrow_to_wide)


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def full_name(*parts: Column) -> Column:
    """Parts joined by spaces; missing ones leave no gap."""
    return F.concat_ws(" ", *parts)


def int_or(text: Column, other: int = 0) -> Column:
    """A whole number, or the other value for what isn't one."""
    return F.coalesce(F.trim(text).try_cast("long"), F.lit(other).cast("long"))


def humanized(seconds: Column) -> Column:
    """Seconds, minutes, hours or days, in the largest unit that they fill."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(60), F.lit("m")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h")))
        .otherwise(F.concat(whole(86400), F.lit("d")))
    )


def named_or(name: Column, kind: str, key: Column) -> Column:
    """The name, or kind/key for what has none."""
    return F.coalesce(name, F.concat(F.lit(kind + "/"), key.cast("string")))


def without_suffix(name: Column, *suffixes: str) -> Column:
    """Less the first of the suffixes that it ends in."""
    out = None
    for s in suffixes:
        cut = F.substring(name, F.lit(1), F.length(name) - len(s))
        out = F.when(F.endswith(name, F.lit(s)), cut) if out is None else out.when(F.endswith(name, F.lit(s)), cut)
    return out.otherwise(name)


def class_path(name: Column) -> Column:
    return F.concat(F.translate(class_name(name), "\\_", "//"), F.lit(".php"))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character's place, from 0."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\n]", "")) + 1


def method_parts(reference: Column) -> Column:
    """Class::method as a struct; the method is null if there's none."""
    return F.struct(F.substring_index(reference, "::", 1).alias("class"), F.when(F.contains(reference, F.lit("::")), F.substring_index(reference, "::", -1)).alias("method"))


def normalized_path(path: Column) -> Column:
    """Without . and .. parts; .. at the start stays."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    start = F.array().cast("array<string>")
    folded = F.aggregate(
        parts, start,
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def environment_path(name: Column) -> Column:
    """CONFIG__DEFAULT__A__B as default and a/b; a scope other than default has its code in the next part."""
    parts = F.slice(F.split(F.lower(name), "__"), F.lit(2), F.size(F.split(name, "__")))
    n = F.when(parts[0] == "default", 1).otherwise(2)
    return F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("scope"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("path"))


def distance_within(a: Column, b: Column, most: int) -> Column:
    """Edits between two names, or null if they are more than most."""
    return F.nullif(F.levenshtein(a, b, most), F.lit(-1))
