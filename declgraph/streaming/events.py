"""Event windows, for batches and for streams, and delta output.

The same functions serve both: a stream needs a watermark, which a batch
ignores. Event time is a timestamp with zone in streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(events: DataFrame, length: str, *keys: str, ts: str = "ts") -> DataFrame:
    counted = events.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, length: str, step: str, *keys: str, ts: str = "ts") -> DataFrame:
    counted = events.groupBy(F.window(ts, length, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str, ts: str = "ts") -> DataFrame:
    counted = events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
    return counted.select(F.col("w.start").alias("start"), "last_ts", *keys, "n")


def changes(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """Rows to write (``after`` is new or changed) or to delete: key, content, action."""
    a = before.select(F.col(key), F.sha2(F.coalesce(content, F.lit("")), 256).alias("__was"))
    b = after.select(F.col(key), F.col(content), F.sha2(F.coalesce(content, F.lit("")), 256).alias("__is"))
    action = F.when(F.col("__is").isNull(), "delete").when(F.col("__was").isNull() | (F.col("__was") != F.col("__is")), "write")
    return a.join(b, key, "full_outer").select(key, content, action.alias("action")).filter("action IS NOT NULL")


def write_deltas(stream: DataFrame, current: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], folder: str, key: str, content: str, version: str):
    """For each micro-batch, hand the differences to what is stored to ``apply``; answers the running query.

    Of a key's rows in a batch the one of the highest version counts; one without content is a deletion.
    """

    def batch(rows: DataFrame, number: int) -> None:
        newest = rows.groupBy(key).agg(F.max_by(F.struct(content), version).alias("__r")).select(key, f"__r.{content}")
        before = current().join(newest.select(key), key, "left_semi")
        apply(changes(before, newest.filter(F.col(content).isNotNull()), key, content), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", folder).outputMode("append").start()


def coarsest(paths: DataFrame, path: str = "path") -> DataFrame:
    """What a set of changed files asks for: 3 module set, 2 PHP, 1 configuration, 0 nothing."""
    rank = (
        F.when(F.col(path).rlike(r"(^|/)(app/etc/config\.php|registration\.php|etc/module\.xml|composer\.json)$"), 3)
        .when(F.col(path).endswith(".php"), 2).when(F.col(path).rlike(r"/etc/.*\.xml$"), 1).otherwise(0)
    )
    return paths.agg(F.coalesce(F.max(rank), F.lit(0)).alias("action"))
