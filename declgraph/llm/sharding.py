"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table. The
shards take turns; in its turn a shard claims the first free slot of its
permutation. The table gives each shard as many slots as any other, to within
one, and few slots move when a shard comes or goes. A row's slot is a hash of
its key modulo the table's size, so placement is one lookup in the table,
which is broadcast: its size is fixed by the settings.

The table is made once on the driver; rows are placed by DataFrame operations
alone.

Defined cases: a null key hashes as an empty one; equal keys share a shard;
a null text has 0 bytes; an empty table gives an empty result; other columns
are ignored in ``place`` and kept in ``sharded``, but for older ones of the names
__slot and __shard, which are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    shards: int = 61
    slots: int = 6571  #: a prime of at least a hundred times the shards

    def __post_init__(self) -> None:
        if self.slots <= self.shards or any(self.slots % k == 0 for k in range(2, int(self.slots**0.5) + 1)):
            raise ValueError("slots is a prime above the number of shards")


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def table(names: list[str], slots: int) -> list[int]:
    """Which of the names each slot belongs to."""
    walks = [(number(f"{n}|offset") % slots, number(f"{n}|skip") % (slots - 1) + 1) for n in names]
    owner, turn, left = [-1] * slots, [0] * len(names), slots
    while left:
        for i, (offset, skip) in enumerate(walks):
            if not left:
                break
            slot = (offset + turn[i] * skip) % slots
            while owner[slot] >= 0:
                turn[i] += 1
                slot = (offset + turn[i] * skip) % slots
            owner[slot] = i
            turn[i] += 1
            left -= 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))


def lookup(docs: DataFrame, settings: Settings, names: list[str] | None) -> DataFrame:
    names = names or [f"shard-{i:04d}" for i in range(settings.shards)]
    rows = list(enumerate(table(names, settings.slots)))
    return docs.sparkSession.createDataFrame(rows, "__slot long, __shard int")


def sharded(docs: DataFrame, settings: Settings = Settings(), names: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The documents with __slot and __shard."""
    keyed = docs.drop("__slot", "__shard").withColumn("__key", slot_of(F.col(id_col), settings.slots))
    found = lookup(docs, settings, names)
    return keyed.join(F.broadcast(found), keyed["__key"] == found["__slot"]).drop("__key")


def place(docs: DataFrame, settings: Settings = Settings(), names: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, slot, shard, n_bytes."""
    placed = sharded(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes")), settings, names, "doc_id")
    return placed.select("doc_id", F.col("__slot").alias("slot"), F.col("__shard").alias("shard"), "n_bytes")


#: Bytes of text that go into a file of a shard, about.
FILE_BYTES = 256 << 20


def write(docs: DataFrame, path: str, settings: Settings = Settings(), files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write a folder __shard=... for each shard, of up to ``files`` files, so that no task writes a whole shard.

    Without a number, files hold about FILE_BYTES of text if the shards are even. Rows of a shard are dealt out by
    their key and text, so those of a frequent key, too, go to all its files.
    """
    if files is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        files = max(1, -(-total // (settings.shards * FILE_BYTES)))
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(files))
    sharded(docs, settings, id_col=id_col).drop("__slot").repartition("__shard", part).write.partitionBy("__shard").parquet(path)
