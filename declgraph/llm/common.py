"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import checkpoint_folder, staged

__all__ = ["batches_of", "checkpoint_folder", "keep_rows", "map_rows", "read_table", "small_batches", "staged"]

#: Rows per Arrow batch; a batch of documents then stays in the megabytes.
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Text columns reach Python in batches of at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside, on short rows, reaches Python in batches of so many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_rows(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Apply function(columns as Python lists) -> list of columns, batch by batch."""
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            if types is None:
                types = arrow_types(schema)
            columns = function(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}


def arrow_types(schema: str) -> list[pa.DataType]:
    return [ARROW[part.split()[1]] for part in schema.split(",")]


def keep_rows(df: DataFrame, text: str, decide: Callable[[list], list[bool]]) -> DataFrame:
    """The rows whose text decide() keeps; all columns and their types stay."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(at).to_pylist()), pa.bool_()))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
