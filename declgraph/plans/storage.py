"""Cutting lineage: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder of this machine;
    elsewhere the setting has to exist, since executors don't share local disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
