"""Cutting lineage: a table is written to the shared folder and read back, so what follows sees the same rows each time."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder (``spark.checkpoint.dir``); a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="takeline-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` from the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
