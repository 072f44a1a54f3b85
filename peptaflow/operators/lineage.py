"""Fixing an intermediate result once, so that later steps neither recompute nor re-plan it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir`` (a temporary one only in local mode).

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` files go once nothing refers to them."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="peptaflow-"))
    return df.checkpoint(eager=True)
