"""Lineage cuts for plans that use one large result several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows as they are now, from a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; one of our own only in local mode.

    This runs ``df``. What follows is planned over its rows, not over its plan, and lost executors don't lose it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="carafe-checkpoint-"))
    return df.checkpoint()
