"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """The table as it is now, written to spark.checkpoint.dir: read several times, computed once, and a wall that
    predicates aren't pushed through.  Only a local master may fall back on a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The table by key in four partitions a core, but no more than the session's number, before work in Python that takes
    long for few bytes: the planner puts partitions together by their bytes, which leaves cores idle, unless their number
    is given."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(most, 4 * spark.sparkContext.defaultParallelism)), *key)
