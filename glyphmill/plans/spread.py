"""Work for all cores on inputs that come in few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows in at least as many partitions as the session has cores.

    A small file is one split, and a pass that computes much for each row would run on
    one core.  Inputs of enough splits, that is all large ones, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
