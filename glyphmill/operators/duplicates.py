"""Keys defined more than once in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import fixed as K


def first_seen(df: DataFrame, group: tuple[str, ...] = ("file", "key"), order: tuple[str, ...] = ("line", "entry_id")) -> DataFrame:
    """``(group..., first, n)`` of the groups with more than one row.

    A minimum of a struct combines before the shuffle, so a key with very many rows
    costs one row per task; no window over the group is needed.
    """
    rows = df.where(F.col(group[-1]).isNotNull())
    firsts = rows.groupBy(*group).agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n"))
    return firsts.where("n > 1")


def duplicates(df: DataFrame, group: tuple[str, ...] = ("file", "key"), order: tuple[str, ...] = ("line", "entry_id")) -> DataFrame:
    """Every row but the first of its key, with the line where the key was first seen."""
    firsts = first_seen(df, group, order)
    later: Column = F.struct(*order) > F.col("first")
    return df.join(firsts, list(group)).where(later).withColumn("first_seen_line", F.col("first.line")).withColumn("note", F.lit(K.DUPLICATE_NOTE)).drop("first", "n")
