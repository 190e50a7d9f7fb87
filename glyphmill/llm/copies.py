"""Problem 1: records that differ only in their formatting.

Two records are copies when their canonical keys and canonical values agree.
A canonical text has its case folded and holds letters, marks and numbers only;
a value made of named fields is the sorted list of its canonical fields.

Plan.  Every row is reduced to ``(id, h1, h2)``, a 128-bit hash of its canonical
form, so no text is shuffled.  Partial counts (combined map-side) find every
canonical key with at least ``hot_rows`` rows exactly.  Hot keys are aggregated in
two levels over a salt and their result is joined back: by a broadcast where there
are at most ``MAX_HOT`` of them (counted), by a shuffle beyond.  All other keys go
through one shuffle on the hash, where no group can reach ``hot_rows`` rows, whatever
the size of the input.  The representative of a group is its smallest identifier.

Defined cases: null keys, null values and values without a letter, mark or
number are left out; empty tables give empty results; a repeated identifier
counts once per row; ties cannot occur because the minimum is unique up to
equal identifiers; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.plans import stage

_NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
#: Rows that make a canonical key hot.
HOT_ROWS = 100
#: Upper bound on the number of hot keys that are broadcast (40 bytes each).
MAX_HOT = 20_000


def fold(c: Column) -> Column:
    """Case folding: upper case of lower case also unites sharp s, final sigma and ligatures."""
    return F.upper(F.lower(c))


def canonical_key(key: Column) -> Column:
    return F.translate(fold(key), "_", "")


def canonical_value(value: Column) -> Column:
    """Canonical form of a value; fields are separated by U+0001, a character that forms never hold."""
    folded = fold(value)
    plain = F.regexp_replace(folded, _NOT_WORD, "")
    fields = F.split(folded, "[;|,]", -1)
    named = F.forall(fields, lambda x: x.contains(":") | x.contains("="))
    listed = F.array_join(F.array_sort(F.transform(fields, lambda x: F.regexp_replace(x, _NOT_WORD, ""))), "\u0001")
    # the cheap tests run first, so that almost all rows never split
    return F.when((value.contains(":") | value.contains("=")) & value.rlike("[;|,]") & named, listed).otherwise(plain)


def canonical_hashes(df: DataFrame, id_col: str, key_col: str, value_col: str) -> DataFrame:
    """``(id, h1, h2)`` of every record that has a canonical form."""
    rows = df.select(
        F.col(id_col).alias("id"),
        canonical_key(F.col(key_col)).alias("k"),
        canonical_value(F.col(value_col)).alias("v"),
    ).where(F.col("k").isNotNull() & F.col("v").isNotNull() & (F.translate("v", "\u0001", "") != ""))
    return rows.select("id", F.xxhash64("k", "v").alias("h1"), F.xxhash64(F.lit(7), "v", "k").alias("h2"))


def copies(
    df: DataFrame,
    id_col: str = "entry_id",
    key_col: str = "key",
    value_col: str = "value",
    hot_rows: int = HOT_ROWS,
    salts: int = 64,
    max_hot: int = MAX_HOT,
) -> DataFrame:
    """``(id, first_id, n_copies)`` for every record that has a canonical form.

    ``hot_rows`` bounds the rows of a group that one task may see.
    """
    rows = stage(canonical_hashes(df, id_col, key_col, value_col), "canon")
    counted = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    hot = stage(counted.where(F.col("n") >= hot_rows).select("h1", "h2"), "hot")
    n_hot = hot.count()
    if not n_hot:
        return _light(rows)

    def beside(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if n_hot <= max_hot else keys.hint("merge")

    salted = (
        rows.join(beside(hot), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    )
    merged = salted.groupBy("h1", "h2").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n_copies"))
    heavy = rows.join(beside(merged), ["h1", "h2"]).select("id", "first_id", "n_copies")
    return _light(rows.join(beside(hot), ["h1", "h2"], "left_anti")).unionByName(heavy)


def _light(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("h1", "h2")
    return rows.select("id", F.min("id").over(w).alias("first_id"), F.count(F.lit(1)).over(w).alias("n_copies"))


def collapse(df: DataFrame, id_col: str = "entry_id", key_col: str = "key", value_col: str = "value", **kw) -> DataFrame:
    """One record per group of copies with its number of copies, text taken from the representative."""
    first = copies(df, id_col, key_col, value_col, **kw).where("id = first_id").select("first_id", "n_copies").distinct()
    texts = df.select(F.col(id_col).alias("first_id"), F.col(key_col).alias("key"), F.col(value_col).alias("value"))
    return first.join(texts, "first_id").select("first_id", "n_copies", "key", "value")


def p1_found(df: DataFrame) -> DataFrame:
    return copies(df).where("id > first_id").select("first_id", F.col("id").alias("entry_id"))
