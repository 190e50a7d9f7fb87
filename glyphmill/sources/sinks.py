"""Sinks: reports as CSV, rewritten resource files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import fixed as K
from glyphmill.operators.detect import Context
from glyphmill.operators.report import fix_all
from glyphmill.sources.resources import line_parts


def output_name(file: Column, ending: str = ".FIXED.js") -> Column:
    """Name of an output beside its file: the last extension replaced."""
    return F.concat(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit(ending))


def rewritten_lines(lines: DataFrame, context: Context = Context(), spelling: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(file, line, text)``: entries with their fixed value in the normal layout, other lines as they stand.

    With ``spelling``, all files are taken as English.
    """
    parts = fix_all(line_parts(lines).withColumn("_id", F.concat_ws("\n", "file", "line")), "value", context, spelling, "_id")
    semi = F.when(F.coalesce(F.regexp_replace("semi", r"\s", ""), F.lit("")) == "", F.lit(";")).otherwise(F.col("semi"))
    entry = F.concat("indent", F.lit(K.PREFIX), "key", F.lit(' = "'), "fixed", F.lit('"'), semi, "trail")
    return parts.select("file", "line", F.when(F.col("is_entry"), entry).otherwise(F.col("raw")).alias("text"))


def write_rewritten(lines: DataFrame, path: str, context: Context = Context(), spelling: tuple[DataFrame, DataFrame] | None = None) -> None:
    """Write the fixed files below ``path``, a folder for each file, lines in order; a file is split nowhere."""
    out = rewritten_lines(lines, context, spelling).withColumn("name", output_name(F.col("file")))
    out.repartition("name").sortWithinPartitions("name", "line").select("name", F.col("text").alias("value")).write.mode("error").partitionBy("name").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each sheet."""
    for name, sheet in sheets.items():
        write_csv(sheet, f"{path}/{name}")
