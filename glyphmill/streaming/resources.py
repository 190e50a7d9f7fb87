"""Structured Streaming over resource lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphmill.operators.detect import Context
from glyphmill.operators.report import differences
from glyphmill.sources.resources import entries


def stream_entries(spark: SparkSession, path: str, schema: str = "file string, line int, raw string") -> DataFrame:
    """Entries of a folder of Parquet tables of raw lines, as they arrive."""
    return entries(spark.readStream.schema(schema).parquet(path))


def stream_differences(stream: DataFrame, context: Context = Context()) -> DataFrame:
    """Fixes of a stream of entries; no state."""
    return differences(stream, context)


def stream_duplicates(stream: DataFrame) -> DataFrame:
    """Entries whose key their file has given before, in order of arrival; state is one line number per key."""

    def later(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        first = state.get[0] if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values("line")
            if first is None and len(pdf):
                first = int(pdf["line"].iloc[0])
                pdf = pdf.iloc[1:]
            if len(pdf):
                yield pd.DataFrame({"file": pdf["file"], "line": pdf["line"], "key": pdf["key"], "first_seen_line": first})
        if first is not None:
            state.update((first,))

    return stream.groupBy("file", "key").applyInPandasWithState(later, "file string, line int, key string, first_seen_line int", "first int", "append", GroupStateTimeout.NoTimeout)
