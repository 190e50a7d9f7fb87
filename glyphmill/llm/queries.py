"""Queries of this subpackage, over the tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    from glyphmill.plans import spread

    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import copies

    return copies.p1_found(_t(spark, d, "parse_entries"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import copies

    return copies.collapse(_t(spark, d, "parse_entries"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import langid

    return langid.p2_found(_t(spark, d, "parse_entries"), _t(spark, d, "languages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import sentences

    return sentences.p3_found(_t(spark, d, "parse_entries"))


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import sentences

    return sentences.sentences(_t(spark, d, "parse_entries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import mojibake

    return mojibake.p4_found(_t(spark, d, "parse_entries"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import mojibake

    return mojibake.garbled(_t(spark, d, "parse_entries")).select("entry_id", "chain", "posterior", "repaired")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import terms

    return terms.p5_found(_t(spark, d, "parse_entries"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import terms

    return terms.p5_terms(_t(spark, d, "parse_entries"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import terms

    return terms.value_counts(_t(spark, d, "parse_entries"))


def p5_marked_values(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import terms

    return terms.p5_marked_values(_t(spark, d, "parse_entries"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import lookalikes

    return lookalikes.p6_found(_t(spark, d, "parse_entries"))


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import lookalikes

    return lookalikes.canonical_texts(_t(spark, d, "parse_entries"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import tokens

    return tokens.p7_ids(_t(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import leaks

    return leaks.p8_found(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import spans

    return spans.p9_found(_t(spark, d, "documents"))


def p9_shared_amount(spark: SparkSession, d: str) -> DataFrame:
    from glyphmill.llm import spans

    return spans.shared_amount(_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_sentences": p3_sentences,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p5_terms": p5_terms,
    "p5_values": p5_values,
    "p5_marked_values": p5_marked_values,
    "p6_found": p6_found,
    "p6_canonical": p6_canonical,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_shared_amount": p9_shared_amount,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from glyphmill.llm.sql import SQL

    return dict(SQL)
