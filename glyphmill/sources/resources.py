"""Resource files: scans, the line grammar, language of a file, glossary and word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions import fixed as K
from glyphmill.functions.text import strip

MAX_LANGUAGES = 5_000
# Fixed value: the grammar of a line that is an entry.
LINE = r'(?d)^(\s*)languageResource\.([A-Za-z0-9_]+)\s*=\s*"((?:[^"\\]|\\.)*)"(\s*;)?(\s*(?://.*)?)\r?$'


def read_resources(spark: SparkSession, path: str, pattern: str = "*.js") -> DataFrame:
    """``(file, line, raw)`` of every physical line of the files below ``path``.

    A file is one row of the scan, so line numbers are exact; lines end at a line
    feed, a carriage return or both, and a byte order mark stays in line 1.
    """
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    lines = files.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n", -1)).alias("pos", "raw"), "value")
    # what follows the last line end is a line only if it holds something
    whole = lines.where(~((F.col("raw") == "") & (F.col("pos") == F.size(F.split("value", r"\r\n|\r|\n", -1)) - 1)))
    return whole.select("file", (F.col("pos") + 1).alias("line"), "raw")


def line_parts(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``indent, key, value, semi, trail`` and ``is_entry`` by the line grammar."""
    hit = F.col(raw).rlike(LINE)
    out = lines.withColumn("is_entry", F.coalesce(hit, F.lit(False)))
    for i, name in enumerate(("indent", "key", "value", "semi", "trail"), 1):
        out = out.withColumn(name, F.when(hit, F.regexp_extract(raw, LINE, i)))
    return out


def entries(lines: DataFrame) -> DataFrame:
    """``(file, line, key, value)`` of the lines that are entries."""
    return line_parts(lines).where("is_entry").select("file", "line", "key", "value")


def language_code(file: Column, codes: list[str] | None = None) -> Column:
    """First token of a file name that is a language code, else ``unknown``."""
    known = codes if codes is not None else list(K.LANGUAGES)
    tokens = F.split(F.regexp_replace(F.lower(file), r"\.js$", ""), r"[_.\-]")
    return F.coalesce(F.get(F.filter(tokens, lambda t: t.isin(known)), 0), F.lit("unknown"))


def detect_language(files: DataFrame, languages: DataFrame | None = None, override: str | None = None) -> DataFrame:
    """Add ``lang_code, lang_name, detection``; an override that is no known code names itself."""
    if languages is None:
        names = dict(K.LANGUAGES)
    else:
        rows = languages.select("code", "name").where("code is not null").limit(MAX_LANGUAGES + 1).collect()
        if len(rows) > MAX_LANGUAGES:
            raise ValueError(f"at most {MAX_LANGUAGES} languages")
        names = {r.code: r.name for r in rows}
    code = F.lit(override) if override else language_code(F.col("file"), sorted(names))
    name = F.lit(None).cast("string")
    for c, n in sorted(names.items()):
        name = F.when(code == c, F.lit(n)).otherwise(name) if override is None else F.lit(names.get(override, override))
    how = F.lit("manual") if override else F.when(code == "unknown", "unknown").otherwise("filename")
    return files.withColumn("lang_code", code).withColumn("lang_name", F.coalesce(name, F.lit("Unknown"))).withColumn("detection", how)


def glossary_pairs(glossary: DataFrame | dict[str, str] | None = None, limit: int = 5000) -> list[tuple[str, str]]:
    """Ordered (wrong, canonical) pairs: built-in pairs first, overlaid by the given ones; keys in lower case."""
    merged = dict(K.GLOSSARY)
    if isinstance(glossary, DataFrame):
        rows = glossary.select("ord", "wrong", "canon").orderBy("ord").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"a glossary may have at most {limit} entries")
        merged.update({r.wrong.lower(): r.canon for r in rows if r.wrong and r.canon})
    elif glossary:
        merged.update({k.lower(): v for k, v in glossary.items()})
    return list(merged.items())


def read_glossary(spark: SparkSession, path: str) -> dict[str, str]:
    """Glossary of a JSON file with one object of strings."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m")).first()
    return dict(parsed.m or {}) if parsed else {}


def word_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(word, original)`` of a word list: comments and blank lines dropped, lower case."""
    w = strip(F.col(column))
    return lines.select(w.alias("original")).where((F.col("original") != "") & ~F.col("original").startswith("#")).select(F.lower("original").alias("word"), "original").distinct()


def fuzzy_words(words: DataFrame) -> DataFrame:
    """Words long enough to be compared by edit distance."""
    return words.where(F.length("word") >= 4).select("word").distinct()


def mixed_case_words(words: DataFrame) -> DataFrame:
    """Words in their own spelling that are neither all lower nor all upper case."""
    return words.where((F.col("original") != F.lower("original")) & (F.col("original") != F.upper("original"))).select(F.col("original").alias("word")).distinct()
