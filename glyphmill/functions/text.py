"""String functions as Catalyst expressions.

Regular expressions keep to classes that mean the same here and in RE2: white
space is the Unicode property, a word character is a letter, number or underscore.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import fixed as K

BEFORE, AFTER = f"(?<!{K.WORD})", f"(?!{K.WORD})"


def quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def whole_words(alternatives: list[str]) -> str:
    """Case-insensitive pattern of whole words, alternatives in the given order."""
    return f"(?iu){BEFORE}(?:{'|'.join(map(quote, alternatives))}){AFTER}"


def strip(v: Column) -> Column:
    return F.regexp_replace(v, f"^{K.WS}+|{K.WS}+$", "")


def words_of(v: Column) -> Column:
    """Parts between white space, without empty ones."""
    return F.filter(F.split(v, f"{K.WS}+", -1), lambda x: x != "")


def letters_of(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, "[^A-Za-z]", ""))


def is_upper(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def is_lower(w: Column) -> Column:
    return (w == F.lower(w)) & (w != F.upper(w))


def initial_upper(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))


def rebuild(v: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``change`` of it."""
    between = F.split(v, pattern, -1)
    found = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def spans(v: Column, pattern: str) -> Column:
    """Array of ``(st, en, txt)`` of every match, 0-based and half-open."""
    found, between = F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), F.split(v, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, txt: F.struct(F.length(gap).alias("gap"), txt.alias("txt")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<st:int,en:int,txt:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        st = acc["at"] + x["gap"]
        en = st + F.length(x["txt"])
        return F.struct(en.alias("at"), F.concat(acc["out"], F.array(F.struct(st.alias("st"), en.alias("en"), x["txt"].alias("txt")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def looks_like_sentence(v: Column) -> Column:
    return (F.size(words_of(v)) >= 3) | F.regexp_replace(v, f"{K.WS}+$", "").rlike(r"[.!?:]$")


def match_case(original: Column, suggestion: Column) -> Column:
    """The suggestion in the original's pattern of cases."""
    rest = F.substring(original, 2, 1_000_000)
    head = F.substring(original, 1, 1)
    return (
        F.when(is_upper(original), F.upper(suggestion))
        .when(is_upper(head) & is_lower(rest), F.concat(F.upper(F.substring(suggestion, 1, 1)), F.lower(F.substring(suggestion, 2, 1_000_000))))
        .when(is_lower(original), F.lower(suggestion))
        .otherwise(suggestion)
    )


def only(condition: Column, message: Column | str) -> Column:
    """One-element array of the message where the condition holds, else an empty array."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))
