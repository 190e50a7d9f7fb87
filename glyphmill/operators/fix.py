"""Fix rules: an ordered pipeline of projections with a label for every step that changed the value.

Steps are chained as columns, never nested, so the plan grows with the number of
steps and not with their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import fixed as K
from glyphmill.functions.text import AFTER, BEFORE, looks_like_sentence, rebuild, strip, whole_words
from glyphmill.operators.casing import sentence_case
from glyphmill.operators.detect import MISSING_SPACE, NUMBER_OF, SENTENCE_START, SMALL_START, Context, passive_pattern

Step = Callable[[Column, Context], Column]


def trim(v: Column, c: Context) -> Column:
    return strip(v)


def no_of(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, f"No\\.{K.WS}*Of{AFTER}", "No. of")


def number_of(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, NUMBER_OF, "number of")


def passive(v: Column, c: Context) -> Column:
    for aux, noun, verb in K.PASSIVE:
        v = F.regexp_replace(v, passive_pattern(aux, noun), f"$1 {verb}")
    return v


def identifier(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, f"{BEFORE}([A-Za-z]*[a-z])ID{AFTER}", "$1 ID")


def double_space(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, " {2,}", " ")


def missing_space(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, MISSING_SPACE, "$0 ")


def comma_case(v: Column, c: Context) -> Column:
    # one alternation over the words, found by their capital; the run of space becomes one space
    words = "|".join(w.capitalize() for w in K.CONTINUATIONS)
    pattern = f",{K.WS}+(?:{words}){AFTER}"
    return F.when(v.rlike(pattern), rebuild(v, pattern, lambda t: F.concat(F.lit(", "), F.lower(F.regexp_extract(t, "[A-Za-z]+$", 0))))).otherwise(v)


def space_before_stop(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, f"{K.WS}+([,.])", "$1")


def space_before_mark(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, f"{K.WS}+([!?;:])", "$1")


def repeated_mark(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, r"([!?])\1+", "$1")


def double_period(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, r"(?<!\.)\.\.(?!\.)", ".")


def comma_splice(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, f"(?s)^(.*?),({K.WS}+(?:{K.AUXILIARIES}){AFTER}[^.!?]*\\?)", "$1.$2")


def fail_to(v: Column, c: Context) -> Column:
    return F.regexp_replace(v, f"(^|[.!?]{K.WS}+)([Ff])ail({K.WS}+to{AFTER})", "$1$2ailed$3")


def capitalize(v: Column, c: Context) -> Column:
    def change(t: Column) -> Column:
        word = F.regexp_extract(t, "[A-Za-z][A-Za-z0-9']*$", 0)
        able = word.rlike("^[a-z]")
        if c.mixed:
            able = able & ~word.isin(list(c.mixed))
        head = F.substring(t, F.lit(1), F.length(t) - F.length(word))
        return F.when(able, F.concat(head, F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000))).otherwise(t)

    later = rebuild(v, SENTENCE_START, lambda t: F.when(t.rlike("^[A-Za-z]"), t).otherwise(change(t)))
    return F.when(~v.rlike(SMALL_START), v).when(looks_like_sentence(v), rebuild(v, SENTENCE_START, change)).otherwise(later)


def casing(v: Column, c: Context) -> Column:
    return sentence_case(v, c.glossary, c.custom)


def glossary(v: Column, c: Context) -> Column:
    if not c.glossary:
        return v
    canon = F.create_map(*[F.lit(x) for pair in c.glossary for x in pair])
    pattern = whole_words([w for w, _ in c.glossary])
    return F.when(v.rlike(pattern), rebuild(v, pattern, lambda t: F.coalesce(F.try_element_at(canon, F.lower(t)), t))).otherwise(v)


#: (id, label, step) in the order that is part of their meaning.
STEPS: tuple[tuple[str, str, Step], ...] = (
    ("f01_trim", K.L_TRIM, trim),
    ("f02_no_of", K.L_NO_OF, no_of),
    ("f03_number_of", K.L_NUMBER_OF, number_of),
    ("f04_passive", K.L_PASSIVE, passive),
    ("f05_identifier", K.L_ID, identifier),
    ("f06_double_space", K.L_DOUBLE_SPACE, double_space),
    ("f07_missing_space", K.L_MISSING_SPACE, missing_space),
    ("f08_comma_case", K.L_COMMA, comma_case),
    ("f09_space_before_stop", K.L_SPACE_BEFORE, space_before_stop),
    ("f10_space_before_mark", K.L_SPACE_BEFORE, space_before_mark),
    ("f11_repeated_mark", K.L_REPEATED, repeated_mark),
    ("f12_double_period", K.L_DOUBLE_PERIOD, double_period),
    ("f13_comma_splice", K.L_SPLICE, comma_splice),
    ("f14_fail_to", K.L_FAIL, fail_to),
    ("f15_capitalize", K.L_START, capitalize),
    ("f16_sentence_case", K.L_CASING, casing),
    ("f17_glossary", K.L_GLOSSARY, glossary),
)
STEP_BY_ID = {i: s for i, _, s in STEPS}


def fix(df: DataFrame, value: str = "value", context: Context = Context()) -> DataFrame:
    """Add ``fixed`` and ``labels``: the value after all steps, and the labels of the steps that changed it."""
    out = df.withColumn("_v0", F.col(value))
    for i, (_, _, step) in enumerate(STEPS, 1):
        out = out.withColumn(f"_v{i}", step(F.col(f"_v{i - 1}"), context))
    labels = F.array(*[F.when(F.col(f"_v{i}") != F.col(f"_v{i - 1}"), F.lit(label)) for i, (_, label, _) in enumerate(STEPS, 1)])
    out = out.withColumn("labels", F.filter(labels, lambda x: x.isNotNull())).withColumn("fixed", F.col(f"_v{len(STEPS)}"))
    return out.drop(*[f"_v{i}" for i in range(len(STEPS) + 1)])


def step_changes(df: DataFrame, step_id: str, id_col: str = "entry_id", value: str = "value", context: Context = Context()) -> DataFrame:
    """``(id_col, after)`` of the values that one step alone changes."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(id_col), F.col(value).alias("_before"), STEP_BY_ID[step_id](F.col(value), context).alias("after"))
    return rows.where("_before <> after").drop("_before")
