"""Detection rules: every rule is an expression that gives an array of issues.

All rules run on every value, none hides another.  Rules marked ``english`` apply
where the language is English or unknown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import fixed as K
from glyphmill.functions.text import AFTER, BEFORE, letters_of, looks_like_sentence, only, quote, strip, whole_words, words_of
from glyphmill.operators.casing import casing_votes

MISSING_SPACE = r"[.,!?;:](?=[A-Za-z])(?!(?:gif|png|jpe?g|pdf|csv|xlsx?)" + AFTER + ")"
SPLICE = f",{K.WS}+(?:{K.AUXILIARIES}){AFTER}[^.!?]*\\?"
FAIL = f"(?:^|[.!?]{K.WS}+)[Ff]ail{K.WS}+to{AFTER}"
SENTENCE_START = f"(?:^|[.!?]{K.WS}+)[A-Za-z][A-Za-z0-9']*"
#: A sentence that begins with a small letter, as most values have none.
SMALL_START = f"(?:^|[.!?]{K.WS}+)[a-z]"
COMMA_CAPITAL = f",{K.WS}+([A-Z][a-z]+){AFTER}"
NUMBER_OF = f"(?iu){BEFORE}No\\.{K.WS}*of{AFTER}"
IDENTIFIER = f"{BEFORE}[A-Za-z]*[a-z]ID{AFTER}"


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    english: bool
    issues: Callable[[Column, Column, "Context"], Column]


@dataclass(frozen=True)
class Context:
    """What rules need to know besides the value: glossary pairs, custom words, mixed-case words."""

    glossary: tuple[tuple[str, str], ...] = tuple(K.GLOSSARY.items())
    custom: tuple[str, ...] = ()
    mixed: tuple[str, ...] = ()


def passive_pattern(aux: str, noun: str) -> str:
    return f"(?iu){BEFORE}{aux}{K.WS}+{noun}{AFTER}"


def repeated_words(v: Column) -> Column:
    """Adjacent equal words of more than two letters, as messages."""
    w = words_of(v)
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def same(p: Column) -> Column:
        x = letters_of(p["a"])
        return ~p["a"].contains("[") & ~p["b"].contains("[") & (F.length(x) > 2) & (x == letters_of(p["b"]))

    return F.transform(F.filter(pairs, same), lambda p: F.concat(F.lit('Repeated word: "'), p["a"], F.lit(" "), p["b"], F.lit('"')))


def sentence_starts(v: Column, context: Context) -> Column:
    starts = F.regexp_extract_all(v, F.lit(SENTENCE_START), F.lit(0))

    def wrong(t: Column) -> Column:
        word = F.regexp_extract(t, "[A-Za-z][A-Za-z0-9']*$", 0)
        bad = word.rlike("^[a-z]")
        return bad & ~word.isin(list(context.mixed)) if context.mixed else bad

    # what holds for the whole value is decided outside the lambdas, which are evaluated for every start
    found = F.when(looks_like_sentence(v), F.filter(starts, wrong)).otherwise(F.filter(starts, lambda t: ~t.rlike("^[A-Za-z]") & wrong(t)))
    found = F.when(v.rlike(SMALL_START), found).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda _: F.lit(K.M_START))


def comma_capitals(v: Column) -> Column:
    found = F.filter(F.regexp_extract_all(v, F.lit(COMMA_CAPITAL), F.lit(1)), lambda w: F.lower(w).isin(list(K.CONTINUATIONS)))
    return F.transform(found, lambda w: F.concat(F.lit('"'), w, F.lit('" should be lowercase after a mid-sentence comma: "...,  '), F.lower(w), F.lit('..."')))


def passive(v: Column) -> Column:
    out = []
    for aux, noun, verb in K.PASSIVE:
        m = F.regexp_extract(v, passive_pattern(aux, noun), 0)
        fixed = F.regexp_replace(m, f"(?iu)^{aux}{K.WS}+{noun}$", f"$1 {verb}")
        out.append(only(m != "", F.concat(F.lit('"'), m, F.lit('" should be "'), fixed, F.lit('"'))))
    return F.concat(*out)


def glossary_terms(v: Column, context: Context) -> Column:
    if not context.glossary:
        return F.array().cast("array<string>")
    each = [only(v.rlike(whole_words([w])) & ~v.contains(c), f'"{w}" should be "{c}"') for w, c in context.glossary]
    # one search settles almost all values
    return F.when(v.rlike(whole_words([w for w, _ in context.glossary])), F.concat(*each)).otherwise(F.array().cast("array<string>"))


def identifiers(v: Column, context: Context) -> Column:
    canon = F.create_map(*[F.lit(x) for pair in context.glossary for x in pair]) if context.glossary else None

    def split(t: Column) -> Column:
        s = F.concat(F.substring(t, F.lit(1), F.length(t) - 2), F.lit(" ID"))
        return F.coalesce(F.try_element_at(canon, F.lower(s)), s) if canon is not None else s

    found = F.transform(F.regexp_extract_all(v, F.lit(IDENTIFIER), F.lit(0)), lambda t: F.struct(t.alias("t"), split(t).alias("s")))
    return F.transform(F.filter(found, lambda x: ~v.contains(x["s"])), lambda x: F.concat(F.lit('"'), x["t"], F.lit('" should be "'), x["s"], F.lit('"')))


def _simple(pattern: str, message: str) -> Callable[[Column, Column, Context], Column]:
    return lambda v, lang, context: only(v.rlike(pattern), message)


RULES: tuple[Rule, ...] = (
    Rule("d01_trim", "Spacing", False, lambda v, lang, c: only(v != strip(v), K.M_TRIM)),
    Rule("d02_double_space", "Spacing", False, lambda v, lang, c: only(v.contains("  "), K.M_DOUBLE_SPACE)),
    Rule("d03_missing_space", "Spacing", False, _simple(MISSING_SPACE, K.M_MISSING_SPACE)),
    Rule("d04_space_before_stop", "Spacing", False, _simple(f"{K.WS}[,.]", K.M_SPACE_BEFORE)),
    Rule("d05_space_before_mark", "Spacing", False, lambda v, lang, c: only(~lang.isin(list(K.SPACE_BEFORE_MARKS)) & v.rlike(f"{K.WS}[!?;:]"), K.M_SPACE_BEFORE)),
    Rule("d06_french_space", "Spacing", False, lambda v, lang, c: only(lang.isin(list(K.SPACE_BEFORE_MARKS)) & v.rlike("[A-Za-z][!?;:]"), K.M_FRENCH)),
    Rule("d07_repeated_mark", "Grammar", False, _simple(r"([!?])\1", K.M_REPEATED)),
    Rule("d08_double_period", "Grammar", False, _simple(r"(?<!\.)\.\.(?!\.)", K.M_DOUBLE_PERIOD)),
    Rule("d09_no_of_glued", "Grammar", True, _simple(f"No\\.Of{AFTER}", K.M_NO_OF_GLUED)),
    Rule("d10_no_of_case", "Grammar", True, lambda v, lang, c: only(~v.rlike(f"No\\.Of{AFTER}") & v.rlike(f"No\\.{K.WS}*Of{AFTER}"), K.M_NO_OF)),
    Rule("d11_comma_splice", "Grammar", True, _simple(SPLICE, K.M_SPLICE)),
    Rule("d12_fail_to", "Grammar", True, _simple(FAIL, K.M_FAIL)),
    Rule("d13_sentence_case", "Grammar", True, lambda v, lang, c: sentence_starts(v, c)),
    Rule("d14_comma_case", "Grammar", True, lambda v, lang, c: comma_capitals(v)),
    Rule("d15_mixed_case", "Grammar", True, lambda v, lang, c: only(casing_votes(v, c.glossary, c.custom)["mixed"], K.M_MIXED)),
    Rule("d16_title_case", "Grammar", True, lambda v, lang, c: only(casing_votes(v, c.glossary, c.custom)["title"], K.M_TITLE)),
    Rule("d17_repeated_word", "Grammar", False, lambda v, lang, c: repeated_words(v)),
    Rule("d18_passive", "Grammar", True, lambda v, lang, c: passive(v)),
    Rule("d19_glossary", "Terminology", True, lambda v, lang, c: glossary_terms(v, c)),
    Rule("d20_number_of", "Terminology", True, _simple(NUMBER_OF, K.M_NUMBER_OF)),
    Rule("d21_identifier", "Terminology", True, lambda v, lang, c: identifiers(v, c)),
)
BY_ID = {r.id: r for r in RULES}


def rule_issues(rule: Rule, v: Column, lang: Column, context: Context) -> Column:
    found = rule.issues(v, lang, context)
    return F.when(lang.isin(list(K.ENGLISH)), found).otherwise(F.array().cast("array<string>")) if rule.english else found


def detect(df: DataFrame, value: str = "value", lang: str = "lang_code", context: Context = Context()) -> DataFrame:
    """Add the issue arrays ``spacing``, ``grammar`` and ``terminology``, in the order of the rules."""
    out = df
    for rule in RULES:
        out = out.withColumn(rule.id, rule_issues(rule, F.col(value), F.col(lang), context))
    for category in ("Spacing", "Grammar", "Terminology"):
        out = out.withColumn(category.lower(), F.concat(*[F.col(r.id) for r in RULES if r.category == category]))
    return out.drop(*[r.id for r in RULES])


def issues_of(df: DataFrame, rule_id: str, id_col: str = "entry_id", value: str = "value", lang: str = "lang_code", context: Context = Context()) -> DataFrame:
    """``(id_col, issue_no, issue)`` of one rule, one row for each issue."""
    found = rule_issues(BY_ID[rule_id], F.col(value), F.col(lang), context)
    return df.where(F.col(value).isNotNull()).select(F.col(id_col), F.posexplode(found).alias("issue_no", "issue"))
