"""Queries over the tables of a directory, one for each operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import fixed as K
from glyphmill.functions.text import match_case
from glyphmill.operators import spelling as S
from glyphmill.operators.detect import RULES, Context, detect, issues_of
from glyphmill.operators.duplicates import duplicates, first_seen
from glyphmill.operators.fix import STEPS, fix, step_changes
from glyphmill.operators.report import column_widths, diff_report, differences, duplicate_rows, file_stats, flags, full_report, glossary_keys, routed, run_stats, spelling_notes, summary
from glyphmill.plans import keep, spread, stage
from glyphmill.sources.resources import detect_language, entries, fuzzy_words, glossary_pairs, language_code, line_parts, mixed_case_words, word_list
from glyphmill.sources.sinks import output_name, rewritten_lines

#: Most rows of the tables that are parameters of rules.
MAX_WORDS = 5_000
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bounded(df: DataFrame, most: int) -> list:
    """Rows of a small table; a larger one is an error, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"at most {most} rows are taken as parameters")
    return rows


def context(spark: SparkSession, d: str) -> Context:
    """Glossary and custom words; these tables are parameters of the rules and are read whole, up to a bound that is checked."""
    words = bounded(custom_words(spark, d).select("word", "original"), MAX_WORDS)
    mixed = tuple(sorted({r.original for r in words if r.original not in (r.original.lower(), r.original.upper())}))
    return Context(glossary=tuple(glossary_pairs(table(spark, d, "glossary"))), custom=tuple(sorted({r.word for r in words})), mixed=mixed)


def codes_of(spark: SparkSession, d: str) -> list[str]:
    return sorted(r.code for r in bounded(table(spark, d, "languages").select("code").where("code is not null").distinct(), MAX_WORDS))


def entry_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the language of their file."""
    codes = codes_of(spark, d)
    rows = spread(table(spark, d, "parse_entries").select("entry_id", "file", "line", "key", "value"))
    return rows.withColumn("lang_code", language_code(F.col("file"), codes))


def english(spark: SparkSession, d: str) -> DataFrame:
    return entry_rows(spark, d).where(F.col("lang_code").isin(list(K.ENGLISH)))


def custom_words(spark: SparkSession, d: str) -> DataFrame:
    return word_list(table(spark, d, "glossary").select(F.col("canon").alias("value")))


def spellers(spark: SparkSession, d: str) -> DataFrame:
    """Entries in the languages that have a dictionary."""
    langs = table(spark, d, "languages").where("has_speller").select(F.col("code").alias("lang_code")).distinct()
    return entry_rows(spark, d).join(F.broadcast(langs), "lang_code", "left_semi")


def lexicons(spark: SparkSession, d: str) -> DataFrame:
    """``(lang, word, freq)`` of the languages that have a dictionary."""
    return S.corpus_lexicon(spellers(spark, d), lang="lang_code")


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus_lexicon(english(spark, d))


def _oov(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lex = stage(lexicon(spark, d), "lexicon")
    words = S.word_counts(english(spark, d)).select("word", F.lower("word").alias("low"))
    return stage(words.join(lex.select(F.col("word").alias("low")), "low", "left_anti"), "oov"), lex


def s1_lines(spark, d):
    return table(spark, d, "resource_lines").groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line").alias("last_line"))


def s2_parse_entries(spark, d):
    return entries(table(spark, d, "resource_lines"))


def s2_line_parts(spark, d):
    return line_parts(table(spark, d, "resource_lines")).where("is_entry").select("file", "line", F.length("indent").alias("indent"), "key", F.coalesce(F.trim("semi"), F.lit("")).alias("semi"), F.trim("trail").alias("trail"))


def s4_glossary(spark, d):
    pairs = glossary_pairs(table(spark, d, "glossary"))
    return spark.createDataFrame([(i, w, c) for i, (w, c) in enumerate(pairs, 1)], "ord int, wrong string, canon string")


def s5_custom_words(spark, d):
    return custom_words(spark, d).select("word").distinct()


def s7_fuzzy_words(spark, d):
    return fuzzy_words(custom_words(spark, d))


def s8_mixed_case_words(spark, d):
    return mixed_case_words(custom_words(spark, d))


def s10_detect_language(spark, d):
    return detect_language(table(spark, d, "resource_files").select("file"), table(spark, d, "languages"))


def s11_language_override(spark, d):
    return detect_language(table(spark, d, "resource_files").select("file"), table(spark, d, "languages"), override="sv")


def s12_lexicon_languages(spark, d):
    langs = table(spark, d, "languages")
    checked = table(spark, d, "resource_files").join(F.broadcast(langs.where("has_speller").select(F.col("code").alias("lang_code"))), "lang_code", "left_semi")
    return checked.groupBy("lang_code").agg(F.count(F.lit(1)).alias("n_files"))


def d23_duplicates(spark, d):
    return duplicates(entry_rows(spark, d).where("value is not null")).select("entry_id", "file", "line", "key", "first_seen_line")


def d24_flags(spark, d):
    return flags(entry_rows(spark, d)).select("entry_id", "line", "category", "issue")


def w1_first_seen(spark, d):
    return first_seen(entry_rows(spark, d)).select("file", "key", F.col("first.line").alias("first_line"), "n")


def p00_checked(spark, d):
    speakers = table(spark, d, "languages").select(F.col("code").alias("lang_code"), "has_speller")
    return entry_rows(spark, d).join(F.broadcast(speakers), "lang_code", "left").groupBy("lang_code").agg(F.count_if(F.coalesce("has_speller", F.lit(False))).alias("n_checked"), F.count(F.lit(1)).alias("n"))


def p02_stray_quotes(spark, d):
    rows = english(spark, d).where("value is not null")
    return rows.select("entry_id", F.posexplode(S.stray_quotes(F.col("value"))).alias("no", "word")).select("entry_id", "no", "word", F.regexp_replace("word", "[\"‘’“”]", "'").alias("fix"))


def p03_tokens(spark, d):
    return S.word_counts(english(spark, d))


def p06_inflected(spark, d):
    words = S.word_counts(english(spark, d)).withColumn("low", F.lower("word"))
    return words.join(S.inflected(custom_words(spark, d)), "low", "left_semi").select("word", "n")


def p08_real_words(spark, d):
    fixes = F.create_map(*[F.lit(x) for pair in K.REAL_WORDS.items() for x in pair])
    return S.word_counts(english(spark, d)).where(F.lower("word").isin(list(K.REAL_WORDS))).select("word", "n", F.try_element_at(fixes, F.lower("word")).alias("fix"))


def p09_oov(spark, d):
    return _oov(spark, d)[0].select("word")


def p09_lexicon(spark, d):
    return lexicon(spark, d)


def p10_prefix(spark, d):
    oov, lex = _oov(spark, d)
    return S._lookup(oov, S.prefix_rests(F.col("low")), lex, "rests").where(F.size("rests") > 0).select("word", F.array_join("rests", ",").alias("rests"))


def p11_regional(spark, d):
    oov, lex = _oov(spark, d)
    return S._lookup(oov, S.regional_forms(F.col("low")), lex, "forms").where(F.size("forms") > 0).select("word", F.array_join("forms", ",").alias("forms"))


def p12_known_fixes(spark, d):
    known = K.CONTRACTIONS | K.TYPOS
    fixes = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return _oov(spark, d)[0].where(F.col("low").isin(list(known))).select("word", F.try_element_at(fixes, F.col("low")).alias("fix"))


def p13_stray_capital(spark, d):
    words = S.word_counts(english(spark, d)).select("word", F.lower("word").alias("low")).where(F.substring("word", 2, 1000).rlike("[A-Z]"))
    return words.join(lexicon(spark, d).select(F.col("word").alias("low")), "low", "left_semi").select("word", F.col("low").alias("fix"))


def p14_transposition(spark, d):
    oov, lex = _oov(spark, d)
    return S._lookup(oov, S.swaps(F.col("low")), lex, "found").where(F.size("found") == 1).select("word", F.get("found", 0).alias("fix"))


def p16_domain_words(spark, d):
    oov, _ = _oov(spark, d)
    return S.near(oov.select("word"), fuzzy_words(custom_words(spark, d)))


def p17_near_words(spark, d):
    oov, lex = _oov(spark, d)
    return S.near(oov.select("word"), lex.select("word"))


def p19_compound_split(spark, d):
    oov, lex = _oov(spark, d)
    cuts = oov.where((F.col("word") == F.col("low")) & (F.length("word") >= 6)).select("word", F.explode(S.halves(F.col("low"))).alias("c"))
    a = cuts.join(lex.select(F.col("word").alias("x")), F.col("c.a") == F.col("x"), "left_semi")
    b = a.join(lex.select(F.col("word").alias("y")), F.col("c.b") == F.col("y"), "left_semi")
    return b.groupBy("word").agg(F.count(F.lit(1)).alias("n_splits"), F.min(F.concat("c.a", F.lit(" "), "c.b")).alias("first_split"))


def _keys(spark, d):
    return glossary_keys(spark, context(spark, d))


def p20_verdicts(spark, d):
    lex, custom = _spelling(spark, d)
    out = S.judge(S.word_counts(spellers(spark, d), lang="lang_code"), lex, custom, _keys(spark, d)).where("not known_key")
    return out.select("lang", "word", F.array_join("suggestions", ", ").alias("suggestions"), "confident", "step")


def d22_spelling(spark, d):
    hits = S.check_spelling(entry_rows(spark, d), *_spelling(spark, d), lang="lang_code", keys=_keys(spark, d))
    tip = F.when(F.size("suggestions") > 0, F.concat(F.lit(' (did you mean "'), F.get("suggestions", 0), F.lit('"?)'))).otherwise(F.lit(""))
    return hits.select("entry_id", "pos", F.concat(F.lit('Possible misspelling: "'), "word", F.lit('"'), tip).alias("issue"))


def f18_spelling(spark, d):
    rows = entry_rows(spark, d).where("value is not null")
    hits = S.check_spelling(rows, *_spelling(spark, d), lang="lang_code", keys=_keys(spark, d))
    return S.apply_spelling(rows, hits).where("spelled <> value").select("entry_id", F.col("spelled").alias("after"))


def x18_match_case(spark, d):
    words = S.word_counts(english(spark, d))
    return words.select("word", match_case(F.col("word"), F.lit("fiXed")).alias("cased"))


def _spelling(spark, d):
    return stage(lexicons(spark, d), "lexicon"), custom_words(spark, d)


def q1_differences(spark, d):
    return differences(entry_rows(spark, d), context(spark, d), spelling=_spelling(spark, d)).select("entry_id", "line", "key", "before", "after", "categories")


def u2_diff_report(spark, d):
    return diff_report(entry_rows(spark, d), context(spark, d), _spelling(spark, d))


def _report(spark, d):
    rows = detect_language(entry_rows(spark, d).drop("lang_code"), table(spark, d, "languages"))
    return routed(rows, context(spark, d), spelling=_spelling(spark, d))


def q3_report(spark, d):
    return _report(spark, d).select("entry_id", "file", "line", "lang_code", "category", "n_grammar", "n_terminology", "n_spacing", "suggested", "changes_applied")


def q3_workbook(spark, d):
    rows = detect_language(entry_rows(spark, d).drop("lang_code"), table(spark, d, "languages"))
    book = full_report(rows, *_spelling(spark, d), context(spark, d))
    parts = [sheet.select(F.lit(name).alias("sheet"), "file", F.to_json(F.struct(*sheet.columns)).alias("row")) for name, sheet in book.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def a1_run_stats(spark, d):
    return run_stats(entry_rows(spark, d), context(spark, d), _spelling(spark, d))


def a2_file_stats(spark, d):
    return file_stats(stage(_report(spark, d), "report"), duplicates(entry_rows(spark, d).where("value is not null")))


def a2_category_pivot(spark, d):
    report = _report(spark, d).withColumn("category", F.coalesce("category", F.lit("Clean")))
    return report.groupBy("file").pivot("category", [*K.CATEGORIES, "Clean"]).count().na.fill(0)


def a6_widths(spark, d):
    return column_widths(duplicates(entry_rows(spark, d).where("value is not null")).select("line", "key", "value"))


def q7_clean(spark, d):
    return keep(_report(spark, d), F.col("category").isNull()).select("entry_id", "value")


def q8_summary(spark, d):
    stats = file_stats(stage(_report(spark, d), "report"), duplicates(entry_rows(spark, d).where("value is not null")))
    return summary(stats)


def k1_rewritten(spark, d):
    return rewritten_lines(table(spark, d, "resource_lines"), context(spark, d), _spelling(spark, d))


def k3_duplicates(spark, d):
    return duplicate_rows(entry_rows(spark, d).where("value is not null"))


def fix_steps(spark, d):
    out = fix(entry_rows(spark, d).where("value is not null"), context=context(spark, d))
    return keep(out, F.size("labels") > 0).select("entry_id", "fixed", F.array_join("labels", "; ").alias("labels"))


def detect_counts(spark, d):
    out = detect(entry_rows(spark, d).where("value is not null"), context=context(spark, d))
    out = out.select("entry_id", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("spacing", "grammar", "terminology")])
    return keep(out, F.col("n_spacing") + F.col("n_grammar") + F.col("n_terminology") > 0)


def k5_spelling_notes(spark, d):
    return spelling_notes(entry_rows(spark, d), lexicons(spark, d))


def o1_files(spark, d):
    return table(spark, d, "resource_lines").select("file").distinct().orderBy("file")


def k9_output_names(spark, d):
    return table(spark, d, "resource_files").select("file", output_name(F.col("file")).alias("fixed"), output_name(F.col("file"), ".diff_report.csv").alias("report"), output_name(F.col("file"), ".duplicates.csv").alias("duplicates"), output_name(F.col("file"), ".qa_report.xlsx").alias("workbook"))


def u1_skip_words(spark, d):
    wrong = spark.createDataFrame([(w,) for w, _ in glossary_pairs(table(spark, d, "glossary"))], "word string")
    return custom_words(spark, d).select("word").union(wrong).distinct()


def _rule(rule_id: str) -> Query:
    return lambda spark, d: issues_of(entry_rows(spark, d), rule_id, context=context(spark, d))


def _step(step_id: str) -> Query:
    return lambda spark, d: step_changes(entry_rows(spark, d), step_id, context=context(spark, d))


NAMED = (
    s1_lines, s2_parse_entries, s2_line_parts, s4_glossary, s5_custom_words, s7_fuzzy_words, s8_mixed_case_words, s10_detect_language, s11_language_override,
    s12_lexicon_languages, d22_spelling, d23_duplicates, d24_flags, w1_first_seen, f18_spelling, x18_match_case, q1_differences, u2_diff_report,
    q3_report, q3_workbook, a1_run_stats, a2_file_stats, a2_category_pivot, a6_widths, q7_clean, q8_summary, k1_rewritten, k3_duplicates, k5_spelling_notes, fix_steps, detect_counts, k9_output_names, o1_files, u1_skip_words,
)
#: Spelling steps; their names must not look like those of numbered problems.
SPELL = (p00_checked, p02_stray_quotes, p03_tokens, p06_inflected, p08_real_words, p09_oov, p09_lexicon, p10_prefix, p11_regional, p12_known_fixes, p13_stray_capital, p14_transposition, p16_domain_words, p17_near_words, p19_compound_split, p20_verdicts)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f.__name__: f for f in NAMED}
    out |= {f"spell_{f.__name__}": f for f in SPELL}
    out |= {r.id: _rule(r.id) for r in RULES}
    out |= {i: _step(i) for i, _, _ in STEPS}
    return dict(sorted(out.items()))
