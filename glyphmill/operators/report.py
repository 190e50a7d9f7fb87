"""Reports: differences, review flags, category routing, sheets, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import fixed as K
from glyphmill.operators.detect import Context, detect, repeated_words
from glyphmill.operators.duplicates import duplicates
from glyphmill.operators.fix import fix
from glyphmill.operators.spelling import apply_spelling, checked, hits_of, judge, word_counts
from glyphmill.plans import keep, stage

SHEETS = ("Spelling", "Grammar", "Terminology", "Spacing", "Duplicates", "Clean", "Summary")


def category(counts: dict[str, Column]) -> Column:
    """Category with the most issues, ties in the order of ``CATEGORIES``; null where there is none."""
    most = F.greatest(*[counts[c] for c in K.CATEGORIES])
    out = F.lit(None).cast("string")
    for c in reversed(K.CATEGORIES):
        out = F.when(counts[c] == most, F.lit(c)).otherwise(out)
    return F.when(most > 0, out)


def glossary_keys(spark, context: Context) -> DataFrame | None:
    """Known abbreviations, which spelling leaves to the terminology rules."""
    return spark.createDataFrame([(w.lower(),) for w, _ in context.glossary], "word string").distinct() if context.glossary else None


def spelling_hits(df: DataFrame, spelling: tuple[DataFrame, DataFrame], context: Context, columns: tuple[str, ...], id_col: str, lang: str | None) -> list[DataFrame]:
    """``hits_of`` each column; the words of all columns are judged once."""
    lexicon, custom = spelling
    rows = checked(df, lexicon, lang)
    words = word_counts(rows, columns[0], "_lang")
    for c in columns[1:]:
        words = words.unionByName(word_counts(rows, c, "_lang"))
    verdicts = judge(words, lexicon, custom, glossary_keys(df.sparkSession, context))
    return [hits_of(rows, verdicts, id_col, c) for c in columns]


def _spelled(out: DataFrame, hits: DataFrame, id_col: str) -> DataFrame:
    out = apply_spelling(out, hits.where("not known_key"), id_col, "fixed")
    labels = F.when(F.col("spelled") != F.col("fixed"), F.concat("labels", F.array(F.lit(K.L_SPELLING)))).otherwise(F.col("labels"))
    return out.withColumn("labels", labels).withColumn("fixed", F.col("spelled")).drop("spelled")


def fix_all(
    df: DataFrame, value: str = "value", context: Context = Context(), spelling: tuple[DataFrame, DataFrame] | None = None, id_col: str = "entry_id", lang: str | None = None
) -> DataFrame:
    """``fix`` with spelling (lexicon and custom words) as its last step, on what the other steps leave.

    ``lang`` names the column with the language of a row; without it all rows are
    taken as English, as the fix of whole files does.
    """
    out = fix(df, value, context)
    if spelling is None:
        return out
    out = stage(out, "fixed")
    return _spelled(out, spelling_hits(out, spelling, context, ("fixed",), id_col, lang)[0], id_col)


def differences(df: DataFrame, context: Context = Context(), value: str = "value", spelling: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows with at least one fix: ``before, after, categories`` beside the input columns."""
    out = fix_all(df.where(F.col(value).isNotNull()), value, context, spelling)
    return keep(out, F.size("labels") > 0).withColumn("before", F.col(value)).withColumn("after", F.col("fixed")).withColumn("categories", F.array_join("labels", "; ")).drop("fixed", "labels")


def flags(df: DataFrame, value: str = "value") -> DataFrame:
    """Repeated words, for review only: one row for each issue."""
    rows = df.where(F.col(value).isNotNull())
    return rows.withColumn("issue", F.explode(repeated_words(F.col(value)))).withColumn("category", F.lit("Grammar"))


def diff_report(df: DataFrame, context: Context = Context(), spelling: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``file, line, key, type, categories_or_category, before_or_issue, after``: fixed rows and rows to review."""
    fixed = differences(df, context, spelling=spelling).select("file", "line", "key", F.lit("auto-fixed").alias("type"), F.col("categories").alias("categories_or_category"), F.col("before").alias("before_or_issue"), "after")
    review = flags(df).select("file", "line", "key", F.lit("needs-review").alias("type"), F.col("category").alias("categories_or_category"), F.col("issue").alias("before_or_issue"), F.lit("").alias("after"))
    return fixed.unionByName(review)


def routed(
    df: DataFrame, context: Context = Context(), hits: DataFrame | None = None, id_col: str = "entry_id", spelling: tuple[DataFrame, DataFrame] | None = None, lang: str = "lang_code"
) -> DataFrame:
    """Every entry once with its issue counts, category, suggestion and labels.

    With ``spelling`` (lexicon and custom words), words of the values and of what the fixes
    leave of them are judged together.  Where the lexicon lacks a language the
    spelling count is null: not checked is not clean.  ``hits`` take the place of
    hits found here.
    """
    rows = fix(detect(df.where("value is not null"), context=context), context=context)
    if spelling is None:
        rows = rows.withColumn("n_spelling", F.lit(None).cast("bigint"))
    else:
        rows = stage(rows, "fixed")
        before, after = spelling_hits(rows, spelling, context, ("value", "fixed"), id_col, lang)
        n = (before.where("not known_key") if hits is None else hits).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
        has = checked(rows, spelling[0], lang).select(id_col, F.lit(True).alias("_checked"))
        rows = _spelled(rows, after, id_col).join(n, id_col, "left").join(has, id_col, "left")
        rows = rows.withColumn("n_spelling", F.when(F.col("_checked"), F.coalesce("_n", F.lit(0).cast("bigint")))).drop("_n", "_checked")
    rows = rows.withColumn("n_grammar", F.size("grammar").cast("bigint")).withColumn("n_terminology", F.size("terminology").cast("bigint")).withColumn("n_spacing", F.size("spacing").cast("bigint"))
    counts = {c: F.coalesce(f"n_{c.lower()}", F.lit(0).cast("bigint")) for c in K.CATEGORIES}
    rows = rows.withColumn("category", category(counts))
    suggested = F.when(F.col("fixed") == F.col("value"), F.lit(K.MANUAL)).otherwise(F.col("fixed"))
    return rows.withColumn("suggested", suggested).withColumn("changes_applied", F.array_join("labels", "; "))


def words_column(hits: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """``(id_col, words_to_correct)``: all hits of a value as one text."""
    s = F.col("suggestions")
    more = F.slice(s, 2, 2)
    text = F.when(F.size(s) == 0, F.concat(F.lit('"'), "word", F.lit('" - no confident suggestion'))).otherwise(
        F.concat(F.lit('"'), "word", F.lit('" -> "'), F.get(s, 0), F.lit('"'), F.when(F.size(s) > 1, F.concat(F.lit(" (or: "), F.array_join(more, ", "), F.lit(")"))).otherwise(F.lit("")))
    )
    per = hits.select(id_col, "pos", text.alias("t")).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("a"))
    return per.select(id_col, F.array_join(F.transform("a", lambda x: x["t"]), ";  ").alias("words_to_correct"))


def file_stats(report: DataFrame, dups: DataFrame) -> DataFrame:
    """One row per file: entries, entries of each category, clean ones, duplicate keys."""
    sums = [F.count_if(F.col("category") == c).alias(c.lower()) for c in K.CATEGORIES]
    by_file = report.groupBy("file", "lang_code", "lang_name", "detection").agg(F.count(F.lit(1)).alias("total"), *sums, F.count_if(F.col("category").isNull()).alias("clean"))
    d = dups.groupBy("file").agg(F.count(F.lit(1)).alias("duplicates"))
    return by_file.join(d, "file", "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0).cast("bigint")))


def run_stats(df: DataFrame, context: Context = Context(), spelling: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per file: total, auto-fixed, duplicates, flagged."""
    rows = fix_all(df.where("value is not null"), context=context, spelling=spelling)
    base = rows.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("labels") > 0).alias("auto_fixed"), F.sum(F.size(repeated_words(F.col("value")))).alias("flagged"))
    d = duplicates(df.where("value is not null")).groupBy("file").agg(F.count(F.lit(1)).alias("duplicates"))
    return base.join(d, "file", "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0).cast("bigint")))


def summary(stats: DataFrame, spelling_checked: bool = False) -> DataFrame:
    """``file, ord, metric, value``: the metrics of a file's summary sheet as rows."""
    rows = [
        ("File", F.col("file")),
        ("Detected language", F.concat("lang_name", F.lit(" ("), "lang_code", F.lit(")"))),
        ("Language detection method", F.col("detection")),
        ("Total strings", F.col("total").cast("string")),
        ("Sheet assignment", F.lit("Each string appears in exactly ONE sheet - priority: Spelling > Grammar > Terminology > Spacing")),
        ("Spelling issues", F.col("spelling").cast("string")),
        ("Grammar issues", F.col("grammar").cast("string")),
        ("Terminology issues", F.col("terminology").cast("string")),
        ("Spacing issues", F.col("spacing").cast("string")),
        ("Duplicate keys", F.col("duplicates").cast("string")),
        ("Clean strings (no issues in any category)", F.col("clean").cast("string")),
        ("LanguageTool server used", F.lit("yes" if spelling_checked else "no - spelling sheet incomplete")),
    ]
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("metric"), v.alias("value")) for i, (name, v) in enumerate(rows, 1)])
    return stats.select(F.col("file"), F.explode(items).alias("m")).select("file", "m.ord", "m.metric", "m.value")


def sheets(report: DataFrame, dups: DataFrame, words: DataFrame | None = None, id_col: str = "entry_id") -> dict[str, DataFrame]:
    """The seven sheets of a workbook as tables."""
    out: dict[str, DataFrame] = {}
    for c in K.CATEGORIES:
        part = keep(report, F.col("category") == c)
        cols = ["file", "line", "key", "value", "suggested"]
        if c == "Spelling" and words is not None:
            part = part.join(words, id_col, "left")
            cols.append("words_to_correct")
        out[c] = part.select(*cols, "changes_applied")
    out["Duplicates"] = dups.select("file", "line", "key", "value", F.concat(F.lit("Also defined at line "), F.col("first_seen_line").cast("string")).alias("note"))
    out["Clean"] = keep(report, F.col("category").isNull()).select("file", "line", "key", "value")
    out["Summary"] = summary(file_stats(report, dups))
    return out


def column_widths(sheet: DataFrame) -> DataFrame:
    """``(column, width)``: longest text of each column plus two, from 12 to 80."""
    longest = [F.greatest(F.lit(len(c)), F.lit(10), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))).alias(c) for c in sheet.columns]
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.least(F.col(c) + 2, F.lit(80)).alias("width")) for c in sheet.columns])
    return sheet.agg(*longest).select(F.explode(items).alias("w")).select("w.column", "w.width")


def spelling_notes(files: DataFrame, lexicon: DataFrame, lang: str = "lang_code") -> DataFrame:
    """``(file, note)`` of the files whose language the lexicon lacks, so that their empty spelling sheets do not pass for clean ones."""
    known = lexicon.select("lang").distinct() if "lang" in lexicon.columns else lexicon.sparkSession.createDataFrame([("en",)], "lang string")
    bare = files.select("file", F.col(lang).alias("lang")).distinct().join(known, "lang", "left_anti")
    note = F.concat(F.lit("Note: no spelling dictionary installed for '"), "lang", F.lit("' - spelling not checked, sheet reflects that, not 'no errors'"))
    return bare.select("file", note.alias("note"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows of the duplicates report: ``file, line, key, first_seen_line, value, note``."""
    return duplicates(df).select("file", "line", "key", "first_seen_line", "value", "note")


def full_report(df: DataFrame, lexicon: DataFrame, custom: DataFrame, context: Context = Context()) -> dict[str, DataFrame]:
    """All sheets of entries with ``file, line, key, value, lang_code, lang_name, detection``, spelling included."""
    rows = df.where("value is not null")
    words = spelling_hits(rows, (lexicon, custom), context, ("value",), "entry_id", "lang_code")[0]
    report = stage(routed(rows, context, spelling=(lexicon, custom)), "report")
    # the words to correct are listed with known abbreviations, which the count of issues leaves out
    return sheets(report, duplicates(df), words_column(words))
