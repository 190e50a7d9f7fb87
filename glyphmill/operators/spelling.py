"""Spelling: a cascade over distinct words against a lexicon table, first decision wins.

The lexicon is a table ``(lang, word, freq)``; without ``lang`` it is English.  A
text in a language that the lexicon does not have is not checked, which is not
clean.  Tokens are reduced to the distinct words of each language before anything
is decided, so every lookup works on a vocabulary and not on the text.  All forms
of a word that some step asks the lexicon for are looked up in one join (shuffled
or, where Spark finds the lexicon small, broadcast); edit distance is measured only
between words that share a deletion signature or, for long words, a piece, never
between all pairs, and only for words that no earlier step has decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import fixed as K
from glyphmill.functions.text import AFTER, BEFORE, is_upper, match_case, rebuild
from glyphmill.plans import stage

PLACEHOLDER = r"\[[^\]]*\]"
STRAY_QUOTE = "[A-Za-z]+[\"‘’“”][A-Za-z]+"
WORD = "[A-Za-z']+"
#: The two parts of a word at its first lower-to-upper boundary.
CAMEL = "^((?:(?![a-z][A-Z]).)*[a-z])([A-Z].*)$"
IDENTIFIER = "^[A-Za-z]*[a-z]ID$"


def masked(v: Column) -> Column:
    """Placeholders replaced by as many ``#``."""
    return F.when(v.contains("["), rebuild(v, PLACEHOLDER, lambda t: F.repeat(F.lit("#"), F.length(t)))).otherwise(v)


def stray_quotes(v: Column) -> Column:
    found = F.filter(F.regexp_extract_all(masked(v), F.lit(STRAY_QUOTE), F.lit(0)), lambda w: ~is_upper(w))
    return F.when(v.rlike(STRAY_QUOTE), found).otherwise(F.array().cast("array<string>"))


def tokens(v: Column) -> Column:
    """Words of a value that may be checked, in order."""
    text = rebuild(masked(v), STRAY_QUOTE, lambda t: F.when(is_upper(t), t).otherwise(F.repeat(F.lit("#"), F.length(t))))
    text = F.when(v.rlike(STRAY_QUOTE), text).otherwise(masked(v))
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, "^'+|'+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~is_upper(w) & ~w.rlike(IDENTIFIER))


def _with_lang(df: DataFrame) -> DataFrame:
    return df if "lang" in df.columns else df.withColumn("lang", F.lit("en"))


def word_counts(df: DataFrame, value: str = "value", lang: str | None = None) -> DataFrame:
    """``(word, n)`` of the distinct words to check, with ``lang`` where a column tells it; counts are combined before the shuffle."""
    keys = [F.col(lang).alias("lang")] if lang else []
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.explode(tokens(F.col(value))).alias("word"))
    return rows.groupBy(*(["lang"] if lang else []), "word").agg(F.count(F.lit(1)).alias("n"))


def corpus_lexicon(df: DataFrame, value: str = "value", at_least: int = 5, lang: str | None = None) -> DataFrame:
    """``(word, freq)``: lower-case words seen at least so often, with ``lang`` where a column tells it."""
    keys = [F.col(lang).alias("lang")] if lang else []
    low = df.where(F.col(value).isNotNull()).select(*keys, F.explode(F.regexp_extract_all(F.lower(F.col(value)), F.lit("[a-z']+"), F.lit(0))).alias("word"))
    return low.where(F.length("word") >= 2).groupBy(*(["lang"] if lang else []), "word").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= at_least)


def inflected(custom: DataFrame) -> DataFrame:
    """Custom words with all inflections."""
    endings = F.array(F.lit(""), *[F.lit(s) for s in K.INFLECTIONS])
    return custom.select(F.explode(F.transform(endings, lambda s: F.concat(F.col("word"), s))).alias("low")).distinct()


def _lookup(words: DataFrame, forms: Column, lexicon: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the forms of each word that the lexicon has, as a sorted set."""
    asked = words.select("word", F.explode(forms).alias("form"))
    found = asked.join(lexicon.select(F.col("word").alias("form")), "form", "left_semi").groupBy("word").agg(F.array_sort(F.collect_set("form")).alias(name))
    return words.join(found, "word", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def prefix_rests(low: Column) -> Column:
    rest = [F.when(low.startswith(p) & (F.length(low) >= len(p) + 3), F.substring(low, len(p) + 1, 1_000)) for p in K.PREFIXES]
    return F.array_compact(F.array(*rest))


def regional_forms(low: Column) -> Column:
    out = []
    for a, b in K.SUFFIX_PAIRS:
        for x, y in ((a, b), (b, a)):
            out.append(F.when(low.endswith(x), F.concat(F.substring(low, F.lit(1), F.length(low) - len(x)), F.lit(y))))
    return F.array_compact(F.array(*out))


def swaps(low: Column) -> Column:
    """Words by exchanging two different neighbours."""
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1)))

    def swap(i: Column) -> Column:
        return F.concat(F.substring(low, F.lit(1), i - 1), F.substring(low, i + 1, F.lit(1)), F.substring(low, i, F.lit(1)), F.substring(low, i + 2, F.lit(1_000)))

    different = F.filter(places, lambda i: (F.length(low) >= 2) & (F.substring(low, i, F.lit(1)) != F.substring(low, i + 1, F.lit(1))))
    return F.array_distinct(F.transform(different, swap))


def halves(low: Column, least: int = 3) -> Column:
    """All splits into two parts of at least ``least`` letters."""
    places = F.sequence(F.lit(least), F.greatest(F.length(low) - least, F.lit(least)))
    cut = F.transform(places, lambda i: F.struct(F.substring(low, F.lit(1), i).alias("a"), F.substring(low, i + 1, F.lit(1_000)).alias("b")))
    return F.filter(cut, lambda x: (F.length(x["a"]) >= least) & (F.length(x["b"]) >= least))


def deletions(low: Column, n: int = 2) -> Column:
    """The word and all words by up to two deletions: two words within distance two share one."""

    def once(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1_000))))

    one = once(low)
    both = F.concat(F.array(low), one) if n == 1 else F.concat(F.array(low), one, F.flatten(F.transform(one, once)))
    return F.array_distinct(both)


#: Words up to this length are compared by deletions, of which there are as many as the square of the length; longer ones by pieces.
SHORT = 20


def _pieces(length: Column, i: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of three pieces of a word."""
    cut = [F.lit(0), F.floor(length / 3).cast("int"), F.floor(length * 2 / 3).cast("int"), length]
    return cut[i], cut[i + 1] - cut[i]


def near(words: DataFrame, targets: DataFrame, distance: int = 2, least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., word, target, d)``: pairs of equal ``by`` within the edit distance (two at most).

    Two words within distance two share a word by up to two deletions each; and of three
    pieces of the one, one stands unchanged in the other, at most two places off.
    """
    keys, low = list(by), F.lower("word")
    a = words.where(F.length("word") >= least).select(*keys, "word", low.alias("low"), F.length("word").alias("n"))
    b = targets.where(F.length("word") >= least - 1).select(*keys, F.col("word").alias("target"), F.length("word").alias("m"))
    sigs_a = a.where(F.col("n") <= SHORT).select(*keys, "word", F.explode(deletions(F.col("low"))).alias("sig"))
    sigs_b = b.where(F.col("m") <= SHORT + 2).select(*keys, "target", F.explode(deletions(F.col("target"))).alias("sig"))
    pairs = sigs_a.join(sigs_b, [*keys, "sig"]).select(*keys, "word", "target")
    lengths = a.where(F.col("n") > SHORT).select("*", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("m"))
    asked, held = [], []
    for i in range(3):
        st, size = _pieces(F.col("m"), i)
        shifts = [F.when(st + d >= 0, F.substring(F.col("low"), st + d + 1, size)) for d in range(-2, 3)]
        asked.append(F.array(*[F.struct(F.lit(i).alias("i"), t.alias("t")) for t in shifts]))
        held.append(F.struct(F.lit(i).alias("i"), F.substring(F.col("target"), st + 1, size).alias("t")))
    asked = lengths.select(*keys, "word", "m", F.explode(F.array_distinct(F.concat(*asked))).alias("p")).where("p.t is not null")
    held = b.where(F.col("m") > SHORT - 2).select(*keys, "target", "m", F.explode(F.array(*held)).alias("p"))
    pairs = pairs.unionByName(asked.join(held, [*keys, "m", "p"]).select(*keys, "word", "target")).distinct()
    return pairs.withColumn("d", F.levenshtein(F.lower("word"), F.col("target"), distance)).where("d >= 0")


def _forms(word: Column, low: Column) -> Column:
    """Everything that the steps ask the lexicon about a word, as ``(kind, at, form)``."""

    def tagged(kind: str, forms: Column) -> Column:
        return F.transform(forms, lambda f, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("at"), f.alias("form")))

    cuts = F.when(F.length(low) >= 6, halves(low)).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
    return F.concat(
        tagged("self", F.array(low)), tagged("prefix", prefix_rests(low)), tagged("regional", regional_forms(low)), tagged("swap", swaps(low)),
        tagged("left", F.transform(cuts, lambda x: x["a"])), tagged("right", F.transform(cuts, lambda x: x["b"])),
    )


def judge(words: DataFrame, lexicon: DataFrame, custom: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``(lang, word, suggestions, confident, step, known_key)`` of the words that are hits; the first step that decides wins.

    ``custom`` words are no hits; ``keys`` (known abbreviations) are marked by ``known_key``, as
    one report lists them all the same.
    """
    low = F.lower("word")
    lex = _with_lang(lexicon).select("lang", "word", "freq")
    rows = _with_lang(words).select("lang", "word").distinct().withColumn("low", low)
    rows = rows.join(inflected(custom), "low", "left_anti").where(~F.col("low").isin(list(K.VARIANTS)))
    fixes = F.create_map(*[F.lit(x) for pair in K.REAL_WORDS.items() for x in pair])
    none = F.array().cast("array<string>")
    asked = rows.select("lang", "word", F.explode(_forms(F.col("word"), F.col("low"))).alias("f")).select("lang", "word", "f.kind", "f.at", "f.form")
    found = asked.join(lex.select("lang", F.col("word").alias("form")), ["lang", "form"], "left_semi")
    found = found.groupBy("lang", "word").agg(F.collect_set(F.struct("kind", "at", "form")).alias("found"))
    state = rows.join(found, ["lang", "word"], "left")

    def of(kind: str) -> Column:
        return F.filter(F.coalesce("found", F.array().cast("array<struct<kind:string,at:int,form:string>>")), lambda x: x["kind"] == kind)

    rights = F.transform(of("right"), lambda x: x["at"])
    splits = F.array_sort(F.transform(F.filter(of("left"), lambda x: F.array_contains(rights, x["at"])), lambda x: x["form"]))
    # a real word with capitals inside is no plain spelling of it
    plain = (F.col("word") == F.col("low")) | is_upper(F.col("word")) | (F.substring("word", 2, 1_000) == F.substring("low", 2, 1_000))
    known = F.create_map(*[F.lit(x) for pair in (K.CONTRACTIONS | K.TYPOS).items() for x in pair])
    state = state.select(
        "lang", "word", "low", (F.size(of("self")) > 0).alias("is_real"), (F.size(of("prefix")) + F.size(of("regional")) > 0).alias("accepted"),
        F.array_distinct(F.transform(of("swap"), lambda x: x["form"])).alias("swapped"), splits.alias("splits"),
        F.try_element_at(fixes, F.col("low")).alias("real_fix"), F.try_element_at(known, F.col("low")).alias("fix"),
    )
    state = state.where(F.col("real_fix").isNotNull() | ((~F.col("is_real") | ~plain) & ~F.col("accepted")))
    step = F.when(F.col("real_fix").isNotNull(), "real word").when(F.col("fix").isNotNull(), "known fix").when(F.col("is_real"), "stray capital").when(F.size("swapped") == 1, "transposition")
    state = stage(state.withColumn("step", step), "words")
    open_words = state.where("step is null").select("lang", "word")
    w = Window.partitionBy("lang", "word").orderBy("d", F.desc("freq"), "target")
    ranked = near(open_words, lex.select("lang", "word"), by=("lang",)).join(lex.withColumnRenamed("word", "target"), ["lang", "target"])
    top = ranked.withColumn("rank", F.row_number().over(w)).where("rank <= 3").groupBy("lang", "word").agg(F.array_sort(F.collect_list(F.struct("rank", "target", "d"))).alias("top"))
    domain = near(open_words.select("word").distinct(), custom.where(F.length("word") >= 4).select("word").distinct())
    domain = domain.groupBy("word").agg(F.min(F.struct("d", "target")).alias("best"), F.collect_list("d").alias("ds"))
    domain = domain.select("word", F.col("best.d").alias("domain_d"), F.col("best.target").alias("domain"), F.size(F.filter("ds", lambda x: x == F.col("best.d"))).alias("ties"))
    state = state.join(top, ["lang", "word"], "left").join(domain, "word", "left")
    raw = F.transform(F.coalesce("top", F.array().cast("array<struct<rank:int,target:string,d:int>>")), lambda x: x["target"])
    raw_d = F.coalesce(F.get("top", 0)["d"], F.lit(1 << 30))
    camel = F.regexp_extract("word", CAMEL, 1)
    camel_ok = (F.length(camel) >= 4) & (F.length("word") - F.length(camel) >= 4) & F.array_contains("splits", F.lower(camel))
    one_split = (F.col("word") == F.col("low")) & (F.size("splits") == 1)
    step = (
        F.when(F.col("step").isNotNull(), F.col("step"))
        .when((F.col("ties") == 1) & (F.col("domain_d") < raw_d), "domain word")
        .when(raw_d <= 2, "near word")
        .when(camel_ok, "camel split")
        .when(one_split, "compound split")
        .otherwise("open")
    )
    first = F.get("splits", 0)
    suggestions = (
        F.when(F.col("step") == "real word", F.array("real_fix"))
        .when(F.col("step") == "known fix", F.array("fix"))
        .when(F.col("step") == "stray capital", F.array("low"))
        .when(F.col("step") == "transposition", F.col("swapped"))
        .when(F.col("step") == "domain word", F.array("domain"))
        .when(F.col("step") == "camel split", F.array(F.concat(camel, F.lit(" "), F.regexp_extract("word", CAMEL, 2))))
        .when(F.col("step") == "compound split", F.array(F.concat(first, F.lit(" "), F.substring(F.col("low"), F.length(first) + 1, F.lit(1_000)))))
        .otherwise(F.coalesce(raw, none))
    )
    hits = state.withColumn("step", step).withColumn("suggestions", suggestions)
    if keys is None:
        hits = hits.withColumn("known_key", F.lit(False))
    else:
        hits = hits.join(inflected(keys).withColumn("_key", F.lit(True)), "low", "left").withColumn("known_key", F.coalesce("_key", F.lit(False)))
    return stage(hits.select("lang", "word", "suggestions", (F.col("step") != "open").alias("confident"), "step", "known_key"), "verdicts")


def checked(df: DataFrame, lexicon: DataFrame, lang: str | None) -> DataFrame:
    """Rows in a language that the lexicon has; all rows are English where no column tells."""
    if lang is None:
        return df.withColumn("_lang", F.lit("en"))
    return df.withColumn("_lang", F.col(lang)).join(_with_lang(lexicon).select(F.col("lang").alias("_lang")).distinct(), "_lang", "left_semi")


def hits_of(rows: DataFrame, verdicts: DataFrame, id_col: str = "entry_id", value: str = "value") -> DataFrame:
    """``(id_col, pos, word, suggestions, confident, known_key)``: the hits of every value of ``checked`` rows, stray quotes first."""
    rows = rows.where(F.col(value).isNotNull())
    quotes = rows.where(F.col(value).rlike(STRAY_QUOTE)).select(F.col(id_col), F.posexplode(stray_quotes(F.col(value))).alias("pos", "word"))
    fixed = F.array(F.regexp_replace("word", "[\"‘’“”]", "'"))
    quotes = quotes.select(id_col, (F.col("pos") - 1_000_000).alias("pos"), "word", fixed.alias("suggestions"), F.lit(True).alias("confident"), F.lit(False).alias("known_key"))
    each = rows.select(F.col(id_col), F.col("_lang").alias("lang"), F.posexplode(tokens(F.col(value))).alias("pos", "word"))
    return quotes.unionByName(each.join(verdicts, ["lang", "word"]).select(id_col, "pos", "word", "suggestions", "confident", "known_key"))


def check_spelling(
    df: DataFrame, lexicon: DataFrame, custom: DataFrame, id_col: str = "entry_id", value: str = "value", lang: str | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """``(id_col, pos, word, suggestions, confident)``: the hits of every value; ``keys`` are skipped like custom words."""
    rows = checked(df, lexicon, lang)
    verdicts = judge(word_counts(rows, value, "_lang"), lexicon, custom, keys)
    return hits_of(rows, verdicts, id_col, value).where("not known_key").drop("known_key")


def apply_spelling(df: DataFrame, hits: DataFrame, id_col: str = "entry_id", value: str = "value") -> DataFrame:
    """Add ``spelled``: confident hits replaced in order, every whole word, in the original's cases."""
    sure = hits.where(F.col("confident") & (F.size("suggestions") > 0))
    per = sure.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "word", match_case(F.col("word"), F.get("suggestions", 0)).alias("to")))).alias("_hits"))

    def replace(acc: Column, h: Column) -> Column:
        pattern = F.concat(F.lit(BEFORE + r"\Q"), h["word"], F.lit(r"\E" + AFTER))
        return F.regexp_replace(acc, pattern, F.regexp_replace(h["to"], r"([\\$])", r"\\$1"))

    joined = df.join(per, id_col, "left")
    empty = F.array().cast("array<struct<pos:int,word:string,to:string>>")
    return joined.withColumn("spelled", F.aggregate(F.coalesce("_hits", empty), F.col(value), replace)).drop("_hits")
