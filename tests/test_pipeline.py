"""Sources, duplicates, spelling, reports, sinks, streaming."""

from pyspark.sql import functions as F

from glyphmill.operators.detect import Context
from glyphmill.operators.duplicates import duplicates
from glyphmill.operators.report import category, column_widths, diff_report, full_report, routed
from glyphmill.operators.spelling import apply_spelling, check_spelling, judge, near
from glyphmill.sources.resources import detect_language, entries, glossary_pairs, read_glossary, read_resources, word_list
from glyphmill.sources.sinks import rewritten_lines, write_rewritten
from glyphmill.streaming import stream_differences, stream_duplicates

TEXT = '﻿languageResource.A = "x";\r\n  languageResource.B="No.Of  items" // note\rlanguageResource.C-D = "no";\n\nlanguageResource.E = \'no\';\nlanguageResource.A = "say \\"hi\\"" ;\nlanguageResource.F = ""'


def test_files_and_line_grammar(spark, tmp_path):
    (tmp_path / "a_fr.js").write_bytes(TEXT.encode("utf-8"))
    lines = read_resources(spark, str(tmp_path))
    assert [(r.line, r.raw[:1]) for r in lines.orderBy("line").collect()][0][0] == 1
    assert lines.count() == 7
    got = [(r.line, r.key, r.value) for r in entries(lines).orderBy("line").collect()]
    assert got == [(2, "B", "No.Of  items"), (6, "A", 'say \\"hi\\"'), (7, "F", "")]


def test_rewritten_lines(spark):
    lines = spark.createDataFrame([("f", 1, "// c"), ("f", 2, '  languageResource.B="No.Of  items" // note'), ("f", 3, 'languageResource.C = "Fine";')], "file string, line int, raw string")
    got = [r.text for r in rewritten_lines(lines).orderBy("line").collect()]
    assert got == ["// c", '  languageResource.B = "Number of items"; // note', 'languageResource.C = "Fine";']


def test_write_rewritten(spark, tmp_path):
    lines = spark.createDataFrame([("f.js", i, f'languageResource.K{i} = "a  b c";') for i in range(1, 60)], "file string, line int, raw string")
    write_rewritten(lines, str(tmp_path / "out"))
    back = [r.value for r in spark.read.text(str(tmp_path / "out" / "name=f.FIXED.js")).collect()]
    assert back == [f'languageResource.K{i} = "A b c";' for i in range(1, 60)]


def test_language_of_file_names(spark):
    files = spark.createDataFrame([("a_fr.js",), ("x-de.js",), ("resource.ja.js",), ("v2.js",), ("is_it_ok.js",)], "file string")
    assert [r.lang_code for r in detect_language(files).collect()] == ["fr", "de", "ja", "unknown", "it"]
    over = detect_language(files, override="qq").first()
    assert (over.lang_code, over.lang_name, over.detection) == ("qq", "qq", "manual")


def test_glossary_and_word_list(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"PO": "Po", "order number": "Order Number"}')
    pairs = glossary_pairs(read_glossary(spark, str(tmp_path / "g.json")))
    assert pairs[3] == ("po", "Po") and pairs[-1] == ("order number", "Order Number") and len(pairs) == 9
    words = word_list(spark.createDataFrame([("# c",), (" Wi-Fi ",), ("",), ("abc",), ("abc",)], "value string"))
    assert {(r.word, r.original) for r in words.collect()} == {("wi-fi", "Wi-Fi"), ("abc", "abc")}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "f", 1, "A", "x"), (2, "f", 2, "B", "x"), (3, "f", 3, "A", "y"), (4, "f", 5, "A", "z"), (5, "g", 1, "A", "x"), (6, "f", 9, None, "x"), (7, "f", 10, None, "x")], "entry_id int, file string, line int, key string, value string")
    assert [(r.entry_id, r.first_seen_line) for r in duplicates(df).orderBy("entry_id").collect()] == [(3, 1), (4, 1)]
    assert duplicates(df.where("false")).count() == 0


WORDS = "load please enter pallet info tag relevant rel event recipe failed order save the search canned color size counter weight".split()


def verdicts(spark, words):
    lex = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(WORDS)], "word string, freq bigint")
    custom = spark.createDataFrame([("preweigh",), ("groupset",)], "word string")
    asked = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    return {r.word: (r.suggestions, r.confident, r.step) for r in judge(asked, lex, custom).collect()}


def test_spelling_cascade(spark):
    got = verdicts(spark, ["laod", "pelase", "enTer", "PalletInfo", "taginfo", "groupset", "relevent", "prewigh", "falied", "caned", "sech", "cancelled", "colour", "preweighed", "receipe", "dont", "reload", "zzzzzzz", "order", "Order"])
    first = {w: (s[0] if s else None) for w, (s, _, _) in got.items()}
    assert first["laod"] == "load" and first["pelase"] == "please" and first["enTer"] == "enter"
    assert first["PalletInfo"] == "Pallet Info" and first["taginfo"] == "tag info"
    assert first["relevent"] == "relevant" and first["prewigh"] == "preweigh" and first["falied"] == "failed"
    assert first["caned"] == "canned" and first["sech"] == "search" and first["receipe"] == "recipe" and first["dont"] == "don't"
    assert not {"groupset", "cancelled", "colour", "preweighed", "reload", "order", "Order"} & set(got)
    assert got["zzzzzzz"] == ([], False, "open")


def test_near_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(4, 7))) for _ in range(60)})
    a = spark.createDataFrame([(w,) for w in words[:30]], "word string")
    b = spark.createDataFrame([(w,) for w in words[30:]], "word string")
    got = {(r.word, r.target, r.d) for r in near(a, b).collect()}
    want = {(r.word, r.target, r.d) for r in a.crossJoin(b.withColumnRenamed("word", "target")).withColumn("d", F.levenshtein("word", "target")).where("d <= 2").collect()}
    assert got == want


def test_spelling_in_values(spark):
    lex = spark.createDataFrame([(w, 10) for w in WORDS], "word string, freq bigint")
    custom = spark.createDataFrame([], "word string")
    df = spark.createDataFrame([(1, 'Laod the order, doesn"t save'), (2, "[laod] 'order'"), (3, None)], "entry_id int, value string")
    hits = check_spelling(df, lex, custom)
    assert sorted((r.entry_id, r.word) for r in hits.collect()) == [(1, "Laod"), (1, 'doesn"t')]
    out = {r.entry_id: r.spelled for r in apply_spelling(df, hits).collect()}
    assert out == {1: "Load the order, doesn't save", 2: "[laod] 'order'", 3: None}


def test_routing(spark):
    df = spark.createDataFrame([(1, 3, 0, 0), (1, 1, 0, 0), (0, 0, 0, 0), (0, 1, 1, 1)], "s int, g int, t int, p int")
    got = [r.c for r in df.select(category({"Spelling": F.col("s"), "Grammar": F.col("g"), "Terminology": F.col("t"), "Spacing": F.col("p")}).alias("c")).collect()]
    assert got == ["Grammar", "Spelling", None, "Grammar"]


def entries_df(spark):
    rows = [(1, "a_en.js", 1, "A", "the the order", "en", "English", "filename"), (2, "a_en.js", 2, "A", "Save  now", "en", "English", "filename"), (3, "a_en.js", 3, "B", "Save", "en", "English", "filename"), (4, "b.js", 1, "C", None, "unknown", "Unknown", "unknown")]
    return spark.createDataFrame(rows, "entry_id int, file string, line int, key string, value string, lang_code string, lang_name string, detection string")


def test_reports(spark):
    df = entries_df(spark)
    report = {r.entry_id: r.category for r in routed(df).collect()}
    assert report == {1: "Grammar", 2: "Spacing", 3: None}
    kinds = sorted((r.line, r.type) for r in diff_report(df).collect())
    assert kinds == [(1, "auto-fixed"), (1, "needs-review"), (2, "auto-fixed")]
    lex = spark.createDataFrame([(w, 9) for w in ("the", "order", "save", "now")], "word string, freq bigint")
    book = full_report(df, lex, spark.createDataFrame([], "word string"), Context())
    assert list(book) == ["Spelling", "Grammar", "Terminology", "Spacing", "Duplicates", "Clean", "Summary"]
    assert book["Clean"].count() == 1 and book["Duplicates"].count() == 1
    summary = {r.metric: r.value for r in book["Summary"].where("file = 'a_en.js'").collect()}
    assert summary["Total strings"] == "3" and summary["Grammar issues"] == "1" and summary["Duplicate keys"] == "1"
    widths = {r.column: r.width for r in column_widths(book["Duplicates"]).collect()}
    assert widths["line"] == 12


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    entries_df(spark).where("value is not null").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(entries_df(spark).schema).parquet(src)
    q = stream_differences(stream).writeStream.format("memory").queryName("diffs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("diffs").count() == 2
    q = stream_duplicates(stream).writeStream.format("memory").queryName("dups").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.line, r.first_seen_line) for r in spark.table("dups").collect()] == [(2, 1)]


def test_entry_point(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_reports_correct_spelling(spark):
    from glyphmill.operators.report import differences, routed
    from glyphmill.operators.spelling import check_spelling
    from glyphmill.sources.sinks import rewritten_lines

    lexicon = spark.createDataFrame([("please", 9), ("select", 9), ("order", 9)], "word string, freq bigint")
    spelling = lexicon, spark.createDataFrame([], "word string")
    rows = spark.createDataFrame([(1, "a_en.js", 1, "k", "Please selcet order", "en")], "entry_id bigint, file string, line int, key string, value string, lang_code string")
    assert [(r.after, r.categories) for r in differences(rows, spelling=spelling).collect()] == [("Please select order", "Spelling (dictionary correction)")]
    r = routed(rows, hits=check_spelling(rows, *spelling), spelling=spelling).first()
    assert (r.category, r.n_spelling, r.suggested, r.changes_applied) == ("Spelling", 1, "Please select order", "Spelling (dictionary correction)")
    lines = spark.createDataFrame([("a_en.js", 1, 'languageResource.k = "Please selcet order";', "en")], "file string, line int, raw string, lang_code string")
    assert rewritten_lines(lines, spelling=spelling).first().text == 'languageResource.k = "Please select order";'
