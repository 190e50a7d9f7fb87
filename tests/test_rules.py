"""Golden cases of the fix and detection rules, and a plain model of single steps."""

import re

import pytest
from pyspark.sql import functions as F

from glyphmill.operators.detect import RULES, Context, detect, issues_of
from glyphmill.operators.fix import STEPS, fix, step_changes

CONTEXT = Context(
    glossary=tuple(
        {
            "ip": "IP", "sop": "SOP", "hu": "HU", "po": "PO", "fg": "FG", "qc": "QC", "sscc": "SSCC", "drl": "DRL", "idh": "IDH",
            "order number": "Order Number", "process order number": "Process Order Number", "barcode id": "Barcode ID",
            "baking": "Baking", "flash-off": "Flash-Off", "hold/resume": "Hold/Resume",
        }.items()
    ),
    mixed=("iPAS",),
)

GOLDEN = [
    (" Save  order ", "Save order"),
    ("No.Of items", "Number of items"),
    ("No. of pallets selected", "Number of pallets selected"),
    ("has already been handovers to the line", "Has already been handed over to the line"),
    ("View recent handovers", "View recent handovers"),
    ("formulaID missing", "Formula ID missing"),
    ("Scan barcodeID", "Scan Barcode ID"),
    ("SSCCID missing", "SSCCID missing"),
    ("Recipe missing, Please check", "Recipe missing, please check"),
    ("resource,Please check", "Resource, please check"),
    ("for the plant .please contact administrator.", "For the plant. Please contact administrator."),
    ("logo.png file uploaded", "Logo.png file uploaded"),
    ("Please wait...", "Please wait..."),
    ("Order saved..", "Order saved."),
    ("Order saved!!", "Order saved!"),
    ("waiting for signals, Are you sure you want to go on?", "Waiting for signals. Are you sure you want to go on?"),
    ("Fail to add comment", "Failed to add comment"),
    ("This will fail to load", "This will fail to load"),
    ("iPAS started successfully", "iPAS started successfully"),
    ("Confirm the order. please proceed", "Confirm the order. Please proceed"),
    ("Failed to load pallet Info", "Failed to load pallet info"),
    ("No Images found", "No images found"),
    ("Please Confirm", "Please Confirm"),
    ("Please Hold/Resume the Process", "Please Hold/Resume the process"),
    ("click Confirm to proceed", "Click Confirm to proceed"),
    ("Oven Capacity Limit Exceeds the Maximum Number of Baking Activities Allowed in Parallel for Selected Oven", "Oven capacity limit exceeds the maximum number of Baking activities allowed in parallel for selected oven"),
    ("idh label missing", "IDH label missing"),
    ("Order done, Process Order Number", "Order done, Process Order Number"),
    ("Start process order number", "Start Process Order Number"),
    ("label printed on po", "Label printed on PO"),
    ("No  IP !", "No IP!"),
    ("Ouvrir le fichier !", "Ouvrir le fichier!"),
    ("see files .gif or .png", "See files.gif or.png"),
    ("", ""),
    ("   ", ""),
]


def test_golden_fixes(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(GOLDEN)], "id int, value string")
    got = {r.id: r.fixed for r in fix(df, context=CONTEXT).select("id", "fixed").collect()}
    wrong = [(v, got[i], want) for i, (v, want) in enumerate(GOLDEN) if got[i] != want]
    assert not wrong


def test_labels_follow_steps(spark):
    df = spark.createDataFrame([("No.Of items",), ("Order saved",), (" a  b !",)], "value string")
    labels = [r.labels for r in fix(df, context=CONTEXT).collect()]
    assert labels[0] == ["Grammar (No.Of casing)", "Terminology (No. of -> number of)", "Grammar (capitalize sentence start)"]
    assert labels[1] == []
    assert labels[2] == ["Spacing (trim)", "Spacing (double space)", "Spacing (space before punctuation)", "Grammar (capitalize sentence start)"]


@pytest.mark.parametrize("rule", [r.id for r in RULES])
def test_rules_take_nulls_and_empty_tables(spark, rule):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "x" * 5000, None)], "entry_id int, value string, lang_code string")
    assert issues_of(df, rule).where("entry_id = 1").count() == 0
    assert issues_of(df.where("false"), rule).count() == 0


@pytest.mark.parametrize(
    "rule,value,lang,n",
    [
        ("d01_trim", "a ", "en", 1), ("d02_double_space", "a  b", "de", 1), ("d03_missing_space", "a.b", "en", 1), ("d03_missing_space", "a.png", "en", 0),
        ("d04_space_before_stop", "a ,b", "fr", 1), ("d05_space_before_mark", "a !", "en", 1), ("d05_space_before_mark", "a !", "fr", 0), ("d06_french_space", "a!", "fr", 1),
        ("d07_repeated_mark", "a!!", "en", 1), ("d07_repeated_mark", "a!?", "en", 0), ("d08_double_period", "a..", "en", 1), ("d08_double_period", "a...", "en", 0),
        ("d09_no_of_glued", "No.Of a", "en", 1), ("d10_no_of_case", "No. Of a", "en", 1), ("d10_no_of_case", "No.Of a", "en", 0),
        ("d11_comma_splice", "Wait, Are you sure?", "en", 1), ("d11_comma_splice", "Wait, Area one?", "en", 0), ("d12_fail_to", "Fail to add", "en", 1), ("d12_fail_to", "It may fail to add", "en", 0),
        ("d13_sentence_case", "one two three. four", "unknown", 2), ("d13_sentence_case", "one", "en", 0), ("d14_comma_case", "a, Please b", "en", 1),
        ("d15_mixed_case", "Failed to load pallet Info", "en", 1), ("d16_title_case", "Start The New Order Today", "en", 1), ("d16_title_case", "Start The New Order Today", "de", 0),
        ("d17_repeated_word", "the the order", "de", 1), ("d17_repeated_word", "[x] [x] a", "en", 0), ("d17_repeated_word", "no no", "en", 0), ("d17_repeated_word", "done. Done", "en", 1),
        ("d18_passive", "has been handover", "en", 1), ("d19_glossary", "the ip and po", "en", 2), ("d19_glossary", "post the ip IP", "en", 0),
        ("d20_number_of", "no. of items", "en", 1), ("d21_identifier", "formulaID and SSCCID", "en", 1),
    ],
)
def test_rule_counts(spark, rule, value, lang, n):
    df = spark.createDataFrame([(1, value, lang)], "entry_id int, value string, lang_code string")
    assert issues_of(df, rule, context=CONTEXT).count() == n


MODEL = {
    "f01_trim": lambda v: re.sub(r"^[\t-\r \x85\xa0 - ]+|[\t-\r \x85\xa0 - ]+$", "", v),
    "f06_double_space": lambda v: re.sub(" {2,}", " ", v),
    "f07_missing_space": lambda v: re.sub(r"([.,!?;:])(?=[A-Za-z])(?!(?:gif|png|jpe?g|pdf|csv|xlsx?)\b)", r"\1 ", v),
    "f09_space_before_stop": lambda v: re.sub(r"\s+([,.])", r"\1", v),
    "f11_repeated_mark": lambda v: re.sub(r"([!?])\1+", r"\1", v),
    "f12_double_period": lambda v: re.sub(r"(?<!\.)\.\.(?!\.)", ".", v),
}


def test_steps_agree_with_a_plain_model(spark):
    import random

    rng = random.Random(5)
    values = ["".join(rng.choice("  \t.,!?;:abPgifn[]'\"é") for _ in range(rng.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(values)), "entry_id int, value string")
    for step, model in MODEL.items():
        got = {r.entry_id: r.after for r in step_changes(df, step).collect()}
        want = {i: model(v) for i, v in enumerate(values) if model(v) != v}
        assert got == want, step


def test_detection_and_fixing_share_their_gate(spark):
    values = [v for v, _ in GOLDEN if v.strip()]
    df = spark.createDataFrame([(i, v, "en") for i, v in enumerate(values)], "entry_id int, value string, lang_code string")
    flagged = {r.entry_id for rule in ("d15_mixed_case", "d16_title_case") for r in issues_of(df, rule, context=CONTEXT).collect()}
    changed = {r.entry_id for r in step_changes(df, "f16_sentence_case", context=CONTEXT).collect()}
    assert changed == flagged


def test_plan_stays_small(spark):
    df = spark.createDataFrame([(1, "a", "en")], "entry_id int, value string, lang_code string")
    plan = fix(detect(df, context=CONTEXT), context=CONTEXT)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 1_500_000
    assert len(STEPS) == 17 and F is not None
