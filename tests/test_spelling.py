"""The spelling cascade against a plain model, languages, known abbreviations, long words."""

import random

from pyspark.sql import functions as F

from glyphmill.functions import fixed as K
from glyphmill.operators.casing import recaser
from glyphmill.operators.detect import Context
from glyphmill.operators.report import routed, spelling_notes
from glyphmill.operators.spelling import check_spelling, judge, near


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        old, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def model(word, lexicon, custom):
    """Suggestions, whether they are sure, and the step that decides, word by word."""
    low, real = word.lower(), lexicon.__contains__
    if any(low == c + e for c in custom for e in ("", *K.INFLECTIONS)) or low in K.VARIANTS:
        return None
    if low in K.REAL_WORDS:
        return [K.REAL_WORDS[low]], True, "real word"
    if real(low) and (word == low or word.isupper() or word[1:] == low[1:]):
        return None
    if any(low.startswith(p) and len(low) >= len(p) + 3 and real(low[len(p) :]) for p in K.PREFIXES):
        return None
    if any(low.endswith(x) and real(low[: -len(x)] + y) for a, b in K.SUFFIX_PAIRS for x, y in ((a, b), (b, a))):
        return None
    known = (K.CONTRACTIONS | K.TYPOS).get(low)
    if known:
        return [known], True, "known fix"
    if real(low):
        return [low], True, "stray capital"
    swaps = {low[:i] + low[i + 1] + low[i] + low[i + 2 :] for i in range(len(low) - 1) if low[i] != low[i + 1]}
    swaps = [x for x in swaps if real(x)]
    if len(swaps) == 1:
        return swaps, True, "transposition"
    raw = sorted((distance(low, w), -n, w) for w, n in lexicon.items() if len(low) >= 3 and len(w) >= 2 and distance(low, w) <= 2)[:3]
    best = raw[0][0] if raw else 99
    domain = sorted((distance(low, c), c) for c in custom if len(c) >= 4)
    if domain and domain[0][0] <= 2 and domain[0][0] < best and [d for d, _ in domain].count(domain[0][0]) == 1:
        return [domain[0][1]], True, "domain word"
    if best <= 2:
        return [w for _, _, w in raw], True, "near word"
    cut = next((i for i in range(1, len(word)) if word[i - 1].islower() and word[i].isupper()), 0)
    if cut >= 4 and len(word) - cut >= 4 and real(low[:cut]) and real(low[cut:]):
        return [word[:cut] + " " + word[cut:]], True, "camel split"
    splits = [(low[:i], low[i:]) for i in range(3, len(low) - 2) if real(low[:i]) and real(low[i:])]
    if word == low and len(low) >= 6 and len(splits) == 1:
        return [" ".join(splits[0])], True, "compound split"
    return [w for _, _, w in raw], False, "open"


def test_cascade_equals_a_plain_model(spark):
    rng = random.Random(8)
    base = "load please enter pallet info tag relevant event recipe failed order save search canned color colour size counter weight realize lock unlocked gate side".split()
    lexicon = {w: rng.randint(1, 40) for w in base}
    custom = ["preweigh", "groupset", "kanban", "hu"]
    words = {"caned", "sech", "dont", "falied", "enTer", "LOAD", "Load", "PalletInfo", "taginfo", "cancelled", "groupsets", "sidegate", "preweihg", "tga", "ordr"}
    for _ in range(250):
        w = list(rng.choice(base + custom) + rng.choice(["", "", rng.choice(base)]))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "e", w[i] * 2])
        word = "".join(w)
        word = rng.choice([word, word, word.capitalize(), word[:3] + word[3:].capitalize()])
        if len(word) >= 3 and not word.isupper() or word == "LOAD":
            words.add(word)
    lex = spark.createDataFrame(list(lexicon.items()), "word string, freq bigint")
    got = {r.word: (r.suggestions, r.confident, r.step) for r in judge(spark.createDataFrame([(w,) for w in words], "word string"), lex, spark.createDataFrame([(c,) for c in custom], "word string")).collect()}
    want = {w: model(w, lexicon, custom) for w in words}
    assert got == {w: v for w, v in want.items() if v is not None}
    assert len({step for _, _, step in got.values()}) >= 8


def test_long_words_are_compared_by_pieces(spark):
    rng = random.Random(3)
    targets = ["".join(rng.choice("ab") for _ in range(rng.randint(17, 30))) for _ in range(40)] + ["a" * 200]
    words = []
    for t in targets:
        w = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "b", "ab"])
        words.append("".join(w))
    got = {(r.word, r.target, r.d) for r in near(*(spark.createDataFrame([(x,) for x in sorted(set(y))], "word string") for y in (words, targets))).collect()}
    assert got == {(w, t, distance(w, t)) for w in words for t in targets if distance(w, t) <= 2}


def test_languages_without_a_lexicon_are_not_checked(spark):
    lex = spark.createDataFrame([("de", "halle", 9), ("en", "hall", 9), ("en", "order", 9)], "lang string, word string, freq bigint")
    custom = spark.createDataFrame([], "word string")
    rows = [(1, "f", 1, "k", "Hlale", "de"), (2, "f", 2, "k", "Hlale", "unknown"), (3, "f", 3, "k", "ordre ccp", "en"), (4, "f", 4, "k", "ccp", "en")]
    df = spark.createDataFrame(rows, "entry_id int, file string, line int, key string, value string, lang_code string")
    keys = spark.createDataFrame([("ccp",)], "word string")
    hits = {(r.entry_id, r.word) for r in check_spelling(df, lex, custom, lang="lang_code", keys=keys).collect()}
    assert hits == {(1, "Hlale"), (3, "ordre")}
    report = {r.entry_id: (r.n_spelling, r.fixed) for r in routed(df, Context(glossary=(("ccp", "CCP"),)), spelling=(lex, custom)).collect()}
    assert report == {1: (1, "Halle"), 2: (None, "Hlale"), 3: (1, "order CCP"), 4: (0, "CCP")}
    assert [r.note for r in spelling_notes(df.where("entry_id = 2"), lex).collect()] == ["Note: no spelling dictionary installed for 'unknown' - spelling not checked, sheet reflects that, not 'no errors'"]


def test_votes_and_text_of_casing():
    run = recaser((("cold store", "Cold Store"), ("po", "PO")), ("kanban",))
    assert run("Save the New Order now") == ("m", "Save the new order now")
    assert run("Print Batch Label") == ("t", "Print batch label")
    assert run("Print PO Kanban list") == ("-", "Print PO Kanban list")
    assert run("Open the Cold Store and Check-In") == ("-", "Open the Cold Store and Check-In")
    assert run("Now click on Save to Continue work") == ("m", "Now click on Save to continue work")
    assert run("No. Of Items") == ("-", "No. Of Items") and F is not None
