"""Canonical texts: equal looks have one, different looks have two, however rows are spread."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import lookalikes as L

WORDS = ["scope", "сейф", "Не", "He", "как", "open", "für", "naïve", "код", "και", "センサー", "นำ"]
CANON = L.Canonizer(WORDS)
SAME = {"o": "оο\uff4f", "e": "е\uff45", "c": "сϲ", "p": "рρ", "a": "аα", "k": "\uff4b", "H": "НΗ", "\\": "\uff3c", "n": "\uff4e", " ": "\u00a0\u3000"}


def disguise(text, rng):
    """The same look with other characters, parts taken apart and invisible characters between."""
    import unicodedata

    out = []
    for c in unicodedata.normalize("NFD", text) if rng.random() < 0.5 else text:
        out.append(rng.choice(SAME[c]) if c in SAME and rng.random() < 0.5 else c)
        if rng.random() < 0.1:
            out.append(rng.choice("\u200b\u2060\ufeff"))
    return "".join(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*WORDS, "ѕсоре", "kak", "\\nHe", "Осталось", "à", "file-7", "ﬁ", "😀", "²", "…"]), st.text(max_size=6)), max_size=5), st.integers(0, 1000))
def test_equal_looks_have_one_canonical_text(words, seed):
    text = " ".join(words)
    other = disguise(text, random.Random(seed))
    assert L.skeleton(text) == L.skeleton(other)
    assert CANON.canonical(text) == CANON.canonical(other)
    assert L.skeleton(CANON.canonical(text)) == L.skeleton(text)
    assert CANON.canonical(CANON.canonical(text)) == CANON.canonical(text)


def test_the_vocabulary_decides_the_spelling():
    russian, latin = L.Canonizer(["Не", "He"]), L.Canonizer(["He", "Не"])
    assert {russian.canonical(t) for t in ("He", "Не", "Нe")} == {"Не"} and {latin.canonical(t) for t in ("He", "Не", "Нe")} == {"He"}
    assert L.Canonizer([]).canonical("Нe") == "He" and L.Canonizer([]).canonical("Oстaлось") == "Осталось" and L.Canonizer([]).canonical("ѕсоре") == "scope"


def test_canonical_texts_of_the_tables(spark, sf):
    df = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/parse_entries.parquet")
    texts = {r.value: r.canonical for r in L.canonical_texts(df.repartition(3)).collect()}
    assert texts == {r.value: r.canonical for r in L.canonical_texts(df.repartition(7)).collect()}
    by_look, by_text = {}, {}
    for value, canonical in texts.items():
        look = L.skeleton(value)
        assert by_look.setdefault(look, canonical) == canonical and by_text.setdefault(canonical, look) == look
    assert sum(v != c and c != L.skeleton(v) for v, c in texts.items()) > 100  # spellings that the table alone does not give


def test_pairs_equal_brute_force_with_a_hot_look(spark):
    rng = random.Random(4)
    values = ["He 1", "Не 1", "Нe 1", "open", "оpen", "Open", "12", "１２", None, ""]
    rows = [(i, rng.choice(["K_1", "k1", "K2", "k_3", None]), rng.choice([values[0], rng.choice(values)])) for i in range(120)]
    df = spark.createDataFrame([(i, k, v, 1, "x", "y") for i, k, v in rows], "entry_id bigint, key string, value string, s1 int, w string, a string")
    got = [tuple(r) for r in L.p6_found(df).collect()]
    ready = [(i, k.lower().replace("_", ""), v) for i, k, v in rows if k is not None and v is not None and any(map(str.isalpha, v))]
    want = {(i, j) for i, k, v in ready for j, m, w in ready if i < j and k != m and v != w and L.skeleton(v) == L.skeleton(w)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
