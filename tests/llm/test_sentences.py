"""Sentence boundaries: abbreviations count in their own language only."""

import time

import pytest

from glyphmill.llm import sentences as S


def cut(text, label=None):
    return [text[a:b] for a, b in S.sentence_spans(text, label)]


@pytest.mark.parametrize("label", [None, "en", "en_GB", "fi", "hu", "fr", "??"])
@pytest.mark.parametrize(
    "text,n",
    [
        ("Width is 5 mm. Check the belt.", 2), ("The operator is ill. Call the supervisor.", 2), ("Use the new kb. Then restart.", 2), ("Press the button for the env. Then wait.", 2),
        ("I am 19. Next one is on the list.", 2), ("The weight is approx. 5 kg. Check it.", 2), ("Das gilt ab dem 3. Tag für die Waage.", 1), ("Leveys on noin. 5 mm. leveä ja se on hyvä.", 1),
    ],
)
def test_abbreviations_of_other_languages_end_sentences(text, n, label):
    assert len(cut(text, S.label_of(label))) == n


@pytest.mark.parametrize(
    "text,n",
    [
        ("Использовать прибл. 5 кг, см. рис. 3. Далее.", 2), ("センサーはVer. 3.5以降で対応します。次へ。", 2), ("Zkontrolujte např. Pole na stránce a obr. 5 pro jistotu.", 1),
        ("Gebruik ca. 5 kg per bak, bijv. Uit partij nr. 9, voor de pallet. Klaar.", 2), ("A doboz kb. 5 kg, és pl. Nem nehéz. Kész.", 2), ("Ver p. ej. La línea del palé y el núm. 5 de la caja.", 1),
    ],
)
def test_own_abbreviations_do_not(text, n):
    assert len(cut(text)) == n


def test_numbers_of_digits_matter_for_ordinals_only():
    assert len(cut("Gültig seit 19. Neue Werte sind in der Liste.")) == 1 and len(cut("Gültig seit 2019. Neue Werte sind in der Liste.")) == 2


def test_labels_are_read_by_their_language():
    assert [S.label_of(x) for x in ("en", "EN_gb", " de-AT ", "xx", "", None, "??", "unknown", "fi\n")] == ["en", "en", "de", None, None, None, None, None, "fi"]


def test_rows_without_a_label_column(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "")], "entry_id bigint, value string")
    assert [tuple(r) for r in S.p3_found(df).collect()] == [(1, 5)]
    labelled = spark.createDataFrame([(1, "x ill. Y", "hu", 5), (2, "x ill. Y", "en", 6)], "entry_id bigint, value string, lang string, id int")
    assert {tuple(r) for r in S.p3_found(labelled).collect()} == {(2, 7)}


def test_time_grows_with_length_only():
    def took(n):
        text = "“ (One. Two approx. 5 kg e.g. \"three\" ; " * n
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            S.sentence_starts(text)
            best = min(best, time.perf_counter() - began)
        return best

    took(10)
    assert took(8_000) < 14 * took(2_000) + 0.05  # four times the text; quadratic time would be sixteen times
