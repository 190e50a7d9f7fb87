"""Problem 6: text that looks the same but differs in its characters.

Every token is compared with a vocabulary of frequent clean words.  The words
form a trie; a weighted edit automaton runs along it and takes characters that
look alike, and characters that are invisible, at no cost, all other edits at
cost one.  With the default budget of zero only words of equal looks are
reached; the most frequent one, ties by the word itself, is the token's canonical
spelling, whether the token is plain ASCII or not.  Tokens that reach no word, and
everything between tokens, are normalised by a table of characters: letters that
look alike become those of the script that the token's other letters call for,
Latin where there are none.  Both depend on the looks of a token only, so values of
equal looks, and no others, have equal canonical texts; these make the groups of
``p6_found``.

Made uniform: width, joined and separate forms (composed and decomposed letters,
ligatures, presentation forms), invisible characters, kinds of space and
look-alike letters of Latin, Greek and Cyrillic.  Kept apart: accents, letter
case, digits, punctuation, superscripts, fractions and symbols.

Plan.  The vocabulary is the ``MAX_WORDS`` most frequent clean words by exact counts,
combined per task, so it does not depend on how rows are spread.  Rows of plain
ASCII never leave the JVM, but for those with a word that has a more frequent
spelling in another script; the others take one narrow Arrow pass in which every
distinct token is looked up once per worker.  Rows shrink to four hashes.  One
combined aggregation finds the looks with two different values and two different
keys, and only their rows go on.  Values of one look are paired first, rows are
joined to their values' pairs, so rows of one value are never compared.

Defined cases: null values, and values without a letter, have no pairs; null
keys are no keys, so their rows have no pairs either; empty tables give no rows;
repeated rows with equal values are no pairs; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.plans import stage

MAX_WORDS = 20_000
MEMO = 200_000

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("асԁеһіјӏкорԛѕуѵԝхАВЕԌНІЈКМОРСԚЅТУѴԜХҮӀ", "acdehijlkopqsyvwxABEGHIJKMOPCQSTYVWXYI"))
GREEK = dict(zip("αινορυγκϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "aivopuykcjABEZHIKMNOPTYXCJ"))
OTHER = dict(zip("µօսհցոԼՕՍ", "μouhgnLOU"))
LOOKS = CYRILLIC | GREEK | OTHER
#: The first letter of each script that has a given look.
BACK = {"CYRILLIC": {v: k for k, v in reversed(CYRILLIC.items())}, "GREEK": {v: k for k, v in reversed(GREEK.items())}}
#: Format characters that are visible (signs of Arabic and Syriac numbers).
VISIBLE_FORMATS = set("؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd")
#: Invisible characters of other categories: joiner, fillers, vowel and variation selectors.
INVISIBLE = set("͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ") | {chr(c) for c in (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))}
_FOLDED_TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")


@lru_cache(maxsize=100_000)
def units(c: str) -> str:
    """Table form of one character: decomposed, invisible ones dropped, look-alikes as Latin letters."""
    category = unicodedata.category(c)
    if c in INVISIBLE or (category == "Cf" and c not in VISIBLE_FORMATS):
        return ""
    if category in ("Zs", "Zl", "Zp"):
        return " "
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in _FOLDED_TAGS or "ﬀ" <= c <= "ﭏ":
        c = unicodedata.normalize("NFKC", c)
    if c == "ำ":
        return "ํา"
    if c == "ຳ":
        return "ໍາ"
    return "".join(LOOKS.get(x, x) for x in unicodedata.normalize("NFD", c))


def skeleton(text: str) -> str:
    """Form in which texts of equal looks are equal."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(map(units, text)))


def script(c: str) -> str:
    """Script of a letter as the first word of its name; empty for other characters."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def clean(word: str) -> bool:
    """A spelling that may be canonical: composed, of one script, without folded or invisible characters."""
    if word.isascii():
        return True
    if word != unicodedata.normalize("NFC", word) or len({s for s in map(script, word) if s}) > 1:
        return False
    return all(u and not any(t in unicodedata.decomposition(c) for t in _FOLDED_TAGS) and not "ﬀ" <= c <= "ﭏ" for c, u in ((c, units(c)) for c in word))


class Trie:
    """Vocabulary trie over decomposed characters, with edges grouped by look."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        self.rank: dict[str, int] = {}
        for i, w in enumerate(words):
            if not clean(w) or w in self.rank:
                continue
            self.rank[w] = i
            node = self.root
            for c in unicodedata.normalize("NFD", w):
                for look in units(c):
                    node = node.setdefault(look, {}).setdefault(c, {})
            node.setdefault(None, []).append(w)

    def matches(self, token: str, budget: int = 0) -> list[tuple[int, str]]:
        """(cost, word) of the words the automaton reaches within the budget."""
        looks = "".join(map(units, token))
        found: dict[str, int] = {}
        stack = [(self.root, {0: 0})]
        while stack:
            node, states = stack.pop()
            if budget:  # leaving out characters of the token costs one each
                for p in range(len(looks)):
                    if p in states and states[p] < budget:
                        states[p + 1] = min(states.get(p + 1, budget + 1), states[p] + 1)
            if len(looks) in states:
                for w in node.get(None, ()):
                    found[w] = min(found.get(w, budget + 1), states[len(looks)])
            if budget:
                choices = [x for x in node if x is not None]
            else:
                choices = {looks[p : p + 1] for p in states} & node.keys()
            for look in choices:
                following: dict[int, int] = {}
                for p, cost in states.items():
                    steps = [(p + 1, cost)] if looks.startswith(look, p) else []
                    if cost < budget:
                        steps += [(p + 1, cost + 1), (p, cost + 1)]
                    for q, k in steps:
                        if q <= len(looks):
                            following[q] = min(following.get(q, budget + 1), k)
                if following:
                    stack.extend((child, dict(following)) for child in node[look].values())
        return sorted(((k, w) for w, k in found.items()), key=lambda x: (x[0], self.rank[x[1]]))


def table_form(look: str) -> str:
    """Spelling of a look that no word of the vocabulary has: Cyrillic or Greek where its letters with no Latin look are of that script."""
    if look.isascii():
        return look
    parts = unicodedata.normalize("NFD", look)
    scripts = {s for s in map(script, parts) if s} - {"LATIN"}
    back = BACK.get(scripts.pop()) if len(scripts) == 1 else None
    if back is None or any(script(c) == "LATIN" and c not in back for c in parts):
        return look
    return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in parts))


class Canonizer:
    """Canonical text of values; remembers tokens, up to ``MEMO`` of them."""

    def __init__(self, words: list[str]):
        import re

        self.trie = Trie(words)
        self.memo: dict[str, str] = {}
        plane = [chr(c) for c in range(0x10000)]
        joined = "".join(c for c in plane if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") or c in INVISIBLE)
        marks = re.escape(joined)
        back, letter = (re.escape("".join(c for c in plane if units(c) in some)) for some in (("\\",), ("n", "r", "t")))
        #: words; an escape such as \\n stands between words
        self.split = re.compile(rf"([{back}][{marks}]*[{letter}]|[^\W_](?:[^\W_]|[{marks}])*)").split
        #: characters of words that stand for several words
        self.several = {ord(c): units(c) for c in plane if c.isalnum() and not all(x.isalnum() or x in joined for x in units(c))}
        #: ASCII words with a more frequent spelling
        self.other = {look: best for look, best in ((skeleton(w), self.trie.matches(w)[0][1]) for w in self.trie.rank if not w.isascii()) if look.isascii() and best != look}

    def part(self, part: str) -> str:
        got = self.memo.get(part)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            if part.isascii():
                got = self.other.get(part, part)
            else:
                found = self.trie.matches(part) if part[:1].isalnum() else []
                got = found[0][1] if found else table_form(skeleton(part))
            self.memo[part] = got
        return got

    def canonical(self, value: str) -> str:
        if value.isascii():
            return "".join(map(self.part, self.split(value))) if self.other else value
        return "".join(map(self.part, self.split(value.translate(self.several))))

    def apart(self) -> str:
        """Pattern of the ASCII values that are not their own canonical texts."""
        return r"(?<![A-Za-z0-9])(?:" + "|".join(sorted(self.other)) + r")(?![A-Za-z0-9])"


def vocabulary(df: DataFrame, value_col: str = "value", limit: int = MAX_WORDS) -> list[str]:
    """Frequent clean words, most frequent first by exact counts; at most ``limit``."""

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        from glyphmill.llm.words import word_finder

        words, held = word_finder(), Counter()

        def flush():
            good = [(w, n) for w, n in held.items() if sum(map(str.isalpha, w)) > 1 and not any(c.isdigit() for c in w) and clean(w)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in good], pa.string()), pa.array([n for _, n in good], pa.int64())], ["word", "n"])

        for batch in batches:
            for v in batch.column(0).to_pylist():
                held.update(words(v))
            if len(held) > 200_000:
                yield flush()
        yield flush()

    counts = df.select(F.col(value_col)).where(F.col(value_col).isNotNull()).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(limit).collect()]


def canonical_texts(df: DataFrame, id_col: str = "entry_id", value_col: str = "value", words: list[str] | None = None) -> DataFrame:
    """``(id_col, value, canonical, looks)`` of every row with a non-null value."""
    rows = df.select(F.col(id_col), F.col(value_col).alias("value")).where("value is not null")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(df, value_col) if words is None else words)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        canon = _canonizer(shared.value)
        for batch in batches:
            texts = [canon.canonical(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(skeleton, texts)), pa.string())], [id_col, "value", "canonical", "looks"])

    plain = _plain(shared.value)
    ascii_rows = rows.where(plain).select(id_col, "value", F.col("value").alias("canonical"), F.col("value").alias("looks"))
    other = rows.where(~plain).mapInArrow(run, f"`{id_col}` {id_type}, value string, canonical string, looks string")
    return ascii_rows.unionByName(other)


def _plain(words: list[str]):
    """Condition: values that are their own canonical texts, as their characters and words tell."""
    canon = _canonizer(words)
    plain = F.col("value").rlike(r"^\p{ASCII}*$")
    return plain & ~F.col("value").rlike(canon.apart()) if canon.other else plain


_made: dict[int, Canonizer] = {}


def _canonizer(words: list[str]) -> Canonizer:
    """The worker's canonizer for these words; kept from task to task."""
    key = hash(tuple(words))
    if key not in _made:
        _made.clear()
        _made[key] = Canonizer(words)
    return _made[key]


def look_pairs(df: DataFrame, id_col: str = "entry_id", key_col: str = "key", value_col: str = "value") -> DataFrame:
    """``(id_a, id_b)``: pairs with different keys and different values of equal looks."""
    keyed = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.translate(F.lower(F.col(key_col)), "_", "")).alias("k")).alias("row"), F.col(value_col).alias("value"), F.col(key_col).alias("key"))
    keyed = keyed.where(F.col("key").isNotNull() & F.col("value").rlike(r"\p{L}"))
    words = vocabulary(df, value_col)
    ids = keyed.select("row.id", "row.k", "value")
    texts = _with_canonical(ids, words, df.sparkSession)
    rows = stage(texts.select("id", "k", F.xxhash64("value").alias("v"), F.xxhash64("canonical").alias("s1"), F.xxhash64(F.lit(7), "canonical").alias("s2")), "looks")
    several = rows.groupBy("s1", "s2").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.min("k").alias("k0"), F.max("k").alias("k1"))
    several = stage(several.where("v0 <> v1 and k0 <> k1").select("s1", "s2"), "alike")
    few = stage(rows.join(several, ["s1", "s2"], "left_semi"), "alike-rows")
    values = few.select("s1", "s2", "v").distinct()
    pairs = stage(values.join(values.withColumnRenamed("v", "w"), ["s1", "s2"]).where("v < w"), "alike-values")
    a = few.join(pairs, ["s1", "s2", "v"]).select("s1", "s2", "w", F.col("id").alias("a"), F.col("k").alias("ka"))
    b = few.select("s1", "s2", F.col("v").alias("w"), F.col("id").alias("b"), F.col("k").alias("kb"))
    both = a.join(b, ["s1", "s2", "w"]).where("ka <> kb and a <> b")
    return both.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))


def _with_canonical(rows: DataFrame, words: list[str], spark) -> DataFrame:
    """Add ``canonical``, by which looks are told apart."""
    shared = spark.sparkContext.broadcast(words)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        canon = _canonizer(shared.value)
        for batch in batches:
            texts = list(map(canon.canonical, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["id", "k", "value", "canonical"])

    plain = _plain(words)
    return rows.where(plain).withColumn("canonical", F.col("value")).unionByName(rows.where(~plain).mapInArrow(run, f"id {id_type}, k bigint, value string, canonical string"))


def p6_found(df: DataFrame) -> DataFrame:
    return look_pairs(df)
