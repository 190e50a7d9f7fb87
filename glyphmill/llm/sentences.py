"""Problem 3: sentence boundaries across languages and scripts.

Standard rules on character properties: terminators (STerm, ATerm) and closing
characters (Close) of all scripts are read from the Unicode sentence-break
property; a boundary follows a terminator, its closing characters and the space
after them.  Full stops are held back by abbreviations of the sentence's own language,
by decimals, file names, initials and ellipses before lower case.  The language of a
sentence is that of its script or of most of its frequent words; the delivered label
has a vote, so a wrong label is outvoted by the text.  A quotation or
bracket that opens inside a sentence belongs to it; one that opens a sentence is
looked into unless the sentence goes on after it.  In scripts without sentence
marks a space between two complete statements is a boundary.  Line-break escapes
and spaced separators end a sentence too; they belong to none.

Plan: one narrow pass over the rows; values without any candidate for a boundary
are settled by one search.  Whole values are read, in time linear in their length.

Defined cases: null values have no sentences; a value of white space and
separators only has none; any other value without a boundary is one sentence; a
value made of named fields is one sentence; repeated rows give repeated rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.lookalikes import skeleton


def _forms(text: str) -> frozenset[str]:
    return frozenset(skeleton(unicodedata.normalize("NFC", w)) for w in text.split())


# Abbreviations of each language, without the last full stop, by what may follow them: those that never
# end a sentence; those that stand before a number, a code or a single letter; those that end one before a capital only.
ABBREVIATIONS = {
    "en": ("approx e.g i.e vs cf st dr mr mrs ms prof gen rev ver dept incl resp viz", "no nos nr fig figs sec sect ch chap p pp vol art tab eq ed tel", "etc inc co ltd corp jr min max a.m p.m"),
    "de": ("ca z z.b d.h u.a o.ä bzw vgl lt evtl ggf inkl zzgl sog st dr prof resp", "nr nrn abb kap s ziff fig art tab bd tel", "usw usf std sek min max co etc"),
    "fr": ("env av mme mlle dr prof", "n º no nos fig figs p pp chap sect vol art tab éd tél", "etc max min"),
    "es": ("aprox dpto depto sr sra avda prov dr dra prof", "n º no núm num nos fig figs pág pag págs p pp cap sec art vol tel ed", "etc máx mín a.m p.m"),
    "pt": ("aprox dpto depto sr sra avda av prov dr dra prof", "n º no núm num fig figs pág pag págs p pp cap cáp sec art vol tel ed", "etc máx mín"),
    "it": ("ecc.le sig sig.ra dott ca prof", "n º no num nr fig figg pag p pp cap sez art vol tab tel ed", "ecc etc max min"),
    "nl": ("bijv o.a d.w.z blz m.b.t t.o.v ca resp dr", "nr nrs afb fig hfst kap p blz art tab tel", "enz etc max min"),
    "pl": ("np tj zob m.in tzn tzw godz ok dr prof", "nr rys rozdz str s p art tab ok tel", "itp itd etc maks min"),
    "ru": ("прибл напр см т.е т.к ср им", "рис гл стр п разд № табл тел", "т.д т.п др пр г тыс млн руб"),
    "el": ("περ π.χ βλ δηλ κ", "αρ εικ κεφ σελ τηλ", "κ.λπ κλπ"),
    "hi": ("सं डॉ श्री प्रो कि.मी रु", "पृ क्र चि", ""),
    "cs": ("např tzn tzv resp popř", "č obr kap str s tel", "atd apod"),
    "hu": ("pl kb ún ill", "ábra fej sz old tel", "stb"),
    "fi": ("esim ks noin mm", "kuva luku s nro kl puh", "jne ym"),
    "sv": ("t.ex bl.a ca s.k d.v.s", "nr fig kap s kl tel", "osv"),
}
# Words by which a language of Latin script is told from the others.
FREQUENT = {
    "en": "the a an i am me my we he she they of to in on for is are was were be been with this that these and or not you your it its from by at as if when before after has have will can cannot more than then every still",
    "de": "der die das den dem des ein eine einen einem einer und oder nicht ist sind war wurde werden wird mit für auf im am an zu zum zur von vom bei bis nach vor sie ihre es aus als wenn wie noch nur mehr",
    "fr": "le la les un une des du de et ou ne pas est sont été dans sur pour par avec au aux à en ce cette ces vous votre vos il elle qui que plus avant après selon",
    "es": "el la los las un una de del y o no es son fue en con por para al se su sus que más antes después está según",
    "pt": "o a os as um uma de do da dos das e ou não é são foi em na nos nas com por para ao se seu sua que mais antes depois está",
    "it": "il lo la i gli le un una uno di del della dei delle e o non è sono in con per da dal al nel alla si che più prima dopo",
    "nl": "de het een en of niet is zijn was in op met voor van naar bij te dat die deze dit uw als wordt worden meer om aan uit",
    "pl": "i w z na do nie jest są się że to dla od po przed oraz lub czy przez jak o za ze niż więcej",
    "cs": "a v z na do ne je jsou se že to pro od po před nebo o za ze než jak s k i",
    "hu": "a az és nem van vagy hogy egy meg is csak el ez ezt még már után előtt",
    "fi": "ja on ei ovat oli tai että se tämä sen kun jos ennen jälkeen mutta myös ole voi kuin",
    "sv": "och att det som en ett på är av för med till den inte i om var eller från",
}
# Letters that one of these languages has and the others have not.
LETTERS = {"de": "ß", "es": "ñ", "pt": "ãõ", "pl": "ąęłńśźż", "cs": "ěřůďťň", "hu": "őű", "sv": "å"}
SETS = {lang: tuple(map(_forms, kinds)) for lang, kinds in ABBREVIATIONS.items()}
SIGNS = {lang: _forms(words) for lang, words in FREQUENT.items()}
#: Words that vote for a language by a letter.
SIGN_LETTERS = {lang: re.compile(f"[{letters}]") for lang, letters in LETTERS.items()}
#: Abbreviations of Latin script inside the sentences of languages that have another script.
SETS["other"] = tuple(map(_forms, ("ver vs", "no nos nr fig figs vol p pp tel", "inc co ltd corp max min")))
#: Languages by the letters that their words have and Latin words do not.
BY_SCRIPT = {"ru": re.compile("[Ѐ-ӿ]"), "el": re.compile("[Ͱ-Ͽἀ-῿]"), "hi": re.compile("[ऀ-ॿ]"), "other": re.compile("[֐-ۿঀ-῿⺀-힣豈-﫿ｦ-ﾟ]")}
KNOWN = frozenset().union(*(forms for kinds in SETS.values() for forms in kinds))
#: Characters of a sentence before a full stop that tell its language, and four times those after it.
AROUND = 320
#: What the label counts in words.
LABEL_VOTES = 1.5
#: Abbreviations only after one of the given words.
AFTER = {"ex": ("p.", "par", "por", "ex."), "ej": ("p.", "por"), "es": ("p.", "ad"), "b": ("z.",), "h": ("d.",), "a": ("u.",), "e": ("т.", "t.", "i."), "д": ("т.",), "п": ("т.",), "ex.": ()}

_PAIRS = {"“": "”“", "„": "“”", "‟": "”", "«": "»", "‹": "›", "‘": "’", "‚": "‘’", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "[": "]", "（": "）", "【": "】", "〔": "〕", "｢": "｣", "»": "«", "›": "‹", "”": "”"}
_BRACKETS = set("([（【〔")
_INVERTED = "¿¡"
_NO_MARKS = "฀-๿຀-໿"  # Thai, Lao
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
#: The rules know digits only as digits: values that differ in their digits, not in their number, have the same boundaries.
DIGITS = re.compile("[1-9]")
MEMO = 100_000
#: Letters a statement in a script without marks must have on either side of a space.
STATEMENT = 8


class Rules:
    """Compiled rules for texts of characters below a limit; made once per worker."""

    def __init__(self, limit: int):
        import regex

        every = "".join(chr(c) for c in (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)) if c < limit)
        sterm = "".join(regex.findall(r"\p{Sentence_Break=STerm}", every)) + "".join(c for c in "…‥｡" if ord(c) < limit)
        aterm = "".join(regex.findall(r"\p{Sentence_Break=ATerm}", every))
        close = "".join(c for c in regex.findall(r"\p{Sentence_Break=Close}", every) if unicodedata.category(c) in ("Pe", "Pf", "Pi", "Ps", "Po")) + "\"'"
        term = re.escape(sterm + aterm)
        self.terms = frozenset(sterm + aterm)
        self.full_stops = frozenset(aterm)
        closing = re.escape("".join(c for c in close if unicodedata.category(c) not in ("Ps",) and c not in "„‚«‹"))
        openers = re.escape("".join(k for k in _PAIRS if ord(k) < limit))
        self.closers = re.compile(rf"(?:\\\"|[{closing}])*")
        gap = r"(?:\s|\\[nrt]|(?<=[\s]|[nrt])[/|–—](?=\s|\\[nrt]))"
        self.gap = re.compile(rf"{gap}*")
        self.lead = re.compile(r"(?:\s|\\[nrt]|[/|](?=\s))*")
        self.candidate = re.compile(rf"[{term}](?:\\\"|[{closing}{term}\s])*(?:\\[nrt]|[^\s{term}{closing}\\\d])|[{term}]\S*\s+\S|\\[nr]|[\n\r]|;\s|[{_NO_MARKS}]\s+\S|\s[/|–—]\s").search
        #: characters that events begin with; space counts in scripts without marks only
        first = rf"{term}\"\\\n\r;{openers}"
        self.triggers = re.compile(rf"[{first}]").search, re.compile(rf"[{first}\s]").search
        self.event = re.compile(
            rf"(?P<term>[{term}]+)|(?P<quote>\\\"|\")|(?P<open>[{openers}])|(?P<line>(?:\\[nr]|[\n\r])+)|(?P<greek>(?<=[Ͱ-Ͽἀ-῿a-zA-Z]);(?=\s|\\n|$))"
            rf"|(?P<space>(?<=[{_NO_MARKS}])\s+(?=[^\W\d_]|[¿¡“„«]))|(?P<sep>(?<=[{_NO_MARKS}])\s+[/|–—]\s+)"
        ).match
        self.skip_open = re.compile(rf"(?:\[\w+\]|\{{\w*\}}|<\w+>|%\w|\\\"|[\s\"'{openers}{_INVERTED}*•·-])*")
        self.unspaced = re.compile(f"[{_UNSPACED}]")
        self.ordinal = re.compile(r"(?:^|[^\w])(?:am|ab|an|bis|das|dem|den|der|des|die|im|jede[mnrs]?|nach|seit|vom|vor|zum|zur) (?:dem |den |der )?\d{1,2}$", re.IGNORECASE)
        self.paired = re.compile(r"[^\W\d_]{1,2}\.")
        self.reference = re.compile(r"[\d(]|[^\W\d_]{1,4}-?\d|[^\W\d_](?![^\W_])|º|№")
        self.cased = re.compile(r"[^\W\d_]+")
        self.no_marks = re.compile(rf"[{_NO_MARKS}]")
        self.latin_words = re.compile(r"(?:[^\W\d_฀-໿]+[\s,]+){2}[^\W\d_฀-໿]{2}")


@lru_cache(maxsize=3)
def _rules(limit: int) -> Rules:
    return Rules(limit)


_BEYOND = re.compile("[\U00010000-\U0010ffff]").search


def rules(text: str) -> Rules:
    """The rules for a text; classes without the characters that it cannot hold are searched much faster."""
    return _rules(0x80 if text.isascii() else 0x110000 if _BEYOND(text) else 0x10000)


def named_fields(value: str) -> bool:
    if ":" not in value and "=" not in value:
        return False
    parts = re.split("[;|,]", value)
    return len(parts) > 1 and all(":" in p or "=" in p for p in parts)


@lru_cache(maxsize=200_000)
def voted(word: str) -> tuple[str, ...]:
    """Languages that a word, in lower case and of uniform look, is a sign of."""
    latin = [lang for lang, signs in SIGNS.items() if word in signs or lang in SIGN_LETTERS and SIGN_LETTERS[lang].search(word)]
    return (*latin, *(lang for lang, letter in BY_SCRIPT.items() if letter.search(word)))


class _Scan:
    def __init__(self, text: str, label: str | None = None):
        self.r = rules(text)
        self.v = text
        self.label = label
        #: start of the sentence that is being read
        self.at = 0
        #: votes of all words, once they are asked for
        self.whole: dict[str, float] | None = None
        self.gone: set[str] = set()
        self.trigger = self.r.triggers[bool(self.r.no_marks.search(text))]

    @cached_property
    def tells(self) -> bool:
        """Whether upper case tells anything in this text."""
        heads = [w[0] for w in self.r.cased.findall(self.v)]
        small = sum(map(str.islower, heads))
        cased = small + sum(c.lower() != c.upper() and not c.islower() for c in heads)
        return not cased or small * 10 >= 3 * cased

    def event(self, at: int):
        """Match of the next place that may end a sentence."""
        trigger, event, v = self.trigger, self.r.event, self.v
        while (m := trigger(v, at)) is not None:
            found = event(v, m.start())
            if found is not None:
                return found
            at = m.start() + 1
        return None

    def closing(self, at: int, opener: str) -> int:
        """Position of the character that closes the opener at ``at``, or -1."""
        v = self.v
        if opener.endswith('"'):
            if opener in self.gone:
                return -1
            j = v.find(opener, at + len(opener))
            if j < 0:
                self.gone.add(opener)
                return -1
            return j + len(opener) - 1
        if opener in "‘”»›" and at and v[at - 1].isalnum():
            return -1
        best = -1
        for c in _PAIRS[opener]:
            if opener + c in self.gone:
                continue
            j = v.find(c, at + 1)
            while j >= 0 and c == "’" and j + 1 < len(v) and v[j + 1].isalpha():
                j = v.find(c, j + 1)
            if j < 0:
                self.gone.add(opener + c)
            elif best < 0 or j < best:
                best = j
        return best

    def ends_inside(self, lo: int, hi: int) -> bool:
        """Whether the text of a quotation ends with a terminator."""
        v = self.v
        while hi > lo and (v[hi - 1].isspace() or v[hi - 1] in "\"”’»)]\\"):
            hi -= 1
        return hi > lo and (v[hi - 1] in self.r.terms or (v[hi - 1] == ";" and hi > 1 and "Ͱ" <= v[hi - 2] <= "῿"))

    def token(self, i: int) -> str:
        """Letters and inner full stops directly before i, within one script that writes spaces."""
        v, lo = self.v, i
        while lo and i - lo < 40:
            c = v[lo - 1]
            if c.isalpha():
                if self.r.unspaced.match(c):
                    break
            elif c != "." and unicodedata.category(c) not in ("Mn", "Mc", "Cf"):
                break
            lo -= 1
        if lo < i and lo and v[lo - 1] == "\\" and v[lo] in "nrt":
            lo += 1  # the letter of an escape
        return v[lo:i].lstrip(".")

    def votes(self, lo: int, hi: int) -> dict[str, float]:
        scores = dict.fromkeys((*SIGNS, *BY_SCRIPT), 0.0)
        for word in self.r.cased.findall(skeleton(self.v[lo:hi].lower())):
            for lang in voted(word):
                scores[lang] += 1
        if self.label in scores:
            scores[self.label] += LABEL_VOTES
        return scores

    def languages(self, i: int, token: str) -> list[str]:
        """Languages whose abbreviations count for a token that ends at i.

        Letters of a script of its own decide; else frequent words of the sentence around it and the label
        vote; where that gives less than two votes or a tie, the whole text decides between the best.
        """
        look = skeleton(token)
        for lang, letter in BY_SCRIPT.items():
            if lang != "other" and letter.search(look):
                return [lang]
        near = self.votes(max(self.at, i - AROUND), i + AROUND // 4)
        votes = max(near.values())
        best = [lang for lang, n in near.items() if n == votes]
        if votes < 2 or len(best) > 1:
            if self.whole is None:
                self.whole = self.votes(0, len(self.v))
            votes = max(self.whole[lang] for lang in best)
            best = [lang for lang in best if self.whole[lang] == votes]
        if not votes:
            return []
        return [*best, "other"] if {"ru", "el", "hi"} & set(best) else best

    def next_letter(self, at: int) -> str:
        k = self.r.skip_open.match(self.v, at).end()
        return self.v[k : k + 1]

    def goes_on(self, opener: str, lo: int, j: int) -> bool:
        """Whether a sentence that began with a quotation continues after it."""
        v, k = self.v, self.r.closers.match(self.v, j + 1).end()
        if k >= len(v) or v[k] in self.r.terms:
            return False
        n = self.r.gap.match(v, k).end()
        if n >= len(v):
            return False
        if not self.ends_inside(lo, j):
            return True
        if n == k:
            return not v[k].isupper() or not self.tells
        if "\\" in v[k:n] or "\n" in v[k:n] or set(v[k:n]) & set("/|–—"):
            return False
        if opener in _BRACKETS:
            return False
        c = self.next_letter(n)
        return not (c.isupper() and self.tells) and not c.isdigit() or v[n] in ",;:"

    def content(self, n: int) -> bool:
        c = self.v[n : n + 1]
        return bool(c) and bool(self.next_letter(n)) and (c.isalnum() or c in _PAIRS or c in "\"'\\¿¡[{<%*•-" or unicodedata.category(c)[0] in "LNS")

    def stops(self, i: int, k: int) -> int:
        """Start of the next sentence if the terminators at [i, k) end one, else -1."""
        v, r = self.v, self.r
        after = r.closers.match(v, k).end()
        n = r.gap.match(v, after).end()
        if n >= len(v) or not self.content(n):
            return -1
        gap = n > after
        hard = gap and ("\\" in v[after:n] or "\n" in v[after:n] or bool(set(v[after:n]) & set("/|–—")))
        c = self.next_letter(n)
        marks = v[i:k]
        if marks[0] in r.full_stops and k - i == 1:
            if i == 0 or v[i - 1].isspace():
                return n if gap else -1
            prev = v[i - 1]
            if not gap:
                if prev.isdigit() and v[n].isdigit() or not v[n].isalpha() or not v[n].isupper() or not self.tells:
                    # an opening mark may follow directly: "done.«Next"
                    return n if v[n] in "¿¡" or (v[n] in "“„«" and c.isupper()) else -1
                if prev.isalpha() and len(self.token(i).rpartition(".")[2]) < 2:
                    return -1
                return -1 if self.held(i, n, c, hard) else n
            if self.held(i, n, c, hard):
                return -1
            return n
        if set(marks) <= set(".…‥"):
            return n if hard or (gap and (c.isupper() or not c.isalpha())) else -1
        if not gap and v[n].islower():
            return -1
        if not gap and not (v[n].isalnum() or v[n] in "¿¡“„«「『‘(（[\\\"") :
            return -1
        return n

    def held(self, i: int, n: int, c: str, hard: bool) -> bool:
        """Whether the single full stop at i belongs to an abbreviation inside a sentence."""
        v, r = self.v, self.r
        whole = self.token(i)
        if not whole:
            if v[i - 1].isdigit():
                # ordinals of German after an article or a preposition
                return v[n].isalpha() and not hard and bool(r.ordinal.search(v, max(0, i - 24), i)) and "de" in self.languages(i, "")
            # a full stop after a letter of a script written without spaces is an abbreviation
            return bool(r.no_marks.match(v, i - 1)) and not (c.isupper() and not hard)
        word = whole.rpartition(".")[2]
        at = i - len(word)
        # capital look-alikes fold differently before and after lower-casing
        whole, last = next(((w, x) for w, x in ((skeleton(whole.lower()), skeleton(word.lower())), (skeleton(whole).lower(), skeleton(word).lower())) if {w, x} & KNOWN), (skeleton(whole.lower()), skeleton(word.lower())))
        if len(word) == 1 and word.isupper() and r.paired.match(v, n):
            return True
        always = reference = soft = frozenset()
        if whole in KNOWN or last in KNOWN:
            for lang in self.languages(i, word):
                always, reference, soft = (x | y for x, y in zip((always, reference, soft), SETS[lang]))
        if hard and last not in always:
            return False
        if whole in always or last in always:
            return True
        if whole in soft or last in soft or (last in ("д", "п") and v[max(0, at - 3) : at].lower().rstrip().endswith("т.")):
            return not (c.isupper() and self.tells) or hard
        head = skeleton(v[max(0, at - 6) : at].lower()).rstrip()
        for key, before in AFTER.items():
            if last == key and head.endswith(before):
                return True
        if last in reference and r.reference.match(v, n):
            return True
        if len(word) == 1:
            if word.islower():
                return True
            # an initial: at the start of a sentence or after another initial
            return head == "" or (head[-1] == "." and len(head) > 1 and head[-2].isalpha() and not head[-3:-2].isalpha())
        return False

    def starts(self) -> list[int]:
        v, r = self.v, self.r
        start = r.lead.match(v).end()
        out = [start] if start < len(v) else []
        if not out or named_fields(v):
            return out
        i = start
        while (m := self.event(i)) is not None:
            kind, i = m.lastgroup, m.end()
            nxt = -1
            if kind in ("open", "quote"):
                p, opener = m.start(), m.group()
                j = self.closing(p, opener)
                if j < 0:
                    continue
                leads = r.skip_open.match(v, start).end() >= p
                if leads and not self.goes_on(opener, i, j):
                    continue
                if not leads and p and v[p - 1] in r.terms and opener.endswith('"'):
                    continue
                i = j + 1
                if not leads and self.ends_inside(p + 1, j):
                    k = r.closers.match(v, i).end()
                    n = r.gap.match(v, k).end()
                    if k < n < len(v) and self.content(n):
                        hard = "\\" in v[k:n] or "\n" in v[k:n] or set(v[k:n]) & set("/|–—")
                        c = self.next_letter(n)
                        if hard or (c.isupper() and self.tells):
                            nxt = n
            elif kind == "term":
                nxt = self.stops(m.start(), m.end())
            elif kind == "greek":
                if "Ͱ" <= v[m.start() - 1] <= "῿" or any("Ͱ" <= x <= "῿" for x in v[start : m.start()]):
                    n = r.gap.match(v, r.closers.match(v, i).end()).end()
                    nxt = n if n < len(v) and self.content(n) else -1
            elif kind in ("line", "sep"):
                n = r.gap.match(v, m.start()).end()
                if n < len(v) and (kind == "line" or self.statement(start, m.start())):
                    nxt = n
            elif kind == "space":
                if self.statement(start, m.start()) and self.begins(m.end()):
                    nxt = m.end()
            if nxt > start:
                out.append(nxt)
                start = i = self.at = nxt
        return out

    def statement(self, lo: int, hi: int) -> bool:
        return sum(1 for _ in self.r.no_marks.finditer(self.v, lo, hi)) >= STATEMENT

    def begins(self, at: int) -> bool:
        """Whether a statement begins here: enough letters without marks, or words of another script."""
        v, r = self.v, self.r
        if r.latin_words.match(v, r.skip_open.match(v, at).end()):
            return True
        if not r.no_marks.match(v, r.skip_open.match(v, at).end()):
            return False
        stop = self.event(at + 1)
        return sum(1 for _ in r.no_marks.finditer(v, at, stop.start() if stop else len(v))) >= STATEMENT


_LABEL = re.compile(r"\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", re.DOTALL)


def label_of(label: str | None) -> str | None:
    """Language with abbreviations that a delivered label names."""
    m = _LABEL.match(label) if label else None
    return m.group(1).lower() if m and m.group(1).lower() in SETS else None


def sentence_starts(text: str | None, label: str | None = None) -> list[int]:
    """Start positions of all sentences of a text; ``label`` helps where its words do not tell the language."""
    if not text:
        return []
    r = rules(text)
    if r.candidate(text):
        return _Scan(text, label).starts()
    start = r.lead.match(text).end()
    return [start] if start < len(text) else []


_TAIL = re.compile(r"(?:\s|\\[nrt]|(?<=[\s])[/|–—])+$")


def sentence_spans(text: str | None, label: str | None = None) -> list[tuple[int, int]]:
    """Half-open spans of all sentences, without the space and separators around them."""
    if not text:
        return []
    starts = sentence_starts(text, label)
    out = []
    for s, e in zip(starts, [*starts[1:], len(text)]):
        body = text[s:e].rstrip()
        if body[-1:] in "nrt/|–—":
            body = _TAIL.sub("", body)
        out.append((s, s + len(body)))
    return out


def _rows(df: DataFrame, id_col: str, value_col: str, label_col: str):
    """Identifier, value and label, null where there is no such column."""
    label = F.col(label_col).cast("string") if label_col in df.columns else F.lit(None).cast("string")
    return df.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"), label.alias("label"))


def boundaries(df: DataFrame, id_col: str = "entry_id", value_col: str = "value", label_col: str = "lang") -> DataFrame:
    """``(id_col, start_pos)`` of every sentence but the first of its value."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = _rows(df, id_col, value_col, label_col).where(F.length("value") > 1)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known: dict[tuple[str, str | None], list[int]] = {}
        for batch in batches:
            at: list[int] = []
            pos: list[int] = []
            for k, (v, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                masked = DIGITS.sub("0", v), label_of(label)
                found = known.get(masked)
                if found is None:
                    if len(known) > MEMO:
                        known.clear()
                    found = known[masked] = sentence_starts(*masked)
                if len(found) > 1:
                    pos.extend(found[1:])
                    at.extend([k] * (len(found) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.asarray(at, np.int64))), pa.array(pos, pa.int32())], [id_col, "start_pos"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, start_pos int")


def sentences(df: DataFrame, id_col: str = "entry_id", value_col: str = "value", label_col: str = "lang") -> DataFrame:
    """``(id_col, sentence_no, start_pos, sentence)`` of every non-null value."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = _rows(df, id_col, value_col, label_col).where("value is not null")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, no, pos, text = [], [], [], []
            for k, (v, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for i, (s, e) in enumerate(sentence_spans(v, label_of(label)), 1):
                    at.append(k)
                    no.append(i)
                    pos.append(s)
                    text.append(v[s:e])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(pos, pa.int32()), pa.array(text, pa.string())], [id_col, "sentence_no", "start_pos", "sentence"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, sentence_no int, start_pos int, sentence string")


def p3_found(df: DataFrame) -> DataFrame:
    return boundaries(df)
