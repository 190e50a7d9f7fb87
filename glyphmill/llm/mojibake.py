"""Problem 4: text garbled by a wrong character encoding.

A record's latent state is an encoding chain: clean, or text stored in encoding R
and read as encoding W (also twice over).  Undoing a chain gives a candidate text.
A bigram model of the collection's characters says how likely each candidate is;
a chain's evidence is the log likelihood ratio of its candidate to the text as it
stands.  Expectation-maximization pools that evidence per source: the shares of
the chains in a file are the expected shares under the posteriors, smoothed by a
prior, so that short values of a garbled file are found although each alone says
little.  A record is repaired by its most probable chain; a text that lost
characters for good (U+FFFD) is found but cannot be regained.

Plan.  One pass counts character bigrams of the values that no chain makes less
stray (so garbled text is not learnt, however frequent it is), combined per task; the
most frequent ``MAX_BIGRAMS`` are broadcast, a table of fixed size.  A second narrow
pass scores every non-ASCII record by all chains that can have made it, weak and
negative evidence included.  Per source, records are reduced to counts of
rounded evidence profiles with map-side combination, so the EM of a source reads
profiles, not records; sources with more than ``HOT_PROFILES`` profiles are fitted by
one combined aggregation for each iteration, so none is ever read by one task.  The
shares are joined back to the records.

Defined cases: null, empty and ASCII values are clean; a null source is a source
of its own; repeated rows have equal results; ties between chains go to the
first in ``CHAINS``; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphmill.llm.lookalikes import BACK, LOOKS, script, skeleton, units
from glyphmill.plans import stage

MAX_BIGRAMS = 300_000
#: Rounding of evidence in profiles, and the most that counts.
STEP, MOST = 1.0, 40.0
#: The share of clean records is at least ``CLEAN``, so evidence below ``NONE`` gives odds under 2e-5 in any source: it is no candidate.
CLEAN, NONE = 1e-6, -25.0
#: Further penalty for each bigram of a candidate that the collection does not hold.
UNSEEN = 6.0
#: Prior share of garbled records in a source, and its weight in records.
PRIOR, WEIGHT = 0.01, 30.0
ITERATIONS = 8
#: Profiles of a source from which on its shares are fitted by aggregations instead of in one task.
HOT_PROFILES = 200_000
#: Texts a worker remembers.
KNOWN = 100_000

READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp866", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp1253", "cp1254", "cp874")
#: Texts of single bytes are not taken to be read as cp1253, cp1254 or cp874: with these, rare Greek and Thai values pass for
#: misread ones (at scale 0.1 nine more records are found, all of them right as they stand, and none that was missed).
SINGLE_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp866", "cp1251", "cp1250", "iso8859-2", "koi8-r")
STORED_AS = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "cp874", "cp437", "cp850", "mac_roman", "mac_cyrillic", "cp932", "gbk", "big5", "euc_kr", "euc_jp")
MULTI = ("cp932", "gbk", "big5", "euc_kr", "euc_jp")
SINGLE = frozenset(STORED_AS) - frozenset(MULTI)
WIDE = ("gbk", "cp932", "big5", "euc_kr")
#: (stored as, read as); a doubled name is a chain applied twice.
CHAINS = (
    [("utf-8", w) for w in READ_AS]
    + [("utf-8 twice", w) for w in ("cp1252", "latin-1", "mac_roman")]
    + [("utf-8", w) for w in WIDE]
    + [(r, w) for w in SINGLE_READ_AS for r in STORED_AS if r != w]
)
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


@lru_cache(maxsize=32)
def to_bytes(codec: str) -> dict[int, int]:
    """Character to byte of a single-byte codec; undefined bytes stand as control characters."""
    table = {b: b for b in range(128)}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    if codec == "cp1252":  # lenient readers pass the controls through
        for b in range(128, 160):
            table.setdefault(b, b)
    return table


@lru_cache(maxsize=512)
def _without(stored: str, read: str) -> frozenset[str]:
    """Characters that the chain cannot have made."""
    return frozenset(chr(c) for c, x in _single(stored, read).items() if x is None)


@lru_cache(maxsize=32)
def _runs(codec: str):
    """Pattern of maximal runs that the codec can have produced and that hold a non-ASCII character."""
    high = "".join(re.escape(chr(c)) for c, b in to_bytes(codec).items() if b > 127)
    return re.compile(rf"[\x00-\x7f]*[{high}](?:[\x00-\x7f{high}])*"), re.compile(rf"[{high}]+")


def _bytes(run: str, codec: str) -> bytes:
    return codecs.charmap_encode(run, "strict", to_bytes(codec))[0]


@lru_cache(maxsize=512)
def _single(stored: str, read: str) -> dict[int, str | None]:
    """Character map that undoes a chain of two single-byte encodings; None where it cannot apply."""
    out: dict[int, str | None] = {c: chr(c) for c in range(128)}
    for c, b in to_bytes(read).items():
        if b > 127:
            try:
                out[c] = bytes([b]).decode(stored)
            except UnicodeDecodeError:
                out[c] = None
    return out


@lru_cache(maxsize=32)
def _sequence(codec: str):
    """Pattern of what the bytes of a character in UTF-8 look like in a codec."""
    table = to_bytes(codec)

    def some(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(chr(c)) for c, b in table.items() if lo <= b <= hi) + "]"

    return re.compile(f"{some(0xC2, 0xF4)}{some(0x80, 0xBF)}")


def _undo_utf8(text: str, codec: str) -> str:
    def fix(m):
        run = m.group()
        raw = _bytes(run, codec)
        if not _SEQUENCE.search(raw):
            return run
        out, at = [], 0
        for s in _SEQUENCE.finditer(raw):
            try:
                good = s.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [run[at : s.start()], good]
            at = s.end()
        return "".join(out) + run[at:]

    return _runs(codec)[1].sub(fix, text)


def undo(text: str, stored: str, read: str) -> str | None:
    """The text before the chain, or None where the chain cannot have made it."""
    if stored == "utf-8 twice":
        once = _undo_utf8(text, read)
        out = _undo_utf8(once, read) if once != text else text
        return out if out != once else None
    if stored == "utf-8" and read in WIDE:
        try:
            out = text.encode(read).decode("utf-8")
        except UnicodeError:
            return None
        return out if out != text else None
    if stored == "utf-8":
        out = _undo_utf8(text, read)
        return out if out != text else None
    if stored not in MULTI:
        bad = _without(stored, read)
        if bad and not bad.isdisjoint(text):
            return None
        out = text.translate(_single(stored, read))
        return out if out != text else None
    try:
        out = _runs(read)[0].sub(lambda m: _bytes(m.group(), read).decode(stored), text)
    except UnicodeDecodeError:
        return None
    return out if out != text else None


@lru_cache(maxsize=100_000)
def _folded(c: str) -> str:
    """Width, kind of space and invisible characters made uniform; letters keep their script."""
    return c if c in LOOKS or unicodedata.normalize("NFD", c)[0] in LOOKS else unicodedata.normalize("NFC", units(c))


#: What is left of lead bytes before a no-break space or a soft hyphen that belongs to them.
_PAIRED = re.compile("(?<=[\x80-\xff])[\xa0\xad]")


def plain(text: str) -> str:
    """Form in which texts are scored: width, spaces and capitals are no evidence of a chain."""
    if _PAIRED.search(text):
        text = _PAIRED.sub(lambda m: chr(0xE000 + ord(m.group())), text)
    return "\n" + "".join(map(_folded, _DIGITS.sub("0", text))).lower() + "\n"


#: Digits are all alike to the model, so what is known of a text holds for all that differ in numbers only.
_DIGITS = re.compile("[0-9]+")


def unmixed(text: str) -> str:
    """The text with look-alike letters of words of mixed scripts put into the word's own script."""

    def one(m):
        token = m.group()
        if token.isascii() or not _MIXED.search(token):
            return token
        scripts = {x for x in map(script, token) if x in _SCRIPTS}
        if len(scripts) < 2:
            return token
        if all(c in LOOKS for c in token if script(c) != "LATIN"):
            return skeleton(token)
        back = BACK["CYRILLIC" if "CYRILLIC" in scripts else "GREEK"]
        return "".join(back.get(c, c) for c in token)

    return text if text.isascii() else _TOKEN.sub(one, text)


_TOKEN = re.compile(r"[^\W\d_]+")
_LATIN, _OTHER = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "Ͱ-ԯἀ-῿"
_MIXED = re.compile(f"[{_LATIN}][^{_OTHER}]*[{_OTHER}]|[{_OTHER}][^{_LATIN}]*[{_LATIN}]")
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")


def credible(text: str, before: str) -> bool:
    """Whether a single-byte candidate brings no stray characters and no word of mixed scripts."""
    new = set(text) - set(before)
    if any(c > "\x7f" and (unicodedata.category(c)[0] == "C" or unicodedata.category(c) in ("Zs", "Zl", "Zp")) for c in new):
        return False
    if not any(c.isalpha() for c in new):
        return False
    return not _mixed(text)


def _mixed(text: str) -> bool:
    return any(_MIXED.search(t) for t in _TOKEN.findall(text) if not t.isascii())


class Bigrams:
    """Log shares of character bigrams of plain forms."""

    def __init__(self, rows: list[tuple[int, int]], total: int):
        self.floor = math.log(0.3 / max(total, 1))
        self.logs = {chr(k >> 21) + chr(k & 0x1FFFFF): math.log(n / max(total, 1)) for k, n in rows}
        ordered = sorted(rows) or [(-1, 1)]
        self.keys = np.array([k for k, _ in ordered], np.int64)
        self.values = np.log(np.array([n for _, n in ordered], np.float64) / max(total, 1))

    def score(self, text: str, unseen: float = 0.0) -> float:
        """Log likelihood of the bigrams in a text; ``unseen`` is a further penalty for every bigram the collection does not hold."""
        return self.sum(plain(text)[1:-1], unseen)

    def sum(self, t: str, unseen: float = 0.0) -> float:
        """The same of a plain form."""
        get, floor = self.logs.get, self.floor - unseen
        return sum([get(t[i : i + 2], floor) for i in range(len(t) - 1)])

    def ends(self, left: str, t: str, right: str, unseen: float = 0.0) -> float:
        """Log likelihood of what a plain form adds between two characters."""
        get, floor = self.logs.get, self.floor - unseen
        return get(left + t[0], floor) + get(t[-1] + right, floor) if t else get(left + right, floor)

    def logs_of(self, first, second, unseen: float = 0.0):
        """Logs of bigrams given as arrays of codes."""
        asked = (first << 21) | second
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.values[at], self.floor - unseen)


#: Marks that stand inside words of clean text.
_INSIDE = frozenset("’‘ʼ·‧・–—‑/…")


@lru_cache(maxsize=100_000)
def _kind(c: str) -> str:
    """Upper case, lower case, other Latin letters (h: not ASCII), eastern letters (e), other letters (x), signs (s, symbols g), what may end a character of two bytes (n), the rest."""
    kind = unicodedata.category(c)
    if c in "\xa0\xad":
        return "n"
    if kind[0] == "L":
        if c >= "⺀":
            return "e"
        latin = c < "\u0250" or "\u1e00" <= c < "\u1f00"
        case = "u" if kind == "Lu" else "l" if kind == "Ll" else "x"
        return case if not latin or c < "\x80" else case.translate(_HIGH)
    if kind in ("Sk", "So", "Sm", "Lm") and c > "\x7f":
        return "g"
    if c > "\x7f" and c not in _INSIDE and (kind[0] in "SC" or kind in ("No", "Po", "Ps", "Pe", "Pi", "Pf", "Lm")):
        return "s"
    return "a" if kind[0] == "M" else " "


#: Upper and lower case of Latin letters outside ASCII.
_HIGH = str.maketrans({"u": "U", "l": "L", "x": "L"})
_STRAY = re.compile("(?<=[lL])[uU]|(?<=[UL])[UL]|(?<=[ULsg])[sgn]|(?<=[ulxe])[sg](?=[ulULxesg])|(?<![ulULxesg])g(?=[lL])|(?<=[lL])e|e(?=[lL])|(?<=[ulUL])x|x(?=[ulUL])")
#: Eastern letters that touch small Latin ones.
_TOUCHING = re.compile("(?<=[a-zß-ɏ])[⺀-\uffef]|[⺀-\uffef](?=[a-zß-ɏ])")


def strayness(word: str) -> int:
    """Number of places where a word does what words of no language do: capitals after small letters, signs inside, Latin letters outside ASCII side by side."""
    return len(_STRAY.findall("".join(map(_kind, word)))) + sum("\x80" <= c <= "\x9f" for c in word)


@lru_cache(maxsize=KNOWN)
def explained(word: str) -> bool:
    """Whether some chain makes a word less stray: such words are not counted in the model, however frequent they are."""
    if word.isascii():
        return False
    odd = strayness(word)
    if not odd:
        return False
    reach = {w for w, high in _reach().items() if not high.isdisjoint(word)}.union(WIDE)
    for stored, read in CHAINS:
        if read not in reach:
            continue
        got = undo(word, stored, read)
        if got is not None and "�" not in got and fitting(stored, got, word) and strayness(got) < odd:
            return True
    return False


def fitting(stored: str, text: str, before: str) -> bool:
    """Whether a candidate can be what was stored."""
    if stored.startswith("utf-8"):
        return True
    return credible(text, before) and (stored not in MULTI or max(text) >= "⺀")


#: Runs that chains of single bytes and of UTF-8 change, with a character on either side.
_RUN = re.compile("([\x00-\x7f]?)([^\x00-\x7f]+)(?=([\x00-\x7f]?))")
#: Chains that change a run whatever stands beside it, and those that read ASCII as second bytes.
_LOCAL = [k for k, (r, w) in enumerate(CHAINS) if r not in MULTI and w not in WIDE]
_WORDS = [k for k in range(len(CHAINS)) if k not in set(_LOCAL)]
_WIDE_CHAINS = [k for k in _WORDS if CHAINS[k][1] in WIDE]
_UTF8 = [k for k in _LOCAL if CHAINS[k][0].startswith("utf-8")]


#: Chains of two single-byte encodings, and the classes of characters in their texts.
_PLAIN_CHAINS = [k for k, (r, _) in enumerate(CHAINS) if r in SINGLE]
_PLAIN_PLACES = np.array(_PLAIN_CHAINS)
_STRAY_CHAR, _ALPHA, _LATIN_CHAR, _OTHER_CHAR, _SLOW = 1, 2, 4, 8, 16
_LATIN_SET, _OTHER_SET = re.compile(f"[{_LATIN}]"), re.compile(f"[{_OTHER}]")


@lru_cache(maxsize=100_000)
def _kinds(c: str) -> tuple[int, int]:
    """Code of a character's plain form, and its classes."""
    kind = _STRAY_CHAR * (c > "\x7f" and category(c) in _STRAYS) + _ALPHA * c.isalpha()
    kind += _LATIN_CHAR * bool(_LATIN_SET.match(c)) + _OTHER_CHAR * bool(_OTHER_SET.match(c))
    flat = _folded(c).lower()
    # forms of several characters, and what depends on its neighbours, take the general way
    return (ord(flat), kind) if len(flat) == 1 and c not in "Σ\xa0\xad" else (0, kind + _SLOW)


@lru_cache(maxsize=200_000)
def _can(c: str):
    """For a character and each chain of single bytes: the character before it (-1: none), its plain form and classes."""
    made = np.full(len(_PLAIN_CHAINS), ord(c), np.int64)
    for i, k in enumerate(_PLAIN_CHAINS):
        stored, read = CHAINS[k]
        if c in _reach()[read]:
            got = _single(stored, read)[ord(c)]
            made[i] = -1 if got is None else ord(got)
    flat, kind = zip(*(_kinds(chr(x)) if x >= 0 else (0, 0) for x in made.tolist()))
    return np.array([made, flat, kind], np.int64)


class _Variants:
    """What the chains that work on runs make of a run; only the bigrams at its ends depend on what stands beside it."""

    def __init__(self, text: str, model: Bigrams):
        self.model, self.crossed = model, {}
        codes = np.array([ord(c) for c in text])
        made, flat, kinds = np.stack([_can(c) for c in text], axis=2)
        new = (made[:, :, None] != np.unique(codes)).all(axis=2)
        self.gain = np.where((made == codes).all(axis=1), 0.0, -np.inf)
        made_ok = (made >= 0).all(axis=1) & ~(new & (kinds & _STRAY_CHAR > 0)).any(axis=1)
        # only chains that change the run and can have made it are looked at any further
        self.open = np.flatnonzero((self.gain < 0) & made_ok)
        made, new, self.flat, self.kinds = made[self.open], new[self.open], flat[self.open], kinds[self.open]
        self.able = np.zeros(len(CHAINS), bool)
        self.able[_PLAIN_PLACES[self.open]] = (new & (self.kinds & _ALPHA > 0)).any(axis=1)
        self.inner = model.logs_of(self.flat[:, :-1], self.flat[:, 1:], UNSEEN).sum(axis=1)
        # the other chains, and texts whose plain form is not one of single characters
        slow = (self.kinds & _SLOW > 0).any(axis=1)
        self.rest = [(i, _PLAIN_CHAINS[self.open[i]], "".join(map(chr, made[i]))) for i in np.flatnonzero(slow).tolist()]
        for k in _UTF8:
            fixed = undo(text, *CHAINS[k]) if _sequence(CHAINS[k][1]).search(text) else None
            if fixed is not None:
                self.rest.append((-1, k, fixed))
                self.able[k] = "\ufffd" not in fixed
        self.forms = {t: (p := plain(t)[1:-1], model.sum(p, UNSEEN)) for t in {t for _, _, t in self.rest}}
        self.plain = plain(text)[1:-1]
        self.base = model.sum(self.plain)

    def gains(self, left: str, right: str):
        """Gain of every chain where the run stands between two characters."""
        out, m = np.zeros(len(CHAINS)), self.model
        sides = left.isalpha(), right.isalpha()
        crossed = self.crossed.get(sides)
        if crossed is None:
            crossed = self.crossed[sides] = self.mixed(*sides)
        left, right = left.lower(), right.lower()
        base = self.base + m.ends(left, self.plain, right)
        gain = self.inner + m.logs_of(ord(left), self.flat[:, 0], UNSEEN) + m.logs_of(self.flat[:, -1], ord(right), UNSEEN) - base
        gain[crossed] = -np.inf
        every = self.gain.copy()
        every[self.open] = gain
        out[_PLAIN_PLACES] = every
        for i, k, fixed in self.rest:
            if "\ufffd" in fixed or i >= 0 and crossed[i]:
                out[k] = -np.inf
            else:
                form, inner = self.forms[fixed]
                out[k] = inner + m.ends(left, form, right, UNSEEN) - base
        return out

    def mixed(self, left: bool, right: bool):
        """Chains whose text has a word of mixed scripts, where letters may stand beside it."""
        n = len(self.kinds)
        latin, other, out = np.full(n, left), np.zeros(n, bool), np.zeros(n, bool)
        for kinds in self.kinds.T:
            letter = kinds & _ALPHA > 0
            latin = letter & (latin | (kinds & _LATIN_CHAR > 0))
            other = letter & (other | (kinds & _OTHER_CHAR > 0))
            out |= latin & other
        return out | (other & right)


class Scorer:
    """Evidence of all chains.  It is a sum over runs of non-ASCII characters or words; these recur, so each is judged once."""

    def __init__(self, model: Bigrams):
        self.model = model
        self.straight: dict[str, str] = {}
        self.runs: dict[str, _Variants] = {}
        self.memo: dict[tuple[str, bool, bool, int], tuple] = {}
        self.words: dict[str, tuple] = {}
        self.known: dict[str, list[tuple[int, float]]] = {}
        self.strange: dict[str, object] = {}

    def judged_word(self, word: str):
        """The same for the chains that read a whole word, by distinct bytes."""
        got = self.words.get(word)
        if got is None and word.isascii():  # nothing is left of what was not ASCII
            got = np.zeros(len(CHAINS)), np.zeros(len(CHAINS), bool)
        if got is None:
            if len(self.words) > KNOWN:
                self.words.clear()
            gain, able = np.zeros(len(CHAINS)), np.zeros(len(CHAINS), bool)
            own = set(word)
            high = {c for c in own if c > "\x7f"}
            raws = {w: _bytes(word, w) for w, reach in _reach().items() if high <= reach}
            touched = {w for w, reach in _reach().items() if not high.isdisjoint(reach)}
            base = None
            decoded: dict[tuple[bytes, str], str | None] = {}
            scores: dict[tuple[str, bool], tuple[float, bool]] = {}
            for k in _WORDS if touched else _WIDE_CHAINS:
                stored, read = CHAINS[k]
                if read in WIDE:
                    fixed = _word_before(word, stored, read)
                elif read in raws:
                    raw = raws[read], stored
                    if raw not in decoded:
                        try:
                            decoded[raw] = raw[0].decode(stored)
                        except UnicodeDecodeError:
                            decoded[raw] = None
                    fixed = decoded[raw]
                elif read in touched:
                    fixed = _word_before(word, stored, read)
                else:
                    continue
                if fixed is None:
                    gain[k] = -np.inf
                elif fixed != word:
                    multi = stored in MULTI
                    got = scores.get((fixed, multi))
                    if got is None:
                        if base is None:
                            base = self.model.score(f" {word} ")
                        got = scores[fixed, multi] = self._word_score(fixed, own, base, multi)
                    gain[k], able[k] = got
            got = self.words[word] = gain, able
        return got

    def _word_score(self, fixed: str, own: set[str], base: float, multi: bool) -> tuple[float, bool]:
        """Gain of a word's candidate, and whether it accounts for a change."""
        if "\ufffd" in fixed:
            return -math.inf, False
        if not multi:
            return self.model.score(f" {fixed} ", UNSEEN) - base, True
        new = every = 0
        for c in set(fixed):
            kind = _kinds(c)[1]
            every |= kind
            if c not in own:
                new |= kind
        if new & _STRAY_CHAR or (every & _LATIN_CHAR and every & _OTHER_CHAR and _mixed(fixed)):
            return -math.inf, False
        full = f" {fixed} "
        return self.model.score(full, UNSEEN) - base - 2 * UNSEEN * len(_TOUCHING.findall(full)), bool(new & _ALPHA) and max(fixed) >= "⺀"

    def foreign(self, word: str):
        """Chains by which a word of Latin letters outside ASCII becomes one of another script."""
        got = self.strange.get(word)
        if got is None:
            if len(self.strange) > KNOWN:
                self.strange.clear()
            got = np.zeros(len(CHAINS))
            if all(_kind(c) in "UL" for c in word if c.isalpha()):
                for k in _LOCAL:
                    fixed = undo(word, *CHAINS[k])
                    got[k] = fixed is not None and any(c.isalpha() and script(c) != "LATIN" for c in fixed)
            self.strange[word] = got
        return got

    def judged(self, word: str, first: bool, last: bool, beside: int):
        """Gain of each chain on a word and its runs, beside so many ASCII words, and whether the chain accounts for a change."""
        key = word, first, last, beside
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > KNOWN:
                self.memo.clear()
                self.runs.clear()
            plain = self.straight.get(word)
            if plain is None:
                if len(self.straight) > KNOWN:
                    self.straight.clear()
                plain = self.straight[word] = unmixed(word)
            gain, able = (x.copy() for x in self.judged_word(plain))
            for m in _RUN.finditer(plain):
                left, text, right = m.groups()
                if _reached().isdisjoint(text):
                    continue  # no chain that works on runs changes it
                run = self.runs.get(text)
                if run is None:
                    run = self.runs[text] = _Variants(text, self.model)
                gain += run.gains(left or ("\n" if first else " "), right or ("\n" if last else " "))
                able |= run.able
            if beside:  # words of two scripts stand side by side as seldom as unknown bigrams
                gain -= UNSEEN * beside * self.foreign(plain)
            got = self.memo[key] = gain, able
        return got

    def chains(self, text: str) -> list[tuple[int, float]]:
        """(chain, evidence) of all chains that can have made the text."""
        words = text.split(" ")
        simple = [w.isascii() and any(map(str.isalpha, w)) for w in words]
        gain, able, last = np.zeros(len(CHAINS)), np.zeros(len(CHAINS), bool), len(words) - 1
        for at, w in enumerate(words):
            if not w.isascii():
                g, a = self.judged(w, at == 0, at == last, (at > 0 and simple[at - 1]) + (at < last and simple[at + 1]))
                gain += g
                able |= a
        return [(int(k), float(gain[k])) for k in np.flatnonzero(able & (gain > NONE))]

    def candidates(self, text: str) -> list[tuple[int, float]]:
        """(chain, evidence); texts that differ in digits only are judged once."""
        masked = _DIGITS.sub("0", text)
        found = self.known.get(masked)
        if found is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            found = self.known[masked] = self.chains(masked)
        return found


@lru_cache(maxsize=1)
def _reached() -> frozenset[str]:
    """Non-ASCII characters of all single-byte codecs."""
    return frozenset().union(*_reach().values())


@lru_cache(maxsize=1)
def _reach() -> dict[str, frozenset[str]]:
    """Non-ASCII characters of each single-byte codec."""
    return {w: frozenset(chr(c) for c, b in to_bytes(w).items() if b > 127) for w in READ_AS}


_made: dict[int, Scorer] = {}


def _scorer(key: int, model: tuple[list[tuple[int, int]], int]) -> Scorer:
    """The worker's scorer for a model; kept from task to task, with what it has judged."""
    if key not in _made:
        _made.clear()
        _made[key] = Scorer(Bigrams(*model))
    return _made[key]


_STRAYS = frozenset(("Cc", "Cf", "Cn", "Co", "Cs", "Zs", "Zl", "Zp"))


def _strays(text: str, before: str) -> bool:
    """Whether a part brings control characters or spaces."""
    return any(c > "\x7f" and category(c) in _STRAYS for c in set(text) - set(before))


def _word_before(word: str, stored: str, read: str) -> str | None:
    """The word before a chain that reads whole words, itself where the chain leaves it; None where the chain cannot have made it."""
    try:
        if read in WIDE:
            return word.encode(read).decode("utf-8")
        return _runs(read)[0].sub(lambda m: _bytes(m.group(), read).decode(stored), word)
    except UnicodeError:
        return None


@lru_cache(maxsize=100_000)
def category(c: str) -> str:
    return unicodedata.category(c)


def bigram_counts(values: DataFrame, limit: int = MAX_BIGRAMS) -> tuple[list[tuple[int, int]], int]:
    """The most frequent character bigrams of the non-ASCII values that no chain explains, and the number of bigrams."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            # values that differ in numbers only are read once
            values = {plain(v): n for v, n in Counter(_DIGITS.sub("0", v) for v in batch.column(0).to_pylist()).items() if not any(map(explained, v.split(" ")))}
            codes = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32).astype(np.int64)
            times = np.repeat(np.fromiter(values.values(), np.int64, len(values)), np.fromiter(map(len, values), np.int64, len(values)))
            keys, at = np.unique(np.r_[keys, (codes[:-1] << 21) | codes[1:]], return_inverse=True)
            counts = np.bincount(at, np.r_[counts, times[:-1]], len(keys)).astype(np.int64)
            if len(keys) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["k", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["k", "n"])

    sums = stage(values.mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")), "bigrams")
    total = sums.agg(F.sum("n")).first()[0] or 0
    return [(r.k, r.n) for r in sums.orderBy(F.desc("n"), "k").limit(limit).collect()], int(total)


def scored_records(df: DataFrame, id_col: str, value_col: str, source_col: str) -> DataFrame:
    """Records that a chain can have made: id, source, value, lossy, chains, evidence."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(value_col).alias("value"))
    rows = rows.where(F.col("value").rlike(r"[^\p{ASCII}]"))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(bigram_counts(rows.select("value")))
    number = uuid.uuid4().int
    id_type, source_type = df.schema[id_col].dataType.simpleString(), df.schema[source_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = _scorer(number, shared.value)
        for batch in batches:
            at, lossy, chains, gains = [], [], [], []
            for k, v in enumerate(batch.column(2).to_pylist()):
                lost = "�" in v or "ï¿½" in v
                found = [] if lost else scorer.candidates(v)
                if found or lost:
                    at.append(k)
                    lossy.append(lost)
                    chains.append([c for c, _ in found])
                    gains.append([g for _, g in found])
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pick) for c in range(3)), pa.array(lossy, pa.bool_()), pa.array(chains, pa.list_(pa.int32())), pa.array(gains, pa.list_(pa.float64()))],
                ["id", "source", "value", "lossy", "chains", "gains"],
            )

    return rows.mapInArrow(run, f"id {id_type}, source {source_type}, value string, lossy boolean, chains array<int>, gains array<double>")


@F.pandas_udf(StringType())
def _undone(value: pd.Series, chain: pd.Series) -> pd.Series:
    """The texts before their chains."""
    return pd.Series([None if v is None or k is None or k != k else undo(unmixed(v), *CHAINS[int(k)]) or unmixed(v) for v, k in zip(value, chain)], dtype=object)


def _weight(chain: int) -> int:
    """Prior weight of a chain: texts stored as UTF-8 are misread most often."""
    return 50 if CHAINS[chain][0].startswith("utf-8") else 1


def fit(source, totals, sizes, chain, gain, n):
    """Shares of the chains (a row for each source) and of clean records by EM over evidence profiles, all sources at once.

    ``source``, ``sizes`` and ``n`` are given by profile, ``chain`` and ``gain`` by entry of a profile.
    """
    many, width = len(totals), len(CHAINS)
    factor = np.exp(np.minimum(gain, MOST))
    profile = np.repeat(np.arange(len(sizes)), sizes)
    place = source[profile] * width + chain
    used = np.bincount(place, minlength=many * width).reshape(many, width) > 0
    base = np.where(used, prior(), 0.0)
    share, clean = base.copy(), np.full(many, 1 - PRIOR)
    for _ in range(ITERATIONS):
        weight = share.ravel()[place] * factor
        z = clean[source] + np.bincount(profile, weight, len(sizes))
        expected = np.bincount(place, weight * (n / z)[profile], many * width).reshape(many, width)
        share = np.where(used, (expected + WEIGHT * base) / (totals[:, None] + WEIGHT), 0.0)
        clean = np.maximum(CLEAN, 1 - share.sum(axis=1))
    return share, clean


def shares(profiles: list[tuple[list[int], list[float], int]], total: int) -> dict[int, float]:
    """Log shares of the chains in one source; chain -1 is clean."""
    sizes = np.array([len(c) for c, _, _ in profiles], np.int64)
    chain, gain = np.array([k for c, _, _ in profiles for k in c], np.int64), np.array([x for _, g, _ in profiles for x in g], float)
    share, clean = fit(np.zeros(len(sizes), np.int64), np.array([total], float), sizes, chain, gain, np.array([n for *_, n in profiles], float))
    return {-1: math.log(clean[0])} | {int(c): math.log(share[0, c]) for c in np.flatnonzero(share[0])}


def source_shares(batches: Iterator) -> Iterator:
    """``(source, share)`` from profiles sorted by source, a few thousand at a time; a source is never cut."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def logs(table):
        table = table.combine_chunks()
        names = table.column("source").chunk(0)
        cut = np.flatnonzero(np.r_[True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)])
        source = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(names)]))
        chains, gains = table.column("chains").chunk(0), table.column("gains").chunk(0)
        totals, n = (table.column(c).to_numpy().astype(float) for c in ("total", "n"))
        sizes = pc.list_value_length(chains).to_numpy()
        share, clean = fit(source, totals[cut], sizes, chains.flatten().to_numpy().astype(np.int64), gains.flatten().to_numpy(), n)
        with np.errstate(divide="ignore"):
            both = np.log(np.c_[clean, share]).ravel()
        values = pa.array(both, pa.float64(), mask=np.isinf(both))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1, dtype=np.int32) * (len(CHAINS) + 1)), values)
        return pa.RecordBatch.from_arrays([names.take(pa.array(cut)), lists], ["source", "share"])

    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= 20_000:
            table = pa.Table.from_batches(held)
            last = table.column("source")[-1].as_py()
            at = pc.index(table.column("source"), last).as_py()
            if at:
                yield logs(table.slice(0, at))
            held, count = table.slice(at).to_batches(), table.num_rows - at
    if held:
        yield logs(pa.Table.from_batches(held))


def prior():
    """Prior share of every chain."""
    weights = np.array([_weight(k) for k in range(len(CHAINS))], float)
    return PRIOR * weights / weights.sum()


def hot_shares(profiles: DataFrame) -> DataFrame:
    """The same EM for sources of any size: each iteration is one aggregation over profiles, combined before the shuffle.

    ``profiles`` has source, chains, gains, n and total; the result has one row per
    source with the logs of its shares by chain, clean first.
    """
    rows = stage(profiles.select("source", "total", "n", "chains", F.transform("gains", lambda g: F.exp(F.least(g, F.lit(MOST)))).alias("factors")), "hot-profiles")
    base = F.array(*[F.lit(float(x)) for x in prior()])
    used = rows.select("source", "total", F.explode("chains").alias("k")).groupBy("source").agg(F.max("total").alias("total"), F.collect_set("k").alias("used"))
    places = F.sequence(F.lit(0), F.lit(len(CHAINS) - 1))
    first = used.select("source", "total", F.transform(places, lambda k: F.when(F.array_contains("used", k), F.get(base, k)).otherwise(F.lit(0.0))).alias("base"))
    state = stage(first.select("*", F.col("base").alias("share"), F.lit(1 - PRIOR).alias("clean")), "hot-shares")
    for _ in range(ITERATIONS):
        joined = rows.drop("total").join(state.select("source", "share", "clean"), "source")
        joined = joined.select("source", "n", "chains", "clean", F.zip_with("chains", "factors", lambda k, x: F.get(F.col("share"), k) * x).alias("w"))
        z = F.col("clean") + F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)
        parts = joined.withColumn("z", z).select("source", F.explode(F.arrays_zip("chains", "w")).alias("x"), (F.col("n") / F.col("z")).alias("f"))
        sums = parts.groupBy("source", F.col("x.chains").alias("k")).agg(F.sum(F.col("x.w") * F.col("f")).alias("expected"))
        sums = sums.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("k", "expected"))).alias("expected"))
        place = F.posexplode("base").alias("k", "b")
        spread = state.join(sums, "source").select("source", "total", "base", "expected", place)
        share = F.when(F.col("b") > 0, (F.coalesce(F.try_element_at("expected", F.col("k")), F.lit(0.0)) + WEIGHT * F.col("b")) / (F.col("total") + WEIGHT)).otherwise(F.lit(0.0))
        fitted = spread.select("source", "total", "base", F.struct("k", share.alias("s")).alias("x")).groupBy("source").agg(F.first("total").alias("total"), F.first("base").alias("base"), F.array_sort(F.collect_list("x")).alias("x"))
        fitted = fitted.select("source", "total", "base", F.transform("x", lambda x: x["s"]).alias("share"))
        left = 1 - F.aggregate("share", F.lit(0.0), lambda acc, x: acc + x)
        state = stage(fitted.withColumn("clean", F.greatest(left, F.lit(CLEAN))), "hot-shares")
    logs = F.transform(F.concat(F.array("clean"), F.col("share")), lambda x: F.when(x > 0, F.log(x)))
    return state.select("source", logs.alias("share"))


def posteriors(df: DataFrame, id_col: str = "entry_id", value_col: str = "value", source_col: str = "file", hot_profiles: int = HOT_PROFILES) -> DataFrame:
    """``(id, lossy, chain, posterior, repaired)`` of every suspicious record, by its most probable chain."""
    spark = df.sparkSession
    scored = stage(scored_records(df, id_col, value_col, source_col), "evidence")
    key = F.coalesce(F.col("source").cast("string"), F.lit("\u0000"))
    rounded = F.transform("gains", lambda g: F.least(F.round(g / STEP) * STEP, F.lit(MOST)))
    profiles = scored.where(F.size("chains") > 0).groupBy(key.alias("source"), "chains", rounded.alias("gains")).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("\u0000")).alias("source")).agg(F.count(F.lit(1)).alias("total"))
    profiles = stage(profiles.join(totals, "source"), "profiles")

    hot = stage(profiles.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_profiles).select("source"), "hot-sources")
    # a number of partitions of its own: the work is in the profiles, not in their bytes
    light = profiles.join(hot, "source", "left_anti").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source").sortWithinPartitions("source")
    fitted = light.select("source", "total", "n", "chains", "gains").mapInArrow(source_shares, "source string, share array<double>")
    if not hot.isEmpty():
        fitted = fitted.unionByName(hot_shares(profiles.join(hot, "source", "left_semi")))
    fitted = stage(fitted, "shares")
    rows = scored.withColumn("source", key).join(fitted, "source", "left")
    logs = F.zip_with("chains", "gains", lambda c, g: F.coalesce(F.get(F.col("share"), c + 1), F.lit(-50.0)) + g)
    rows = rows.select("id", "value", "lossy", "chains", logs.alias("logs"), F.coalesce(F.get("share", F.lit(0)), F.lit(0.0)).alias("clean"))
    best = F.array_position("logs", F.array_max("logs")).cast("int") - 1
    rows = rows.withColumn("best", F.when(F.size("logs") > 0, best))
    odds = F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(F.least(x - F.col("clean"), F.lit(60.0))))
    return rows.select(
        F.col("id").alias(id_col),
        "lossy",
        F.get("chains", F.col("best")).alias("chain"),
        F.when(F.col("lossy"), 1.0).otherwise(odds / (1 + odds)).alias("posterior"),
        _undone(F.col("value"), F.get("chains", F.col("best"))).alias("repaired"),
    )


def garbled(df: DataFrame, threshold: float = 0.5, **columns) -> DataFrame:
    """Records whose text is garbled: chain, posterior and, where it can be regained, the original text."""
    names = F.array(*[F.lit(f"{r} read as {w}") for r, w in CHAINS])
    found = posteriors(df, **columns).where(F.col("posterior") > threshold)
    return found.withColumn("chain", F.when(F.col("lossy"), "lost").otherwise(F.get(names, F.col("chain")))).withColumn("repaired", F.when(~F.col("lossy"), F.col("repaired")))


def p4_found(df: DataFrame) -> DataFrame:
    return garbled(df).select("entry_id")
