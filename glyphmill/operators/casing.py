"""Sentence casing: protected spans, votes on the casing of a value, and recasing.

Positions are kept as spans; the first span at a place wins and a later one that
overlaps it is dropped whole.  Built-in expressions can say this, as folds in
lambdas, but those are interpreted and share nothing, so every token computes the
protected spans anew (50 seconds for 80,000 values).  Here one Arrow-batched pass
computes votes and text together, and only values that a cheap expression lets
through leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphmill.functions import fixed as K

#: White space as in the other rules.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
COMPOUND = re.compile(r"(?<!\w)[A-Za-z]+(?:[/-][A-Za-z]+)+(?!\w)")
ACTION = re.compile(rf"(?<!\w)(?:{K.ACTIONS}){SPACE}+(?:on{SPACE}+|the{SPACE}+)?([A-Za-z][A-Za-z/-]*)(?!\w)", re.IGNORECASE)
TOKEN = re.compile("[A-Za-z']+")
NUMBER = re.compile(rf"(?<!\w)No\.{SPACE}*")
#: Values of several sentences are left alone.
MANY = f"[.!?]{K.WS}+[A-Z]"
#: A capital after the first word, without which there is nothing to vote on.
ABLE = "[^A-Za-z'][A-Z][A-Za-z']*[a-z]|'[A-Z]"

MINOR = frozenset(K.MINOR_WORDS)
Span = tuple[int, int]


def protector(glossary: tuple[tuple[str, str], ...]) -> Callable[[str], list[Span]]:
    """A function that gives the spans whose casing is deliberate: glossary phrases, compounds, targets of actions."""
    phrases = [w for _, w in sorted(((-len(w), i), w) for i, (w, _) in enumerate(glossary) if " " in w)]
    phrase = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, phrases))})(?!\w)", re.IGNORECASE) if phrases else None

    def held(v: str) -> list[Span]:
        spans = [m.span() for m in phrase.finditer(v)] if phrase else []
        spans += [m.span() for m in COMPOUND.finditer(v)]
        spans += [m.span(1) for m in ACTION.finditer(v)]
        out: list[Span] = []
        for a, b in spans:
            if not any(x < b and a < y for x, y in out):
                out.append((a, b))
        return out

    return held


def recaser(glossary: tuple[tuple[str, str], ...], custom: tuple[str, ...] = ()) -> Callable[[str], tuple[str, str]]:
    """A function that gives the vote on a value (``m`` mixed, ``t`` title, ``-`` none) and the value recased where one calls for it."""
    terms = frozenset(x.lower() for w, c in glossary if " " not in w for x in (w, c)) | frozenset(custom)
    held = protector(glossary)

    def content(w: str) -> bool:
        return len(w) > 1 and w.lower() not in MINOR

    def free(w: str, at: int, spans: list[Span]) -> bool:
        return not w.isupper() and w.lower() not in terms and not any(a <= at < b for a, b in spans)

    def titled(w: str) -> bool:
        return "A" <= w[0] <= "Z" and not w.isupper()

    def run(v: str) -> tuple[str, str]:
        plain = NUMBER.sub("", v)
        words = [m for m in TOKEN.finditer(plain) if content(m.group())]
        if len(words) < 3:
            return "-", v
        spans = held(plain)
        voting = [m.group() for m in words[1:] if free(m.group(), m.start(), spans)]
        if not any(map(titled, voting)):
            return "-", v
        vote = "m" if any("a" <= w[0] <= "z" for w in voting) else "t"
        spans, seen, at, out = held(v), False, 0, []
        for m in TOKEN.finditer(v):
            w = m.group()
            if content(w):
                if seen and titled(w) and free(w, m.start(), spans):
                    out += [v[at : m.start()], w[0].lower(), w[1:]]
                    at = m.end()
                seen = True
        return vote, "".join(out) + v[at:]

    return run


def recased(v: Column, glossary: tuple[tuple[str, str], ...], custom: tuple[str, ...] = ()) -> Column:
    """Vote and recased value of a column as one text, the vote first; null where there is nothing to vote on."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        one = recaser(glossary, custom)
        return values.map(lambda x: "".join(one(x)), na_action="ignore")

    return run(F.when(v.rlike(ABLE) & ~v.rlike(MANY), v))


def casing_votes(v: Column, glossary: tuple[tuple[str, str], ...], custom: tuple[str, ...] = (), vote: Column | None = None) -> dict[str, Column]:
    """Conditions ``mixed`` (capitals and lower case) and ``title`` (capitals only) among the words that may vote.

    ``vote`` is the column of ``recased`` where it is at hand.
    """
    vote = F.coalesce(F.substring(recased(v, glossary, custom) if vote is None else vote, 1, 1), F.lit("-"))
    return {"mixed": vote == "m", "title": vote == "t"}


def sentence_case(v: Column, glossary: tuple[tuple[str, str], ...], custom: tuple[str, ...] = ()) -> Column:
    """The value with capitals lowered from the second content word on, where the votes call for it."""
    return F.coalesce(F.substring(recased(v, glossary, custom), 2, 1_000_000_000), v)
