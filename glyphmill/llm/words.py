"""Words of a text: maximal runs of letters, marks and numbers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache


@lru_cache(maxsize=1)
def word_finder() -> Callable[[str], list[str]]:
    """A function that lists the words of a text.

    The standard engine knows letters and numbers; marks of the basic plane are
    added to its class.  Only texts with marks beyond that plane take the general way.
    """
    import regex

    general = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
    ascii_only = re.compile(r"[A-Za-z0-9]+").findall
    marks = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c))[0] == "M")
    simple = re.compile(rf"[\w{marks}]+").findall
    beyond = re.compile("[\U00010000-\U0010ffff]").findall

    def words(text: str) -> list[str]:
        if text.isascii():
            return ascii_only(text)
        if any(unicodedata.category(c)[0] == "M" for c in set(beyond(text))):
            return general(text)
        return simple(text.replace("_", " "))

    return words
