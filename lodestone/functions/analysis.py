"""Folding and tokenising, as Catalyst expressions and, identically, in Python for query text."""

from __future__ import annotations

import contextlib
import contextvars
import re
import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with inner apostrophes and points, keycaps, and single emoji.  Java, RE2 and regex read it alike.
TOKEN_RE = r"_*[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}_]*(?:['’.][\p{L}\p{M}\p{N}_]+)*|[#*]\x{FE0F}?\x{20E3}|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
_TOKEN = regex.compile(TOKEN_RE.replace(r"\x{FE0F}", "️").replace(r"\x{20E3}", "⃣").replace(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "[\U0001f300-\U0001faff☀-➿]"))
KEYCAP = "⃣"
#: Letters that fold to several (fixed values).
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l"}


def _plain_letters() -> dict[str, str]:
    """Lower-case Latin letters with marks, and the letter that is left without them."""
    out = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(point).lower()
        base = unicodedata.normalize("NFD", low)
        if len(low) == 1 and len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            out[low] = base[0]
    return out


_PLAIN = _plain_letters()


#: Whether case counts just now; accents never do.
_CASED: contextvars.ContextVar[bool] = contextvars.ContextVar("cased", default=False)
_UPPER = {k.upper(): v.upper() for k, v in _PLAIN.items() if len(k.upper()) == 1 and k.upper() != k}
_UPPER_SPELLED = {"ẞ": "SS"} | {k.upper(): v.upper() for k, v in SPELLED.items() if len(k.upper()) == 1 and k.upper() != k}


@contextlib.contextmanager
def casing(counts: bool) -> Iterator[None]:
    """Expressions and query texts made within keep the case if it counts."""
    held = _CASED.set(counts)
    try:
        yield
    finally:
        _CASED.reset(held)


def fold(text: Column) -> Column:
    """Lower case, unless case counts, without accents.  Texts of ASCII alone, told by their length in bytes, skip the rest."""
    low = text if _CASED.get() else F.lower(text)
    letters, spelled = (_PLAIN | _UPPER, SPELLED | _UPPER_SPELLED) if _CASED.get() else (_PLAIN, SPELLED)
    plain = F.translate(low, "".join(letters), "".join(letters.values()))
    for letter, several in spelled.items():
        plain = F.replace(plain, F.lit(letter), F.lit(several))
    plain = F.regexp_replace(plain, r"[̀-ͯ]", "")
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(plain)


def fold_text(text: str) -> str:
    letters, spelled = (_PLAIN | _UPPER, SPELLED | _UPPER_SPELLED) if _CASED.get() else (_PLAIN, SPELLED)
    plain = "".join(letters.get(c, c) for c in (text if _CASED.get() else text.lower()))
    for letter, several in spelled.items():
        plain = plain.replace(letter, several)
    return re.sub("[̀-ͯ]", "", plain)


def tokens(text: Column, folded: bool = True) -> Column:
    """The tokens of a text in order; null texts have none.  Underscores alone are no token, a keycap is its sign."""
    found = F.regexp_extract_all(fold(text) if folded else text, F.lit(TOKEN_RE), F.lit(0))
    signs = F.transform(found, lambda x: F.regexp_replace(x, "[️⃣]", ""))
    return F.coalesce(F.when(F.contains(text, F.lit(KEYCAP)), signs).otherwise(found), F.array().cast("array<string>"))


def query_tokens(text: str, folded: bool = True) -> list[str]:
    found = _TOKEN.findall(fold_text(text) if folded else text)
    return [re.sub("[️⃣]", "", t) for t in found]
