"""Text columns: words, letter case, plural endings and diacritics.

Everything here is a plain Catalyst expression except ``nfc`` and
``strip_marks_unicode``: Spark has no Unicode normalisation, so those two go
through an Arrow UDF that only receives the rows that need it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A word starts and ends with a letter and may hold - : . / _ and digits inside.
# Letters and joiners are disjoint, so nothing ever needs to backtrack: the possessive
# form matches the same words in a loop, where the plain one recurses once per joiner.
WORD = r"\p{L}++(?:[-:./_0-9]++\p{L}++)*+"
# The browser form of the same rule also joins over a question mark.
WORD_BROWSER = r"\p{L}++(?:[-:./_0-9?]++\p{L}++)*+"
# A compound made of letters and hyphens only may be split at its hyphens.
HYPHENATED = r"^[\p{L}-]++$"


def _maybe_not_nfc() -> str:
    """A character class of what normalisation can touch: marks, jamo vowels and
    finals, and the code points that are never in normal form on their own."""
    ranges: list[list[int]] = []
    for c in range(0x80, 0x10000):
        if 0xD800 <= c < 0xE000 or unicodedata.is_normalized("NFC", chr(c)):
            continue
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    body = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)
    return rf"[\p{{M}}\x{{1160}}-\x{{11ff}}{body}\x{{1d15e}}-\x{{1d1c0}}\x{{2f800}}-\x{{2fa1d}}]"


_MAYBE_NOT_NFC = _maybe_not_nfc()
# One or two range tests per character decide nearly every Latin text: nothing below
# the combining marks changes on its own, nor does typographic punctuation. As ranges: the
# negated class of the others is met ten times more slowly.
_UNUSUAL = r"[\x{300}-\x{200f}\x{2028}-\x{20ab}\x{20ad}-\x{10ffff}]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


@F.pandas_udf(StringType())
def _nfc_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _strip_batch(s: pd.Series) -> pd.Series:
    def strip(x):
        if x is None:
            return None
        flat = unicodedata.normalize("NFD", x)
        return "".join("oe" if c == "œ" else c for c in flat if unicodedata.category(c) != "Mn")

    return s.map(strip)


def nfc(text: Column | str) -> Column:
    """NFC form. Rows that cannot change are masked out before the UDF."""
    t = _c(text)
    return F.coalesce(_nfc_batch(F.when(t.rlike(_UNUSUAL) & t.rlike(_MAYBE_NOT_NFC), t)), t)


# The accented letters of the Latin languages and what remains of each.
_MARKED = "àâäáãåéèêëíìîïóòôöõúùûüýÿçñāēīōūȳÀÂÄÁÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝŸÇÑĀĒĪŌŪȲ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuyycnaeiouyAAAAAAEEEEIIIIOOOOOUUUUYYCNAEIOUY"


def strip_marks(text: Column | str) -> Column:
    """Letters without their diacritics, œ as oe; composed Latin letters."""
    return F.replace(F.translate(_c(text), _MARKED, _PLAIN), F.lit("œ"), F.lit("oe"))


def strip_marks_unicode(text: Column | str) -> Column:
    """``strip_marks`` for every script, through NFD, only where Latin is not enough."""
    t = strip_marks(text)
    return F.coalesce(_strip_batch(F.when(t.rlike(r"[^\x00-\x7f]"), t)), t)


def capitalize(w: Column | str) -> Column:
    w = _c(w)
    return F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))


def uncapitalize(w: Column | str) -> Column:
    w = _c(w)
    return F.concat(F.lower(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))


def is_capitalized(w: Column | str) -> Column:
    return _c(w).rlike(r"^\p{Lu}")


def is_all_upper(w: Column | str) -> Column:
    return _c(w).rlike(r"^\p{Lu}+$")


def lowercase_if_all_upper(w: Column | str) -> Column:
    """The lower-case word when every character is a capital, else null."""
    w = _c(w)
    return F.when(is_all_upper(w), F.lower(w))


def drop_last(w: Column | str, n: int = 1) -> Column:
    w = _c(w)
    return F.substr(w, F.lit(1), F.length(w) - n)


def depluralize(w: Column | str) -> Column:
    """The word without one final s, or null when it has none."""
    w = _c(w)
    return F.when(F.endswith(w, F.lit("s")), drop_last(w))


def words(text: Column | str, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))


def separators(text: Column | str, pattern: str = WORD) -> Column:
    """The text between words: always one more element than ``words``."""
    return F.split(_c(text), pattern, -1)


def weave(seps: Column | str, ws: Column | str) -> Column:
    """Put separators and words back together; the inverse of the two above."""
    return F.array_join(
        F.zip_with(_c(seps), _c(ws), lambda s, w: F.concat(s, F.coalesce(w, F.lit("")))), ""
    )


def tokens(text: Column | str, pattern: str = WORD) -> Column:
    """``array<struct<kind, tok>>`` alternating ``out`` and ``word``; lossless."""
    pairs = F.zip_with(
        separators(text, pattern),
        words(text, pattern),
        lambda s, w: F.array(
            F.struct(F.lit("out").alias("kind"), s.alias("tok")),
            F.struct(F.lit("word").alias("kind"), w.alias("tok")),
        ),
    )
    return F.filter(F.flatten(pairs), lambda t: F.length(t["tok"]) > 0)


def split_hyphens(w: Column) -> Column:
    """Parts and dashes of a compound, in order."""
    return F.filter(F.split(w, r"(?<=-)|(?=-)"), lambda p: F.length(p) > 0)
