"""Text normalisers and id padding (column expressions).

Spark has no NFKD or HTML-unescape builtin, so each normaliser has two paths. Rows
of ASCII text and Latin letters - accented names and cities are the normal case -
are folded with native JVM expressions: a character table for ``translate``, built
by rule from the Unicode data, and plain replacements of the common entities. Every
other row (other scripts, rare entities) goes through one Arrow ``pandas_udf``,
which is fed NULL for native rows.
"""

from __future__ import annotations

import html
import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE_RUN = re.compile(r"\s+")
_EDGE_NON_WORD = re.compile(r"^\W+|\W+$")
_NOT_UPPER_ALNUM_SPACE = re.compile(r"[^A-Z0-9 ]+")

# Entities decoded natively: written in full, so that what follows cannot change
# their meaning. The ampersand goes last (an entity is decoded once).
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
             ("&nbsp;", " "), ("&amp;", "&"))
_LETTERS = range(0xC0, 0x250)  # Latin-1 and Latin Extended letters
_BLANKS = "\t\n\x0b\x0c\r "


def _fold_char(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii").upper()


def _fold_char_strict(ch: str) -> str:
    marks_off = "".join(c for c in unicodedata.normalize("NFKD", ch.upper()) if not unicodedata.combining(c))
    return re.sub("[^A-Z0-9 ]+", "", marks_off)


def _ranges(chars: list[str]) -> str:
    """Characters as the ranges of a character class (a class that lists hundreds of
    them one by one is tried one by one)."""
    out: list[list[str]] = []
    for ch in sorted(chars):
        if out and ord(ch) == ord(out[-1][1]) + 1:
            out[-1][1] = ch
        else:
            out.append([ch, ch])
    return "".join(f"{a}-{b}" for a, b in out)


def _table(fold) -> tuple[str, str, str]:
    """Arguments of ``translate`` - the letters that become one character, then those
    that vanish, and the characters they become - and all these letters as a class.
    Letters that become several characters are left to the general path."""
    letters = [chr(c) for c in _LETTERS if chr(c).isalpha()]
    one = [c for c in letters if len(fold(c)) == 1]
    none = [c for c in letters if not fold(c)]
    small = string.ascii_lowercase  # upper-cased in the same pass
    return small + "".join(one + none), small.upper() + "".join(map(fold, one)), _ranges(one + none)


_FOLD_FROM, _FOLD_TO, _FOLD_CLASS = _table(_fold_char)
_STRICT_FROM, _STRICT_TO, _STRICT_CLASS = _table(_fold_char_strict)


def _native_rows(letters: str) -> str:
    """Pattern of texts that the native path folds. ``\\z`` is the absolute end:
    Java's ``$`` would also match before a final line break."""
    return "^[" + _BLANKS.replace(" ", "") + "\\x20-\\x7E" + letters + "]*\\z"


def fold_text(text: str | None) -> str | None:
    """Lenient form: unescape, fold to ASCII, upper-case, squeeze whitespace.

    NULL and '' give NULL; characters without an ASCII decomposition are
    dropped (so ``ß`` disappears); punctuation is kept.
    """
    if text is None or text == "":
        return None
    decoded = unicodedata.normalize("NFKD", html.unescape(text))
    ascii_only = decoded.encode("ascii", "ignore").decode("ascii")
    return _SPACE_RUN.sub(" ", ascii_only.upper().strip())


def fold_text_strict(text: str | None) -> str | None:
    """Strict form: only A-Z, 0-9 and single spaces survive.

    NULL gives NULL but '' stays ''. Edge punctuation is trimmed with Unicode
    word rules before upper-casing (so ``ß`` becomes ``SS``), accents are
    removed by dropping combining marks after NFKD.
    """
    if text is None:
        return None
    squeezed = _SPACE_RUN.sub(" ", html.unescape(text).strip())
    upper = _EDGE_NON_WORD.sub("", squeezed).upper()
    no_marks = "".join(ch for ch in unicodedata.normalize("NFKD", upper)
                       if not unicodedata.combining(ch))
    kept = _NOT_UPPER_ALNUM_SPACE.sub("", no_marks)
    return _SPACE_RUN.sub(" ", kept).strip()


@F.pandas_udf(T.StringType())
def _fold_udf(values: pd.Series) -> pd.Series:
    return values.map(fold_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_strict_udf(values: pd.Series) -> pd.Series:
    return values.map(fold_text_strict, na_action="ignore")


def _decode(c: Column) -> Column:
    decoded = c
    for entity, char in _ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(c.contains("&"), decoded).otherwise(c)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{_BLANKS}]+", " "))


def _native_fold(c: Column) -> Column:
    plain = F.translate(_decode(c), _FOLD_FROM, _FOLD_TO)
    return F.when(c == "", F.lit(None)).otherwise(_squeeze(plain))


def _native_fold_strict(c: Column) -> Column:
    word = "A-Za-z0-9_" + _STRICT_CLASS
    trimmed = F.regexp_replace(_squeeze(_decode(c)), f"^[^{word}]+|[^{word}]+$", "")
    plain = F.translate(trimmed, _STRICT_FROM, _STRICT_TO)
    return _squeeze(F.regexp_replace(plain, "[^A-Z0-9 ]+", ""))


def is_native(c: Column, strict: bool = False) -> Column:
    """Whether a text takes the native path: ASCII and Latin letters, and no ``&``
    but those of the common entities."""
    rest = c
    for entity, _ in _ENTITIES:
        rest = F.replace(rest, F.lit(entity), F.lit(""))
    known = ~c.contains("&") | ~rest.contains("&")
    return c.rlike(_native_rows(_STRICT_CLASS if strict else _FOLD_CLASS)) & known


def clean_text(c: Column | str, strict: bool = False) -> Column:
    """Normalise names/cities. ``strict=False`` is the form used by the cleaning
    steps; ``strict=True`` keeps only ``[A-Z0-9 ]``."""
    c = F.col(c) if isinstance(c, str) else c
    native = is_native(c, strict)
    if strict:
        folded, udf = _native_fold_strict(c), _fold_strict_udf
    else:
        folded, udf = _native_fold(c), _fold_udf
    return F.when(native, folded).otherwise(udf(F.when(~native, c)))


def zero_pad(c: Column | str, width: int = 7) -> Column:
    """Left-pad with zeros to ``width``; a leading sign stays in front; longer
    values are unchanged; NULL and '' give NULL."""
    c = F.col(c) if isinstance(c, str) else c
    first = F.substring(c, 1, 1)
    return (F.when(c.isNull() | (c == ""), F.lit(None))
            .when(F.length(c) >= width, c)
            .when(first.isin("+", "-"), F.concat(first, F.lpad(F.substring(c, 2, width), width - 1, "0")))
            .otherwise(F.lpad(c, width, "0")))
