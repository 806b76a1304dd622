"""One consistent form for text that looks the same in different characters.

The consistent form is NFC, with full-width and half-width forms, spaces, hyphens and look-alike letters written plainly and
characters without width removed. What a reader can see is kept: letter case, accents, superscripts, fractions, signs, line ends.

Most text is already in that form. Quick-check properties tell which characters can be part of an unstable segment; only the
segments around them are normalised, with the starter before and the marks after as context, and spliced into the unchanged text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut_lineage

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Ð": "Đ", "Ɖ": "Đ",
    "ɑ": "a", "ɡ": "g",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g",
}
# Hyphens drawn like the plain one.
HYPHENS = "‐‑⁃﹣－−"

# Default-ignorable characters beside those that the properties below find: bidi marks, embeddings and isolates, variation selectors.
_IGNORABLE = {0x034F, 0x061C, *range(0x180B, 0x1810), *range(0x202A, 0x202F), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

_COMPATIBLE = ("<wide>", "<narrow>", "<noBreak>")


@cache
def _replacements() -> dict[int, str]:
    """What single characters become before composition: from the Unicode properties, and the hyphens above."""
    table = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" and unicodedata.bidirectional(char) in ("BN", "L", "R") or code in _IGNORABLE:
            table[code] = ""
        elif kind == "Zs":
            table[code] = " "
        elif unicodedata.decomposition(char).startswith(_COMPATIBLE):
            table[code] = unicodedata.normalize("NFKC", char)
    return table | {ord(h): "-" for h in HYPHENS}


def _ranges(codes: list[int]) -> str:
    """The body of a character class, valid for Python and Java."""
    parts, start = [], None
    for code, following in zip(codes, [*codes[1:], -1]):
        start = code if start is None else start
        if following != code + 1:
            parts.append(_class_char(start) + (f"-{_class_char(code)}" if code > start else ""))
            start = None
    return "".join(parts)


def _class_char(code: int) -> str:
    return f"\\x{{{code:X}}}"


@cache
def unstable_class() -> str:
    """Characters that the quick check does not pass: those that are replaced, that NFC changes, or that may combine with what is before."""
    codes = set(_replacements())
    codes |= {ord(c) for c in LOOK_ALIKES}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char) or 0xD7FF < code < 0xE000 or unicodedata.is_normalized("NFC", char) is False or 0x1160 < code < 0x1200:
            codes.add(code)
    return _ranges(sorted(c for c in codes if not 0xD800 <= c <= 0xDFFF))


@cache
def _segment() -> re.Pattern:
    """A word that holds an unstable character. The whole word is the context: look-alikes are judged by the letters next to them, and a
    mark belongs to the starter before it."""
    body = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", unstable_class())
    return re.compile(rf"(?<![^ \t\r\n])[^ \t\r\n]*[{body}][^ \t\r\n]*")


@cache
def _words() -> regex.Pattern:
    return regex.compile(r"[\p{L}\p{M}]+")


@cache
def _foreign() -> regex.Pattern:
    return regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Cherokee}\p{Script=Armenian}]")


_TO_LATIN = str.maketrans(LOOK_ALIKES)


def _plain_word(match: regex.Match) -> str:
    """A word in one script. Letters of another script that cannot be Latin, in a word without Latin letters, leave it as it is."""
    word = match[0]
    if not _foreign().search(word):
        return word.translate(_TO_LATIN)
    latin = regex.search(r"\p{Script=Latin}", word)
    own = [c for c in word if _foreign().match(c) and c not in LOOK_ALIKES]
    return word.translate(_TO_LATIN) if latin or not own else word


def canonical_text(text: str) -> str:
    """The consistent form of one text; a text without unstable segments is returned as it is.

    The empty text stays empty. Applying it twice gives the same as once.
    """
    return _segment().sub(lambda m: _canonical_segment(m[0]), text)


def _canonical_segment(segment: str) -> str:
    parts = unicodedata.normalize("NFD", segment).translate(_replacements())
    return unicodedata.normalize("NFC", _words().sub(_plain_word, parts))


@cache
def _common_class() -> str:
    """The stable characters of the blocks that Latin text is made of; a class so short that the JVM tests it fast."""
    unstable = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", unstable_class()) + "]")
    blocks = [*range(0x0250), *range(0x1E00, 0x1F00), *range(0x2013, 0x2028), *range(0x2030, 0x205F)]
    return _ranges([code for code in blocks if not unstable.match(chr(code))])


def needs_work(text: Column) -> Column:
    """Whether a text may hold unstable segments: it has a character outside the stable Latin ones. Evaluated in the JVM; the full
    quick check follows in ``canonical_text``."""
    return text.rlike(f"[^{_common_class()}]")


@F.pandas_udf(T.StringType())
def _canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(canonical_text, na_action="ignore")


def with_canonical(df: DataFrame, column: str, into: str) -> DataFrame:
    """Adds ``into``, the consistent form of ``column``. Null stays null.

    Rows are kept as they are, repeated or not; ``into`` must be a new name. Only rows that fail the quick check go to Python.
    """
    if into in df.columns:
        raise ValueError(f"column {into} is there already")
    unstable = F.when(needs_work(F.col(column)), F.col(column))
    return df.withColumn(into, F.coalesce(_canonical(unstable), F.col(column)))


def look_alike_pairs(records: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``key_a`` < ``key_b`` of records whose texts look the same without being the same characters.

    Records with a null key or text take no part; a repeated row counts once. Texts are compared by digests of their
    form and of themselves: different texts of one form meet first, then their records, so many records with one text are never
    compared with each other.
    """
    rows = records.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_key").isNotNull() & F.col("_text").isNotNull())
    formed = with_canonical(rows, "_text", "_form").select("_key", F.sha2("_form", 256).alias("_form"), F.sha2("_text", 256).alias("_raw"))
    formed = cut_lineage(formed.distinct())  # several readers follow; texts are formed once
    texts = formed.select("_form", "_raw").distinct()
    different = texts.join(texts.withColumnRenamed("_raw", "_other"), "_form").where("_raw < _other").select("_raw", "_other")
    own, other = formed.select(F.col("_raw"), F.col("_key").alias("_a")), formed.select(F.col("_raw").alias("_other"), F.col("_key").alias("_b"))
    pairs = different.join(own, "_raw").join(other, "_other").where("_a != _b")
    return pairs.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b")).distinct()
