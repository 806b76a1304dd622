"""Pieces of at most a given size, cut at the strongest natural boundary and overlapping.

Boundaries have strengths. For each piece a sparse table answers which cut in the permissible window is strongest, the rightmost
of equals; the next piece steps back by the overlap to the start of a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HARD, WORD, SENTENCE, LINE, PARAGRAPH, CLAUSE = range(6)
KINDS = ("hard", "word", "sentence", "line", "paragraph", "clause")
END = "end"

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

_WHITE = np.array(sorted(map(ord, WHITE_SPACE)), dtype=np.uint32)
_SENTENCE_END = re.compile(rf"[.!?…;:][\"'”’»)\]]*[{WHITE_SPACE}]+")
_LINE_END = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])+[^\S\n\r]*")
_BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_CLAUSE_START = re.compile(r"(?:(?<=\n)|(?<=\r))(?=(?:Điều|Chương|Mục|Phần|Article|Section)\s+[\dIVXLC]|\d{1,3}[.)/]\s|\w[)]\s|[-*+•]\s|#{1,6}\s)")

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType(), False),
            T.StructField("start", T.IntegerType(), False),
            T.StructField("end", T.IntegerType(), False),
            T.StructField("cut", T.StringType(), False),
            T.StructField("text", T.StringType(), False),
        ]
    ),
    False,
)


def boundary_strengths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For every position, how strong a cut before it is, and whether it holds white space. Only cuts next to white space are boundaries."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    white = np.isin(codes, _WHITE)
    strength = np.zeros(len(text) + 1, dtype=np.int8)
    strength[1:-1] = np.where(white[1:] | white[:-1], WORD, HARD)
    for pattern, value in ((_SENTENCE_END, SENTENCE), (_LINE_END, LINE), (_BLANK_LINE, PARAGRAPH)):
        for found in pattern.finditer(text):
            strength[found.end()] = max(strength[found.end()], value)
    for found in _CLAUSE_START.finditer(text):
        strength[found.start()] = CLAUSE
    return strength, white


class RangeMaximum:
    """Where the largest value of a range stands, the rightmost of equals; windows are at most ``width`` long."""

    def __init__(self, values: np.ndarray, width: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        step = 1
        while 2 * step <= min(width, len(values)):
            left, right = self.levels[-1][: len(values) - 2 * step + 1], self.levels[-1][step : len(values) - step + 1]
            self.levels.append(np.where(values[right] >= values[left], right, left))
            step *= 2

    def last_max(self, low: int, high: int) -> int:
        """The position for the range from ``low`` to ``high``, both included."""
        level = (high - low + 1).bit_length() - 1
        left, right = self.levels[level][low], self.levels[level][high - (1 << level) + 1]
        return int(right if self.values[right] >= self.values[left] else left)


def split_text(text: str, limit: int, overlap: int, least: int) -> list[tuple[int, int, int, str, str]]:
    """Pieces as (number, start, end, kind of the cut at the end, text), trimmed of white space at both ends.

    A cut lies ``least`` to ``limit`` characters behind the piece's start if there is a boundary; else anywhere in reach; only a run
    of more than ``limit`` characters without white space is cut ``hard``. White space alone makes no piece.
    """
    strength, white = boundary_strengths(text)
    solid = np.flatnonzero(~white)
    if not len(solid):
        return []
    start, stop = int(solid[0]), int(solid[-1]) + 1
    table = RangeMaximum(strength, limit) if stop - start > limit else None
    word_starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    out, covered = [], start
    while stop - start > limit:
        high = start + limit
        cut = table.last_max(max(start + least, covered + 1), high)
        if strength[cut] == HARD:
            cut = table.last_max(covered + 1, high)
        if strength[cut] == HARD and start < covered and not _inside_run(white, covered):
            start = int(solid[np.searchsorted(solid, covered)])  # the overlap takes the room that the next word needs
            covered = start
            continue
        if strength[cut] == HARD:
            cut = high
        end = int(solid[np.searchsorted(solid, cut) - 1]) + 1
        out.append((len(out), start, end, KINDS[strength[cut]], text[start:end]))
        following = int(solid[np.searchsorted(solid, cut)])
        back = _step_back(word_starts, cut, following, overlap, start, strength[cut] == HARD)
        start, covered = back, following
    out.append((len(out), start, stop, END, text[start:stop]))
    return out


def _inside_run(white: np.ndarray, position: int) -> bool:
    return position > 0 and not white[position] and not white[position - 1]


def _step_back(word_starts: np.ndarray, cut: int, following: int, overlap: int, start: int, hard: bool) -> int:
    """The first word start in reach of the overlap, else, inside a run that is cut hard, the overlap itself."""
    at = int(np.searchsorted(word_starts, max(cut - overlap, start + 1)))
    if at < len(word_starts) and word_starts[at] < following:
        return int(word_starts[at])
    return max(cut - overlap, start + 1) if hard else following


def with_pieces(df: DataFrame, column: str, into: str, limit: int = 1000, overlap: int = 150, least: int = 400) -> DataFrame:
    """Adds ``into``: the array of pieces of ``column`` (piece, start, end, cut, text), lengths in code points.

    Null stays null; the empty text and white space alone give an empty array; a text within the limit gives one piece, trimmed.
    ``cut`` names the boundary that ends the piece: clause, paragraph, line, sentence, word, hard, or end. Rows are kept as they are.
    """
    if into in df.columns:
        raise ValueError(f"column {into} is there already")
    if not 0 <= overlap < least <= limit:
        raise ValueError("0 <= overlap < least <= limit must hold")

    @F.pandas_udf(PIECES)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda text: [_as_row(p) for p in split_text(text, limit, overlap, least)], na_action="ignore")

    return df.withColumn(into, pieces(F.col(column)))


def _as_row(piece: tuple) -> dict:
    return dict(zip(("piece", "start", "end", "cut", "text"), piece))


def oversized(df: DataFrame, key: str, column: str, limit: int = 1000) -> DataFrame:
    """One row (key, text) per key whose text is longer than the limit. Of different texts under one key the smallest counts; rows
    with a null key or text take no part."""
    rows = df.select(F.col(key).alias(key), F.col(column).alias("text")).where(F.col(key).isNotNull() & (F.length("text") > limit))
    return rows.groupBy(key).agg(F.min("text").alias("text"))
