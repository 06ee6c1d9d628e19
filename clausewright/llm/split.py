"""Oversized texts cut at natural boundaries with a given overlap (problem 1).

Every gap between two characters has a boundary strength. A sparse table
answers "strongest gap in this window, the rightmost of equals" in constant
time; each piece ends at the strongest gap of its permissible window and the
next begins ``overlap`` characters before that end. The window is all that the
limit permits: from the first character that the piece before didn't hold (or
from ``least`` characters on, if short pieces are unwanted) to the limit.

Defined results: null, '' and texts within the limit come out as one piece
(null and '' as none); a text without any pause is cut at the limit, inside a
word only if the word alone exceeds the window; limits below 1 or an overlap
not below the limit raise ValueError.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strength of a gap by what stands before it.
PARAGRAPH, LINE, SENTENCE, CLAUSE, COMMA, SPACE, ANY, WORD, NEVER = 8, 7, 6, 5, 4, 3, 2, 1, 0
_RULES = [
    (SPACE, re.compile(r"\s+")),
    (COMMA, re.compile(r"[,，、]+(?!\d)[”’\"')）」』】》]*\s*")),
    (CLAUSE, re.compile(r"[;；:：]+(?!\d)[”’\"')）」』】》]*\s*")),
    (SENTENCE, re.compile(r"(?:[。！？!?…．]+(?!\d)|(?<![\W_][A-Za-z])(?<!\b[A-Z][a-z])(?<!\b[A-Z][a-z]{2})\.+(?=\s+[A-Z]|\s*$|[一-鿿]))[”’\"')）」』】》]*\s*")),
    (LINE, re.compile(r"[ \t]*\r?\n[ \t]*")),
    (PARAGRAPH, re.compile(r"\n\s*\n\s*")),
]
_WORD = re.compile(r"[A-Za-zÀ-ɏͰ-ԯ0-9]+(?:[.,:/'’\-·][A-Za-zÀ-ɏͰ-ԯ0-9]+)*")


def strengths(text: str) -> np.ndarray:
    """Strength of the gap before each position 0..len; gaps inside words, numbers and combined characters are weak."""
    s = np.full(len(text) + 1, ANY, np.int8)
    for m in _WORD.finditer(text):
        s[m.start() + 1 : m.end()] = WORD
    for value, rule in _RULES:
        for m in rule.finditer(text):
            s[m.end()] = max(s[m.end()], value)
    if not text.isascii():
        for i, ch in enumerate(text):
            if unicodedata.category(ch) in ("Mn", "Mc", "Me", "Cf"):
                s[i] = NEVER
    return s


class StrongestGap:
    """Sparse table over strengths: the rightmost position of the maximum in a window, in constant time."""

    def __init__(self, strength: np.ndarray, longest: int):
        n = len(strength)
        # later positions win ties because the key grows with the position
        key = strength.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels = n, [key]
        width = 1
        while 2 * width <= min(longest, n):
            prev = self.levels[-1]
            self.levels.append(np.maximum(prev[: n - 2 * width + 1], prev[width : n - width + 1]))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """Position in lo..hi (both included)."""
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - (1 << k) + 1]) % (self.n + 1))


def pieces(text: str, limit: int, overlap: int, least: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut) of each piece; ends and starts count code points. Only the last piece may be shorter than ``least``."""
    if limit < 1 or not 0 <= overlap < limit or least > limit:
        raise ValueError(f"limit {limit} and overlap {overlap} leave no room for a piece")
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH)] if n else []
    strength = strengths(text)
    index = StrongestGap(strength, limit)
    out, start = [], 0
    while n - start > limit:
        end = index.query(start + max(overlap + 1, least), start + limit)
        out.append((start, end, int(strength[end])))
        start = end - overlap
    out.append((start, n, PARAGRAPH))
    return out


def split_oversized(texts: DataFrame) -> DataFrame:
    """Pieces of (field_name, row_id, text, max_chars, overlap_chars).

    Out: (field_name, row_id, piece_no, start_pos, end_pos, cut_strength,
    piece). Rows stay whole within a task: a text is one value, its table takes
    8 bytes times the logarithm of the limit for each of its characters.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r.field_name, r.row_id, no, a, b, strong, r.text[a:b])
                for r in pdf.itertuples(index=False)
                if r.text
                for no, (a, b, strong) in enumerate(pieces(r.text, int(r.max_chars), int(r.overlap_chars)), 1)
            ]
            yield pd.DataFrame(rows, columns=["field_name", "row_id", "piece_no", "start_pos", "end_pos", "cut_strength", "piece"])

    return texts.select("field_name", "row_id", "text", "max_chars", "overlap_chars").mapInPandas(cut, "field_name string, row_id long, piece_no int, start_pos int, end_pos int, cut_strength int, piece string")


def oversized(rows: DataFrame, limits: DataFrame, fields: list[str], row_id: str = "row_id") -> DataFrame:
    """The values of ``fields`` above their limit, ready for :func:`split_oversized`; ``limits`` has one row per field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields]))
    long = rows.select(F.col(row_id).alias("row_id"), pairs.alias("v")).select("row_id", "v.field_name", "v.text")
    return long.join(F.broadcast(limits.where(F.col("field_name").isin(fields))), "field_name").where(F.length("text") > F.col("max_chars"))
