"""Evaluation texts leaking into a corpus (problem 7).

Pigeonhole edit matching. Every window of a test item that counts as a leak is
to be found even with ``budget`` edits, so the item is cut into pieces so short
that each window holds budget + 1 whole ones: one of them must occur exactly.
An automaton over all pieces scans each document once; each hit is verified by
Myers' bit-parallel distance over the windows that hold the piece, and the
longest exact run at the hit is measured. A leak with run >= window is exact.

The items are a stated query set; the automaton over their pieces is built once
and goes to each executor, and the corpus is neither shuffled nor collected.
Sets of more than ``most`` bytes of text are searched in several passes over
the corpus, so that no executor holds more at once.

Defined results: null and '' texts and items shorter than the window never
match; characters that are no letters or digits, case and the differences that
problem 5 folds are ignored on both sides; repeated documents each match.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.canon import AS_LATIN, fold

_WORD = re.compile(r"[^\W_]+")
_LOOKS = str.maketrans({k.casefold(): v.casefold() for k, v in AS_LATIN.items()})
_HAN = re.compile("[㐀-鿿豈-﫿]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
CHARS, WORDS = 24, 12  # shortest run that counts, for items in Chinese and for others


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits of the folded text; look-alike letters are one."""
    return _WORD.findall(fold(text).casefold().translate(_LOOKS)) if text else []


def distance_within(pattern: Sequence, text: Sequence, most: int) -> bool:
    """Whether the pattern occurs somewhere in the text with at most ``most`` edits (Myers' bit vectors)."""
    m = len(pattern)
    if m <= most:
        return True
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high, pv, mv, score = (1 << m) - 1, 1 << m - 1, (1 << m) - 1, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score <= most:
                return True
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return False


class _Side:
    """Pieces of all items that are compared in one unit, characters or words."""

    def __init__(self, window: int, budget: int):
        self.window, self.budget = window, budget
        # each window holds budget + 1 whole pieces of this size at this stride
        self.size = max(1, (window + 1) // (budget + 2))
        while (window - self.size + 1) // self.size < budget + 1 and self.size > 1:
            self.size -= 1
        self.fields: list[tuple[int, Sequence]] = []
        self.at: dict[str, list[tuple[int, int]]] = {}
        self.automaton = None

    def add(self, item: int, units: Sequence) -> None:
        if len(units) < self.window:
            return
        self.fields.append((item, units))
        for o in range(0, len(units) - self.size + 1, self.size):
            self.at.setdefault(self.text(units[o : o + self.size]), []).append((len(self.fields) - 1, o))

    def text(self, units: Sequence) -> str:
        return units if isinstance(units, str) else "\x01" + "\x01".join(units) + "\x01"

    def close(self) -> _Side:
        if self.at:
            self.automaton = ahocorasick.Automaton()
            for piece in self.at:
                self.automaton.add_word(piece, piece)
            self.automaton.make_automaton()
        return self

    def matches(self, units: Sequence) -> dict[int, tuple[int, int]]:
        """item -> (longest exact run, 1 if some window matched within the budget)."""
        found: dict[int, tuple[int, int]] = {}
        if self.automaton is None or len(units) < self.size:
            return found
        text = self.text(units)
        starts = None
        if not isinstance(units, str):
            starts, p = [], 0
            for w in units:
                starts.append(p)
                p += len(w) + 1
        done: set[tuple[int, int, int]] = set()
        for last, piece in self.automaton.iter(text):
            first = last - len(piece) + 1
            p = first if starts is None else bisect_right(starts, first) - 1
            for f, o in self.at[piece]:
                item, field = self.fields[f]
                a = 0
                while o - a > 0 and p - a > 0 and field[o - a - 1] == units[p - a - 1]:
                    a += 1
                key = (f, p - o, o - a)
                if key in done:
                    continue
                done.add(key)
                if not self._verified(field, o, units, p):
                    continue
                b = self.size
                while o + b < len(field) and p + b < len(units) and field[o + b] == units[p + b]:
                    b += 1
                found[item] = (max(a + b, found.get(item, (0, 0))[0]), 1)
        return found

    def _verified(self, field: Sequence, o: int, units: Sequence, p: int) -> bool:
        """Some window of the item that holds the piece lies in the document within the budget."""
        spare = self.window - self.size
        for w in sorted(range(max(0, o - spare), min(o, len(field) - self.window) + 1), key=lambda w: abs(w - o + spare // 2)):
            a = p - (o - w)
            if distance_within(field[w : w + self.window], units[max(0, a - self.budget) : a + self.window + self.budget], self.budget):
                return True
        return False


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, fields: list[str], budget: int = 1, most: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, run, window): the items of which a document holds a window within the budget.

    ``run`` is the longest exact run in the item's unit, ``window`` the length
    that counts.
    """
    wanted = items.select(F.col(item_id).cast("long").alias("i"), *fields).where("i is not null").distinct()
    size = wanted.agg(F.sum(sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in fields), F.lit(0)))).first()[0] or 0
    passes = max(1, -(-size // most))
    found = [_pass(documents, wanted.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == n) if passes > 1 else wanted, doc_id, text, item_id, budget) for n in range(passes)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _pass(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, budget: int) -> DataFrame:
    chars, tokens = _Side(CHARS, budget), _Side(WORDS, budget)
    for item, *texts in items.toLocalIterator():
        # the unit is that of the item as a whole: a quoted term of the other script doesn't change it
        whole = "".join(t or "" for t in texts)
        chinese = 3 * len(_HAN.findall(whole)) > len(_LATIN.findall(whole))
        for t in texts:
            units = words(t)
            if chinese:
                chars.add(item, "".join(units))
            else:
                tokens.add(item, units)
    shared = documents.sparkSession.sparkContext.broadcast((chars.close(), tokens.close()))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars, tokens = shared.value
        for pdf in batches:
            rows = []
            for doc, t in zip(pdf["d"], pdf["t"]):
                units = words(t)
                for side, us in ((chars, "".join(units)), (tokens, units)):
                    rows += [(doc, item, run, side.window) for item, (run, _) in side.matches(us).items()]
            yield pd.DataFrame(rows, columns=["d", "i", "run", "window"])

    return documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null and t <> ''").mapInPandas(search, "d long, i long, run int, window int").withColumnsRenamed({"d": doc_id, "i": item_id})
