"""Sentence boundaries across languages and scripts (problem 3).

A hidden-event n-gram language model sees a possible boundary token between
any two words. Line breaks and the space between two Chinese characters are
certain; every other gap is decided by forward-backward posteriors over the
model, which is trained by expectation maximisation on the corpus itself.

Gaps come in two kinds. *Marked* ones stand at a sentence mark (or at a space
of a script that writes neither spaces between words nor marks): contexts are
counted over all rows, the certain boundaries give the first estimate, and the
rounds settle abbreviations, numberings and quotations. *Unmarked* ones stand
between any other two words or ideographs: uni-, bi- and trigrams of the
stretches between marks say how likely the words are to go on and how likely
to end and to begin a sentence. How often a mark was lost is judged for each
stretch: one that is longer than sentences are, or that no mark closes, is
likelier to have lost some. Words inside quotations and brackets have no gap.

Every context and n-gram counts, however rare. The sums are taken in Spark, and
the model is a table of hashed counts of fixed size (the smaller of two rows of
``2 ** BITS`` slots), so what is sent to the workers is bounded whatever the
corpus: at most 12 bytes for each of the ``2 ** (BITS + 1)`` slots.

Defined results: null, '' and white space give no sentence; end positions
count characters of the raw text, closing marks included, white space and
invisible characters after the sentence excluded.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.canon import fold, fold_char

_CJK = "⺀-⿟々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"
_SPACELESS = "฀-໿က-႟ក-៿"  # Thai, Lao, Burmese, Khmer
_LETTER = rf"[^\W\d_{_CJK}{_SPACELESS}]"
_TOKEN = re.compile(
    rf"""(?P<nl>\s*[\n\r\x0b\x0c\x85  ]\s*)|(?P<sp>\s+)
    |(?P<num>\d+(?:[.．,:：/]\d+)*)
    |(?P<term>[.。！？!?…．｡।؟]+)
    |(?P<abbr>(?<![\w.])(?:(?:[a-z]\.)+[a-z](?![a-z])|(?<!\d\s)(?:[A-Z]\.)+[A-Z](?![A-Za-z])))
    |(?P<word>{_LETTER}+(?:['’·\-]{_LETTER}+)*)
    |(?P<cjk>[{_CJK}]+)|(?P<bare>[{_SPACELESS}]+)|(?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)
_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
# Pairs whose inside belongs to the sentence around them.
_PAIRS = dict(zip("“‘「『《〈«(（【[", "”’」』》〉»)）】]"))
_CLOSERS = set(_PAIRS.values()) | {'"', "'"}
_FORCED, _OPEN, _START, _LOST = "f", "o", "s", "u"
_QUOTES = re.compile(f"[{re.escape(''.join(_PAIRS) + ''.join(_CLOSERS))}\n\r]")
_ODD = re.compile("[⺀-⿟豈-﫿！-～]")
_NO_CAPITAL, _NO_LETTER = re.compile("[^A-Z]+"), re.compile("[^A-Za-z]+")
BITS = 22  # slots of a row of the count table, as a power of two


class Gap(NamedTuple):
    """A place where a sentence may end: position after it, certainty, words around it, tokens since the last gap."""

    end: int
    kind: str
    w: str
    m: str
    x: str
    cls: str
    y: str
    tokens: int


class Stretch(NamedTuple):
    """What stands between two marked gaps: words and ideographs, where each ends, their classes ('o': no gap beside it), the mark after them."""

    names: list[str]
    ends: list[int]
    classes: list[str]
    mark: str


def _spans(text: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets; both ends must stand on one line."""
    out, stack, quote = [], [], None
    for found in _QUOTES.finditer(text):
        ch, i = found.group(), found.start()
        if ch in "\n\r":
            stack, quote = [], None
        elif ch in _PAIRS:
            stack.append((_PAIRS[ch], i))
        elif ch == '"':
            if quote is None:
                quote = i
            else:
                out.append((quote, i))
                quote = None
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == ch:
                    out.append((stack[k][1], i))
                    del stack[k:]
                    break
    return out


def _class(kind: str, token: str) -> str:
    if kind in ("word", "abbr"):
        return "U" if token[0].isupper() else "l"
    return {"num": "#", "cjk": "C", "bare": "B"}.get(kind, "o")


def gaps(raw: str | None) -> list[Gap]:
    """All marked gaps of a text in order, the end of the text included."""
    return scan(raw)[0]


def scan(raw: str | None) -> tuple[list[Gap], list[Stretch]]:
    """Marked gaps of a text in order, the end of the text included, and the stretches between them."""
    if not raw:
        return [], []
    text, place = raw, None
    if not raw.isascii() and _INVISIBLE.search(raw):
        place = [i for i, c in enumerate(raw) if not _INVISIBLE.match(c)]
        text = "".join(raw[i] for i in place)
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text)]
    capitals, letters = len(_NO_CAPITAL.sub("", text)), len(_NO_LETTER.sub("", text))
    shouting = letters > 20 and capitals > 0.8 * letters
    spans = _spans(text)
    odd = not text.isascii() and _ODD.search(text)  # radicals, compatibility ideographs and wide letters count as the usual ones
    inside = bytearray(len(text) + 2)
    for a, b in spans:
        inside[a + 1 : b + 1] = b"\1" * (b - a)
    closes = {b for _, b in spans}

    def name(i: int, last: bool = False) -> tuple[str, str]:
        """Normalised token and its class; of a run of ideographs the first or last one."""
        kind, a, b = tokens[i]
        if kind == "cjk":
            return text[b - 1 if last else a], "C"
        cls = _class(kind, text[a:b])
        return ("#" if kind == "num" else text[a:b].casefold()), ("" if shouting and cls in "Ul" else cls)

    def after(i: int) -> tuple[str, str, str]:
        """Word, class and next word from token i on; an opening quote or bracket is one with what it opens."""
        seen = []
        while i < len(tokens) and len(seen) < 3:
            if tokens[i][0] == "nl" and seen:
                break
            if tokens[i][0] not in ("sp", "nl"):
                seen.append((*name(i), tokens[i][2] - tokens[i][1] > 1 and tokens[i][0] == "cjk"))
            i += 1
        return _ahead(seen)

    out: list[Gap] = []
    parts: list[Stretch] = []
    names: list[str] = []
    ends: list[int] = []
    classes: list[str] = []
    count, fresh, prev = 0, True, -1  # tokens since the last gap; whether a numbering could stand here; last visible token

    def add(end: int, kind: str, i: int, m: str) -> None:
        nonlocal count, fresh, names, ends, classes
        if names:
            parts.append(Stretch(names, ends if place is None else [place[e - 1] + 1 for e in ends], classes, m))
            names, ends, classes = [], [], []
        x, cls, y = after(i)
        w = name(prev, True)[0] if prev >= 0 else ""
        if count or kind == _OPEN:
            out.append(Gap(end if place is None else place[end - 1] + 1, kind, w, m, x, cls, y, count))
        count, fresh = 0, True

    i, mark, mark_end, before = 0, "", -1, -1
    visible_end = 0
    while i < len(tokens):
        kind, a, b = tokens[i]
        if kind == "nl":
            if mark_end == a and before >= 0:  # the mark before the break is what ended the sentence
                out_prev, prev = prev, before
                if out and out[-1].kind == _OPEN and out[-1].end == (mark_end if place is None else place[mark_end - 1] + 1):
                    count += out.pop().tokens + 1
                add(visible_end, _FORCED, i + 1, mark)
                prev = out_prev
            elif visible_end:
                add(visible_end, _FORCED, i + 1, "")
            mark_end = -1
        elif kind == "sp":
            sides = [tokens[j][0] if 0 <= j < len(tokens) else "" for j in (i - 1, i + 1)]
            if sides == ["cjk", "cjk"]:
                add(visible_end, _FORCED, i + 1, "")
            elif sides == ["bare", "bare"]:
                add(visible_end, _OPEN, i + 1, " ")
            elif mark_end == a:
                mark_end = b
                fresh = True
        elif kind == "term":
            j, end = i + 1, b
            while j < len(tokens) and tokens[j][0] == "other" and text[tokens[j][1]] in _CLOSERS and (text[tokens[j][1]] in "'’" or tokens[j][1] in closes):
                end = tokens[j][2]
                j += 1
            m = text[a:end]
            m = m if len(m) < 4 else m[:1] + m[-1:]
            nxt = tokens[j][0] if j < len(tokens) else ""
            last = tokens[i - 1] if i else ("", 0, 0)
            dot = text[b - 1] in ".．" and b - a == 1
            if dot and last[0] == "cjk" and last[2] == a:
                m += "c"  # a dot after an ideograph is no abbreviation's
            shut = inside[end] > 0
            if dot and end == b:
                # glued to a number or a small letter it is a part of a token; after an opening number it is its numbering
                shut |= last[0] in ("word", "abbr") and last[2] == a and nxt == "num"
                shut |= last[0] in ("word", "abbr", "num") and last[2] == a and nxt in ("word", "abbr") and text[tokens[j][1]].islower()
                shut |= last[0] == "num" and last[2] == a and fresh and count == 1
            visible_end = end
            if not shut:
                before = prev
                add(end, _OPEN, j, m)
                mark, mark_end = m, end
            else:
                count += 1
                names.append(text[a])
                ends.append(end)
                classes.append("o")
            prev = j - 1
            i = j - 1
        else:
            if not (kind == "num" and count == 0):
                fresh = fresh and count == 0 and kind == "other"
            if kind == "other" and text[a] in ";；:：":
                fresh = True
            if kind == "cjk":
                count += b - a
                names.extend(map(fold_char, text[a:b]) if odd else text[a:b])
                ends.extend(range(a + 1, b + 1))
                classes.extend("o" * (b - a) if inside[b] else "C" * (b - a))
            else:
                count += 1
                names.append("#" if kind == "num" else (fold(text[a:b]) if odd else text[a:b]).casefold())
                ends.append(b)
                cls = "o" if inside[b] else _class(kind, text[a:b])
                classes.append("w" if shouting and cls in "Ul" else cls)
            prev, visible_end = i, b
            mark_end = -1
        i += 1
    # the end of the text is certain; a mark standing there ended the sentence
    stop = visible_end if place is None else (place[visible_end - 1] + 1 if visible_end else 0)
    if out and out[-1].end == stop:
        out[-1] = out[-1]._replace(kind=_FORCED)
    elif count and visible_end:
        add(visible_end, _FORCED, len(tokens), "")
    return out, parts


def _ahead(seen: list[tuple[str, str, bool]]) -> tuple[str, str, str]:
    """Context from the next tokens: (name, class, whether more ideographs follow in the run)."""
    if not seen:
        return "", "", ""
    (x, cls, more), rest = seen[0], seen[1:]
    if cls == "o" and rest and (x in _PAIRS or x in _CLOSERS):
        x, more, rest = x + rest[0][0], rest[0][2], rest[1:]
    y = "C" if more else (rest[0][0] if x == "#" else rest[0][1] or "l") if rest else ""
    return x, cls, y


def first_words(raw: str) -> tuple[str, str, str]:
    """Word, class and next word at the start of a text."""
    seen: list[tuple[str, str, bool]] = []
    for m in _TOKEN.finditer(_INVISIBLE.sub("", raw)):
        k, t = m.lastgroup, m.group()
        if k not in ("sp", "nl"):
            seen.append(("#" if k == "num" else t[0] if k == "cjk" else t.casefold(), "C" if k == "cjk" else _class(k, t), k == "cjk" and len(t) > 1))
            if len(seen) == 3:
                break
    return _ahead(seen)


def _digest(*key: str) -> int:
    """64 bits that stand for a table's name and a key in it."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(key).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _length_bin(n: int) -> int:
    """Four bins to each doubling of a length."""
    return int(4 * math.log2(max(n, 1)))


@dataclass
class BoundaryModel:
    """Counts of the hidden-event model; all probabilities are smoothed towards shorter contexts."""

    slots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    numbers: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    words: float = 1.0
    kinds: int = 0  # different words
    starts: float = 1.0
    known: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)
    fours: dict = field(default_factory=dict)
    tail: list | None = None
    table: memoryview | None = None

    # Share of marks that end a sentence before anything is known, and sentences of one or two tokens.
    PRIOR = {".": 0.6, "．": 0.7, ".c": 0.98, "．c": 0.98, " ": 0.5, "": 0.5}
    SHORT = {0: 0.001, 1: 0.02, 2: 0.3}
    # Share of stretches that lost their marks; log odds below which trigrams aren't asked, and a gap isn't listed.
    LOST, ASK, LIST = 2e-5, -9.0, -4.6

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "pairs": {}, "fours": {}, "table": None}

    def count(self, *key: str) -> float:
        """Number of a key in a table, 0 if it wasn't seen; another key in both of its slots can only raise it."""
        t = self.table
        if t is None:
            # the slots in use travel as a list; the table they fill has a fixed size
            filled = np.zeros(2 << BITS, np.float32)
            filled[self.slots] = self.numbers
            t = self.table = memoryview(filled)
        a, b = _slots(_digest(*key))
        return min(t[a], t[b])

    def odds(self, w: str, m: str, x: str, cls: str, y: str) -> float:
        """Log odds of a boundary in this context against none."""
        z = self.known.get((w, m, x, cls, y))
        if z is None:
            # contexts recur, so what was worked out is kept
            if len(self.known) >= 100_000:
                self.known.clear()
            z = self.known[w, m, x, cls, y] = self._odds(w, m, x, cls, y)
        return z

    def _odds(self, w: str, m: str, x: str, cls: str, y: str) -> float:
        n = self.count
        uni = self._alone(x)
        hard = m not in self.PRIOR and m[-1:] not in _CLOSERS  # marks that hardly do anything else
        k, prior = (60, 0.998) if hard else (3, self.PRIOR.get(m, 0.9))
        em, gm, start = n("end_m", m), n("gm", m), n("start", x)
        pm = (em + k * prior) / (em + gm + k)
        e, g = n("end", w, m), n("g", w, m)
        pe = (e + 2 * pm) / (e + g + 2)
        ps = (start + self.starts * uni) / (n("s") + self.starts)
        # absolute discounting: a context seen once must not confirm itself
        pgm = (max(0.0, n("go_m", m, x) - 1) + 20 * uni) / (gm + 20)
        pg = (max(0.0, n("go", w, m, x) - 1) + 5 * pgm) / (g + 5)
        z = math.log(pe / (1 - pe)) + math.log(ps / pg)
        if cls and cls != "o":
            ce = (n("cls_end", cls) + 1) / (n("s") + 6)
            cg = (n("cls_go", cls) + 1) / (n("cg") + 6)
            z += 0.5 * math.log(ce / cg)
        py = (n("ycount", y) + 1) / (n("y") + 100)
        z += math.log((n("start_y", x, y) + 5 * py) / (start + 5) / py)
        return max(-30.0, min(30.0, z))

    def _alone(self, x: str) -> float:
        """Probability of a word whatever stands before it."""
        return (self.count("1", x) + 0.5) / (self.words + 0.5 * self.kinds + 1)

    def _pair(self, w: str, x: str) -> float:
        """Log odds by bigrams that a sentence ends after w and the next begins with x, marks aside; an occurrence doesn't confirm itself."""
        n = self.count
        uni, all_w, end_w, stretches = self._alone(x), n("1", w), n("last", w), n("stretches")
        pe = (end_w + 5 * (stretches + 1) / (self.words + 20)) / (all_w + 5)
        ps = (n("first", x) + 50 * uni) / (stretches + 50)
        pg = (max(0.0, n("2", w, x) - 1) + 5 * uni) / (max(0.0, all_w - end_w - 1) + 5)
        return math.log(pe / (1 - pe)) + math.log(ps / pg)

    def _trigrams(self, h: str, w: str, x: str, y: str) -> float:
        """What the words h before w and y after x change in the log odds."""
        n = self.count
        z, all_w, wx = 0.0, n("1", w), max(0.0, n("2", w, x) - 1)
        if h:
            hw, end_w = n("2", h, w), n("last", w)
            pe = (end_w + 5 * (n("stretches") + 1) / (self.words + 20)) / (all_w + 5)
            pg = (wx + 5 * self._alone(x)) / (max(0.0, all_w - end_w - 1) + 5)
            pe2 = (n("last2", h, w) + 5 * pe) / (hw + 5)
            pg2 = (max(0.0, n("3", h, w, x) - 1) + 5 * pg) / (max(0.0, hw - n("last2", h, w) - 1) + 5)
            z += math.log(pe2 / (1 - pe2)) - math.log(pe / (1 - pe)) + math.log(pg / pg2)
        if y:
            py = (max(0.0, n("2", x, y) - 1) + 5 * self._alone(y)) / (n("1", x) + 5)
            z += math.log((n("first2", x, y) + 5 * py) / (n("first", x) + 5)) - math.log((max(0.0, n("3", w, x, y) - 1) + 5 * py) / (wx + 5))
        return z

    def _case(self, x: str, cls: str) -> float:
        """Log odds by the first letter of the next word: how often it is a capital at the start of a stretch and within one."""
        n = self.count
        first, within = (n("upper_first") + 1) / (n("letter_first") + 2), (n("upper_within") + 1) / (n("letter_within") + 2)
        here = (max(0.0, n("upper", x) - (cls == "U")) + 2 * within) / (max(0.0, n("letter", x) - 1) + 2)
        return math.log(first / here) if cls == "U" else math.log((1 - first) / (1 - min(here, 0.999)))

    def _lost(self, tokens: int, mark: str) -> float:
        """Log of the share of boundaries in a stretch that are without a mark, by its length and by whether a mark closes it."""
        if self.tail is None:
            self.tail = [0.0]
            for k in range(119, -1, -1):
                self.tail.append(self.tail[-1] + self.count("length", str(k)))
            self.tail.reverse()
        total = self.tail[0]
        as_long = (self.tail[min(_length_bin(tokens), 120)] + 0.5) / (total + 1)
        bare = (self.count("bare") + 1) / (total + 2)
        whole = (1 - self.LOST) * as_long * (1.0 if mark else bare)
        return math.log(self.LOST / (self.LOST + whole))

    def lost_places(self, part: Stretch) -> list[tuple[int, float, int]]:
        """(end, log odds, tokens before it) of the unmarked gaps of a stretch that could be boundaries."""
        names, classes = part.names, part.classes
        if len(names) < 2:
            return []
        known, found = self.pairs, []
        if len(known) >= 400_000:
            known.clear()
        lost, cased = None, None
        for i, wx in enumerate(zip(names, names[1:])):
            z = known.get(wx)
            if z is None:
                z = known[wx] = self._pair(*wx)
            if z < self.ASK or classes[i] == "o" or classes[i + 1] == "o":
                continue
            if lost is None:
                lost = self._lost(len(names), part.mark)
                # text in small letters only has no case to go by
                cased = "U" in classes
            if z + lost < self.ASK:
                continue
            w, x = wx
            four = (names[i - 1] if i else "", w, x, names[i + 2] if i + 2 < len(names) else "")
            more = self.fours.get(four)
            if more is None:
                if len(self.fours) >= 100_000:
                    self.fours.clear()
                more = self.fours[four] = self._trigrams(*four)
            z += lost + more
            if cased and classes[i + 1] in "Ul":
                z += self._case(x, classes[i + 1])
            if z >= self.LIST:
                found.append((part.ends[i], max(-30.0, min(30.0, z)), i + 1))
        return found

    def posteriors(self, found: list[Gap], given: dict[int, float] | None = None) -> list[float]:
        """Forward-backward over the gaps of a text: boundary or none at each, short sentences being unlikely.

        ``given`` has the log odds of unmarked gaps by their place.
        """
        z = [30.0 if g.kind == _FORCED else given[g.end] if g.kind == _LOST else self.odds(g.w, g.m, g.x, g.cls, g.y) for g in found]
        n = len(z)
        p1 = [1 / (1 + math.exp(-v)) for v in z]
        joint = [self.SHORT.get(g.tokens, 1.0) if g.kind == _LOST or g.m[:1] in (".", "．") or not g.tokens else 1.0 for g in found]  # factor if this gap and the one before are both boundaries
        fwd = []
        a0, a1 = 0.0, 1.0  # the start of the text is a boundary
        for k in range(n):
            b0, b1 = (a0 + a1) * (1 - p1[k]), (a0 + a1 * joint[k]) * p1[k]
            s = b0 + b1 or 1.0
            a0, a1 = b0 / s, b1 / s
            fwd.append((a0, a1))
        out = [0.0] * n
        c0 = c1 = 1.0
        for k in range(n - 1, -1, -1):
            f0, f1 = fwd[k]
            q0, q1 = f0 * c0, f1 * c1
            out[k] = q1 / ((q0 + q1) or 1.0)
            n0, n1 = (1 - p1[k]) * c0, p1[k] * c1
            d0, d1 = n0 + n1, n0 + n1 * joint[k]
            s = d0 + d1 or 1.0
            c0, c1 = d0 / s, d1 / s
        return out

    def ends(self, raw: str | None) -> list[int]:
        """End positions of the sentences of a text."""
        found, parts = scan(raw)
        given: dict[int, float] = {}
        for part in parts:
            before = 0
            for end, z, tokens in self.lost_places(part):
                given[end] = z
                found.append(Gap(end, _LOST, "", "", "", "", "", tokens - before))
                before = tokens
            if before:
                # the next marked gap has so many tokens less before it
                k = min((k for k, g in enumerate(found) if g.kind != _LOST and g.end >= part.ends[-1]), key=lambda k: found[k].end, default=-1)
                if k >= 0:
                    found[k] = found[k]._replace(tokens=max(0, found[k].tokens - before))
        if given:
            found.sort(key=lambda g: g.end)
        return [g.end for g, p in zip(found, self.posteriors(found, given)) if p >= 0.5 or g.kind == _FORCED]


def _slots(digest: int) -> tuple[int, int]:
    """The slot of a digest in either row of the count table."""
    mask = (1 << BITS) - 1
    return digest & mask, (digest >> 32) & mask | 1 << BITS


def _shares(contexts: Iterable[tuple], model: BoundaryModel | None) -> Iterator[tuple[float, tuple]]:
    """What each (kind, w, m, x, cls, y, n) adds to which key, by the model of the round before."""
    for kind, w, m, x, c, y, n in contexts:
        p = 1.0 if kind != _OPEN else (1 / (1 + math.exp(-model.odds(w, m, x, c, y))) if model else None)
        if p is None:
            continue
        # the certain ends alone would say that every mark ends a sentence, so the first estimate has the prior only
        if kind != _START and m and model:
            yield n * p, ("end", w, m)
            yield n * p, ("end_m", m)
            if p < 1:
                for key in (("go", w, m, x), ("go_m", m, x), ("g", w, m), ("gm", m), ("cls_go", c), ("cg",)):
                    yield n * (1 - p), key
        if x:
            for key in (("start", x), ("start_y", x, y), ("cls_end", c), ("s",)):
                yield n * p, key
            yield n, ("ycount", y)
            yield n, ("y",)


def _grams(parts: list[Stretch], seen: Counter) -> None:
    """Adds the n-grams, first and last words, cases and lengths of stretches."""
    for names, _, classes, mark in parts:
        seen.update(zip(itertools.repeat("1"), names))
        seen.update(zip(itertools.repeat("2"), names, names[1:]))
        seen.update(zip(itertools.repeat("3"), names, names[1:], names[2:]))
        seen["first", names[0]] += 1
        seen["last", names[-1]] += 1
        if len(names) > 1:
            seen["first2", names[0], names[1]] += 1
            seen["last2", names[-2], names[-1]] += 1
        seen["stretches",] += 1
        seen["length", str(_length_bin(len(names)))] += 1
        if not mark:
            seen["bare",] += 1
        for k, (x, cls) in enumerate(zip(names, classes)):
            if cls == "l" or cls == "U":
                seen["letter", x] += bool(k)
                seen["letter_within" if k else "letter_first",] += 1
                if cls == "U":
                    seen["upper", x] += bool(k)
                    seen["upper_within" if k else "upper_first",] += 1


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts and n-grams of one partition, counted before anything is shuffled."""
    seen: Counter = Counter()
    grams: Counter = Counter()

    def flush() -> pd.DataFrame:
        rows = [(*k, 0, n) for k, n in seen.items()] + [("u" if k[0] == "1" else "n", "", "", "", "", "", _digest(*k), n) for k, n in grams.items() if n]
        seen.clear()
        grams.clear()
        return pd.DataFrame(rows, columns=["kind", "w", "m", "x", "cls", "y", "digest", "n"])

    for pdf in batches:
        for text in pdf["text"]:
            if not text:
                continue
            seen[(_START, "", "", *first_words(text))] += 1
            found, parts = scan(text)
            for g in found:
                seen[(g.kind, g.w, g.m, g.x, g.cls, g.y)] += 1
            _grams(parts, grams)
            if len(grams) + len(seen) > 200_000:
                yield flush()
    yield flush()


def train(texts: DataFrame, column: str, rounds: int = 3) -> BoundaryModel:
    """Model of all values of ``column``: expectation maximisation, its sums taken over all contexts in each round."""
    sc = texts.sparkSession.sparkContext
    keys = ["kind", "w", "m", "x", "cls", "y", "digest"]
    counts = (
        texts.select(F.col(column).alias("text"))
        .where("text is not null")
        .mapInPandas(_count, "kind string, w string, m string, x string, cls string, y string, digest long, n long")
        .repartition(max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism), *keys)
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"))
        .persist()
    )
    schema = "digest long, n double"
    mask = (1 << BITS) - 1
    rows = F.explode(F.array(F.col("digest").bitwiseAND(mask), F.shiftright("digest", 32).bitwiseAND(mask).bitwiseOR(1 << BITS)))

    def slotted(sums: DataFrame) -> pd.DataFrame:
        """Counts by slot, so never more rows than the table has slots."""
        return sums.select(rows.alias("slot"), "n").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()

    grams = slotted(counts.where("kind in ('u', 'n')").select("digest", F.col("n").cast("double").alias("n")))
    contexts = counts.where("kind not in ('u', 'n')").drop("digest")
    words, kinds = counts.where("kind = 'u'").agg(F.coalesce(F.sum("n"), F.lit(1)), F.count(F.lit(1))).first()
    starts = contexts.select("x").distinct().limit(50).count()
    model = None
    for _ in range(rounds + 1):
        shared = sc.broadcast(model)

        def add(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sums: defaultdict = defaultdict(float)

            def flush() -> pd.DataFrame:
                got = [(_digest(*k), n) for k, n in sums.items()]
                sums.clear()
                return pd.DataFrame(got, columns=["digest", "n"])

            for pdf in batches:
                for n, k in _shares(pdf.itertuples(index=False, name=None), shared.value):
                    sums[k] += n
                if len(sums) > 200_000:
                    yield flush()
            yield flush()

        got = pd.concat([grams, slotted(contexts.mapInPandas(add, schema))]).groupby("slot", sort=True)["n"].sum()
        model = BoundaryModel(got.index.to_numpy(np.int64), got.to_numpy(np.float32), float(words or 1), int(kinds), float(starts + 1))
        shared.unpersist()
    counts.unpersist()
    return model


def sentence_ends(texts: DataFrame, keys: list[str], column: str, model: BoundaryModel) -> DataFrame:
    """(keys..., sent_no, start_pos, end_pos, sentence): one row per sentence of ``column``."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(texts.dtypes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in zip(*[pdf[k] for k in keys], pdf["_text"]):
                start = 0
                for no, end in enumerate(shared.value.ends(rec[-1]), 1):
                    piece = rec[-1][start:end]
                    a = start + len(piece) - len(piece.lstrip())
                    rows.append((*rec[:-1], no, a, end, rec[-1][a:end]))
                    start = end
            yield pd.DataFrame(rows, columns=[*keys, "sent_no", "start_pos", "end_pos", "sentence"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sent_no long, start_pos long, end_pos long, sentence string"
    return texts.select(*keys, F.col(column).alias("_text")).where("_text is not null and _text <> ''").mapInPandas(cut, schema)
