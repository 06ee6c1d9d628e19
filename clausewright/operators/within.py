"""Which texts lie in which others, for many texts against a small set, both ways.

Texts meet by their first one to three characters, as one exact number each;
what meets is compared character by character. All in arrays.
"""

from __future__ import annotations

import numpy as np

from clausewright.operators.scan import points

HEAD = 3  # characters of 21 bits in one number


class Texts:
    """Texts as code points: all in a row, with begin, end and length of each."""

    def __init__(self, texts: list[str]):
        self.codes, self.length = points(texts)
        self.end = np.cumsum(self.length)
        self.begin = self.end - self.length
        self.stop = np.repeat(self.end, self.length)
        self.owner = np.repeat(np.arange(len(texts)), self.length)

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the ``n`` characters from each place on."""
        key = self.codes[at]
        for j in range(1, n):
            key = (key << 21) | self.codes[at + j]
        return key

    def heads(self, n: int) -> np.ndarray:
        """Texts that are looked up by ``n`` characters: shorter ones whole."""
        return np.flatnonzero(self.length >= HEAD if n == HEAD else self.length == n)


def _same(a: Texts, which: np.ndarray, b: Texts, at: np.ndarray, known: int) -> np.ndarray:
    """Whether text ``which`` of ``a`` stands at place ``at`` of ``b`` within one text; ``known`` characters do."""
    ok = at + a.length[which] <= b.stop[at]
    live, j = np.flatnonzero(ok), known
    while len(live := live[a.length[which[live]] > j]):
        equal = a.codes[a.begin[which[live]] + j] == b.codes[at[live] + j]
        ok[live[~equal]] = False
        live, j = live[equal], j + 1
    return ok


def _spread(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) for every place of the ranges."""
    size = right - left
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + left[of]


class Small:
    """A small set of texts that others are held against."""

    def __init__(self, texts: list[str]):
        self.texts = Texts(texts)
        self.head, self.inner = {}, {}
        for n in range(1, HEAD + 1):
            own = self.texts.heads(n)
            self.head[n] = self._sorted(self.texts.keys(self.texts.begin[own], n), own)
            at = np.flatnonzero(np.arange(len(self.texts.codes)) + n <= self.texts.stop)
            self.inner[n] = self._sorted(self.texts.keys(at, n), at)
        self.first = np.zeros(0x110000, dtype=bool)
        self.first[self.texts.codes[self.texts.begin[self.texts.length > 0]]] = True

    @staticmethod
    def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return key[order], value[order]

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, number of the small one, equal): pairs of which one holds the other."""
        many, count, found = Texts(texts), max(len(self.texts.length), 1), []
        begins = np.flatnonzero(self.first[many.codes])
        for n in range(1, HEAD + 1):
            # small ones in the texts
            key, value = self.head[n]
            at = begins[begins + n <= many.stop[begins]]
            seek = many.keys(at, n)
            of, place = _spread(np.searchsorted(key, seek, "left"), np.searchsorted(key, seek, "right"))
            at, which = at[of], value[place]
            ok = _same(self.texts, which, many, at, n)
            found.append(many.owner[at[ok]] * count + which[ok])
            # texts in the small ones
            key, value = self.inner[n]
            own = many.heads(n)
            seek = many.keys(many.begin[own], n)
            of, place = _spread(np.searchsorted(key, seek, "left"), np.searchsorted(key, seek, "right"))
            which, at = own[of], value[place]
            ok = _same(many, which, self.texts, at, n)
            found.append(which[ok] * count + self.texts.owner[at[ok]])
        text, small = np.divmod(np.unique(np.concatenate(found)), count)
        return text, small, many.length[text] == self.texts.length[small]
