"""Several values packed in one field (problem 6).

Each field becomes a lattice: delimiters outside quotations, brackets, numbers
and fixed expressions are places where it may be cut. Expectation maximisation
learns from the whole column how often each value occurs on its own and how
often each kind of delimiter separates; Viterbi then takes the likeliest cut of
each field. Quoted and bracketed spans are atomic.

Fields without an open delimiter feed the value frequencies directly; only the
candidate segments of the others are joined with the frequency table, so
nothing of the column is collected but one probability per delimiter kind, and
each round starts from tables written in the shared folder.
A segment may be as long as its field. One that no other field holds weighs the
same as an unseen one, so only shared ones are carried through the rounds.

Defined results: null, '' and blank fields have no value; empty values between
delimiters don't count; text with ideographs is one value; quotes around a
value are removed, doubled quotes inside become one; an unclosed quote or
bracket is an ordinary character; repeated values stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.plans.lineage import cut

_CJK = re.compile("[㐀-䶿一-鿿豈-﫿]")
_DELIMITER = re.compile(r"[ \t]*(?:[;；、,，/／|｜\t\n\r]+[ \t]*)+")
_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "{": "}", "“": "”", "«": "»", "《": "》", "「": "」"}
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
# Letters of other scripts or widths that look like a Latin one, and what they look like.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(33, 127))
_DRESSED = "АВЕЅІЈКМНОРСТУХаеіјорсухѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο" + _WIDE
_UNDRESSED = "ABESIJKMHOPCTYXaeijopcyxsABEZHIKMNOPTYXo" + "".join(map(chr, range(33, 127)))


def _atoms(text: str) -> list[bool]:
    """For each character whether it lies in a closed quotation or bracket."""
    inside, i, n = [False] * len(text), 0, len(text)
    while i < n:
        ch, j = text[i], -1
        if ch == '"':
            j = i + 1
            while j < n:  # a doubled quote stands for one
                if text[j] == '"':
                    if j + 1 < n and text[j + 1] == '"' and not (j == i + 1 and (j + 2 >= n or not text[j + 2].isalnum() and text[j + 2] != '"')):
                        j += 2
                        continue
                    break
                j += 1
            j = j if j < n else -1
        elif ch == "'" and (i == 0 or not text[i - 1].isalnum()):
            j = next((k for k in range(i + 1, n) if text[k] == "'" and (k + 1 == n or not text[k + 1].isalnum())), -1)
        elif ch in _PAIRS:
            depth = 0
            for k in range(i, n):
                depth += (text[k] == ch) - (text[k] == _PAIRS[ch])
                if not depth:
                    j = k
                    break
            if j < 0 and ch in "([{":  # opened by one kind of bracket and closed by another
                j = next((k for k in range(i + 1, n) if text[k] in ")]}】"), -1)
        if j > i:
            inside[i : j + 1] = [True] * (j + 1 - i)
            i = j + 1
        else:
            i += 1
    return inside


def _plain(text: str) -> str:
    """The text for scanning, character by character: wide forms and unusual spaces as their plain equivalents."""
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else " " if c.isspace() and c not in "\t\n\r" else c for c in text)


def _numbering(text: str) -> list[tuple[int, int]]:
    """Places of (1) (2) ... or 1) 2) ... or 1. 2. ... if the field is such a list of two or more."""
    m = re.match(r"(\(?)1([).])\s*", text)
    if not m:
        return []
    spans, k = [m.span()], 2
    while found := re.compile(rf"(?:[;,]\s*|\s){re.escape(m.group(1))}{k}{re.escape(m.group(2))}\s*").search(text, spans[-1][1]):
        spans.append(found.span())
        k += 1
    return spans if len(spans) > 1 else []


def lattice(raw: str | None) -> tuple[list[str], list[str]]:
    """Elementary pieces of a field and the kind of delimiter between each two.

    A kind is the mark with its surroundings: 's' with white space beside it,
    't' without; 'n' is a running number. Marks in numbers (1,400 and 25/0.4),
    units and expressions of short parts (km/h, AC/DC, I/O) are no delimiters.
    """
    text = _INVISIBLE.sub("", raw or "").strip()
    if not text:
        return [], []
    if _CJK.search(text):
        return [text], []
    scan = _plain(text)
    numbers = _numbering(scan)
    spans = [(a, b, "n") for a, b in numbers]
    if not numbers:
        inside = _atoms(scan)
        for found in _DELIMITER.finditer(scan):
            a, b = found.span()
            if any(inside[a:b]):
                continue
            mark = found.group().strip(" ") or found.group()
            tight = mark == found.group()
            if tight and mark in ",/" and a and b < len(scan):
                left, right = re.search(r"[^\W_]*$", scan[:a]).group(), re.match(r"[^\W_]*", scan[b:]).group()
                # words may be glued to an expression by lost spaces; then its capitals show where it ends
                left = m.group() if (m := re.search(r"(?<=[^\W\d_A-Z])[A-Z]{1,3}$", left)) else left
                right = m.group() if (m := re.match(r"[A-Z]{1,3}(?=[^\W\d_A-Z])", right)) else right
                if left[-1:].isdigit() and right[:1].isdigit() and (mark == "/" or re.fullmatch(r"\d{1,3}", left) and re.match(r"\d{3}(?!\d)", scan[b:])):
                    continue
                if mark == "/" and left and right and (len(left) <= 3 and len(right) <= 3 or len(left) == 1):
                    continue
            spans.append((a, b, mark[0] + ("t" if tight else "s")))
    pieces, kinds, start = [], [], 0
    for a, b, kind in spans:
        pieces.append(text[start:a])
        kinds.append(kind)
        start = b
    pieces.append(text[start:])
    keep = [i for i, p in enumerate(pieces) if re.search(r"\w", p)]
    return [pieces[i].strip() for i in keep], [kinds[j - 1] for j in keep[1:]]


def clean(value: str) -> str:
    """A value without the quotes around it; doubled quotes become one."""
    v = value.strip()
    if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" or len(v) > 1 and _PAIRS.get(v[0]) == v[-1] and v[0] in "“«「":
        v = v[1:-1].replace('""', '"').strip()
    return v


def key(value: str) -> str:
    """What two dresses of a value share: case, white space and quotes don't count."""
    return re.sub(r"[\s\"'“”]+", " ", _plain(_INVISIBLE.sub("", value))).strip().casefold()


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["k", "a", "b", "value", "pieces", "lesson"]
    for pdf in batches:
        rows = []
        for k, raw, lesson in zip(pdf["k"], pdf["t"], pdf["lesson"]):
            keys = [key(p) for p in lattice(raw)[0]]
            for i in range(len(keys)):
                value = ""
                for j in range(i + 1, len(keys) + 1):
                    value = f"{value} {keys[j - 1]}" if value else keys[j - 1]
                    rows.append((k, i, j, value, len(keys), lesson))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)


def _add(a: float, b: float) -> float:
    """Logarithm of the sum of two numbers given by theirs."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Cuts:
    """Logarithmic weights of the cuts of one field.

    An unseen value is as likely as its pieces one by one, so that without
    evidence only the delimiters decide; a field's own share in a count (at
    most one) is taken off, so that no field confirms itself. Unseen values of
    all lengths are summed piece by piece, seen ones one by one.
    """

    def __init__(self, kinds: list[str], seen: dict[tuple[int, int], float], prior: dict[str, float], total: float):
        self.n, self.unseen, self.total, self.seen = len(kinds) + 1, math.log(0.1 / total), total, seen
        self.on = [math.log(1 - prior.get(k, 0.7)) for k in kinds]
        self.off = [-math.inf, *(math.log(prior.get(k, 0.7)) for k in kinds), 0.0]  # by the place after the value
        self.inner = [0.0]
        for v in self.on:
            self.inner.append(self.inner[-1] + v)
        self.into: list[list[tuple[int, float]]] = [[] for _ in range(self.n + 1)]
        for (i, j), p in sorted(seen.items()):
            if p > 1:
                self.into[j].append((i, math.log((p - 1) / total) + self.inner[j - 1] - self.inner[i] + self.off[j]))

    def weight(self, i: int, j: int) -> float:
        """Weight of one value, seen or not."""
        known = max(self.seen.get((i, j), 0.0) - 1, 0.0) / self.total
        alone = (j - i) * self.unseen
        return (_add(math.log(known), alone) if known else alone) + self.inner[j - 1] - self.inner[i] + self.off[j]

    def shares(self) -> tuple[dict[tuple[int, int], float], list[float]]:
        """Probability of each listed value and of a cut at each place."""
        n, inf = self.n, -math.inf
        fwd, open_ = [0.0] + [inf] * n, inf
        for j in range(1, n + 1):
            open_ = self.unseen + _add(fwd[j - 1], open_ + self.on[j - 2] if j > 1 else inf)
            fwd[j] = open_ + self.off[j]
            for i, v in self.into[j]:
                fwd[j] = _add(fwd[j], fwd[i] + v)
        bwd, open_ = [inf] * n + [0.0], 0.0  # here open_ is for a value that goes on or ends after piece j - 1
        for j in range(n, 0, -1):
            open_ = _add(self.off[j] + bwd[j], self.on[j - 1] + self.unseen + open_ if j < n else inf)
            for i, v in self.into[j]:
                bwd[i] = _add(bwd[i], v + bwd[j])
            bwd[j - 1] = _add(bwd[j - 1], self.unseen + open_)
        z = fwd[n]
        return {(i, j): math.exp(fwd[i] + self.weight(i, j) + bwd[j] - z) for i, j in self.seen}, [math.exp(f + b - z) for f, b in zip(fwd, bwd)]

    def best(self) -> list[tuple[int, int]]:
        """The likeliest values of the field; of equals the shorter ones."""
        n = self.n
        top, came = [0.0] + [-math.inf] * n, [0] * (n + 1)
        open_, since = -math.inf, 0
        listed: list[list[int]] = [[] for _ in range(n + 1)]
        for i, j in sorted(self.seen):
            listed[j].append(i)
        for j in range(1, n + 1):
            go = open_ + self.on[j - 2] if j > 1 else -math.inf
            if top[j - 1] >= go - 1e-9:
                go, since = top[j - 1], j - 1
            open_ = self.unseen + go
            top[j], came[j] = open_ + self.off[j], since
            for i in listed[j]:
                v = top[i] + self.weight(i, j)
                if v > top[j] + 1e-9 or v >= top[j] - 1e-9 and i > came[j]:
                    top[j], came[j] = v, i
        cuts, j = [], n
        while j:
            cuts.append((came[j], j))
            j = came[j]
        return cuts[::-1]


def separated(fields: DataFrame, key_col: str, column: str, rounds: int = 3) -> DataFrame:
    """(key_col, value_pos, value, values): one row per value of each field, ``values`` being how many there are."""
    rows = fields.select(F.col(key_col).alias("k"), F.col(column).alias("t"))
    # a field learns once in whatever dress it is repeated, so that a hot one can't outvote the column
    dress = F.lower(F.regexp_replace(F.translate("t", _DRESSED, _UNDRESSED), r"[^\p{L}\p{N}]+", ""))
    each = rows.where("t is not null").groupBy("t").agg(F.min("k").alias("k")).withColumn("_d", dress)
    taught = each.groupBy("_d").agg(F.min("k").alias("_first"))
    distinct = cut(each.join(taught, "_d").select("t", "k", (F.col("k") == F.col("_first")).alias("lesson")))
    cand = cut(distinct.mapInPandas(_segments, "k long, a int, b int, value string, pieces int, lesson boolean"))
    learn = cand.where("lesson")
    single = cut(learn.where("pieces = 1").groupBy("value").agg(F.count("*").cast("double").alias("n")))
    shared = learn.groupBy("value").agg(F.count("*").alias("fields")).where("fields > 1")
    # each field keeps its first piece, so that it stays though it shares nothing
    several = cand.where("pieces > 1").join(shared, "value", "left").where("fields is not null or a = 0 and b = 1").select("k", "a", "b", "value")
    multi = cut(several.join(distinct, "k").select("k", "t", "lesson", "a", "b", "value"))
    total = float(max(1, distinct.where("lesson").count()))
    prior: dict[str, float] = {}
    counts = single

    def lattices(segments: DataFrame, counts: DataFrame) -> DataFrame:
        """(t, segs): each field with its listed segments and how often they were seen."""
        weighed = segments.join(counts, "value", "left").withColumn("p", F.coalesce("n", F.lit(0.0)))
        return weighed.groupBy("k").agg(F.first("t").alias("t"), F.collect_list(F.struct("a", "b", "value", "p")).alias("segs")).select("t", "segs")

    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], prior=dict(prior)) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for t, segs in zip(pdf["t"], pdf["segs"]):
                    kinds = lattice(t)[1]
                    named = {(s["a"], s["b"]): s["value"] for s in segs}
                    found, cuts = Cuts(kinds, {(s["a"], s["b"]): s["p"] for s in segs}, prior, total).shares()
                    out += [(named[ij], None, p) for ij, p in found.items() if p > 1e-6]
                    out += [(None, k, cuts[j]) for j, k in enumerate(kinds, 1)]
                yield pd.DataFrame(out, columns=["value", "kind", "p"])

        # one shuffle for both sums of a round, and nothing of a round is left in the plan of the next
        soft = cut(lattices(multi.where("lesson"), counts).mapInPandas(expect, "value string, kind string, p double").groupBy("value", "kind").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
        # one row per kind of delimiter
        prior = {r["kind"]: min(0.999, max(0.001, (r["s"] + 1) / (r["n"] + 2))) for r in soft.where("kind is not null").collect()}
        counts = single.unionByName(soft.where("value is not null").select("value", F.col("s").alias("n"))).groupBy("value").agg(F.sum("n").alias("n"))

    def viterbi(batches: Iterator[pd.DataFrame], prior=dict(prior)) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, segs in zip(pdf["t"], pdf["segs"]):
                pieces, kinds = lattice(t)
                cuts = Cuts(kinds, {(s["a"], s["b"]): s["p"] for s in segs}, prior, total).best()
                out += [(t, pos, clean(", ".join(pieces[a:b])), len(cuts)) for pos, (a, b) in enumerate(cuts, 1)]
            yield pd.DataFrame(out, columns=["t", "value_pos", "value", "values"])

    several = lattices(multi, counts).mapInPandas(viterbi, "t string, value_pos long, value string, values int")
    one = distinct.mapInPandas(_single, "t string, value_pos long, value string, values int")
    return rows.join(several.unionByName(one), "t").select(F.col("k").alias(key_col), "value_pos", "value", "values")


def _single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(t, 1, clean(p[0]), 1) for t in pdf["t"] for p in [lattice(t)[0]] if len(p) == 1]
        yield pd.DataFrame(out, columns=["t", "value_pos", "value", "values"])
