"""Sentence alignment in bilingual records (problem 4).

Length-based dynamic programming in the manner of Gale and Church: the length
of a translation is normal around a multiple of the original's, and the
likeliest path over one-to-one, omission, merge and split beads is found. Three
stages over all records:

1. by lengths alone; its one-to-one beads give a corpus lexicon, which ideograph
   bigrams and words occur together against chance;
2. by lengths again, to whose cost is added minus the log of what the sentences
   of a bead share by the lexicon and by numbers and codes. Links of its beads
   that share too little are dropped: lengths can't see that a sentence was
   omitted here and another one added;
3. sentences that are still without a partner were moved or belong to another
   bead's listing: they are linked by what they share alone, best first.

Every one-to-one bead is counted, however long, except those whose numbers
contradict each other. The lexicon is two tables of fixed size, hashed by pairs
of units, so what is sent to the workers is bounded whatever the vocabulary;
each pair seen ``least`` times that passes the association test and comes near
the best partner of either unit is in it.

The search is exact: it looks at a band around the diagonal and widens it until
no path outside can be likelier.

Defined results: a record with one side null, '' or blank has no pair.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.canon import AS_LATIN, fold
from clausewright.llm.sentences import BoundaryModel
from clausewright.plans.lineage import cut

# Bead shapes (sentences taken on either side) and their prior cost.
BEADS = {(1, 1): 0.1, (1, 0): 4.0, (0, 1): 4.0, (2, 1): 2.6, (1, 2): 2.6, (2, 2): 4.5, (3, 1): 4.5, (1, 3): 4.5}
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]+")
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:'[a-z]+)?")
_ANCHOR = re.compile(r"[A-ZÀ-Þ][A-Za-zÀ-ɏ]*-\d+|\d+(?:[.:]\d+)*")
_SPACE = re.compile(r"\s+")
_LOOKS = str.maketrans(AS_LATIN)
NEAR = 0.3  # least association of a partner in proportion to the best one
BAND = 8  # half width in sentences of the band that is tried first
PAIR_BITS, UNIT_BITS = 23, 21  # slots of a row of the tables of pairs and of units, as powers of two
_MIX = tuple(np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Side:
    """The sentences of one side of a record: sizes, hashes of their lexical units (0 fills empty ones), numbers and codes with their counts."""

    sizes: list[int]
    units: list[list[int]]
    anchors: list[dict[str, int]]

    def __len__(self) -> int:
        return len(self.sizes)


_HASHES: dict[str, int] = {}


def unit_hash(unit: str) -> int:
    """63 bits that stand for a unit; never 0."""
    h = _HASHES.get(unit)
    if h is None:
        if len(_HASHES) >= 200_000:
            _HASHES.clear()
        h = _HASHES[unit] = int.from_bytes(hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 or 1
    return h


def _anchors(text: str) -> tuple[dict[str, int], str]:
    found: Counter = Counter()
    for a in _ANCHOR.findall(text):
        a = a.upper()
        if a[0].isdigit() and (a.count(".") == 2 or a.count(":") == 2):
            found.update(p.lstrip("0") or "0" for p in re.split("[.:]", a))  # a date: day and year change places
        else:
            found[a] += 1
    return dict(found), _ANCHOR.sub(" ", text) if found else text


def side(text: str | None, ends: list[int], chinese: bool) -> Side:
    """Sizes, units and anchors of the sentences that end at ``ends``; of Chinese the bigrams of ideographs and foreign words, else the words."""
    out, start = Side([], [], []), 0
    for end in ends:
        s = fold(text[start:end]) or ""
        start = end
        if chinese:
            s = s.translate(_LOOKS)
        anchors, rest = _anchors(s)
        units = [run[i : i + 2] for run in _HAN.findall(rest) for i in range(max(1, len(run) - 1))] if chinese else []
        units += _WORD.findall(rest.lower())
        out.sizes.append(len(_SPACE.sub("", s)))
        out.units.append([unit_hash(u) for u in dict.fromkeys(units)])
        out.anchors.append(anchors)
    return out


def _pair_slots(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of pairs of unit hashes in the two rows of a table."""
    key = a.astype(np.uint64) * _MIX[0] + b.astype(np.uint64) * _MIX[1]
    key ^= key >> np.uint64(29)
    key *= _MIX[2]
    shift = np.uint64(64 - bits)
    return (key >> shift).astype(np.int64), ((key * _MIX[0]) >> shift).astype(np.int64) + (1 << bits)


@dataclass
class Lexicon:
    """Association of units of the two sides and weights of units, in hashed tables of fixed size, and the length ratio.

    A value is read as the smaller one (for weights, the larger one) of its two
    slots, so that only another key in both of them can change it.
    """

    of_zh: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.empty(0, np.int64), np.empty(0, np.uint8)))
    of_en: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.empty(0, np.int64), np.empty(0, np.uint8)))
    weight: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.empty(0, np.int64), np.empty(0, np.float32)))
    ratio: float = 3.0
    spread: float = 6.0
    tables: tuple | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tables": None}

    def _filled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.tables is None:
            zh, en = np.zeros(2 << PAIR_BITS, np.uint8), np.zeros(2 << PAIR_BITS, np.uint8)
            zh[self.of_zh[0]], en[self.of_en[0]] = self.of_zh[1], self.of_en[1]
            weight = np.zeros(2 << UNIT_BITS, np.float32)
            weight[self.weight[0]] = self.weight[1]
            self.tables = zh, en, weight
        return self.tables

    def weights(self, units: np.ndarray) -> np.ndarray:
        """How much each unit says; 2 for unknown ones, none for fillers."""
        table = self._filled()[2]
        a, b = _pair_slots(units, np.zeros(1, np.uint64), UNIT_BITS)
        w = np.maximum(table[a], table[b])
        w[w == 0] = 2.0
        w[units == 0] = 0.0
        return w

    def credits(self, zh: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the presence of each English unit renders each Chinese one, and the other way round."""
        tz, te, _ = self._filled()
        a, b = _pair_slots(zh[:, None], en[None, :], PAIR_BITS)
        same = zh[:, None] == en[None, :]
        return tuple(np.where(same, np.float32(1), np.minimum(t[a], t[b]) * np.float32(1 / 255)) for t in (tz, te))

    def length_costs(self, zh: np.ndarray, en: np.ndarray) -> np.ndarray:
        """Minus log of the two-sided probability of so unequal lengths, for each of zh against each of en."""
        z, e = zh[:, None].astype(np.float32), en[None, :].astype(np.float32)
        mean = np.maximum((z + e / self.ratio) / 2, 1.0)
        return np.interp(np.abs(e - z * self.ratio) / np.sqrt(mean * self.spread * self.ratio), _DELTA, _UNLIKELY).astype(np.float32)


_DELTA = np.linspace(0, 7.2, 1441)
_UNLIKELY = np.array([-math.log(max(math.erfc(d / math.sqrt(2)), 1e-12)) for d in _DELTA])


def coverage(zh: Side, en: Side, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """For each Chinese and English sentence the weighted share of the one's units and anchors that the other's render, both ways."""
    nz, ne = len(zh), len(en)

    def flat(s: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = [max(1, len(u)) for u in s.units]
        units = np.array([h for u in s.units for h in (u or [0])], np.int64)
        kinds, place = np.unique(units, return_inverse=True)
        return kinds, place, np.concatenate(([0], np.cumsum(sizes)[:-1]))

    (uz, pz, oz), (ue, pe, oe) = flat(zh), flat(en)
    wz, we = lex.weights(uz), lex.weights(ue)
    cz, ce = np.zeros((nz, ne), np.float32), np.zeros((nz, ne), np.float32)
    # in blocks of English sentences, so that a very long record needs no matrix of all its units
    bounds = [*oe.tolist(), len(pe)]
    a = 0
    while a < ne:
        b = a + 1
        while b < ne and (bounds[b + 1] - bounds[a]) * max(len(uz), len(pz)) <= 2_000_000:
            b += 1
        here = pe[bounds[a] : bounds[b]]
        kinds, place = (ue, here) if b - a == ne else (lambda k: (ue[k[0]], k[1]))(np.unique(here, return_inverse=True))
        w = we if b - a == ne else lex.weights(kinds)
        starts = oe[a:b] - bounds[a]
        az, ae = lex.credits(uz, kinds)
        best = np.maximum.reduceat(az[:, place], starts, axis=1) * wz[:, None]
        cz[:, a:b] = np.add.reduceat(best[pz], oz, axis=0)
        best = np.maximum.reduceat(ae[pz], oz, axis=0) * w[None, :]
        ce[:, a:b] = np.add.reduceat(best[:, place], starts, axis=1)
        a = b
    tz, te = np.add.reduceat(wz[pz], oz), np.add.reduceat(we[pe], oe)
    where: dict[str, list[tuple[int, int]]] = {}
    for y, found in enumerate(en.anchors):
        for t, n in found.items():
            where.setdefault(t, []).append((y, n))
            te[y] += n * _anchor_weight(t)
    for x, found in enumerate(zh.anchors):
        for t, n in found.items():
            w = _anchor_weight(t)
            tz[x] += n * w
            for y, k in where.get(t, ()):
                cz[x, y] += w * min(n, k)
                ce[x, y] += w * min(n, k)
    return cz / np.maximum(tz, 1e-9)[:, None], ce / np.maximum(te, 1e-9)[None, :]


def _anchor_weight(anchor: str) -> float:
    return 6.0 if not anchor.isdigit() or len(anchor) > 1 else 3.0


def beads(nz: int, ne: int, costs: dict[tuple[int, int], list[list[float]]]) -> list[tuple[int, int, int, int]]:
    """Cheapest path: (i, j, di, dj) of each bead; ``costs`` has the cost, never negative, of each shape at each place; omissions cost their prior only, shapes without costs don't occur.

    Only a band around the diagonal is searched. It is widened until no path
    that leaves it can be cheaper: one that does strays at least ``band``
    sentences and comes back, and pays for each.
    """
    stray = min(prior / abs(di - dj) for (di, dj), prior in BEADS.items() if di != dj)
    band = BAND
    while True:
        best, came, whole = _in_band(nz, ne, costs, band + abs(nz - ne))
        if whole or best <= stray * (2 * band + abs(nz - ne)):
            break
        band *= 2
    out, i, j = [], nz, ne
    while i or j:
        di, dj = came[i][j]
        out.append((i - di, j - dj, di, dj))
        i, j = i - di, j - dj
    return out[::-1]


def _in_band(nz: int, ne: int, costs: dict, wide: int) -> tuple[float, list[dict[int, tuple[int, int]]], bool]:
    """Cost of the cheapest path within the band, the last bead at each place, and whether the band holds all places."""
    inf = math.inf
    shapes = [(di, dj, prior, costs.get((di, dj))) for (di, dj), prior in BEADS.items() if not di or not dj or (di, dj) in costs]
    rows: list[dict[int, float]] = [{} for _ in range(nz + 1)]
    came: list[dict[int, tuple[int, int]]] = [{} for _ in range(nz + 1)]
    rows[0][0] = 0.0
    for i in range(nz + 1):
        mid = i * ne // max(nz, 1)
        row, back = rows[i], came[i]
        for j in range(max(0, mid - wide - 1), min(ne, mid + wide + 1) + 1):
            least, how = row.get(j, inf), None
            for di, dj, prior, cost in shapes:
                if di <= i and dj <= j:
                    c = rows[i - di].get(j - dj)
                    if c is not None:
                        c += prior
                        if c < least and cost is not None:
                            c += cost[i - di][j - dj]
                        if c < least:
                            least, how = c, (di, dj)
            if least < inf:
                row[j] = least
                if how:
                    back[j] = how
    return rows[nz].get(ne, inf), came, wide >= ne


def _costs(zh: Side, en: Side, lex: Lexicon, shares: tuple[np.ndarray, np.ndarray] | None = None) -> dict[tuple[int, int], list[list[float]]]:
    """Cost of each shape of bead at each place, by lengths and, if given, by what the sentences share."""
    zs, es = np.concatenate(([0], np.cumsum(zh.sizes))), np.concatenate(([0], np.cumsum(en.sizes)))
    nz, ne = len(zh), len(en)
    out = {}
    for di, dj in BEADS:
        if not di or not dj or di > nz or dj > ne:
            continue
        c = lex.length_costs(zs[di:] - zs[:-di], es[dj:] - es[:-dj])
        if shares is not None:
            cz, ce = shares
            # what each sentence has rendered by the bead's other side
            z = [np.minimum(sum(cz[x : nz - di + 1 + x, y : ne - dj + 1 + y] for y in range(dj)), 1) for x in range(di)]
            e = [np.minimum(sum(ce[x : nz - di + 1 + x, y : ne - dj + 1 + y] for x in range(di)), 1) for y in range(dj)]
            s = (sum(z) / di + sum(e) / dj) / 2
            for v in (*z, *e):
                s = np.minimum(s, v + 0.15)
            c = c - np.log(np.maximum(s, 0.03))
        out[di, dj] = c.tolist()
    return out


def by_length(zh: Side, en: Side, lex: Lexicon) -> list[tuple[int, int, int, int]]:
    """Beads from lengths alone."""
    return beads(len(zh), len(en), _costs(zh, en, lex))


SURE, FAIR, LEFT = 0.62, 0.5, 0.66  # least score of a bead's link, of a one-to-one bead, of a moved sentence


def pairs(zh: Side, en: Side, lex: Lexicon) -> list[tuple[int, int, float]]:
    """(zh, en, score) of sentences that render each other wholly or in part; numbered from 0."""
    if not len(zh) or not len(en):
        return []
    cz, ce = coverage(zh, en, lex)
    # how far each side covers as much of the other as their lengths allow
    r = np.array(zh.sizes)[:, None] * lex.ratio / np.maximum(np.array(en.sizes), 1)[None, :]
    sz, se = np.minimum(1, cz / np.minimum(1, 1 / np.maximum(r, 1e-6))), np.minimum(1, ce / np.maximum(np.minimum(1, r), 0.02))
    least = np.minimum(sz, se)
    link = np.where(least >= 0.3, (sz + se) / 2, 0.5 * least)
    score: dict[tuple[int, int], float] = {}
    for i, j, di, dj in beads(len(zh), len(en), _costs(zh, en, lex, (cz, ce))):
        for x in range(i, i + di):
            for y in range(j, j + dj):
                s = float(link[x, y])
                if s >= (FAIR if di == dj == 1 else SURE):
                    score[x, y] = s
    # moved sentences and parts of merged ones: the best links left, whatever their order
    used_z, used_e = {x for x, _ in score}, {y for _, y in score}
    left_z, left_e = [x for x in range(len(zh)) if x not in used_z], [y for y in range(len(en)) if y not in used_e]
    left = {(x, int(y)) for x in left_z for y in np.flatnonzero(link[x] >= LEFT)} | {(int(x), y) for y in left_e for x in np.flatnonzero(link[:, y] >= LEFT)}
    for s, x, y in sorted(((float(link[x, y]), x, y) for x, y in left), key=lambda f: (-f[0], f[1], f[2])):
        if x not in used_z and y not in used_e:
            score[x, y] = s
        elif x not in used_z and s >= LEFT + 0.1 and en.sizes[y] > 1.3 * zh.sizes[x] * lex.ratio:
            score[x, y] = s  # a part of a merged or listing sentence
        elif y not in used_e and s >= LEFT + 0.1 and zh.sizes[x] * lex.ratio > 1.3 * en.sizes[y]:
            score[x, y] = s
        else:
            continue
        used_z.add(x)
        used_e.add(y)
    return sorted((x, y, s) for (x, y), s in score.items())


def prepared(records: DataFrame, key: str, zh: str, en: str, model: BoundaryModel) -> DataFrame:
    """(key, z, e): both sides of each record as sentences with sizes, units and anchors; written once to the shared folder."""
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = [[pickle.dumps(s.__dict__, 5) for s in (side(z, m.ends(z), True), side(e, m.ends(e), False))] for z, e in zip(pdf["z"], pdf["e"])]
            yield pd.DataFrame({"k": pdf["k"], "z": [o[0] for o in out], "e": [o[1] for o in out]})

    rows = records.select(F.col(key).alias("k"), F.col(zh).alias("z"), F.col(en).alias("e")).where("trim(z) <> '' and trim(e) <> ''")
    return cut(rows.mapInPandas(run, f"k {dict(records.dtypes)[key]}, z binary, e binary")).withColumnRenamed("k", key)


def _sides(pdf: pd.DataFrame) -> Iterator[tuple[Side, Side]]:
    for z, e in zip(pdf["z"], pdf["e"]):
        yield Side(**pickle.loads(z)), Side(**pickle.loads(e))


# Names of the counts that belong to no unit.
_ALL, _ZH_SIZE, _EN_SIZE = 0, -1, -2


def train(sides: DataFrame, least: int = 3) -> Lexicon:
    """Lexicon and length statistics from the one-to-one beads that lengths alone give, over all :func:`prepared` records."""
    base = Lexicon()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            rows = [(*k, n) for k, n in seen.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["a", "b", "n"])

        for pdf in batches:
            for zh, en in _sides(pdf):
                if not len(zh) or not len(en):
                    continue
                for i, j, di, dj in by_length(zh, en, base):
                    if di == dj == 1:
                        # numbers and codes that contradict each other show a wrong bead
                        if (zh.anchors[i] or en.anchors[j]) and not zh.anchors[i].keys() & en.anchors[j].keys():
                            continue
                        seen[_ALL, _ALL] += 1
                        seen[_ZH_SIZE, _ALL] += zh.sizes[i]
                        seen[_EN_SIZE, _ALL] += en.sizes[j]
                        seen.update((u, _ALL) for u in zh.units[i])
                        seen.update((_ALL, w) for w in en.units[j])
                        for u in zh.units[i]:
                            seen.update(product((u,), en.units[j]))
                            if len(seen) > 300_000:  # here, as long sentences have many pairs
                                yield flush()
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    kept = sides.mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).persist()
    sizes = {r.a: r.n for r in kept.where("b = 0 and a <= 0").collect()}
    total = sizes.get(_ALL, 0)
    za, eb = kept.where("b = 0 and a > 0").select("a", F.col("n").alias("na")), kept.where("a = 0 and b > 0").select("b", F.col("n").alias("nb"))
    strong = kept.where("a > 0 and b > 0").join(za, "a").join(eb, "b").withColumn("dice", 2 * F.col("n") / (F.col("na") + F.col("nb"))).withColumn("most", F.col("n") / F.least("na", "nb"))
    strong = strong.where(F.col("n") * float(max(total, 1)) > 3.0 * F.col("na") * F.col("nb")).where("dice >= 0.08 or most >= 0.5")
    strong = strong.select("a", "b", "dice").persist()
    tops = [strong.groupBy(k).agg(F.max("dice").alias(f"top_{k}")) for k in "ab"]
    # a partner far below the best one is of no use, and a unit whose best partner is a weak one gives little credit at all
    near = strong.join(tops[0], "a").join(tops[1], "b")

    def slotted(rows: DataFrame, bits: int, how: str) -> tuple[np.ndarray, np.ndarray]:
        """Values by slot, so never more rows than the table has slots."""

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for slots in _pair_slots(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64), bits):
                    yield pd.DataFrame({"slot": slots, "v": pdf["v"]})

        got = rows.mapInPandas(place, "slot long, v double").groupBy("slot").agg(F.expr(f"{how}(v)").alias("v")).toPandas()
        return got["slot"].to_numpy(np.int64), got["v"].to_numpy(float)

    lex = Lexicon()
    for name, top in (("of_en", "top_b"), ("of_zh", "top_a")):
        credit = F.col("dice") / F.col(top) * F.least(F.lit(1.0), 2 * F.col(top))
        slots, v = slotted(near.where(F.col("dice") >= NEAR * F.col(top)).select("a", "b", credit.alias("v")), PAIR_BITS, "max")
        setattr(lex, name, (slots, np.maximum(1, np.round(v * 255)).astype(np.uint8)))
    weight = F.greatest(F.lit(0.3), F.log((F.lit(float(total)) + 1) / F.col("n")))
    units = za.select(F.col("a"), F.col("na").alias("n")).unionByName(eb.select(F.col("b").alias("a"), F.col("nb").alias("n"))).groupBy("a").agg(F.max("n").alias("n"))
    slots, v = slotted(units.select("a", F.lit(0).cast("long").alias("b"), weight.alias("v")), UNIT_BITS, "min")
    lex.weight = (slots, v.astype(np.float32))
    if total:
        lex.ratio = sizes.get(_EN_SIZE, 1) / max(1, sizes.get(_ZH_SIZE, 1))
    strong.unpersist()
    kept.unpersist()
    return lex


def aligned(sides: DataFrame, key: str, lexicon: Lexicon) -> DataFrame:
    """(key, zh_sent, en_sent, score): sentences of :func:`prepared` records, numbered from 1, that render each other wholly or in part."""
    shared = sides.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, x + 1, y + 1, s) for k, (zh, en) in zip(pdf["k"], _sides(pdf)) for x, y, s in pairs(zh, en, shared.value)]
            yield pd.DataFrame(out, columns=["k", "zh_sent", "en_sent", "score"])

    rows = sides.select(F.col(key).alias("k"), "z", "e")
    return rows.mapInPandas(run, f"k {dict(sides.dtypes)[key]}, zh_sent long, en_sent long, score double").withColumnRenamed("k", key)
