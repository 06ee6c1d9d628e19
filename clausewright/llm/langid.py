"""Language of each document and of each stretch of a mixed one (problem 9).

Hierarchical discrimination: the family of a sentence is predicted first, by
the probabilities of its letters' scripts in each family, which are fitted on
the sample; within a family one-versus-one linear support
vector machines on hashed character n-grams separate the related languages.
Decisions along a document are smoothed by a Viterbi pass, so that a short
doubtful sentence follows its neighbours while a clear one stands.

The machines are fitted on a bounded sample of labelled rows: at most
``per_language`` documents of each label by order of a hash. Labels are dirty,
so a first fit is used to drop sentences that contradict their label.

Defined results: null and '' texts and texts without a letter have no segment;
sentences without letters belong to the segment they stand in.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.canon import fold
from clausewright.llm.sentences import BoundaryModel

LANGUAGES = ("zh", "en", "ja", "de", "fr", "ru")
_BITS = 15
_QUOTED = re.compile(r"“[^”]*”|「[^」]*」|《[^》]*》|«[^»]*»|\"[^\"]*\"|（[^）]*）|\([^)]*\)")
_CODE = re.compile(r"(?<!\w)[^\W\d]*-?\d[\w.:,/-]*")  # numbers and names with a number in them
# The family of each language.
FAMILIES = {"zh": "han", "ja": "han", "en": "latin", "de": "latin", "fr": "latin", "ru": "cyrillic"}
_SCRIPT: dict[str, str] = {}


def script_of(ch: str) -> str:
    """Script of a letter by its Unicode name; '' for anything else."""
    got = _SCRIPT.get(ch)
    if got is None:
        got = _SCRIPT[ch] = unicodedata.name(ch, "").split(" ")[0].split("-")[0] if ch.isalpha() else ""
    return got


def scripts(sentence: str) -> Counter:
    """Letters of a sentence by script; those in quotations and brackets count only if there are no others."""
    for text in (_QUOTED.sub(" ", sentence), sentence):
        seen: Counter = Counter()
        for ch, n in Counter(text).items():
            if name := script_of(ch):
                seen[name] += n
        if seen:
            break
    return seen


def words_of(sentence: str) -> list[str]:
    """Distinct words of a sentence; of ideographs and kana, whole runs between marks."""
    text = _CODE.sub(" ", _QUOTED.sub(" ", sentence))
    if not re.search(r"[^\W\d_]", text):
        text = sentence
    return list(dict.fromkeys(re.sub(r"[\W\d_]+", " ", text.lower()).split()))


def word_features(word: str) -> np.ndarray:
    """Hashed character n-grams of a word (1 to 4; 1 and 2 among ideographs and kana), each once, and the word itself."""
    w = f" {word} "
    grams = {w[i : i + n] for n in ((1, 2) if ord(word[0]) > 0x3000 else (1, 2, 3, 4)) for i in range(len(w) - n + 1)}
    if len(word) < 12:
        grams.add(f"={word}")
    return np.fromiter({zlib.crc32(g.encode()) & ((1 << _BITS) - 1) for g in grams}, np.int64)


def features(sentence: str, kept: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Features of all words of a sentence, each once; words recur, so theirs are kept."""
    kept = {} if kept is None else kept
    found = []
    for word in words_of(sentence):
        x = kept.get(word)
        if x is None:
            if len(kept) >= 100_000:
                kept.clear()
            x = kept[word] = word_features(word)
        found.append(x)
    if not found:
        return np.empty(0, np.int64)
    x = np.concatenate(found)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _svm(xs: list[np.ndarray], ys: np.ndarray, epochs: int = 6, c: float = 1e-4) -> np.ndarray:
    """Linear machine by stochastic subgradients, averaged over the last half; the order is fixed by a seed."""
    w, total, taken = np.zeros((1 << _BITS) + 1), np.zeros((1 << _BITS) + 1), 0
    order, step, rng = np.arange(len(xs)), 0, np.random.default_rng(7)
    for epoch in range(epochs):
        rng.shuffle(order)
        for i in order:
            step += 1
            x = xs[i]
            norm = 1 / math.sqrt(len(x) or 1)
            if ys[i] * ((w[x].sum()) * norm + w[-1]) < 1:
                rate = 1 / (1 + 0.001 * step)
                w[x] += rate * ys[i] * norm
                w[-1] += 0.1 * rate * ys[i]
        w *= 1 - c
        if epoch >= epochs // 2:
            total += w
            taken += 1
    return total / max(taken, 1)


@dataclass
class LanguageModel:
    """Families with their languages, and a machine for each pair within a family."""

    members: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    kept: dict[str, np.ndarray] = field(default_factory=dict)
    letters: dict[str, dict[str, float]] = field(default_factory=dict)  # log probability of each script's letters in a family

    def family(self, sentence: str) -> tuple[str, float]:
        """Likeliest family of a sentence by the scripts of its letters, and the share of letters that are likeliest in it; '' with fewer than two letters."""
        seen = scripts(sentence)
        if sum(seen.values()) < 2 or not self.letters:
            return "", 0.0  # a single letter says nothing
        best = max(self.letters, key=lambda f: sum(n * self.letters[f].get(k, self.letters[f][""]) for k, n in seen.items()))
        typical = sum(n for k, n in seen.items() if self.letters[best].get(k, self.letters[best][""]) >= max(v.get(k, v[""]) for v in self.letters.values()))
        return best, max(0.01, typical / sum(seen.values()))

    def _fit_families(self, rows: list[tuple[str, str]]) -> None:
        """Script probabilities of each family, first from all rows, then from those the first fit doesn't contradict."""
        known = [(FAMILIES.get(label, label), s) for label, s in rows]
        for last in (False, True):
            counts: dict[str, Counter] = {}
            for kin, s in known:
                counts.setdefault(kin, Counter()).update(scripts(s))
            kinds = {k for c in counts.values() for k in c}
            self.letters = {kin: {k: math.log((c[k] + 1) / (sum(c.values()) + len(kinds) + 1)) for k in (*kinds, "")} for kin, c in sorted(counts.items())}
            if not last:
                known = [(kin, s) for kin, s in known if self.family(s)[0] == kin]

    def scores(self, sentence: str) -> dict[str, float] | None:
        """Probability of each language of the sentence's family; None without letters."""
        kin, share = self.family(sentence)
        if not kin:
            return None
        langs = self.members.get(kin, [])
        if not langs:
            return None
        if len(langs) == 1:
            return {langs[0]: share}
        pairs = [q for q in combinations(langs, 2) if q in self.machines]
        x = features(sentence, self.kept)
        logp = dict.fromkeys(langs, 0.0)
        for a, b in pairs:
            w = self.machines[a, b]
            z = max(-20.0, min(20.0, 3 * (float(w[x].sum()) / math.sqrt(len(x) or 1) + w[-1])))
            logp[a] -= math.log1p(math.exp(-z))
            logp[b] -= math.log1p(math.exp(z))
        top = max(logp.values())
        p = {k: math.exp(v - top) for k, v in logp.items()}
        total = sum(p.values())
        return {k: share * v / total for k, v in p.items()}

    def segments(self, text: str, ends: list[int], switch: float = 1.0) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence): longest runs of whole sentences in one language."""
        cuts, start = [], 0
        for e in ends:
            cuts.append((start, e))
            start = e
        found = [self.scores(fold(text[a:b])) for a, b in cuts]
        langs = sorted({k for f in found if f for k in f})
        if not langs:
            return []
        back, best = [], dict.fromkeys(langs, 0.0)
        for f in found:
            top = max(best.values())
            came = max(best, key=lambda k: best[k])
            new, frm = {}, {}
            for k in langs:
                stay = best[k] >= top - switch
                new[k] = (best[k] if stay else top - switch) + (0.0 if f is None else math.log(max(f.get(k, 0.0), 1e-4)))
                frm[k] = k if stay else came
            back.append(frm)
            best = new
        path, k = [], max(best, key=lambda q: best[q])
        for frm in reversed(back):
            path.append(k)
            k = frm[k]
        path.reverse()
        out: list[list] = []
        for (a, b), lang, f in zip(cuts, path, found):
            p = f.get(lang, 0.0) if f else None
            if out and out[-1][2] == lang:
                out[-1][1] = b
                if p is not None:
                    out[-1][3].append(p)
            else:
                out.append([a, b, lang, [p] if p is not None else []])
        return [(a, b, lang, round(float(np.mean(p)) if p else 0.5, 4)) for a, b, lang, p in out]

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]]) -> LanguageModel:
        """From (label, sentence); sentences of a foreign family, then those that contradict a first fit, are dropped."""
        total = Counter(label for label, _ in labelled)
        votes_of: dict[str, Counter] = {}
        text: dict[str, str] = {}
        for label, sentence in labelled:
            shape = re.sub(r"\d+", "0", sentence)
            text.setdefault(shape, sentence)
            votes_of.setdefault(shape, Counter())[label] += 1
        # a sentence seen under several labels belongs to the one in which it is relatively most frequent
        seen = {(max(sorted(v), key=lambda q: v[q] / total[q]), shape): text[shape] for shape, v in votes_of.items()}
        model = cls()
        model._fit_families([(label, s) for (label, _), s in seen.items()])
        for label in sorted(total):
            model.members.setdefault(FAMILIES.get(label, label), []).append(label)
        kin = {s: model.family(s)[0] for s in seen.values()}
        rows = {label: [s for (q, _), s in seen.items() if q == label and kin[s] == FAMILIES.get(label, label)] for label in total}
        cache = {s: features(s, model.kept) for v in rows.values() for s in v}
        for last in (False, True):
            for langs in model.members.values():
                for a, b in combinations(langs, 2):
                    xs = [cache[s] for q in (a, b) for s in rows[q]]
                    ys = np.array([y for q, y in ((a, 1.0), (b, -1.0)) for _ in rows[q]])
                    model.machines[a, b] = _svm(xs, ys)
            if not last:
                for label in rows:
                    rows[label] = [s for s in rows[label] if (p := model.scores(s)) and max(p, key=lambda k: p[k]) == label]
        model.machines = {k: v.astype(np.float32) for k, v in model.machines.items()}
        model.kept.clear()
        return model


def label_of(lang: Column) -> Column:
    """The two-letter code in a label of any case, with script or region or without."""
    return F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})(?:[-_].*)?$", 1)


def train(documents: DataFrame, text: str, lang: str, key: str, boundaries: BoundaryModel, languages: tuple[str, ...] = LANGUAGES, per_language: int = 600) -> LanguageModel:
    """Fit on at most ``per_language`` documents of each label, by order of a hash of the key."""
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), label_of(F.col(lang)).alias("l")).where("t is not null and t <> ''")
    # a limit in each partition stands below the window's shuffle, so the table is read once and few rows move
    first = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    sample = rows.where(F.col("l").isin(list(languages))).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).select("t", "l").orderBy("l", F.xxhash64("t"))
    labelled = []
    for r in sample.toPandas().itertuples(index=False):
        start = 0
        for end in boundaries.ends(r.t):
            labelled.append((r.l, fold(r.t[start:end].strip())))
            start = end
    return LanguageModel.fit(labelled)


def segments(documents: DataFrame, text: str, lang: str, key: str, boundaries: BoundaryModel, model: LanguageModel) -> DataFrame:
    """(key, label, seg_no, seg_lang, confidence, start_pos, end_pos, languages): one row per segment of each document.

    ``label`` is the code in ``lang`` or ''; ``languages`` is the number of
    different languages in the document.
    """
    shared = documents.sparkSession.sparkContext.broadcast((boundaries, model))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, q in zip(pdf["k"], pdf["t"], pdf["l"]):
                found = shared.value[1].segments(t, shared.value[0].ends(t))
                n = len({s[2] for s in found})
                rows += [(k, q, no, s[2], s[3], s[0], s[1], n) for no, s in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["k", "label", "seg_no", "seg_lang", "confidence", "start_pos", "end_pos", "languages"])

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(label_of(F.col(lang)), F.lit("")).alias("l")).where("t is not null and t <> ''")
    out = rows.mapInPandas(cut, "k long, label string, seg_no long, seg_lang string, confidence double, start_pos long, end_pos long, languages int")
    return out.withColumnRenamed("k", key)


def mislabelled(found: DataFrame) -> DataFrame:
    """The segments of documents whose label is missing or wrong, or that hold more than one language."""
    return found.where((F.col("languages") > 1) | (F.col("label") != F.col("seg_lang")))
