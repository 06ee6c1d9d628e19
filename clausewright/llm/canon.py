"""Visually identical text in one consistent form (problem 5).

Two stages. *Folding* works character by character: other-width letters and
digits, compatibility ideographs and radicals, separate accents, invisible
characters and unusual spaces have one plain equivalent. *Script-aware repair*
works on letter runs (tokens): the dominant script of the token is found, its
look-alikes from other scripts are substituted, and the result is taken only
if the corpus vocabulary holds it. Vocabulary and repairs are tables that are
joined, so neither is collected.

Defined results: null stays null, '' stays '', punctuation of any width, tabs
and line breaks are left alone, and a foreign word written in its own script
(no vocabulary word looks like it) is left alone.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.plans.lineage import cut

# Letters of other scripts that look like a Latin letter.
CYRILLIC_AS_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw"))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυιχκ", "ABEZHIKMNOPTYXovpuixk"))
AS_LATIN = {**CYRILLIC_AS_LATIN, **GREEK_AS_LATIN}
AS_CYRILLIC = {v: k for k, v in CYRILLIC_AS_LATIN.items()}
AS_GREEK = {v: k for k, v in GREEK_AS_LATIN.items()}
# Simplified radicals without a compatibility mapping.
RADICALS = dict(zip("⺠⻁⻄⻅⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻤⻥⻦⻨⻩⻬⻮⻰", "民虎西见贝车长门青韦页风飞食马鬼鱼鸟麦黄齐齿龙"))

# Letters of the scripts with look-alikes, as the classes of a Java pattern.
_LATIN, _GREEK, _CYRILLIC = (rf"[\p{{L}}&&[{r}]]" for r in (r"\x{0}-\x{24f}\x{1e00}-\x{1eff}", r"\x{370}-\x{3ff}\x{1f00}-\x{1fff}", r"\x{400}-\x{52f}"))
_JOINERS = "‌‍"
_SUSPECT = re.compile(r"[^\x00-\x7e一-鿿、-】！-／：-＠]")
_RUN = re.compile(r"[^\W\d_]+")
_FOLDED: dict[str, str] = {}


def fold_char(ch: str) -> str:
    """The plain equivalent of one character; '' for one that doesn't show."""
    got = _FOLDED.get(ch)
    if got is None:
        kind, got = unicodedata.category(ch), ch
        if kind == "Cf":
            got = ""
        elif kind == "Zs":
            got = " "
        elif ch in RADICALS:
            got = RADICALS[ch]
        elif kind[0] in "LN" and kind not in ("No", "Nl", "Lm") or 0x2E80 <= ord(ch) <= 0x2FDF:
            how = unicodedata.decomposition(ch)
            if how and (" " not in how or how.split(" ", 1)[0] in ("<wide>", "<narrow>", "<font>", "<compat>")):
                got = unicodedata.normalize("NFKC", ch)
        _FOLDED[ch] = got
    return got


def _joins(ch: str) -> bool:
    """Whether the joiner characters carry meaning beside this letter (Arabic and Indic scripts)."""
    return "؀" <= ch <= "߿" or "ऀ" <= ch <= "෿"


def fold(text: str | None) -> str | None:
    """Character-level canonical form, without the vocabulary."""
    if not text or text.isascii() or not _SUSPECT.search(text):
        return text
    if any(c in text for c in _JOINERS) and any(_joins(c) for c in text):
        out = "".join(c if c in _JOINERS and 0 < i < len(text) - 1 and _joins(text[i - 1]) and _joins(text[i + 1]) else fold_char(c) for i, c in enumerate(text))
    else:
        out = "".join(map(fold_char, text))
    return unicodedata.normalize("NFC", out) if any(unicodedata.combining(c) for c in out) else out


def script(ch: str) -> str:
    """'L', 'C', 'G' for Latin, Cyrillic, Greek letters; '' for anything else."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    return "C" if 0x400 <= o < 0x530 else ""


def runs(text: str | None) -> list[str]:
    """Letter runs of the alphabets with look-alikes; ideographs and kana end a run."""
    out = []
    for m in _RUN.finditer(text or ""):
        piece = ""
        for ch in m.group():
            if script(ch):
                piece += ch
            elif piece:
                out.append(piece)
                piece = ""
        if piece:
            out.append(piece)
    return out


def repairs_of(token: str) -> list[str]:
    """What the token could become once its look-alikes take one script, the dominant script's version first.

    A tie goes to Latin. A token wholly of another script is offered only as
    Latin, and only if each of its letters has a Latin look-alike; the
    vocabulary decides.
    """
    kinds = [script(c) for c in token]
    n = {k: kinds.count(k) for k in "LCG"}
    if n["L"] == len(token):
        return []
    out = []
    for own, to in sorted((("L", AS_LATIN), ("C", AS_CYRILLIC), ("G", AS_GREEK)), key=lambda x: -n[x[0]]):
        if (n[own] or own == "L") and n[own] < len(token) and all(k == own or c in to for c, k in zip(token, kinds)):
            out.append("".join(c if k == own else to[c] for c, k in zip(token, kinds)))
    return out


@F.pandas_udf(T.StringType())
def fold_text(s: pd.Series) -> pd.Series:
    """Column form of :func:`fold`."""
    return s.map(fold)


_FORM = T.StructType([T.StructField("folded", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])


def suspicious(text: str | None) -> list[str]:
    """Distinct letter runs for which :func:`repairs_of` offers a repair."""
    return [] if not text or text.isascii() else sorted({t for t in runs(text) if not t.isascii() and repairs_of(t)})


@F.pandas_udf(_FORM)
def form(s: pd.Series) -> pd.DataFrame:
    """Folded text and its suspicious letter runs, in one pass."""
    folded = [fold(x) for x in s]
    return pd.DataFrame({"folded": folded, "tokens": [suspicious(x) for x in folded]})


def plain_tokens(folded: Column) -> Column:
    """Lower-case letter runs of one script each, what the vocabulary counts; JVM-side."""
    found = F.regexp_extract_all(F.lower(F.coalesce(folded, F.lit(""))), F.lit(f"[{_LATIN}{_GREEK}{_CYRILLIC}]+"), F.lit(0))
    return F.filter(found, lambda t: t.rlike(f"^(?:{_LATIN}+|{_GREEK}+|{_CYRILLIC}+)$"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def offered(s: pd.Series) -> pd.Series:
    """Column form of :func:`repairs_of`."""
    return s.map(repairs_of)


@F.pandas_udf(T.StringType())
def apply_repairs(s: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """Replace whole letter runs by their accepted repairs."""

    def one(text: str | None, a, b) -> str | None:
        if text is None or a is None or not len(a):
            return text
        known = dict(zip(a, b))
        return re.sub(r"[A-ɏͰ-ԯḀ-῿]+", lambda m: "".join(known.get(t, t) for t in re.split(r"(\W|\d|_)", m.group())), text)

    return pd.Series([one(*x) for x in zip(s, old, new)])


@F.pandas_udf(T.BooleanType())
def _covered(cands: pd.Series, words: pd.Series) -> pd.Series:
    """Whether a run is a concatenation of the given vocabulary words (words glued by lost spaces)."""

    def one(c: str, have) -> bool:
        ok, have = [True] + [False] * len(c), set(have)
        for j in range(1, len(c) + 1):
            ok[j] = any(ok[i] and c[i:j] in have for i in range(max(0, j - 24), j))
        return ok[-1]

    return pd.Series([one(*x) for x in zip(cands, words)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(s: pd.Series) -> pd.Series:
    """Substrings of 2 to 24 letters that a glued run may be made of; longer and one-letter words are not tried."""
    return s.map(lambda c: sorted({c[i:j] for i in range(len(c)) for j in range(i + 2, min(len(c), i + 24) + 1)}))


def vocabulary(folded: DataFrame, column: str) -> DataFrame:
    """(word, n): lower-case single-script letter runs of folded values with their counts."""
    return folded.select(F.explode(plain_tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def repairs(values: DataFrame, tokens: str, vocab: DataFrame, glue_min: int = 3) -> DataFrame:
    """(token, repaired): accepted repairs of all suspicious tokens listed in the column ``tokens``.

    Accepted is a repair that the vocabulary holds (if the token is of one
    script, more often than the token itself), or that is a concatenation of words seen at least ``glue_min``
    times each (lost spaces glue words together).
    """
    seen = values.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("own"))
    cand = seen.select("token", "own", F.posexplode(offered("token")).alias("rank", "repaired")).withColumn("word", F.lower("repaired"))
    known = cand.join(vocab, "word", "left")
    mixed = F.col("token").rlike("[A-Za-z\u00c0-\u024f]")  # a token of one foreign script may be a foreign word
    whole = known.where(F.col("n").isNotNull() & (mixed | (F.col("n") > F.col("own")))).select("token", "repaired", "rank")
    open_ = known.where("n is null and length(word) >= 6")
    parts = open_.select("token", "rank", F.col("word").alias("whole"), "repaired", F.explode(_parts("word")).alias("word"))
    glued = (
        parts.join(vocab.where(F.col("n") >= glue_min), "word")
        .groupBy("token", "repaired", "rank", "whole")
        .agg(F.collect_set("word").alias("words"))
        .where(_covered("whole", "words"))
        .select("token", "repaired", F.expr("rank + 10").alias("rank"))
    )
    return whole.unionByName(glued).groupBy("token").agg(F.min_by("repaired", "rank").alias("repaired"))


def canonical(values: DataFrame, key: list[str], column: str, out: str = "canon", corpus: DataFrame | None = None) -> DataFrame:
    """``values`` with ``out``, the consistent form of ``column``, and ``folded``, the form before token repair.

    ``key`` identifies a row of ``values``; rows are kept exactly, null in,
    null out. ``corpus`` (one column named like ``column``) feeds the
    vocabulary; by default the column itself.
    """
    # texts are folded once; what needs no repair isn't joined with anything
    staged = cut(values.withColumn("_form", form(F.col(column))).withColumn("folded", F.col("_form.folded")).withColumn("_tokens", F.col("_form.tokens")).drop("_form"))
    source = staged.select("folded") if corpus is None else corpus.select(fold_text(F.col(column)).alias("folded"))
    accepted = repairs(staged, "_tokens", vocabulary(source, "folded"))
    has = F.size("_tokens") > 0
    wanted = staged.where(has).select(*key, F.explode("_tokens").alias("token"))
    per_row = (
        wanted.join(accepted, "token")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("token", "repaired"))).alias("_fix"))
    )
    fixed = staged.where(has).join(per_row, key, "left").withColumn(out, F.when(F.col("_fix").isNull(), F.col("folded")).otherwise(apply_repairs("folded", F.col("_fix.token"), F.col("_fix.repaired"))))
    return staged.where(~has).withColumn(out, F.col("folded")).drop("_tokens").unionByName(fixed.drop("_fix", "_tokens"))


def differs(raw: Column, canon: Column) -> Column:
    """Whether a value holds a stand-in or invisible character: its consistent form is another one."""
    return raw.isNotNull() & (raw != canon)
