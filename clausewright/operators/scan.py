"""Search of records for a small set of questions without stored postings.

An index of all postings is many times as large as its texts, and a set of
questions needs few of them. Here the texts are read twice: once to count in how
many records each gram occurs, once to weigh each record whole and score it
against all questions where it is read. Only gram counts and the best rows of
each question and task move. Scores are those of :func:`index.search`.

A gram is the pair (hi, lo) of its characters' code points plus one, 21 bits
each: the last three in ``lo``, one before them in ``hi``. So keys are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.operators import index
from clausewright.plans.lineage import cut

BLOCK = 1 << 21  # characters that are sorted at once
CELLS = 1 << 22  # scores that are held at once
KNOWN = 1 << 21  # most grams whose idf is sent to all workers; others meet theirs by shuffle
VECTORS = 1 << 12  # most questions that are scored in one pass
LONGEST = 4  # characters of the longest gram that (hi, lo) holds
_POINTS = 0x110000


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, length of each)."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return joined.astype(np.int64), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def counted(codes: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, ...]:
    """(hi, lo, start, row, tf): different grams of ``n`` characters in the order of their characters, and for
    each the rows that hold it from ``start`` on (``start`` has one entry more), with how often they do."""
    m = max(len(codes) - n + 1, 0)
    inside = np.flatnonzero(row[:m] == row[len(row) - m :])
    seen = np.zeros(_POINTS, dtype=bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    number = np.zeros(_POINTS, dtype=np.int64)
    number[letters] = np.arange(len(letters))
    ids = number[codes]
    low = max(rows - 1, 1).bit_length()
    bits = max(len(letters) - 1, 1).bit_length()
    if n * bits + low <= 63:
        key = ids[:m].copy()
        for j in range(1, n):
            key <<= bits
            key |= ids[j : j + m]
        where = None
    else:  # too many different characters for one number: grams get theirs character by character
        key = ids[inside]
        where = np.arange(len(inside))
        for j in range(1, n):
            _, where, key = np.unique(key * len(letters) + ids[inside + j], return_index=True, return_inverse=True)
    key = ((key << low)[inside] if where is None else key << low) | row[inside]
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    tf = np.diff(new, append=len(key))
    key = key[new]
    gram = key >> low
    start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))[: len(key)])
    own = gram[start]
    if where is None:
        chars = [letters[(own >> (bits * (n - 1 - j))) & ((1 << bits) - 1)] for j in range(n)]
    else:
        chars = [codes[inside[where[own]] + j] for j in range(n)]
    hi, lo = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
    for j, c in enumerate(chars):
        if j < n - 3:
            hi = (hi << 21) | (c + 1)
        else:
            lo = (lo << 21) | (c + 1)
    return hi, lo, np.append(start, len(key)), key & ((1 << low) - 1), tf


def blocks(batches: Iterator[pa.RecordBatch], most_rows: int = 1 << 20) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, int]]:
    """(numeric columns, code points, row of each, rows) of some :data:`BLOCK` characters; the text is the last column."""
    held: list[list] = []
    texts: list[str] = []
    size = 0

    def block() -> tuple:
        codes, lengths = points(texts)
        return [np.concatenate(c) for c in zip(*held)], codes, np.repeat(np.arange(len(texts)), lengths), len(texts)

    for batch in batches:
        *columns, text = batch.columns
        columns, every, begin = [c.to_numpy(zero_copy_only=False) for c in columns], text.to_pylist(), 0
        for end, one in enumerate(every, 1):
            size += len(one)
            if size >= BLOCK or len(texts) + end - begin >= most_rows or end == len(every):
                held.append([c[begin:end] for c in columns])
                texts += every[begin:end]
                begin = end
                if size >= BLOCK or len(texts) >= most_rows:
                    yield block()
                    held, texts, size = [], [], 0
    if texts:
        yield block()


def _plain(records: DataFrame, text: Column | str, how: index.Vectorizer, *columns: str | Column) -> DataFrame:
    return records.select(*columns, index.gram_text(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), how).alias("_t"))


def frequencies(records: DataFrame, text: str, how: index.Vectorizer = index.PLAIN) -> DataFrame:
    """(hi, lo, df): in how many records each gram occurs; a block's grams are counted before they move."""
    if how.most > LONGEST:
        raise ValueError(f"grams of more than {LONGEST} characters need the index")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, row, rows in blocks(batches):
            for n in range(how.least, how.most + 1):
                hi, lo, start, _, _ = counted(codes, row, rows, n)
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(np.diff(start))], ["hi", "lo", "df"])

    made = _plain(records, text, how).mapInArrow(count, "hi long, lo long, df long")
    found = made.groupBy("hi", "lo").agg(F.sum("df").alias("df"))
    return found.where(F.col("df") >= how.min_df)


class Table:
    """Values of grams, looked up by (hi, lo)."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, idf: np.ndarray):
        self.lo, at = np.unique(lo, return_inverse=True)
        key = hi * max(len(self.lo), 1) + at
        order = np.argsort(key, kind="stable")
        self.key, self.idf = key[order], idf[order]

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Places of grams, -1 for those that aren't there."""
        if not len(self.key):
            return np.full(len(hi), -1)
        at = np.minimum(np.searchsorted(self.lo, lo), len(self.lo) - 1)
        key = np.where(self.lo[at] == lo, hi * len(self.lo) + at, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def _weight(tf: np.ndarray, how: index.Vectorizer) -> np.ndarray:
    return np.log(tf) + 1 if how.sublinear else tf.astype(np.float64)


class Best:
    """The best rows of each question so far: by score to nine places, then by key descending."""

    def __init__(self, questions: int, top: int):
        self.top, self.least = top, np.zeros(questions)
        self.held = [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.float64, np.float64)]

    def add(self, key: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` by row and question."""
        rounded = np.round(scores, 9)
        least = self.least
        if len(key) > self.top:
            least = np.maximum(least, np.partition(rounded, len(key) - self.top, axis=0)[len(key) - self.top])
        row, question = np.nonzero((scores > 0) & (rounded >= least))
        new = [question, key[row], scores[row, question], rounded[row, question]]
        held = [np.concatenate(x) for x in zip(self.held, new)]
        order = np.lexsort((~held[1], -held[3], held[0]))
        held = [x[order] for x in held]
        begins = np.searchsorted(held[0], np.arange(len(self.least)))
        rank = np.arange(len(order)) - begins[held[0]]
        self.held = [x[rank < self.top] for x in held]
        full = rank == self.top - 1
        self.least[held[0][full]] = held[3][full]


class _Vectors:
    """Questions by gram: those that hold the gram at a place of a :class:`Table`, and with what weight."""

    def __init__(self, table: Table, texts: list[str], how: index.Vectorizer):
        codes, lengths = points(texts)
        row = np.repeat(np.arange(len(texts)), lengths)
        parts = []
        for n in range(how.least, how.most + 1):
            hi, lo, start, r, tf = counted(codes, row, len(texts), n)
            at = np.repeat(table.find(hi, lo), np.diff(start))
            parts.append((at, r, _weight(tf, how)))
        at, r, w = (np.concatenate(x) for x in zip(*parts))
        at, r, w = at[at >= 0], r[at >= 0], w[at >= 0]  # grams of no record drop out before the length is taken
        w = w * table.idf[at]
        w /= np.sqrt(np.bincount(r, w * w, len(texts)))[r]
        order = np.lexsort((r, at))
        self.at, self.question, self.weight = at[order], r[order], w[order]
        self.place, begin = np.unique(self.at, return_index=True)
        self.begin = np.append(begin, len(self.at))


def _scored(table: Table, asked: _Vectors, questions: int, top: int, how: index.Vectorizer, batches: Iterator[pa.RecordBatch]) -> Best:
    best = Best(questions, top)
    slot = np.full(len(table.key) + 1, -1)  # the last one is for grams that aren't there
    slot[asked.place] = np.arange(len(asked.place))
    idf = np.append(table.idf, 0.0)
    for (key, more), codes, row, rows in blocks(batches, max(CELLS // questions, 1)):
        size, score = more.astype(np.float64), np.zeros((rows, questions))
        for n in range(how.least, how.most + 1):
            hi, lo, start, r, tf = counted(codes, row, rows, n)
            at = table.find(hi, lo)
            w = _weight(tf, how) * np.repeat(idf[at], np.diff(start))
            size += np.bincount(r, w * w, rows)
            own = slot[at]
            for g in np.flatnonzero(own >= 0):
                a, b, k = start[g], start[g + 1], own[g]
                c, e = asked.begin[k], asked.begin[k + 1]
                score[r[a:b, None], asked.question[c:e]] += w[a:b, None] * asked.weight[c:e]
        best.add(key, score / np.sqrt(np.where(size > 0, size, 1.0))[:, None])
    return best


def _known(frequency: DataFrame, asked: DataFrame, n: int) -> tuple[Table, DataFrame | None]:
    """Idf of the most frequent grams and of all that are asked for, and the counts of the rest if there are any."""
    def idf(df: np.ndarray) -> np.ndarray:
        return np.log((1.0 + n) / (1.0 + df)) + 1

    grade = F.floor(F.log2("df") * 8)
    sizes = {r[0]: r[1] for r in frequency.groupBy(grade.alias("g")).count().collect()}
    least, total = None, 0
    for g in sorted(sizes, reverse=True):
        total += sizes[g]
        if total > KNOWN:
            break
        least = g
    often = F.lit(False) if least is None else grade >= least
    got = frequency if total <= KNOWN else frequency.where(often).unionByName(frequency.where(~often).join(F.broadcast(asked), ["hi", "lo"], "left_semi"))
    found = got.toArrow()
    hi, lo, df = (found[c].to_numpy() for c in ("hi", "lo", "df"))
    return Table(hi, lo, idf(df)), None if total <= KNOWN else frequency.where(~often).join(F.broadcast(asked), ["hi", "lo"], "left_anti")


def _lacking(rows: DataFrame, table, rest: DataFrame, n: int, how: index.Vectorizer) -> DataFrame:
    """(_k, _s): what grams that the table lacks add to the square of a record's length."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), codes, row, count in blocks(batches):
            for k in range(how.least, how.most + 1):
                hi, lo, start, r, tf = counted(codes, row, count, k)
                gone = np.repeat(table.value.find(hi, lo) < 0, np.diff(start))
                of = [np.repeat(x, np.diff(start))[gone] for x in (hi, lo)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[r[gone]], *of, _weight(tf[gone], how))], ["_k", "hi", "lo", "w"])

    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1
    pairs = rows.mapInArrow(emit, "_k long, hi long, lo long, w double").join(rest, ["hi", "lo"])
    return pairs.groupBy("_k").agg(F.sum((F.col("w") * idf) * (F.col("w") * idf)).alias("_s"))


def finder(records: DataFrame, frequency: DataFrame, n: int, key: str, text: str, other: index.Finder, query_id: str = "query_id", query: str = "query", how: index.Vectorizer = index.PLAIN) -> index.Finder:
    """Searches several sets of questions in one pass over the records of the types asked for; keys are whole numbers.

    ``frequency`` is that of all ``n`` records. Sets of more than
    :data:`VECTORS` questions or :data:`index.BROADCAST` bytes are left to ``other``.
    """
    spark = records.sparkSession

    def find(sets: list[DataFrame], top: int, types: list[str]) -> list[DataFrame]:
        top = max(top, 1)
        numbered = [s.where(F.col(query).isNotNull()).select(F.lit(i).alias("_set"), F.col(query_id).alias("_q"), F.col(query).alias("_text")) for i, s in enumerate(sets)]
        both = numbered[0]
        for s in numbered[1:]:
            both = both.unionByName(s)
        both = cut(both)
        count, size = both.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
        # each character begins one gram of each length, with number, question and weight
        if count > VECTORS or size * (how.most - how.least + 1) * 24 > index.BROADCAST:
            return other(sets, top, types)
        kept = _plain(both, "_text", how, "_set", "_q").toArrow()
        texts = kept["_t"].to_pylist()
        codes, lengths = points(texts)
        row = np.repeat(np.arange(len(texts)), lengths)
        grams = [counted(codes, row, len(texts), k)[:2] for k in range(how.least, how.most + 1)]
        hi, lo = (np.concatenate(x) for x in zip(*grams))
        who = spark.createDataFrame(kept.select(["_set", "_q"]).append_column("_n", pa.array(np.arange(len(texts)))), f"_set int, _q {sets[0].schema[query_id].dataType.simpleString()}, _n long")
        asked = spark.createDataFrame(pa.table({"hi": pa.array(hi), "lo": pa.array(lo)}), "hi long, lo long")
        table, rest = _known(frequency, asked, n) if len(hi) else (Table(*[np.empty(0, dtype=np.int64)] * 2, np.empty(0)), None)
        vectors = _Vectors(table, texts, how)
        rows = _plain(records.where(F.col("record_type").isin(types)), text, how, F.col(key).cast("long").alias("_k"))
        tables = spark.sparkContext.broadcast(table)
        vector = spark.sparkContext.broadcast(vectors)
        if rest is None:
            whole = rows.select("_k", F.lit(0.0).alias("_s"), "_t")
        else:
            more = cut(_lacking(rows, tables, rest, n, how))
            whole = rows.join(index.beside(more, more, F.lit(60)), "_k", "left").select("_k", F.coalesce("_s", F.lit(0.0)).alias("_s"), "_t")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _scored(tables.value, vector.value, len(texts), top, how, batches).held
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["_n", key, "score", "_r"])

        schema = f"_n long, {key} long, score double, _r double"
        near = whole.mapInArrow(score, schema) if len(vectors.at) else spark.createDataFrame([], schema)
        order = Window.partitionBy("_n").orderBy(F.desc("_r"), F.desc(key))
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found = cut(ranked.join(F.broadcast(who), "_n").select("_set", F.col("_q").alias(query_id), key, "score", "rank"))
        return [found.where(F.col("_set") == i).drop("_set") for i in range(len(sets))]

    return find
