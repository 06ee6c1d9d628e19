"""Retrieval and answer metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as X


def retrieval(hits: DataFrame, relevant: DataFrame, query_id: str, key: str, top: int = 5) -> DataFrame:
    """(query_id, relevant, found, recall, reciprocal_rank, ndcg) of each question that has a relevant record."""
    n = relevant.groupBy(query_id).agg(F.count(F.lit(1)).alias("relevant"))
    good = hits.where(F.col("rank") <= top).join(relevant.select(query_id, key), [query_id, key])
    got = good.groupBy(query_id).agg(F.count(F.lit(1)).alias("found"), F.max(1.0 / F.col("rank")).alias("reciprocal_rank"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("_dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(top)).cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    joined = n.join(got, query_id, "left").fillna(0, ["found", "reciprocal_rank", "_dcg"])
    return joined.select(query_id, "relevant", "found", (F.col("found") / F.col("relevant")).alias("recall"), "reciprocal_rank", (F.col("_dcg") / best).alias("ndcg"))


def tokens(x: Column) -> Column:
    """Ideographs one by one, words of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\x{3400}-\x{9fff}]|[a-z0-9]+"), F.lit(0))


def exact_match(answer: Column, gold: Column) -> Column:
    """1.0 if both have the same tokens in the same order."""
    return (tokens(answer) == tokens(gold)).cast("double")


def token_f1(answer: Column, gold: Column) -> Column:
    """Harmonic mean of token precision and recall, repeated tokens counted; 1.0 if both have none."""

    def f1(a: Column, g: Column) -> Column:
        common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda v: v == t)), F.size(F.filter(g, lambda v: v == t))))
        both = F.size(a) + F.size(g)
        return F.when(both == 0, 1.0).otherwise(2.0 * common / both)

    return X.let(tokens(answer), lambda a: X.let(tokens(gold), lambda g: f1(a, g)))


def rouge_l(answers: DataFrame, key: str, answer: str, gold: str) -> DataFrame:
    """(key, rouge_l): F measure of the longest common subsequence of tokens."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "rouge_l": [_lcs_f(list(a), list(g)) for a, g in zip(pdf["a"], pdf["g"])]})

    rows = answers.select(F.col(key).alias("k"), tokens(F.col(answer)).alias("a"), tokens(F.col(gold)).alias("g"))
    return rows.mapInPandas(score, "k long, rouge_l double").withColumnRenamed("k", key)


def _lcs_f(a: list[str], g: list[str]) -> float:
    if not a or not g:
        return float(a == g)
    # bit-parallel longest common subsequence
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for t in g:
        hit = row & where.get(t, 0)
        row = (row + hit | row - hit) & full
    n = len(a) - row.bit_count()
    return 2 * n / (len(a) + len(g))
