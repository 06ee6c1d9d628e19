"""Character n-gram index as plain tables: postings (record, gram, weight) and idf.

Weights are those of sublinear tf-idf with smooth idf and unit length. Postings
lie with their record and keep its type, so that a type filter reaches the scan
and a score is summed without moving; idf stays global.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.functions import text as X
from clausewright.plans.lineage import cut


@dataclass(frozen=True)
class Vectorizer:
    """How texts become vectors: shortest and longest gram, least number of records of a gram, case folding, logarithmic counts."""

    least: int = 2
    most: int = 4
    min_df: int = 1
    lowercase: bool = True
    sublinear: bool = True


PLAIN = Vectorizer()


def gram_text(x: Column, how: Vectorizer = PLAIN) -> Column:
    """Lower case if wanted, runs of two or more white spaces as one space."""
    return F.regexp_replace(F.lower(x) if how.lowercase else x, X.WS + "{2,}", " ")


def grams(x: Column, how: Vectorizer = PLAIN) -> Column:
    """All character n-grams of a text, repeated ones included; shorter texts give those that fit."""
    def of(c: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0)))
        made = F.transform(starts, lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
        return F.when(F.size(c) >= n, made).otherwise(F.array().cast("array<string>"))

    return X.let(X.characters(gram_text(x, how)), lambda c: F.concat(*[of(c, n) for n in range(how.least, how.most + 1)]))


def term_frequency(records: DataFrame, key: str, text: str, keep: list[str] | None = None, how: Vectorizer = PLAIN) -> DataFrame:
    """(key, keep..., gram, tf): counted within a record before anything is shuffled."""
    keep = keep or []
    # texts move once, by record; the far larger grams are then counted where they arise. The number of
    # partitions is given, since by the size of the texts alone they would be merged into too few
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = records.select(key, *keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).repartition(parts, F.col(key))
    return rows.select(key, *keep, F.explode(grams(F.col("_t"), how)).alias("gram")).groupBy(key, *keep, "gram").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequency(tf: DataFrame, records: int, how: Vectorizer = PLAIN) -> DataFrame:
    """(gram, df, idf) with idf = ln((1 + N) / (1 + df)) + 1, of the grams of ``min_df`` records or more."""
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= how.min_df)
    return df.withColumn("idf", F.log((F.lit(1.0) + records) / (F.lit(1.0) + F.col("df"))) + 1)


FREQUENT = 0.001  # share of the records from which on a gram is sent to all workers instead of being shuffled


def weighted(tf: DataFrame, idf: DataFrame, key: str, keep: list[str] | None = None, records: int | None = None, how: Vectorizer = PLAIN) -> DataFrame:
    """(key, keep..., gram, w): (1 + ln tf) * idf over the length of the record's vector.

    With ``records``, the number of records, grams that a thousandth of them
    hold meet their idf by broadcast: there are at most a thousand times as
    many of them as a record has grams on average, whatever the number of
    records. Only the rest is shuffled, so no gram is a hot key.
    """
    keep = keep or []
    table = idf.select("gram", "idf", *(["df"] if records else []))
    if records:
        often = F.broadcast(table.where(F.col("df") >= FREQUENT * records).select("gram", "idf"))
        rare = table.where(F.col("df") < FREQUENT * records).select("gram", "idf")
        # the rare ones come back to their records, the others have never left them
        parts = int(tf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        raw = tf.join(often, "gram").unionByName(tf.join(often, "gram", "left_anti").join(rare, "gram").repartition(parts, key))
    else:
        raw = tf.join(table, "gram")
    count = F.col("tf").cast("double")
    raw = raw.withColumn("_w", (F.log(count) + 1 if how.sublinear else count) * F.col("idf"))
    # a window's group is one record
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.withColumn("_n", norm).select(key, *keep, "gram", (F.col("_w") / F.col("_n")).alias("w"))


def build(records: DataFrame, key: str, text: str, keep: list[str] | None = None, how: Vectorizer = PLAIN) -> tuple[DataFrame, DataFrame]:
    """(postings, idf) of the records; postings are partitioned by record, so that :func:`search` scores each record where it lies."""
    n = records.count()
    tf = cut(term_frequency(records, key, text, keep, how), placed=True)
    idf = cut(inverse_frequency(tf, n, how))
    return weighted(tf, idf, key, keep, max(n, 1), how), idf


def save(postings: DataFrame, idf: DataFrame, records: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Index as three parquet tables; files hold whole records, sorted by type and gram so that filters skip row groups."""
    first = postings.columns[0]
    placed = postings.repartition(partitions, first) if partitions else postings.repartition(first)
    placed.sortWithinPartitions("record_type", "gram").write.mode("overwrite").parquet(f"{folder}/postings")
    idf.write.mode("overwrite").parquet(f"{folder}/idf")
    records.write.mode("overwrite").parquet(f"{folder}/records")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, idf, records) of a saved index."""
    return tuple(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "idf", "records"))


BROADCAST = 64 << 20  # most bytes of what was derived from the questions that are sent to all workers


def beside(derived: DataFrame, source: DataFrame, size: Column, most: int = BROADCAST) -> DataFrame:
    """``derived``, marked for broadcast only if it takes at most ``most`` bytes; ``size`` bounds them for each row of ``source``."""
    total = source.agg(F.coalesce(F.sum(size.cast("double")), F.lit(0.0))).first()[0]
    return F.broadcast(derived) if total <= most else derived


def search(queries: DataFrame, postings: DataFrame, idf: DataFrame, key: str, query_id: str = "query_id", query: str = "query", top: int = 5, types: list[str] | None = None, most: int = BROADCAST, how: Vectorizer = PLAIN) -> DataFrame:
    """(query_id, key, score, rank): best records of each query by cosine, ties by key descending.

    Grams that the index doesn't hold drop out before the query's length is
    taken. Query vectors of up to ``most`` bytes are broadcast: then scores are
    summed and cut to the best ones in the partitions of the records, and only
    ``top`` rows of each query and partition move. Larger ones are joined by
    shuffle. ``top`` below 1 gives one hit.
    """
    asked = queries.where(F.col(query).isNotNull())
    # each character begins at most so many grams
    size = F.length(query) * (how.most - how.least + 1) * (40 + 4 * how.most)
    vectors = weighted(beside(term_frequency(asked, query_id, query, how=how), asked, size, most), idf, query_id, how=how).withColumnRenamed("w", "qw")
    vectors = beside(vectors, asked, size, most)
    rows = postings.where(F.col("record_type").isin(types)) if types else postings
    scored = rows.join(vectors, "gram").groupBy(query_id, key).agg(F.sum(F.col("qw") * F.col("w")).alias("score")).where("score > 0")
    return top_hits(scored, [query_id], [F.desc(F.round("score", 9)), F.desc(key)], top)


Finder = Callable[[list[DataFrame], int, list[str]], list[DataFrame]]  # hits of each set of questions: sets, top, record types


def finder(postings: DataFrame, idf: DataFrame, key: str, query_id: str = "query_id", how: Vectorizer = PLAIN) -> Finder:
    """:func:`search` in postings."""
    return lambda sets, top, types: [search(s, postings, idf, key, query_id, top=top, types=types, how=how) for s in sets]


def top_hits(scored: DataFrame, group: list[str], order: list[Column], top: int) -> DataFrame:
    """Rows ranked 1..top within their group; the rank filter is a limit below the window's shuffle."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= max(top, 1))
