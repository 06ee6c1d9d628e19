"""Dictionary match, query expansion and the two retrieval channels, for many questions at once.

Questions are a stated set that is broadcast only while small; term and clause
tables are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as X
from clausewright.operators import index, within
from clausewright.plans.lineage import cut

GENERAL = X.CATEGORIES[0][0]


def names(terms: DataFrame, key: str) -> DataFrame:
    """(key, category_zh, alias_list, n, alias): every normalised name of each term; lower case happens later."""
    listed = X.term_names(*[F.col(c) for c in ("term_zh", "term_en", "abbreviation", "full_form", "zh_text", "en_text")], more=F.col("aliases"))
    return terms.select(key, F.coalesce("category_zh", F.lit("")).alias("category_zh"), listed.alias("alias_list"))


def candidates(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, candidate): the distinct terms each question may be about, in lower case."""
    return queries.select(query_id, F.explode(X.term_candidates(F.col(query))).alias("candidate")).select(query_id, F.lower("candidate").alias("candidate")).where("candidate <> ''")


HEAD = 4  # characters by which a text inside another one is looked up


def _inner(x: Column) -> Column:
    """Distinct substrings of 1 to :data:`HEAD` characters."""

    def every(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(c) - 1)
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.size(c) - i)), lambda k: F.array_join(F.slice(c, i + 1, k), ""))))

    return F.array_distinct(X.let(X.characters(x), every))


def _head(x: Column) -> Column:
    """The first :data:`HEAD` characters, by which a text is looked up in another one."""
    return F.substring(x, 1, HEAD)


def dictionary_matches(queries: DataFrame, terms: DataFrame, key: str, query_id: str = "query_id") -> DataFrame:
    """(query_id, key, exact, contained, score): terms one of whose names equals, holds or lies in a candidate.

    No pair of all is formed. Candidates of up to :data:`index.BROADCAST` bytes
    go to all workers and each term meets them where it is read; more of them
    are joined by short substrings.
    """
    cand = cut(candidates(queries, query_id))
    each = cand.select("candidate").distinct()
    # places, heads and inner texts of a character take some 100 bytes
    size = each.agg(F.coalesce(F.sum(F.length("candidate") + 1), F.lit(0))).first()[0] * 100
    counted = (_met if size <= index.BROADCAST else _joined)(cand, each, names(terms, key), key, query_id)
    score = (
        F.when(F.col("exact") > 0, 10.0).otherwise(8.0)
        + F.col("exact") * 2.0
        + F.col("contained") * 0.5
        + F.when((F.col("category_zh") != "") & (F.col("category_zh") != GENERAL), 0.5).otherwise(0.0)
        - F.col("size") * 0.01
    )
    return counted.select(query_id, key, "exact", "contained", F.round(score, 6).alias("score"))


def _met(cand: DataFrame, each: DataFrame, listed: DataFrame, key: str, query_id: str) -> DataFrame:
    """(query_id, key, category_zh, size, exact, contained), each term held against all candidates where it is read."""
    spark = cand.sparkSession
    texts = sorted(r[0] for r in each.collect())
    small = spark.sparkContext.broadcast(within.Small(texts))
    count = len(texts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            text, which, equal = small.value.pairs(lists.flatten().to_pylist())
            pair, at = np.unique(owner[text] * count + which, return_inverse=True)
            term, candidate = np.divmod(pair, count)
            exact, contained = np.bincount(at[equal], minlength=len(pair)), np.bincount(at, minlength=len(pair))
            held = [batch.column(i).take(pa.array(term)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*held, *map(pa.array, (candidate, exact, contained))], [key, "category_zh", "size", "_n", "exact", "contained"])

    lowered = listed.select(key, "category_zh", _size().alias("size"), F.transform("alias_list", F.lower).alias("low"))
    kind = listed.schema[key].dataType.simpleString()
    if not texts:
        lowered = lowered.limit(0)
    met = lowered.mapInArrow(meet, f"{key} {kind}, category_zh string, size int, _n long, exact long, contained long")
    numbers = spark.createDataFrame(list(enumerate(texts)), "_n long, candidate string")
    asked = F.broadcast(cand.join(F.broadcast(numbers), "candidate").select("_n", query_id))
    return met.join(asked, "_n").groupBy(query_id, key, "category_zh", "size").agg(F.sum("exact").alias("exact"), F.sum("contained").alias("contained"))


def _size() -> Column:
    """Characters of the first two names."""
    return F.aggregate(F.slice("alias_list", 1, 2), F.lit(0), lambda a, s: a + F.length(s))


def _joined(cand: DataFrame, each: DataFrame, listed: DataFrame, key: str, query_id: str) -> DataFrame:
    """As :func:`_met`, for any number of candidates.

    A text inside another one is found by an equi-join of its first characters
    with all short substrings of the other, and a check; what is joined grows
    with the length of a text only.
    """
    alias = listed.select(key, F.explode("alias_list").alias("alias")).select(key, F.lower("alias").alias("alias"))
    # equal names of many terms are looked up once
    distinct = alias.select("alias").distinct()
    parts = each.select("candidate", F.explode(_inner(F.col("candidate"))).alias("head"))
    inside = distinct.withColumn("head", _head(F.col("alias"))).join(parts, "head").where(F.col("candidate").contains(F.col("alias")))
    heads = each.select("candidate", _head(F.col("candidate")).alias("head"))
    around = distinct.select("alias", F.explode(_inner(F.col("alias"))).alias("head")).join(heads, "head").where(F.col("alias").contains(F.col("candidate")))
    pairs = inside.select("candidate", "alias").union(around.select("candidate", "alias")).distinct()
    hits = alias.join(pairs, "alias").join(cand, "candidate")
    counted = hits.groupBy(query_id, key).agg(F.sum((F.col("candidate") == F.col("alias")).cast("int")).alias("exact"), F.count(F.lit(1)).alias("contained"))
    return counted.join(listed.select(key, "category_zh", _size().alias("size")), key)


def dictionary_search(queries: DataFrame, terms: DataFrame, key: str, postings: DataFrame | None = None, idf: DataFrame | None = None, top: int = 8, query_id: str = "query_id", how: index.Vectorizer = index.PLAIN, find: index.Finder | None = None) -> DataFrame:
    """(query_id, key, score, rank): best dictionary matches, ties by key; questions without one search the index, or by ``find``."""
    found = index.top_hits(dictionary_matches(queries, terms, key, query_id), [query_id], [F.desc("score"), F.asc(key)], top).select(query_id, key, "score", "rank")
    if postings is None and find is None:
        return found
    find = find or index.finder(postings, idf, key, query_id, how)
    found = cut(found)
    rest = queries.join(found.select(query_id).distinct(), query_id, "left_anti")
    more = find([rest], top, ["glossary_term"])[0]
    return found.unionByName(more.select(query_id, key, F.round("score", 6).alias("score"), "rank"))


def expanded(queries: DataFrame, hits: DataFrame, terms: DataFrame, key: str, query_id: str = "query_id", query: str = "query", top: int = 3) -> DataFrame:
    """(query_id, query): each question followed by the names of its best terms that it doesn't hold yet, case aside."""
    hits = cut(hits.where(F.col("rank") <= top))
    terms = terms.join(index.beside(hits.select(key).distinct(), hits, F.lit(100)), key, "left_semi")
    listed = names(terms, key).select(key, "alias_list")
    extra = terms.select(key, X.abbreviation(F.coalesce("term_en", F.lit(""))).alias("_a"), X.full_form(F.coalesce("term_en", F.lit(""))).alias("_f"))
    each = hits.join(listed, key).join(extra, key).select(query_id, "rank", F.concat("alias_list", F.array(X.normalize(F.col("_a")), "_f")).alias("all"))
    gathered = each.groupBy(query_id).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "all"))), lambda s: s["all"])).alias("more"))
    joined = queries.select(query_id, F.col(query).alias("_q")).join(gathered, query_id, "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    empty = F.array().cast("array<string>")
    start = F.struct(F.array(F.lower(X.normalize(F.col("_q")))).alias("seen"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = (s != "") & ~F.array_contains(acc["seen"], F.lower(s))
        return F.struct(F.when(new, F.array_append(acc["seen"], F.lower(s))).otherwise(acc["seen"]).alias("seen"), F.when(new, F.array_append(acc["out"], s)).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate("more", start, step)
    return joined.select(query_id, F.array_join(F.concat(F.array("_q"), folded["out"]), " ").alias(query))


def regulation_search(queries: DataFrame, wide: DataFrame, postings: DataFrame | None, idf: DataFrame | None, key: str, top: int = 5, query_id: str = "query_id", how: index.Vectorizer = index.PLAIN, find: index.Finder | None = None) -> DataFrame:
    """(query_id, key, score, origin, matched_query, rank): hits of the expanded questions, then those only the raw ones have.

    Each search takes the larger of 4 * top and 16; the union isn't cut back.
    """
    n, kind = max(top * 4, 16), ["regulation_clause"]
    wide = cut(wide)
    find = find or index.finder(postings, idf, key, query_id, how)
    first, raw = find([wide, queries.select(query_id, "query")], n, kind)
    first, raw = first.withColumn("origin", F.lit("expanded")), raw.withColumn("origin", F.lit("raw"))
    new = raw.join(first.select(query_id, key), [query_id, key], "left_anti").withColumn("rank", F.col("rank") + n)
    asked = wide.select(query_id, F.col("query").alias("_wide")).join(queries.select(query_id, F.col("query").alias("_raw")), query_id)
    both = first.unionByName(new).join(asked, query_id)
    order = Window.partitionBy(query_id).orderBy("rank")
    matched = F.when(F.col("origin") == "expanded", F.col("_wide")).otherwise(F.col("_raw"))
    return both.select(query_id, key, F.round("score", 6).alias("score"), "origin", matched.alias("matched_query"), F.row_number().over(order).alias("rank"))


def traced(hits: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """``hits`` of :func:`regulation_search` with ``retrieval_trace``: channel, matched query and what the record says of itself."""
    about = records.select(key, *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("risk_level", "content_type")], F.coalesce("evidence_priority", F.lit(0)).alias("_p"))
    trace = F.struct(
        F.lit("regulation").alias("channel"), "matched_query", F.col("_risk_level").alias("risk_level"), F.col("_content_type").alias("content_type"), F.col("_p").alias("evidence_priority")
    )
    hits = cut(hits)
    return about.join(index.beside(hits, hits, F.length("matched_query") * 4 + 200), key).withColumn("retrieval_trace", trace).drop("_risk_level", "_content_type", "_p")


def dual_channel(queries: DataFrame, terms: DataFrame, postings: DataFrame | None, idf: DataFrame | None, key: str, top: int = 5, query_id: str = "query_id", how: index.Vectorizer = index.PLAIN, find: index.Finder | None = None) -> DataFrame:
    """(query_id, channel, key, score, rank): dictionary and regulation hits of every question; the dictionary is searched once."""
    hits = cut(dictionary_search(queries, terms, key, postings, idf, max(3, top), query_id, how, find))
    wide = expanded(queries, hits, terms, key, query_id)
    reg = regulation_search(queries, wide, postings, idf, key, top, query_id, how, find)
    return hits.select(query_id, F.lit("terminology").alias("channel"), key, "score", "rank").unionByName(reg.select(query_id, F.lit("regulation").alias("channel"), key, "score", "rank"))


def chosen_channel(queries: DataFrame, channels: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """The hits that answer each question by its class: terms, clauses, terms or else clauses, or none."""
    kind = queries.select(query_id, X.query_class(F.col(query)).alias("query_type"))
    has_terms = channels.where("channel = 'terminology'").select(query_id).distinct().withColumn("_t", F.lit(True))
    use = kind.join(has_terms, query_id, "left").select(
        query_id, "query_type",
        F.when(F.col("query_type") == "term", "terminology").when(F.col("query_type") == "paper", "none")
        .when((F.col("query_type") == "bilingual") & F.col("_t"), "terminology").otherwise("regulation").alias("channel"),
    )
    return channels.join(use, [query_id, "channel"])
