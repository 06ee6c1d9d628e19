"""Reranking, snippets, glossary choice and citations over (question, hit) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as X
from clausewright.operators.index import top_hits


def haystack(*parts: Column) -> Column:
    """Texts of a hit as one normalised lower-case string."""
    return F.lower(X.normalize(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])))


def rerank_score(query: Column, hay: Column, priority: Column, risk: Column, kind: Column, score: Column) -> Column:
    """Overlap, content words, whole phrase, priority, risk, content type, retrieval score and length in one sum."""
    hits = X.let(
        hay,
        lambda h: X.let(
            X.query_terms(query),
            lambda ts: F.size(F.filter(F.array_distinct(ts), lambda t: h.contains(t))) * 2.0
            + F.aggregate(ts, F.lit(0), lambda a, t: a + X.occurrences(h, t)) * 0.2
            + F.size(F.filter(X.content_terms(query), lambda t: h.contains(t))) * 3.0,
        ),
    )
    phrase = X.trim_ws(X.key_question(query))
    return (
        hits
        + F.when((phrase != "") & hay.contains(phrase), 10.0).otherwise(0.0)
        + F.coalesce(priority, F.lit(0)) * 1.2
        + F.when(risk == "high", 1.0).when(risk == "medium", 0.5).otherwise(0.0)
        + F.when(kind.isin("restriction", "precondition", "rule", "emergency"), 1.5).otherwise(0.0)
        + F.coalesce(score, F.lit(0.0))
        + F.least(F.length(hay), F.lit(200)) / 200.0
    )


def reranked(hits: DataFrame, query_id: str = "query_id", top: int = 5) -> DataFrame:
    """Hits (query, record columns, score, rank) in their new order; a question without terms keeps the old one."""
    hay = haystack(*[F.col(c) for c in ("section_path", "zh_text", "en_text", "term_zh", "term_en")])
    combined = rerank_score(F.col("query"), hay, F.col("evidence_priority"), F.col("risk_level"), F.col("content_type"), F.col("score"))
    none = F.size(X.query_terms(F.col("query"))) == 0
    scored = hits.withColumn("combined", F.when(none, F.lit(0.0)).otherwise(F.round(combined, 6)))
    return top_hits(scored.withColumnRenamed("rank", "input_rank"), [query_id], [F.desc("combined"), F.asc("input_rank")], top)


def best_snippet(query: Column, body: Column) -> Column:
    """The sentence with most occurrences of the question's terms; the first of equals, the text itself if it has none."""
    sentences = X.let(X.split_sentences(body), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(body)))

    def best(terms: Column) -> Column:
        def scored(s: Column, i: Column) -> Column:
            n = X.let(F.lower(X.normalize(s)), lambda low: F.aggregate(terms, F.lit(0), lambda a, t: a + X.occurrences(low, t)))
            return F.struct(n.alias("n"), (-i).alias("p"), s.alias("s"))

        return F.array_max(F.transform(sentences, scored))["s"]

    return X.let(X.query_terms(query), best)


def glossary_choice(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The glossary hit each question most likely asks for."""
    q = F.lower(X.normalize(F.col("query")))
    zh, en = X.normalize(F.coalesce("term_zh", F.lit(""))), X.normalize(F.coalesce("term_en", F.lit("")))
    score = (
        F.when((zh != "") & q.contains(F.lower(zh)), 5).otherwise(0)
        + F.when((en != "") & q.contains(F.lower(en)), 5).otherwise(0)
        + F.when((F.coalesce("category_zh", F.lit("")) != "") & (F.col("category_zh") != X.CATEGORIES[0][0]), 0.5).otherwise(0.0)
        + F.col("score") - (F.length(zh) + F.length(en)) * 0.01
    )
    rows = hits.where("record_type = 'glossary_term'").withColumn("choice_score", F.round(score, 6)).withColumnRenamed("rank", "input_rank")
    return top_hits(rows, [query_id], [F.desc("choice_score"), F.asc("input_rank")], 1).drop("rank")


def citations(hits: DataFrame, query_id: str = "query_id", most: int = 3) -> DataFrame:
    """(query_id, citations): the first hits of each question as an array in rank order."""
    item = F.struct(F.col("rank").cast("int").alias("index"), "record_id", "source_label", F.col("score").cast("double").alias("score"))
    return hits.where(F.col("rank") <= most).groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("citations"))


def trace(channel: Column, kind: Column, risk: Column, priority: Column) -> Column:
    """Where a hit came from, as key=value pairs without empty values."""
    pairs = [("channel", channel), ("content_type", kind), ("risk_level", risk), ("evidence_priority", priority.cast("string"))]
    return F.concat_ws(", ", *[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), v)) for k, v in pairs])


def composed(hits: DataFrame, query_id: str = "query_id", most: int = 3) -> DataFrame:
    """(query_id, answer, citations): the distinct best snippets of each question's first hits, in its own language where there is text in it.

    A question about a term or its translation is answered by its first hit alone, in both languages.
    """
    zh, en = F.coalesce("zh_text", F.lit("")), F.coalesce("en_text", F.lit(""))
    chinese = X.has_cjk(F.col("query"))
    body = F.when(chinese, F.when(zh != "", zh).otherwise(en)).otherwise(F.when(en != "", en).otherwise(zh))
    term = X.query_class(F.col("query")).isin("term", "bilingual") & (F.col("rank") == 1)
    pair = F.concat_ws(" / ", *[F.coalesce(F.expr(f"nullif({a}, '')"), F.expr(f"nullif({b}, '')")) for a, b in (("term_zh", "zh_text"), ("term_en", "en_text"))])
    rows = hits.where(F.col("rank") <= most).withColumn("_s", F.when(term, pair).otherwise(best_snippet(F.col("query"), body))).withColumn("_t", term)
    item = F.struct(F.col("rank").cast("int").alias("index"), "record_id", "source_label", F.col("score").cast("double").alias("score"))
    grouped = rows.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", "_s", "_t"))).alias("s"), F.array_sort(F.collect_list(item)).alias("c"))
    about_term = F.get(F.col("s"), 0)["_t"]
    snippets = F.array_distinct(F.filter(F.transform("s", lambda v: v["_s"]), lambda v: v != ""))
    return grouped.select(
        query_id,
        F.when(about_term, F.get(F.col("s"), 0)["_s"]).otherwise(F.array_join(snippets, " ")).alias("answer"),
        F.when(about_term, F.slice("c", 1, 1)).otherwise(F.col("c")).alias("citations"),
    )
