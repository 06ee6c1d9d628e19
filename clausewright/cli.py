"""Command line: ``build`` documents into an index, ``ask`` it one question or a file of them."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import text as X
from clausewright.operators import index, rank, retrieve, segment
from clausewright.plans.lineage import cut
from clausewright.plans.ship import importable
from clausewright.sources import docx, sinks

KEY = "record_id"


def build(spark: SparkSession, settings: sinks.Settings) -> DataFrame:
    """Records of all configured documents, written as JSON lines and as an index; counts by record type come back."""
    sources = spark.createDataFrame([(v["source_id"], v.get("title", ""), v["file"], k) for k, v in settings.documents.items()], "source_id string, source_title string, source_file string, kind string")
    blocks = docx.as_blocks(docx.read(spark, [v["file"] for v in settings.documents.values()]), sources).persist()
    kinds = sources.select("source_id", "kind")
    rules = segment.lines(blocks.join(kinds.where("kind = 'regulation'"), "source_id", "left_semi"))
    clauses = segment.clause_records(segment.clauses(segment.from_anchor(rules, F.col("line") == "第一部分 总 则")), sources)
    plain = blocks.join(kinds.where("kind = 'glossary'"), "source_id", "left_semi").where("block_type = 'paragraph'")
    words = plain.select("source_id", "ord", "block_id", X.normalize(F.col("text")).alias("line"))
    body = segment.until_stop(segment.folded(segment.from_anchor(words, segment.glossary_start(F.col("line")), required=False)), segment.glossary_stop(F.col("line")))
    records = clauses.unionByName(segment.term_records(segment.with_category(body, segment.category_keys(spark)), sources)).persist()
    if records.isEmpty():
        raise ValueError("the documents hold no clause and no term")
    sinks.write_json_lines(records, settings.paths["unified_jsonl"], [KEY])
    postings, idf = index.build(records, KEY, "retrieval_text", ["record_type"], settings.vectorizer)
    index.save(postings, idf, records, settings.paths["vector_index"])
    return records.groupBy("record_type").agg(F.count(F.lit(1)).alias("records"))


def ask(spark: SparkSession, settings: sinks.Settings, questions: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, query, query_type, risk_level, matched_risk_markers, answer, citations, terminology_hits, regulation_hits) of questions (query_id, query).

    The two lists hold the record ids of the first five hits of either channel.
    Hits of questions about a term or its translation keep their order, all
    others are reranked.
    """
    postings, idf, records = index.load(spark, settings.paths["vector_index"])
    terms = records.where("record_type = 'glossary_term'")
    channels = cut(retrieve.dual_channel(questions, terms, postings, idf, KEY, top or settings.top, how=settings.vectorizer))
    hits = retrieve.chosen_channel(questions, channels).join(questions, "query_id").join(records.drop("knowledge_channel"), KEY)
    kept = F.col("query_type").isin("term", "bilingual")
    answers = rank.composed(rank.reranked(hits.where(~kept)).select(*hits.columns).unionByName(hits.where(kept)))

    def first(channel: str) -> Column:
        mine = F.when((F.col("channel") == channel) & (F.col("rank") <= 5), F.struct("rank", KEY))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda h: h[KEY]).alias(f"{channel}_hits")

    listed = channels.groupBy("query_id").agg(first("terminology"), first("regulation"))
    q, none = F.col("query"), F.array().cast("array<string>")
    tagged = questions.withColumns({"query_type": X.query_class(q), "risk_level": X.query_risk(q), "matched_risk_markers": X.risk_markers(q)})
    done = tagged.join(answers, "query_id", "left").join(listed, "query_id", "left")
    return done.withColumns({c: F.coalesce(c, none) for c in ("terminology_hits", "regulation_hits")})


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["build", "ask"])
    parser.add_argument("--config", required=True)
    parser.add_argument("--query", action="append", default=[])
    parser.add_argument("--top-k", type=int)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    importable(spark)
    settings = sinks.read_settings(args.config)
    if args.command == "build":
        for r in build(spark, settings).collect():
            print(f"{r.record_type}: {r.records}")
        return
    questions = spark.createDataFrame(list(enumerate(args.query, 1)), "query_id long, query string")
    answered = ask(spark, settings, questions, args.top_k).persist()
    sinks.append_log(answered, settings.paths["output_dir"] + "/qa_runs")
    for r in answered.orderBy("query_id").collect():
        print(r.answer or "", *[f"  [{c['index']}] {c.source_label} ({c.record_id}, {c.score})" for c in r.citations or []] or ["  (none)"], sep="\n")


if __name__ == "__main__":
    main()
