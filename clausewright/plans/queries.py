"""Query catalogue of the core: the engine's own operators over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import text as X
from clausewright.operators import evaluate, index, ordered, packed, rank, retrieve, scan, segment
from clausewright.plans.lineage import cut
from clausewright.sources import docx
from clausewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_KEY = "record_key"


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every term_en with its place."""
    return packed.separated(table(spark, d, "glossary_term"), "row_id", "term_en")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of fields that hold two or more."""
    return p6_values(spark, d).where("values > 1").select("row_id", "value_pos")


def q01_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("normalized"))


def q02_classify_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.has_cjk(t).alias("has_cjk"), X.has_english(t).alias("has_english"), X.language_class(t).alias("lang_class"))


def q03_lines_noise(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").where("block_type = 'paragraph'")
    return b.select("block_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("block_id", "pos", "line", X.is_noise(F.col("line")).alias("noise"))


def q04_split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence"))


def q05_query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", F.array_join(X.query_terms(F.col("query")), "|").alias("terms"))


def q06_heading_kind(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "regulation_clause")
    parts = F.explode(F.array("section_part_zh", "section_part_en", "section_chapter_zh", "section_chapter_en", "appendix_zh", "appendix_en"))
    return r.select(parts.alias("heading")).where("heading <> ''").groupBy("heading").agg(F.count(F.lit(1)).alias("n")).select("heading", X.heading_kind(F.col("heading")).alias("kind"), "n")


def q07_suffix_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").select("block_id", X.clean_heading_suffix(F.col("text")).alias("line"))


def _block_stream(spark: SparkSession, d: str) -> DataFrame:
    """Blocks under the headings their clauses are filed under: the headings of each source as paragraphs before its blocks."""
    b = table(spark, d, "blocks").select("block_id", "source_id", "ord", "block_type", "text")
    r = table(spark, d, "regulation_clause").where("source_id is not null and section_part_zh <> ''")
    h = r.groupBy("source_id").agg(F.min(F.struct("section_part_zh", "section_part_en")).alias("h"))
    tops = h.select("source_id", F.posexplode(F.array(F.col("h.section_part_zh"), F.coalesce("h.section_part_en", F.lit("")))).alias("p", "text")).where("text <> ''")
    heads = tops.select((F.col("p") - 2).cast("long").alias("block_id"), "source_id", (F.col("p") - 2).cast("long").alias("ord"), F.lit("paragraph").alias("block_type"), "text")
    return heads.unionByName(b)


def q08_clause_segment(spark: SparkSession, d: str) -> DataFrame:
    found = segment.clauses(segment.lines(_block_stream(spark, d)))
    return found.select("source_id", "clause_index", "zh_text", "en_text", "section_part_zh", "section_part_en", "section_chapter_zh", "appendix_zh")


def q09_clause_enrich(spark: SparkSession, d: str) -> DataFrame:
    z = F.coalesce("zh_text", F.lit(""))
    words = X.keywords(F.col("section_part_zh"), F.col("section_chapter_zh"), F.col("appendix_zh"), z)
    return table(spark, d, "regulation_clause").select(
        "row_id", X.clause_risk(z).alias("risk"), X.content_type(z).alias("kind"), X.evidence_priority(z).alias("priority"), F.array_join(words, "|").alias("words")
    )


def q10_start_stop(spark: SparkSession, d: str) -> DataFrame:
    lines = segment.lines(table(spark, d, "blocks"))
    kept = segment.until_stop(segment.from_anchor(lines, F.col("line").contains("力矩"), required=False), F.col("line").contains("Fig."))
    return kept.select("source_id", "ord", "block_id", "line")


def q11_line_fold(spark: SparkSession, d: str) -> DataFrame:
    return segment.folded(segment.lines(table(spark, d, "blocks"))).select("source_id", "ord", "block_id", "line")


def q12_term_pairs(spark: SparkSession, d: str) -> DataFrame:
    line = X.normalize(F.concat_ws(" ", "term_zh", "term_en"))
    pairs = table(spark, d, "glossary_term").select("row_id", F.posexplode(X.term_pairs(line)).alias("pos", "p"))
    return pairs.select("row_id", "pos", "p.term_zh", "p.term_en", X.low_quality_pair(F.col("p.term_zh"), F.col("p.term_en")).alias("low_quality"))


def q13_abbrev_aliases(spark: SparkSession, d: str) -> DataFrame:
    en = F.coalesce("term_en", F.lit(""))
    g = table(spark, d, "glossary_term").select("row_id", "term_zh", "term_en", X.abbreviation(en).alias("short"), X.full_form(en).alias("full"))
    return g.select("row_id", "short", "full", F.array_join(X.aliases(F.col("term_zh"), F.col("term_en"), F.col("short"), F.col("full")), "|").alias("names"))


def q14_category_carry(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "glossary_term")
    keys = segment.category_keys(spark, g.where("category_zh <> ''").select("category_zh", F.coalesce("category_en", F.lit("")).alias("category_en")).distinct())
    both = F.posexplode(F.array(F.concat_ws(" ", "category_zh", "category_en"), F.coalesce("term_zh", F.lit(""))))
    rows = g.select("source_id", "row_id", both.alias("pos", "line")).select("source_id", F.col("row_id").alias("ord"), (F.col("row_id") * 2 + F.col("pos")).alias("block_id"), "line")
    return segment.with_category(rows, keys).select("block_id", "is_anchor", "category_zh", "category_en")


def q15_records_union(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "regulation_clause").unionByName(table(spark, d, "glossary_term"))
    return both.groupBy("record_type", "knowledge_channel").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("record_id").alias("different"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both record tables under one numeric key; a record delivered again is a row like any other."""
    parts = [table(spark, d, name).withColumn(_KEY, F.col("row_id") * 10 + base) for name, base in (("regulation_clause", 1), ("glossary_term", 2))]
    return parts[0].unionByName(parts[1])


def _state(spark: SparkSession, d: str, names: tuple[str, ...]) -> tuple:
    """Folder and files of tables with their sizes and times, so that a changed table is another one."""
    found = []
    for name in names:
        for f in sorted(table(spark, d, name).inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            found.append((f, status.getLen(), status.getModificationTime()))
    return (d, *found)


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index of all records, written to the shared folder once a session for each state of the tables."""
    built = spark.__dict__.setdefault("_clausewright_index", {})
    state = _state(spark, d, ("regulation_clause", "glossary_term"))
    if state not in built:
        # the last one only: an index is as large as its tables
        built.clear()
        records = _records(spark, d)
        postings, idf = index.build(records, _KEY, "retrieval_text", ["record_type"])
        built[state] = cut(postings, placed=True), idf, records
    return built[state]


def _finder(spark: SparkSession, d: str) -> index.Finder:
    """Search of all records where they are read; gram counts are made once a session for each state of the tables."""
    counted = spark.__dict__.setdefault("_clausewright_grams", {})
    state = _state(spark, d, ("regulation_clause", "glossary_term"))
    records = _records(spark, d)
    if state not in counted:
        counted.clear()
        counted[state] = cut(scan.frequencies(records, "retrieval_text")), records.count()

    def by_index(sets: list[DataFrame], top: int, types: list[str]) -> list[DataFrame]:
        p, idf, _ = _index(spark, d)
        return index.finder(p, idf, _KEY)(sets, top, types)

    return scan.finder(records, *counted[state], _KEY, "retrieval_text", by_index)


def q16_tf(spark: SparkSession, d: str) -> DataFrame:
    tf = index.term_frequency(_records(spark, d), _KEY, "retrieval_text")
    return tf.groupBy(_KEY).agg(F.count(F.lit(1)).alias("grams"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


def q17_df_idf(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    idf = index.inverse_frequency(index.term_frequency(records, _KEY, "retrieval_text"), records.count())
    return idf.select("gram", "df", F.round("idf", 6).alias("idf"))


def q18_postings_norm(spark: SparkSession, d: str) -> DataFrame:
    p = _index(spark, d)[0]
    return p.groupBy(_KEY).agg(F.count(F.lit(1)).alias("grams"), F.round(F.sum(F.col("w") * F.col("w")), 4).alias("length"), F.round(F.max("w"), 4).alias("heaviest"))


def q19_search_topk(spark: SparkSession, d: str) -> DataFrame:
    p, idf, _ = _index(spark, d)
    hits = index.search(table(spark, d, "queries"), p, idf, _KEY)
    return hits.select("query_id", _KEY, F.round("score", 4).alias("score"), "rank")


def q20_search_type_filter(spark: SparkSession, d: str) -> DataFrame:
    p, idf, _ = _index(spark, d)
    hits = index.search(table(spark, d, "queries"), p, idf, _KEY, types=["regulation_clause"], top=3)
    return hits.select("query_id", _KEY, F.round("score", 4).alias("score"), "rank")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("record_type = 'glossary_term'")


def q21_dictionary_search(spark: SparkSession, d: str) -> DataFrame:
    """Best terms of every question, by the index where the dictionary has none."""
    p, idf, _ = _index(spark, d)
    return retrieve.dictionary_search(table(spark, d, "queries"), _terms(spark, d), _KEY, p, idf)


def q22_expand_query(spark: SparkSession, d: str) -> DataFrame:
    p, idf, _ = _index(spark, d)
    q, terms = table(spark, d, "queries"), _terms(spark, d)
    return retrieve.expanded(q, retrieve.dictionary_search(q, terms, _KEY, p, idf, top=3), terms, _KEY)


def q23_regulation_search(spark: SparkSession, d: str) -> DataFrame:
    find = _finder(spark, d)
    q, terms = table(spark, d, "queries"), _terms(spark, d)
    wide = retrieve.expanded(q, retrieve.dictionary_search(q, terms, _KEY, top=3, find=find), terms, _KEY)
    found = retrieve.traced(retrieve.regulation_search(q, wide, None, None, _KEY, find=find), _records(spark, d), _KEY)
    t = F.col("retrieval_trace")
    said = rank.trace(t["channel"], t["content_type"], t["risk_level"], t["evidence_priority"])
    return found.select("query_id", _KEY, "score", "origin", t["matched_query"].alias("matched_query"), said.alias("trace"), "rank")


def q24_dual_channel(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries")
    channels = retrieve.dual_channel(q, _terms(spark, d), None, None, _KEY, find=_finder(spark, d))
    return retrieve.chosen_channel(q, channels).select("query_id", "query_type", "channel", _KEY, "score", "rank")


def q25_classify_query(spark: SparkSession, d: str) -> DataFrame:
    kind = X.query_class(F.col("query"))
    return table(spark, d, "qa_log").select("log_id", kind.alias("asked_type"), F.array_join(X.record_types(kind), "|").alias("types"))


def q26_risk_check(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return table(spark, d, "qa_log").select("log_id", X.query_risk(q).alias("risk"), F.array_join(X.risk_markers(q), "|").alias("markers"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    p, idf, records = _index(spark, d)
    q = table(spark, d, "queries")
    found = index.search(q, p, idf, _KEY, top=10)
    columns = ["record_id", "record_type", "section_path", "zh_text", "en_text", "term_zh", "term_en", "category_zh", "evidence_priority", "risk_level", "content_type", "source_label"]
    return found.join(q, "query_id").join(records.select(_KEY, *columns), _KEY).withColumn("score", F.round("score", 6))


def q27_rerank(spark: SparkSession, d: str) -> DataFrame:
    return rank.reranked(_hits(spark, d)).select("query_id", _KEY, "input_rank", "combined", "rank")


def q28_snippet(spark: SparkSession, d: str) -> DataFrame:
    body = F.coalesce(F.expr("nullif(zh_text, '')"), F.col("en_text"), F.lit(""))
    return _hits(spark, d).where("rank <= 3").select("query_id", _KEY, rank.best_snippet(F.col("query"), body).alias("snippet"))


def q30_glossary_select(spark: SparkSession, d: str) -> DataFrame:
    return rank.glossary_choice(_hits(spark, d)).select("query_id", _KEY, "choice_score")


def q31_citations(spark: SparkSession, d: str) -> DataFrame:
    cited = rank.citations(rank.reranked(_hits(spark, d), top=3))
    return cited.select("query_id", F.size("citations").alias("cited"), F.array_join(F.col("citations.record_id"), "|").alias("record_ids"))


def q32_answers(spark: SparkSession, d: str) -> DataFrame:
    got = rank.composed(rank.reranked(_hits(spark, d), top=3))
    return got.select("query_id", "answer", F.size("citations").alias("cited"))


def q37_qa_log(spark: SparkSession, d: str) -> DataFrame:
    """Log entries once each with what they cite, the first delivery winning."""
    log = table(spark, d, "qa_log")
    first = log.groupBy("query_id", "asked_at", "query_type", "risk_level").agg(F.min_by(F.struct("log_id", "citations"), "log_id").alias("f"), F.count(F.lit(1)).alias("deliveries"))
    return first.select("f.log_id", "query_id", "deliveries", F.coalesce(F.size("f.citations"), F.lit(0)).alias("cited"))


def q38_docx_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every block written into a document of its own and read again."""
    found = docx.parsed(docx.written(table(spark, d, "blocks"), "block_id"))
    return found.select(F.col("path").cast("long").alias("block_id"), "block_type", "text", F.transform("cell_rows", lambda r: F.array_join(r, "¦")).alias("rows")).withColumn("rows", F.array_join("rows", "‖"))


def q39_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of held-out items as questions; relevant are the records that share the item's terms most."""
    p, idf, records = _index(spark, d)
    items = table(spark, d, "qa_samples").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"), "terminology_tags")
    hits = index.search(items, p, idf, _KEY, top=10)
    tags = items.select("query_id", F.explode("terminology_tags").alias("tag"))
    named = records.where("record_type = 'regulation_clause'").select(_KEY, "section_chapter_zh").where("section_chapter_zh <> ''")
    chapter = named.withColumn("tag", F.regexp_extract("section_chapter_zh", "^第[^章]+章 (.+)$", 1))
    relevant = chapter.join(tags, "tag").select("query_id", _KEY).distinct()
    got = evaluate.retrieval(hits, relevant, "query_id", _KEY, top=10)
    return got.select("query_id", "relevant", "found", *[F.round(c, 4).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


def q40_text_match(spark: SparkSession, d: str) -> DataFrame:
    a, g = F.col("evidence"), F.col("answer_gold")
    return table(spark, d, "qa_samples").select("item_id", evaluate.exact_match(a, g).alias("em"), F.round(evaluate.token_f1(a, g), 4).alias("f1"))


def q41_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.rouge_l(table(spark, d, "qa_samples"), "item_id", "evidence", "answer_gold")
    return got.select("item_id", F.round("rouge_l", 4).alias("rouge_l"))


def q42_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return segment.flat_rows(table(spark, d, "blocks")).select("block_id", "row_no", "line")


def q43_clause_records(spark: SparkSession, d: str) -> DataFrame:
    found = segment.clause_records(segment.clauses(segment.lines(_block_stream(spark, d))), table(spark, d, "source_registry"))
    return found.select("record_id", "source_label", "content_type", "risk_level", "evidence_priority", F.array_join("keywords", "|").alias("words"), "retrieval_text")


def q44_next_line(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.bucketed(segment.lines(table(spark, d, "blocks")), segment.GROUP, segment.ORDER)
    return ordered.neighbour(rows, segment.GROUP, segment.ORDER, "line", "next_line", 1).select("block_id", "next_line")


def _glossary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Terms as the lines they stood in: category headings as (source, place) asks, then both names on one line."""
    g = table(spark, d, "glossary_term")
    both = F.posexplode(F.array(F.concat_ws(" ", "category_zh", "category_en"), F.concat_ws(" ", "term_zh", "term_en")))
    rows = g.select("source_id", "row_id", both.alias("pos", "line"))
    return rows.select("source_id", F.col("row_id").alias("ord"), (F.col("row_id") * 2 + F.col("pos")).alias("block_id"), X.normalize(F.col("line")).alias("line"))


def q46_term_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the terms found in categorised lines."""
    g = table(spark, d, "glossary_term")
    keys = segment.category_keys(spark, g.where("category_zh <> ''").select("category_zh", F.coalesce("category_en", F.lit("")).alias("category_en")).distinct())
    found = segment.term_records(segment.with_category(_glossary_lines(spark, d), keys), table(spark, d, "source_registry"))
    return found.select("record_id", "term_zh", "term_en", "abbreviation", "full_form", F.array_join("aliases", "|").alias("names"), "category_zh", "source_label", F.array_join("keywords", "|").alias("words"), "retrieval_text")


def q47_all_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each source under all its part, chapter and appendix headings, each before the blocks of its share."""
    r = table(spark, d, "regulation_clause").where("source_id is not null")
    names = [("section_part_zh", "section_part_en", 0), ("section_chapter_zh", "section_chapter_en", 1), ("appendix_zh", "appendix_en", 2)]
    heads = None
    for zh, en, level in names:
        one = r.where(f"{zh} <> ''").groupBy("source_id", zh).agg(F.max(F.coalesce(en, F.lit(""))).alias("en"), F.min("row_id").alias("at"))
        one = one.select("source_id", "at", F.lit(level).alias("level"), F.posexplode(F.array(F.col(zh), "en")).alias("pos", "text")).where("text <> ''")
        heads = one if heads is None else heads.unionByName(one)
    place = heads.select("source_id", F.col("at").alias("ord"), (F.col("level") * 2 + F.col("pos")).cast("long").alias("block_id"), F.lit("paragraph").alias("block_type"), "text")
    clauses = r.where("zh_text <> ''").select("source_id", F.col("row_id").alias("ord"), F.lit(6).cast("long").alias("block_id"), F.lit("paragraph").alias("block_type"), F.col("zh_text").alias("text"))
    found = segment.with_headings(segment.lines(place.unionByName(clauses)))
    return found.select("source_id", "ord", "block_id", "kind", *segment._SECTION)


def q45_translation_candidate(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return table(spark, d, "qa_log").select("log_id", X.translation_candidate(q).alias("candidate"), F.array_join(X.term_candidates(q), "|").alias("candidates"))


def queries() -> dict[str, Query]:
    """Every query of the core by name."""
    here = globals()
    return {k: here[k] for k in sorted(here) if k[0] in "pq" and k[1:2].isdigit()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Both channels for every question: dictionary, expansion, index search and choice of channel."""
    return q24_dual_channel(spark, d)
