"""Queries pN_... over the tables of a data folder; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import align, canon, copies, langid, leaks, mixing, sentences, split
from clausewright.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"  # where the queries find a public tokenizer
Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Values above their limit, as the splitter cut them."""
    return p1_pieces(spark, d).where("piece_no = 2").select("field_name", "row_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized value."""
    big = split.oversized(table(spark, d, "regulation_clause"), table(spark, d, "chunk_limits"), ["zh_text", "retrieval_text"])
    return split.split_oversized(big)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each member of a group of copies with the group's smallest row id."""
    return copies.members(table(spark, d, "glossary_term"), "row_id", "term_zh", "term_en").where("first_row_id <> copy_row_id")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record per group with its representative's fields and the number of copies."""
    terms = table(spark, d, "glossary_term")
    groups = copies.collapsed(copies.members(terms, "row_id", "term_zh", "term_en"))
    return groups.join(terms.select(F.col("row_id").alias("first_row_id"), "record_id", "term_zh", "term_en"), "first_row_id")


def _canon_values(spark: SparkSession, d: str) -> DataFrame:
    terms, clauses = table(spark, d, "glossary_term"), table(spark, d, "regulation_clause")

    def long(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
        return df.select(F.lit(name).alias("table_name"), "row_id", each.alias("v")).select("table_name", "v.field_name", "row_id", "v.value")

    return long(terms, "glossary_term", ["term_zh", "term_en"]).unionByName(long(clauses, "regulation_clause", ["zh_text"]))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Each value in its consistent form."""
    return canon.canonical(_canon_values(spark, d), ["table_name", "field_name", "row_id"], "value").select("table_name", "field_name", "row_id", F.col("canon").alias("value"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that hold a stand-in or invisible character."""
    done = canon.canonical(_canon_values(spark, d), ["table_name", "field_name", "row_id"], "value")
    return done.where(canon.differs(F.col("value"), F.col("canon"))).select("table_name", "field_name", "row_id")


def _clause_fields(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("zh_text", "en_text")]))
    return table(spark, d, "regulation_clause").select("row_id", each.alias("v")).select("v.field_name", "row_id", "v.text")


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its number and place."""
    fields = _clause_fields(spark, d)
    return sentences.sentence_ends(fields, ["field_name", "row_id"], "text", sentences.train(fields, "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The end of every sentence."""
    return p3_sentences(spark, d).select("field_name", "row_id", "end_pos")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that render each other, with a score."""
    clauses = table(spark, d, "regulation_clause")
    sides = align.prepared(clauses, "row_id", "zh_text", "en_text", sentences.train(_clause_fields(spark, d), "text"))
    return align.aligned(sides, "row_id", align.train(sides))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of sentences that render each other."""
    return p4_pairs(spark, d).select("row_id", "zh_sent", "en_sent")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a window of an item within one edit, and the longest exact run."""
    fields = ["question", "answer_gold", "evidence"]
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "qa_samples"), "doc_id", "text", "item_id", fields)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an exact run of an item, of the length that counts."""
    return p7_leaks(spark, d).where("run >= `window`").select("doc_id", "item_id").distinct()


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    targets = table(spark, d, "mix_targets")
    return mixing.plan(mixing.sized(table(spark, d, "documents"), targets, "doc_id", "text", "source", TOKENIZER), targets)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(*_mix(spark, d))


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    """Rate and copies of each document."""
    return _mix(spark, d)[0]


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's segments with language and confidence."""
    docs = table(spark, d, "documents")
    boundaries = sentences.train(docs, "text")
    return langid.segments(docs, "text", "lang", "doc_id", boundaries, langid.train(docs, "text", "lang", "doc_id", boundaries))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The segments of documents with a missing or wrong label or several languages."""
    return langid.mislabelled(p9_segments(spark, d)).select("doc_id", "seg_no", "seg_lang")


def queries() -> dict[str, Query]:
    """All pN_ queries of this package."""
    here = globals()
    return {k: here[k] for k in sorted(here) if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Twins of those queries that SQL can express on whole tables."""
    return {
        "p1_found": """
            select f.field_name, f.row_id from (
              select 'zh_text' as field_name, row_id, zh_text as t from regulation_clause
              union all select 'retrieval_text', row_id, retrieval_text from regulation_clause) f
            join chunk_limits l using (field_name) where length(f.t) > l.max_chars""",
    }
