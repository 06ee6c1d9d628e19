"""From blocks to lines, clauses and folded glossary lines.

Input is one row per block with its source and its place in it; (source, ord)
may occur twice, so a unique ``block_id`` settles the order. Null and empty
texts give no line; sources and headings may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import text as X
from clausewright.operators import ordered

ORDER = ["ord", "block_id"]
GROUP = ["source_id"]


def lines(blocks: DataFrame) -> DataFrame:
    """(source_id, ord, block_id, line): paragraphs without heading suffixes; tables and empty lines are dropped."""
    cleaned = blocks.where("block_type = 'paragraph'").select("source_id", "ord", "block_id", X.clean_heading_suffix(F.col("text")).alias("line"))
    return cleaned.where("line <> ''")


def flat_rows(blocks: DataFrame) -> DataFrame:
    """(source_id, ord, block_id, row_no, line): each row of each table as a line."""
    rows = blocks.where("block_type = 'table'").select("source_id", "ord", "block_id", F.posexplode("cell_rows").alias("p", "cells"))
    return rows.select("source_id", "ord", "block_id", (F.col("p") + 1).alias("row_no"), F.array_join("cells", " | ").alias("line"))


def from_anchor(rows: DataFrame, anchor: Column, required: bool = True) -> DataFrame:
    """The rows of each source from the first one at which ``anchor`` holds; sources without one are dropped or kept whole."""
    first = rows.where(anchor).groupBy(*GROUP).agg(F.min(F.struct(*ORDER)).alias("_a"))
    joined = rows.join(first.withColumnRenamed("source_id", "_s"), F.col("source_id").eqNullSafe(F.col("_s")), "inner" if required else "left")
    return joined.where(F.col("_a").isNull() | (F.struct(*ORDER) >= F.col("_a"))).drop("_a", "_s")


def until_stop(rows: DataFrame, stop: Column) -> DataFrame:
    """The rows of each source before the first one at which ``stop`` holds."""
    first = rows.where(stop).groupBy(*GROUP).agg(F.min(F.struct(*ORDER)).alias("_a"))
    joined = rows.join(first.withColumnRenamed("source_id", "_s"), F.col("source_id").eqNullSafe(F.col("_s")), "left")
    return joined.where(F.col("_a").isNull() | (F.struct(*ORDER) < F.col("_a"))).drop("_a", "_s")


def with_headings(content: DataFrame) -> DataFrame:
    """Lines with kind and the part, chapter and appendix they stand under.

    A Chinese heading takes the English one of its kind in the next line; a
    part ends chapter and appendix, these don't end each other.
    """
    d = ordered.bucketed(content, GROUP, ORDER).withColumn("heading", X.heading_kind(F.col("line")))
    d = ordered.neighbour(d, GROUP, ORDER, "line", "next_line", 1)
    place = F.struct(*ORDER)

    def seen(kind: str, en: int) -> Column:
        own = F.when(F.col("next_line").rlike(X.HEADINGS[en][1]), F.col("next_line")).otherwise("")
        return F.when(F.col("heading") == kind, F.struct(place.alias("at"), F.col("line").alias("zh"), own.alias("en")))

    d = ordered.last_seen(d, GROUP, ORDER, {"_part": seen("part_zh", 3), "_chapter": seen("chapter_zh", 4), "_appendix": seen("appendix_zh", 5)})

    def under(c: str, side: str) -> Column:
        fresh = F.col("_part").isNull() | (F.col(f"{c}.at") > F.col("_part.at"))
        return F.when(F.col(c).isNotNull() & fresh, F.col(f"{c}.{side}")).otherwise("")

    out = d.withColumns({
        "section_part_zh": F.coalesce("_part.zh", F.lit("")), "section_part_en": F.coalesce("_part.en", F.lit("")),
        "section_chapter_zh": under("_chapter", "zh"), "section_chapter_en": under("_chapter", "en"),
        "appendix_zh": under("_appendix", "zh"), "appendix_en": under("_appendix", "en"),
    })
    return out.withColumn("kind", F.when(F.col("heading").isNotNull(), "H").when(X.language_class(F.col("line")).isin("zh", "mixed_zh"), "Z").otherwise("E")).drop("_part", "_chapter", "_appendix", "next_line")


_SECTION = ["section_part_zh", "section_part_en", "section_chapter_zh", "section_chapter_en", "appendix_zh", "appendix_en"]


def clauses(rows: DataFrame) -> DataFrame:
    """Clauses of lines: a run of Chinese lines and the English lines after it, numbered per source.

    Headings end a clause, English lines without a Chinese one before are
    dropped, and so are clauses that are short on both sides.
    """
    d = with_headings(rows.where(~X.is_noise(F.col("line"))))
    d = ordered.neighbour(d, GROUP, ORDER, "kind", "_prev", -1)
    starts = (F.col("kind") == "H") | ((F.col("kind") == "Z") & ~F.coalesce(F.col("_prev") == "Z", F.lit(False)))
    d = ordered.running_sum(d, GROUP, ORDER, starts.cast("long"), "island")
    item = F.struct(*ORDER, "line")

    def text(kind: str) -> Column:
        got = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))
        return X.normalize(F.array_join(F.transform(got, lambda s: s["line"]), " "))

    runs = d.groupBy("source_id", "island").agg(
        F.min(F.struct(*ORDER, "kind", *_SECTION)).alias("first"), text("Z").alias("zh_text"), text("E").alias("en_text")
    )
    keep = (F.col("first.kind") == "Z") & (F.col("zh_text") != "") & ~((F.length(X.compact(F.col("zh_text"))) < 6) & (F.length(X.compact(F.col("en_text"))) < 20))
    kept = runs.where(keep).select("source_id", F.col("first.ord").alias("ord"), F.col("first.block_id").alias("block_id"), "zh_text", "en_text", *[F.col(f"first.{c}").alias(c) for c in _SECTION])
    return ordered.running_sum(ordered.bucketed(kept, GROUP, ORDER), GROUP, ORDER, F.lit(1), "clause_index").drop("_bucket", "ord", "block_id")


def clause_records(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Clauses in the record layout; ``sources`` has (source_id, source_title, source_file)."""
    z = F.col("zh_text")
    sub = F.coalesce(F.expr("nullif(section_chapter_zh, '')"), F.col("appendix_zh"))
    s = found.join(sources.select("source_id", "source_title", "source_file"), "source_id", "left")
    path = F.concat_ws(" / ", F.expr("nullif(section_part_zh, '')"), F.when(sub != "", sub))
    s = s.withColumn("section_path", path)
    empty = F.lit("")
    return s.select(
        F.format_string("%s_clause_%04d", "source_id", "clause_index").alias("record_id"), F.lit("regulation_clause").alias("record_type"), F.lit("regulation").alias("knowledge_channel"),
        "source_id", "source_title", "source_file", *_SECTION, "section_path", F.col("clause_index").cast("int").alias("clause_index"), "zh_text", "en_text",
        *[empty.alias(c) for c in ("term_zh", "term_en", "abbreviation", "full_form")], F.array().cast("array<string>").alias("aliases"),
        *[empty.alias(c) for c in ("notes", "category_zh", "category_en")],
        X.content_type(z).alias("content_type"), X.clause_risk(z).alias("risk_level"),
        X.keywords(F.col("section_part_zh"), F.col("section_chapter_zh"), F.col("appendix_zh"), z).alias("keywords"), X.evidence_priority(z).alias("evidence_priority"),
        F.concat_ws(" > ", F.expr("nullif(source_title, '')"), F.expr("nullif(section_part_zh, '')"), F.when(sub != "", sub), F.concat(F.lit("条款 "), F.col("clause_index").cast("string"))).alias("source_label"),
        X.normalize(F.concat_ws(" ", F.coalesce("source_title", empty), "section_path", "zh_text", "en_text")).alias("retrieval_text"),
    )


def folded(rows: DataFrame) -> DataFrame:
    """Lines of each source with every line without an ideograph appended to the line before it."""
    d = ordered.bucketed(rows.where(~X.is_noise(F.col("line"))), GROUP, ORDER)
    d = ordered.running_sum(d, GROUP, ORDER, X.has_cjk(F.col("line")).cast("long"), "_n")
    # leading lines without an ideograph form one fold of their own
    got = F.array_sort(F.collect_list(F.struct(*ORDER, "line")))
    runs = d.groupBy("source_id", "_n").agg(F.min(F.struct(*ORDER)).alias("_f"), X.normalize(F.array_join(F.transform(got, lambda s: s["line"]), " ")).alias("line"))
    return runs.select("source_id", "_f.ord", "_f.block_id", "line")


def category_keys(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(key, category_zh, category_en): each anchor, the fixed ones and ``more``, under its key and under the key doubled."""
    base = spark.createDataFrame(X.CATEGORIES, "category_zh string, category_en string")
    base = base if more is None else base.unionByName(more.select("category_zh", "category_en")).distinct()
    key = X.anchor_key(F.concat("category_zh", "category_en"))
    return base.select(F.explode(F.array(key, F.concat(key, key))).alias("key"), X.normalize(F.col("category_zh")).alias("category_zh"), X.normalize(F.col("category_en")).alias("category_en"))


def with_category(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines with the category announced last before them (the first anchor's by default) and whether they announce one."""
    found = rows.join(keys, X.anchor_key(F.col("line")) == F.col("key"), "left")
    d = ordered.bucketed(found, GROUP, ORDER).withColumn("is_anchor", F.col("key").isNotNull())
    own = F.when(F.col("is_anchor"), F.struct("category_zh", "category_en"))
    d = ordered.last_seen(d.withColumn("_own", own).drop("category_zh", "category_en", "key"), GROUP, ORDER, {"_cat": F.col("_own")})
    first = X.CATEGORIES[0]
    return d.select("source_id", "ord", "block_id", "line", "is_anchor", F.coalesce("_cat.category_zh", F.lit(first[0])).alias("category_zh"), F.coalesce("_cat.category_en", F.lit(first[1])).alias("category_en"))


INDEX_MARK = r"^Z\d+汉英索引$"


def glossary_stop(line: Column) -> Column:
    """Lines at which a glossary ends: its index or an appendix."""
    return X.compact(line).rlike(INDEX_MARK) | line.contains("附件1 常用缩写") | line.contains("附件2相关国际组织名称") | line.contains("相关国际组织名称")


def glossary_start(line: Column) -> Column:
    """The line at which the body of a glossary begins."""
    return line.contains("通用词汇") & line.contains("General")


def term_records(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Terms of categorised lines in the record layout, numbered per source in order."""
    pairs = rows.where(~F.col("is_anchor")).select("source_id", "ord", "block_id", "category_zh", "category_en", F.posexplode(X.term_pairs(F.col("line"))).alias("pos", "p"))
    flat = pairs.select("source_id", "ord", "block_id", "pos", "category_zh", "category_en", "p.term_zh", "p.term_en").where(~X.low_quality_pair(F.col("term_zh"), F.col("term_en")))
    order = [*ORDER, "pos"]
    t = ordered.running_sum(ordered.bucketed(flat, GROUP, order), GROUP, order, F.lit(1), "n").drop("_bucket")
    t = t.join(sources.select("source_id", "source_title", "source_file"), "source_id", "left")
    t = t.withColumns({"abbreviation": X.abbreviation(F.col("term_en")), "full_form": X.full_form(F.col("term_en"))})
    empty = F.lit("")
    cat = F.coalesce(F.expr("nullif(category_zh, '')"), F.lit("未分类术语"))
    return t.select(
        F.format_string("%s_term_%05d", "source_id", "n").alias("record_id"), F.lit("glossary_term").alias("record_type"), F.lit("terminology").alias("knowledge_channel"),
        "source_id", "source_title", "source_file", *[empty.alias(c) for c in _SECTION], F.col("category_zh").alias("section_path"), F.lit(None).cast("int").alias("clause_index"),
        F.col("term_zh").alias("zh_text"), F.col("term_en").alias("en_text"), "term_zh", "term_en", "abbreviation", "full_form",
        X.aliases(F.col("term_zh"), F.col("term_en"), F.col("abbreviation"), F.col("full_form")).alias("aliases"),
        F.concat(F.lit("标准术语，类别为"), F.col("category_zh"), F.lit("。")).alias("notes"), "category_zh", "category_en", F.lit("definition").alias("content_type"), F.lit("low").alias("risk_level"),
        X.keywords(F.col("category_zh"), F.col("term_zh"), F.col("term_en"), F.col("abbreviation"), F.col("full_form")).alias("keywords"), F.lit(1).alias("evidence_priority"),
        F.concat_ws(" > ", F.expr("nullif(source_title, '')"), cat, F.concat(F.lit("术语 "), F.col("n").cast("string"))).alias("source_label"),
        X.normalize(F.concat_ws(" ", F.coalesce("source_title", empty), "category_zh", "category_en", "term_zh", "term_en", "abbreviation", "full_form")).alias("retrieval_text"),
    )
