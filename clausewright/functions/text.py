"""Scalar text operators as column expressions; everything stays in the JVM.

Regular expressions name their white space explicitly, so that Java, RE2 and
Python agree on it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space (the set Python strips), ideographs, sentence marks.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{3400}-\x{9fff}]"
TOKEN2 = r"[A-Za-z]{2,}|[\x{3400}-\x{9fff}]{2,}"
SENTENCE_MARKS = "。！？!?;；."

# Marker lists, in the order in which they are tried or reported.
CLAUSE_HIGH = ["停电", "送电", "带电", "倒闸", "接地", "验电", "应急", "故障处置", "调度命令", "高压"]
CLAUSE_MEDIUM = ["检修", "维修", "巡视", "巡检", "试验", "操作", "异常", "排查", "流程"]
PROHIBITION = ["禁止", "不得", "严禁"]
MANDATORY = ["必须", "应", "应当"]
EMERGENCY = ["应急", "事故", "故障", "异常"]
PRECONDITION = ["前", "之前", "满足", "条件", "准备", "确认"]
PROCEDURE = ["流程", "步骤"]
STRESS = ["必须", "应当", "操作前", "应急处置"]
MENTION = ["应", "注意", "检查"]
QUERY_HIGH = ["带电", "停电", "送电", "倒闸", "验电", "接地", "高压", "应急处置", "抢修", "故障处理", "调度命令", "授权"]
QUERY_MEDIUM = ["检修", "维修", "巡视", "巡检", "试验", "操作", "异常", "告警", "故障", "排查", "步骤", "流程"]
ASK_PAPER = ["论文", "实验", "消融", "评测", "baseline", "ablation", "metric", "contribution"]
ASK_BILINGUAL = ["双语", "bilingual", "english answer", "英文回答", "中英"]
ASK_TERM = ["英文", "中文", "怎么说", "翻译", "术语", "全称", "缩写", "对应", "what does", "translate", "in chinese", "in english"]
ASK_FAULT = ["故障", "异常", "告警", "排查", "原因", "先查", "diagnose", "alarm"]
ASK_PROCEDURE = ["流程", "步骤", "巡检", "检修", "如何组织", "怎么做"]
QUESTION_MARKERS = ["什么", "哪些", "如何", "怎么", "是否", "吗", "么", "？", "?", "请问"]
TRANSLATION_ZH = ["英文怎么说", "中文怎么说", "英文", "中文", "怎么说", "翻译", "术语", "全称", "缩写", "对应"]
TRANSLATION_EN = ["what does", "what is", "mean in chinese", "mean in english", "in chinese", "in english", "translate", "meaning of", "term", "abbreviation", "full form"]
CANDIDATE_MARKERS = ["是否对应", "是否等价", "是否规范", "英文是什么", "中文是什么", "怎么说", "翻译", "对应", "term", "translate"]
CANDIDATE_SPLITS = [WS + "+and" + WS + "+", WS + "+or" + WS + "+", WS + r"+vs\.?" + WS + "+", WS + "*[与和及/]" + WS + "*", WS + "*[,，;；]" + WS + "*"]
NOISE_TITLES = ["目录", "目 录", "Purpose record"]
CATEGORIES = [
    ("通用词汇", "General vocabulary"),
    ("通 信", "Communication"),
    ("信 号", "Signaling"),
    ("机 车", "Locomotive"),
    ("车 辆", "Rolling stock"),
    ("牵引供电", "Traction power supply"),
    ("工务工程", "Permanent way"),
    ("运输与经济", "Transportation and economy"),
    ("相关科学", "Related sciences"),
]
PAIR_FORBIDDEN = ["索引", "续上表", "常用缩写", "相关国际组织名称"]
# What a line must begin with to be a heading, and lines that carry nothing.
HEADINGS = [
    ("part_zh", "^第[一二三四五六七八九十百零]+部分"),
    ("chapter_zh", "^第[一二三四五六七八九十百零]+章"),
    ("appendix_zh", "^附件" + WS + r"*\d+"),
    ("part_en", "(?i)^part" + WS + r"+[IVXLC\d]+"),
    ("chapter_en", "(?i)^chapter" + WS + r"+[IVXLC\d]+"),
    ("appendix_en", "(?i)^(attachment|appendix)" + WS + r"*\d+"),
]
NOISE = r"^[,.'`“”‘’．。()\-I \t\n\r]+$"
# A Chinese term and the English one after it in a line; a short form in round brackets.
TERM_PAIR = r"([\x{3400}-\x{9fff}][\x{3400}-\x{9fff}A-Za-z0-9（）()/\-、，,．. ]*?){ws}+([A-Za-z(][A-Za-z0-9 /;,\-().:+]*?)(?={ws}+[\x{3400}-\x{9fff}]|$)".replace("{ws}", WS)
SHORT_FORM = r"\(([^()]{2,16})\)"


def normalize(x: Column) -> Column:
    """Bullets and white space become single spaces, the ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[·•]+", " "), WS + "+", " "))


def has_cjk(x: Column) -> Column:
    """Whether an ideograph occurs."""
    return x.rlike(CJK)


def has_english(x: Column) -> Column:
    """Whether an ASCII letter occurs."""
    return x.rlike("[A-Za-z]")


def language_class(x: Column) -> Column:
    """zh, en, mixed_zh or mixed_en by counts of ideographs and letters; a text of neither is mixed_zh."""
    c, e = F.regexp_count(x, F.lit(CJK)), F.regexp_count(x, F.lit("[A-Za-z]"))
    return F.when((c > 0) & (e == 0), "zh").when((e > 0) & (c == 0), "en").when(c >= e, "mixed_zh").otherwise("mixed_en")


def split_sentences(x: Column) -> Column:
    """Pieces between white space that follows a sentence mark; empty ones are dropped."""
    parts = F.split(trim_ws(x), f"(?<=[{SENTENCE_MARKS}]){WS}+")
    return F.filter(F.transform(parts, trim_ws), lambda s: s != "")


def trim_ws(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; an expression used inside a lambda would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def characters(x: Column) -> Column:
    """Array of the code points of a text; '' gives an empty array."""
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))


def query_terms(x: Column) -> Column:
    """Bigrams of the normalised lower-case text if it has an ideograph, else its words; repeated ones stay."""
    def of(n: Column) -> Column:
        return F.when(has_cjk(n), F.filter(let(characters(n), bigrams), lambda g: F.trim(g) != "")).otherwise(F.regexp_extract_all(n, F.lit("[a-z0-9]+"), F.lit(0)))

    return let(F.lower(normalize(x)), of)


def bigrams(c: Column) -> Column:
    """Pairs of neighbours of an array of characters."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), lambda i: F.concat(F.get(c, i), F.get(c, i + 1)))
    return F.when(F.size(c) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def clean_heading_suffix(x: Column) -> Column:
    """Dot leaders with a page number, then a trailing number, are cut off; the rest is normalised."""
    return normalize(F.regexp_replace(F.regexp_replace(x, r"\.{3,}" + WS + r"*\d+$", ""), WS + r"+\d+$", ""))


def heading_kind(x: Column) -> Column:
    """Name of the first heading pattern the line begins with, or null."""
    return F.coalesce(*[F.when(x.rlike(p), F.lit(k)) for k, p in HEADINGS])


def is_noise(x: Column) -> Column:
    """Empty lines, lines of marks only and three known titles."""
    return (x == "") | x.rlike(NOISE) | x.isin(NOISE_TITLES)


def any_of(x: Column, markers: list[str]) -> Column:
    """Whether one of the markers occurs."""
    return reduce(lambda a, b: a | b, [x.contains(m) for m in markers])


def clause_risk(x: Column) -> Column:
    """high, medium or low by the markers of a clause."""
    return F.when(any_of(x, CLAUSE_HIGH), "high").when(any_of(x, CLAUSE_MEDIUM), "medium").otherwise("low")


def content_type(x: Column) -> Column:
    """The first class of a fixed cascade whose markers occur."""
    return (
        F.when(any_of(x, PROHIBITION), "restriction")
        .when(any_of(x, EMERGENCY), "emergency")
        .when(any_of(x, PRECONDITION), "precondition")
        .when(any_of(x, PROCEDURE), "procedure")
        .when(any_of(x, MANDATORY), "rule")
        .otherwise("description")
    )


def evidence_priority(x: Column) -> Column:
    """Sum of weights of the markers present: 3 for a prohibition, 2 for stress, 1 for a mention."""
    return reduce(lambda a, b: a + b, [x.contains(m).cast("int") * w for ms, w in ((PROHIBITION, 3), (STRESS, 2), (MENTION, 1)) for m in ms])


def keywords(*parts: Column, most: int = 8) -> Column:
    """First distinct words of two or more letters or ideographs over the parts in order."""
    found = [F.coalesce(F.regexp_extract_all(normalize(p), F.lit(TOKEN2), F.lit(0)), F.array().cast("array<string>")) for p in parts]
    return F.slice(F.array_distinct(F.flatten(F.array(*found))), 1, most)


def abbreviation(term: Column) -> Column:
    """What stands in the first round brackets, else the initials of two or more words, else ''."""
    words = F.regexp_extract_all(term, F.lit("[A-Za-z]+"), F.lit(0))
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(term.rlike(SHORT_FORM), trim_ws(F.regexp_extract(term, SHORT_FORM, 1))).when(F.size(words) >= 2, initials).otherwise("")


def full_form(term: Column) -> Column:
    """The term before its first short bracket, normalised."""
    before = F.regexp_extract(term, r"(?s)^(.*?)\([^()]{2,16}\)", 1)
    return normalize(F.when(term.rlike(SHORT_FORM), before).otherwise(term))


def distinct_filled(*parts: Column) -> Column:
    """Distinct non-empty values in order; null counts as empty."""
    return F.array_distinct(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda v: v != ""))


def aliases(zh: Column, en: Column, short: Column, full: Column) -> Column:
    """Distinct normalised names of a term in order."""
    return distinct_filled(*[normalize(c) for c in (zh, en, short, full)])


def compact(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(x, WS + "+", "")


def anchor_key(x: Column) -> Column:
    """Compact lower-case key under which headings of categories are compared."""
    return F.lower(compact(normalize(x)))


def term_pairs(line: Column) -> Column:
    """Array of (term_zh, term_en) found in a line, in order."""
    zh, en = (F.regexp_extract_all(line, F.lit(TERM_PAIR), F.lit(g)) for g in (1, 2))
    pairs = F.transform(F.arrays_zip(zh.alias("a"), en.alias("b")), lambda p: F.struct(normalize(p["a"]).alias("term_zh"), normalize(p["b"]).alias("term_en")))
    return F.filter(pairs, lambda p: (F.length(compact(p["term_zh"])) >= 2) & has_english(p["term_en"]))


def low_quality_pair(zh: Column, en: Column) -> Column:
    """Pairs that are too short, index remnants, articles, odd symbols or unbalanced brackets."""
    z, e = compact(zh), compact(en)
    return (
        (F.length(z) < 2)
        | (F.length(e) < 2)
        | any_of(z, PAIR_FORBIDDEN)
        | e.isin("a", "an", "the")
        | en.rlike(r"[^\p{L}\p{N}_\s/;,\-().:+]")
        | (F.regexp_count(e, F.lit(r"\(")) != F.regexp_count(e, F.lit(r"\)")))
    )


def _blank(x: Column, markers: list[str]) -> Column:
    """Markers replaced by a space one after the other; the order matters."""
    return reduce(lambda a, m: F.replace(a, F.lit(m), F.lit(" ")), markers, x)


def _strip_question(x: Column) -> Column:
    return F.regexp_replace(x, "^[ ?？]+|[ ?？]+$", "")


def translation_candidate(q: Column) -> Column:
    """What is left of a question once the words that ask for a translation are gone."""
    n = normalize(q)
    return _strip_question(normalize(F.when(has_cjk(n), _blank(n, TRANSLATION_ZH)).otherwise(_blank(F.lower(n), TRANSLATION_EN))))


def _splitter(pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.split(s, pattern)


def term_candidates(q: Column) -> Column:
    """Distinct terms a question may be about; split step by step, in order."""
    parts = F.array(_blank(F.lower(normalize(q)), CANDIDATE_MARKERS))
    for p in CANDIDATE_SPLITS:
        parts = F.flatten(F.transform(parts, _splitter(p)))
    found = F.array_distinct(F.filter(F.transform(parts, lambda s: _strip_question(normalize(s))), lambda s: s != ""))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(translation_candidate(q))))


def term_names(*names: Column, more: Column) -> Column:
    """All normalised names of a record for matching; names that differ in case stay apart."""
    rest = F.transform(F.coalesce(more, F.array().cast("array<string>")), lambda s: F.coalesce(normalize(s), F.lit("")))
    return F.array_distinct(F.filter(F.concat(F.array(*[F.coalesce(normalize(n), F.lit("")) for n in names]), rest), lambda s: s != ""))


def query_class(q: Column) -> Column:
    """Class of a question: the first list of markers that hits."""
    n = F.lower(normalize(q))
    return (
        F.when(any_of(n, ASK_PAPER), "paper")
        .when(any_of(n, ASK_BILINGUAL), "bilingual")
        .when(any_of(n, ASK_TERM), "term")
        .when(any_of(n, ASK_FAULT), "fault")
        .when(any_of(n, ASK_PROCEDURE), "procedure")
        .otherwise("regulation")
    )


def record_types(kind: Column) -> Column:
    """Record types that answer a class of question; null for all."""
    return F.when(kind == "term", F.array(F.lit("glossary_term"))).when(kind != "paper", F.array(F.lit("regulation_clause")))


def risk_markers(q: Column) -> Column:
    """Markers present in a question, the high ones first, in list order."""
    n = F.lower(normalize(q))
    return F.filter(F.array(*map(F.lit, QUERY_HIGH + QUERY_MEDIUM)), lambda m: n.contains(m))


def query_risk(q: Column) -> Column:
    """high with any high marker, medium with two medium ones, low with one, else none."""
    n = F.lower(normalize(q))
    medium = reduce(lambda a, b: a + b, [n.contains(m).cast("int") for m in QUERY_MEDIUM])
    return F.when(any_of(n, QUERY_HIGH), "high").when(medium >= 2, "medium").when(medium == 1, "low").otherwise("none")


def key_question(q: Column) -> Column:
    """The normalised lower-case question with its question words blanked (not normalised again)."""
    return _blank(F.lower(normalize(q)), QUESTION_MARKERS)


def content_terms(q: Column) -> Column:
    """Words of two or more letters or ideographs of the key question; repeated ones stay."""
    return F.transform(F.regexp_extract_all(normalize(key_question(q)), F.lit(TOKEN2), F.lit(0)), F.lower)


def occurrences(haystack: Column, needle: Column) -> Column:
    """How often a text occurs without overlap."""
    return ((F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)).cast("int")
