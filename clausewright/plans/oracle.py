"""DuckDB twins of the core queries, stated independently of the engine."""

from __future__ import annotations

# Fixed values, written out here once more so that a wrong one in the engine shows.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{3400}-\x{9fff}]"
TOKEN2 = r"[A-Za-z]{2,}|[\x{3400}-\x{9fff}]{2,}"
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
CANDIDATE_SPLITS = [r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+and[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+or[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+vs\.?[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*[与和及/][\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*", r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*[,，;；][\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"]
NOISE_TITLES = ["目录", "目 录", "Purpose record"]
PAIR_FORBIDDEN = ["索引", "续上表", "常用缩写", "相关国际组织名称"]
CATEGORIES = [(r"通用词汇", r"General vocabulary"), (r"通 信", r"Communication"), (r"信 号", r"Signaling"), (r"机 车", r"Locomotive"), (r"车 辆", r"Rolling stock"), (r"牵引供电", r"Traction power supply"), (r"工务工程", r"Permanent way"), (r"运输与经济", r"Transportation and economy"), (r"相关科学", r"Related sciences")]
HEADINGS = [(r"part_zh", r"^第[一二三四五六七八九十百零]+部分"), (r"chapter_zh", r"^第[一二三四五六七八九十百零]+章"), (r"appendix_zh", r"^附件[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\d+"), (r"part_en", r"(?i)^part[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+[IVXLC\d]+"), (r"chapter_en", r"(?i)^chapter[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+[IVXLC\d]+"), (r"appendix_en", r"(?i)^(attachment|appendix)[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\d+")]
NOISE = r"^[,.'`“”‘’．。()\-I \t\n\r]+$"


def q(s: str) -> str:
    """A text as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[·•]+', ' ', 'g'), {q(WS + '+')}, ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace({x}, {q(WS + '+')}, '', 'g')"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def lang(x: str) -> str:
    c, e = count(x, CJK), count(x, "[A-Za-z]")
    return f"case when {c} > 0 and {e} = 0 then 'zh' when {e} > 0 and {c} = 0 then 'en' when {c} >= {e} then 'mixed_zh' else 'mixed_en' end"


def hit(x: str, markers: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(m)})" for m in markers) + ")"


def sums(x: str, markers: list[str], w: int = 1) -> str:
    return " + ".join(f"{w} * contains({x}, {q(m)})::int" for m in markers)


def clean(x: str) -> str:
    a = f"regexp_replace({x}, {q(chr(92) + '.{3,}' + WS + '*' + chr(92) + 'd+$')}, '')"
    return norm(f"regexp_replace({a}, {q(WS + '+' + chr(92) + 'd+$')}, '')")


def noise(x: str) -> str:
    return f"({x} = '' or regexp_matches({x}, {q(NOISE)}) or {x} in ({', '.join(map(q, NOISE_TITLES))}))"


def heading(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, {q(p)}) then {q(k)}" for k, p in HEADINGS) + " end"


def initials(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+'), lambda w: upper(w[1])), '')"


_SHORT = r"\(([^()]{2,16})\)"


def abbreviation(x: str) -> str:
    return f"case when regexp_matches({x}, {q(_SHORT)}) then {trim_ws(f'regexp_extract({x}, {q(_SHORT)}, 1)')} when len(regexp_extract_all({x}, '[A-Za-z]+')) >= 2 then {initials(x)} else '' end"


def full_form(x: str) -> str:
    before = f"regexp_extract({x}, {q('(?s)^(.*?)' + chr(92) + '([^()]{2,16}' + chr(92) + ')')}, 1)"
    return norm(f"case when regexp_matches({x}, {q(_SHORT)}) then {before} else {x} end")


def ordered_distinct(x: str) -> str:
    """First occurrence of each value of a list."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def keywords(parts: list[str]) -> str:
    found = " || ".join(f"regexp_extract_all({norm(f'''coalesce({p}, '')''')}, {q(TOKEN2)})" for p in parts)
    return f"list_slice({ordered_distinct(f'({found})')}, 1, 8)"


def blank(x: str, markers: list[str]) -> str:
    for m in markers:
        x = f"replace({x}, {q(m)}, ' ')"
    return x


def strip_question(x: str) -> str:
    return f"regexp_replace({x}, '^[ ?？]+|[ ?？]+$', '', 'g')"


def candidate(x: str) -> str:
    n = norm(x)
    return strip_question(norm(f"case when regexp_matches({n}, {q(CJK)}) then {blank(n, TRANSLATION_ZH)} else {blank(f'lower({n})', TRANSLATION_EN)} end"))


def candidates(x: str) -> str:
    parts = f"[{blank(f'lower({norm(x)})', CANDIDATE_MARKERS)}]"
    for p in CANDIDATE_SPLITS:
        parts = f"flatten(list_transform({parts}, lambda s: regexp_split_to_array(s, {q(p)})))"
    got = f"list_filter(list_transform({parts}, lambda s: {strip_question(norm('s'))}), lambda s: s <> '')"
    return got


def terms(x: str) -> str:
    n = f"lower({norm(x)})"
    grams = f"list_filter(list_transform(range(1, greatest(length({n}), 1)), lambda i: substring({n}, i, 2)), lambda g: trim(g) <> '')"
    return f"case when regexp_matches({n}, {q(CJK)}) then {grams} else regexp_extract_all({n}, '[a-z0-9]+') end"


LINES = f"lines as (select source_id, ord, block_id, {clean('text')} as line from blocks where block_type = 'paragraph')"

_COLUMNS = "record_id, record_type, retrieval_text, section_chapter_zh, section_path, zh_text, en_text, term_zh, term_en, abbreviation, full_form, aliases, category_zh, evidence_priority, risk_level, content_type, source_label"
RECORDS = f"""
records as (
  select row_id * 10 + 1 as record_key, {_COLUMNS} from regulation_clause
  union all
  select row_id * 10 + 2, {_COLUMNS} from glossary_term)"""


def grams(source: str, key: str, text: str, name: str) -> str:
    """CTEs that count the n-grams of a table."""
    t = f"regexp_replace(lower(coalesce({text}, '')), {q(WS + '{2,}')}, ' ', 'g')"
    return f"""
{name}_text as (select {key}, {t} as t from {source}),
{name}_gram as (select {key}, unnest(list_transform(range(1, length(t) - n + 2), lambda i: substring(t, i, n))) as gram from {name}_text, (values (2), (3), (4)) v(n) where length(t) >= n),
{name} as (select {key}, gram, count(*) as tf from {name}_gram group by all)"""


INDEX = (
    RECORDS
    + ","
    + grams("records", "record_key", "retrieval_text", "tf")
    + """,
idf as (select gram, count(*) as df, ln((1.0 + (select count(*) from records)) / (1.0 + count(*))) + 1 as idf from tf group by gram),
raw as (select record_key, gram, (1 + ln(tf)) * idf as w from tf join idf using (gram)),
postings as (select record_key, gram, w / sqrt(sum(w * w) over (partition by record_key)) as w from raw)"""
)

def search(source: str, name: str) -> str:
    """CTEs that score every record for each query of a table; the last one is ``{name}_scored``."""
    return (
        ","
        + grams(source, "query_id", "query", f"{name}_tf")
        + f""",
{name}_raw as (select query_id, gram, (1 + ln(tf)) * idf as w from {name}_tf join idf using (gram)),
{name}_vec as (select query_id, gram, w / sqrt(sum(w * w) over (partition by query_id)) as qw from {name}_raw),
{name}_scored as (select query_id, record_key, sum(qw * w) as score from {name}_vec join postings using (gram) group by all)"""
    )


SEARCH = search("queries", "q")


def ranked(scored: str, k: int, kind: int = 0) -> str:
    """The best k records of each query, of one kind if given."""
    only = f"where record_key % 10 = {kind}" if kind else ""
    return f"select query_id, record_key, score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, record_key desc) as rank from {scored} {only}) where rank <= {k}"


def top(scored: str, k: int, extra: str = "") -> str:
    return f"select query_id, record_key, round(score, 4) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, record_key desc) as rank from {scored} {extra}) where rank <= {k}"


def dictionary() -> str:
    """CTEs of dictionary matches; the last one is ``dict_scored``, ``dict_names`` has the names of each term."""
    listed = f"list_concat([{', '.join(norm(f"""coalesce({c}, '')""") for c in ('term_zh', 'term_en', 'abbreviation', 'full_form', 'zh_text', 'en_text'))}], list_transform(coalesce(aliases, []), lambda s: {norm('s')}))"
    return f""",
dict_c as (select distinct query_id, unnest(case when len({candidates('query')}) > 0 then {candidates('query')} else [{candidate('query')}] end) as c from queries),
dict_t as (select record_key, term_en, coalesce(category_zh, '') as cat, {listed} as l0 from records where record_type = 'glossary_term'),
dict_names as (select record_key, cat, coalesce(term_en, '') as en, {ordered_distinct("list_filter(l0, lambda v: v <> '')")} as l from dict_t),
dict_a as (select record_key, unnest(list_transform(l, lambda v: lower(v))) as a from dict_names),
dict_m as (select query_id, record_key, sum((a = c)::int) as exact, count(*) as contained from dict_c, dict_a where c <> '' and (contains(a, c) or contains(c, a)) group by all),
dict_scored as (select query_id, record_key, round(case when exact > 0 then 10.0 else 8.0 end + exact * 2.0 + contained * 0.5 + case when cat <> '' and cat <> '通用词汇' then 0.5 else 0 end
  - 0.01 * (length(coalesce(l[1], '')) + length(coalesce(l[2], ''))), 6)::double as score from dict_m join dict_names using (record_key))"""


def found(k: int) -> str:
    """CTE ``found``: the best k terms of each query, by the index where the dictionary has none."""
    return f""",
found_d as (select query_id, record_key, score, rank from (select *, row_number() over (partition by query_id order by score desc, record_key) as rank from dict_scored) where rank <= {k}),
found as (select * from found_d union all select query_id, record_key, round(score, 6), rank from ({ranked('q_scored', k, 2)}) where query_id not in (select query_id from found_d))"""


def wide() -> str:
    """CTE ``wide``: each query followed by the names of its three best terms."""
    own = f"lower({norm('query')})"
    return f""",
wide_e as (select query_id, flatten(list(list_concat(l, [{norm(abbreviation('en'))}, {full_form('en')}]) order by rank)) as more from found join dict_names using (record_key) where rank <= 3 group by query_id),
wide_l as (select query_id, query, coalesce(more, []) as more, list_transform(coalesce(more, []), lambda v: lower(v)) as low from queries left join wide_e using (query_id)),
wide as (select query_id, array_to_string(list_concat([query], list_filter(more, lambda v, i: v <> '' and lower(v) <> {own} and list_position(low, lower(v)) = i)), ' ') as query from wide_l)"""


def regulation() -> str:
    """CTE ``reg``: clauses for the expanded queries, then those only the raw ones find."""
    return (
        search("wide", "w")
        + f""",
reg_w as ({ranked('w_scored', 20, 1)}), reg_q as ({ranked('q_scored', 20, 1)}),
reg_b as (select *, 'expanded' as origin from reg_w union all select query_id, record_key, score, rank + 20, 'raw' from reg_q anti join reg_w using (query_id, record_key)),
reg as (select query_id, record_key, round(score, 6) as score, origin, row_number() over (partition by query_id order by rank) as rank from reg_b)"""
    )


def asked(n: str) -> str:
    """Class of a question."""
    return (
        f"case when {hit(n, ASK_PAPER)} then 'paper' when {hit(n, ASK_BILINGUAL)} then 'bilingual' when {hit(n, ASK_TERM)} then 'term' "
        f"when {hit(n, ASK_FAULT)} then 'fault' when {hit(n, ASK_PROCEDURE)} then 'procedure' else 'regulation' end"
    )


def sentences(x: str) -> str:
    """Sentences of a text as a list."""
    marks = "[。！？!?;；.]"
    return f"list_filter(list_transform(string_split(regexp_replace({trim_ws(x)}, {q('(' + marks + ')' + WS + '+')}, {q(chr(92) + '1' + chr(1))}, 'g'), chr(1)), lambda s: {trim_ws('s')}), lambda s: s <> '')"


def often(text: str, terms: str) -> str:
    """How often the terms of a list occur in a text altogether."""
    return f"coalesce(list_sum(list_transform({terms}, lambda t: (length({text}) - length(replace({text}, t, ''))) // length(t))), 0)"


HITS = f""",
hits as (select query_id, query, record_key, round(s.score, 6) as score, rank as input_rank, {_COLUMNS} from ({ranked('q_scored', 10)}) s join queries using (query_id) join records using (record_key)),
asked_t as (select *, {terms('query')} as ts, {blank(f"lower({norm('query')})", QUESTION_MARKERS)} as kq, lower({norm("concat_ws(' ', coalesce(section_path, ''), coalesce(zh_text, ''), coalesce(en_text, ''), coalesce(term_zh, ''), coalesce(term_en, ''))")}) as hay from hits),
asked_c as (select *, list_transform(regexp_extract_all({norm('kq')}, {q(TOKEN2)}), lambda t: lower(t)) as cs, {trim_ws('kq')} as phrase from asked_t),
summed as (select *, case when len(ts) = 0 then 0.0 else round((len(list_filter(list_distinct(ts), lambda t: contains(hay, t))) * 2.0 + {often('hay', 'ts')} * 0.2 + len(list_filter(cs, lambda t: contains(hay, t))) * 3.0
  + case when phrase <> '' and contains(hay, phrase) then 10.0 else 0 end + coalesce(evidence_priority, 0) * 1.2 + case when risk_level = 'high' then 1.0 when risk_level = 'medium' then 0.5 else 0 end
  + case when content_type in ('restriction', 'precondition', 'rule', 'emergency') then 1.5 else 0 end)::double + coalesce(score, 0) + least(length(hay), 200) / 200.0::double, 6) end as combined from asked_c),
reranked as (select *, row_number() over (partition by query_id order by combined desc, input_rank) as rank from summed)"""


def snippet(body: str, terms: str = "ts") -> tuple[str, str]:
    """Expressions of the sentences of a text, and of the one with most terms in a list ``ss`` of them."""
    counts = f"list_transform(ss, lambda x: {often(f'lower({norm("x")})', terms)})"
    return f"case when len({sentences(body)}) > 0 then {sentences(body)} else [{body}] end", f"ss[list_position({counts}, list_max({counts}))]"


def oracle_sql() -> dict[str, str]:
    """Twins by query name."""
    z = "coalesce(zh_text, '')"
    n = f"lower({norm('query')})"
    sections = ["section_part_zh", "section_part_en", "section_chapter_zh", "section_chapter_en", "appendix_zh", "appendix_en"]
    kind, en, split = asked(n), "coalesce(term_en, '')", sentences("text")
    out = {
        "q01_normalize": f"select doc_id, {norm('text')} as normalized from documents",
        "q02_classify_text": f"select doc_id, regexp_matches(text, {q(CJK)}) as has_cjk, regexp_matches(text, '[A-Za-z]') as has_english, {lang('text')} as lang_class from documents",
        "q03_lines_noise": f"select block_id, pos, line, {noise('line')} as noise from (select block_id, (unnest(range(len(string_split(text, chr(10))))))::int as pos, unnest(string_split(text, chr(10))) as line from blocks where block_type = 'paragraph')",
        "q04_split_sentences": f"select doc_id, unnest(range(len(s)))::int as pos, unnest(s) as sentence from (select doc_id, {split} as s from documents)",
        "q05_query_terms": f"select query_id, array_to_string({terms('query')}, '|') as terms from queries",
        "q06_heading_kind": f"select heading, {heading('heading')} as kind, count(*) as n from (select unnest([{', '.join(sections)}]) as heading from regulation_clause) where heading <> '' group by heading",
        "q07_suffix_clean": f"select block_id, {clean('text')} as line from blocks",
        "q09_clause_enrich": f"""select row_id, case when {hit(z, CLAUSE_HIGH)} then 'high' when {hit(z, CLAUSE_MEDIUM)} then 'medium' else 'low' end as risk,
            case when {hit(z, PROHIBITION)} then 'restriction' when {hit(z, EMERGENCY)} then 'emergency' when {hit(z, PRECONDITION)} then 'precondition'
                 when {hit(z, PROCEDURE)} then 'procedure' when {hit(z, MANDATORY)} then 'rule' else 'description' end as kind,
            {sums(z, PROHIBITION, 3)} + {sums(z, STRESS, 2)} + {sums(z, MENTION, 1)} as priority,
            array_to_string({keywords(['section_part_zh', 'section_chapter_zh', 'appendix_zh', 'zh_text'])}, '|') as words from regulation_clause""",
        "q10_start_stop": f"""with {LINES}, l as (select * from lines where line <> ''),
            a as (select source_id, min(row(ord, block_id)) as a from l where contains(line, '力矩') group by 1),
            k as (select l.* from l left join a on l.source_id is not distinct from a.source_id where a is null or row(ord, block_id) >= a),
            s as (select source_id, min(row(ord, block_id)) as s from k where contains(line, 'Fig.') group by 1)
            select k.source_id, ord, block_id, line from k left join s on k.source_id is not distinct from s.source_id where s is null or row(ord, block_id) < s""",
        "q11_line_fold": f"""with {LINES}, l as (select * from lines where not {noise('line')}),
            g as (select *, sum(regexp_matches(line, {q(CJK)})::int) over (partition by source_id order by ord, block_id rows unbounded preceding) as g from l)
            select source_id, min(ord) as ord, arg_min(block_id, row(ord, block_id)) as block_id, {norm("string_agg(line, ' ' order by ord, block_id)")} as line from g group by source_id, g""",
        "q13_abbrev_aliases": f"""select row_id, short, "full", array_to_string({ordered_distinct("list_filter([" + ", ".join(norm(f"coalesce({c}, '')") for c in ("term_zh", "term_en", "short", '"full"')) + "], lambda v: v <> '')")}, '|') as names
            from (select row_id, term_zh, term_en, {abbreviation(en)} as short, {full_form(en)} as "full" from glossary_term)""",
        "q15_records_union": "select record_type, knowledge_channel, count(*) as records, count(distinct record_id) as different from (select record_type, knowledge_channel, record_id from regulation_clause union all select record_type, knowledge_channel, record_id from glossary_term) group by all",
        "q16_tf": f"with {RECORDS},{grams('records', 'record_key', 'retrieval_text', 'tf')} select record_key, count(*) as grams, sum(tf)::bigint as total, max(tf) as most from tf group by record_key",
        "q17_df_idf": f"with {INDEX} select gram, df, round(idf, 6) as idf from idf",
        "q18_postings_norm": f"with {INDEX} select record_key, count(*) as grams, round(sum(w * w), 4) as length, round(max(w), 4) as heaviest from postings group by record_key",
        "q19_search_topk": f"with {INDEX}{SEARCH} {top('q_scored', 5)}",
        "q20_search_type_filter": f"with {INDEX}{SEARCH} {top('q_scored', 3, 'where record_key % 10 = 1')}",
        "q25_classify_query": f"select log_id, k as asked_type, case when k = 'term' then 'glossary_term' when k <> 'paper' then 'regulation_clause' end as types from (select log_id, {kind} as k from qa_log)",
        "q26_risk_check": f"""select log_id, case when {hit(n, QUERY_HIGH)} then 'high' when {sums(n, QUERY_MEDIUM)} >= 2 then 'medium' when {sums(n, QUERY_MEDIUM)} = 1 then 'low' else 'none' end as risk,
            array_to_string(list_filter([{', '.join(map(q, QUERY_HIGH + QUERY_MEDIUM))}], lambda m: contains({n}, m)), '|') as markers from qa_log""",
        "q37_qa_log": "select min(log_id) as log_id, query_id, count(*) as deliveries, coalesce(len(arg_min(citations, log_id)), 0)::int as cited from qa_log group by query_id, asked_at, query_type, risk_level",
        "q40_text_match": r"""with t as (select item_id, regexp_extract_all(lower(coalesce(evidence, '')), '[\x{3400}-\x{9fff}]|[a-z0-9]+') as a, regexp_extract_all(lower(coalesce(answer_gold, '')), '[\x{3400}-\x{9fff}]|[a-z0-9]+') as g from qa_samples)
            select item_id, (a = g)::int::double as em, round(case when len(a) + len(g) = 0 then 1.0 else 2.0 * list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda v: v = t)), len(list_filter(g, lambda v: v = t))))) / (len(a) + len(g)) end, 4) as f1 from t""",
        "q42_table_rows": "select block_id, unnest(range(1, len(cell_rows) + 1))::int as row_no, unnest(list_transform(cell_rows, lambda r: array_to_string(r, ' | '))) as line from blocks where block_type = 'table'",
        "q44_next_line": f"with {LINES}, l as (select * from lines where line <> '') select block_id, lead(line) over (partition by source_id order by ord, block_id) as next_line from l",
        "q45_translation_candidate": f"""select log_id, {candidate('query')} as candidate,
            array_to_string(case when len(c) > 0 then {ordered_distinct('c')} else [{candidate('query')}] end, '|') as candidates from (select log_id, query, {candidates('query')} as c from qa_log)""",
    }
    heads = """heads as (select source_id, min(row(section_part_zh, section_part_en)) as h from regulation_clause where source_id is not null and section_part_zh <> '' group by 1),
        blk as (select block_id, source_id, ord, block_type, text from blocks
          union all select -2, source_id, -2, 'paragraph', h[1] from heads union all select -1, source_id, -1, 'paragraph', h[2] from heads where h[2] <> '')"""
    islands = f"""{heads},
        l as (select source_id, ord, block_id, {clean('text')} as line from blk where block_type = 'paragraph'),
        c as (select *, {heading('line')} as hk from l where not {noise('line')}),
        k as (select *, case when hk is not null then 'H' when {lang('line')} in ('zh', 'mixed_zh') then 'Z' else 'E' end as kind,
              lead(line) over w as nxt, row_number() over w as pos from c window w as (partition by source_id order by ord, block_id)),
        m as (select *, (kind = 'H' or (kind = 'Z' and coalesce(lag(kind) over w, '') <> 'Z'))::int as st,
              last_value(case when hk = 'part_zh' then pos end ignore nulls) over w as pp,
              last_value(case when hk = 'part_zh' then line end ignore nulls) over w as pz,
              last_value(case when hk = 'part_zh' then case when regexp_matches(nxt, {q(HEADINGS[3][1])}) then nxt else '' end end ignore nulls) over w as pe,
              last_value(case when hk = 'chapter_zh' then pos end ignore nulls) over w as cp, last_value(case when hk = 'chapter_zh' then line end ignore nulls) over w as cz,
              last_value(case when hk = 'appendix_zh' then pos end ignore nulls) over w as ap, last_value(case when hk = 'appendix_zh' then line end ignore nulls) over w as az
              from k window w as (partition by source_id order by ord, block_id)),
        n as (select *, sum(st) over (partition by source_id order by ord, block_id rows unbounded preceding) as isl from m),
        r as (select source_id, isl, min(pos) as pos, arg_min(kind, pos) as first, {norm("coalesce(string_agg(line, ' ' order by pos) filter (where kind = 'Z'), '')")} as zh_text, {norm("coalesce(string_agg(line, ' ' order by pos) filter (where kind = 'E'), '')")} as en_text,
              coalesce(arg_min(pz, pos), '') as section_part_zh, coalesce(arg_min(pe, pos), '') as section_part_en,
              coalesce(arg_min(case when cz is null then '' when pp is null or cp > pp then cz else '' end, pos), '') as section_chapter_zh,
              coalesce(arg_min(case when az is null then '' when pp is null or ap > pp then az else '' end, pos), '') as appendix_zh from n group by source_id, isl),
        cl as (select source_id, row_number() over (partition by source_id order by pos) as clause_index, zh_text, en_text, section_part_zh, section_part_en, section_chapter_zh, appendix_zh
        from r where first = 'Z' and zh_text <> '' and not (length({compact('zh_text')}) < 6 and length({compact('en_text')}) < 20))"""
    out["q08_clause_segment"] = f"with {islands} select * from cl"
    zt, sub = "zh_text", "coalesce(nullif(section_chapter_zh, ''), appendix_zh)"
    path = f"concat_ws(' / ', nullif(section_part_zh, ''), nullif({sub}, ''))"
    judged = (
        f"case when {hit(zt, PROHIBITION)} then 'restriction' when {hit(zt, EMERGENCY)} then 'emergency' when {hit(zt, PRECONDITION)} then 'precondition' "
        f"when {hit(zt, PROCEDURE)} then 'procedure' when {hit(zt, MANDATORY)} then 'rule' else 'description' end as content_type, "
        f"case when {hit(zt, CLAUSE_HIGH)} then 'high' when {hit(zt, CLAUSE_MEDIUM)} then 'medium' else 'low' end as risk_level, "
        f"{sums(zt, PROHIBITION, 3)} + {sums(zt, STRESS, 2)} + {sums(zt, MENTION, 1)} as evidence_priority"
    )
    out["q43_clause_records"] = f"""with {islands}
        select format('{{}}_clause_{{:04d}}', coalesce(source_id, 'null'), clause_index) as record_id,
        concat_ws(' > ', nullif(source_title, ''), nullif(section_part_zh, ''), nullif({sub}, ''), '条款 ' || clause_index) as source_label, {judged},
        array_to_string({keywords(['section_part_zh', 'section_chapter_zh', 'appendix_zh', 'zh_text'])}, '|') as words,
        {norm(f"concat_ws(' ', coalesce(source_title, ''), {path}, zh_text, en_text)")} as retrieval_text from cl left join source_registry using (source_id)"""
    heads_all = " union all ".join(
        f"select source_id, min(row_id) as ord, {2 * k} as block_id, {zh} as line, max(coalesce({en_}, '')) as nxt from regulation_clause where source_id is not null and {zh} <> '' group by source_id, {zh}"
        for k, (zh, en_) in enumerate((("section_part_zh", "section_part_en"), ("section_chapter_zh", "section_chapter_en"), ("appendix_zh", "appendix_en")))
    )

    def seen(kind: str, english: int) -> str:
        own = f"case when regexp_matches(nxt, {q(HEADINGS[english][1])}) then nxt else '' end"
        return f"last_value(case when hk = '{kind}' then {{'at': pos, 'zh': line, 'en': {own}}} end ignore nulls) over w as {kind}"

    def under(name: str, side: str, alias: str) -> str:
        return f"case when {name} is not null and (part_zh is null or {name}.at > part_zh.at) then {name}.{side} else '' end as {alias}"

    out["q47_all_headings"] = f"""with h as ({heads_all}),
        x as (select source_id, ord, block_id, line from h union all select source_id, ord, block_id + 1, nxt from h where nxt <> ''
          union all select source_id, row_id, 6, zh_text from regulation_clause where source_id is not null and zh_text <> ''),
        l as (select source_id, ord, block_id, {clean('line')} as line from x),
        k as (select *, {heading('line')} as hk, lead(line) over w as nxt, row_number() over w as pos from l where line <> '' window w as (partition by source_id order by ord, block_id)),
        m as (select *, {seen('part_zh', 3)}, {seen('chapter_zh', 4)}, {seen('appendix_zh', 5)} from k window w as (partition by source_id order by ord, block_id))
        select source_id, ord, block_id::bigint as block_id, case when hk is not null then 'H' when {lang('line')} in ('zh', 'mixed_zh') then 'Z' else 'E' end as kind,
        coalesce(part_zh.zh, '') as section_part_zh, coalesce(part_zh.en, '') as section_part_en, {under('chapter_zh', 'zh', 'section_chapter_zh')}, {under('chapter_zh', 'en', 'section_chapter_en')},
        {under('appendix_zh', 'zh', 'appendix_zh')}, {under('appendix_zh', 'en', 'appendix_en')} from m"""
    key = f"lower({compact(norm('line'))})"

    def carried(line: str, of: str) -> str:
        """CTEs up to ``cat``: lines with the category announced last; ``line`` is the second line of each row."""
        return f"""g as (select source_id, row_id, coalesce(category_zh, '') as cz, coalesce(category_en, '') as ce, category_zh, category_en, term_zh, term_en from glossary_term),
        base as (select * from (values {', '.join(f'({q(a)}, {q(b)})' for a, b in CATEGORIES)}) v(a, b) union select cz, ce from g where cz <> ''),
        keys as (select lower({compact(norm('a || b'))}) as k, {norm('a')} as ka, {norm('b')} as kb from base),
        allk as (select k, ka, kb from keys union select k || k, ka, kb from keys),
        l as (select source_id, row_id * 2 as block_id, row_id, {of.replace('{}', "concat_ws(' ', category_zh, category_en)")} as line from g union all select source_id, row_id * 2 + 1, row_id, {of.replace('{}', line)} from g),
        m as (select l.*, k is not null as is_anchor, ka, kb from l left join allk on {key} = k),
        cat as (select source_id, row_id, block_id, line, is_anchor, coalesce(last_value(ka ignore nulls) over w, '通用词汇') as category_zh, coalesce(last_value(kb ignore nulls) over w, 'General vocabulary') as category_en
          from m window w as (partition by source_id order by row_id, block_id rows unbounded preceding))"""

    out["q14_category_carry"] = f"with {carried("coalesce(term_zh, '')", '{}')} select block_id, is_anchor, category_zh, category_en from cat"
    # a mark stands where a Chinese term begins, since this dialect can't look ahead
    marked = f"regexp_replace(line, {q('(' + WS + '+[' + chr(92) + 'x{3400}-' + chr(92) + 'x{9fff}])')}, {q(chr(1) + chr(92) + '1')}, 'g')"
    pair = r"([\x{3400}-\x{9fff}][\x{3400}-\x{9fff}A-Za-z0-9（）()/\-、，,．. \x01]*?)" + WS + r"+([A-Za-z(][A-Za-z0-9 /;,\-().:+]*?)(?:\x01|$)"
    zs, es = f"regexp_extract_all({marked}, {q(pair)}, 1)", f"regexp_extract_all({marked}, {q(pair)}, 2)"
    both = f"list_transform(range(1, len({zs}) + 1), lambda i: {{'z': {norm(f"replace({zs}[i], chr(1), '')")}, 'e': {norm(f'{es}[i]')}}})"
    pairs = f"list_filter({both}, lambda p: length({compact('p.z')}) >= 2 and regexp_matches(p.e, '[A-Za-z]'))"
    cz, ce = compact("term_zh"), compact("term_en")
    low = (
        f"(length({cz}) < 2 or length({ce}) < 2 or {hit(cz, PAIR_FORBIDDEN)} or {ce} in ('a', 'an', 'the') or regexp_matches(term_en, {q(r'[^\p{L}\p{N}_\s/;,\-().:+]')}) "
        f"or length({ce}) - length(replace({ce}, '(', '')) <> length({ce}) - length(replace({ce}, ')', '')))"
    )
    out["q12_term_pairs"] = f"""with l as (select row_id, {norm("concat_ws(' ', term_zh, term_en)")} as line from glossary_term), p as (select row_id, {pairs} as ps from l),
        u as (select row_id, unnest(range(len(ps)))::int as pos, unnest(ps) as p from p), f as (select row_id, pos, p.z as term_zh, p.e as term_en from u)
        select *, {low} as low_quality from f"""
    names = ordered_distinct("list_filter([" + ", ".join(norm(c) for c in ("term_zh", "term_en", "abbreviation", "full_form")) + "], lambda v: v <> '')")
    out["q46_term_records"] = f"""with {carried("concat_ws(' ', term_zh, term_en)", norm('{}'))},
        p as (select source_id, row_id, block_id, category_zh, category_en, {pairs} as ps from cat where not is_anchor),
        u as (select source_id, row_id, block_id, category_zh, category_en, unnest(range(len(ps)))::int as pos, unnest(ps) as p from p),
        f as (select source_id, row_id, block_id, pos, category_zh, category_en, p.z as term_zh, p.e as term_en from u),
        t as (select *, {abbreviation('term_en')} as abbreviation, {full_form('term_en')} as full_form, row_number() over (partition by source_id order by row_id, block_id, pos) as n from f where not {low})
        select format('{{}}_term_{{:05d}}', coalesce(source_id, 'null'), n) as record_id, term_zh, term_en, abbreviation, full_form, array_to_string({names}, '|') as names, category_zh,
        concat_ws(' > ', nullif(source_title, ''), coalesce(nullif(category_zh, ''), '未分类术语'), '术语 ' || n) as source_label,
        array_to_string({keywords(['category_zh', 'term_zh', 'term_en', 'abbreviation', 'full_form'])}, '|') as words,
        {norm("concat_ws(' ', coalesce(source_title, ''), category_zh, category_en, term_zh, term_en, abbreviation, full_form)")} as retrieval_text from t left join source_registry using (source_id)"""
    base = f"with {INDEX}{SEARCH}"
    terms_found = base + dictionary()
    out["q21_dictionary_search"] = f"{terms_found}{found(8)} select query_id, record_key, score, rank from found"
    out["q22_expand_query"] = f"{terms_found}{found(3)}{wide()} select query_id, query from wide"
    out["q23_regulation_search"] = f"""{terms_found}{found(3)}{wide()}{regulation()}
        select r.query_id, r.record_key, r.score as score, origin, case when origin = 'expanded' then w.query else o.query end as matched_query,
        concat_ws(', ', 'channel=regulation', 'content_type=' || nullif(content_type, ''), 'risk_level=' || nullif(risk_level, ''), 'evidence_priority=' || coalesce(evidence_priority, 0)) as trace, rank
        from reg r join wide w using (query_id) join queries o using (query_id) join records using (record_key)"""
    out["q24_dual_channel"] = f"""{terms_found}{found(5)}{wide()}{regulation()},
        ch as (select query_id, 'terminology' as channel, record_key, score, rank from found union all select query_id, 'regulation', record_key, score, rank from reg),
        kd as (select query_id, {asked(n)} as query_type from queries),
        us as (select query_id, query_type, case when query_type = 'term' then 'terminology' when query_type = 'paper' then 'none' when query_type = 'bilingual' and query_id in (select query_id from found) then 'terminology' else 'regulation' end as channel from kd)
        select query_id, query_type, channel, record_key, score, rank from ch join us using (query_id, channel)"""
    out["q27_rerank"] = f"{base}{HITS} select query_id, record_key, input_rank, combined, rank from reranked where rank <= 5"
    first, best = snippet("coalesce(nullif(zh_text, ''), en_text, '')")
    out["q28_snippet"] = f"{base}{HITS}, sn as (select query_id, record_key, ts, {first} as ss from asked_t where input_rank <= 3) select query_id, record_key, {best} as snippet from sn"
    zn, enn, ql = norm("coalesce(term_zh, '')"), norm("coalesce(term_en, '')"), f"lower({norm('query')})"
    out["q30_glossary_select"] = f"""{base}{HITS},
        gl as (select query_id, record_key, input_rank, round((case when {zn} <> '' and contains({ql}, lower({zn})) then 5 else 0 end + case when {enn} <> '' and contains({ql}, lower({enn})) then 5 else 0 end
          + case when coalesce(category_zh, '') not in ('', '通用词汇') then 0.5 else 0 end)::double + score - (length({zn}) + length({enn})) * 0.01, 6) as cs from hits where record_type = 'glossary_term')
        select query_id, record_key, cs as choice_score from gl qualify row_number() over (partition by query_id order by cs desc, input_rank) = 1"""
    out["q31_citations"] = f"{base}{HITS} select query_id, count(*)::int as cited, string_agg(record_id, '|' order by rank) as record_ids from reranked where rank <= 3 group by query_id"
    z0, e0 = "coalesce(zh_text, '')", "coalesce(en_text, '')"
    body = f"case when regexp_matches(query, {q(CJK)}) then case when {z0} <> '' then {z0} else {e0} end else case when {e0} <> '' then {e0} else {z0} end end"
    first, best = snippet("body")
    out["q32_answers"] = f"""{base}{HITS},
        bo as (select *, {body} as body, {asked(n)} in ('term', 'bilingual') and rank = 1 as tm from reranked where rank <= 3),
        sn as (select *, {first} as ss from bo),
        on_ as (select query_id, rank, tm, case when tm then concat_ws(' / ', coalesce(nullif(term_zh, ''), nullif(zh_text, '')), coalesce(nullif(term_en, ''), nullif(en_text, ''))) else {best} end as s from sn),
        gr as (select query_id, bool_or(tm) as tm, count(*) as c, list(s order by rank) as l from on_ group by query_id)
        select query_id, case when tm then l[1] else array_to_string({ordered_distinct("list_filter(l, lambda v: v <> '')")}, ' ') end as answer, (case when tm then 1 else c end)::int as cited from gr"""
    cell = norm("coalesce(c, '')")
    rows_ = f"list_filter(list_transform(coalesce(cell_rows, []), lambda r: list_filter(list_transform(coalesce(r, []), lambda c: {cell}), lambda c: c <> '')), lambda r: len(r) > 0)"
    out["q38_docx_blocks"] = f"""with b as (select block_id, block_type, {norm("coalesce(text, '')")} as t, {rows_} as r from blocks)
        select block_id, case when block_type = 'table' then 'table' else 'paragraph' end as block_type, case when block_type = 'table' then array_to_string(list_transform(r, lambda x: array_to_string(x, ' | ')), chr(10)) else t end as text,
        case when block_type = 'table' then array_to_string(list_transform(r, lambda x: array_to_string(x, '¦')), '‖') else '' end as rows from b where case when block_type = 'table' then len(r) > 0 else t <> '' end"""
    out["q39_retrieval_metrics"] = f"""with {INDEX}{search('items', 'q')},
        hits as (select query_id, record_key, row_number() over (partition by query_id order by round(score, 9) desc, record_key desc) as rank from q_scored qualify rank <= 10),
        tags as (select item_id as query_id, unnest(terminology_tags) as tag from qa_samples),
        chap as (select record_key, regexp_extract(section_chapter_zh, '^第[^章]+章 (.+)$', 1) as tag from records where record_type = 'regulation_clause' and section_chapter_zh <> ''),
        rel as (select distinct query_id, record_key from chap join tags using (tag)),
        n as (select query_id, count(*) as relevant from rel group by 1),
        g as (select query_id, count(*) as found, max(1.0 / rank) as rr, sum(1.0 / log2(rank + 1)) as dcg from hits join rel using (query_id, record_key) group by 1)
        select query_id, relevant, coalesce(found, 0) as found, round(coalesce(found, 0) / relevant, 4) as recall, round(coalesce(rr, 0)::double, 4) as reciprocal_rank,
        round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda r: 1.0 / log2(r + 1))), 4) as ndcg from n left join g using (query_id)""".replace("with \nrecords", "with items as (select item_id as query_id, question as query from qa_samples), records")
    return out
