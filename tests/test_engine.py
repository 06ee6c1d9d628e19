"""Segmentation, index, retrieval and sources on small fixtures against plain loops."""

import io
import json
import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright import cli
from clausewright.operators import evaluate, index, ordered, packed, rank, retrieve, scan, segment, within
from clausewright.plans import queries as plans
from clausewright.sources import docx, sinks
from clausewright.streaming import ask


def blocks(spark, rows):
    return spark.createDataFrame([(i, s, o, t, x) for i, (s, o, t, x) in enumerate(rows)], "block_id long, source_id string, ord long, block_type string, text string")


def loop_clauses(kinds):
    """Islands of a token sequence: Chinese run, then English run; H breaks."""
    out, i = [], 0
    while i < len(kinds):
        if kinds[i][0] != "Z":
            i += 1
            continue
        z, e = [], []
        while i < len(kinds) and kinds[i][0] == "Z":
            z.append(kinds[i][1])
            i += 1
        while i < len(kinds) and kinds[i][0] == "E":
            e.append(kinds[i][1])
            i += 1
        out.append((" ".join(z), " ".join(e)))
    return out


def test_clauses_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ordered.bucketed, "__defaults__", (5,))  # many buckets per source
    rnd, rows, want = random.Random(3), [], {}
    for s in ("a", "b"):
        seq = []
        for i in range(60):
            k = rnd.choice("ZZEEH")
            seq.append((k, {"Z": f"检查接触线第{i}项内容", "E": f"check the contact wire of item no {i} again", "H": "第一章 总则"}[k] + "。" * (k == "Z")))
        rows += [(s, i, "paragraph", t) for i, (_, t) in enumerate(seq)]
        want[s] = [(z, re.sub(r" \d+$", "", e)) for z, e in loop_clauses([(k, re.sub(r"\s+\d+$", "", t)) for k, t in seq])]
    got = segment.clauses(segment.lines(blocks(spark, rows))).orderBy("source_id", "clause_index").collect()
    for s in want:
        assert [(r.zh_text, r.en_text) for r in got if r.source_id == s] == want[s]
        assert [r.clause_index for r in got if r.source_id == s] == list(range(1, len(want[s]) + 1))


def test_headings_reset(spark):
    texts = ["第一部分 甲", "Part I A", "第一章 乙", "附件1 丙", "检查接触线和吊弦。", "第二部分 丁", "检查绝缘子和支柱。", "orphan", "short"]
    got = segment.clauses(segment.lines(blocks(spark, [("s", i, "paragraph", t) for i, t in enumerate(texts)]))).orderBy("clause_index").collect()
    assert [(r.section_part_zh, r.section_part_en, r.section_chapter_zh, r.appendix_zh) for r in got] == [("第一部分 甲", "Part I A", "第一章 乙", "附件1 丙"), ("第二部分 丁", "", "", "")]
    assert got[1].en_text == "orphan short"


def test_empty_and_null_blocks(spark):
    none = blocks(spark, [("s", 1, "paragraph", None), (None, 2, "paragraph", ""), ("s", 3, "table", "x")])
    assert segment.clauses(segment.lines(none)).count() == 0
    assert segment.folded(segment.lines(none.limit(0))).count() == 0


def test_fold_anchor_stop_and_category(spark):
    texts = ["intro", "通用词汇 General vocabulary", "接触线 contact", "wire", "牵引供电 Traction power supply", "吊弦 dropper", "Z12 汉英索引", "late 词"]
    rows = segment.lines(blocks(spark, [("s", i, "paragraph", t) for i, t in enumerate(texts)]))
    rows = segment.until_stop(segment.from_anchor(rows, segment.glossary_start(F.col("line"))), segment.glossary_stop(F.col("line")))
    done = segment.with_category(segment.folded(rows), segment.category_keys(spark)).orderBy("ord")
    assert [(r.line, r.is_anchor, r.category_zh) for r in done.collect()] == [
        ("通用词汇 General vocabulary", True, "通用词汇"), ("接触线 contact wire", False, "通用词汇"), ("牵引供电 Traction power supply", True, "牵引供电"), ("吊弦 dropper", False, "牵引供电"),
    ]
    sources = spark.createDataFrame([("s", "T", "f.docx")], "source_id string, source_title string, source_file string")
    terms = segment.term_records(done, sources).orderBy("record_id").collect()
    assert [(t.record_id, t.term_zh, t.term_en, t.abbreviation) for t in terms] == [("s_term_00001", "接触线", "contact wire", "CW"), ("s_term_00002", "吊弦", "dropper", "")]


def plain_index(texts):
    tf = {k: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for k, t in ((k, re.sub(r"\s{2,}", " ", v.lower())) for k, v in texts.items())}
    df = Counter(g for c in tf.values() for g in c)
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}
    out = {}
    for k, c in tf.items():
        w = {g: (1 + math.log(n)) * idf[g] for g, n in c.items()}
        size = math.sqrt(sum(v * v for v in w.values()))
        out[k] = {g: v / size for g, v in w.items()}
    return out, idf


def test_index_and_search(spark, tmp_path):
    texts = {1: "The Contact  wire", 2: "接触线 contact", 3: "a", 4: "", 5: "contact wire of the dropper"}
    rec = spark.createDataFrame([(k, v, "t") for k, v in texts.items()], "k long, x string, record_type string")
    postings, idf = index.build(rec, "k", "x", ["record_type"])
    want, widf = plain_index(texts)
    assert {(r.k, r.gram): round(r.w, 9) for r in postings.collect()} == {(k, g): round(w, 9) for k, v in want.items() for g, w in v.items()}
    index.save(postings, idf, rec, str(tmp_path), 2)
    p, i, _ = index.load(spark, str(tmp_path))
    q = spark.createDataFrame([(1, "contact wire"), (2, "zzzz"), (3, None)], "query_id long, query string")
    hits = index.search(q, p, i, "k", top=2).orderBy("rank").collect()
    assert [(h.query_id, h.k, h["rank"]) for h in hits] == [(1, 1, 1), (1, 5, 2)] or [h.k for h in hits] == [5, 1]
    assert len(index.search(q, p, i, "k", top=0).collect()) == 1
    assert index.search(q, p, i, "k", types=["other"]).count() == 0


def test_dictionary_against_nested_loops(spark):
    rows = [(1, "接触线", "contact wire", "CW", "contact wire", "牵引供电"), (2, "线", "wire", "", "wire", "通用词汇"), (3, "吊弦", "Dropper", "D", "dropper", None), (4, None, None, "", "", "")]
    terms = spark.createDataFrame([(*r, r[1], r[2], ["x", None]) for r in rows], "k long, term_zh string, term_en string, abbreviation string, full_form string, category_zh string, zh_text string, en_text string, aliases array<string>")
    q = spark.createDataFrame([(1, "接触线和吊弦英文怎么说？"), (2, "contact wire"), (3, "啊啊")], "query_id long, query string")
    got = {(r.query_id, r.k): (r.exact, r.contained, r.score) for r in retrieve.dictionary_matches(q, terms, "k").collect()}
    cand = {}
    for r in retrieve.candidates(q).collect():
        cand.setdefault(r.query_id, []).append(r.candidate)
    want = {}
    for t in rows:
        names = list(dict.fromkeys(n for n in (t[1], t[2], t[3], t[4], t[1], t[2], "x", "") if n))
        low = [n.lower() for n in names]
        for i, cs in cand.items():
            exact = sum(c == a for c in cs for a in low)
            some = sum(c in a or a in c for c in cs for a in low)
            if some:
                score = (10 if exact else 8) + 2 * exact + 0.5 * some + (0.5 if t[5] and t[5] != "通用词汇" else 0) - 0.01 * sum(map(len, names[:2]))
                want[i, t[0]] = (exact, some, round(score, 6))
    assert got == want and want
    hits = retrieve.dictionary_search(q, terms, "k", top=3)
    wide = {r.query_id: r.query for r in retrieve.expanded(q, hits, terms, "k").collect()}
    assert wide[3] == "啊啊" and wide[2].startswith("contact wire ") and "接触线" in wide[2]


def test_grams_are_counted_as_by_a_loop():
    rnd = random.Random(1)
    wide = [chr(c) for c in (*range(0x4E00, 0x4E00 + 20000), *range(0x20000, 0x20000 + 20000))]  # too many for one number
    for texts in ([], [""], ["a", "", "abab", "\0\0a"], ["".join(rnd.choice("ab😀线") for _ in range(30)) for _ in range(20)], ["".join(wide), "ab", "".join(wide[5:50] * 2)]):
        codes, lengths = scan.points(texts)
        row = np.repeat(np.arange(len(texts)), lengths)
        for n in (2, 3, 4):
            want = Counter((t[i : i + n], k) for k, t in enumerate(texts) for i in range(len(t) - n + 1))
            hi, lo, start, r, tf = scan.counted(codes, row, len(texts), n)
            names = ["".join(chr((v >> 21 * j & 0x1FFFFF) - 1) for v, w in ((h, n - 3), (x, min(n, 3))) for j in range(w - 1, -1, -1)) for h, x in zip(hi.tolist(), lo.tolist())]
            assert {(names[g], int(r[i])): int(tf[i]) for g in range(len(names)) for i in range(start[g], start[g + 1])} == want


@pytest.mark.parametrize(("known", "block"), [(1 << 21, 1 << 21), (20, 40)])
def test_scan_finds_what_the_index_finds(spark, monkeypatch, known, block):
    monkeypatch.setattr(scan, "KNOWN", known)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["接触线", "contact", "Wire", "吊弦", "😀", "dropper  x"]) for _ in range(rnd.randrange(6))) for _ in range(60)] + [None, "", "a", "contact Wire", "contact Wire"]
    rec = spark.createDataFrame([(k * 10, t, "regulation_clause" if k % 3 else "glossary_term") for k, t in enumerate(texts)], "k long, x string, record_type string")
    asked = [spark.createDataFrame(rows, "query_id long, query string") for rows in ([(1, "contact wire"), (2, "zzzz"), (3, None), (4, "接触线 吊弦 dropper")], [(1, "😀 Wire contact"), (5, "")], [(1, "")])]
    by_index = index.finder(*index.build(rec, "k", "x", ["record_type"]), "k")
    monkeypatch.setattr(scan, "BLOCK", block)
    find = scan.finder(rec, scan.frequencies(rec, "x"), len(texts), "k", "x", None)
    for top in (1, 7):
        for got, want in zip(find(asked, top, ["regulation_clause"]), by_index(asked, top, ["regulation_clause"])):
            assert {(h.query_id, h.k, h["rank"]): round(h.score, 9) for h in got.collect()} == {(h.query_id, h.k, h["rank"]): round(h.score, 9) for h in want.collect()}
    assert [f.count() for f in find(asked[2:], 5, ["regulation_clause"])] == [0]
    assert scan.finder(rec, None, 0, "k", "x", lambda *a: "other")(asked, 5, ["x"] * (monkeypatch.setattr(scan, "VECTORS", 2) or 1)) == "other"


def test_texts_within_others_against_all_pairs():
    rnd = random.Random(2)
    some = lambda n, most: ["".join(rnd.choice("ab线😀") for _ in range(rnd.randrange(most))) for _ in range(n)]
    for small in ([], ["a"], list(dict.fromkeys(t for t in some(40, 9) if t))):
        many = [t for t in some(200, 12) if t]
        text, which, equal = within.Small(small).pairs(many)
        assert list(zip(text.tolist(), which.tolist(), equal.tolist())) == [(i, j, a == b) for i, a in enumerate(many) for j, b in enumerate(small) if a in b or b in a]


def test_candidates_too_many_for_the_workers_are_joined(spark, monkeypatch):
    rows = [(1, "接触线", "contact wire", "牵引供电"), (2, "线", "wire", "通用词汇"), (3, "吊弦", "Dropper", None), (4, None, None, "")]
    terms = spark.createDataFrame([(*r, "", "", r[1], r[2], ["x", None]) for r in rows], "k string, term_zh string, term_en string, category_zh string, abbreviation string, full_form string, zh_text string, en_text string, aliases array<string>")
    q = spark.createDataFrame([(1, "接触线和吊弦英文怎么说？"), (2, "contact wire"), (3, "啊啊")], "query_id long, query string")
    met = sorted(retrieve.dictionary_matches(q, terms, "k").collect())
    monkeypatch.setattr(index, "BROADCAST", -1)
    assert met == sorted(retrieve.dictionary_matches(q, terms, "k").collect()) and met
    assert retrieve.dictionary_matches(q.limit(0), terms, "k").count() == 0


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of small record tables and questions."""
    rnd = random.Random(9)
    names = "record_id, record_type, retrieval_text, zh_text, en_text, term_zh, term_en, abbreviation, full_form, category_zh, risk_level, content_type".split(", ")
    schema = "row_id long, " + ", ".join(f"{n} string" for n in names) + ", aliases array<string>, evidence_priority int"
    words = ["接触线", "吊弦", "contact wire", "dropper", "检修", "insulator"]
    for kind in ("regulation_clause", "glossary_term"):
        rows = []
        for i in range(50):
            zh, en = rnd.choice(words), rnd.choice(words)
            text = " ".join(rnd.choice(words) for _ in range(5))
            rows.append((i, f"{kind}{i}", kind, f"{text} {zh} {en}", zh, en, zh, en, "", en, rnd.choice(["", "通用词汇", "牵引供电"]), "high", "rule", [zh, None], i))
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{kind}.parquet"))
    asked = ["接触线英文怎么说？", "吊弦检修有哪些步骤？", "what does dropper mean in Chinese", "insulator 检修周期", "论文实验", "双语 gggg"]
    spark.createDataFrame(list(enumerate(asked)), "query_id long, query string").write.parquet(str(tmp_path / "queries.parquet"))
    return str(tmp_path)


def no_index(*_):
    raise AssertionError("postings of all records are built for a few questions")


def test_dual_channel_reads_records_without_postings(spark, tables, monkeypatch):
    p, idf, records = plans._index(spark, tables)
    q = spark.read.parquet(f"{tables}/queries.parquet")
    want = retrieve.chosen_channel(q, retrieve.dual_channel(q, records.where("record_type = 'glossary_term'"), p, idf, "record_key"))
    want = {(r.query_id, r.channel, r.record_key, r.score, r["rank"]) for r in want.collect()}
    monkeypatch.setattr(plans, "_index", no_index)
    assert {(r.query_id, r.channel, r.record_key, r.score, r["rank"]) for r in plans.q24_dual_channel(spark, tables).collect()} == want and want


def test_regulation_search_reads_records_without_postings(spark, tables, monkeypatch):
    p, idf, records = plans._index(spark, tables)
    q, terms = spark.read.parquet(f"{tables}/queries.parquet"), records.where("record_type = 'glossary_term'")
    wide = retrieve.expanded(q, retrieve.dictionary_search(q, terms, "record_key", p, idf, top=3), terms, "record_key")
    columns = ("query_id", "record_key", "score", "origin", "matched_query", "rank")
    want = {tuple(r[c] for c in columns) for r in retrieve.regulation_search(q, wide, p, idf, "record_key").collect()}
    monkeypatch.setattr(plans, "_index", no_index)
    got = plans.q23_regulation_search(spark, tables).collect()
    assert {tuple(r[c] for c in columns) for r in got} == want and want
    assert {r.trace for r in got} <= {f"channel=regulation, content_type=rule, risk_level=high, evidence_priority={i}" for i in range(50)}


def test_snippet_rerank_and_metrics(spark):
    df = spark.createDataFrame([("吊弦检查", "无关。 检查吊弦。 吊弦检查两次，吊弦。"), ("x", ""), ("吊弦", "a。 b。")], "q string, b string")
    assert [r[0] for r in df.select(rank.best_snippet(F.col("q"), F.col("b"))).collect()] == ["吊弦检查两次，吊弦。", "", "a。"]
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "query_id long, k long, rank int")
    rel = spark.createDataFrame([(1, 8), (1, 5), (2, 1)], "query_id long, k long")
    got = {r.query_id: r for r in evaluate.retrieval(hits, rel, "query_id", "k", 3).collect()}
    assert (got[1].recall, got[1].reciprocal_rank, got[2].recall, got[2].ndcg) == (0.5, 0.5, 0.0, 0.0)
    pairs = spark.createDataFrame([(1, "a b c", "a c"), (2, "", ""), (3, "中文", "文"), (4, None, "x")], "id long, a string, g string")
    f1 = {r[0]: r[1] for r in pairs.select("id", evaluate.token_f1(F.col("a"), F.col("g"))).collect()}
    assert f1 == {1: 0.8, 2: 1.0, 3: pytest.approx(2 / 3), 4: 0.0}
    assert {r.id: round(r.rouge_l, 4) for r in evaluate.rouge_l(pairs, "id", "a", "g").collect()} == {1: 0.8, 2: 1.0, 3: 0.6667, 4: 0.0}


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def document(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}">{body}</w:document>')
    return out.getvalue()


def para(text):
    return f"<w:p><w:r>{text}</w:r></w:p>"


def test_docx(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{para('<w:t>a</w:t>')}{para('<w:t>b</w:t>')}</w:tc><w:tc>{para('')}</w:tc><w:tc>{para('<w:t>c</w:t>')}</w:tc></w:tr><w:tr><w:tc>{para('')}</w:tc></w:tr></w:tbl>"
    good = document(f"<w:body>{para('<w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/>')}{table}{para('<w:t> </w:t>')}{para('<w:t>z</w:t>')}</w:body>")
    (tmp_path / "d.docx").write_bytes(good)
    got = docx.read(spark, str(tmp_path / "d.docx")).orderBy("ord").collect()
    assert [(r.ord, r.block_type, r.text, r.cell_rows) for r in got] == [(1, "paragraph", "x y", []), (2, "table", "a | b | c", [["a | b", "c"]]), (3, "paragraph", "z", [])]
    for bad in (document(""), b"no zip"):
        with pytest.raises(ValueError, match="."):
            docx.blocks_of(bad)
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("other.xml", "")
    with pytest.raises(ValueError, match="no word/document.xml"):
        docx.blocks_of(empty.getvalue())


def test_build_and_ask(spark, tmp_path):
    rule = "".join(para(f"<w:t>{t}</w:t>") for t in ["目录", "第一部分 总 则", "Part I General", "接触网检修应先停电，再验电。", "De-energize the contact line before work.", "绝缘子每年清扫一次，并记录结果。"])
    words = "".join(para(f"<w:t>{t}</w:t>") for t in ["通用词汇 General vocabulary", "母线 busbar", "接触线 contact wire", "Z 1 汉英索引", "后 late"])
    (tmp_path / "c").mkdir()
    for name, body in (("r.docx", rule), ("g.docx", words)):
        (tmp_path / name).write_bytes(document(f"<w:body>{body}</w:body>"))
    (tmp_path / "c" / "s.yaml").write_text(json.dumps({
        "paths": {"unified_jsonl": "out/lines", "vector_index": "out/index", "output_dir": "out"},
        "documents": {"regulation": {"file": "r.docx", "source_id": "r", "title": "规程"}, "glossary": {"file": "g.docx", "source_id": "g", "title": "词表"}},
        "retrieval": {"top_k": 2},
    }), encoding="utf-8")
    settings = sinks.read_settings(str(tmp_path / "c" / "s.yaml"))
    assert {r.record_type: r.records for r in cli.build(spark, settings).collect()} == {"regulation_clause": 2, "glossary_term": 2}
    q = spark.createDataFrame([(1, "“母线”英文怎么说？"), (2, "绝缘子多久清扫？"), (3, "论文的创新点")], "query_id long, query string")
    got = {r.query_id: r for r in cli.ask(spark, settings, q).collect()}
    assert got[1].answer == "母线 / busbar" and len(got[1].citations) == 1
    assert got[2].answer.startswith("绝缘子每年清扫一次") and got[2].citations[0].record_id == "r_clause_0002"
    assert got[3].answer is None and got[3].query_type == "paper"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "乙", None), (1, "甲", "x")], "i long, s string, t string")
    sinks.write_json_lines(df, str(tmp_path / "lines"), ["i"], 2)
    assert sorted(r.s for r in spark.read.json(str(tmp_path / "lines")).collect()) == ["乙", "甲"]
    sinks.write_pretty_json(df, str(tmp_path / "x" / "p.json"))
    assert "甲" in (tmp_path / "x" / "p.json").read_text(encoding="utf-8")
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_pretty_json(df, str(tmp_path / "p.json"), most=1)
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_stream(spark, tmp_path):
    log = spark.createDataFrame([(1, "带电检修", "2031-01-01 00:10:00"), (1, "带电检修", "2031-01-01 00:10:00"), (2, "fuse", "2031-01-01 03:00:00")], "log_id long, query string, at string")
    log.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("log_id long, query string, at timestamp").parquet(str(tmp_path / "in"))
    run = ask.tagged(ask.once(source, "log_id", "at")).writeStream.format("memory").queryName("tags").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.log_id, r.risk_level) for r in spark.table("tags").collect()) == [(1, "high"), (2, "none")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('RK12 junction box; """RK12"" box"; "box (flexible)"', ["RK12 junction box", '"RK12" box', "box (flexible)"]),
        ("gasket for 1,800 V", ["gasket for 1,800 V"]), ("25/0.4 kV vent", ["25/0.4 kV vent"]), ("AC/DC vent (on/off)", ["AC/DC vent (on/off)"]),
        ("housing A1/housing for B2", ["housing A1", "housing for B2"]), ("A;; B; C;", ["A", "B", "C"]), ("(1) red one (2) blue one", ["red one", "blue one"]),
        ("1) red one; 2) blue one", ["red one", "blue one"]), ("甲、乙", ["甲、乙"]), ("", []), (None, []), (" ; ", []), ("x\ty", ["x", "y"]), ('bad "quote, here', ['bad "quote', "here"]),
    ],
)
def test_lattice(raw, want):
    assert [packed.clean(p) for p in packed.lattice(raw)[0]] == want


def test_packed_values(spark):
    rows = [(1, "red vent; blue vent"), (2, "red vent"), (3, None), (4, ""), (5, "red vent; blue vent"), (6, "a, b, c"), (7, "blue vent"), (8, "，甲")] + [(100 + i, "hot one; hot two") for i in range(30)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "id long, v string, t string")
    got = {}
    for r in packed.separated(df, "id", "v").orderBy("id", "value_pos").collect():
        got.setdefault(r.id, []).append((r.value_pos, r.value, r["values"]))
    assert got[1] == got[5] == [(1, "red vent", 2), (2, "blue vent", 2)]
    assert got[2] == [(1, "red vent", 1)] and got[6] == [(1, "a", 3), (2, "b", 3), (3, "c", 3)]
    assert 3 not in got and 4 not in got and len(got[8]) == 1
    assert all(len(got[100 + i]) == 2 for i in range(30))
    assert packed.separated(df.limit(0), "id", "v").count() == 0


def test_packed_values_of_many_pieces(spark):
    long = "valve, ball, brass, threaded, small"
    rows = [f"{long}; {w} lamp; {w} fuse" for w in ("red", "blue", "green", "white", "black", "grey", "pink", "brown")] * 3
    rows += [f"{w} lamp; {w} nut" for w in ("red", "blue", "green", "white", "black", "grey", "pink", "brown")] * 3
    rows += ['"valve ball brass threaded small"', "valve ball brass threaded small"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, v string")
    got = {}
    for r in packed.separated(df, "id", "v").orderBy("id", "value_pos").collect():
        got.setdefault(r.id, []).append(r.value)
    assert got[0] == [long, "red lamp", "red fuse"]


def test_packed_cuts_against_all_cuts():
    rnd = random.Random(6)
    for _ in range(60):
        n = rnd.randrange(2, 7)
        kinds = [rnd.choice([",s", ";s"]) for _ in range(n - 1)]
        seen = {(i, j): rnd.choice([0.0, 0.5, 3.0, 40.0]) for i in range(n) for j in range(i + 1, n + 1) if rnd.random() < 0.6}
        prior, total = {",s": 0.4}, 50.0
        all_cuts = []
        for mask in range(1 << (n - 1)):
            ends = [j for j in range(1, n) if mask >> (j - 1) & 1] + [n]
            cuts = list(zip([0, *ends], ends))
            w = 1.0
            for i, j in cuts:
                w *= max(seen.get((i, j), 0.0) - 1, 0.0) / total + (0.1 / total) ** (j - i)
            for k, kind in enumerate(kinds, 1):
                w *= prior.get(kind, 0.7) if k in ends else 1 - prior.get(kind, 0.7)
            all_cuts.append((w, cuts))
        z = sum(w for w, _ in all_cuts)
        field = packed.Cuts(kinds, seen, prior, total)
        found, cut = field.shares()
        for ij, p in found.items():
            assert p == pytest.approx(sum(w for w, c in all_cuts if ij in c) / z)
        for k in range(1, n):
            assert cut[k] == pytest.approx(sum(w for w, c in all_cuts if any(j == k for _, j in c)) / z)
        assert dict((tuple(c), w) for w, c in all_cuts)[tuple(field.best())] == pytest.approx(max(w for w, _ in all_cuts))


def test_packed_fields_of_very_many_pieces_do_not_underflow():
    cut = packed.Cuts([";s"] * 2000, {(0, 1): 0.0}, {}, 1e6).shares()[1]
    assert all(c == pytest.approx(0.7) for c in cut[1:-1])
