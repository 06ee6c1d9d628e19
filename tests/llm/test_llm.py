"""Training-text operators against brute force, round trips and hand-written cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import align, canon, copies, langid, leaks, mixing, queries, sentences, split


# --- 1 splitting


def test_pieces_round_trip():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choice("甲乙丙ab1 ，。；\n.") for _ in range(rnd.randrange(0, 400)))
        limit = rnd.randrange(5, 80)
        overlap = rnd.randrange(0, limit // 2)
        got = split.pieces(text, limit, overlap)
        assert all(0 < b - a <= limit for a, b, _ in got)
        back = ""
        for i, (a, b, _) in enumerate(got):
            assert i == 0 or a == got[i - 1][1] - overlap
            back += text[a:b] if i == 0 else text[a + overlap : b]
        assert back == text


def test_strongest_gap_is_rightmost():
    rnd = np.random.default_rng(1)
    s = rnd.integers(0, 5, 300).astype(np.int8)
    table = split.StrongestGap(s, 64)
    for _ in range(500):
        lo = int(rnd.integers(0, 299))
        hi = min(299, lo + int(rnd.integers(0, 63)))
        window = s[lo : hi + 1]
        assert table.query(lo, hi) == hi - int(np.argmax(window[::-1]))


def test_natural_cuts():
    text = "第一句话说完了。" * 10
    assert all(b % 8 == 0 for _, b, _ in split.pieces(text, 30, 4))
    assert split.pieces("a" * 100, 30, 5)[0][1] == 30
    assert split.pieces("", 30, 5) == [] and split.pieces("ab", 30, 5)[0][:2] == (0, 2)
    with pytest.raises(ValueError, match="no room"):
        split.pieces("abc", 5, 5)


def test_strongest_cut_of_the_whole_window():
    text = "a" * 20 + ". " + "B" + "b" * 43 + "; " + "c" * 60
    assert split.pieces(text, 100, 5)[0][1] == 22
    assert split.pieces(text, 100, 5, least=50)[0][1] == 68


def test_split_query(spark):
    rows = spark.createDataFrame([(1, "甲" * 50, "x"), (2, None, ""), (3, "", "x" * 21), (4, "甲" * 10, None)], "row_id long, zh_text string, retrieval_text string")
    limits = spark.createDataFrame([("zh_text", 10, 2), ("retrieval_text", 20, 3)], "field_name string, max_chars int, overlap_chars int")
    got = split.split_oversized(split.oversized(rows, limits, ["zh_text", "retrieval_text"]))
    assert {(r.field_name, r.row_id) for r in got.collect()} == {("zh_text", 1), ("retrieval_text", 3)}
    assert split.split_oversized(split.oversized(rows.limit(0), limits, ["zh_text"])).count() == 0


# --- 5 consistent form


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ＡＢ１２", "AB12"), ("a​b­c", "abc"), ("a b　c", "a b c"), ("é", "é"), ("⽤", "用"), ("流", "流"), ("K", "K"), ("（x）。，", "（x）。，"), ("é", "é"), ("φΩ\t\n", "φΩ\t\n"), ("", ""), (None, None), ("²", "²")],
)
def test_fold(raw, want):
    assert canon.fold(raw) == want


def test_canonical(spark):
    rows = [(1, "contact wire plate"), (2, "соntасt wire"), (3, "Щит"), (4, "RК12"), (5, "RK13 plate"), (6, None), (7, ""), (8, "ТЕ1"), (9, "TE2 x"), (14, "TE3 x"), (10, "platеwire"), (11, "plate wire"), (12, "wire plate"), (15, "plate of a wire"), (13, "ЖаТЕ")]
    df = spark.createDataFrame([(k, v, "z") for k, v in rows], "row_id long, value string, token string")
    got = {r.row_id: r.canon for r in canon.canonical(df, ["row_id"], "value").collect()}
    assert got[2] == "contact wire" and got[3] == "Щит" and got[4] == "RK12" and got[8] == "TE1" and got[10] == "platewire" and got[13] == "ЖаТЕ"
    assert got[6] is None and got[7] == "" and len(got) == len(rows)
    assert canon.canonical(df.limit(0), ["row_id"], "value").count() == 0


def test_vocabulary_words_are_runs_of_one_script(spark):
    texts = ["contact wire 25kV", "соntасt Щит-12 φάση", "接触线wire甲 naïve_x Ωa", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "folded string")
    want = [[t.lower() for t in canon.runs(x) if len({canon.script(c) for c in t}) == 1] for x in texts]
    assert [r[0] for r in df.select(canon.plain_tokens(F.col("folded"))).collect()] == want
    assert any("щит" in w for w in want) and any("φάση" in w for w in want)


# --- 2 copies


def test_field_key():
    same = ["Guy-wire  1.5 mm", "guy wire 1.5mm.", "“GUY_WIRE” 1.5 MM"]
    assert len({copies.field_key(s) for s in same}) == 1
    assert copies.field_key("25/0.4 kV") != copies.field_key("250.4 kV") and copies.field_key(None) == copies.field_key("") == ""


def test_members_against_brute_force(spark):
    rnd = random.Random(2)
    words = ["fuse", "wire", "clamp 1.5", "母线"]
    rows = []
    for i in range(400):
        a, b = ("hot", "词") if rnd.random() < 0.4 else (rnd.choice(words) + str(rnd.randrange(9)), rnd.choice([*words, "", None]))
        if rnd.random() < 0.5:
            a, b = b, a
        rows.append((i, a.upper() if a and rnd.random() < 0.5 else a, b, "z"))
    df = spark.createDataFrame(rows, "row_id long, term_zh string, term_en string, key string")
    groups = {}
    for i, a, b, _ in rows:
        groups.setdefault(tuple(sorted((copies.field_key(a), copies.field_key(b)))), []).append(i)
    want = {(min(g), i) for g in groups.values() for i in g}
    for n in (1, 7):
        got = copies.members(df, "row_id", "term_zh", "term_en", n)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert {r.copies for r in copies.collapsed(got).collect()} == {len(g) for g in groups.values()}
    assert copies.members(df.limit(0), "row_id", "term_zh", "term_en").count() == 0


# --- 3 sentences

TEXTS = [
    "The wire is checked. The clamp is cleaned.\nThe wire weighs approx. 5 kg. The fuse is open.",
    "The fuse weighs approx. 7 kg. The clamp is closed. The wire is cleaned.\nThe clamp is checked.",
    'He reads back: "It is open." The fuse is checked.\nThe lines "Stop. Go!" are read out. The wire is open.',
    "接触线已检查。“谁在？”“没有人！”的问答完成。吊弦断裂\n下一行 又一行；仍是；一行。",
] * 12


@pytest.fixture(scope="module")
def model(spark):
    return sentences.train(spark.createDataFrame([(t,) for t in TEXTS] + [(None,), ("",)], "text string"), "text")


def cut(model, text):
    out, start = [], 0
    for end in model.ends(text):
        out.append(text[start:end].strip())
        start = end
    assert not text[start:].strip("​ \n")
    return out


def test_sentences(model):
    assert cut(model, TEXTS[0]) == ["The wire is checked.", "The clamp is cleaned.", "The wire weighs approx. 5 kg.", "The fuse is open."]
    assert cut(model, TEXTS[2]) == ['He reads back: "It is open."', "The fuse is checked.", 'The lines "Stop. Go!" are read out.', "The wire is open."]
    assert cut(model, TEXTS[3]) == ["接触线已检查。", "“谁在？”“没有人！”的问答完成。", "吊弦断裂", "下一行", "又一行；仍是；一行。"]
    assert cut(model, "1. 甲乙；\n2. 丙丁。") == ["1. 甲乙；", "2. 丙丁。"]
    assert model.ends(None) == model.ends("") == model.ends(" \n ") == []
    assert model.ends("甲​。​ 乙。") == [3, 7]
    assert len(model.ends("字" * 50_000)) == 1


def test_unpunctuated_texts(spark):
    rnd = random.Random(7)
    things = ["contact wire", "fuse", "clamp", "mast", "insulator", "dropper"]
    acts = ["is checked every day", "weighs seven kilograms", "was replaced by the patroller", "must not be touched in rain", "stands near the gate"]
    zh = [("接触线", "每天检查一次"), ("断路器", "由值班员上锁"), ("绝缘子", "不得在雨天更换"), ("吊弦", "断裂时先封锁线路"), ("支柱", "立在大门旁边"), ("线夹", "重约七千克")]

    def en():
        return f"The {rnd.choice(things)} {rnd.choice(acts)}"

    def han():
        return rnd.choice(zh)[0] + rnd.choice(zh)[1]

    texts = [" ".join(en() + "." for _ in range(4)) for _ in range(300)] + ["".join(han() + "。" for _ in range(4)) for _ in range(300)]
    m = sentences.train(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    good = total = 0
    for _ in range(60):
        for parts, glue in (([en() for _ in range(5)], " "), ([en().lower() for _ in range(5)], " "), ([han() for _ in range(5)], "")):
            ends = set(itertools.accumulate(len(p) + (len(glue) if k else 0) for k, p in enumerate(parts)))
            got = set(m.ends(glue.join(parts)))
            good, total = good + len(got & ends), total + len(got | ends)
    assert good / total > 0.95
    # marked text keeps its sentences, and words inside a quotation have no gap
    assert all(len(m.ends(t)) == 4 for t in texts)
    assert len(m.ends("He reads “" + " ".join(en() for _ in range(4)) + "” aloud.")) == 1


def test_start_of_a_text_after_many_blanks():
    assert sentences.first_words(" " * 500 + "Hello world") == ("hello", "U", "l")


def test_sentence_rows(spark, model):
    df = spark.createDataFrame([(1, "甲。乙。", 0), (2, None, 0), (3, "", 0), (1, "甲。乙。", 0)], "id long, text string, end_pos long")
    got = sentences.sentence_ends(df, ["id"], "text", model).collect()
    assert sorted((r.id, r.sent_no, r.end_pos, r.sentence) for r in got) == [(1, 1, 2, "甲。")] * 2 + [(1, 2, 4, "乙。")] * 2
    assert sentences.sentence_ends(df.limit(0), ["id"], "text", model).count() == 0


def test_rare_contexts_count(spark):
    names = ["".join(c) for c in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 204_000)]
    texts = ["\n".join(f"{n}a".capitalize() for n in names[i : i + 1000]) for i in range(0, len(names), 1000)]
    texts += [f"Zz{n}\nZebra came." for n in names[:300]]
    m = sentences.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), "text")
    assert cut(m, "It is done. Zebra came.") == ["It is done.", "Zebra came."]


# --- 4 alignment


def test_alignment(spark):
    things = [("接触线", "contact wire"), ("绝缘子", "insulator"), ("吊弦", "dropper"), ("支柱", "mast"), ("电容器", "capacitor"), ("线夹", "clamp")]
    acts = [("每天清扫{n}次", "is cleaned {n} times a day"), ("不得在雨天更换", "is never replaced in rain"), ("由值班员单独上锁", "is locked by the duty operator alone"), ("断裂时先封锁线路", "breaks, then the line is blocked first")]
    rnd, rows = random.Random(4), []

    def pair():
        (z, e), (za, ea), n = rnd.choice(things), rnd.choice(acts), rnd.randrange(2, 90)
        return f"{z}{za.format(n=n)}。", f"The {e} {ea.format(n=n)}."

    for i in range(300):
        ps = [pair() for _ in range(3)]
        rows.append((i, "".join(p[0] for p in ps), " ".join(p[1] for p in ps)))
    a, b, c, d = ("接触线每天清扫7次。", "The contact wire is cleaned 7 times a day."), ("吊弦不得在雨天更换。", "The dropper is never replaced in rain."), ("支柱由值班员单独上锁。", "The mast is locked by the duty operator alone."), ("线夹断裂时先封锁线路。", "The clamp breaks, then the line is blocked first.")
    cases = {
        1001: ([a, b, c], [a, b, c], {(1, 1), (2, 2), (3, 3)}),
        1002: ([a, b, c, d], [d, a, b, c], {(1, 2), (2, 3), (3, 4), (4, 1)}),
        1003: ([a, b, c], [a, c], {(1, 1), (3, 2)}),
        1004: ([a], [d], set()),
    }
    for k, (z, e, _) in cases.items():
        rows.append((k, "".join(p[0] for p in z), " ".join(p[1] for p in e)))
    rows += [(1005, a[0] + b[0], a[1][:-1] + ", and t" + b[1][1:]), (1006, None, a[1]), (1007, "", ""), (1008, a[0], " ")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "row_id long, zh_text string, en_text string, score long")
    both = df.select(F.explode(F.array("zh_text", "en_text")).alias("text"))
    m = sentences.train(both, "text")
    sides = align.prepared(df, "row_id", "zh_text", "en_text", m)
    lex = align.train(sides)
    got = {}
    for r in align.aligned(sides, "row_id", lex).collect():
        got.setdefault(r.row_id, set()).add((r.zh_sent, r.en_sent))
    for k, (_, _, want) in cases.items():
        assert got.get(k, set()) == want, k
    assert got[1005] == {(1, 1), (2, 1)} and not {1006, 1007, 1008} & set(got)
    assert np.mean([got.get(i) == {(1, 1), (2, 2), (3, 3)} for i in range(300)]) > 0.95
    none = align.prepared(df.limit(0), "row_id", "zh_text", "en_text", m)
    assert align.aligned(none, "row_id", align.train(none)).count() == 0


def test_lexicon_keeps_long_sentences_and_all_partners(spark):
    zh = "".join(chr(0x5000 + i) for i in range(450))
    words = ["".join(c) for c in itertools.islice(itertools.product("bcdfghjklm", repeat=3), 400)]
    df = spark.createDataFrame([(zh + "。", " ".join(words) + ".")] * 3 + [("甲乙丙丁。", "Nothing at all.")] * 12, "zh_text string, en_text string")
    df = df.withColumn("row_id", F.monotonically_increasing_id())
    lex = align.train(align.prepared(df, "row_id", "zh_text", "en_text", sentences.train(df.select(F.explode(F.array("zh_text", "en_text")).alias("text")), "text")))
    units = [np.array([align.unit_hash(u) for u in us], np.int64) for us in ([zh[i : i + 2] for i in range(449)], words, ["nothing"])]
    of_zh, of_en = lex.credits(units[0], units[1])
    assert of_zh.min() > 0.9 and of_en.min() > 0.9 and not lex.credits(units[0], units[2])[0].any()


def test_beads_find_the_cheapest_path():
    rnd = random.Random(1)
    for _ in range(30):
        n, m = rnd.randrange(0, 5), rnd.randrange(0, 5)
        costs = {s: [[rnd.random() * 5 for _ in range(m)] for _ in range(n)] for s in align.BEADS if all(s)}

        def cost(i, j, di, dj, costs=costs):
            return costs[di, dj][i][j] if di and dj else 0.0

        def best(i, j):
            return 0.0 if i == n and j == m else min((p + cost(i, j, di, dj) + best(i + di, j + dj) for (di, dj), p in align.BEADS.items() if i + di <= n and j + dj <= m), default=float("inf"))

        got = align.beads(n, m, costs)
        assert sum(align.BEADS[b[2:]] + cost(*b) for b in got) == pytest.approx(best(0, 0))


def test_beads_far_from_the_diagonal():
    # the first 200 sentences of one side and the last 200 of the other have no partner
    got = align.beads(400, 400, {(1, 1): [[0.0 if i == j + 200 else float("inf") for j in range(400)] for i in range(400)]})
    assert [(i, j) for i, j, di, dj in got if di and dj] == [(k + 200, k) for k in range(200)]


def test_band_widens_until_it_is_exact():
    rnd = random.Random(3)
    for n, m in ((40, 40), (30, 55), (60, 31)):
        costs = {(1, 1): [[rnd.random() * (0.1 if abs(i - j) < 25 else 9) + (12 if i < 20 and abs(i - j) < 12 else 0) for j in range(m)] for i in range(n)]}
        got, full = align.beads(n, m, costs), align._in_band(n, m, costs, n + m)[0]
        assert sum(align.BEADS[b[2:]] + (costs[1, 1][b[0]][b[1]] if b[2] and b[3] else 0) for b in got) == pytest.approx(full)


def brute_coverage(a, b, credit, weight):
    """Share of the units of each sentence of a that each of b renders, unit by unit."""
    return [[sum(weight(u) * max((credit(u, v) for v in y), default=0) for u in x) / (sum(weight(u) for u in x) or 1) for y in b] for x in a]


def test_coverage_against_brute_force():
    rnd = np.random.default_rng(5)
    zh_units, en_units = rnd.integers(1, 2**62, 30), rnd.integers(1, 2**62, 25)
    lex = align.Lexicon()
    known = {(int(u), int(v)): int(rnd.integers(1, 256)) for u in zh_units for v in en_units if rnd.random() < 0.1}
    a, b = (np.array(x, np.int64) for x in zip(*known))
    slots = np.concatenate(align._pair_slots(a, b, align.PAIR_BITS))
    values = np.array([*known.values()] * 2, np.uint8)
    lex.of_zh = lex.of_en = (slots, values)
    for _ in range(20):
        z = [[int(u) for u in rnd.choice(zh_units, rnd.integers(0, 6), replace=False)] for _ in range(rnd.integers(1, 7))]
        e = [[int(v) for v in rnd.choice(en_units, rnd.integers(0, 6), replace=False)] for _ in range(rnd.integers(1, 7))]
        cz, ce = align.coverage(align.Side([9] * len(z), z, [{}] * len(z)), align.Side([9] * len(e), e, [{}] * len(e)), lex)
        assert np.allclose(cz, brute_coverage(z, e, lambda u, v: known.get((u, v), 0) / 255, lambda u: 2.0), atol=1e-4)
        assert np.allclose(ce.T, brute_coverage(e, z, lambda v, u: known.get((u, v), 0) / 255, lambda u: 2.0), atol=1e-4)


# --- 7 leaks


def edit_within(p, t, k):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        row = [i]
        for j, d in enumerate(t, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (c != d)))
        prev = row
    return min(prev) <= k


def test_myers_against_dynamic_programming():
    rnd = random.Random(6)
    for _ in range(800):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 16)))
        k = rnd.randrange(0, 4)
        assert leaks.distance_within(p, t, k) == edit_within(p, t, k)


def test_leaks_against_brute_force(spark):
    rnd = random.Random(8)
    items = [(i, "".join(rnd.choice("甲乙丙丁戊己庚辛") for _ in range(60)), " ".join(rnd.choice(["a", "bb", "cc", "dd"]) for _ in range(30)) if i % 2 else None) for i in range(6)]
    items = [(i, None if i % 2 else z, e) for i, z, e in items] + [(99, "短", None), (98, None, "")]
    docs = []
    for d in range(150):
        i, z, e = items[rnd.randrange(6)]
        units = list(z) if z else e.split()
        n = rnd.randrange(5, len(units))
        a = rnd.randrange(0, len(units) - n + 1)
        piece = units[a : a + n]
        if rnd.random() < 0.3:
            piece[rnd.randrange(n)] = "壬" if z else "zz"
        joined = "，​".join(piece) if z else ("  " if rnd.random() < 0.5 else "\n").join(piece).upper()
        docs.append((d, f"前言 {joined} end", 1))
    docs += [(500, None, 1), (501, "", 1)]
    fields = {}
    for i, z, e in items:
        fields[i] = (list(z), 24) if z else (leaks.words(e), 12)
    want = set()
    for d, t, _ in docs:
        for i, (u, n) in fields.items():
            have = list("".join(leaks.words(t))) if n == 24 else leaks.words(t)
            grams = {tuple(have[k : k + n]) for k in range(len(have) - n + 1)}
            if any(tuple(u[k : k + n]) in grams for k in range(len(u) - n + 1)):
                want.add((d, i))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, q string, a string"), "doc_id", "text", "item_id", ["q", "a"])
    assert {(r.doc_id, r.item_id) for r in got.where("run >= `window`").collect()} == want and want
    few = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, q string, a string"), "doc_id", "text", "item_id", ["q", "a"], most=300)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, got.collect()))


def test_leak_unit_is_that_of_the_item(spark):
    words = [f"word{chr(97 + i)}" for i in range(14)]
    items = spark.createDataFrame([(1, "The term 接触线 is asked for. " + " ".join(words), None)], "item_id long, q string, a string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[:12])), (2, "x " + " ".join(words[:10]))], "doc_id long, text string")
    got = leaks.leaks(docs, items, "doc_id", "text", "item_id", ["q", "a"])
    assert [(r.doc_id, r.run, r.window) for r in got.where("run >= `window`").collect()] == [(1, 12, 12)]


# --- 8 mixing


def test_mixing(spark):
    words = "the contact wire is checked by the patroller every day "
    rows = [(i, words * (1 + i % 9), "Big Source") for i in range(600)] + [(1000 + i, words * (1 + i % 5), "mid-source ") for i in range(200)] + [(2000 + i, words, "tiny") for i in range(5)]
    rows += [(3000, words, None), (3001, None, "tiny"), (3002, "", "tiny"), (3003, words, "unlisted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big_source", 0.4, 1), ("mid_source", 0.4, 4), ("tiny", 0.1, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.plan(mixing.sized(docs, targets, "doc_id", "text", "source", queries.TOKENIZER), targets)
    got = {r.source: r for r in mixing.shares(mixed, report).collect()}
    for s in ("big_source", "mid_source"):
        assert abs(got[s].mixed_tokens - got[s].goal_tokens) < 0.02 * got[s].goal_tokens and not got[s].capped
    assert got["tiny"].capped and got["tiny"].copies == 15 and got["absent"].mixed_tokens == 0 and got["absent"].capped
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    for r in mixed.collect():
        assert np.floor(r.rate) <= r.copies <= np.ceil(r.rate + 1e-6) and r.copies <= {"big_source": 1, "mid_source": 4, "tiny": 3}[r.source]
    # the weighted sizes meet the goals and the rates are an exponential tilt where they are not capped
    one = mixed.where("source = 'big_source' and rate < 0.999").select("tokens", "rate").distinct().orderBy("tokens").toPandas()
    slope = np.log(one["rate"]) / one["tokens"]
    assert slope.max() - slope.min() < 1e-9
    empty, none = mixing.plan(mixing.sized(docs.limit(0), targets, "doc_id", "text", "source", queries.TOKENIZER), targets)
    assert {r.mixed_tokens for r in mixing.shares(empty, none).collect()} == {0}


# --- 9 languages

SAMPLES = {
    "zh": ["接触线每天清扫一次。", "断路器表面若有放电痕迹，应拍照并编号。", "值班员提醒新员工先看风向。"],
    "ja": ["がいしの清掃は毎日行います。", "架線の張力を調整しました。", "報告書の番号を確かめます。"],
    "en": ["The wire is cleaned every day.", "Discharge marks on the breaker are photographed.", "The operator reminds newcomers of the wind."],
    "de": ["Der Isolator wird alle Tage gereinigt.", "Bei Regen werden keine Leitungen gewechselt.", "Bitte die Stange nach der Arbeit nicht vergessen."],
    "fr": ["La nuit, on travaille toujours à deux.", "Le rapport porte un numéro de série.", "Veuillez resserrer les boulons de la console."],
    "ru": ["В дождь изоляторы не меняют.", "Ночью работают не менее двух человек.", "На занятии разбирали порядок работы."],
}


def test_language_scores_are_those_of_the_fitted_machines():
    w = np.random.default_rng(3).normal(size=(1 << 15) + 1) / 9
    model = langid.LanguageModel({"latin": ["de", "en"]}, {("de", "en"): w}, letters={"latin": {"LATIN": -0.1, "": -9.0}})
    for s in ("making taking baking", "the other brother", "ein kleines eigenes"):
        x = langid.features(s)
        z = 3 * (w[x].sum() / len(x) ** 0.5 + w[-1])
        assert model.scores(s)["de"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_language_machines_see_all_sentences(monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "_svm", lambda xs, ys: seen.append(len(xs)) or np.zeros((1 << 15) + 1))
    names = ["".join(c) for c in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4), 40_100)]
    langid.LanguageModel.fit([("de" if i % 2 else "en", n) for i, n in enumerate(names)])
    assert seen[0] == 40_100


def test_languages(spark):
    rnd, rows = random.Random(9), []
    for i in range(360):
        lang = list(SAMPLES)[i % 6]
        label = lang if rnd.random() < 0.85 else rnd.choice(list(SAMPLES))
        rows.append((i, "\n".join(rnd.choice(SAMPLES[lang]) for _ in range(4)), rnd.choice([label, label.upper(), f"{label}-XX"])))
    mixed = SAMPLES["zh"][0] + "\n" + "\n".join(SAMPLES["en"][:2]) + "\n" + SAMPLES["ru"][0]
    rows += [(900, mixed, "zh"), (901, "接触线的英文是“contact wire”。" + SAMPLES["zh"][1], "zh_Hans"), (902, None, "en"), (903, "", "en"), (904, "12-3 ...", "en"), (905, SAMPLES["de"][0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = sentences.train(df, "text")
    model = langid.train(df, "text", "lang", "doc_id", m)
    found = langid.segments(df, "text", "lang", "doc_id", m, model)
    got = {}
    for r in found.orderBy("doc_id", "seg_no").collect():
        got.setdefault(r.doc_id, []).append(r.seg_lang)
        assert 0 <= r.confidence <= 1
    assert [got.get(i) for i in range(360)] == [[list(SAMPLES)[i % 6]] for i in range(360)]
    assert got[900] == ["zh", "en", "ru"] and got[901] == ["zh"] and got[905] == ["de"] and not {902, 903, 904} & set(got)
    wrong = {r.doc_id for r in langid.mislabelled(found).collect()}
    assert {900, 905} <= wrong and 901 not in wrong
    assert langid.segments(df.limit(0), "text", "lang", "doc_id", m, model).count() == 0
