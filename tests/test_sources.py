import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tamnan.operators import language as L
from tamnan.sources import readers, writers


def test_parquet_union_fills_what_is_missing(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "i int, t string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2,)], "i int").write.parquet(str(tmp_path / "b"))
    rows = readers.parquet(spark, str(tmp_path / "a"), str(tmp_path / "b"), fill={"t": ""}).orderBy("i").collect()
    assert [(r.i, r.t) for r in rows] == [(1, "a"), (2, "")]
    split = readers.labelled(spark, {"train": [str(tmp_path / "a")], "test": [str(tmp_path / "b")]})
    assert {(r.i, r.split) for r in split.collect()} == {(1, "train"), (2, "test")}


def test_csv_round_trip_and_flags(spark, tmp_path):
    df = spark.createDataFrame([(1, 'says "x", and\nmore', " True "), (2, "short", None), (3, "gone", "0")], "i int, t string, f string")
    writers.csv(df, str(tmp_path / "c"))
    back = readers.csv(spark, str(tmp_path / "c"), "i int, t string, f string", "length(t) > 4")
    assert {(r.i, r.t, r.g) for r in back.select("i", "t", readers.flag(F.col("f")).alias("g")).collect()} == {(1, 'says "x", and\nmore', True), (2, "short", False)}


def test_json_sources(spark, tmp_path):
    (tmp_path / "x_round3.json").write_text(json.dumps([{"id": "a", "code": 1}, {"id": "b", "code": None}]))
    one = readers.by_file_name(readers.json_document(spark, str(tmp_path / "x_round3.json"), "id string, code int"), r"round(\d+)", "round")
    assert {(r.id, r.code, r.round) for r in one.collect()} == {("a", 1, 3), ("b", None, 3)}
    writers.jsonl(one.drop("round"), str(tmp_path / "l"))
    assert readers.jsonl(spark, str(tmp_path / "l"), "id string, code int").count() == 2
    (tmp_path / "bad.json").write_text('{"id": "a", "code": "no number"}')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.json"), "id string, code int").collect()


def test_lines_pages_and_tables(spark, tmp_path):
    (tmp_path / "d.md").write_text("<!-- page 4 -->\n# H\ntext\n<!-- page 5 -->\n| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\n")
    lines = readers.text_lines(spark, str(tmp_path / "d.md"))
    pages = {r.line: r.page for r in readers.with_pages(lines).where("line != ''").collect()}
    assert pages["text"] == 4 and pages["| 2 | y |"] == 5
    assert {(r.a, r.b) for r in readers.markdown_table(lines, ["a", "b"]).collect()} == {("1", "x"), ("2", "y")}


def test_report_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(2, "y"), (1, "x"), (3, None)], "a int, b string")
    writers.report(df, ["a", "b"], ["a"], str(tmp_path / "r"))
    text = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert text == ["| a | b |", "|---|---|", "| 1 | x |", "| 2 | y |", "| 3 |  |"]


def test_manifest_and_ladder(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"good text")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    manifest = spark.createDataFrame([("a.bin", hashlib.sha256(b"good text").hexdigest()), ("b.bin", "0"), ("c.bin", "1")], "file string, sha256 string")
    assert {r.file: r.ok for r in readers.checked(spark, str(tmp_path), manifest).collect()} == {"a.bin": True, "b.bin": False, "c.bin": False}

    def plain(b):
        try:
            return b.decode()
        except UnicodeDecodeError:
            return None

    got = readers.extracted(spark, str(tmp_path), [("utf-8", plain), ("latin", lambda b: b.decode("latin-1"))], lambda t: len(t) > 3)
    assert {r.file: r.rung for r in got.collect()} == {"a.bin": "utf-8", "b.bin": None}


def test_ordinals_are_positions_in_a_total_order(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    rows = readers.with_ordinal(df, "k").collect()
    assert all(r.k == r.ordinal for r in rows) and len(rows) == 1000


def test_index_layout_and_keys(spark, tmp_path):
    p = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("a", 2, 1)], "term string, doc_id int, tf int")
    writers.index({"postings": p, "docs": p.select("doc_id").distinct()}, str(tmp_path / "i"), 4)
    assert spark.read.parquet(str(tmp_path / "i/postings")).where("term = 'a'").count() == 2
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.missing_in) for r in writers.both_ways(a, b, "k").collect()} == {(1, "right"), (3, "left")}
    assert writers.appended(a, b).count() == 4


WORDS = frozenset(["ตา", "กลม", "ตาก", "ลม", "ระบบ", "ดูแล", "ผู้"])


def test_segmentation():
    assert L.segment("ผู้ดูแลระบบ", WORDS) == ["ผู้", "ดูแล", "ระบบ"]
    assert L.segment("กขคระบบ", WORDS) == ["กขค", "ระบบ"]
    assert L.segment("IP 10.2.3 ระบบ", WORDS) == ["IP", " ", "10.2.3", " ", "ระบบ"]
    assert "".join(L.segment("็กเ ระบบ_x!?\n", WORDS)) == "็กเ ระบบ_x!?\n"
    assert L.soft_breaks("ผู้ดูแลระบบ", WORDS).count("​") == 2


def test_rewriting():
    assert L.resolve_pointers("Yes [1] [1]. No [9].", ["ch. 2"]) == "Yes (ch. 2). No."
    assert L.tidy_markdown("## H\n\n\n\n**b** x\n* item") == "H\n\nb x\n- item"
    assert L.unglue("end of text Title Long", ["Long", "Title Long"]) == ("end of text", "Title Long")
    assert L.merge_runs([3, 1, 2, 7, 7]) == "1-3, 7"
    assert L.modal_mismatches("ครูต้องทำ", "ครูพึงทำ") and not L.modal_mismatches("ครูต้องทำ", "ครูต้องทำ")
    assert L.corrected_modal("ครูต้องทำ", "ครูพึงทำ") == "ครูพึงทำ"
    assert L.added_negations("ห้ามเปิดเผยข้อมูล", "ครูเปิดเผยข้อมูลได้") == ["เปิดเผยข้อ"]


def test_rerank_and_embeddings(spark):
    hits = spark.createDataFrame([(1, i, i, "q", "x" * i) for i in range(1, 6)], "qid bigint, doc_id bigint, pos int, question string, text string")
    got = {r.doc_id: r.reranked for r in L.reranked(hits, lambda q, t: [float(len(x)) for x in t], keep=3).collect()}
    assert got == {3: 1, 2: 2, 1: 3, 4: 4, 5: 5}
    rows = spark.createDataFrame([(1, "some words"), (2, ""), (3, None)], "id int, t string")
    v = {r.id: r.embedding for r in L.embedded(rows, "id", "t", L.hashed_encoder(16), 16).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-9 and v[2] is None and v[3] is None
