import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tamnan.functions import cluster
from tamnan.operators import amendments, chunks, ranking, retrieval, text, verify


def test_seat_displaces_a_higher_fused_score(spark):
    rows = [(1, d, 0.9 - d / 100, d, None, None, False) for d in range(8)] + [(1, 100 + i, None, None, 5.0 - i, 20 + i, False) for i in range(2)]
    df = spark.createDataFrame(rows, "qid int, doc_id int, dense_score double, dense_rank int, lexical_score double, lexical_rank int, superseded boolean")
    part = lambda c: F.coalesce(1 / (60 + F.col(c) + 1), F.lit(0.0))
    top = retrieval.seated(df.withColumn("rrf", part("dense_rank") + part("lexical_rank")))
    ids = [r.doc_id for r in top.orderBy("pos").collect()]
    assert len(ids) == 8 and {100, 101} <= set(ids) and 7 not in ids and 6 not in ids


def test_superseded_documents_take_no_seat(spark):
    rows = [(1, d, 0.5, d, None, None, d < 2) for d in range(10)]
    df = spark.createDataFrame(rows, "qid int, doc_id int, dense_score double, dense_rank int, lexical_score double, lexical_rank int, superseded boolean")
    df = df.withColumn("rrf", 1 / (61 + F.col("dense_rank")) * F.when(F.col("superseded"), 0.1).otherwise(1.0))
    assert {r.doc_id for r in retrieval.seated(df).collect()} == set(range(2, 10))


def test_bm25_counts_repeated_words_and_skips_unknown_ones(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "dog dog bird"), (3, "fish"), (4, "ant"), (5, "bee")], "doc_id int, text string")
    index = retrieval.Index.build(docs, str(tmp_path))
    ask = lambda q: {r.doc_id: r.score for r in retrieval.bm25(spark.createDataFrame([(1, q)], "qid int, text string"), index).collect()}
    once, twice = ask("cat"), ask("cat cat unknown")
    assert set(once) == {1} and twice[1] == pytest.approx(2 * once[1])
    reopened = retrieval.Index.open(spark, str(tmp_path))
    assert (reopened.n_docs, reopened.mean_length) == (5, 1.6) == (index.n_docs, index.mean_length)


def test_dense_search_in_blocks_is_one_search(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    queries = vectors.where("doc_id % 3 = 0").selectExpr("doc_id AS qid", "embedding AS v")
    want = {(q, d): sum(a * b for a, b in zip(x, y)) for q, x in rows if q % 3 == 0 and x for d, y in rows if y}
    whole = {(r.qid, r.doc_id): r.score for r in retrieval.dense(queries, vectors).where("score is not null").collect()}
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 200)
    blocks = {(r.qid, r.doc_id): r.score for r in retrieval.dense(queries, vectors).where("score is not null").collect()}
    assert whole == pytest.approx(want) and blocks == pytest.approx(want)
    top = retrieval.ranked(retrieval.dense_top(queries, vectors, 4, same=False), 4, "n").collect()
    for q in {k[0] for k in want}:
        best = sorted(((-round(s, 9), d) for (x, d), s in want.items() if x == q and d != q))[:4]
        assert [d for _, d in best] == [r.doc_id for r in sorted((r for r in top if r.qid == q), key=lambda r: r.n_rank)]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            class sc:
                class getCheckpointDir:
                    isDefined = staticmethod(lambda: False)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError):
        cluster.ensure_checkpoint_dir(Session())


def test_text_functions(spark):
    df = spark.createDataFrame([("ข้อ ๑๒ a@b.org  x\n\n\n\ny", "<p>a &lt; b</p><script>x()</script>")], "a string, h string")
    r = df.select(text.arabic_digits("a").alias("d"), text.redact_emails(F.col("a")).alias("e"), text.tidy(F.col("a")).alias("t"), text.strip_tags(F.col("h")).alias("h"), text.cut_at_edge(F.lit("aaaa bbbb cccc"), 10).alias("c")).first()
    assert "12" in r.d and "[e-mail]" in r.e and "\n\n\n" not in r.t and r.h == "a < b" and r.c == "aaaa bbbb"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab กข\n.", max_size=400), st.integers(10, 60))
def test_chunkers_keep_the_text_and_the_limit(s, limit):
    solid = "".join(s.split())
    for f in (chunks.chunk_at_space, chunks.chunk_at_paragraph, chunks.pack_paragraphs):
        parts = f(s, limit)
        assert "".join("".join(parts).split()) == solid
        assert all(len(p) <= limit for p in parts)


def test_soft_hard_joins_a_short_tail():
    parts = chunks.soft_hard("\n".join(["x" * 100] * 8 + ["- tail"]), soft=700, hard=1400)
    assert parts[-1].endswith("- tail") and len(parts[-1]) > 200


def test_budget_lets_a_later_smaller_item_fit():
    assert chunks.budget_pick([(0, 50, 0), (1, 70, 0), (2, 40, 0), (3, 30, 1)], 120) == [0, 2, 3]


@pytest.mark.parametrize("words,value", [("เจ็ดสิบ", 70), ("สี่สิบเอ็ด", 41), ("แปดหมื่น", 80000), ("หกหมื่นแปดสิบสี่", 60084), ("เก้าล้านสามพัน", 9003000), ("แมว", None), ("", None), (None, None)])
def test_thai_numbers(words, value):
    assert verify.thai_number(words) == value


def test_number_words_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, "สิบ"), (2, None), (3, "ไม่ใช่")], "id int, w string")
    assert {r.id: r.value for r in verify.number_words(rows, "id", "w").collect()} == {1: 10, 2: None, 3: None}


def test_reorder_list():
    source = ["one", "two", "three", "four"]
    assert verify.reorder_list(["intro", "1. three", "2. one", "3. two"], source) == ["intro", "1. one", "2. two", "3. three"]
    assert verify.reorder_list(["- two", "- one"], source) == ["- two", "- one"]
    assert verify.reorder_list(["- two", "- two", "- one"], source) == ["- two", "- two", "- one"]


def test_amend():
    base = {"1": "a\nb", "2": "c"}
    got = verify.amend(base, [("replace", "1", 2, "B"), ("append", "2", None, "d"), ("set", "3", None, "new"), ("replace", "2", 9, "e")])
    assert got == {"1": "a\nB", "2": "c\nd\ne", "3": "new"} and base["1"] == "a\nb"


def test_budgeted_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(1, 40), int(rng.random() < 0.2)) for g in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, pos int, size int, priority int")
    got = {(r.g, r.pos) for r in chunks.budgeted(df, "g", 100).collect()}
    want = {(g, p) for g in range(5) for p in chunks.budget_pick([(i, s, pr) for gg, i, s, pr in rows if gg == g], 100)}
    assert got == want


def test_dense_block(spark):
    v = spark.createDataFrame([Row(doc_id=1, embedding=[1.0, 0.0]), Row(doc_id=2, embedding=[0.6, 0.8])])
    q = spark.createDataFrame([Row(qid=7, v=[0.0, 1.0])])
    assert {r.doc_id: round(r.score, 6) for r in retrieval.dense(q, v).collect()} == {1: 0.0, 2: 0.8}




def test_ordinals_and_carried_values_in_a_hot_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 50), i, rng.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v int").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] or "", r[1], r[2]))
    want, seen, last, prev = {}, {}, {}, {}
    for g, _, i, v in order:
        seen[g] = seen.get(g, 0) + 1
        before = prev.get(g)
        last[g] = v if v is not None else last.get(g)
        want[i] = (seen[g], last[g], before)
        prev[g] = i
    a = {r.i: r.ordinal for r in ranking.ordinal_within(df, ["g"], ["k", "i"]).collect()}
    b = {r.i: r.c for r in ranking.carried_within(df, ["g"], ["k", "i"], F.col("v"), "c").collect()}
    c = {r.i: r.p for r in ranking.lagged_within(df, ["g"], ["k", "i"], {"i": "p"}).collect()}
    assert {i: (a[i], b[i], c[i]) for i in a} == want
    assert ranking.ordinal_within(df.where("false"), ["g"], ["i"]).count() == 0


def test_amending_sentences_are_parsed_and_folded(spark):
    rows = [
        ("a", 1, "ให้ยกเลิกความในวรรคสองของมาตรา ๗ และให้ใช้ความต่อไปนี้แทน\n“anew”"),
        ("a", 2, "ให้เพิ่มความต่อไปนี้เป็นวรรคสามของมาตรา 7\n“more”"),
        ("a", 3, "ให้ยกเลิกมาตรา 9 และให้ใช้ความต่อไปนี้แทน \"whole\""),
        ("a", 4, "มาตรา 3 ไม่มีข้อความ"),
        ("a", 5, None),
    ]
    ops = amendments.parsed(spark.createDataFrame(rows, "act string, no int, text string"))
    got = [(r.kind, r.section, r.paragraph, r.payload) for r in ops.orderBy("no").collect()]
    assert got[:3] == [("replace", "7", 2, "anew"), ("append", "7", None, "more"), ("set", "9", None, "whole")] and got[3][0] is None and got[4][0] is None
    base = spark.createDataFrame([("a", "7", "one\ntwo"), ("a", "8", "kept"), ("b", "7", "other")], "act string, section string, body string")
    done = {(r.act, r.section): r.body for r in amendments.amended(base, ops.where("kind IS NOT NULL").withColumnRenamed("payload", "body").drop("text")).collect()}
    assert done == {("a", "7"): "one\nanew\nmore", ("a", "8"): "kept", ("a", "9"): "whole", ("b", "7"): "other"}


def test_islands_over_ranges_are_those_of_one_window(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(3000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id int, ts int, event_id int").repartition(7)
    got = {r.event_id: r.island for r in ranking.islands_within(df, ["user_id"], "ts", ["ts", "event_id"], F.lit(12)).collect()}
    want, last = {}, {}
    for u, t, e in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        n, before = last.get(u, (0, None))
        n += before is None or t - before > 12
        last[u] = (n, t)
        want[e] = n
    assert got == want
