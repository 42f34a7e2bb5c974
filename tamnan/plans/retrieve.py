"""Retrieval queries.  The query block is every held-out item whose id is divisible by 20, against all documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import broadcast_if_small, cut_lineage, ensure_checkpoint_dir, read, spread
from tamnan.operators import retrieval as R
from tamnan.operators import text as T


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", "text"))


_INDEXES: dict[tuple, R.Index] = {}


def _index(spark: SparkSession, sf: str, cut_up: Callable[[Column], Column] = T.tokens) -> R.Index:
    """The stored index of the documents, built once a session and set of files, in the shared folder."""
    docs = read(spark, sf, "documents")
    key = (spark.sparkContext.applicationId, sf, cut_up.__name__, *docs.inputFiles())
    if key not in _INDEXES:
        _INDEXES[key] = R.Index.build(_docs(spark, sf), f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", cut_up=cut_up)
    return _INDEXES[key]


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "holdout_questions").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("question").alias("text"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of documents; a document without one is never in the dense list."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return v.join(_docs(spark, sf).select("doc_id"), "doc_id", "left_semi")


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return v.join(broadcast_if_small(_queries(spark, sf).select("qid")), "qid", "left_semi")


_TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"
_INDEX = f"""tok AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents),
post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY 1, 2, 3),
sz AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, sz),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""q AS (SELECT item_id AS qid, question AS text FROM holdout_questions WHERE item_id % 20 = 0),
qt AS (SELECT qid, term, count(*) AS n FROM (SELECT qid, unnest({_TOK.format('text')}) AS term FROM q) GROUP BY 1, 2),
{_INDEX},
bm AS (SELECT qid, doc_id, sum(qt.n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term), sz GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT qid, doc_id, score AS lexical_score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS lexical_rank FROM bm WHERE score > 0) WHERE lexical_rank < 30)"""
_DENSE = """qv AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM holdout_questions WHERE item_id % 20 = 0)),
dn AS (SELECT qid, e.vec_id AS doc_id, list_dot_product(e.embedding::DOUBLE[], qv.v::DOUBLE[]) AS score FROM embeddings e, qv WHERE e.vec_id IN (SELECT doc_id FROM documents)),
den AS (SELECT * FROM (SELECT qid, doc_id, score AS dense_score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS dense_rank FROM dn) WHERE dense_rank < 30)"""
_FUSED = f"""{_BM25}, {_DENSE},
old AS (SELECT d.doc_id FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS f FROM documents GROUP BY 1) g ON sha256(d.text) = g.h WHERE d.doc_id > g.f),
fused AS (SELECT qid, doc_id, dense_score, lexical_score, dense_rank, lexical_rank, coalesce(1.0 / (61 + dense_rank), 0) + coalesce(1.0 / (61 + lexical_rank), 0) AS rrf FROM den FULL JOIN lex USING (qid, doc_id)),
pen AS (SELECT f.*, o.doc_id IS NOT NULL AS superseded, rrf * CASE WHEN o.doc_id IS NOT NULL THEN 0.6 ELSE 1 END AS score FROM fused f LEFT JOIN old o USING (doc_id))"""
_SEATED = f"""{_FUSED},
s1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN NOT superseded THEN dense_rank END NULLS LAST, doc_id) AS d,
  row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN NOT superseded THEN lexical_rank END NULLS LAST, doc_id) AS l FROM pen),
s2 AS (SELECT *, coalesce((NOT superseded AND dense_rank IS NOT NULL AND d <= 2) OR (NOT superseded AND lexical_rank IS NOT NULL AND l <= 3), false) AS seat FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seat DESC, round(score, 9) DESC, doc_id) AS f FROM s2),
fin AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS pos FROM s3 WHERE f <= 8)"""


@register(f"SELECT doc_id, {_TOK.format('text')} AS tokens FROM documents")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@register(f"WITH {_INDEX} SELECT doc_id, dl::INTEGER AS dl, term, tf, least(tf, 255)::INTEGER AS tf_byte FROM tf")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return R.postings(_docs(spark, sf)).withColumn("tf_byte", F.least("tf", F.lit(255)).cast("int"))


@register(f"WITH {_INDEX} SELECT term, df FROM df")
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return R.document_frequency(_docs(spark, sf))


@register(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf, round(greatest(idf, 0), 6) AS rarity FROM idf")
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round(F.greatest("idf", F.lit(0.0)), 6).alias("rarity"))


@register(f"WITH {_BM25} SELECT qid, doc_id, round(score, 6) AS score FROM bm")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(_queries(spark, sf), _index(spark, sf)).select("qid", "doc_id", F.round("score", 6).alias("score"))


@register(f"WITH {_BM25.replace('question AS text', chr(39) + ' ' + chr(39) + ' || question || ' + chr(39) + ' ' + chr(39) + ' || question AS text')} SELECT qid, doc_id, round(score, 6) AS score FROM bm")
def bm25_repeat_token(spark: SparkSession, sf: str) -> DataFrame:
    """The question twice: repeated query words count again."""
    twice = _queries(spark, sf).select("qid", F.concat(F.lit(" "), "text", F.lit(" "), "text").alias("text"))
    return R.bm25(twice, _index(spark, sf)).select("qid", "doc_id", F.round("score", 6).alias("score"))


@register(f"WITH {_BM25} SELECT qid, doc_id, lexical_rank::INTEGER AS lexical_rank, round(lexical_score, 6) AS lexical_score FROM lex")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = R.bm25(_queries(spark, sf), _index(spark, sf)).where("score > 0")
    return R.ranked(s, R.P.top_lexical, "lexical").select("qid", "doc_id", "lexical_rank", F.round("lexical_score", 6).alias("lexical_score"))


@register(f"WITH {_DENSE} SELECT qid, doc_id, dense_rank::INTEGER AS dense_rank, round(dense_score, 6) AS dense_score FROM den")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = R.dense_top(_query_vectors(spark, sf), _vectors(spark, sf), R.P.top_dense)
    return R.ranked(s, R.P.top_dense, "dense").select("qid", "doc_id", "dense_rank", F.round("dense_score", 6).alias("dense_score"))


@register(
    """WITH q AS (SELECT vec_id AS qid, embedding AS v, label FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT qid, e.label, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[]), 9) DESC, e.vec_id) AS r FROM embeddings e, q WHERE e.vec_id <> qid),
    v AS (SELECT qid, label, count(*) AS votes FROM s WHERE r <= 10 GROUP BY 1, 2)
    SELECT qid, label AS voted, votes FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) = 1"""
)
def nearest_label_vote(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    s = R.dense_top(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), 10, same=False)
    near = R.ranked(s, 10, "n").join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    votes = near.groupBy("qid", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("qid").orderBy(F.desc("votes"), "label")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", F.col("label").alias("voted"), "votes")


@register("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding)::INTEGER AS dims FROM embeddings")
def vector_norm_check(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.size("embedding").alias("dims"))


@register(
    """WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding, lambda x: round(x::DOUBLE, 2)) AS r FROM embeddings)
    SELECT vec_id, round(list_dot_product(a, r) / sqrt(list_dot_product(r, r) * list_dot_product(a, a)), 6) AS cosine FROM b"""
)
def embedding_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Two encodings of the same vectors (full and rounded) held against each other."""
    e = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("r"))
    a, r = F.col("a"), F.col("r")
    return e.select("vec_id", F.round(R.dot(a, r) / F.sqrt(R.dot(r, r) * R.dot(a, a)), 6).alias("cosine"))


def _fused(spark: SparkSession, sf: str, p: R.Params = R.P) -> DataFrame:
    d = R.ranked(R.dense_top(_query_vectors(spark, sf), _vectors(spark, sf), p.top_dense), p.top_dense, "dense")
    lex = R.ranked(R.bm25(_queries(spark, sf), _index(spark, sf), p).where("score > 0"), p.top_lexical, "lexical")
    return R.fuse(d, lex, p)


def _penalised(spark: SparkSession, sf: str, p: R.Params = R.P) -> DataFrame:
    old = _index(spark, sf).copies.withColumn("superseded", F.lit(True))
    f = _fused(spark, sf, p).join(old, "doc_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    return f.withColumn("score", F.col("rrf") * F.when(F.col("superseded"), p.superseded).otherwise(1.0))


@register(f"WITH {_FUSED} SELECT qid, doc_id, round(rrf, 6) AS rrf, dense_rank::INTEGER AS dense_rank, lexical_rank::INTEGER AS lexical_rank FROM fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("qid", "doc_id", F.round("rrf", 6).alias("rrf"), "dense_rank", "lexical_rank")


@register(f"WITH {_FUSED} SELECT qid, doc_id, superseded, round(score, 6) AS score FROM pen")
def superseded_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return _penalised(spark, sf).select("qid", "doc_id", "superseded", F.round("score", 6).alias("score"))


@register(f"WITH {_SEATED} SELECT qid, doc_id, pos::INTEGER AS pos, round(score, 6) AS score FROM fin")
def reserved_seats(spark: SparkSession, sf: str) -> DataFrame:
    return R.seated(_penalised(spark, sf), score="score").select("qid", "doc_id", "pos", F.round("score", 6).alias("score"))


@register(
    f"""WITH {_SEATED}, g AS (SELECT qid, coalesce(max(dense_score), 0) AS max_dense FROM pen GROUP BY 1)
    SELECT qid, pos::INTEGER AS pos, doc_id, round(score, 6) AS score, round(coalesce(dense_score, 0), 6) AS dense_score, round(coalesce(lexical_score, 0), 6) AS lexical_score,
    dense_rank::INTEGER AS dense_rank, lexical_rank::INTEGER AS lexical_rank, max_dense >= 0.46 AS in_scope FROM fin JOIN g USING (qid)"""
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    x = _penalised(spark, sf).withColumn("max_dense", F.coalesce(F.max("dense_score").over(Window.partitionBy("qid")), F.lit(0.0)))
    top = R.seated(x, score="score").withColumn("in_scope", F.col("max_dense") >= R.P.gate)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return top.select("qid", "pos", "doc_id", F.round("score", 6).alias("score"), zero("dense_score"), zero("lexical_score"), "dense_rank", "lexical_rank", "in_scope")


@register(
    f"""WITH {_SEATED} SELECT qid, string_agg('[' || pos || '] ' || coalesce(title, '') || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS block
    FROM (SELECT qid, doc_id, pos FROM fin) JOIN (SELECT doc_id, title, text FROM documents WHERE text IS NOT NULL) USING (doc_id) GROUP BY 1"""
)
def hits_context_block(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieved hits of each query, a bounded list, numbered and whole, as one block."""
    hits = R.seated(_penalised(spark, sf), score="score").select("qid", "doc_id", F.col("pos").cast("int").alias("pos"))
    texts = read(spark, sf, "documents").select("doc_id", "title", "text").where("text IS NOT NULL").join(broadcast_if_small(hits), "doc_id")
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), "text")
    items = F.array_sort(F.collect_list(F.struct("pos", line.alias("l"))))
    return texts.groupBy("qid").agg(F.array_join(F.transform(items, lambda s: s["l"]), "\n\n").alias("block"))


@register(f"WITH {_FUSED} SELECT qid, round(coalesce(max(dense_score), 0), 6) AS max_dense, coalesce(max(dense_score), 0) >= 0.46 AS in_scope FROM pen GROUP BY 1")
def gate(spark: SparkSession, sf: str) -> DataFrame:
    return R.gate(_penalised(spark, sf)).select("qid", F.round("max_dense", 6).alias("max_dense"), "in_scope")


_GOLD = f"""ev AS (SELECT item_id AS qid, list_distinct({_TOK.format('evidence')}) AS t FROM holdout_questions WHERE item_id % 20 = 0),
gold AS (SELECT qid, doc_id FROM (SELECT qid, len(t) AS need, unnest(t) AS term FROM ev) JOIN tf USING (term) GROUP BY qid, doc_id, need HAVING count(*) >= 0.5 * need)"""


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least half of the different words of a question's evidence, found through the index."""
    evidence = read(spark, sf, "holdout_questions").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.array_distinct(T.tokens(F.col("evidence"))).alias("t"))
    words = broadcast_if_small(evidence.select("qid", F.size("t").alias("need"), F.explode("t").alias("term")))
    held = _index(spark, sf).postings.join(words, "term").groupBy("qid", "doc_id", "need").agg(F.count("*").alias("n"))
    return held.where(F.col("n") >= 0.5 * F.col("need")).select("qid", "doc_id")


@register(
    f"""WITH {_SEATED}, {_GOLD}, r AS (SELECT q.qid, min(pos) AS rank FROM (SELECT DISTINCT qid FROM gold) q LEFT JOIN (SELECT qid, pos FROM fin JOIN gold USING (qid, doc_id)) USING (qid) GROUP BY 1)
    SELECT count(*) AS queries, round(avg(coalesce((rank <= 1)::INTEGER, 0)), 6) AS hit1, round(avg(coalesce((rank <= 3)::INTEGER, 0)), 6) AS hit3, round(avg(coalesce((rank <= 8)::INTEGER, 0)), 6) AS hit8, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r"""
)
def hit_at_k_mrr(spark: SparkSession, sf: str) -> DataFrame:
    gold = _gold(spark, sf)
    found = R.seated(_penalised(spark, sf), score="score").select("qid", "doc_id", "pos").join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.min("pos").alias("rank"))
    r = gold.select("qid").distinct().join(found, "qid", "left")
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))), 6).alias(f"hit{k}")
    return r.agg(F.count("*").alias("queries"), hit(1), hit(3), hit(8), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@register(f"WITH {_BM25}, {_GOLD} SELECT qid, min(lexical_rank)::INTEGER AS rank0 FROM lex JOIN gold USING (qid, doc_id) GROUP BY 1")
def first_relevant_rank(spark: SparkSession, sf: str) -> DataFrame:
    lex = R.ranked(R.bm25(_queries(spark, sf), _index(spark, sf)).where("score > 0"), 30, "lexical")
    return lex.join(_gold(spark, sf), ["qid", "doc_id"]).groupBy("qid").agg(F.min("lexical_rank").alias("rank0"))


@register(
    f"""WITH {_SEATED}, {_GOLD}, g AS (SELECT gold.qid, count(*) AS gold, count(fin.doc_id) AS got FROM gold LEFT JOIN fin USING (qid, doc_id) GROUP BY 1)
    SELECT count(*) AS queries, round(avg(got / gold), 6) AS macro_recall, count(*) FILTER (got = gold) AS full_recall, list_sort(coalesce(list(qid) FILTER (got < gold), [])) AS missed FROM g"""
)
def macro_recall(spark: SparkSession, sf: str) -> DataFrame:
    final = R.seated(_penalised(spark, sf), score="score").select("qid", "doc_id", F.lit(1).alias("got"))
    g = _gold(spark, sf).join(final, ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("*").alias("gold"), F.count("got").alias("got"))
    return g.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("got") / F.col("gold")), 6).alias("macro_recall"), F.count_if(F.col("got") == F.col("gold")).alias("full_recall"), F.array_sort(F.collect_list(F.when(F.col("got") < F.col("gold"), F.col("qid")))).alias("missed"))


@register(
    f"""WITH {_FUSED}, {_GOLD}, cfg AS (SELECT wd, wl FROM (VALUES (0.0::DOUBLE), (0.25), (1.0), (3.0)) a(wd), (VALUES (0.25::DOUBLE), (1.0), (3.0)) b(wl)),
    s AS (SELECT wd, wl, qid, doc_id, row_number() OVER (PARTITION BY wd, wl, qid ORDER BY round(coalesce(wd / (61 + dense_rank), 0) + coalesce(wl / (61 + lexical_rank), 0), 9) DESC, doc_id) AS pos FROM fused, cfg),
    r AS (SELECT wd, wl, qid, min(pos) AS rank FROM s JOIN gold USING (qid, doc_id) GROUP BY 1, 2, 3)
    SELECT wd, wl, count(*) FILTER (rank <= 1) AS hit1, count(*) FILTER (rank <= 6) AS hit6, (2 * count(*) FILTER (rank <= 6) + count(*) FILTER (rank <= 1))::BIGINT AS objective FROM r GROUP BY 1, 2"""
)
def fusion_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve weightings over one retrieval pass; the grid is exploded from a literal, not joined."""
    grid = F.array(*[F.struct(F.lit(d).alias("wd"), F.lit(w).alias("wl")) for d in (0.0, 0.25, 1.0, 3.0) for w in (0.25, 1.0, 3.0)])
    x = _fused(spark, sf).select("qid", "doc_id", "dense_rank", "lexical_rank", F.explode(grid).alias("c")).select("*", "c.wd", "c.wl")
    part = lambda w, r: F.coalesce(F.col(w) / (61 + F.col(r)), F.lit(0.0))
    w = Window.partitionBy("wd", "wl", "qid").orderBy(F.round(part("wd", "dense_rank") + part("wl", "lexical_rank"), 9).desc(), "doc_id")
    r = x.withColumn("pos", F.row_number().over(w)).join(_gold(spark, sf), ["qid", "doc_id"]).groupBy("wd", "wl", "qid").agg(F.min("pos").alias("rank"))
    one, six = F.count_if(F.col("rank") <= 1), F.count_if(F.col("rank") <= 6)
    return r.groupBy("wd", "wl").agg(one.alias("hit1"), six.alias("hit6"), (2 * six + one).alias("objective"))


_CAL = """s AS (SELECT q.vec_id AS qid, max(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) FILTER (e.label = q.label) AS same,
  max(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) FILTER (e.label <> q.label) AS other FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id GROUP BY 1)"""


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.struct("vec_id", "label").alias("qid"), F.col("embedding").alias("v"))
    s = R.dense(q, e.select(F.struct("vec_id", "label").alias("doc_id"), "embedding")).where("doc_id.vec_id != qid.vec_id")
    same = F.col("doc_id.label") == F.col("qid.label")
    return s.groupBy(F.col("qid.vec_id").alias("qid")).agg(F.max(F.when(same, F.col("score"))).alias("same"), F.max(F.when(~same, F.col("score"))).alias("other"))


@register(f"WITH {_CAL} SELECT round(min(same), 6) AS same_min, round(max(same), 6) AS same_max, round(min(other), 6) AS other_min, round(max(other), 6) AS other_max, min(same) > max(other) AS separable, round((min(same) + max(other)) / 2, 6) AS threshold FROM s")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    lo, hi = F.min("same"), F.max("other")
    return _calibration(spark, sf).agg(r(lo).alias("same_min"), r(F.max("same")).alias("same_max"), r(F.min("other")).alias("other_min"), r(hi).alias("other_max"), (lo > hi).alias("separable"), r((lo + hi) / 2).alias("threshold"))


@register(f"WITH {_CAL} SELECT t::DOUBLE AS threshold, count(*) FILTER (other >= t) AS leaks, count(*) FILTER (same < t) AS misses FROM s, (VALUES (0.3), (0.46), (0.6)) x(t) GROUP BY 1")
def leak_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = _calibration(spark, sf).withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.46), F.lit(0.6))))
    return x.groupBy("threshold").agg(F.count_if(F.col("other") >= F.col("threshold")).alias("leaks"), F.count_if(F.col("same") < F.col("threshold")).alias("misses"))


@register(
    f"""WITH {_INDEX}, w AS (SELECT term, df, (SELECT n FROM sz) AS n FROM df)
    SELECT term, df FROM w WHERE df <= greatest(2, floor(n / 6)) AND length(term) >= 3"""
)
def distinctive_words(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    n = index.n_docs
    return index.terms.select("term", "df").where((F.col("df") <= max(2, n // 6)) & (F.length("term") >= 3))


@register(f"WITH {_INDEX} SELECT doc_id, list_transform(list_sort(list((df, term)))[1:3], lambda x: x[2]) AS rarest FROM (SELECT doc_id, term, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS r FROM tf JOIN df USING (term)) WHERE r <= 3 GROUP BY 1")
def rarest_words(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    x = index.postings.select("doc_id", "term").join(index.terms.select("term", "df"), "term")
    w = Window.partitionBy("doc_id").orderBy("df", "term")
    top = x.withColumn("r", F.row_number().over(w)).where("r <= 3")
    return top.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]).alias("rarest"))


@register(
    f"""WITH {_INDEX} SELECT dfreq, count(*) AS terms FROM (SELECT df AS dfreq FROM df) GROUP BY 1"""
)
def distinct_token_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).terms.select(F.col("df").alias("dfreq")).groupBy("dfreq").agg(F.count("*").alias("terms"))


_VOCAB = f"""v AS (SELECT DISTINCT term, src FROM (SELECT unnest({_TOK.format('text')}) AS term, 'p' AS src FROM passages UNION ALL SELECT unnest({_TOK.format('text')}), 'd' FROM documents)),
qw AS (SELECT DISTINCT id, term FROM (SELECT id, unnest({_TOK.format('question')}) AS term FROM questions) WHERE length(term) >= 3)"""


@register(f"WITH {_VOCAB} SELECT id, term FROM qw WHERE term IN (SELECT term FROM v WHERE src = 'd') AND term NOT IN (SELECT term FROM v WHERE src = 'p')")
def foreign_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Question words that only the second corpus knows."""
    words = lambda name, c: read(spark, sf, name).select(F.explode(F.array_distinct(T.tokens(F.col(c)))).alias("term"))
    q = read(spark, sf, "questions").select("id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term")).where(F.length("term") >= 3)
    return q.join(words("documents", "text").distinct(), "term", "left_semi").join(words("passages", "text").distinct(), "term", "left_anti").select("id", "term")


@register(
    """WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT qid, e.label < 5 AS rules, max(list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[])) AS best FROM embeddings e, q WHERE e.vec_id <> qid GROUP BY 1, 2),
    w AS (SELECT qid, max(best) FILTER (rules) AS rules, max(best) FILTER (NOT rules) AS articles FROM s GROUP BY 1)
    SELECT qid, round(rules, 6) AS rules, round(articles, 6) AS articles, CASE WHEN articles < 0.55 THEN 'none' WHEN rules < 0.46 OR articles - rules >= 0.08 THEN 'articles' ELSE 'rules' END AS route FROM w"""
)
def route_corpus(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    s = R.dense(q, e.select(F.struct("vec_id", "label").alias("doc_id"), "embedding")).where("doc_id.vec_id != qid")
    best = lambda c: F.max(F.when(c, F.col("score")))
    w = s.groupBy("qid").agg(best(F.col("doc_id.label") < 5).alias("r"), best(F.col("doc_id.label") >= 5).alias("a"))
    route = F.when(F.col("a") < 0.55, "none").when((F.col("r") < 0.46) | (F.col("a") - F.col("r") >= 0.08), "articles").otherwise("rules")
    return w.select("qid", F.round("r", 6).alias("rules"), F.round("a", 6).alias("articles"), route.alias("route"))


_CITES = "(?:ข้อ|มาตรา) [0-9]+(?:/[0-9]+)?"


@register(
    f"""WITH a AS (SELECT answer_id AS qid, list_distinct(regexp_extract_all(translate(answer, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '{_CITES}')) AS asked FROM answers WHERE answer_id % 20 = 0 AND answer IS NOT NULL),
    c AS (SELECT qid, unnest(list_distinct(list_transform(asked, lambda x: string_split(x, ' ')[2]))) AS section, asked FROM a)
    SELECT qid, passage_id, round(0.016 + CASE WHEN list_contains(asked, unit || ' ' || p.section) THEN CASE WHEN coalesce(part, 0) = 0 THEN 0.5 ELSE 0.4 END ELSE 0 END, 6)::DOUBLE AS boosted FROM c JOIN passages p ON p.section = c.section"""
)
def exact_number_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates share the cited number; those of the same unit (rule or section) are boosted."""
    asked = F.array_distinct(F.regexp_extract_all(T.arabic_digits(F.col("answer")), F.lit(f"({_CITES})")))
    a = read(spark, sf, "answers").where("answer_id % 20 = 0 AND answer IS NOT NULL").select(F.col("answer_id").alias("qid"), asked.alias("asked"))
    keys = a.select("qid", "asked", F.explode(F.array_distinct(F.transform("asked", lambda x: F.split(x, " ")[1]))).alias("section"))
    p = read(spark, sf, "passages").where("section IS NOT NULL").select("passage_id", "section", "unit", "part")
    c = p.join(broadcast_if_small(keys), "section").withColumn("score", F.lit(0.016))
    return R.exact_number_boost(c, F.col("asked"), F.concat_ws(" ", "unit", "section")).select("qid", "passage_id", F.round("boosted", 6).alias("boosted"))


@register(
    f"""WITH {_FUSED}, s AS (SELECT qid, list_distinct(regexp_extract_all(text, '(?:OSPF|DHCP|SNMP|SMTP|VLAN|ICMP|IPv6|Wi-Fi|Ethernet)')) AS subjects FROM q)
    SELECT qid, doc_id, round(rrf * CASE WHEN len(subjects) = 1 AND NOT coalesce(contains(d.title, subjects[1]), false) THEN 0.5 ELSE 1 END, 6) AS penalised FROM fused JOIN s USING (qid) JOIN documents d USING (doc_id)"""
)
def off_subject_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """A question that names exactly one subject halves the score of documents whose title doesn't hold it."""
    named = F.array_distinct(F.regexp_extract_all("text", F.lit("(OSPF|DHCP|SNMP|SMTP|VLAN|ICMP|IPv6|Wi-Fi|Ethernet)")))
    q = broadcast_if_small(_queries(spark, sf).select("qid", named.alias("subjects")))
    c = _fused(spark, sf).withColumnRenamed("rrf", "score").join(q, "qid").join(read(spark, sf, "documents").select("doc_id", "title"), "doc_id")
    return R.off_subject_penalty(c, F.col("subjects"), F.col("title")).select("qid", "doc_id", F.round("penalised", 6).alias("penalised"))


_SUBJECTS = "(?:OSPF|DHCP|SNMP|SMTP|VLAN|ICMP|IPv6|Wi-Fi|Ethernet)"
#: What a question's word is also called, and the words that must stand beside it for that.
_ALSO = [("ครู", "", "ผู้ประกอบวิชาชีพ"), ("บทลงโทษ|โทษ", "ระเบียบ|ข้อบังคับ|จรรยาบรรณ", "ภาคทัณฑ์ ตักเตือน"), ("router|Router", "", "เราเตอร์"), ("switch", "network|port|VLAN", "สวิตช์")]
_CITE_NO = "(?:ข้อ|มาตรา) [0-9]+(?:/[0-9]+)?"


def _expanded_sql(text: str) -> str:
    text = f"translate({text}, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"
    return text + "".join(f" || CASE WHEN regexp_matches({text}, '{word}') AND regexp_matches({text}, '{near}') THEN ' {more}' ELSE '' END" for word, near, more in _ALSO)


def _expanded(c: Column) -> Column:
    """Digits in one form, then the other names of words whose context holds."""
    c = T.arabic_digits(c)
    return F.concat(c, *[F.when(c.rlike(word) & c.rlike(near), f" {more}").otherwise("") for word, near, more in _ALSO])


_CHAIN = _FUSED.replace("question AS text", f"{_expanded_sql('question')} AS text").split("pen AS (")[0]
_CHAIN += f"""asks AS (SELECT qid, list_distinct(regexp_extract_all(text, '{_CITE_NO}')) AS asked, list_distinct(regexp_extract_all(text, '{_SUBJECTS}')) AS subjects FROM q),
pen AS (SELECT f.*, o.doc_id IS NOT NULL AS superseded, coalesce(list_contains(asked, nullif(regexp_extract(translate(d.text, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '{_CITE_NO}'), '')), false) AS exact,
  (rrf + CASE WHEN coalesce(list_contains(asked, nullif(regexp_extract(translate(d.text, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '{_CITE_NO}'), '')), false) THEN 0.5 ELSE 0 END)
  * CASE WHEN o.doc_id IS NOT NULL THEN 0.6 ELSE 1 END * CASE WHEN len(subjects) = 1 AND NOT coalesce(contains(d.title, subjects[1]), false) THEN 0.5 ELSE 1 END AS score
  FROM fused f JOIN asks USING (qid) JOIN documents d USING (doc_id) LEFT JOIN old o USING (doc_id))"""
_CHAIN += _SEATED[len(_FUSED) :]
_GTOK = f"flatten(list_transform({_TOK.format('text')}, lambda t: CASE WHEN regexp_matches(t, '{T.UNSPACED}') AND length(t) > 4 THEN list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4)) ELSE [t] END))"
_CHAIN = _CHAIN.replace(_TOK.format("text"), _GTOK)


@register(
    f"""WITH {_CHAIN}, g AS (SELECT qid, coalesce(max(dense_score), 0) AS max_dense, bool_or(exact) AS exact_section FROM pen GROUP BY 1)
    SELECT qid, pos::INTEGER AS pos, doc_id, round(score, 6) AS score, g.exact_section, max_dense >= 0.46 OR g.exact_section AS in_scope FROM fin JOIN g USING (qid)"""
)
def full_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain over an index that cuts up scripts without blanks: digits, expansion, both rankings, fusion, exact section, superseded and off-subject penalties, seats, and a gate that an exact section opens."""
    p = R.P
    q = _queries(spark, sf).select("qid", _expanded(F.col("text")).alias("text"))
    lex = R.ranked(R.bm25(q, _index(spark, sf, T.search_tokens)).where("score > 0"), p.top_lexical, "lexical")
    fused = R.fuse(R.ranked(R.dense_top(_query_vectors(spark, sf), _vectors(spark, sf), p.top_dense), p.top_dense, "dense"), lex)
    all_of = lambda rx: F.array_distinct(F.regexp_extract_all("text", F.lit(f"({rx})")))
    asks = broadcast_if_small(q.select("qid", all_of(_CITE_NO).alias("asked"), all_of(_SUBJECTS).alias("subjects")))
    old = _index(spark, sf, T.search_tokens).copies.withColumn("superseded", F.lit(True))
    few = cut_lineage(fused.join(asks, "qid"))  # at most both rankings of each query
    cited = F.nullif(F.regexp_extract(T.arabic_digits(F.col("text")), f"({_CITE_NO})", 1), F.lit(""))
    docs = read(spark, sf, "documents").select("doc_id", "title", "text").join(broadcast_if_small(few.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "title", cited.alias("cited"))
    x = docs.join(few, "doc_id").join(old, "doc_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    x = x.withColumn("exact", F.coalesce(F.array_contains("asked", F.col("cited")), F.lit(False)))
    x = R.exact_number_boost(x.withColumn("score", F.col("rrf")).withColumn("part", F.lit(0)), F.col("asked"), F.col("cited"))
    x = x.withColumn("score", F.col("boosted") * F.when(F.col("superseded"), p.superseded).otherwise(1.0))
    x = R.off_subject_penalty(x, F.col("subjects"), F.col("title")).withColumn("score", F.col("penalised"))
    w = Window.partitionBy("qid")
    x = x.withColumn("max_dense", F.coalesce(F.max("dense_score").over(w), F.lit(0.0))).withColumn("exact_section", F.bool_or("exact").over(w))
    return R.seated(x, score="score").select("qid", "pos", "doc_id", F.round("score", 6).alias("score"), "exact_section", ((F.col("max_dense") >= p.gate) | F.col("exact_section")).alias("in_scope"))


@register(f"WITH {_INDEX.replace(_TOK.format('text'), _GTOK)} SELECT term, df, round(idf, 6) AS idf FROM idf")
def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the index that cuts up scripts without blanks."""
    return _index(spark, sf, T.search_tokens).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register(
    f"""WITH {_FUSED}, {_GOLD}, cfg AS (SELECT wd, wl, gd, gl FROM (VALUES (1.0::DOUBLE), (1.5), (2.0), (3.0)) a(wd), (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) b(wl), (VALUES (0), (1), (2), (3)) c(gd), (VALUES (0), (1), (2)) d(gl)),
    s AS (SELECT wd, wl, gd, gl, qid, doc_id, pen.superseded, (coalesce(wd / (61 + dense_rank), 0) + coalesce(wl / (61 + lexical_rank), 0)) * CASE WHEN superseded THEN 0.6 ELSE 1 END AS v,
      NOT superseded AND (coalesce(dense_rank < gd, false) OR coalesce(lexical_rank < gl, false)) AS seat FROM pen, cfg),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY wd, wl, gd, gl, qid ORDER BY seat DESC, round(v, 9) DESC, doc_id) <= 6),
    r AS (SELECT *, row_number() OVER (PARTITION BY wd, wl, gd, gl, qid ORDER BY round(v, 9) DESC, doc_id) AS pos FROM k),
    h AS (SELECT wd, wl, gd, gl, qid, min(pos) AS rank FROM r JOIN gold USING (qid, doc_id) GROUP BY ALL),
    t AS (SELECT wd, wl, gd, gl, count(*) FILTER (rank <= 1) AS at1, count(*) FILTER (rank <= 3) AS at3, count(*) AS at6 FROM h GROUP BY ALL)
    SELECT wd, wl, gd::INTEGER AS gd, gl::INTEGER AS gl, at1, at3, at6, (2 * at6 + 2 * at1 + at3)::BIGINT AS objective, row_number() OVER (ORDER BY 2 * at6 + 2 * at1 + at3 DESC, wd, wl, gd, gl) = 1 AS best FROM t"""
)
def fusion_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """192 weightings and seatings over one retrieval pass with their objective and the best of them; the grid is exploded from a literal."""
    grid = [(d, x, a, b) for d in (1.0, 1.5, 2.0, 3.0) for x in (0.0, 0.25, 0.5, 1.0) for a in range(4) for b in range(3)]
    cfg = F.explode(F.array(*[F.struct(F.lit(d).alias("wd"), F.lit(x).alias("wl"), F.lit(a).alias("gd"), F.lit(b).alias("gl")) for d, x, a, b in grid])).alias("c")
    pen = cut_lineage(_penalised(spark, sf).select("qid", "doc_id", "dense_rank", "lexical_rank", "superseded").join(_gold(spark, sf).withColumn("gold", F.lit(True)), ["qid", "doc_id"], "left"))
    s = pen.select("*", cfg).select("qid", "doc_id", "dense_rank", "lexical_rank", "superseded", "gold", "c.*")
    part = lambda w, r: F.coalesce(F.col(w) / (61 + F.col(r)), F.lit(0.0))
    v = F.round((part("wd", "dense_rank") + part("wl", "lexical_rank")) * F.when(F.col("superseded"), 0.6).otherwise(1.0), 9)
    within = lambda r, g: F.coalesce(F.col(r) < F.col(g), F.lit(False))
    s = s.withColumn("v", v).withColumn("seat", ~F.col("superseded") & (within("dense_rank", "gd") | within("lexical_rank", "gl")))
    key = ["wd", "wl", "gd", "gl"]
    k = s.withColumn("r", F.row_number().over(Window.partitionBy(*key, "qid").orderBy(F.desc("seat"), F.desc("v"), "doc_id"))).where("r <= 6")
    r = k.withColumn("pos", F.row_number().over(Window.partitionBy(*key, "qid").orderBy(F.desc("v"), "doc_id"))).where("gold")
    h = r.groupBy(*key, "qid").agg(F.min("pos").alias("rank"))
    t = h.groupBy(*key).agg(F.count_if(F.col("rank") <= 1).alias("at1"), F.count_if(F.col("rank") <= 3).alias("at3"), F.count("*").alias("at6"))
    t = t.withColumn("objective", 2 * F.col("at6") + 2 * F.col("at1") + F.col("at3"))
    top = t.agg(F.min(F.struct((-F.col("objective")).alias("o"), *key)).alias("m"))  # one row
    one = F.lit(1).alias("one")
    same = F.struct((-F.col("objective")).alias("o"), *key) == F.col("m")
    return t.select("*", one).join(F.broadcast(top.select("m", one)), "one").select(*key, "at1", "at3", "at6", "objective", same.alias("best"))
