"""Retrieval over DataFrames: an inverted index, BM25, dense ranking, fusion, seats and gates.

Queries come in blocks of bounded size, so their terms and vectors are broadcast; documents never are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.functions.cluster import broadcast_if_small, cut_lineage
from tamnan.operators.text import tokens


@dataclass(frozen=True)
class Params:
    """Fixed values of the retrieval pipeline."""

    top_dense: int = 30
    top_lexical: int = 30
    top_final: int = 8
    rrf_k: int = 60
    w_dense: float = 1.0
    w_lexical: float = 1.0
    seats_dense: int = 2
    seats_lexical: int = 3
    superseded: float = 0.6
    off_subject: float = 0.5
    boost_first: float = 0.5
    boost_part: float = 0.4
    gate: float = 0.46
    k1: float = 1.5
    b: float = 0.75
    negative_idf: float = 0.25


P = Params()


def postings(docs: DataFrame, cut_up: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc_id, dl, term, tf): ``docs`` has doc_id and text.  One shuffle on (doc_id, term), combined before it."""
    cut = docs.select("doc_id", cut_up(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return cut.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df): each document counts a term once before anything is shuffled."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _raw_idf(n_docs: int) -> Column:
    return F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def mean_idf(df: DataFrame, n_docs: int) -> float:
    """Mean over all terms, before negative values are replaced."""
    return float(df.agg(F.avg(_raw_idf(n_docs))).first()[0] or 0.0)


def terms(df: DataFrame, n_docs: int, mean: float, p: Params = P) -> DataFrame:
    """(term, df, idf): logarithmic idf; a negative one becomes a share of the mean over all terms."""
    raw = _raw_idf(n_docs)
    return df.select("term", "df", F.when(raw < 0, F.lit(mean * p.negative_idf)).otherwise(raw).alias("idf"))


def corpus_size(docs: DataFrame, cut_up: Callable[[Column], Column] = tokens) -> tuple[int, float]:
    """(documents, mean length in tokens), of all documents."""
    r = docs.select(F.size(cut_up(F.col("text"))).alias("dl")).agg(F.count("*"), F.avg("dl")).first()
    return int(r[0]), float(r[1] or 0.0)


def query_terms(queries: DataFrame, cut_up: Callable[[Column], Column] = tokens) -> DataFrame:
    """(qid, term, n): repeated words count again."""
    return queries.select("qid", F.explode(cut_up(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Index:
    """A stored inverted index: postings sorted by term, terms with their idf, later copies of a text, and the corpus's size."""

    postings: DataFrame
    terms: DataFrame
    copies: DataFrame
    n_docs: int
    mean_length: float
    cut_up: Callable[[Column], Column] = tokens

    @staticmethod
    def build(docs: DataFrame, path: str, p: Params = P, cut_up: Callable[[Column], Column] = tokens) -> Index:
        """Write the index of ``docs`` (doc_id, text) under ``path``, a folder all executors share, and open it."""
        spark = docs.sparkSession
        n, length = corpus_size(docs, cut_up)
        postings(docs, cut_up).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        df = cut_lineage(stored.groupBy("term").agg(F.count("*").alias("df")))
        terms(df, n, mean_idf(df, n), p).sort("term").write.mode("overwrite").parquet(f"{path}/terms")
        superseded_copies(docs).write.mode("overwrite").parquet(f"{path}/copies")
        spark.createDataFrame([(n, length)], "n_docs bigint, mean_length double").write.mode("overwrite").parquet(f"{path}/size")
        return Index.open(spark, path, cut_up)

    @staticmethod
    def open(spark: SparkSession, path: str, cut_up: Callable[[Column], Column] = tokens) -> Index:
        """The index under ``path``; ``cut_up`` must be what it was built with."""
        size = spark.read.parquet(f"{path}/size").first()
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/copies"), size["n_docs"], size["mean_length"], cut_up)


#: Query terms up to which the stored postings are read through a pushed filter.
PUSHED_TERMS = 2_000


def bm25(queries: DataFrame, index: Index, p: Params = P) -> DataFrame:
    """(qid, doc_id, score) of all documents that share a term with a query.

    The block's terms reach the scan of the postings, which are sorted by term, as a filter, so only row groups
    that hold them are read; beyond ``PUSHED_TERMS`` they are joined, broadcast only while they are few.
    """
    wanted = query_terms(queries, index.cut_up)
    names = [r["term"] for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    cut = (lambda df: df.where(F.col("term").isin(names))) if len(names) <= PUSHED_TERMS else (lambda df: df)
    weights = broadcast_if_small(cut(index.terms).select("term", "idf").join(wanted, "term"))
    hits = cut(index.postings).join(weights, "term")
    norm = p.k1 * (1 - p.b + p.b * F.col("dl") / index.mean_length)
    part = F.col("n") * F.col("idf") * F.col("tf") * (p.k1 + 1) / (F.col("tf") + norm)
    return hits.groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; equals the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Bytes of query vectors that travel to the vectors at a time.
BLOCK_BYTES = 64 << 20


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """``queries`` (qid, v) in blocks of about ``BLOCK_BYTES``."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    n = max(1, -(-size["n"] * (size["dims"] or 1) * 8 // BLOCK_BYTES))
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def dense(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, doc_id, score): query vectors (qid, v) against all ``vectors`` (doc_id, embedding), to be reduced at once.

    Each block of queries, bounded in bytes, travels to the vectors as one array, so no vector is shuffled or repeated.
    """
    found = None
    for part in _blocks(queries):
        block = part.groupBy().agg(F.collect_list(F.struct("qid", "v")).alias("block")).withColumn("one", F.lit(1))
        scored = vectors.withColumn("one", F.lit(1)).join(F.broadcast(block), "one")
        hits = scored.select("doc_id", "embedding", F.explode("block").alias("q")).select("q.qid", "doc_id", dot(F.col("embedding"), F.col("q.v")).alias("score"))
        found = hits if found is None else found.unionByName(hits)
    return found


def dense_top(queries: DataFrame, vectors: DataFrame, top: int, same: bool = True) -> DataFrame:
    """(qid, doc_id, score) that hold the ``top`` of each query's ranking (and more, one list for each batch of vectors).

    A matrix product for each batch of vectors and block of queries; a batch passes on its own best only.  Ties go to the
    smaller id, as in ``ranked``; ``same`` is whether a document may be found for the query of its own id.
    """
    found = None
    for part in _blocks(queries):
        rows = part.where("v IS NOT NULL").toArrow()  # at most about BLOCK_BYTES
        if not rows.num_rows:
            continue
        ids, matrix = np.array(rows["qid"].to_pylist(), dtype=np.int64), np.array(rows["v"].to_pylist(), dtype=np.float64)
        block = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            qids, m = block.value
            for b in batches:
                b = b[b["embedding"].notna()].sort_values("doc_id", kind="stable")
                if not len(b):
                    continue
                docs = b["doc_id"].to_numpy()
                score = np.stack(b["embedding"].tolist()).astype(np.float64) @ m.T
                key = np.round(score, 9)
                if not same:
                    key[docs[:, None] == qids[None, :]] = -np.inf
                order = np.argsort(-key, axis=0, kind="stable")[:top]
                q = np.broadcast_to(np.arange(len(qids)), order.shape).reshape(-1)
                d = order.reshape(-1)
                keep = np.isfinite(key[d, q])
                yield pd.DataFrame({"qid": qids[q[keep]], "doc_id": docs[d[keep]], "score": score[d[keep], q[keep]]})

        hits = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), "embedding").mapInPandas(best, "qid bigint, doc_id bigint, score double")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else vectors.sparkSession.createDataFrame([], "qid bigint, doc_id bigint, score double")


def ranked(scores: DataFrame, top: int, name: str) -> DataFrame:
    """(qid, doc_id, <name>_score, <name>_rank from 0): ties go to the smaller id."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("qid", "doc_id", F.col("score").alias(f"{name}_score"), (F.col("r") - 1).alias(f"{name}_rank"))


def fuse(dense_ranks: DataFrame, lexical_ranks: DataFrame, p: Params = P) -> DataFrame:
    """Full outer join of two rankings with the weighted reciprocal-rank score ``rrf``."""
    both = dense_ranks.join(lexical_ranks, ["qid", "doc_id"], "full")
    part = lambda c, w: F.coalesce(F.lit(w) / (p.rrf_k + F.col(c) + 1), F.lit(0.0))
    return both.withColumn("rrf", part("dense_rank", p.w_dense) + part("lexical_rank", p.w_lexical))


def seated(fused: DataFrame, p: Params = P, score: str = "rrf") -> DataFrame:
    """The final list: reserved seats for the best of each ranking (superseded documents take none), filled by
    fused score, cut to ``top_final`` and ordered by fused score.  Needs a boolean ``superseded``."""
    free = ~F.coalesce(F.col("superseded"), F.lit(False))
    by_dense = Window.partitionBy("qid").orderBy(F.when(free, F.col("dense_rank")).asc_nulls_last(), "doc_id")
    by_lexical = Window.partitionBy("qid").orderBy(F.when(free, F.col("lexical_rank")).asc_nulls_last(), "doc_id")
    x = fused.withColumn("d", F.row_number().over(by_dense)).withColumn("l", F.row_number().over(by_lexical))
    seat = (free & F.col("dense_rank").isNotNull() & (F.col("d") <= p.seats_dense)) | (free & F.col("lexical_rank").isNotNull() & (F.col("l") <= p.seats_lexical))
    fill = Window.partitionBy("qid").orderBy(F.coalesce(seat, F.lit(False)).desc(), F.round(score, 9).desc(), "doc_id")
    final = Window.partitionBy("qid").orderBy(F.round(score, 9).desc(), "doc_id")
    kept = x.withColumn("f", F.row_number().over(fill)).where(F.col("f") <= p.top_final)
    return kept.withColumn("pos", F.row_number().over(final)).drop("d", "l", "f")


def superseded_copies(docs: DataFrame) -> DataFrame:
    """doc_ids whose text, by its SHA-256, also stands under a smaller id."""
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(first, "h").where("doc_id > first").select("doc_id")


def gate(results: DataFrame, p: Params = P) -> DataFrame:
    """(qid, max_dense, in_scope): the dense list alone decides."""
    best = results.groupBy("qid").agg(F.coalesce(F.max("dense_score"), F.lit(0.0)).alias("max_dense"))
    return best.withColumn("in_scope", F.col("max_dense") >= p.gate)


def exact_number_boost(candidates: DataFrame, asked: Column, cited: Column, p: Params = P) -> DataFrame:
    """``boosted``: the score, plus ``boost_first`` (part 0) or ``boost_part`` where the query names the candidate's section."""
    named = F.array_contains(asked, cited)
    extra = F.when(F.coalesce(named, F.lit(False)), F.when(F.coalesce("part", F.lit(0)) == 0, p.boost_first).otherwise(p.boost_part)).otherwise(0.0)
    return candidates.withColumn("boosted", F.col("score") + extra)


def off_subject_penalty(candidates: DataFrame, subjects: Column, title: Column, p: Params = P) -> DataFrame:
    """``penalised``: the score times ``off_subject`` where the query names exactly one subject and the title doesn't hold it."""
    off = (F.size(subjects) == 1) & ~F.coalesce(F.contains(title, F.try_element_at(subjects, F.lit(1))), F.lit(False))
    return candidates.withColumn("penalised", F.col("score") * F.when(F.coalesce(off, F.lit(False)), p.off_subject).otherwise(1.0))
