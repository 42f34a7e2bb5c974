"""The queries of the problems, over whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamnan.functions.cluster import broadcast_if_small, read, spread
from tamnan.llm import chunking, confusables, consensus, leakage, mojibake, packing, qa_defects, residue, scan_noise, sentences

CODES = [0, 1, 2, 3]
#: Where the public tokenizers' vocabulary files are.
TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def _texts(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    return spread(read(spark, sf, table).select(*columns))


def _labels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(standing codes of known questions, questions as (item, grp))."""
    questions = read(spark, sf, "questions").select(F.col("id").alias("item"), F.coalesce("phrasing", F.lit("")).alias("grp"), consensus.id_key(F.col("id")).alias("k"))
    coded = read(spark, sf, "coding_round6").withColumn("k", consensus.id_key(F.col("id")))
    joined = coded.join(questions.select("k", "item"), "k").select("item", F.col("assessor").alias("annotator"), "code", "coded_at", F.col("row_id").alias("order_id"))
    return consensus.standing_codes(joined, CODES), questions.select("item", "grp")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    labels, groups = _labels(spark, sf)
    post, _ = consensus.consensus(labels, CODES, groups)
    return post.where("n_codes > 1").select(F.col("item").alias("id"), consensus.best_code(F.col("posterior"), CODES).alias("code"))


def p1_consensus(spark: SparkSession, sf: str) -> DataFrame:
    labels, groups = _labels(spark, sf)
    post, _ = consensus.consensus(labels, CODES, groups)
    return post.select(F.col("item").alias("id"), "n_labels", "n_codes", consensus.best_code(F.col("posterior"), CODES).alias("code"), F.round(F.array_max("posterior"), 6).alias("probability"))


def p1_reliability(spark: SparkSession, sf: str) -> DataFrame:
    labels, groups = _labels(spark, sf)
    post, confusions = consensus.consensus(labels, CODES, groups)
    return consensus.reliability(confusions, labels, post, CODES).select(F.col("annotator").alias("assessor"), "n_labels", F.round("accuracy", 6).alias("accuracy"), F.round("information", 6).alias("information"))


def p1_agreement(spark: SparkSession, sf: str) -> DataFrame:
    alpha = consensus.krippendorff_alpha(_labels(spark, sf)[0])
    return alpha.select("n_items", "n_labels", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.repair_garbled(_texts(spark, sf, "passages", "passage_id", "text"), "passage_id").where("garbled").select("passage_id")


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.repair_garbled(_texts(spark, sf, "passages", "passage_id", "text"), "passage_id").where("garbled").select("passage_id", "encodings", "lossy", "restored")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    wanted = read(spark, sf, "sentence_check").select("passage_id").distinct()
    passages = read(spark, sf, "passages").select("passage_id", "text").join(broadcast_if_small(wanted), "passage_id", "left_semi")
    return sentences.sentence_units(passages, corpus=_texts(spark, sf, "passages", "text")).select("passage_id", "end_pos")


def p3_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(_texts(spark, sf, "passages", "passage_id", "text"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_oversized(read(spark, sf, "passages"), read(spark, sf, "size_limits"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).where("oversized AND piece = 0").select("passage_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.repair_scans(_texts(spark, sf, "passages", "passage_id", "text"), with_text=False).select("passage_id")


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.repair_scans(_texts(spark, sf, "passages", "passage_id", "text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return qa_defects.pair_defects(_texts(spark, sf, "answers", "answer_id", "question", "answer", "in_scope"))


def _lookalikes(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.lookalike_groups([(read(spark, sf, "docs"), "doc_no", "short", "docs.short"), (_texts(spark, sf, "passages", "passage_id", "text"), "passage_id", "text", "passages.text")])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.lookalike_pairs(_lookalikes(spark, sf))


def p7_classes(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.lookalike_classes(_lookalikes(spark, sf))


def p7_normal_passages(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.normalised(_texts(spark, sf, "passages", "passage_id", "text"), ["text"]).select("passage_id", "text_norm")


def p7_normal_docs(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.normalised(read(spark, sf, "docs").select("doc_no", "short"), ["short"])


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    # the table of limits is fixed: one row for documents
    capacity = read(spark, sf, "size_limits").where("scope = 'documents' AND size_unit = 'tokens'").agg(F.min("max_size")).first()[0]
    return packing.pack_documents(packing.token_counts(_texts(spark, sf, "documents", "doc_id", "text"), TOKENIZER), int(capacity))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    packed = p8_containers(spark, sf).groupBy("container_id").agg(F.sum("tokens").alias("load"))
    return packed.agg(F.count("*").alias("containers"), F.max("load").alias("largest"), F.round(F.avg("load"), 3).alias("mean_load"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    hits = leakage.leaks(_texts(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "holdout_questions"))
    return leakage.leaked_items(hits).select("doc_id", "item_id")


def p9_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents").select("doc_id", "text")
    return leakage.without_spans(documents, leakage.leaks(spread(documents), read(spark, sf, "holdout_questions")))


def p10_clean(spark: SparkSession, sf: str) -> DataFrame:
    documents = _texts(spark, sf, "documents", "doc_id", "text")
    return residue.without_residue(documents, residue.find_residue(documents)).select("doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find_residue(_texts(spark, sf, "documents", "doc_id", "text")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_consensus, p1_reliability, p1_agreement, p2_found, p2_restored, p3_found, p3_units, p4_found, p4_pieces, p5_found, p5_repaired, p6_found, p7_found, p7_classes, p7_normal_docs, p7_normal_passages, p8_containers, p8_fill, p9_found, p9_cleaned, p10_found, p10_clean)}

_CODING = """
WITH q AS (SELECT id, lower(regexp_replace(translate(id, '０１２３４５６７８９ａｂＵ', '0123456789abU'), '[^0-9A-Za-z]', '', 'g')) AS k FROM questions),
c AS (SELECT *, lower(regexp_replace(translate(id, '๐๑๒๓๔๕๖๗๘๙０１２３４５６７８９ａｂｕＵ', '01234567890123456789abuU'), '[^0-9A-Za-z]', '', 'g')) AS k FROM coding_round6 WHERE code BETWEEN 0 AND 3),
s AS (SELECT q.id AS item, c.assessor, arg_max(c.code, (c.coded_at, c.row_id)) AS code FROM c JOIN q USING (k) GROUP BY 1, 2)
"""

SQL = {
    "p1_agreement": _CODING
    + """, n AS (SELECT item, code, count(*) AS n FROM s GROUP BY 1, 2),
i AS (SELECT item, sum(n) AS m, sum(n * n) AS sq FROM n GROUP BY 1 HAVING sum(n) > 1),
t AS (SELECT count(*) AS n_items, sum(m) AS n_labels, sum((m * m - sq) / (m - 1)::DOUBLE) AS dis FROM i),
g AS (SELECT sum(nc * nc) AS sq FROM (SELECT code, sum(n) AS nc FROM n JOIN i USING (item) GROUP BY 1))
SELECT n_items::BIGINT AS n_items, n_labels::BIGINT AS n_labels, round(dis / n_labels, 6) AS observed,
  round((n_labels * n_labels - sq) / (n_labels * (n_labels - 1))::DOUBLE, 6) AS expected,
  round(1 - (dis / n_labels) / ((n_labels * n_labels - sq) / (n_labels * (n_labels - 1))::DOUBLE), 6) AS alpha FROM t, g""",
    "p4_found": "SELECT passage_id FROM passages JOIN size_limits ON scope = kind WHERE size_unit = 'characters' AND length(text) > max_size",
}
