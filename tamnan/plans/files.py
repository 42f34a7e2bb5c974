"""Sources and sinks over files of the shared folder: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import ensure_checkpoint_dir, read
from tamnan.sources import readers, writers


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@register("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path, n = _folder(spark), read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    writers.csv(n, path)
    return readers.csv(spark, path, n.schema)


@register("SELECT id, category, phrasing, question FROM questions")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls stay nulls, and columns that are null throughout stay columns."""
    path, q = _folder(spark), read(spark, sf, "questions").select("id", "category", "phrasing", "question")
    writers.jsonl(q, path)
    return readers.jsonl(spark, path, q.schema)


@register("SELECT split, count(*) AS rows FROM (SELECT 'train' AS split FROM questions UNION ALL SELECT 'test' FROM holdout_questions) GROUP BY 1")
def labelled_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two groups as one table under their group's name."""
    both = readers.labelled(spark, {"train": [f"{sf}/questions.parquet"], "test": [f"{sf}/holdout_questions.parquet"]})
    return both.groupBy("split").agg(F.count("*").alias("rows"))


@register("SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def cached_reader(spark: SparkSession, sf: str) -> DataFrame:
    """A slow reader whose result is kept by what it read: the second call opens the first one's files."""
    kept = readers.cached(spark, [f"{sf}/documents.parquet"], "lengths", lambda: read(spark, sf, "documents").select("lang", F.length("text").alias("n")))
    again = readers.cached(spark, [f"{sf}/documents.parquet"], "lengths", lambda: kept.where("false"))
    return again.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("chars"))


@register("SELECT 'by question' AS sheet, count(*) AS rows FROM questions UNION ALL SELECT 'summary', count(DISTINCT coalesce(category, '')) FROM questions")
def workbook_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook's sheets as tables of one folder with a list of them."""
    q, path = read(spark, sf, "questions"), _folder(spark)
    writers.workbook({"by question": q.select("id", "category", "question"), "summary": q.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"))}, path)
    return readers.workbook_list(spark, path)
