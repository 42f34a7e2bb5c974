"""Sinks: tables to files, with checks before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def appended(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Tables one after the other; columns that one lacks are null."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def index(tables: dict[str, DataFrame], path: str, buckets: int = 32) -> None:
    """Index tables as parquet folders; postings are laid out by term, so a query reads few files."""
    for name, df in tables.items():
        if name == "postings":
            df.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.parquet(f"{path}/{name}")


def report(df: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """A markdown table as text, in order.  A report is small: it is written by one task."""
    w = df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(columns) + " |",), ("|" + "---|" * len(columns),)], "value string")
    head.coalesce(1).unionByName(w.coalesce(1)).coalesce(1).write.text(path)


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, with the side that lacks them."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").where("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "left").otherwise("right").alias("missing_in"))


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """The sheets of a workbook: one CSV folder each, in order, and ``_sheets`` that names them with their rows."""
    spark = next(iter(sheets.values())).sparkSession
    names = []
    for i, (name, df) in enumerate(sheets.items()):
        csv(df, f"{path}/sheet-{i:03d}")
        names.append((i, name, spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/sheet-{i:03d}").count()))
    spark.createDataFrame(names, "no int, sheet string, rows bigint").coalesce(1).write.json(f"{path}/_sheets_list")
