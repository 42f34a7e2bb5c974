"""Sources: every reader takes a schema or none and returns a DataFrame; nothing is read on the driver."""

from __future__ import annotations

import hashlib

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamnan.functions.cluster import ensure_checkpoint_dir

from tamnan.operators.ranking import ordinal_within


def parquet(spark: SparkSession, *paths: str, fill: dict | None = None) -> DataFrame:
    """Several files as one table; columns missing from one of them are null, then filled."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    return df.fillna(fill) if fill else df


def labelled(spark: SparkSession, parts: dict[str, list[str]], column: str = "split") -> DataFrame:
    """Files of several groups with the group's name in ``column``."""
    out = None
    for name, paths in parts.items():
        df = spark.read.parquet(*paths).withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def csv(spark: SparkSession, path: str, schema: StructType | str, valid: str | None = None) -> DataFrame:
    """A CSV with a header; rows that don't fit the schema fail; ``valid`` is a filter in SQL."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    return df.where(valid) if valid else df


def flag(c):
    """A flag written as true, ' True ', 1, yes or nothing."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes"), F.lit(False))


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one array or one object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def by_file_name(df: DataFrame, pattern: str, column: str, kind: str = "int") -> DataFrame:
    """What ``pattern`` captures in the name of each row's file."""
    return df.withColumn(column, F.nullif(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1), F.lit("")).try_cast(kind))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of whole text files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("pos", "line"))


def with_pages(lines: DataFrame, marker: str = r"^<!-- page (\d+) -->$") -> DataFrame:
    """Lines with the page they stand on, carried forward from page markers; the markers are dropped."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    page = F.nullif(F.regexp_extract("line", marker, 1), F.lit("")).cast("int")
    return lines.withColumn("mark", page).withColumn("page", F.last("mark", ignorenulls=True).over(w)).where("mark IS NULL").drop("mark")


def markdown_table(lines: DataFrame, columns: list[str]) -> DataFrame:
    """The body rows of markdown tables of as many cells as ``columns``."""
    cells = F.filter(F.transform(F.split(F.trim("line"), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = lines.where(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$")).select("file", "pos", cells.alias("c")).where(F.size("c") == len(columns))
    head = rows.groupBy("file").agg(F.min("pos").alias("first"))
    body = rows.join(head, "file").where("pos > first")
    return body.select("file", "pos", *[F.col("c")[i].alias(name) for i, name in enumerate(columns)])


def checked(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, sha256, ok): files against a manifest (file, sha256); a file that is missing or unknown is not ok."""
    got = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("got"))
    return got.join(manifest, "file", "full").select("file", F.col("got").alias("sha256"), F.coalesce(F.col("got") == F.col("sha256"), F.lit(False)).alias("ok"))


def extracted(spark: SparkSession, path: str, ladder: list[tuple[str, Callable[[bytes], str | None]]], good: Callable[[str], bool]) -> DataFrame:
    """(file, text, rung): the first extractor of the ladder whose text is good; null where none is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["file"].tolist(), b["content"].tolist()):
                text = rung = None
                for rung_name, f in ladder:
                    got = f(bytes(content))
                    if got is not None and good(got):
                        text, rung = got, rung_name
                        break
                rows.append((name, text, rung))
            yield pd.DataFrame(rows, columns=["file", "text", "rung"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInPandas(run, "file string, text string, rung string")


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """``ordinal``, a row number from 0 over a total order, for access by position."""
    return ordinal_within(df, [], list(order)).withColumn("ordinal", F.col("ordinal") - 1)


def cached(spark: SparkSession, paths: list[str], name: str, read) -> DataFrame:
    """What ``read()`` gives, kept as parquet in the shared folder under ``name`` and the state of ``paths`` (names, sizes, times).

    A changed file makes another key, so nothing stale is read; an unfinished write has no ``_SUCCESS`` and is made again.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    state = []
    for p in paths:
        fs = hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration())
        top = fs.getFileStatus(hadoop(p))
        for s in fs.listStatus(hadoop(p)) if top.isDirectory() else [top]:
            state.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    key = hashlib.sha256(repr((name, sorted(state))).encode()).hexdigest()[:32]
    path = f"{ensure_checkpoint_dir(spark)}/cached-{key}"
    if not hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(f"{path}/_SUCCESS")):
        read().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def workbook_list(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, rows) of a workbook's tables."""
    return spark.read.schema("no int, sheet string, rows bigint").json(f"{path}/_sheets_list").select("sheet", "rows")
