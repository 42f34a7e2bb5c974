"""Ordered amendments applied to the sections of acts, as an aggregation and a fold inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with kind, section, paragraph and payload of an amending sentence.

    replace: a paragraph is repealed and replaced; append: paragraphs are added to a section; set: a section is
    replaced or added.  The payload is what stands in quotation marks; kind is null where there is none.
    """
    t = F.translate(F.col(text), "๐๑๒๓๔๕๖๗๘๙“”", '0123456789""')
    head = F.substring_index(t, "\n", 1)
    section = F.nullif(F.regexp_extract(head, r"มาตรา\s*([0-9]+(?:/[0-9]+)?)", 1), F.lit(""))
    ordinal = F.regexp_extract(head, "ยกเลิกความในวรรค(หนึ่ง|สอง|สาม|สี่|ห้า|หก|เจ็ด|แปด|เก้า|สิบ)", 1)
    number = F.array_position(F.array(*map(F.lit, "หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า สิบ".split())), ordinal).cast("int")
    payload = F.nullif(F.trim(F.regexp_extract(t, r'(?s)"(.*)"', 1)), F.lit(""))
    kind = F.when(ordinal != "", "replace").when(head.rlike("เพิ่มความต่อไปนี้เป็นวรรค"), "append").when(section.isNotNull(), "set")
    return rows.select("*", F.when(payload.isNotNull(), kind).alias("kind"), section.alias("section"), F.nullif(number, F.lit(0)).alias("paragraph"), payload.alias("payload"))


def _apply(body: Column, op: Column) -> Column:
    parts = F.split(body, "\n")
    inside = op["paragraph"].between(1, F.size(parts)) & body.isNotNull()
    spliced = F.array_join(F.transform(parts, lambda x, i: F.when(i == op["paragraph"] - 1, op["body"]).otherwise(x)), "\n")
    appended = F.concat_ws("\n", body, op["body"])
    return F.when(op["kind"] == "set", op["body"]).when((op["kind"] == "replace") & F.coalesce(inside, F.lit(False)), spliced).otherwise(appended)


def amended(base: DataFrame, operations: DataFrame) -> DataFrame:
    """(act, section, body) after ``operations`` (act, no, kind, section, paragraph, body) in the order of ``no``.

    A paragraph out of range and a section that isn't there are appended.  Operations are gathered by section of
    one act, whose number the acts bound; texts are folded with the built-in aggregate.
    """
    ops = operations.groupBy("act", "section").agg(F.array_sort(F.collect_list(F.struct("no", "kind", "paragraph", "body"))).alias("ops"))
    joined = base.select("act", "section", F.col("body").alias("old")).join(ops, ["act", "section"], "full")
    none = F.array().cast("array<struct<no:int,kind:string,paragraph:int,body:string>>")
    return joined.select("act", "section", F.aggregate(F.coalesce("ops", none), F.col("old"), _apply).alias("body"))
