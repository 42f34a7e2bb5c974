"""Operators that need no table of their own: citations, names, amendments, context blocks, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import read
from tamnan.operators import language as L
from tamnan.operators import text as T
from tamnan.operators import verify as V


@register("SELECT doc_no, CASE WHEN contains(short, ' et al.') OR contains(short, ' และคณะ') THEN 'many' WHEN contains(short, ' & ') THEN 'two' ELSE 'one' END AS authors, try_cast(nullif(regexp_extract(short, '\\(([0-9]{4})\\)', 1), '') AS INTEGER) AS year FROM docs WHERE regexp_matches(short, '\\([0-9]{4}\\)')")
def author_form(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("short")
    form = F.when(F.contains(s, F.lit(" et al.")) | F.contains(s, F.lit(" และคณะ")), "many").when(F.contains(s, F.lit(" & ")), "two").otherwise("one")
    return read(spark, sf, "docs").where(s.rlike(r"\([0-9]{4}\)")).select("doc_no", form.alias("authors"), F.nullif(F.regexp_extract(s, r"\(([0-9]{4})\)", 1), F.lit("")).try_cast("int").alias("year"))


@register("SELECT passage_id, sysid, coalesce(unit || ' ' || section, heading, '') AS citation, concat_ws(' ', sysid, unit, section) AS header FROM passages")
def citation_label(spark: SparkSession, sf: str) -> DataFrame:
    both = F.when(F.col("unit").isNotNull() & F.col("section").isNotNull(), F.concat("unit", F.lit(" "), "section"))
    return read(spark, sf, "passages").select("passage_id", "sysid", F.coalesce(both, F.col("heading"), F.lit("")).alias("citation"), F.concat_ws(" ", "sysid", "unit", "section").alias("header"))


@register("SELECT passage_id, coalesce(sysid, '') || ' มาตรา ' || coalesce(section, '-') || chr(10) || text AS indexed FROM passages WHERE kind = 'regulation'")
def indexed_text(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.coalesce("sysid", F.lit("")), F.lit(" มาตรา "), F.coalesce("section", F.lit("-")), F.lit("\n"))
    return read(spark, sf, "passages").where("kind = 'regulation'").select("passage_id", F.concat(head, "text").alias("indexed"))


@register(
    """WITH p AS (SELECT sysid, passage_id, row_number() OVER (PARTITION BY sysid ORDER BY passage_id) AS n, left(text, 120) AS t, coalesce(heading, '') AS h FROM passages)
    SELECT sysid, string_agg('[' || n || '] ' || h || chr(10) || t, chr(10) || chr(10) ORDER BY n) AS block FROM p WHERE n <= 6 GROUP BY 1"""
)
def context_block(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered passages of each document as one block of at most six."""
    p = read(spark, sf, "passages").withColumn("n", F.row_number().over(Window.partitionBy("sysid").orderBy("passage_id"))).where("n <= 6")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.left("text", F.lit(120)))
    items = F.array_sort(F.collect_list(F.struct("n", line.alias("l"))))
    return p.groupBy("sysid").agg(F.array_join(F.transform(items, lambda s: s["l"]), "\n\n").alias("block"))


@register(
    """WITH d AS (SELECT doc_no, trim(regexp_replace(act, '\\s*\\(ฉบับที่.*$', '')) AS base, try_cast(nullif(regexp_extract(act, 'ฉบับที่ ([0-9]+)', 1), '') AS INTEGER) AS no FROM docs WHERE act IS NOT NULL)
    SELECT a.doc_no, b.doc_no AS amends FROM d a JOIN d b ON a.base = b.base AND a.doc_no <> b.doc_no AND a.no > coalesce(b.no, 1)"""
)
def amendment_links(spark: SparkSession, sf: str) -> DataFrame:
    """Amending and amended acts of one name, by issue number."""
    d = read(spark, sf, "docs").where("act IS NOT NULL").select("doc_no", F.trim(F.regexp_replace("act", r"\s*\(ฉบับที่.*$", "")).alias("base"), F.nullif(F.regexp_extract("act", "ฉบับที่ ([0-9]+)", 1), F.lit("")).try_cast("int").alias("no"))
    b = d.select(F.col("doc_no").alias("amends"), "base", F.col("no").alias("bno"))
    return d.join(b, "base").where("doc_no != amends AND no > coalesce(bno, 1)").select("doc_no", "amends")


@register(
    """WITH a AS (SELECT answer_id, unnest(list_distinct(regexp_extract_all(answer, 'มาตรฐาน [A-Z]+-[0-9]+'))) AS mention FROM answers),
    k AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'มาตรฐาน [A-Z]+-[0-9]+')) AS mention FROM passages) SELECT answer_id, mention FROM a WHERE mention NOT IN (SELECT mention FROM k)"""
)
def unknown_instruments(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments an answer names that no passage names."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(มาตรฐาน [A-Z]+-[0-9]+)")))
    a = read(spark, sf, "answers").select("answer_id", F.explode(found("answer")).alias("mention"))
    return a.join(read(spark, sf, "passages").select(F.explode(found("text")).alias("mention")).distinct(), "mention", "left_anti").select("answer_id", "mention")


@register("SELECT doc_id, len(regexp_extract_all(text, '(?m)^หมวด [0-9๐-๙]+$'))::INTEGER AS chapters, len(regexp_extract_all(text, '(?m)^(?:ข้อ|มาตรา) [0-9๐-๙]+'))::INTEGER AS sections FROM documents")
def chapter_headings(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p)))
    return read(spark, sf, "documents").select("doc_id", count("(?m)(^หมวด [0-9๐-๙]+$)").alias("chapters"), count("(?m)(^(?:ข้อ|มาตรา) [0-9๐-๙]+)").alias("sections"))


@register("SELECT doc_id, CASE WHEN strpos(text, 'ข้าพเจ้า ....') > 0 THEN left(text, strpos(text, 'ข้าพเจ้า ....') - 1) ELSE text END AS body FROM documents")
def cut_tail(spark: SparkSession, sf: str) -> DataFrame:
    at = F.instr("text", "ข้าพเจ้า ....")
    return read(spark, sf, "documents").select("doc_id", F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("body"))


@register(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT doc_id, try_cast(translate(regexp_extract(line, '^(?:ข้อ|มาตรา) ([0-9๐-๙]+)', 1), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS INTEGER) AS n FROM l WHERE regexp_matches(line, '^(?:ข้อ|มาตรา) [0-9๐-๙]'))
    SELECT doc_id, max(n)::INTEGER AS last, count(DISTINCT n) AS present, (max(n) - count(DISTINCT n))::BIGINT AS missing FROM s GROUP BY 1"""
)
def sequence_complete(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("^(?:ข้อ|มาตรา) [0-9๐-๙]"))
    n = T.arabic_digits(F.regexp_extract("line", "^(?:ข้อ|มาตรา) ([0-9๐-๙]+)", 1)).try_cast("int")
    return line.select("doc_id", n.alias("n")).groupBy("doc_id").agg(F.max("n").alias("last"), F.count_distinct("n").alias("present"), (F.max("n") - F.count_distinct("n")).alias("missing"))


@register("SELECT c.name AS table_name, c.n FROM (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'passages', count(*) FROM passages UNION ALL SELECT 'docs', count(*) FROM docs UNION ALL SELECT 'vectors', count(*) FROM embeddings) c")
def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, table in (("documents", "documents"), ("passages", "passages"), ("docs", "docs"), ("vectors", "embeddings")):
        part = read(spark, sf, table).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


#: A small dictionary; any set of words can be given.
WORDS = frozenset("การ ความ ผู้ ดูแล ระบบ ตรวจ สอบ เครือ ข่าย ครู โรงเรียน วิทยาลัย ข้อมูล มาตรา ข้อ และ หรือ ของ ใน ที่ ให้ ตาม โดย ต้อง เพื่อ จาก ผ่าน ใช้ สวิตช์ เราเตอร์ ทะเบียน ใบอนุญาต".split())


@register()
def dictionary_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return L.segmented(read(spark, sf, "passages"), "passage_id", "text", WORDS)


@register()
def tidy_answers(spark: SparkSession, sf: str) -> DataFrame:
    return L.rewritten(read(spark, sf, "answers"), "answer_id", "answer", L.tidy_markdown)


@register()
def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return L.embedded(read(spark, sf, "questions"), "id", "question", L.hashed_encoder(64), 64)


@register()
def resolved_pointers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in brackets as the sources they point to."""
    return L.applied(read(spark, sf, "answers"), "answer_id", ["answer", "sources"], lambda a, s: L.resolve_pointers(a, list(s)), "string", "answer")


@register()
def reordered_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of an answer in the order of the question's passages: here of the text itself, sorted, as the source."""
    d = read(spark, sf, "documents").where("text IS NOT NULL")
    return L.applied(d, "doc_id", ["text"], lambda t: "\n".join(V.reorder_list(t.split("\n"), sorted(t.split("\n")))), "string", "text")


@register()
def number_word_values(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of Thai number words in the passages and what they are worth."""
    runs = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("((?:ศูนย์|หนึ่ง|เอ็ด|สอง|ยี่|สาม|สี่|ห้า|หก|เจ็ด|แปด|เก้า|สิบ|ร้อย|พัน|หมื่น|แสน|ล้าน){2,})"))))
    return V.number_words(read(spark, sf, "passages").select(runs.alias("words")).distinct().select("words", F.col("words").alias("w")), "words", "w")


@register()
def modal_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that say must where their question says should, or the reverse, with the wording put right, and what they negate on their own."""
    a = read(spark, sf, "answers")
    put = L.applied(a, "answer_id", ["answer", "question"], L.corrected_modal, "string", "corrected")
    added = L.applied(a, "answer_id", ["answer", "question"], L.added_negations, "array<string>", "negated")
    return put.join(added, "answer_id")


@register()
def soft_broken(spark: SparkSession, sf: str) -> DataFrame:
    return L.applied(read(spark, sf, "questions"), "id", ["question"], lambda t: L.soft_breaks(t, WORDS), "string", "question")


@register()
def page_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each document's passages as runs; a document has as many pages as it has."""
    p = read(spark, sf, "passages").where("page_from IS NOT NULL").groupBy("sysid").agg(F.collect_set("page_from").alias("pages"))
    return L.applied(p, "sysid", ["pages"], lambda x: L.merge_runs(list(map(int, x))), "string", "runs")


@register(
    """WITH t AS (SELECT DISTINCT chapter_title AS heading FROM passages WHERE length(chapter_title) >= 4), l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM passages WHERE text IS NOT NULL)
    SELECT line, max_by(heading, length(heading)) AS heading FROM l JOIN t ON length(line) > length(heading) AND ends_with(line, heading) GROUP BY 1"""
)
def unglued_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that end in a chapter title stuck to them, the longest title; the ending of each length that titles have is a key, so this is a hash join."""
    p = read(spark, sf, "passages")
    titles = p.where("length(chapter_title) >= 4").select(F.col("chapter_title").alias("heading")).distinct()
    lengths = sorted(r["n"] for r in titles.select(F.length("heading").alias("n")).distinct().collect())  # no more than the longest title has characters
    lines = p.where("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    ends = lines.select("line", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n")).where(F.length("line") > F.col("n"))
    found = ends.withColumn("heading", F.right("line", F.col("n"))).join(titles, "heading")
    return found.groupBy("line").agg(F.max_by("heading", "n").alias("heading"))
