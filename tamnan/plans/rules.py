"""Rules over lines, questions, answers and names: filters, routes, normal forms, sections and their amendment, faults."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import read
from tamnan.operators import amendments
from tamnan.operators.text import arabic_digits, compose_thai, mac_roman_tables, recode_mac_roman

_LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", (F.col("pos") + 1).alias("pos"), F.trim("line").alias("line"))


_MARKER = r"^\([ก-ฮ0-9๐-๙]+\)|^[0-9๐-๙]+[.)] |^(หมวด|ส่วนที่|บทที่|ข้อ|มาตรา) "


@register(rf"WITH {_LINES} SELECT doc_id, pos::INTEGER AS pos FROM l WHERE line <> '' AND length(line) <= 40 AND NOT regexp_matches(line, '{_MARKER}') AND len(regexp_extract_all(line, '[ก-ฮA-Za-z一-龥ぁ-んァ-ンअ-ह]')) <= 2")
def noise_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Short lines that carry next to no letters and aren't a marker of their own."""
    letters = F.regexp_count("line", F.lit("[ก-ฮA-Za-z一-龥ぁ-んァ-ンअ-ह]"))
    return _lines(spark, sf).where((F.col("line") != "") & (F.length("line") <= 40) & ~F.col("line").rlike(_MARKER) & (letters <= 2)).select("doc_id", "pos")


_MASTHEAD = "^(หน้า|Page|Seite) [0-9๐-๙]+$|^เล่ม [0-9๐-๙]+ ตอน|ปีที่ [0-9๐-๙]+ ฉบับที่|, vol\\. [0-9]+$"


@register(
    f"""WITH l AS (SELECT passage_id, unnest(string_split(text, chr(10))) AS line FROM passages WHERE text IS NOT NULL)
    SELECT passage_id, count(*) FILTER (regexp_matches(trim(line), '{_MASTHEAD}')) AS furniture, count(*) AS lines FROM l GROUP BY 1"""
)
def masthead_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of page furniture in each passage."""
    line = F.explode(F.split("text", "\n")).alias("line")
    p = read(spark, sf, "passages").where("text IS NOT NULL").select("passage_id", line)
    return p.groupBy("passage_id").agg(F.count_if(F.trim("line").rlike(_MASTHEAD)).alias("furniture"), F.count("*").alias("lines"))


#: Routes in the order in which they are tried.
_ROUTES = [("which rule", "ตามข้อใด|ข้อไหน|มาตราใด"), ("difference", "ต่างจาก|ต่างกัน|difference"), ("permitted", "ได้หรือไม่|ทำอะไรได้|ต้องทำอย่างไร"), ("reason", "เหตุใด|ทำไม|why "), ("book", "บทที่|หนังสือ|ตำรา"), ("thanks", "ขอบคุณ|thank")]
_FOLLOW = "^(แล้ว|ส่วน|และ)|(ล่ะ|นั้น|เมื่อกี้|อีก)"


@register(
    "SELECT id, CASE "
    + " ".join(f"WHEN regexp_matches(lower(question), '{rx}') THEN '{name}'" for name, rx in _ROUTES)
    + f" ELSE 'search' END AS route, length(question) <= 60 AND regexp_matches(question, '{_FOLLOW}') AS follow_up FROM questions"
)
def canned_intents(spark: SparkSession, sf: str) -> DataFrame:
    """The first route whose pattern a question meets, and whether it is short and leans on the one before."""
    q = F.lower("question")
    route = F.coalesce(*[F.when(q.rlike(rx), name) for name, rx in _ROUTES], F.lit("search"))
    return read(spark, sf, "questions").select("id", route.alias("route"), ((F.length("question") <= 60) & F.col("question").rlike(_FOLLOW)).alias("follow_up"))


@register("SELECT event_id, greatest(1, least(floor(value)::BIGINT, 100))::BIGINT AS page_size, event_type <> 'error' AND user_id IS NOT NULL AS allowed FROM events")
def limit_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """A requested page size held between 1 and 100, and whether the caller may ask at all."""
    size = F.greatest(F.lit(1), F.least(F.floor("value").cast("bigint"), F.lit(100))).cast("bigint")
    return read(spark, sf, "events").select("event_id", size.alias("page_size"), ((F.col("event_type") != "error") & F.col("user_id").isNotNull()).alias("allowed"))


_BLANK = "^[\\s\u00a0\u3000\u200b]*$"
_LAW = "(พระราชบัญญัติ|พ\\.ร\\.บ\\.|ข้อบังคับ|ระเบียบ|ประกาศ)[^ ]{4,}"


@register(
    f"""SELECT answer_id, CASE WHEN regexp_matches(coalesce(answer, ''), '{_BLANK}') OR length(answer) > 700 THEN 'length' WHEN regexp_matches(answer, '(ข้อ|มาตรา) [0-9๐-๙]') THEN 'section'
    WHEN regexp_matches(answer, '[0-9๐-๙]+ (บาท|วัน|ปี|%)') THEN 'figure' WHEN regexp_matches(answer, '{_LAW}') THEN 'law' END AS unsafe FROM answers"""
)
def refusal_safe(spark: SparkSession, sf: str) -> DataFrame:
    """Why an answer can't stand as a refusal; null where it can."""
    a = F.col("answer")
    why = (
        F.when(F.coalesce(a, F.lit("")).rlike(_BLANK) | (F.length(a) > 700), "length")
        .when(a.rlike("(ข้อ|มาตรา) [0-9๐-๙]"), "section")
        .when(a.rlike("[0-9๐-๙]+ (บาท|วัน|ปี|%)"), "figure")
        .when(a.rlike(_LAW), "law")
    )
    return read(spark, sf, "answers").select("answer_id", why.alias("unsafe"))


@register("SELECT id, question FROM questions ORDER BY md5(id || '-20240607'), id LIMIT 25")
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """A sample that is the same for one seed at any partitioning: the order is a hash of id and seed."""
    return read(spark, sf, "questions").orderBy(F.md5(F.concat("id", F.lit("-20240607"))), "id").limit(25).select("id", "question")


_CITED = "(?:ข้อ|มาตรา)\\s*[0-9]+(?:/[0-9]+)?"


@register(
    f"""WITH c AS (SELECT answer_id, unnest(list_distinct(list_transform(regexp_extract_all(translate(answer, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '{_CITED}'), lambda x: regexp_replace(x, '\\s+', '', 'g')))) AS gold FROM answers),
    p AS (SELECT regexp_replace(unit || section, '\\s+', '', 'g') AS gold, count(*) AS passages FROM passages WHERE unit IS NOT NULL AND section IS NOT NULL GROUP BY 1)
    SELECT answer_id, gold, coalesce(passages, 0) AS passages FROM c LEFT JOIN p USING (gold)"""
)
def gold_join(spark: SparkSession, sf: str) -> DataFrame:
    """Sections an answer names, white space aside, with how many passages are of them; passages are counted before they are joined."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    named = F.array_distinct(F.transform(F.regexp_extract_all(arabic_digits(F.col("answer")), F.lit(f"({_CITED})")), bare))
    c = read(spark, sf, "answers").select("answer_id", F.explode(named).alias("gold"))
    p = read(spark, sf, "passages").where("unit IS NOT NULL AND section IS NOT NULL").groupBy(bare(F.concat("unit", "section")).alias("gold")).agg(F.count("*").alias("passages"))
    return c.join(p, "gold", "left").select("answer_id", "gold", F.coalesce("passages", F.lit(0)).alias("passages"))


_NAME_NOISE = r"\s*\([^)]*\)|\s*(พ\.ศ\.|ค\.ศ\.)\s*[0-9๐-๙]+|\s+[0-9๐-๙]{4}$"
_NAME_WORDS = (("พระราชบัญญัติ", "พ.ร.บ."), ("ว่าด้วย", ""), ("เรื่อง", ""), ("ประกาศ", ""), ("ข้อบังคับ", ""), (" ", ""))


def _name(c: Column) -> Column:
    c = F.regexp_replace(c, _NAME_NOISE, "")
    for a, b in _NAME_WORDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _name_sql(c: str) -> str:
    c = f"regexp_replace({c}, '{_NAME_NOISE}', '', 'g')"
    for a, b in _NAME_WORDS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@register(f"SELECT {_name_sql('act')} AS name, count(*) AS docs, min(doc_no) AS first_doc FROM docs WHERE act IS NOT NULL GROUP BY 1")
def law_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of instruments in one form: years, issue numbers, kinds and blanks don't count."""
    return read(spark, sf, "docs").where("act IS NOT NULL").groupBy(_name(F.col("act")).alias("name")).agg(F.count("*").alias("docs"), F.min("doc_no").alias("first_doc"))


@register("SELECT passage_id, md5(nfc_normalize(replace(text, chr(3661) || chr(3634), chr(3635)))) AS form FROM passages WHERE text IS NOT NULL")
def nfc_text(spark: SparkSession, sf: str) -> DataFrame:
    """Thai am composed, then NFC (which no built-in offers) in Arrow batches."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t))

    return read(spark, sf, "passages").where("text IS NOT NULL").select("passage_id", F.md5(nfc(compose_thai(F.col("text")))).alias("form"))


_MAC, _THAI = mac_roman_tables()


@register(f"SELECT passage_id, md5(translate(text, '{_MAC}', '{_THAI}')) AS form FROM passages WHERE len(regexp_extract_all(text, '[{_MAC}]')) > 2 * len(regexp_extract_all(text, '[ก-๛]')) AND len(regexp_extract_all(text, '[{_MAC}]')) >= 6")
def recoded_text(spark: SparkSession, sf: str) -> DataFrame:
    """Passages whose Thai bytes were read as Mac Roman, recoded character by character."""
    mac, thai = F.regexp_count("text", F.lit(f"[{_MAC}]")), F.regexp_count("text", F.lit("[ก-๛]"))
    return read(spark, sf, "passages").where((mac > 2 * thai) & (mac >= 6)).select("passage_id", F.md5(recode_mac_roman(F.col("text"))).alias("form"))


_DUTY = "(จรรยาบรรณต่อ(?:ตนเอง|วิชาชีพ|ผู้รับบริการ|ผู้ร่วมประกอบวิชาชีพ|สังคม))"


@register(f"SELECT id, nullif(regexp_extract(category, '{_DUTY}', 1), '') AS duty FROM questions")
def heading_category(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "questions").select("id", F.nullif(F.regexp_extract("category", _DUTY, 1), F.lit("")).alias("duty"))


_ITEM = r"\n(\([ก-ฮ0-9๐-๙]+\)|[-•] )"


@register(
    f"""WITH t AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(text, '{_ITEM}', chr(10) || chr(10) || '\\1', 'g'), '\\n\\n+', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)) AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, md5(t) AS form, len(string_split(t, chr(10) || chr(10)))::INTEGER AS paragraphs FROM t"""
)
def reflowed(spark: SparkSession, sf: str) -> DataFrame:
    """Wrapped lines joined; blank lines and item markers begin a paragraph."""
    t = F.regexp_replace("text", _ITEM, "\n\n$1")
    t = F.replace(F.replace(F.regexp_replace(t, r"\n\n+", "\u0001"), F.lit("\n"), F.lit(" ")), F.lit("\u0001"), F.lit("\n\n"))
    d = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.md5("t").alias("form"), F.size(F.split("t", "\n\n")).alias("paragraphs"))


_SECTION = "^(ข้อ|มาตรา) ([0-9๐-๙]+(?:/[0-9๐-๙]+)?)"
_BODIES = f"""{_LINES}, g AS (SELECT doc_id, pos, line, sum(regexp_matches(line, '{_SECTION}')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM l),
b AS (SELECT doc_id, grp, translate(regexp_extract(first(line ORDER BY pos), '{_SECTION}', 2), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS section, string_agg(line, chr(10) ORDER BY pos) AS body FROM g WHERE grp > 0 GROUP BY 1, 2)"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, grp, section, body): a document's lines are one row of a table, so its window is bounded by its text."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    g = _lines(spark, sf).withColumn("grp", F.sum(F.col("line").rlike(_SECTION).cast("int")).over(w)).where("grp > 0")
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    b = g.groupBy("doc_id", "grp").agg(lines.alias("x"))
    return b.select("doc_id", "grp", arabic_digits(F.regexp_extract(F.col("x")[0]["line"], _SECTION, 2)).alias("section"), F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("body"))


@register(f"WITH {_BODIES} SELECT doc_id, grp::BIGINT AS grp, section, length(body)::INTEGER AS chars, md5(body) AS form FROM b")
def section_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(spark, sf).select("doc_id", "grp", "section", F.length("body").alias("chars"), F.md5("body").alias("form"))


@register(
    f"""WITH {_BODIES}, d AS (SELECT doc_id, doc_type, min(doc_id) OVER (PARTITION BY doc_type) AS first_doc FROM documents),
    s AS (SELECT coalesce(doc_type, '') AS act, section, doc_id, grp, body FROM b JOIN d USING (doc_id))
    SELECT act, section, count(*) AS versions, md5(arg_max(body, (doc_id, grp))) AS form FROM s GROUP BY 1, 2"""
)
def amended_acts(spark: SparkSession, sf: str) -> DataFrame:
    """Every later section of an act replaces the one of its number: the newest stands.

    A section in force is the last of its amendments, so this is an aggregation; ``operators.amendments`` folds
    amendments that change single paragraphs.
    """
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("doc_type", F.lit("")).alias("act"))
    s = _sections(spark, sf).join(d, "doc_id")
    return s.groupBy("act", "section").agg(F.count("*").alias("versions"), F.md5(F.max_by("body", F.struct("doc_id", "grp"))).alias("form"))


@register(
    """WITH f AS (SELECT answer_id, translate(question, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS q, unnest(list_distinct(regexp_extract_all(translate(answer, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '[0-9][0-9,.]* (?:บาท|วัน|ปี|เครื่อง|ครั้ง|คน|ฉบับ|ชั่วโมง)'))) AS figure FROM answers)
    SELECT answer_id, figure FROM f WHERE NOT contains(q, string_split(figure, ' ')[1]) AND NOT (coalesce(try_cast(replace(string_split(figure, ' ')[1], ',', '') AS DOUBLE) <= 3, false) AND string_split(figure, ' ')[2] <> 'บาท')"""
)
def unsupported_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures with a unit that the question doesn't hold; counts of at most three are how prose is written, unless they are money."""
    figures = F.array_distinct(F.regexp_extract_all(arabic_digits(F.col("answer")), F.lit("([0-9][0-9,.]* (?:บาท|วัน|ปี|เครื่อง|ครั้ง|คน|ฉบับ|ชั่วโมง))")))
    f = read(spark, sf, "answers").select("answer_id", arabic_digits(F.col("question")).alias("q"), F.explode(figures).alias("figure"))
    number, unit = F.split("figure", " ")[0], F.split("figure", " ")[1]
    small = F.coalesce(F.replace(number, F.lit(","), F.lit("")).try_cast("double") <= 3, F.lit(False)) & (unit != "บาท")
    return f.where(~F.contains(F.col("q"), number) & ~small).select("answer_id", "figure")


@register(
    f"""SELECT answer_id, list_sort(list_filter([CASE WHEN regexp_matches(coalesce(answer, ''), '{_BLANK}') THEN 'empty' END, CASE WHEN len(sources) > 0 AND NOT regexp_matches(answer, '(ข้อ|มาตรา|บทที่|หน้า) [0-9๐-๙]') THEN 'uncited' END,
      CASE WHEN regexp_matches(answer, '(ดังนี้|ได้แก่|เช่น|และ|หรือ)$') THEN 'unfinished' END, CASE WHEN starts_with(answer, question) THEN 'echo' END], lambda x: x IS NOT NULL)) AS found,
      regexp_matches(coalesce(answer, ''), '{_BLANK}') OR coalesce(starts_with(answer, question), false) AS blocks FROM answers"""
)
def draft_faults(spark: SparkSession, sf: str) -> DataFrame:
    """All faults of a draft at once, and whether one of them keeps it from being sent."""
    a = F.col("answer")
    empty = F.coalesce(a, F.lit("")).rlike(_BLANK)
    echo = F.startswith(a, F.col("question"))
    faults = {
        "empty": empty,
        "uncited": (F.size("sources") > 0) & ~a.rlike("(ข้อ|มาตรา|บทที่|หน้า) [0-9๐-๙]"),
        "unfinished": a.rlike("(ดังนี้|ได้แก่|เช่น|และ|หรือ)$"),
        "echo": echo,
    }
    found = F.array_sort(F.array_compact(F.array(*[F.when(c, name) for name, c in faults.items()])))
    return read(spark, sf, "answers").select("answer_id", found.alias("found"), (empty | F.coalesce(echo, F.lit(False))).alias("blocks"))


_SUPPLEMENT = "^(.*?)[ \\n](ทั้งนี้|อนึ่ง|นอกจากนี้|หมายเหตุ)(.*)$"


@register(f"SELECT answer_id, regexp_extract(answer, '(?s){_SUPPLEMENT}', 1) AS main, regexp_extract(answer, '(?s){_SUPPLEMENT}', 2) || regexp_extract(answer, '(?s){_SUPPLEMENT}', 3) AS supplement FROM answers WHERE regexp_matches(answer, '(?s){_SUPPLEMENT}')")
def supplement_split(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that add to themselves, as their main part and the supplement."""
    part = lambda n: F.regexp_extract("answer", f"(?s){_SUPPLEMENT}", n)
    return read(spark, sf, "answers").where(F.col("answer").rlike(f"(?s){_SUPPLEMENT}")).select("answer_id", part(1).alias("main"), F.concat(part(2), part(3)).alias("supplement"))


@register("SELECT act AS act, section, paragraph::INTEGER AS paragraph, body FROM (SELECT * FROM (VALUES ('a', '1', 1, 'first'), ('a', '1', 2, 'second anew'), ('a', '1', 3, 'third'), ('a', '2', 1, 'all new'), ('a', '3', 1, 'added')) t(act, section, paragraph, body))")
def amendment_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The fold of ordered amendments, on a fixture: the tables hold none."""
    base = spark.createDataFrame([("a", "1", "first\nsecond"), ("a", "2", "old")], "act string, section string, body string")
    ops = spark.createDataFrame([("a", 1, "replace", "1", 2, "second anew"), ("a", 2, "append", "1", None, "third"), ("a", 3, "set", "2", None, "all new"), ("a", 4, "replace", "3", 9, "added")], "act string, no int, kind string, section string, paragraph int, body string")
    done = amendments.amended(base, ops)
    return done.select("act", "section", F.posexplode(F.split("body", "\n")).alias("paragraph", "body")).withColumn("paragraph", F.col("paragraph") + 1)
