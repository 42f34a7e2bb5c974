"""Audits of corpora, answers and gold data: shares, keys, repeats, pointers, revisions, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import read
from tamnan.operators.text import arabic_digits
from tamnan.plans.rules import _LINES, _lines, _name, _name_sql

_KIND = "^(พระราชบัญญัติ|ประกาศ|ข้อบังคับ|ระเบียบ)"


@register(
    f"""WITH k AS (SELECT DISTINCT {_name_sql('act')} AS name FROM docs WHERE act IS NOT NULL)
    SELECT doc_id, {_name_sql('title')} AS name FROM documents WHERE regexp_matches(title, '{_KIND}') AND {_name_sql('title')} NOT IN (SELECT name FROM k)"""
)
def unlisted_laws(spark: SparkSession, sf: str) -> DataFrame:
    """Documents named after an instrument that the register of instruments lacks, names in one form."""
    known = read(spark, sf, "docs").where("act IS NOT NULL").select(_name(F.col("act")).alias("name")).distinct()
    return read(spark, sf, "documents").where(F.col("title").rlike(_KIND)).select("doc_id", _name(F.col("title")).alias("name")).join(known, "name", "left_anti").select("doc_id", "name")


@register(
    f"""WITH d AS (SELECT doc_no, {_name_sql('act')} AS name, try_cast(nullif(regexp_extract(translate(act, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '([0-9]{{4}})$', 1), '') AS INTEGER) AS year FROM docs WHERE act IS NOT NULL)
    SELECT doc_no, year, lag(doc_no) OVER w AS revises, lag(year) OVER w AS revised_year FROM d WINDOW w AS (PARTITION BY name ORDER BY coalesce(year, 0), doc_no)"""
)
def revision_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each instrument with the one of its name that it follows; instruments of one name are few, and no pairs are made of them."""
    year = F.nullif(F.regexp_extract(arabic_digits(F.col("act")), "([0-9]{4})$", 1), F.lit("")).try_cast("int")
    d = read(spark, sf, "docs").where("act IS NOT NULL").select("doc_no", _name(F.col("act")).alias("name"), year.alias("year"))
    w = Window.partitionBy("name").orderBy(F.coalesce("year", F.lit(0)), "doc_no")
    return d.select("doc_no", "year", F.lag("doc_no").over(w).alias("revises"), F.lag("year").over(w).alias("revised_year"))


@register(
    """WITH e AS (SELECT item_id, generate_subscripts(expect, 1) AS pos, unnest(expect) AS key, evidence FROM holdout_questions)
    SELECT item_id, pos::INTEGER AS pos, len(string_split(key, '|'))::INTEGER AS alternatives, len(list_filter(string_split(key, '|'), lambda x: contains(evidence, x))) > 0 AS met FROM e"""
)
def gold_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every key an answer is expected to hold, with its alternatives and whether the evidence holds one of them."""
    e = read(spark, sf, "holdout_questions").select("item_id", "evidence", F.posexplode("expect").alias("pos", "key"))
    either = F.split("key", r"\|")
    return e.select("item_id", (F.col("pos") + 1).alias("pos"), F.size(either).alias("alternatives"), F.exists(either, lambda x: F.contains(F.col("evidence"), x)).alias("met"))


@register(
    """WITH p AS (SELECT coalesce(kind, '') AS kind, coalesce(lang, '') AS lang, sysid, sum(length(text)) AS chars, count(*) AS n FROM passages GROUP BY 1, 2, 3)
    SELECT kind, lang, sysid, n AS passages, chars::BIGINT AS chars, round(chars::DOUBLE / sum(chars) OVER (PARTITION BY kind), 6) AS share FROM p"""
)
def corpus_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What each document holds of its kind, counted before kinds are summed."""
    p = read(spark, sf, "passages").groupBy(F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("lang", F.lit("")).alias("lang"), "sysid").agg(F.count("*").alias("passages"), F.sum(F.length("text")).alias("chars"))
    total = p.groupBy("kind").agg(F.sum("chars").alias("all"))
    return p.join(total, "kind").select("kind", "lang", "sysid", "passages", "chars", F.round(F.col("chars").cast("double") / F.col("all"), 6).alias("share"))


@register(
    """SELECT answer_id, len(list_filter(list_transform(regexp_extract_all(answer, '\\[([0-9]{1,6})\\]', 1), lambda x: x::INTEGER), lambda x: x < 1 OR x > len(sources)))::INTEGER AS out_of_range,
    len(regexp_extract_all(answer, '\\[([0-9]{1,6})\\]', 1))::INTEGER AS pointers FROM answers WHERE answer IS NOT NULL"""
)
def pointer_range(spark: SparkSession, sf: str) -> DataFrame:
    """Pointers of an answer, and those that point at no source."""
    found = F.regexp_extract_all("answer", F.lit(r"\[([0-9]{1,6})\]"))
    beyond = F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: (x < 1) | (x > F.size("sources")))
    return read(spark, sf, "answers").where("answer IS NOT NULL").select("answer_id", F.size(beyond).alias("out_of_range"), F.size(found).alias("pointers"))


@register(
    """WITH w AS (SELECT answer_id, unnest(list_filter(string_split(answer, ' '), lambda x: length(x) >= 4)) AS word FROM answers), c AS (SELECT answer_id, word, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT answer_id, max(n) AS most, sum(n)::BIGINT AS words, max(n) >= 3 AND max(n) * 2 > sum(n) AS degenerate FROM c GROUP BY 1"""
)
def degenerate_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that say one word over and over."""
    w = read(spark, sf, "answers").select("answer_id", F.explode(F.filter(F.split("answer", " "), lambda x: F.length(x) >= 4)).alias("word"))
    c = w.groupBy("answer_id", "word").agg(F.count("*").alias("n"))
    return c.groupBy("answer_id").agg(F.max("n").alias("most"), F.sum("n").alias("words"), ((F.max("n") >= 3) & (F.max("n") * 2 > F.sum("n"))).alias("degenerate"))


_LETTER, _TONE = "[ก-ฮ]", "[่-๋]"


@register(
    f"""WITH c AS (SELECT passage_id, length(text) AS n, len(regexp_extract_all(text, '[ก-๛]')) AS thai, len(regexp_extract_all(text, '{_LETTER}')) AS letters, len(regexp_extract_all(text, '{_TONE}')) AS tones FROM passages WHERE text <> '')
    SELECT passage_id, round(thai::DOUBLE / n, 4) AS thai_share, round(tones::DOUBLE / greatest(letters, 1), 4) AS tone_share, thai >= 0.8 * n AS mostly_thai, letters >= 40 AND tones < 0.03 * letters AS toneless FROM c"""
)
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Share of Thai and of tone marks: a text that lost its marks has letters without tones."""
    n = lambda rx: F.regexp_count("text", F.lit(rx))
    c = read(spark, sf, "passages").where("text != ''").select("passage_id", F.length("text").alias("n"), n("[ก-๛]").alias("thai"), n(_LETTER).alias("letters"), n(_TONE).alias("tones"))
    share = lambda a, b: F.round(F.col(a).cast("double") / b, 4)
    return c.select("passage_id", share("thai", F.col("n")).alias("thai_share"), share("tones", F.greatest("letters", F.lit(1))).alias("tone_share"), (F.col("thai") >= 0.8 * F.col("n")).alias("mostly_thai"), ((F.col("letters") >= 40) & (F.col("tones") < 0.03 * F.col("letters"))).alias("toneless"))


@register(
    f"""WITH {_LINES} SELECT doc_id, pos::INTEGER AS pos, last_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceding,
    first_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM l"""
)
def nearest_nonblank(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that hold something before and after each line of a document."""
    held, w = F.nullif("line", F.lit("")), Window.partitionBy("doc_id").orderBy("pos")
    before = F.last(held, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(held, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return _lines(spark, sf).select("doc_id", "pos", before.alias("preceding"), after.alias("following"))


@register(
    """WITH s AS (SELECT event_id, 'reply: ' || props || ' (end)' AS reply FROM events)
    SELECT event_id, try_cast(json_extract_string(regexp_extract(reply, '\\{.*\\}'), '$.k') AS INTEGER) AS k FROM s"""
)
def recovered_json(spark: SparkSession, sf: str) -> DataFrame:
    """A field of a JSON object with text around it: what stands between the outermost braces is parsed."""
    reply = F.concat(F.lit("reply: "), "props", F.lit(" (end)"))
    return read(spark, sf, "events").select("event_id", F.get_json_object(F.regexp_extract(reply, r"\{.*\}", 0), "$.k").try_cast("int").alias("k"))


@register(
    """WITH q AS (SELECT phrasing, a.id, length(answer) AS n, in_scope FROM answers a WHERE answer IS NOT NULL)
    SELECT coalesce(phrasing, '') AS phrasing, count(*) AS answers, count(*) FILTER (in_scope) AS in_scope, round(avg(n), 4) AS mean_length, count(DISTINCT id) AS questions FROM q GROUP BY 1"""
)
def phrasing_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by how their question was put."""
    a = read(spark, sf, "answers").where("answer IS NOT NULL")
    return a.groupBy(F.coalesce("phrasing", F.lit("")).alias("phrasing")).agg(F.count("*").alias("answers"), F.count_if("in_scope").alias("in_scope"), F.round(F.avg(F.length("answer")), 4).alias("mean_length"), F.count_distinct("id").alias("questions"))


@register(
    """WITH s AS (SELECT coded_at, assessor, code, q.phrasing, q.id FROM coding_round6 c JOIN questions q ON q.id = c.id WHERE code BETWEEN 0 AND 3)
    SELECT assessor, coalesce(phrasing, '') AS phrasing, count(*) AS codings, round(avg((code IN (1, 2))::INTEGER), 6) AS accuracy FROM s GROUP BY 1, 2"""
)
def phrasing_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of answers an assessor held right, by how the question was put."""
    c = read(spark, sf, "coding_round6").where("code BETWEEN 0 AND 3").join(read(spark, sf, "questions").select("id", "phrasing"), "id")
    return c.groupBy("assessor", F.coalesce("phrasing", F.lit("")).alias("phrasing")).agg(F.count("*").alias("codings"), F.round(F.avg(F.col("code").isin(1, 2).cast("int")), 6).alias("accuracy"))


@register(
    """WITH h AS (SELECT user_id, event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)
    SELECT user_id, event_id FROM h WHERE r <= 40"""
)
def context_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """The contexts that stay when only so many chats are held: those heard from last; each chat is one row before they are ordered."""
    last = read(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.ts", "m.event_id")
    return last.orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("user_id", "event_id")


_EITHER = "(มาตรฐาน|โพรโทคอล|ระเบียบ|ตาราง|ประกาศ|ข้อบังคับ)"
_VOID = "^(ระเบียบ|ตาราง|ประกาศ|ข้อบังคับ)$"


@register(
    f"""WITH a AS (SELECT answer_id, string_split(answer, 'ข้อ ') AS parts FROM answers WHERE contains(answer, 'ข้อ ')), x AS (SELECT answer_id, len(parts) AS n, generate_subscripts(parts, 1) AS i, unnest(parts) AS seg FROM a),
    m AS (SELECT answer_id, i + 1 AS cite, list_extract(regexp_extract_all(right(seg, 90), '{_EITHER}'), -1) AS word FROM x WHERE i < n)
    SELECT answer_id, cite::INTEGER AS cite, CASE WHEN NOT regexp_matches(word, '{_VOID}') THEN word END AS instrument, coalesce(regexp_matches(word, '{_VOID}'), false) AS voided FROM m"""
)
def asof_named(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of instrument that stands nearest before each citation, void where another word for an instrument stands between."""
    parts = read(spark, sf, "answers").where(F.contains("answer", F.lit("ข้อ "))).select("answer_id", F.split("answer", "ข้อ ").alias("p"))
    seg = parts.select("answer_id", F.size("p").alias("n"), F.posexplode("p").alias("i", "seg")).where("i + 1 < n")
    word = F.try_element_at(F.regexp_extract_all(F.right("seg", F.lit(90)), F.lit(_EITHER)), F.lit(-1))
    void = F.coalesce(word.rlike(_VOID), F.lit(False))
    return seg.select("answer_id", (F.col("i") + 2).alias("cite"), F.when(~void, word).alias("instrument"), void.alias("voided"))


_ROWS_UP = "PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@register(
    f"""WITH s AS (SELECT l_orderkey, l_linenumber AS n, last_value(CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag || l_linenumber END IGNORE NULLS) OVER ({_ROWS_UP} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM lineitem)
    SELECT l_orderkey, n, CASE WHEN starts_with(mark, 'R') THEN try_cast(substring(mark, 2) AS INTEGER) END AS above FROM s"""
)
def asof_step_void(spark: SparkSession, sf: str) -> DataFrame:
    """The step line above each block of a page (an order of a few lines), void where a caption stands between."""
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.last(F.when(F.col("l_returnflag").isin("R", "A"), F.struct("l_returnflag", "l_linenumber")), ignorenulls=True).over(w)
    s = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), mark.alias("mark"))
    return s.select("l_orderkey", "n", F.when(F.col("mark.l_returnflag") == "R", F.col("mark.l_linenumber")).alias("above"))


@register(
    """WITH b AS (SELECT l_orderkey, l_linenumber AS n, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS y, l_partkey % 200 AS x FROM lineitem),
    r AS (SELECT *, coalesce(y - lag(y) OVER w > 15, true)::INTEGER AS starts FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY y, x, n)),
    rows_ AS (SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY y, x, n) AS band FROM r),
    c AS (SELECT *, coalesce(x - lag(x) OVER w > 25, true)::INTEGER AS begins FROM rows_ WINDOW w AS (PARTITION BY l_orderkey, band ORDER BY x, y, n)),
    cells AS (SELECT *, sum(begins) OVER (PARTITION BY l_orderkey, band ORDER BY x, y, n) AS col FROM c)
    SELECT l_orderkey, band::BIGINT AS band, col::BIGINT AS col, count(*) AS blocks, count(*) > 1 AS dense FROM cells GROUP BY 1, 2, 3"""
)
def page_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a page in row bands, and those in column bands, with gaps tolerated; a page is an order of a few lines."""
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    b = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), day.alias("y"), (F.col("l_partkey") % 200).alias("x"))

    def banded(df: DataFrame, keys: list[str], along: str, order: list[str], gap: int, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        starts = F.coalesce((F.col(along) - F.lag(along).over(w)) > gap, F.lit(True)).cast("int")
        return df.withColumn("_s", starts).withColumn(name, F.sum("_s").over(w)).drop("_s")

    cells = banded(banded(b, ["l_orderkey"], "y", ["y", "x", "n"], 15, "band"), ["l_orderkey", "band"], "x", ["x", "y", "n"], 25, "col")
    return cells.groupBy("l_orderkey", "band", "col").agg(F.count("*").alias("blocks"), (F.count("*") > 1).alias("dense"))


_FROM, _TO = "^(หมวด|บทที่|ส่วนที่|1\\.) ", "^(บรรณานุกรม|เอกสารอ้างอิง|แบบฝึกหัด|บทเฉพาะกาล)"


@register(
    f"""WITH {_LINES}, f AS (SELECT *, CASE WHEN regexp_matches(line, '{_TO}') THEN 0 WHEN regexp_matches(line, '{_FROM}') THEN 1 END AS mark FROM l),
    k AS (SELECT doc_id, pos, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS kept FROM f)
    SELECT doc_id, pos::INTEGER AS pos FROM k WHERE kept = 1"""
)
def kept_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines from the first heading on, without the parts that end a chapter (references, exercises, transitory provisions) up to the next heading."""
    mark = F.when(F.col("line").rlike(_TO), 0).when(F.col("line").rlike(_FROM), 1)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    k = _lines(spark, sf).select("doc_id", "pos", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)).alias("kept"))
    return k.where("kept = 1").select("doc_id", "pos")
