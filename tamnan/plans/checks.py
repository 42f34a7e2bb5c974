"""Checks of answers, ratings and acceptance over the answer log and the assessors' codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import read
from tamnan.operators import text as T
from tamnan.operators import verify as V

_N = "list_distinct(regexp_extract_all(translate(coalesce({0}, ''), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '[0-9][0-9.,]*[0-9]'))"
_C = "list_distinct(regexp_extract_all(translate(coalesce({0}, ''), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '(?:ข้อ|มาตรา) [0-9๐-๙]+(?:/[0-9๐-๙]+)?'))"


@register(f"SELECT answer_id, list_sort(list_filter({_N.format('answer')}, lambda x: NOT list_contains({_N.format('question')}, x) AND NOT contains(array_to_string(coalesce(sources, []), ' '), x))) AS unsupported FROM answers")
def numbers_not_in_evidence(spark: SparkSession, sf: str) -> DataFrame:
    src = F.concat_ws(" ", F.coalesce("sources", F.array().cast("array<string>")))
    fresh = F.filter(F.array_except(V.numbers(F.col("answer")), V.numbers(F.col("question"))), lambda x: ~F.contains(src, x))
    return read(spark, sf, "answers").select("answer_id", F.array_sort(fresh).alias("unsupported"))


_L = "l AS (SELECT answer_id, question, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS pos FROM answers WHERE answer IS NOT NULL)"
_TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: length(x) >= 3)"


@register(f"WITH {_L} SELECT answer_id, pos::INTEGER AS pos FROM l WHERE len({_TOK.format('line')}) > 0 AND len(list_filter({_TOK.format('line')}, lambda x: contains(lower(coalesce(question, '')), x))) = 0")
def ungrounded_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines none of whose longer words stands in the question."""
    a = read(spark, sf, "answers").where("answer IS NOT NULL").select("answer_id", F.lower(F.coalesce("question", F.lit(""))).alias("q"), F.posexplode(F.split("answer", "\n")).alias("p", "line"))
    words = F.filter(T.tokens(F.col("line")), lambda t: F.length(t) >= 3)
    return a.where((F.size(words) > 0) & ~F.exists(words, lambda t: F.contains(F.col("q"), t))).select("answer_id", (F.col("p") + 1).alias("pos"))


@register("SELECT answer_id, list_sort(list_filter(list_distinct(regexp_extract_all(answer, '[A-Za-z]{3,}')), lambda x: NOT contains(lower(coalesce(question, '')), lower(x)))) AS terms FROM answers WHERE answer IS NOT NULL")
def foreign_terms(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("answer", F.lit("([A-Za-z]{3,})")))
    q = F.lower(F.coalesce("question", F.lit("")))
    return read(spark, sf, "answers").where("answer IS NOT NULL").select("answer_id", F.array_sort(F.filter(found, lambda t: ~F.contains(q, F.lower(t)))).alias("terms"))


_DATE = "[0-9]{1,2} (?:ม\\.ค|ก\\.พ|มี\\.ค|เม\\.ย|พ\\.ค|มิ\\.ย|ก\\.ค|ส\\.ค|ก\\.ย|ต\\.ค|พ\\.ย|ธ\\.ค)\\. [0-9]{4}"


@register(f"SELECT answer_id, list_sort(list_filter(list_distinct(regexp_extract_all(answer, '{_DATE}')), lambda x: NOT contains(coalesce(question, ''), x))) AS dates FROM answers WHERE answer IS NOT NULL")
def date_diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("answer", F.lit(f"({_DATE})")))
    return read(spark, sf, "answers").where("answer IS NOT NULL").select("answer_id", F.array_sort(F.filter(found, lambda t: ~F.contains(F.coalesce("question", F.lit("")), t))).alias("dates"))


_CITED = f"c AS (SELECT answer_id, unnest({_C.format('answer')}) AS cite FROM answers), k AS (SELECT DISTINCT unit || ' ' || section AS cite FROM passages WHERE unit IS NOT NULL AND section IS NOT NULL)"


@register(f"WITH {_CITED} SELECT answer_id, cite FROM c WHERE cite NOT IN (SELECT cite FROM k)")
def citation_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of sections that no document has."""
    known = read(spark, sf, "passages").where("unit IS NOT NULL AND section IS NOT NULL").select(F.concat_ws(" ", "unit", "section").alias("cite")).distinct()
    c = read(spark, sf, "answers").select("answer_id", F.explode(V.citations(F.col("answer"))).alias("cite"))
    return c.join(known, "cite", "left_anti").select("answer_id", "cite")


@register(f"WITH {_CITED}, w AS (SELECT unit || ' ' || section AS cite, count(DISTINCT sysid) AS documents FROM passages WHERE unit IS NOT NULL AND section IS NOT NULL GROUP BY 1) SELECT answer_id, cite, documents, documents > 1 AS ambiguous FROM c JOIN w USING (cite)")
def citation_sources(spark: SparkSession, sf: str) -> DataFrame:
    w = read(spark, sf, "passages").where("unit IS NOT NULL AND section IS NOT NULL").groupBy(F.concat_ws(" ", "unit", "section").alias("cite")).agg(F.count_distinct("sysid").alias("documents"))
    c = read(spark, sf, "answers").select("answer_id", F.explode(V.citations(F.col("answer"))).alias("cite"))
    return c.join(w, "cite").select("answer_id", "cite", "documents", (F.col("documents") > 1).alias("ambiguous"))


@register(
    f"""WITH w AS (SELECT item_id, list_distinct({_TOK.format('question')}) AS q, list_distinct({_TOK.format('evidence')}) AS e FROM holdout_questions)
    SELECT item_id, len(q)::INTEGER AS words, len(list_intersect(q, e))::INTEGER AS shared, len(q) >= 6 AND len(list_intersect(q, e)) = 0 AS unsupported FROM w"""
)
def claim_overlap(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.filter(T.tokens(F.col(c)), lambda t: F.length(t) >= 3))
    w = read(spark, sf, "holdout_questions").select("item_id", words("question").alias("q"), words("evidence").alias("e"))
    shared = F.size(F.array_intersect("q", "e"))
    return w.select("item_id", F.size("q").alias("words"), shared.alias("shared"), ((F.size("q") >= 6) & (shared == 0)).alias("unsupported"))


@register(
    f"""WITH q AS (SELECT item_id, {_TOK.format('question')} AS w, string_split(evidence, ' ') AS parts FROM holdout_questions),
    p AS (SELECT item_id, w, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM q),
    s AS (SELECT item_id, i, len(list_intersect(list_distinct(w), list_distinct({_TOK.format('part')}))) AS score FROM p),
    r AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM s)
    SELECT item_id, max(i)::INTEGER AS part FROM r WHERE score = best AND best > 0 GROUP BY 1 HAVING count(*) = 1"""
)
def best_subitem(spark: SparkSession, sf: str) -> DataFrame:
    """The part with the one highest overlap; a tie or no overlap gives none."""
    long = lambda c: F.array_distinct(F.filter(T.tokens(c), lambda t: F.length(t) >= 3))
    p = read(spark, sf, "holdout_questions").select("item_id", long(F.col("question")).alias("w"), F.posexplode(F.split("evidence", " ")).alias("i", "part"))
    s = p.select("item_id", "i", F.size(F.array_intersect("w", long(F.col("part")))).alias("score"))
    r = s.withColumn("best", F.max("score").over(Window.partitionBy("item_id"))).where("score = best AND best > 0")
    return r.groupBy("item_id").agg((F.max("i") + 1).alias("part"), F.count("*").alias("n")).where("n = 1").select("item_id", "part")


@register(
    """WITH a AS (SELECT id, answer_id, logged_at, repair_state, coalesce(faults, []) AS f, lag(coalesce(faults, [])) OVER (PARTITION BY id ORDER BY logged_at, answer_id) AS b FROM answers)
    SELECT answer_id, len(f) < len(b) AND len(list_filter(list_distinct(f), lambda x: NOT list_contains(b, x))) = 0 AS accepted FROM a WHERE b IS NOT NULL"""
)
def repair_accept(spark: SparkSession, sf: str) -> DataFrame:
    """A later draft is accepted if it has fewer faults and none that the one before didn't have."""
    f = F.coalesce("faults", F.array().cast("array<string>"))
    w = Window.partitionBy("id").orderBy("logged_at", "answer_id")
    a = read(spark, sf, "answers").select("answer_id", "id", "logged_at", f.alias("f")).withColumn("b", F.lag("f").over(w)).where("b IS NOT NULL")
    return a.select("answer_id", ((F.size("f") < F.size("b")) & (F.size(F.array_except("f", "b")) == 0)).alias("accepted"))


_TOPICS = ["SNMP", "SMTP", "DHCP", "OSPF"]


@register("SELECT answer_id, list_filter(['" + "', '".join(_TOPICS) + "'], lambda t: contains(answer, t) AND NOT contains(coalesce(question, ''), t))[1] AS stray FROM answers WHERE answer IS NOT NULL")
def stray_topic(spark: SparkSession, sf: str) -> DataFrame:
    q = F.coalesce("question", F.lit(""))
    stray = F.filter(F.array(*[F.lit(t) for t in _TOPICS]), lambda t: F.contains("answer", t) & ~F.contains(q, t))
    return read(spark, sf, "answers").where("answer IS NOT NULL").select("answer_id", F.try_element_at(stray, F.lit(1)).alias("stray"))


@register(
    """SELECT answer_id, CASE WHEN answer IS NULL OR trim(answer, ' ') = '' THEN 'empty' WHEN length(answer) < 8 THEN 'short' WHEN contains(answer, 'ไม่มีข้อมูล') THEN 'no answer'
    WHEN NOT regexp_matches(answer, '\\[[0-9]+\\]|หน้า [0-9]') THEN 'no pointer' ELSE 'kept' END AS verdict FROM answers"""
)
def draft_rejection(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("answer")
    verdict = F.when(a.isNull() | (F.trim(a) == ""), "empty").when(F.length(a) < 8, "short").when(F.contains(a, F.lit("ไม่มีข้อมูล")), "no answer").when(~a.rlike(r"\[[0-9]+\]|หน้า [0-9]"), "no pointer").otherwise("kept")
    return read(spark, sf, "answers").select("answer_id", verdict.alias("verdict"))


_STANDING = """s AS (SELECT upper(trim(id)) AS id, assessor, arg_max(code, (coded_at, row_id)) AS code, arg_max(coalesce(note, ''), (coded_at, row_id)) AS note FROM coding_round6 WHERE code BETWEEN 0 AND 3 GROUP BY 1, 2)"""


def _standing(spark: SparkSession, sf: str) -> DataFrame:
    """The latest valid code of each assessor for an id, trimmed and in capitals."""
    c = read(spark, sf, "coding_round6").where("code BETWEEN 0 AND 3")
    last = F.max(F.struct("coded_at", "row_id", "code", F.coalesce("note", F.lit("")).alias("note"))).alias("m")
    return c.groupBy(F.upper(F.trim("id")).alias("id"), "assessor").agg(last).select("id", "assessor", F.col("m.code").alias("code"), F.col("m.note").alias("note"))


def _right():
    return F.col("code").isin(1, 2)


@register(f"WITH {_STANDING} SELECT assessor, count(*) AS n, count(*) FILTER (code IN (1, 2)) AS correct, round(count(*) FILTER (code IN (1, 2)) / count(*), 6) AS accuracy, count(*) FILTER (code = 0) AS c0, count(*) FILTER (code = 3) AS c3 FROM s GROUP BY 1")
def rater_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    code = lambda k: F.count_if(F.col("code") == k).alias(f"c{k}")
    return _standing(spark, sf).groupBy("assessor").agg(F.count("*").alias("n"), F.count_if(_right()).alias("correct"), F.round(F.count_if(_right()) / F.count("*"), 6).alias("accuracy"), code(0), code(3))


@register(f"WITH {_STANDING} SELECT coalesce(assessor, 'all') AS assessor, count(*) AS n, count(*) FILTER (code IN (1, 2)) AS correct FROM s GROUP BY ROLLUP (assessor)")
def rater_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _standing(spark, sf).rollup("assessor").agg(F.count("*").alias("n"), F.count_if(_right()).alias("correct")).select(F.coalesce("assessor", F.lit("all")).alias("assessor"), "n", "correct")


@register(f"WITH {_STANDING}, i AS (SELECT id, count(DISTINCT code IN (1, 2)) AS d, bool_and(code IN (1, 2)) AS allright FROM s GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS items, count(*) FILTER (d = 1) AS unanimous, count(*) FILTER (d > 1) AS disputed, count(*) FILTER (allright) AS unanimous_right, count(*) FILTER (d = 1 AND NOT allright) AS unanimous_wrong FROM i")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    i = _standing(spark, sf).withColumn("right", _right()).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("right").alias("d"), F.every("right").alias("good")).where("n > 1")
    return i.agg(F.count("*").alias("items"), F.count_if(F.col("d") == 1).alias("unanimous"), F.count_if(F.col("d") > 1).alias("disputed"), F.count_if("good").alias("unanimous_right"), F.count_if((F.col("d") == 1) & ~F.col("good")).alias("unanimous_wrong"))


@register(f"WITH {_STANDING}, r AS (SELECT assessor, count(*) FILTER (code IN (1, 2)) / count(*) AS acc FROM s GROUP BY 1) SELECT bool_and(acc >= 0.8) AS passed, count(*) FILTER (acc < 0.8) AS below FROM r")
def all_raters_pass(spark: SparkSession, sf: str) -> DataFrame:
    r = _standing(spark, sf).groupBy("assessor").agg((F.count_if(_right()) / F.count("*")).alias("acc"))
    return r.agg(F.every(F.col("acc") >= 0.8).alias("passed"), F.count_if(F.col("acc") < 0.8).alias("below"))


@register(f"WITH {_STANDING} SELECT id, count(*) FILTER (code IN (0, 3)) AS wrong, string_agg(assessor || ': ' || note, '; ' ORDER BY assessor) FILTER (code IN (0, 3)) AS notes FROM s GROUP BY 1 HAVING count(*) FILTER (code IN (0, 3)) > 0")
def failed_items(spark: SparkSession, sf: str) -> DataFrame:
    wrong = _standing(spark, sf).where(~_right())
    lines = F.array_sort(F.collect_list(F.struct("assessor", "note")))
    return wrong.groupBy("id").agg(F.count("*").alias("wrong"), F.array_join(F.transform(lines, lambda s: F.concat(s["assessor"], F.lit(": "), s["note"])), "; ").alias("notes"))


@register(f"WITH {_STANDING} SELECT q.id, max(code) FILTER (assessor = 'assessor1') AS a1, max(code) FILTER (assessor = 'assessor2') AS a2, max(code) FILTER (assessor = 'assessor3') AS a3 FROM questions q LEFT JOIN s ON s.id = upper(q.id) GROUP BY 1")
def rater_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = _standing(spark, sf).groupBy(F.col("id").alias("k")).agg(*[F.max(F.when(F.col("assessor") == f"assessor{i}", F.col("code"))).alias(f"a{i}") for i in (1, 2, 3)])
    return read(spark, sf, "questions").select("id", F.upper("id").alias("k")).join(wide, "k", "left").select("id", "a1", "a2", "a3")


@register(f"WITH {_STANDING} SELECT coalesce(q.id, s.id) AS id, s.id IS NULL AS uncoded FROM (SELECT upper(id) AS id FROM questions) q FULL JOIN (SELECT DISTINCT id FROM s) s ON q.id = s.id WHERE q.id IS NULL OR s.id IS NULL")
def strict_keys(spark: SparkSession, sf: str) -> DataFrame:
    q = read(spark, sf, "questions").select(F.upper("id").alias("id"), F.lit(1).alias("q"))
    s = _standing(spark, sf).select("id").distinct().withColumn("s", F.lit(1))
    return q.join(s, "id", "full").where("q IS NULL OR s IS NULL").select("id", F.col("s").isNull().alias("uncoded"))


@register(
    """WITH x AS (SELECT h.item_id, h.lang, coalesce(h.expect, []) AS expect, d.text FROM holdout_questions h JOIN documents d ON d.doc_id = h.item_id),
    r AS (SELECT lang, len(list_filter(expect, lambda e: len(list_filter(string_split(e, '|'), lambda o: contains(text, o))) > 0)) = len(expect) AS ok FROM x)
    SELECT lang, count(*) AS n, count(*) FILTER (ok) AS passed FROM r GROUP BY 1"""
)
def expectation_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Each expectation is met by any of its alternatives ("a|b"); an item passes if all are met."""
    h = read(spark, sf, "holdout_questions").select(F.col("item_id").alias("doc_id"), F.col("lang").alias("l"), F.coalesce("expect", F.array().cast("array<string>")).alias("expect"))
    ok = F.forall("expect", lambda e: F.exists(F.split(e, r"\|"), lambda o: F.contains("text", o)))
    return read(spark, sf, "documents").select("doc_id", "text").join(h, "doc_id").select(F.col("l").alias("lang"), ok.alias("ok")).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))


@register("SELECT category, count(*) AS n, round(avg((len(faults) > 0)::INTEGER), 6) AS flagged FROM answers GROUP BY 1")
def flag_rate(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "answers").groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg((F.size("faults") > 0).cast("int")), 6).alias("flagged"))


@register("SELECT assessor, count(*) FILTER (code = 1) AS ones, count(*) FILTER (code = 0) AS zeros, count(*) FILTER (code IS NULL) AS blanks, count(*) FILTER (note IS NULL OR trim(note) IN ('', '-')) AS bare FROM coding_round6 GROUP BY 1")
def countif(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda k: F.count_if(F.coalesce(F.col("code") == k, F.lit(False)))
    bare = F.col("note").isNull() | F.trim("note").isin("", "-")
    return read(spark, sf, "coding_round6").groupBy("assessor").agg(one(1).alias("ones"), one(0).alias("zeros"), F.count_if(F.col("code").isNull()).alias("blanks"), F.count_if(bare).alias("bare"))


@register("SELECT a.phrasing, count(*) AS n, round(avg(a.seconds), 6) AS mean_seconds, count(*) FILTER (a.error IS NOT NULL) AS errors, count(*) FILTER (a.in_scope) AS in_scope, count(DISTINCT a.id) AS questions FROM answers a GROUP BY 1")
def service_summary(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "answers").groupBy("phrasing").agg(
        F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.coalesce("in_scope", F.lit(False))).alias("in_scope"), F.count_distinct("id").alias("questions")
    )
