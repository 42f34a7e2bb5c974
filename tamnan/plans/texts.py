"""Text cleaning, line windows, rule matching and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import read
from tamnan.operators import text as T
from tamnan.operators.ranking import islands_within, ordinal_within

_TIDY = "trim(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(160) || chr(9), '  '), ' +', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')"


@register(f"SELECT passage_id, {_TIDY} AS text FROM passages")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "passages").select("passage_id", T.tidy(F.col("text")).alias("text"))


def _edge_sql(limit: int) -> str:
    head = f"left(text, {limit})"
    at = lambda m: f"({limit} - strpos(reverse({head}), {m}) + 1)"
    ok = lambda m: f"(strpos({head}, {m}) > 0 AND {at(m)} > {limit * 0.6})"
    return f"CASE WHEN length(text) <= {limit} THEN text WHEN {ok('chr(10)')} THEN left({head}, {at('chr(10)')} - 1) WHEN {ok(chr(39) + ' ' + chr(39))} THEN left({head}, {at(chr(39) + ' ' + chr(39))} - 1) ELSE {head} END"


@register(f"SELECT doc_id, {_edge_sql(300)} AS teaser FROM documents")
def truncate_edge(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.cut_at_edge(F.col("text"), 300).alias("teaser"))


@register("SELECT doc_no, translate(published, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS arabic, translate(published, '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS thai FROM docs")
def digits(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("published")
    return read(spark, sf, "docs").select("doc_no", T.arabic_digits(p).alias("arabic"), T.thai_digits(p).alias("thai"))


@register(
    """WITH p AS (SELECT doc_no, regexp_extract_all(translate(published, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '[0-9]+') AS g FROM docs)
    SELECT doc_no, CASE WHEN len(g) = 3 THEN try_cast(format('{:04d}-{:02d}-{:02d}', (g[1]::INTEGER - CASE WHEN g[1]::INTEGER > 2400 THEN 543 ELSE 0 END), g[2]::INTEGER, g[3]::INTEGER) AS DATE) END AS published FROM p"""
)
def buddhist_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Years above 2400 are Buddhist; Thai digits are read like Arabic ones."""
    g = F.transform(F.regexp_extract_all(T.arabic_digits(F.col("published")), F.lit("([0-9]+)")), lambda x: x.cast("int"))
    d = read(spark, sf, "docs").select("doc_no", g.alias("g"))
    at = lambda i: F.try_element_at("g", F.lit(i))
    year = F.when(at(1) > 2400, at(1) - 543).otherwise(at(1))
    return d.select("doc_no", F.when(F.size("g") == 3, F.try_make_date(year, at(2), at(3)) if hasattr(F, "try_make_date") else F.to_date(F.format_string("%04d-%02d-%02d", year, at(2), at(3)))).alias("published"))


@register("SELECT passage_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[e-mail]', 'g') AS text FROM passages WHERE contains(text, '@')")
def email_redact(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "passages").where(F.contains("text", F.lit("@"))).select("passage_id", T.redact_emails(F.col("text")).alias("text"))


@register(
    """SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS plain FROM documents WHERE contains(text, '</')"""
)
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where(F.contains("text", F.lit("</"))).select("doc_id", T.strip_tags(F.col("text")).alias("plain"))


@register("SELECT doc_no, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS base, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM docs WHERE url IS NOT NULL")
def url_base(spark: SparkSession, sf: str) -> DataFrame:
    u = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return read(spark, sf, "docs").where("url IS NOT NULL").select("doc_no", u.alias("base"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


_CITES = "(?:ข้อ|มาตรา) [0-9๐-๙]+(?:/[0-9๐-๙]+)?"


@register(f"SELECT answer_id, pos::INTEGER AS pos, cite FROM (SELECT answer_id, cite, min(i) AS at, row_number() OVER (PARTITION BY answer_id ORDER BY min(i)) AS pos FROM (SELECT answer_id, unnest(c) AS cite, generate_subscripts(c, 1) AS i FROM (SELECT answer_id, regexp_extract_all(answer, '{_CITES}') AS c FROM answers)) GROUP BY 1, 2)")
def citations_distinct(spark: SparkSession, sf: str) -> DataFrame:
    c = F.array_distinct(F.regexp_extract_all("answer", F.lit(f"({_CITES})")))
    return read(spark, sf, "answers").select("answer_id", F.posexplode(c).alias("i", "cite")).select("answer_id", (F.col("i") + 1).alias("pos"), "cite")


@register("SELECT c_custkey, left(sha256(c_name), 8) AS person FROM customer")
def hash_identity(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", T.short_hash(F.col("c_name")).alias("person"))


@register("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def checksum_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"
_HEAD = "^(หมวด [0-9๐-๙]+|[0-9]+\\. .{2,60})$"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("pos"), "line")


@register(f"WITH {_LINES} SELECT doc_id, pos::INTEGER AS pos, length(line)::INTEGER AS n FROM l")
def line_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", "pos", F.length("line").alias("n"))


@register(f"WITH {_LINES} SELECT doc_id, pos::INTEGER AS pos, last_value(CASE WHEN regexp_matches(line, '{_HEAD}') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l")
def forward_fill_heading(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _lines(spark, sf).select("doc_id", "pos", F.last(F.when(F.col("line").rlike(_HEAD), F.col("line")), ignorenulls=True).over(w).alias("heading"))


@register(
    f"""WITH {_LINES}, g AS (SELECT *, sum((line LIKE 'หมวด %')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS outer_no FROM l)
    SELECT doc_id, pos::INTEGER AS pos, outer_no::BIGINT AS outer_no, last_value(CASE WHEN regexp_matches(line, '^(ข้อ|มาตรา) ') THEN regexp_extract(line, '^((ข้อ|มาตรา) [0-9๐-๙/]+)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id, outer_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM g"""
)
def nested_fill_reset(spark: SparkSession, sf: str) -> DataFrame:
    """A new chapter clears the section that was filled forward."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    g = _lines(spark, sf).withColumn("outer_no", F.sum(F.startswith(F.col("line"), F.lit("หมวด ")).cast("int")).over(w))
    inner = Window.partitionBy("doc_id", "outer_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(F.col("line").rlike("^(ข้อ|มาตรา) "), F.regexp_extract("line", "^((ข้อ|มาตรา) [0-9๐-๙/]+)", 1))
    return g.select("doc_id", "pos", "outer_no", F.last(section, ignorenulls=True).over(inner).alias("section"))


@register(
    f"""WITH {_LINES}, g AS (SELECT doc_id, pos, sum(regexp_matches(line, '^(ข้อ|มาตรา) [0-9๐-๙]')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS grp, line FROM l)
    SELECT doc_id, grp::BIGINT AS grp, count(*) AS lines, sum(length(line))::BIGINT AS chars, min(pos)::INTEGER AS first_pos FROM g GROUP BY 1, 2"""
)
def section_groups(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    g = _lines(spark, sf).withColumn("grp", F.sum(F.col("line").rlike("^(ข้อ|มาตรา) [0-9๐-๙]").cast("int")).over(w))
    return g.groupBy("doc_id", "grp").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.min("pos").alias("first_pos"))


@register(f"WITH {_LINES}, k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l WHERE line <> '') SELECT doc_id, pos::INTEGER AS pos FROM k WHERE NOT (regexp_matches(line, '^[0-9]{{4}}$') AND NOT coalesce(before LIKE '%พ.ศ.', false))")
def lag_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A lone year stays only after a kept line that ends with the era."""
    k = _lines(spark, sf).where("line != ''").withColumn("before", F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos")))
    lone = F.col("line").rlike("^[0-9]{4}$") & ~F.coalesce(F.endswith(F.col("before"), F.lit("พ.ศ.")), F.lit(False))
    return k.where(~lone).select("doc_id", "pos")


@register(
    f"""WITH {_LINES}, c AS (SELECT doc_id, pos, nullif(regexp_extract(line, '({_CITES})', 1), '') AS cite FROM l WHERE line <> '')
    SELECT doc_id, pos::INTEGER AS pos, cite, coalesce(cite = lead(cite) OVER (PARTITION BY doc_id ORDER BY pos), false) AS repeated FROM c"""
)
def lead_cite_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    cite = F.nullif(F.regexp_extract("line", f"({_CITES})", 1), F.lit(""))
    c = _lines(spark, sf).where("line != ''").select("doc_id", "pos", cite.alias("cite"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return c.select("doc_id", "pos", "cite", F.coalesce(F.col("cite") == F.lead("cite").over(w), F.lit(False)).alias("repeated"))


@register(f"WITH {_LINES} SELECT doc_id, pos::INTEGER AS pos, first_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM l")
def next_nonblank(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return _lines(spark, sf).select("doc_id", "pos", F.first(F.nullif("line", F.lit("")), ignorenulls=True).over(w).alias("following"))


@register("SELECT passage_id, row_number() OVER (PARTITION BY sysid, coalesce(heading, '') ORDER BY passage_id)::INTEGER AS ordinal FROM passages")
def chunk_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "passages").select("passage_id", "sysid", F.coalesce("heading", F.lit("")).alias("h"))
    return ordinal_within(p, ["sysid", "h"], ["passage_id"]).select("passage_id", F.col("ordinal").cast("int").alias("ordinal"))


@register(
    """WITH g AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true) AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT user_id, ts, sum(starts::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
    SELECT user_id, island::BIGINT AS island, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY 1, 2"""
)
def islands(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered over sorted ranges, so one user's events may span many tasks."""
    events = read(spark, sf, "events").select("user_id", "ts", "event_id")
    all_ = islands_within(events, ["user_id"], "ts", ["ts", "event_id"], F.expr("INTERVAL '6' HOUR"))
    return all_.groupBy("user_id", "island").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register(f"WITH {_LINES}, f AS (SELECT *, max(regexp_matches(line, '^(หมวด 2|2\\. )')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM l) SELECT doc_id, pos::INTEGER AS pos FROM f WHERE after = 1")
def flag_after_marker(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    f = _lines(spark, sf).withColumn("after", F.max(F.col("line").rlike(r"^(หมวด 2|2\. )").cast("int")).over(w))
    return f.where("after = 1").select("doc_id", "pos")


_CHECKS = [
    ("short", "length(text) < 60", lambda: F.length("text") < 60),
    ("private", "regexp_matches(text, '[\\x{E000}-\\x{F8FF}]')", lambda: F.col("text").rlike(r"[\x{E000}-\x{F8FF}]")),
    ("control", "regexp_matches(text, '[\\x{80}-\\x{9F}]')", lambda: F.col("text").rlike(r"[\x{80}-\x{9F}]")),
    ("split_vowel", "contains(text, 'ํา')", lambda: F.contains(F.col("text"), F.lit("ํา"))),
    ("stray_mark", "regexp_matches(text, '(^|[ \n])[\\x{E31}\\x{E34}-\\x{E3A}\\x{E47}-\\x{E4E}]')", lambda: F.col("text").rlike(r"(^|[ \n])[\x{E31}\x{E34}-\x{E3A}\x{E47}-\x{E4E}]")),
    ("count", "n_chars IS NULL OR n_chars <> length(text)", lambda: F.col("n_chars").isNull() | (F.col("n_chars") != F.length("text"))),
    ("no_language", "lang IS NULL", lambda: F.col("lang").isNull()),
    ("late", "loaded_at > extracted_at + INTERVAL 1 DAY", lambda: F.col("loaded_at") > F.col("extracted_at") + F.expr("INTERVAL '1' DAY")),
]


@register("SELECT passage_id, list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql, _ in _CHECKS) + "], lambda x: x IS NOT NULL) AS reasons FROM passages")
def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Eight checks; every reason is reported."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c(), F.lit(False)), F.lit(name)) for name, _, c in _CHECKS]))
    return read(spark, sf, "passages").select("passage_id", reasons.alias("reasons"))


@register(
    "SELECT passage_id, round(length(regexp_replace(text, '[^\\x{E00}-\\x{E7F}]', '', 'g')) / nullif(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')), 0), 6) AS thai_share FROM passages"
)
def script_share(spark: SparkSession, sf: str) -> DataFrame:
    thai, solid = F.length(F.regexp_replace("text", r"[^\x{E00}-\x{E7F}]", "")), F.length(F.regexp_replace("text", r"[ \t\n\x0B\f\r]", ""))
    return read(spark, sf, "passages").select("passage_id", F.round(F.try_divide(thai, solid), 6).alias("thai_share"))


@register(
    """SELECT sysid, round(sum(length(regexp_replace(text, '[^0-9๐-๙]', '', 'g'))) / sum(length(text)), 6)::DOUBLE AS digit_share, round(sum(coalesce(n_chars, 0)) / sum(length(text)), 6)::DOUBLE AS retained FROM passages GROUP BY 1"""
)
def retention_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n = F.sum(F.length("text"))
    return read(spark, sf, "passages").groupBy("sysid").agg(F.round(F.sum(F.length(F.regexp_replace("text", "[^0-9๐-๙]", ""))) / n, 6).alias("digit_share"), F.round(F.sum(F.coalesce("n_chars", F.lit(0))) / n, 6).alias("retained"))


#: Ordered rules: (topic, pattern, hard).  Data, not code: any table of this shape works.
_RULES = [("duty", "ต้อง|must", True), ("fee", "ค่าธรรมเนียม|fee", True), ("network", "เราเตอร์|router|switch|สวิตช์", False), ("ethics", "ซื่อสัตย์|ethics", False), ("how", "อย่างไร|how|ไหม", False)]
_RULES_SQL = ", ".join(f"({i}, '{t}', '{p}', {str(h).lower()})" for i, (t, p, h) in enumerate(_RULES))


@register(f"WITH r(no, topic, pat, hard) AS (VALUES {_RULES_SQL}) SELECT q.id, r.topic FROM questions q JOIN r ON regexp_matches(lower(q.question), r.pat) AND (r.hard OR NOT regexp_matches(lower(q.question), 'ต้องไปหาใคร')) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY r.no) = 1")
def ordered_rule_match(spark: SparkSession, sf: str) -> DataFrame:
    """First rule that matches; soft rules don't hold where the exception does.  The rules become one expression."""
    q = F.lower("question")
    soft = ~q.rlike("ต้องไปหาใคร")
    topic = F.coalesce(*[F.when(q.rlike(p) if hard else q.rlike(p) & soft, F.lit(t)) for t, p, hard in _RULES])
    return read(spark, sf, "questions").select("id", topic.alias("topic")).where("topic IS NOT NULL")


_GLOSSARY = [("เสียบ่อย", ["การซ่อมบำรุง", "อุปกรณ์"]), ("โดนอะไร", ["บทลงโทษ", "ตักเตือน"]), ("ใครต้อง|ไปหาใคร", ["นายทะเบียน"]), ("do with", ["frames", "traffic"])]


@register(
    "WITH g(no, pat, terms) AS (VALUES "
    + ", ".join(f"({i}, '{p}', ['{chr(39).join([', '.join([])]) if False else (chr(39) + ', ' + chr(39)).join(t)}'])" for i, (p, t) in enumerate(_GLOSSARY))
    + "), t AS (SELECT q.id, q.question, g.no, unnest(g.terms) AS term, generate_subscripts(g.terms, 1) AS k FROM questions q JOIN g ON regexp_matches(q.question, g.pat)), "
    "u AS (SELECT id, question, term, min(no * 100 + k) AS o FROM t WHERE NOT contains(question, term) GROUP BY 1, 2, 3) "
    "SELECT id, question || ' ' || string_agg(term, ' ' ORDER BY o) AS asked FROM u GROUP BY id, question UNION ALL SELECT id, question FROM questions WHERE id NOT IN (SELECT id FROM u)"
)
def query_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of all matching rules, in order, each once and only if the question doesn't hold it."""
    q = F.col("question")
    none = F.array().cast("array<string>")
    added = F.array_distinct(F.flatten(F.array(*[F.when(q.rlike(p), F.array(*[F.lit(x) for x in t])).otherwise(none) for p, t in _GLOSSARY])))
    fresh = F.filter(added, lambda t: ~F.contains(q, t))
    return read(spark, sf, "questions").select("id", F.when(F.size(fresh) > 0, F.concat(q, F.lit(" "), F.concat_ws(" ", fresh))).otherwise(q).alias("asked"))


@register("SELECT event_id, coalesce(try_cast(props::JSON->>'k' AS INTEGER), -1) AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).alias("k"))


@register("SELECT sysid, section, string_agg(text, chr(10) ORDER BY part NULLS FIRST, passage_id) AS joined FROM passages WHERE section IS NOT NULL GROUP BY 1, 2")
def concat_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one section of one document (bounded by the document) in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("part", F.lit(-1)).alias("p"), "passage_id", "text")))
    return read(spark, sf, "passages").where("section IS NOT NULL").groupBy("sysid", "section").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "\n").alias("joined"))
