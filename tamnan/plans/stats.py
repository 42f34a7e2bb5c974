"""Counts, distributions, versions and reports over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import broadcast_if_small, cut_lineage, read
from tamnan.operators import text as T
from tamnan.operators.ranking import ordinal_within


@register("SELECT doc_id, title, length(text)::INTEGER AS n FROM documents")
def scan_parquet_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "title", F.length("text").alias("n"))


@register("SELECT coalesce(title, '') AS title, coalesce(text, '') AS txt, 'documents' AS origin FROM documents UNION ALL SELECT coalesce(heading, ''), coalesce(text, ''), 'passages' FROM passages")
def union_corpora(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "documents").select("title", F.col("text").alias("txt"), F.lit("documents").alias("origin"))
    b = read(spark, sf, "passages").select(F.col("heading").alias("title"), F.col("text").alias("txt"), F.lit("passages").alias("origin"))
    return a.unionByName(b).fillna("", ["title", "txt"])


@register("SELECT doc_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM documents GROUP BY 1")
def doc_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    per = read(spark, sf, "documents").groupBy("doc_type").agg(F.count("*").alias("n"))
    return per.select("doc_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@register(
    """SELECT CASE WHEN title LIKE 'พระราชบัญญัติ%' THEN 'act' WHEN title LIKE 'ข้อบังคับ%' THEN 'regulation' WHEN title LIKE 'ระเบียบ%' THEN 'rule'
    WHEN title LIKE 'ประกาศ%' THEN 'notice' WHEN title IS NULL THEN 'none' ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY 1"""
)
def title_class(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    c = F.when(t.startswith("พระราชบัญญัติ"), "act").when(t.startswith("ข้อบังคับ"), "regulation").when(t.startswith("ระเบียบ"), "rule").when(t.startswith("ประกาศ"), "notice").when(t.isNull(), "none").otherwise("other")
    return read(spark, sf, "documents").select(c.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@register("SELECT doc_id, title FROM documents WHERE (title LIKE 'พระราชบัญญัติ%' OR title LIKE 'ระเบียบ%') AND NOT regexp_matches(title, 'ฉบับที่|งบประมาณ') AND length(text) >= 20")
def prefix_negative_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    kept = (t.startswith("พระราชบัญญัติ") | t.startswith("ระเบียบ")) & ~t.rlike("ฉบับที่|งบประมาณ") & (F.length("text") >= 20)
    return read(spark, sf, "documents").where(kept).select("doc_id", "title")


_BINS = [(0, 200), (200, 500), (500, 1000), (1000, 2000), (2000, 5000), (5000, 10_000_000)]


@register(
    """SELECT b.lo::INTEGER AS lo, b.hi::INTEGER AS hi, count(d.doc_id) AS n, repeat('█', greatest(1, round(60 * count(d.doc_id) / sum(count(d.doc_id)) OVER ())::INTEGER)) AS bar
    FROM (VALUES (0, 200), (200, 500), (500, 1000), (1000, 2000), (2000, 5000), (5000, 10000000)) b(lo, hi)
    LEFT JOIN documents d ON length(d.text) >= b.lo AND length(d.text) < b.hi GROUP BY 1, 2"""
)
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    label = F.coalesce(*[F.when((n >= lo) & (n < hi), F.lit(lo)) for lo, hi in _BINS])
    counted = read(spark, sf, "documents").select(label.alias("lo")).groupBy("lo").agg(F.count("*").alias("n"))
    bins = spark.createDataFrame(_BINS, "lo int, hi int")
    full = bins.join(counted, "lo", "left").fillna(0, ["n"])
    share = F.round(60 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    return full.select("lo", "hi", "n", F.repeat(F.lit("█"), F.greatest(F.lit(1), share.cast("int"))).alias("bar"))


@register("SELECT doc_type, round(avg(length(text)), 6) AS mean, median(length(text))::DOUBLE AS median, min(length(text))::INTEGER AS lo, max(length(text))::INTEGER AS hi, sum(length(text))::BIGINT AS total FROM documents GROUP BY 1")
def length_stats_median(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return read(spark, sf, "documents").groupBy("doc_type").agg(F.round(F.avg(n), 6).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.sum(n).alias("total"))


@register("SELECT category, list_sort(list(seconds))[(count(*) // 2)::INTEGER + 1] AS upper_median FROM answers WHERE seconds IS NOT NULL GROUP BY 1")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    """The element at n div 2 of the sorted values, found by ordinal: no group is sorted in one task."""
    x = read(spark, sf, "answers").where("seconds IS NOT NULL").select("category", "seconds", "answer_id")
    n = x.groupBy("category").agg(F.count("*").alias("n")).withColumnRenamed("category", "c")
    return ordinal_within(x, ["category"], ["seconds", "answer_id"], "r").join(broadcast_if_small(n), F.col("category").eqNullSafe(F.col("c"))).where("r = n div 2 + 1").select("category", F.col("seconds").alias("upper_median"))


@register("SELECT kind, count(DISTINCT sysid) AS documents, count(*) AS chunks, count(DISTINCT section) AS sections FROM passages GROUP BY 1")
def distinct_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "passages").groupBy("kind").agg(F.count_distinct("sysid").alias("documents"), F.count("*").alias("chunks"), F.count_distinct("section").alias("sections"))


@register("WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS distinct_texts, count(*) FILTER (n > 1) AS repeated, sum(n - 1)::BIGINT AS surplus, round(sum(n - 1) / sum(n), 6)::DOUBLE AS surplus_share FROM g")
def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("distinct_texts"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.col("n") - 1).alias("surplus"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("surplus_share"))


@register("SELECT title, count(*) AS n FROM documents WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("title IS NOT NULL").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


@register("WITH y AS (SELECT pub_year, count(*) AS n FROM documents WHERE pub_year BETWEEN 2500 AND 2570 GROUP BY 1) SELECT pub_year, n, round(n / max(n) OVER (), 6) AS peak_share FROM y")
def share_of_peak(spark: SparkSession, sf: str) -> DataFrame:
    y = read(spark, sf, "documents").where("pub_year BETWEEN 2500 AND 2570").groupBy("pub_year").agg(F.count("*").alias("n"))
    return y.select("pub_year", "n", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6).alias("peak_share"))


@register("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 12")
def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)


_BASE = r"\s*\(ฉบับที่[^)]*\)|\s+(?:[0-9๐-๙]{4})$"


@register(
    f"""WITH d AS (SELECT doc_no, doc_key, trim(regexp_replace(act, '{_BASE}', '', 'g')) AS base, contains(act, 'ฉบับที่') AS amended, length(act) AS n FROM docs)
    SELECT base, doc_no, doc_key FROM d QUALIFY row_number() OVER (PARTITION BY base ORDER BY amended, n DESC, doc_no) = 1"""
)
def current_revision(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "docs").select("doc_no", "doc_key", F.trim(F.regexp_replace("act", _BASE, "")).alias("base"), F.contains(F.col("act"), F.lit("ฉบับที่")).alias("amended"), F.length("act").alias("n"))
    w = Window.partitionBy("base").orderBy("amended", F.desc("n"), "doc_no")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select("base", "doc_no", "doc_key")


@register("SELECT doc_no, doc_key FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs e WHERE e.superseded_by = d.doc_key) ")
def superseded_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "docs")
    return d.select("doc_no", "doc_key").join(d.select(F.col("superseded_by").alias("doc_key")).where("doc_key IS NOT NULL"), "doc_key", "left_anti").select("doc_no", "doc_key")


@register(
    """WITH RECURSIVE c(doc_key, cur, depth) AS (SELECT doc_key, superseded_by, 1 FROM docs WHERE superseded_by IS NOT NULL
    UNION ALL SELECT c.doc_key, d.superseded_by, depth + 1 FROM c JOIN docs d ON d.doc_key = c.cur WHERE d.superseded_by IS NOT NULL AND depth < 8)
    SELECT doc_key, arg_max(cur, depth) AS newest, max(depth)::INTEGER AS steps FROM c GROUP BY 1"""
)
def newest_version(spark: SparkSession, sf: str) -> DataFrame:
    """Follows superseded_by to its end by doubling: after n joins 2**n links are followed.

    Ends when no link goes on; in a circle, which has no end, when more links were followed than there are.
    """
    found = cut_lineage(read(spark, sf, "docs").where("superseded_by IS NOT NULL").select("doc_key", F.col("superseded_by").alias("newest"), F.lit(1).alias("steps")))
    links, reach = found.count(), 1
    while reach <= links:
        onward = found.select(F.col("doc_key").alias("k"), F.col("newest").alias("s"), F.col("steps").alias("more"))
        joined = cut_lineage(found.join(onward, found.newest == onward.k, "left"))
        found = joined.select("doc_key", F.coalesce("s", "newest").alias("newest"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if joined.where("k IS NOT NULL").isEmpty():
            break
        reach *= 2
    return found


@register("SELECT sysid, section, arg_min(passage_id, passage_id) AS passage_id, min(passage_id) AS first_id FROM passages WHERE section IS NOT NULL GROUP BY 1, 2")
def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "passages").where("section IS NOT NULL").groupBy("sysid", "section").agg(F.min_by("passage_id", "passage_id").alias("passage_id"), F.min("passage_id").alias("first_id"))


@register(
    """WITH x AS (SELECT doc_id, doc_type, row_number() OVER (PARTITION BY doc_type ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY doc_type) AS size FROM documents)
    SELECT doc_id, doc_type, rn::INTEGER AS rn FROM x ORDER BY rn, size DESC, doc_type LIMIT 72"""
)
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    """72 rows in turn from each type; at most 72 of a type can be among them, so ranks stop there."""
    d = read(spark, sf, "documents").select("doc_id", "doc_type")
    x = d.withColumn("rn", F.row_number().over(Window.partitionBy("doc_type").orderBy("doc_id"))).where("rn <= 72")
    sizes = d.groupBy("doc_type").agg(F.count("*").alias("size"))
    return x.join(sizes, "doc_type").orderBy("rn", F.desc("size"), "doc_type").limit(72).select("doc_id", "doc_type", "rn")


@register(
    """SELECT passage_id, sysid, section, row_number() OVER (PARTITION BY sysid ORDER BY try_cast(split_part(section, '/', 1) AS INTEGER) NULLS LAST,
    coalesce(try_cast(split_part(section, '/', 2) AS INTEGER), 0), passage_id)::INTEGER AS ord FROM passages WHERE section IS NOT NULL"""
)
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "passages").where("section IS NOT NULL").select("passage_id", "sysid", "section")
    by = [F.coalesce(T.major(F.col("section")), F.lit(2**31 - 1)), T.minor(F.col("section")), "passage_id"]
    return ordinal_within(p, ["sysid"], by, "ord").select("passage_id", "sysid", "section", F.col("ord").cast("int").alias("ord"))


@register("SELECT passage_id, row_number() OVER (PARTITION BY sysid ORDER BY (kind <> 'regulation')::INTEGER, part NULLS LAST, passage_id)::INTEGER AS ord FROM passages")
def preferred_first(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "passages").select("passage_id", "sysid", (F.col("kind") != "regulation").cast("int").alias("other"), F.coalesce("part", F.lit(2**31 - 1)).alias("part"))
    return ordinal_within(p, ["sysid"], ["other", "part", "passage_id"], "ord").select("passage_id", F.col("ord").cast("int").alias("ord"))


@register("SELECT id, category, (floor((row_number() OVER (PARTITION BY category ORDER BY id) - 1) / 15) + 1)::INTEGER AS page FROM questions")
def paging(spark: SparkSession, sf: str) -> DataFrame:
    q = ordinal_within(read(spark, sf, "questions").select("id", "category"), ["category"], ["id"], "rn")
    return q.select("id", "category", (F.floor((F.col("rn") - 1) / 15) + 1).cast("int").alias("page"))


@register("SELECT sysid, chapter, arg_min(page_from, passage_id) AS first_page, max(page_to) AS last_page, count(*) AS chunks FROM passages WHERE kind = 'book' AND chapter IS NOT NULL GROUP BY 1, 2")
def chapter_span(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "passages").where("kind = 'book' AND chapter IS NOT NULL").groupBy("sysid", "chapter").agg(F.min_by("page_from", "passage_id").alias("first_page"), F.max("page_to").alias("last_page"), F.count("*").alias("chunks"))


@register("SELECT kind, count(*) AS chunks, arg_max(passage_id, (length(text), -passage_id)) AS longest, arg_min(passage_id, (length(text), passage_id)) AS shortest, round(avg(length(text)), 6) AS mean FROM passages GROUP BY 1")
def corpus_overview(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return read(spark, sf, "passages").groupBy("kind").agg(
        F.count("*").alias("chunks"),
        F.max_by("passage_id", F.struct(n.alias("n"), (-F.col("passage_id")).alias("i"))).alias("longest"),
        F.min_by("passage_id", F.struct(n.alias("n"), F.col("passage_id").alias("i"))).alias("shortest"),
        F.round(F.avg(n), 6).alias("mean"),
    )


@register("SELECT coalesce(kind, 'total') AS kind, coalesce(lang, 'all') AS lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT kind, coalesce(lang, 'none') AS lang, text FROM passages) GROUP BY GROUPING SETS ((kind, lang), (kind), ())")
def kind_language_rollup(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "passages").select("kind", F.coalesce("lang", F.lit("none")).alias("lang"), F.length("text").alias("n"))
    return p.rollup("kind", "lang").agg(F.count("*").alias("c"), F.sum("n").alias("chars")).select(F.coalesce("kind", F.lit("total")).alias("kind"), F.coalesce("lang", F.lit("all")).alias("lang"), F.col("c").alias("n"), "chars")


@register("SELECT kind, list_sort(list(DISTINCT chapter) FILTER (lang = 'th' AND chapter IS NOT NULL)) AS th, list_sort(list(DISTINCT chapter) FILTER (lang = 'en' AND chapter IS NOT NULL)) AS en FROM passages GROUP BY 1")
def pivot_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    """Chapter numbers (a few) of each kind by language."""
    p = read(spark, sf, "passages").select("kind", "lang", "chapter").distinct().groupBy("kind").pivot("lang", ["th", "en"]).agg(F.array_sort(F.collect_set("chapter")))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return p.select("kind", some("th"), some("en"))


@register("SELECT p.sysid, bool_and(d.superseded_by IS NOT NULL) AS repealed, count(*) AS chunks FROM passages p JOIN docs d ON d.doc_key = p.sysid GROUP BY 1")
def status_every(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "docs").select(F.col("doc_key").alias("sysid"), F.col("superseded_by").isNotNull().alias("gone"))
    return read(spark, sf, "passages").select("sysid").join(d, "sysid").groupBy("sysid").agg(F.every("gone").alias("repealed"), F.count("*").alias("chunks"))


_PROBES = ["มาตรฐานไร้สาย", "การอุทธรณ์", "Subnets", "เครือข่าย"]


@register(
    """SELECT p.word, count(d.doc_id) AS matches, CASE WHEN bool_or(starts_with(d.title, p.word)) THEN 'own title' WHEN count(d.doc_id) > 0 THEN 'cited' ELSE 'missing' END AS how,
    arg_max(d.doc_id, (length(d.text), -d.doc_id)) AS example FROM (VALUES ('มาตรฐานไร้สาย'), ('การอุทธรณ์'), ('Subnets'), ('เครือข่าย')) p(word)
    LEFT JOIN documents d ON contains(d.title, p.word) GROUP BY 1"""
)
def coverage_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Four probe words held against all titles, each title read once."""
    words = spark.createDataFrame([(w,) for w in _PROBES], "word string")
    d = read(spark, sf, "documents").select("doc_id", "title", F.length("text").alias("n"))
    hit = d.select("doc_id", "title", "n", F.explode(F.filter(F.array(*[F.lit(w) for w in _PROBES]), lambda w: F.contains(F.col("title"), w))).alias("word"))
    per = hit.groupBy("word").agg(F.count("*").alias("matches"), F.bool_or(F.startswith(F.col("title"), F.col("word"))).alias("own"), F.max_by("doc_id", F.struct("n", (-F.col("doc_id")).alias("i"))).alias("example"))
    j = words.join(per, "word", "left")
    return j.select("word", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), F.when(F.col("own"), "own title").when(F.col("matches") > 0, "cited").otherwise("missing").alias("how"), "example")


@register("SELECT l.l_partkey, count(DISTINCT l.l_orderkey) AS orders, round(sum(l.l_quantity), 6) AS quantity FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size < 10 GROUP BY 1")
def part_order_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_quantity").join(parts, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@register("SELECT n_name, r_name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def nation_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are reduced by nation before the small tables are joined."""
    per = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("customers"), F.sum("c_acctbal").alias("balance"))
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(per, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"), F.round("balance", 2).alias("balance"))


@register("SELECT '| ' || doc_type || ' | ' || count(*) || ' | ' || sum(length(text)) || ' |' AS line FROM documents GROUP BY doc_type")
def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    g = read(spark, sf, "documents").groupBy("doc_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return g.select(T.markdown_row(F.col("doc_type"), F.col("n"), F.col("chars")).alias("line"))
