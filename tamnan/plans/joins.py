"""Joins of the reference's shapes: neighbours, siblings, parents, as-of, intervals, containment, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamnan.catalog import register
from tamnan.functions.cluster import cut_lineage, read
from tamnan.operators import text as T
from tamnan.operators.ranking import carried_within, ordinal_within

_HITS = "hits AS (SELECT passage_id, sysid, chapter, part FROM passages WHERE passage_id % 20 = 0)"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every passage whose id is divisible by 20, against all passages."""
    return read(spark, sf, "passages").where("passage_id % 20 = 0")


_ORD = "o AS (SELECT passage_id, sysid, coalesce(heading, '') AS h, row_number() OVER (PARTITION BY sysid ORDER BY passage_id) AS ord, count(*) OVER (PARTITION BY sysid, coalesce(heading, '')) AS n FROM passages)"


@register(
    f"""WITH {_ORD}, x AS (SELECT * FROM o WHERE passage_id % 20 = 0)
    SELECT DISTINCT x.passage_id AS hit, c.passage_id FROM x JOIN o c ON c.sysid = x.sysid AND ((x.n <= 4 AND c.h = x.h) OR c.ord BETWEEN x.ord - 1 AND x.ord + 1)"""
)
def neighbour_expand(spark: SparkSession, sf: str) -> DataFrame:
    """The whole section of a hit if it has at most four chunks, and the chunks before and after it.

    Both parts are equi-joins (on section, and on ordinal after three shifts), so a document that holds
    a large part of the rows is joined by narrow keys instead of all against all.
    """
    p = read(spark, sf, "passages").select("passage_id", "sysid", F.coalesce("heading", F.lit("")).alias("h"))
    o = cut_lineage(ordinal_within(p, ["sysid"], ["passage_id"], "ord"))
    x = o.where("passage_id % 20 = 0").withColumnRenamed("passage_id", "hit").join(p.groupBy("sysid", "h").agg(F.count("*").alias("n")), ["sysid", "h"])
    section = x.where("n <= 4").select("hit", "sysid", "h").join(p, ["sysid", "h"]).select("hit", "passage_id")
    near = x.select("hit", "sysid", F.explode(F.array(F.col("ord") - 1, F.col("ord"), F.col("ord") + 1)).alias("ord")).join(o.select("sysid", "ord", "passage_id"), ["sysid", "ord"]).select("hit", "passage_id")
    return section.unionByName(near).distinct()


@register("SELECT passage_id, list(passage_id) OVER (PARTITION BY sysid ORDER BY passage_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM passages")
def sliding_frame(spark: SparkSession, sf: str) -> DataFrame:
    o = cut_lineage(ordinal_within(read(spark, sf, "passages").select("passage_id", "sysid"), ["sysid"], ["passage_id"], "ord"))
    near = o.select("sysid", F.col("passage_id").alias("other"), F.explode(F.array(F.col("ord") - 1, F.col("ord"), F.col("ord") + 1)).alias("ord"))
    return o.join(near, ["sysid", "ord"]).groupBy("passage_id").agg(F.sort_array(F.collect_list("other")).alias("around"))  # three rows at most


@register(
    f"""WITH {_HITS}, want AS (SELECT DISTINCT sysid, chapter FROM hits WHERE chapter IS NOT NULL)
    SELECT p.passage_id FROM passages p JOIN want USING (sysid, chapter) WHERE p.passage_id NOT IN (SELECT passage_id FROM hits)"""
)
def sibling_expand(spark: SparkSession, sf: str) -> DataFrame:
    h = _hits(spark, sf)
    want = h.where("chapter IS NOT NULL").select("sysid", "chapter").distinct()
    return read(spark, sf, "passages").join(want, ["sysid", "chapter"], "left_semi").join(h.select("passage_id"), "passage_id", "left_anti").select("passage_id")


@register(
    f"""WITH {_HITS}, h AS (SELECT DISTINCT sysid FROM hits)
    SELECT sysid, passage_id, r::INTEGER AS r FROM (SELECT sysid, passage_id, row_number() OVER (PARTITION BY sysid ORDER BY part NULLS LAST, passage_id) AS r FROM passages JOIN h USING (sysid)) WHERE r <= 3"""
)
def parent_fetch(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "passages").select("sysid", "passage_id", "part").join(_hits(spark, sf).select("sysid").distinct(), "sysid", "left_semi")
    w = Window.partitionBy("sysid").orderBy(F.col("part").asc_nulls_last(), "passage_id")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 3").select("sysid", "passage_id", "r")


@register(
    """WITH e AS (SELECT event_id, user_id, ts, event_type FROM events), v AS (SELECT * FROM e WHERE event_type = 'view')
    SELECT p.event_id, v.event_id AS before FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM v GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def asof_event(spark: SparkSession, sf: str) -> DataFrame:
    """The latest view of the same user at or before each purchase: carried along one sort, no range join."""
    e = read(spark, sf, "events").where("event_type IN ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type", (F.col("event_type") == "purchase").cast("int").alias("last"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return carried_within(e, ["user_id"], ["ts", "last", "event_id"], view, "before").where("event_type = 'purchase'").select("event_id", "before")


_NAMES = "(มาตรฐาน|โพรโทคอล|ระเบียบ|ตาราง)"


@register(
    f"""WITH a AS (SELECT answer_id, string_split(answer, 'ข้อ ') AS parts FROM answers WHERE contains(answer, 'ข้อ ')),
    x AS (SELECT answer_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS seg FROM a),
    n AS (SELECT answer_id, i + 1 AS cite, nullif(list_extract(regexp_extract_all(right(seg, 90), '{_NAMES}'), -1), '') AS instrument FROM x)
    SELECT n.answer_id, n.cite::INTEGER AS cite, n.instrument FROM n JOIN x ON x.answer_id = n.answer_id AND x.i = n.cite"""
)
def asof_instrument(spark: SparkSession, sf: str) -> DataFrame:
    """The instrument named nearest before each citation, within the 90 characters between it and the last one."""
    parts = read(spark, sf, "answers").where(F.contains("answer", F.lit("ข้อ "))).select("answer_id", F.split("answer", "ข้อ ").alias("p"))
    seg = parts.select("answer_id", F.size("p").alias("n"), F.posexplode("p").alias("i", "seg")).where("i + 1 < n")
    found = F.regexp_extract_all(F.right("seg", F.lit(90)), F.lit(_NAMES))
    return seg.select("answer_id", (F.col("i") + 2).alias("cite"), F.try_element_at(found, F.lit(-1)).alias("instrument"))


@register(
    """WITH h AS (SELECT passage_id, sysid, page_from, page_to FROM passages WHERE kind = 'book' AND passage_id % 20 = 0 AND page_from IS NOT NULL),
    f AS (SELECT passage_id AS photo, sysid, page_from AS page FROM passages WHERE kind = 'book' AND len(figures) > 0 AND page_from IS NOT NULL)
    SELECT h.passage_id, f.photo FROM h JOIN f ON f.sysid = h.sysid AND f.page BETWEEN h.page_from AND h.page_to"""
)
def interval_photos(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the hits are exploded, so the interval join is an equi-join on (book, page)."""
    b = read(spark, sf, "passages").where("kind = 'book' AND page_from IS NOT NULL")
    h = b.where("passage_id % 20 = 0 AND page_to >= page_from").select("passage_id", "sysid", F.explode(F.sequence("page_from", "page_to")).alias("page"))
    f = b.where(F.size("figures") > 0).select(F.col("passage_id").alias("photo"), "sysid", F.col("page_from").alias("page"))
    return h.join(f, ["sysid", "page"]).select("passage_id", "photo")


@register(
    """WITH b AS (SELECT l_orderkey, l_linenumber AS n, l_partkey % 100 AS x, l_suppkey % 100 AS y, l_quantity AS w, 10 + l_linenumber AS h FROM lineitem)
    SELECT a.l_orderkey, a.n AS block, c.n AS box FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.n <> c.n
    WHERE greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) > 0.5 * a.w * a.h"""
)
def overlap_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of which more than half lies inside another box of the same page (an order of at most seven lines)."""
    b = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 100).alias("y"), F.col("l_quantity").alias("w"), (10 + F.col("l_linenumber")).alias("h"))
    c = b.select("l_orderkey", *[F.col(k).alias(f"c{k}") for k in "nxywh"])
    side = lambda p, q: F.greatest(F.lit(0), F.least(F.col(p) + F.col(q), F.col(f"c{p}") + F.col(f"c{q}")) - F.greatest(F.col(p), F.col(f"c{p}")))
    return b.join(c, "l_orderkey").where("n != cn").where(side("x", "w") * side("y", "h") > 0.5 * F.col("w") * F.col("h")).select("l_orderkey", F.col("n").alias("block"), F.col("cn").alias("box"))


@register(
    """WITH s AS (SELECT l_orderkey, l_linenumber AS n, l_shipdate AS y, l_returnflag = 'R' AS step, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
    SELECT l_orderkey, n, last_value(CASE WHEN step THEN n END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY y, n, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM s"""
)
def asof_step(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")), ignorenulls=True).over(w)
    return read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), above.alias("above"))


@register(
    """WITH n AS (SELECT DISTINCT trim(regexp_replace(act, '\\s*\\(.*$', '')) AS name FROM docs WHERE act IS NOT NULL)
    SELECT doc_no, n.name FROM docs d JOIN n ON d.short IS NOT NULL AND length(n.name) >= 6 AND starts_with(d.short, n.name)"""
)
def containment_join(spark: SparkSession, sf: str) -> DataFrame:
    """Short names that begin with the name of an act: every prefix of a short name, a line of text, is a key, so this is a hash join."""
    d = read(spark, sf, "docs")
    names = d.where("act IS NOT NULL").select(F.trim(F.regexp_replace("act", r"\s*\(.*$", "")).alias("name")).where(F.length("name") >= 6).distinct()
    x = d.where("short IS NOT NULL").select("doc_no", "short")
    cuts = x.select("doc_no", F.explode(F.expr("transform(sequence(1, length(short)), i -> substring(short, 1, i))")).alias("name"))
    return cuts.join(names, "name").select("doc_no", "name")


@register(
    """WITH s AS (SELECT DISTINCT act AS subject FROM docs WHERE act IS NOT NULL),
    m AS (SELECT d.doc_id, s.subject FROM documents d JOIN s ON d.title = left(s.subject, 18) OR (length(s.subject) > 18 AND starts_with(d.title, left(s.subject, 18))))
    SELECT doc_id, min(subject) AS subject FROM m GROUP BY 1 HAVING count(DISTINCT subject) = 1"""
)
def unique_prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that share their first 18 characters with exactly one act."""
    s = read(spark, sf, "docs").where("act IS NOT NULL").select(F.col("act").alias("subject"), F.left("act", F.lit(18)).alias("k")).distinct()
    d = read(spark, sf, "documents").where("title IS NOT NULL").select("doc_id", "title", F.left("title", F.lit(18)).alias("k"))
    m = d.join(s, "k").where((F.col("title") == F.col("k")) | (F.length("subject") > 18))
    return m.groupBy("doc_id").agg(F.min("subject").alias("subject"), F.count_distinct("subject").alias("n")).where("n = 1").select("doc_id", "subject")


@register(
    """SELECT coalesce(q.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'unanswered' ELSE 'unknown' END AS side
    FROM (SELECT DISTINCT id FROM questions) q FULL JOIN (SELECT DISTINCT id FROM coding_round6) a ON q.id = a.id WHERE q.id IS NULL OR a.id IS NULL"""
)
def symmetric_diff(spark: SparkSession, sf: str) -> DataFrame:
    q = read(spark, sf, "questions").select("id", F.lit(1).alias("q")).distinct()
    a = read(spark, sf, "coding_round6").select("id", F.lit(1).alias("a")).distinct()
    return q.join(a, "id", "full").where("q IS NULL OR a IS NULL").select("id", F.when(F.col("a").isNull(), "unanswered").otherwise("unknown").alias("side"))


@register(
    """SELECT 'both' AS part, sysid AS k FROM (SELECT sysid FROM passages INTERSECT SELECT doc_key FROM docs)
    UNION ALL SELECT 'docs only', k FROM (SELECT doc_key AS k FROM docs EXCEPT SELECT sysid FROM passages) UNION ALL SELECT 'either', k FROM (SELECT sysid AS k FROM passages UNION SELECT doc_key FROM docs)"""
)
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "passages").select(F.col("sysid").alias("k"))
    b = read(spark, sf, "docs").select(F.col("doc_key").alias("k"))
    tag = lambda name, df: df.select(F.lit(name).alias("part"), "k")
    return tag("both", a.intersect(b)).unionByName(tag("docs only", b.subtract(a))).unionByName(tag("either", a.union(b).distinct()))


@register(
    """SELECT id, len(list_distinct(sources))::INTEGER AS sources, len(list_intersect(list_distinct(sources), list_distinct(faults)))::INTEGER AS shared,
    list_sort(list_filter(list_distinct(sources), lambda x: NOT list_contains(coalesce(faults, []), x))) AS left_over, answer_id FROM answers WHERE sources IS NOT NULL"""
)
def set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    faults = F.coalesce("faults", F.array().cast("array<string>"))
    return read(spark, sf, "answers").where("sources IS NOT NULL").select(
        "id", F.size(F.array_distinct("sources")).alias("sources"), F.size(F.array_intersect("sources", faults)).alias("shared"), F.array_sort(F.array_except("sources", faults)).alias("left_over"), "answer_id"
    )


@register(
    """WITH w AS (SELECT answer_id, unnest(list_distinct(list_filter(string_split_regex(lower(question), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> ''))) AS term FROM answers WHERE question IS NOT NULL),
    r AS (SELECT term, ln((SELECT count(*) FROM answers) / count(*)) AS rarity FROM w GROUP BY 1),
    m AS (SELECT answer_id, sum(rarity) AS mass FROM w JOIN r USING (term) GROUP BY 1)
    SELECT answer_id, round(mass, 6) AS mass, mass >= 0.9 * max(mass) OVER (PARTITION BY a.id) AS near_best FROM m JOIN (SELECT answer_id, id FROM answers) a USING (answer_id)"""
)
def figure_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Rarity mass of the words, and whether a row comes within a tenth of the best of its question."""
    a = read(spark, sf, "answers")
    n = a.count()
    w = a.where("question IS NOT NULL").select("answer_id", "id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term"))
    r = w.groupBy("term").agg(F.log(F.lit(float(n)) / F.count("*")).alias("rarity"))
    m = w.join(r, "term").groupBy("answer_id", "id").agg(F.sum("rarity").alias("mass"))
    return m.select("answer_id", F.round("mass", 6).alias("mass"), (F.col("mass") >= 0.9 * F.max("mass").over(Window.partitionBy("id"))).alias("near_best"))


@register("SELECT a.answer_id FROM answers a SEMI JOIN questions q ON q.id = a.id")
def eligible_answers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "answers").join(read(spark, sf, "questions").select("id"), "id", "left_semi").select("answer_id")


@register(
    """SELECT d.doc_key, count(p.passage_id) AS chunks, count(DISTINCT p.section) AS sections, count(p.passage_id) = 0 AS missing FROM docs d LEFT JOIN passages p ON p.sysid = d.doc_key GROUP BY 1"""
)
def integrity_check(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks are counted by document before the join: the document with a tenth of the rows is one row by then."""
    per = read(spark, sf, "passages").groupBy(F.col("sysid").alias("doc_key")).agg(F.count("*").alias("chunks"), F.count_distinct("section").alias("sections"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return read(spark, sf, "docs").select("doc_key").join(per, "doc_key", "left").select("doc_key", zero("chunks"), zero("sections"), F.col("chunks").isNull().alias("missing"))


@register("SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F'")
def order_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").join(read(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return read(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment", "n_name")
